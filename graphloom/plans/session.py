"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = str(PACKAGE.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        at = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(at)
    sc._graphloom_shipped = True
