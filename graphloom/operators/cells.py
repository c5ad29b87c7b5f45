"""Joins of cells (sample, feature, value) with a table by feature.

Some features are in nearly every sample.  Dealt by feature, all their cells would
meet in one task; the parameters of the most frequent ones go to the cells instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many features at most are broadcast; each of the others has at most 1 / HOT of the cells.
HOT = 256


def frequent(x: DataFrame) -> list[int]:
    """The HOT features with most cells (or with the highest degree, if ``x`` is a table of parameters)."""
    n = x.select("feature", F.col("degree").alias("n")) if "degree" in x.columns else x.groupBy("feature").agg(F.count("*").alias("n"))
    return [r.feature for r in n.where("feature is not null").orderBy(F.desc("n"), "feature").limit(HOT).collect()]


def with_params(x: DataFrame, params: DataFrame, hot: list[int]) -> DataFrame:
    """Cells with their feature's parameters, as by an inner join; features in ``hot`` by broadcast."""
    if not hot:
        return x.join(params, "feature")
    often = F.col("feature").isin(hot)
    near = x.where(often).join(F.broadcast(params.where(often)), "feature")  # HOT rows at most
    return near.unionByName(x.where(~often).join(params.where(~often), "feature"))
