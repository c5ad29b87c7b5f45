"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins, so no component is ever
gathered in one task; each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, keep: list[str] | None = None) -> DataFrame:
    """(id, component): smallest id reachable, for every id that has a link.

    Null ids, self-links and repeated links are ignored; no links give no rows.
    """
    spark = links.sparkSession
    e = links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    old: list[str] = []
    now: list[str] = []
    e = cut(e.distinct(), old)
    state = None
    while True:
        e = cut(_small(_large(e)), now)
        drop(spark, old)
        old, now = now, []
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if got == state:
            break
        state = got
    if keep is not None:
        keep += old
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
