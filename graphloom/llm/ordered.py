"""Documents in doc_id order without a single-partition sort.

Cut points between ranges come from quantiles of doc_id alone; each range is one
partition, sorted by itself.  Every range is numbered, so that what a range
needs from its neighbour can be addressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending ids that divide the rows about evenly."""
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).where("x is not null")
    got = ids.approxQuantile("x", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted({int(x) for x in got})


def range_number(column: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are at or below the value; by binary search. Null counts as lowest."""
    if not cuts:
        return F.lit(0)
    k = len(cuts) // 2
    low, high = range_number(column, cuts[:k]), range_number(column, cuts[k + 1 :])
    return F.when(column >= cuts[k], high + (k + 1)).otherwise(low)


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
