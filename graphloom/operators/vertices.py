"""Relational operators on keyed vertex frames (unique ``id``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(rows: DataFrame) -> DataFrame:
    """One row for each id: the least."""
    attrs = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*attrs)).alias("_v")).select("id", "_v.*")


def filter_vertices(v: DataFrame, predicate: Column) -> DataFrame:
    return v.where(predicate)


def map_values(v: DataFrame, **columns: Column) -> DataFrame:
    return v.select("id", *(c.alias(k) for k, c in columns.items()))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose id b lacks."""
    return a.join(b, "id", "left_anti")


def diff(a: DataFrame, b: DataFrame, name: str = "attr") -> DataFrame:
    """Ids in both with another value, with b's value."""
    o = b.select("id", F.col(name).alias("_other"))
    return a.join(o, "id").where(~F.col(name).eqNullSafe(F.col("_other"))).select("id", F.col("_other").alias(name))


def left_join(a: DataFrame, b: DataFrame, **columns: Column) -> DataFrame:
    return a.join(b, "id", "left").select("id", *(c.alias(k) for k, c in columns.items()))


def inner_join(a: DataFrame, b: DataFrame, **columns: Column) -> DataFrame:
    return a.join(b, "id").select("id", *(c.alias(k) for k, c in columns.items()))


def inner_join_keep_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with b's attributes where b has the id; others keep their own."""
    attrs = [c for c in a.columns if c != "id"]
    o = b.select("id", *(F.col(c).alias(f"_{c}") for c in attrs), F.lit(True).alias("_hit"))
    return a.join(o, "id", "left").select("id", *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in attrs))


def aggregate_using_index(index: DataFrame, messages: DataFrame, **merge: Column) -> DataFrame:
    """Messages merged by id; ids that ``index`` lacks are dropped.

    The messages are combined first, so that the semi-join meets one row an id.
    """
    return messages.groupBy("id").agg(*(c.alias(k) for k, c in merge.items())).join(index.select("id"), "id", "left_semi")


def edge_inner_join(a: DataFrame, b: DataFrame, **columns: Column) -> DataFrame:
    return a.join(b, ["src", "dst"]).select("src", "dst", *(c.alias(k) for k, c in columns.items()))


def number_rows(rows: DataFrame, by: list[str], blocks: int = 256) -> DataFrame:
    """``index`` from 0 in the order of ``by`` (whose first column is numeric), without a one-task sort.

    Rows are sorted within ranges of the first column; the ranges' sizes (at most
    ``blocks``) give each range's first number.
    """
    spark = rows.sparkSession
    cuts = sorted(set(rows.select(F.col(by[0]).cast("double").alias("x")).approxQuantile("x", [k / blocks for k in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []

    def number(c: list[float], at: int) -> Column:
        if not c:
            return F.lit(at)
        k = len(c) // 2
        return F.when(F.col(by[0]).cast("double") >= c[k], number(c[k + 1 :], at + k + 1)).otherwise(number(c[:k], at))

    r = rows.withColumn("_block", number(cuts, 0))
    per = {x["_block"]: x["n"] for x in r.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for k in sorted(per):
        base.append((k, at))
        at += per[k]
    w = Window.partitionBy("_block").orderBy(*by)
    out = r.join(F.broadcast(spark.createDataFrame(base, "_block int, _base long")), "_block")
    return out.withColumn("index", F.col("_base") + F.row_number().over(w) - 1).select(*rows.columns, "index")


def bernoulli(rows: DataFrame, fraction: float, iteration: int, key: str = "id") -> DataFrame:
    """A sample without replacement that depends on key and iteration only."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(42 + iteration)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(u < fraction)
