"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rmse(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("rmse"))


def log_loss(label: str = "label", margin: str = "score") -> Column:
    from .exprs import log1p_exp

    z = F.col(margin)
    return F.avg(F.when(F.col(label) > 0, log1p_exp(-z)).otherwise(log1p_exp(z)))


def auc(rows: DataFrame, label: str = "label", score: str = "score", blocks: int = 64) -> DataFrame:
    """Area under the ROC curve; tied scores count a half.

    Rows are first counted by distinct score.  Score ranges (at most ``blocks``)
    give each its number of lower negatives, so no task sorts all scores.
    """
    spark = rows.sparkSession
    pos = F.col(label) > 0
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(pos.cast("long")).alias("p"), F.sum((~pos).cast("long")).alias("n"))
    cuts = sorted(set(rows.select(F.col(score).cast("double").alias("s")).approxQuantile("s", [k / blocks for k in range(1, blocks)], 0.005)))
    block = F.lit(0)
    for k, c in enumerate(cuts):
        block = F.when(F.col("s") >= c, k + 1).otherwise(block)
    by = by.withColumn("b", block)
    per = by.groupBy("b").agg(F.sum("n").alias("n")).collect()  # at most ``blocks`` rows
    base, at = [], 0
    for r in sorted(per, key=lambda r: r.b):
        base.append((r.b, at))
        at += r.n
    base = spark.createDataFrame(base, "b int, base long")
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))
    t = by.join(F.broadcast(base), "b").select("p", "n", below.alias("below"))
    return t.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
