"""Logistic regression over samples in long form.

``x`` has (sample, feature, value), ``y`` (sample, label), ``w`` (feature, w).
Each step is joins and partial aggregations; weights stay a DataFrame, however
many features there are.  Samples without features take part with margin 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import log1p_exp, sigmoid, soft_threshold
from ..plans.lineage import release, table
from .cells import frequent, with_params


@dataclass(frozen=True)
class Config:
    iterations: int = 10
    step: float = 0.1
    l1: float = 0.0
    adagrad: bool = False
    epsilon: float = 1e-3


def replace_iterations(c: Config, iterations: int) -> Config:
    return replace(c, iterations=iterations)


def zero_weights(x: DataFrame) -> DataFrame:
    return x.select("feature").distinct().withColumn("w", F.lit(0.0))


def margins(x: DataFrame, y: DataFrame, w: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """(sample, label, z) with z = sum of w * value.  ``hot``: the frequent features, if known."""
    z = with_params(x, w, frequent(x) if hot is None else hot).groupBy("sample").agg(F.sum(F.col("w") * F.col("value")).alias("z"))
    return y.join(z, "sample", "left").select("sample", "label", F.coalesce("z", F.lit(0.0)).alias("z"))


def positive() -> Column:
    return (F.col("label") > 0).cast("double")


def loss(m: DataFrame) -> DataFrame:
    z = F.col("z")
    return m.agg(F.avg(F.when(F.col("label") > 0, log1p_exp(-z)).otherwise(log1p_exp(z))).alias("loss"))


def gradient_sgd(x: DataFrame, m: DataFrame, n: int) -> DataFrame:
    """(feature, g): mean of value * (sigmoid(z) - y)."""
    err = m.select("sample", (sigmoid(F.col("z")) - positive()).alias("m"))
    return x.join(err, "sample").groupBy("feature").agg((F.sum(F.col("value") * F.col("m")) / n).alias("g"))


def gradient_mis(x: DataFrame, m: DataFrame, epsilon: float) -> DataFrame:
    """(feature, g): minus the log ratio of the two labels' weighted sums; values must not be negative.

    With epsilon 0, a feature that one label lacks has gradient 0.
    """
    q = m.select("sample", "label", sigmoid(-F.when(F.col("label") > 0, F.col("z")).otherwise(-F.col("z"))).alias("q"))
    part = lambda c: F.sum(F.when(c, F.col("q") * F.col("value")).otherwise(0.0))
    mu = x.join(q, "sample").groupBy("feature").agg(part(F.col("label") > 0).alias("up"), part(F.col("label") <= 0).alias("um"))
    g = -F.log((F.col("up") + epsilon) / (F.col("um") + epsilon))
    if epsilon == 0:
        g = F.when((F.col("up") == 0) | (F.col("um") == 0), F.lit(0.0)).otherwise(g)
    return mu.select("feature", g.alias("g"))


def adagrad(state: DataFrame | None, g: DataFrame, epsilon: float = 1e-4, rho: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(gradient, state): squares add up; features without a gradient keep their state."""
    if state is None:
        new = g.select("feature", "g", (F.col("g") * F.col("g")).alias("s"))
    else:
        j = state.join(g, "feature", "full")
        new = j.select("feature", "g", (F.coalesce("s", F.lit(0.0)) * F.when(F.col("g").isNull(), 1.0).otherwise(rho) + F.coalesce(F.col("g") * F.col("g"), F.lit(0.0))).alias("s"))
    return new.where("g is not null").select("feature", (F.col("g") / (F.lit(epsilon) + F.sqrt("s"))).alias("g")), new.select("feature", "s")


def adadelta(state: DataFrame | None, g: DataFrame, epsilon: float = 1e-4, rho: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(gradient, state) with decayed squares of gradients (eg) and of updates (ed)."""
    j = g.withColumns({"eg": F.lit(0.0), "ed": F.lit(0.0)}) if state is None else g.join(state, "feature", "left").fillna(0.0, ["eg", "ed"])
    eg = F.col("eg") * rho + F.col("g") * F.col("g") * (1 - rho)
    j = j.select("feature", "g", eg.alias("eg"), "ed")
    j = j.withColumn("d", F.col("g") * F.sqrt(F.col("ed") + epsilon) / F.sqrt(F.col("eg") + epsilon))
    return j.select("feature", F.col("d").alias("g")), j.select("feature", "eg", (F.col("ed") * rho + F.col("d") * F.col("d") * (1 - rho)).alias("ed"))


def update(w: DataFrame, g: DataFrame, step: float, shrink: float = 0.0) -> DataFrame:
    """w - step * g, then shrunk toward 0 by ``shrink``; features without a gradient stay."""
    moved = F.col("w") - F.col("g") * step
    moved = soft_threshold(moved, shrink) if shrink > 0 else moved
    return w.join(g, "feature", "left").select("feature", F.when(F.col("g").isNull(), F.col("w")).otherwise(moved).alias("w"))


def step_size(c: Config, i: int, mis: bool = False) -> float:
    if c.adagrad:
        return c.step * min(i / 11, 1.0)
    return c.step / math.sqrt(10 + i if mis else i)


def train(x: DataFrame, y: DataFrame, c: Config, w: DataFrame | None = None, mis: bool = False) -> DataFrame:
    """(feature, w) after c.iterations full-batch steps; weights and state are written down after each.

    A step reads the weights twice, so plans of several steps would double with each.
    """
    spark, old, now = x.sparkSession, [], []
    hot, n = frequent(x), y.count()
    w, state = table(zero_weights(x) if w is None else w, now), None
    for i in range(1, c.iterations + 1):
        m = margins(x, y, w, hot)
        g = gradient_mis(x, m, c.epsilon) if mis else gradient_sgd(x, m, n)
        old, now = now, []
        if c.adagrad:
            g, state = adagrad(state, table(g, old))
            state = table(state, now)
        w = table(update(w, g, step_size(c, i, mis), c.l1 * c.step / math.sqrt(i)), now)
        m = g = None
        release(spark, old)
    return w


def predict(x: DataFrame, ids: DataFrame, w: DataFrame) -> DataFrame:
    """(sample, score): probability of the positive label."""
    y = ids.select("sample").withColumn("label", F.lit(0.0))
    return margins(x, y, w).select("sample", sigmoid(F.col("z")).alias("score"))
