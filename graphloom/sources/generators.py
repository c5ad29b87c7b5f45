"""Graph generators as range projections: no driver-side edge lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def star(spark: SparkSession, n: int) -> Graph:
    """Vertices 1 to n - 1, each with an edge to 0."""
    return Graph.from_edges(spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1).alias("attr")), 1)


def grid(spark: SparkSession, rows: int, cols: int) -> Graph:
    """Row-major ids (vertex attribute: its row and column), edges to the right and below of weight 1."""
    at = spark.range(rows * cols).select("id", F.floor(F.col("id") / cols).alias("row"), F.pmod("id", F.lit(cols)).alias("col"))
    ends = F.array(F.when(F.col("col") + 1 < cols, F.col("id") + 1), F.when(F.col("row") + 1 < rows, F.col("id") + cols))
    edges = at.select(F.col("id").alias("src"), F.explode(ends).alias("dst")).where("dst is not null").withColumn("attr", F.lit(1.0))
    return Graph(at, edges)


def _uniform(k: int, seed: int, *cols):
    return (F.pmod(F.xxhash64(*cols, F.lit(seed), F.lit(k)), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)


def log_normal_degrees(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 1.3, most: int | None = None, seed: int = 1, tries: int = 32) -> DataFrame:
    """(id, degree): floor(exp(mu + sigma z)), drawn anew while it is not below ``most``.

    Draws are hashes of id and try; the first accepted one counts (0 if none of
    ``tries`` is).
    """
    most = n if most is None else most
    z = lambda t: F.sqrt(F.log(_uniform(2 * t, seed, "id")) * -2) * F.cos(_uniform(2 * t + 1, seed, "id") * (2 * np.pi))
    draws = F.array(*(F.floor(F.exp(z(t) * sigma + mu)) for t in range(tries)))
    ok = F.filter(draws, lambda d: d < most)
    return spark.range(n).select("id", F.coalesce(F.get(ok, F.lit(0)), F.lit(0)).cast("long").alias("degree"))


def out_edges(degrees: DataFrame, n: int, seed: int = 2) -> DataFrame:
    """``degree`` edges from each id to uniform ids below n."""
    e = degrees.where("degree > 0").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree"))).alias("k"))
    return e.select("src", F.floor(_uniform(0, seed, "src", "k") * n).cast("long").alias("dst"), F.lit(1).alias("attr"))


def log_normal_graph(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> Graph:
    """Out-degrees are log-normal; the vertex attribute is the out-degree."""
    d = log_normal_degrees(spark, n, mu, sigma, seed=seed)
    return Graph(d.withColumnRenamed("degree", "attr"), out_edges(d, n, seed + 1))


# The recursive matrix's quadrant probabilities.
QUADRANTS = (0.45, 0.15, 0.15, 0.25)


def rmat(spark: SparkSession, vertices: int, edges: int, seed: int = 3) -> Graph:
    """Distinct edges of a recursive matrix over a power of two of vertices.

    Quadrants are drawn batch-wise from a generator seeded by the batch's first
    number; rounds of draws go on until enough distinct edges are there.
    """
    bits = max(1, (vertices - 1).bit_length())
    side = 1 << bits
    if edges > side * side // 2:
        raise ValueError("more edges than half of all pairs")
    a, b, c, _ = QUADRANTS

    def draw(batches):
        for df in batches:
            if len(df):
                u = np.random.default_rng([seed, int(df["id"].iat[0])]).random((len(df), bits))
                right, down = ((u >= a) & (u < a + b)) | (u >= a + b + c), u >= a + b
                power = 1 << np.arange(bits - 1, -1, -1)
                yield pd.DataFrame({"src": (down * power).sum(1), "dst": (right * power).sum(1)})

    got, start, want = None, 0, edges
    while True:
        new = spark.range(start, start + 2 * want).mapInPandas(draw, "src long, dst long")
        got = new if got is None else got.union(new)
        start += 2 * want
        distinct = got.distinct()
        have = distinct.count()
        if have >= edges:
            break
        want = edges - have
    e = distinct.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(edges)
    return Graph.from_edges(e.withColumn("attr", F.lit(1)), 1)
