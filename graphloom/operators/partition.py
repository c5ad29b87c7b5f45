"""Vertex-cut partitioners: a partition number for every edge.

All are expressions or aggregations over edges; none needs a driver-side table
that grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Fixed value: multiplier that mixes ids.
MIXING_PRIME = 1125899906842597


def wrapped_product(x: Column, factor: int = MIXING_PRIME) -> Column:
    """abs(x * factor) with 64-bit two's-complement wraparound, as decimal(20, 0)."""
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    p = x.cast("decimal(20,0)") * F.lit(factor).cast("decimal(17,0)")
    m = F.pmod(p, two64)
    return F.abs(F.when(m >= F.lit(str(2**63)).cast("decimal(20,0)"), m - two64).otherwise(m))


def _mod(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n).cast("decimal(20,0)")).cast("int")


def edge_1d(parts: int, end: str = "src") -> Column:
    """All edges of a source together."""
    return _mod(wrapped_product(F.col(end)), parts)


def edge_2d(parts: int) -> Column:
    """A grid of about sqrt(parts) x sqrt(parts): a vertex is in at most 2 sqrt(parts) partitions."""
    side = 1
    while side * side < parts:
        side += 1
    return F.pmod(_mod(wrapped_product(F.col("src")), side) * side + _mod(wrapped_product(F.col("dst")), side), F.lit(parts)).cast("int")


def random_cut(parts: int) -> Column:
    """Equal (src, dst) together."""
    return F.pmod(F.xxhash64("src", "dst"), F.lit(parts)).cast("int")


def canonical_cut(parts: int) -> Column:
    """Both directions of a pair together."""
    return F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(parts)).cast("int")


STRATEGIES = {"EdgePartition1D": edge_1d, "EdgePartition2D": edge_2d, "RandomVertexCut": random_cut, "CanonicalRandomVertexCut": canonical_cut}


def partition_id(strategy: str, parts: int) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"no such partition strategy: {strategy}")
    return STRATEGIES[strategy](parts)


def _with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the total degree of both ends (``_ds``, ``_dd``)."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return edges.join(deg.select(F.col("id").alias("src"), F.col("d").alias("_ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("_dd")), "dst")


def by_low_degree(edges: DataFrame, parts: int, threshold: int = 0) -> DataFrame:
    """Hash of the end of lower degree (ties: dst); of the higher where both are below ``threshold``."""
    e = _with_degrees(edges)
    low = F.when(F.col("_ds") < F.col("_dd"), F.col("src")).otherwise(F.col("dst"))
    high = F.when(F.col("_ds") < F.col("_dd"), F.col("dst")).otherwise(F.col("src"))
    key = F.when(F.greatest("_ds", "_dd") < threshold, high).otherwise(low)
    return e.withColumn("pid", _mod(wrapped_product(key), parts)).select(*edges.columns, "pid")


def by_destination(edges: DataFrame, parts: int) -> DataFrame:
    return edges.withColumn("pid", edge_1d(parts, "dst"))


def balanced_by_key(edges: DataFrame, parts: int) -> DataFrame:
    """Keys packed, in order, into partitions of equal size.

    An edge's key is its end of higher degree (ties: src).  Keys' edge counts are
    summed in key order through ranges of keys, so no task sees all keys; an
    edge's rank within its key decides its side of a split.
    """
    spark = edges.sparkSession
    e = _with_degrees(edges).withColumn("_key", F.when(F.col("_ds") >= F.col("_dd"), F.col("src")).otherwise(F.col("dst"))).select(*edges.columns, "_key")
    total = edges.count()
    size = max(1, -(-total // parts))
    counts = e.groupBy("_key").agg(F.count("*").alias("_n"))
    bounds = sorted({int(x) for x in counts.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", [i / 64 for i in range(1, 64)], 0.01)})
    block = F.lit(0)
    for k, b in enumerate(bounds):
        block = F.when(F.col("_key") >= b, k + 1).otherwise(block)
    counts = counts.withColumn("_block", block)
    per = {r["_block"]: r["n"] for r in counts.groupBy("_block").agg(F.sum("_n").alias("n")).collect()}  # at most 64 rows
    base, at = [], 0
    for k in sorted(per):
        base.append((k, at))
        at += per[k]
    w = Window.partitionBy("_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.join(F.broadcast(spark.createDataFrame(base, "_block int, _base long")), "_block").select("_key", (F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_first"))
    # an edge's rank within its key, through ranges of the other end, so that a key of very many edges is no single task
    attrs = [c for c in edges.columns if c not in ("src", "dst")]
    e = e.withColumn("_other", F.when(F.col("_key") == F.col("src"), F.col("dst")).otherwise(F.col("src")))
    bounds = sorted({int(x) for x in e.select(F.col("_other").cast("double").alias("k")).approxQuantile("k", [i / 64 for i in range(1, 64)], 0.01)})
    part = F.lit(0)
    for k, b in enumerate(bounds):
        part = F.when(F.col("_other") >= b, k + 1).otherwise(part)
    e = e.withColumn("_part", part)
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows a key
    before = e.groupBy("_key", "_part").agg(F.count("*").alias("_n")).select("_key", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_part").orderBy("src", "dst", *attrs)) - 1
    out = e.join(first, "_key").join(before, ["_key", "_part"]).withColumn("pid", F.floor((F.col("_first") + rank) / size).cast("int"))
    return out.select(*edges.columns, "pid")


def by_label_propagation(edges: DataFrame, parts: int, rounds: int = 4) -> DataFrame:
    """Vertices move to the label that most neighbours have, as far as balance lets them.

    Each round, a vertex wants the commonest label among its neighbours (ties:
    lowest).  Of those that want to go from label a to b, a share is let through
    so that b's load stays below a tenth over the mean; a hash of the id and the
    round picks them.  Only a parts x parts table of wishes reaches the driver.
    An edge goes with its source's label.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    v = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")).withColumn("pid", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    both = cut(both)
    v = cut(v)
    for i in range(rounds):
        near = both.join(v.select(F.col("id").alias("dst"), "pid"), "dst").groupBy(F.col("src").alias("id"), "pid").agg(F.count("*").alias("n"))
        want = near.groupBy("id").agg(F.max(F.struct("n", (-F.col("pid")).alias("k"))).alias("x")).select("id", (-F.col("x.k")).alias("want"))
        w = cut(v.join(want, "id", "left").withColumn("want", F.coalesce("want", "pid")))
        wish = {(r.pid, r.want): r.d for r in w.groupBy("pid", "want").agg(F.sum("deg").alias("d")).collect()}
        load = [sum(d for (a, _), d in wish.items() if a == p) for p in range(parts)]
        top = 1.1 * sum(load) / parts
        share = {}
        for p in range(parts):
            coming = sum(d for (a, b), d in wish.items() if b == p != a)
            room = max(0.0, top - load[p])
            for (a, b), _ in wish.items():
                if b == p != a:
                    share[a, b] = min(1.0, room / coming) if coming else 0.0
        rows = [(a, b, s) for (a, b), s in share.items()] or [(0, 0, 0.0)]
        t = spark.createDataFrame(rows, "pid int, want int, share double")
        draw = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 30)) / (1 << 30)
        v = cut(w.join(F.broadcast(t), ["pid", "want"], "left").select("id", "deg", F.when(draw < F.coalesce("share", F.lit(0.0)), F.col("want")).otherwise(F.col("pid")).alias("pid")))
    return edges.join(v.select(F.col("id").alias("src"), "pid"), "src").select(*edges.columns, "pid")


def ranges(upper: int, parts: int) -> list[int]:
    """parts + 1 ascending offsets over [0, upper]; the first ``upper % parts`` ranges get one more."""
    q, r = divmod(upper, parts)
    return [k * q + min(k, r) for k in range(parts + 1)]


def partition_edges(name: str, edges: DataFrame, parts: int) -> DataFrame:
    """Edges with ``pid`` by a strategy's name, as topic models choose them."""
    plain = {"direct": lambda e: e.withColumn("pid", F.spark_partition_id() % parts), "byterm": lambda e: e.withColumn("pid", edge_1d(parts)), "bydoc": lambda e: by_destination(e, parts), "edge2d": lambda e: e.withColumn("pid", edge_2d(parts))}
    joined = {"dbh": by_low_degree, "vsdlp": by_label_propagation, "bbr": balanced_by_key}
    if name in plain:
        return plain[name](edges)
    if name in joined:
        return joined[name](edges, parts)
    raise ValueError(f"no such partition strategy: {name}")
