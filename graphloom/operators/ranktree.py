"""Boosted regression trees for ranking, on long-form binned features.

Samples are (query, doc, label, score); features (query, doc, feature, bin) with
bin 0 implicit (absent rows).  Scores, gradients and node membership stay
DataFrames keyed by (query, doc); only node and split tables, whose size is
bounded by leaves, features and bins, meet the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Smoothing of leaf outputs, and the normaliser's factor.
LEAF_EPSILON = 1e-9
NORM_FACTOR = 10.0


@dataclass(frozen=True)
class Config:
    trees: int = 10
    leaves: int = 8
    depth: int = 8
    rate: float = 0.1
    sigma: float = 1.0
    gains: tuple[float, ...] = (0.0, 1.0, 3.0, 7.0, 15.0)
    min_instances: int = 1
    lowest_first: bool = False  # the growth order of the surveyed trees; else best gain first


@dataclass
class Tree:
    """Nodes by number (root 1, children 2i and 2i + 1)."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)  # node -> feature, threshold bin, gain
    outputs: dict[int, float] = field(default_factory=dict)


def gain(label: Column, gains: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, gains)), label.cast("int") + 1)


def discount(rank: Column) -> Column:
    """1 / ln(position + 2) for positions from 0; ``rank`` counts from 1."""
    return F.lit(1.0) / F.log(rank + 1.0)


def score_rank() -> Column:
    """Rank in the order of current scores; of equal scores the later document comes first."""
    return F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("doc")))


def ideal_dcg(samples: DataFrame, gains: tuple[float, ...]) -> DataFrame:
    """(query, idcg): 0 where no document has a gain."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("label"), "doc"))
    return samples.select("query", (gain(F.col("label"), gains) * discount(rank)).alias("g")).groupBy("query").agg(F.sum("g").alias("idcg"))


def ndcg_error(samples: DataFrame, gains: tuple[float, ...]) -> DataFrame:
    """Mean over queries of 1 - DCG / IDCG (0 for a query without gains)."""
    d = samples.withColumn("g", gain(F.col("label"), gains) * discount(score_rank())).groupBy("query").agg(F.sum("g").alias("dcg"))
    e = F.when(F.col("idcg") > 0, F.lit(1.0) - F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return d.join(ideal_dcg(samples, gains), "query").agg(F.avg(e).alias("error"))


def _derivative_parts(a: pd.DataFrame, b: pd.DataFrame, sigma: float, same: bool) -> tuple[np.ndarray, ...]:
    """Sums of lambda, weight and p * delta over the pairs of two blocks of a query, for both blocks' rows."""

    def one(x, y):  # rows of x that win over rows of y
        win = x["label"].to_numpy()[:, None] > y["label"].to_numpy()[None]
        p = 2 / (1 + np.exp(np.minimum(2 * sigma * (x["score"].to_numpy()[:, None] - y["score"].to_numpy()[None]), 700)))
        delta = (x["gain"].to_numpy()[:, None] - y["gain"].to_numpy()[None]) * np.abs(x["disc"].to_numpy()[:, None] - y["disc"].to_numpy()[None]) / x["idcg"].to_numpy()[:, None]
        return np.where(win, p * delta, 0), np.where(win, p * (2 - p) * delta, 0)

    l, w = one(a, b)
    la, wa, pa_, lb, wb, pb = l.sum(1), w.sum(1), l.sum(1), -l.sum(0), w.sum(0), l.sum(0)
    if not same:
        l, w = one(b, a)
        la, wa, pa_, lb, wb, pb = la - l.sum(0), wa + w.sum(0), pa_ + l.sum(0), lb + l.sum(1), wb + w.sum(1), pb + l.sum(1)
    return la, wa, pa_, lb, wb, pb


def derivatives(samples: DataFrame, c: Config, block: int = 1024, small: int = 64) -> DataFrame:
    """(query, doc, lambda, weight).

    Each pair of one query with label_i > label_j adds p * delta to i, takes it
    from j, and adds p (2 - p) delta to both weights; all of a query is scaled by
    10 ln(1 + S) / S with S the sum of 2 p delta.  Queries of at most ``small``
    documents join with themselves (at most small / 2 pairs a document).  Larger
    ones meet in pairs of blocks, where pairs are summed as they are formed: a
    row for each document leaves a pair of blocks.
    """
    # all that a query's documents share comes from windows over it: samples are dealt once
    w = Window.partitionBy("query")
    ideal = gain(F.col("label"), c.gains) * discount(F.row_number().over(w.orderBy(F.desc("label"), "doc")))
    s = samples.withColumns({"disc": discount(score_rank()), "gain": gain(F.col("label"), c.gains), "ideal": ideal})
    s = s.withColumns({"idcg": F.sum("ideal").over(w), "n": F.count("*").over(w)}).where("idcg > 0").drop("ideal")
    one = _joined_parts(s.where(F.col("n") <= small), c).unionByName(_blocked_parts(s.where(F.col("n") > small), samples, c, block))
    total = one.groupBy("query").agg(F.sum("part").alias("S"))  # both ends of a pair have its p * delta
    norm = F.when(F.col("S") > 0, F.log1p("S") * NORM_FACTOR / F.col("S")).otherwise(1.0)
    got = one.join(total, "query").select("query", "doc", (F.col("l") * norm).alias("lambda"), (F.col("w") * norm).alias("weight"))
    return samples.select("query", "doc").join(got, ["query", "doc"], "left").fillna(0.0, ["lambda", "weight"])


def _joined_parts(s: DataFrame, c: Config) -> DataFrame:
    """(query, doc, l, w, part) of small queries."""
    a = s.select("query", F.col("doc").alias("i"), F.col("label").alias("li"), F.col("score").alias("si"), F.col("disc").alias("di"), F.col("gain").alias("gi"), "idcg")
    b = s.select("query", F.col("doc").alias("j"), F.col("label").alias("lj"), F.col("score").alias("sj"), F.col("disc").alias("dj"), F.col("gain").alias("gj"))
    p = F.lit(2.0) / (F.lit(1.0) + F.exp((F.col("si") - F.col("sj")) * (2 * c.sigma)))
    delta = (F.col("gi") - F.col("gj")) * F.abs(F.col("di") - F.col("dj")) / F.col("idcg")
    pair = a.join(b, "query").where("li > lj").select("query", "i", "j", (p * delta).alias("l"), (p * (F.lit(2.0) - p) * delta).alias("w"))
    ends = F.explode(F.array(F.struct(F.col("i").alias("doc"), F.col("l").alias("l")), F.struct(F.col("j").alias("doc"), (-F.col("l")).alias("l")))).alias("e")
    return pair.select("query", ends, "w", F.col("l").alias("part")).groupBy("query", "e.doc").agg(F.sum("e.l").alias("l"), F.sum("w").alias("w"), F.sum("part").alias("part"))


def _blocked_parts(s: DataFrame, samples: DataFrame, c: Config, block: int) -> DataFrame:
    """(query, doc, l, w, part) of large queries."""
    s = s.withColumn("b", F.ceil(F.col("n") / block)).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("b")))
    s = s.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    s = s.select("query", "doc", "label", "score", "disc", "gain", "idcg", "mine", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))
    sigma = c.sigma

    def run(g: pd.DataFrame) -> pd.DataFrame:
        q, x, y = g["query"].iat[0], g["x"].iat[0], g["y"].iat[0]
        a, b = g[g["mine"] == x], g[g["mine"] == y]
        la, wa, p, lb, wb, pb = _derivative_parts(a, b, sigma, x == y)
        if x == y:
            return pd.DataFrame({"query": q, "doc": a["doc"].to_numpy(), "l": la + lb, "w": wa + wb, "part": p + pb})
        both = [np.concatenate(t) for t in ((a["doc"], b["doc"]), (la, lb), (wa, wb), (p, pb))]
        return pd.DataFrame({"query": q, "doc": both[0], "l": both[1], "w": both[2], "part": both[3]})

    kind = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    parts = s.groupBy("query", "x", "y").applyInPandas(run, f"query {kind['query']}, doc {kind['doc']}, l double, w double, part double")
    return parts.groupBy("query", "doc").agg(F.sum("l").alias("l"), F.sum("w").alias("w"), F.sum("part").alias("part"))


def histograms(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(node, feature, bin, n, s, w) of (query, doc, node, lambda, weight); bin 0 from the node's totals."""
    j = features.where("bin > 0").join(nodes, ["query", "doc"])
    h = j.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("lambda").alias("s"), F.sum("weight").alias("w"))
    seen = h.groupBy("node", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("w").alias("w"))
    total = F.broadcast(node_totals(nodes))  # a row for each node
    zero = seen.alias("a").join(total.alias("t"), "node").select(
        "node", "feature", F.lit(0).cast(features.schema["bin"].dataType).alias("bin"), (F.col("t.n") - F.col("a.n")).alias("n"), (F.col("t.s") - F.col("a.s")).alias("s"), (F.col("t.w") - F.col("a.w")).alias("w")
    )
    return h.unionByName(zero)


def node_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("lambda").alias("s"), F.sum("weight").alias("w"))


def cumulated(hist: DataFrame, right: bool = False) -> DataFrame:
    """Running sums over bins: up to each bin, or from it on."""
    w = Window.partitionBy("node", "feature").orderBy(F.desc("bin") if right else "bin")
    return hist.select("node", "feature", "bin", *(F.sum(c).over(w).alias(c) for c in ("n", "s", "w")))


def split_gains(hist: DataFrame, least: int = 1) -> DataFrame:
    """(node, feature, bin, gain): s_l^2 / n_l + s_r^2 / n_r - s^2 / n for bin as the last of the left side."""
    whole = Window.partitionBy("node", "feature")
    t = hist.select("node", "feature", "bin", F.sum("n").over(whole.orderBy("bin")).alias("nl"), F.sum("s").over(whole.orderBy("bin")).alias("sl"), F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    g = F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("s") * F.col("s") / F.col("n")
    return t.where((F.col("nl") >= least) & (nr >= least)).select("node", "feature", "bin", g.alias("gain"))


def best_splits(hist: DataFrame, least: int = 1) -> DataFrame:
    """The best split of each node with a gain above 0 (ties: lowest feature, then bin)."""
    g = split_gains(hist, least).where("gain > 0")
    key = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return g.groupBy("node").agg(F.max(key).alias("x")).select("node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), "x.gain")


def route(nodes: DataFrame, features: DataFrame, splits: dict[int, tuple[int, int, float]]) -> DataFrame:
    """Samples of split nodes move to child 2i (bin <= threshold, or absent) or 2i + 1."""
    spark = nodes.sparkSession
    if not splits:
        return nodes
    t = F.broadcast(spark.createDataFrame([(n, f, b) for n, (f, b, _) in splits.items()], "node int, feature int, cutoff int"))  # a row for each node
    at = nodes.join(t, "node", "left")
    f = features.select("query", "doc", "feature", "bin")
    j = at.join(f, ["query", "doc", "feature"], "left")
    child = F.when(F.col("cutoff").isNull(), F.col("node")).when(F.coalesce("bin", F.lit(0)) <= F.col("cutoff"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return j.select("query", "doc", child.cast("int").alias("node"), "lambda", "weight")


def leaf_outputs(nodes: DataFrame) -> DataFrame:
    """(node, output): sum of lambdas over the sum of weights."""
    return nodes.groupBy("node").agg((F.sum("lambda") / (F.sum("weight") + LEAF_EPSILON)).alias("output"))


def level(node: int) -> int:
    return node.bit_length() - 1


def grow(gradients: DataFrame, features: DataFrame, c: Config) -> tuple[Tree, DataFrame]:
    """A tree of at most c.leaves leaves, and the samples with their leaves."""
    nodes = cut(gradients.withColumn("node", F.lit(1)))
    tree, open_, leaves = Tree(), {1}, 1
    waiting: dict[int, tuple[int, int, float]] = {}
    while True:
        if open_:
            sub = nodes.where(F.col("node").isin(*open_))
            for r in best_splits(histograms(sub, features), c.min_instances).collect():  # a row for each open node
                if level(r.node) < c.depth:
                    waiting[r.node] = (r.feature, r.bin, r.gain)
        order = sorted(waiting, key=lambda k: (waiting[k][2] if c.lowest_first else -waiting[k][2], k))
        take = order[: max(0, c.leaves - leaves)]
        if not take:
            break
        # one level of the best candidates at once; children compete in the next round
        take = take[: max(1, len(take) // 2)] if len(order) > 1 else take[:1]
        now = {k: waiting.pop(k) for k in take}
        nodes = cut(route(nodes, features, now))
        tree.splits |= now
        leaves += len(now)
        open_ = {child for k in now for child in (2 * k, 2 * k + 1)}
    tree.outputs = {r.node: r.output for r in leaf_outputs(nodes).collect()}  # a row for each leaf
    return tree, nodes


def boost(samples: DataFrame, features: DataFrame, c: Config) -> tuple[list[Tree], DataFrame]:
    """Trees, and samples with their final scores."""
    trees: list[Tree] = []
    s = cut(samples.select("query", "doc", "label", F.lit(0.0).alias("score")))
    features = features.persist()
    for _ in range(c.trees):
        tree, nodes = grow(derivatives(s, c), features, c)
        trees.append(tree)
        out = F.broadcast(s.sparkSession.createDataFrame(list(tree.outputs.items()), "node int, output double"))
        step = nodes.join(out, "node").select("query", "doc", (F.col("output") * c.rate).alias("step"))
        s = cut(s.join(step, ["query", "doc"]).select("query", "doc", "label", (F.col("score") + F.col("step")).alias("score")))
    features.unpersist()
    return trees, s


def predict(ids: DataFrame, features: DataFrame, trees: list[Tree], rate: float) -> DataFrame:
    """(query, doc, score) by routing through every tree."""
    spark = ids.sparkSession
    score = ids.select("query", "doc").withColumn("score", F.lit(0.0))
    for tree in trees:
        nodes = ids.select("query", "doc", F.lit(1).alias("node"), F.lit(0.0).alias("lambda"), F.lit(0.0).alias("weight"))
        for d in range(max(map(level, tree.splits), default=-1) + 1):
            nodes = route(nodes, features, {k: v for k, v in tree.splits.items() if level(k) == d})
        out = F.broadcast(spark.createDataFrame(list(tree.outputs.items()), "node int, output double"))
        score = score.join(nodes.join(out, "node").select("query", "doc", "output"), ["query", "doc"]).select("query", "doc", (F.col("score") + F.col("output") * rate).alias("score"))
    return score


def tree_text(trees: list[Tree], rate: float) -> str:
    """Trees as lines of tab-separated lists."""
    out = [f"trees={len(trees)}\trate={rate!r}"]
    for k, t in enumerate(trees):
        inner = sorted(t.splits)
        number = {n: i for i, n in enumerate(inner)} | {n: ~i for i, n in enumerate(sorted(t.outputs))}
        lines = {
            "feature": [t.splits[n][0] for n in inner], "threshold": [t.splits[n][1] for n in inner], "gain": [repr(t.splits[n][2]) for n in inner],
            "left": [number.get(2 * n, ~0) for n in inner], "right": [number.get(2 * n + 1, ~0) for n in inner], "output": [repr(t.outputs[n]) for n in sorted(t.outputs)],
        }
        out += [f"tree={k}"] + ["\t".join([name, *map(str, v)]) for name, v in lines.items()]
    return "\n".join(out) + "\n"
