"""Topic models by Gibbs and Metropolis-Hastings sampling.

Tokens are (doc, term, pos, topic).  A sweep samples every token's topic against
counts that are frozen at the sweep's start outside the token's block and live
inside it, then recounts.  Blocks hold whole documents and run in parallel.  In a
block, documents (or terms, for the tree) are lanes: in each step, every lane
samples one token, against the counts of the step's start without the token itself.

Blocks are formed by hash and hold about BLOCK tokens, so their number grows with
the corpus.  A block counts its documents from its tokens; sparse counts of the
terms, only for what occurs in the block, are cogrouped in.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import lgamma
from ..plans.lineage import release, table
from .samplers import AliasTable, FTrees

#: Tokens of a block on the average; bounds what a worker holds.
BLOCK = 1 << 21
#: Cells of (token, topic) that a kernel works on together.
CELLS = 1 << 19
#: Tokens that inference samples together: it keeps their base values of all sweeps.
INFER = 1 << 18


@dataclass(frozen=True)
class Config:
    topics: int = 8
    alpha: float = 0.1
    beta: float = 0.01
    alpha_as: float = 0.1
    algorithm: str = "sparse"
    blocks: int = 64
    seed: int = 1
    init: str = "random"


# ------------------------------------------------------------ tokens


def tokens_from_bags(bags: DataFrame) -> DataFrame:
    """(doc, term, pos) from (doc, term, cnt): one row an occurrence."""
    return bags.where("cnt > 0").select("doc", "term", F.explode(F.sequence(F.lit(0), F.col("cnt").cast("int") - 1)).alias("pos"))


def _hash(k: int, *cols) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(k)), F.lit(1 << 30))


def initialise(tokens: DataFrame, c: Config) -> DataFrame:
    """Topics by a seeded hash.

    random: any topic for each token.  sparseterm: a term with more than
    max(100, K / 10) tokens draws from that many topics of its own; sparsedoc
    likewise for documents above max(10, tokens / 10).
    """
    k = c.topics
    free = F.pmod(_hash(c.seed, "doc", "term", "pos"), F.lit(k))
    if c.init == "random":
        return tokens.withColumn("topic", free.cast("int"))
    by = {"sparseterm": "term", "sparsedoc": "doc"}[c.init]
    n = tokens.groupBy(by).agg(F.count("*").alias("_n"))
    least = F.lit(max(100, k // 10)) if c.init == "sparseterm" else F.greatest(F.lit(10).cast("long"), F.floor(F.col("_n") / 10))
    t = tokens.join(n, by)
    slot = F.pmod(_hash(c.seed, "doc", "term", "pos"), least)
    own = F.pmod(_hash(c.seed + 1, by, slot), F.lit(k))
    return t.withColumn("topic", F.when(F.col("_n") > least, own).otherwise(free).cast("int")).drop("_n")


def term_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("term", "topic").agg(F.count("*").alias("nw"))


def doc_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("doc", "topic").agg(F.count("*").alias("nd"))


def topic_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("topic").agg(F.count("*").alias("nk"))


def alpha_k(nk: Column, n: int, c: Config) -> Column:
    """Asymmetric prior: (n_k + alpha') * alpha K / (N + alpha' K)."""
    return (nk + c.alpha_as) * (c.alpha * c.topics / (n + c.alpha_as * c.topics))


# ------------------------------------------------------------ kernels


@dataclass
class Block:
    """A block's tokens with the counts they need, as dense arrays."""

    doc: np.ndarray
    term: np.ndarray
    topic: np.ndarray
    nd: np.ndarray  # documents x K
    nw: np.ndarray  # terms x K
    nk: np.ndarray  # K
    alpha: np.ndarray
    beta: float
    vbeta: float
    rng: np.random.Generator

    def move(self, i: np.ndarray, new: np.ndarray) -> None:
        d, w, old, k = self.doc[i], self.term[i], self.topic[i], len(self.nk)
        for a, row in ((self.nd, d), (self.nw, w)):
            np.add.at(a, (row, old), -1)
            np.add.at(a, (row, new), 1)
        self.nk += np.bincount(new, minlength=k) - np.bincount(old, minlength=k)
        self.topic[i] = new

    def without(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of document, term and topic counts, each without its token."""
        at, z = np.arange(len(i)), self.topic[i]
        nd, nw, nk = self.nd[self.doc[i]], self.nw[self.term[i]], np.tile(self.nk, (len(i), 1))
        for a in (nd, nw, nk):
            a[at, z] -= 1
        return nd, nw, nk

    def lanes(self, by: np.ndarray, then: np.ndarray) -> Iterator[np.ndarray]:
        """Token numbers by step: one of each document (or term) that has some left.

        A lane takes its tokens in the order of ``then``, from a place of its own,
        so that lanes seldom come to the same term (or document) at once.
        """
        order = np.lexsort((then, by))
        first = np.flatnonzero(np.diff(by[order], prepend=-1))
        size = np.diff(first, append=len(order))
        long = np.argsort(-size, kind="stable")
        first, size = first[long], size[long]
        shift = (self.rng.random(len(size)) * size).astype(np.int64)
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # lanes of more tokens than the step's number
        step = max(1, CELLS // len(self.nk))
        for t, n in enumerate(active):
            for lo in range(0, n, step):
                hi = min(n, lo + step)
                yield order[first[lo:hi] + (t + shift[lo:hi]) % size[lo:hi]]


def _draws(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A column for each row of weights, by base values in [0, 1)."""
    c = np.cumsum(p, axis=1)
    return np.minimum((c <= (u * c[:, -1])[:, None]).sum(axis=1), p.shape[1] - 1)


def sparse_gibbs(b: Block) -> None:
    """Exact: smoothing, document and term parts with live counts, by document."""
    for i in b.lanes(b.doc, b.term):
        nd, nw, nk = b.without(i)
        den = nk + b.vbeta
        parts = np.stack((nw * (nd + b.alpha) / den, nd * b.beta / den, b.alpha * b.beta / den))
        which = _draws(b.rng.random(len(i)), parts.sum(axis=2).T)
        b.move(i, _draws(b.rng.random(len(i)), parts[which, np.arange(len(i))]))


def frozen_gibbs(b: Block) -> None:
    """Counts frozen for the sweep: a global and a term's table, and a document's part.

    A draw equal to the current topic is drawn anew at the rate by which the
    token inflates that topic's weight.
    """
    den = b.nk + b.vbeta
    glob = AliasTable(b.alpha * b.beta / den)
    new = b.topic.copy()
    step = max(1, CELLS // len(b.nk))
    for lo in range(0, len(new), step):
        i = np.arange(lo, min(lo + step, len(new)))
        at, nd, nw, z = np.arange(len(i)), b.nd[b.doc[i]], b.nw[b.term[i]], b.topic[i]
        own = nd * (nw + b.beta) / den
        own[at, z] = np.maximum(nd[at, z] - 1, 0) * np.maximum(nw[at, z] - 1 + b.beta, 0) / den[z]
        by_term = b.alpha * nw / den
        which = _draws(b.rng.random(len(i)), np.stack((own.sum(axis=1), by_term.sum(axis=1), np.full(len(i), glob.norm())), axis=1))
        k = _draws(b.rng.random(len(i)), np.where((which == 0)[:, None], own, by_term))
        again, rate = which == 1, 1 / np.maximum(nw[at, z], 1)
        for _ in range(3):
            again &= (k == z) & (b.rng.random(len(i)) < rate)
            if again.any():
                k[again] = _draws(b.rng.random(int(again.sum())), by_term[again])
        far = np.flatnonzero(which == 2)
        k[far] = glob.draw(b.rng, len(far))
        new[i] = k
    b.move(np.arange(len(new)), new)


def cycle_mh(b: Block, steps: int = 2) -> None:
    """Alternating document and term proposals, accepted against the exact conditional."""
    seen, stale = np.zeros(len(b.nw), bool), np.zeros(b.nw.shape)
    order = np.argsort(b.doc, kind="stable")
    size = np.bincount(b.doc, minlength=len(b.nd))
    first = np.cumsum(size) - size
    asum, prior = b.alpha.sum(), AliasTable(b.alpha)
    for i in b.lanes(b.doc, b.term):
        at, d, w, z = np.arange(len(i)), b.doc[i], b.term[i], b.topic[i]
        nd, nw, nk = b.without(i)
        p = (nd + b.alpha) * (nw + b.beta) / (nk + b.vbeta)
        q = b.nd[d] + b.alpha
        for _ in range(steps):
            # a document proposal is the topic of a random token of it, or the prior
            mine = b.topic[order[first[d] + (b.rng.random(len(i)) * size[d]).astype(np.int64)]]
            t = np.where(b.rng.random(len(i)) * (size[d] + asum) < size[d], mine, prior.draw(b.rng, len(i)))
            z = np.where(b.rng.random(len(i)) * p[at, z] * q[at, t] < p[at, t] * q[at, z], t, z)
            fresh = w[~seen[w] | (b.rng.random(len(i)) < 1e-2)]
            seen[fresh], stale[fresh] = True, (b.nw[fresh] + b.beta) / (b.nk + b.vbeta)
            qw = stale[w]
            t = _draws(b.rng.random(len(i)), qw)
            z = np.where(b.rng.random(len(i)) * p[at, z] * qw[at, t] < p[at, t] * qw[at, z], t, z)
        b.move(i, z)


def alias_mh(b: Block, steps: int = 2) -> None:
    """An exact document part and a stale term part as the proposal, by document."""
    seen, stale = np.zeros(len(b.nw), bool), np.zeros(b.nw.shape)
    for i in b.lanes(b.doc, b.term):
        at, w, z = np.arange(len(i)), b.term[i], b.topic[i]
        fresh = w[~seen[w]]
        seen[fresh], stale[fresh] = True, b.alpha * (b.nw[fresh] + b.beta) / (b.nk + b.vbeta)
        qs = stale[w]
        nd, nw, nk = b.without(i)
        p = (nd + b.alpha) * (nw + b.beta) / (nk + b.vbeta)
        exact = nd * (b.nw[w] + b.beta) / (b.nk + b.vbeta)
        total, norm = exact.sum(axis=1), qs.sum(axis=1)
        for _ in range(steps):
            own = b.rng.random(len(i)) * (total + norm) < total
            t = _draws(b.rng.random(len(i)), np.where(own[:, None], exact, qs))
            z = np.where(b.rng.random(len(i)) * p[at, z] * (exact + qs)[at, t] < p[at, t] * (exact + qs)[at, z], t, z)
        b.move(i, z)


def tree_gibbs(b: Block) -> None:
    """Exact, by term: a sum tree over alpha-weighted term counts and a document part."""
    for i in b.lanes(b.term, b.doc):
        nd, nw, nk = b.without(i)
        weight = (nw + b.beta) / (nk + b.vbeta)
        trees, part = FTrees(b.alpha * weight), nd * weight
        total = part.sum(axis=1)
        u = b.rng.random(len(i)) * (total + trees.norm())
        own = u < total
        b.move(i, np.where(own, _draws(b.rng.random(len(i)), part), trees.sample_from(np.where(own, 0.0, u - total))))


KERNELS: dict[str, Callable[[Block], None]] = {"frozen": frozen_gibbs, "light": cycle_mh, "sparse": sparse_gibbs, "alias": alias_mh, "ftree": tree_gibbs}


def kernel(name: str) -> Callable[[Block], None]:
    if name not in KERNELS:
        raise ValueError(f"no such algorithm: {name}")
    return KERNELS[name]


# ------------------------------------------------------------ sweeps


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct values, which are sorted."""
    x = column.combine_chunks().dictionary_encode()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    order = pc.sort_indices(x.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[x.indices.to_numpy(zero_copy_only=False)], x.dictionary.take(order)


def _counted(far: pa.Table, terms: pa.Array, k: int) -> np.ndarray:
    """Counts (term, topic, n) as an array of all the terms."""
    out = np.zeros((len(terms), k), np.int64)
    if far.num_rows:
        at = pc.index_in(far["term"], value_set=terms).to_numpy()
        np.add.at(out, (at, far["topic"].to_numpy()), far["n"].to_numpy())
    return out


def _blocks(rows: DataFrame, counts: DataFrame, blocks: int):
    """Rows (doc, term, …) by blocks of whole documents, each with the counts (term, topic, n) of its terms."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
    far = counts.join(rows.select("term", "block").distinct(), "term").select("block", "term", "topic", "n")  # of a term, ``blocks`` rows at most
    # columns of their own names: the two sides come from the same tokens
    far = far.select(*(F.col(x).alias(f"far_{x}") for x in far.columns)).toDF(*far.columns)
    return rows.groupBy("block").cogroup(far.groupBy("block"))


def sweep(tokens: DataFrame, c: Config, iteration: int, vocabulary: int, prior: DataFrame | None = None) -> DataFrame:
    """Tokens with new topics.  ``prior``: (term, topic, nw) of an older model, added to the counts."""
    run = kernel(c.algorithm)
    nw = term_counts(tokens)
    totals = dict(topic_counts(tokens).collect())  # K rows
    size = sum(totals.values())
    if prior is not None:
        nw = nw.unionByName(prior.select("term", "topic", "nw")).groupBy("term", "topic").agg(F.sum("nw").alias("nw"))
        for r in prior.groupBy("topic").agg(F.sum("nw").alias("n")).collect():  # K rows
            totals[r.topic] = totals.get(r.topic, 0) + r.n
    nk = np.array([totals.get(t, 0) for t in range(c.topics)], np.int64)
    n = int(nk.sum())
    alpha = (nk + c.alpha_as) * (c.alpha * c.topics / (n + c.alpha_as * c.topics))
    beta, vbeta, k, seed = c.beta, c.beta * vocabulary, c.topics, c.seed

    def sample(own: pa.Table, far: pa.Table) -> pa.Table:
        (d, docs), (w, terms) = _numbered(own["doc"]), _numbered(own["term"])
        order = np.lexsort((own["pos"].to_numpy(), w, d))
        d, w, z = d[order], w[order], own["topic"].to_numpy()[order].astype(np.int64)
        nd = np.bincount(d * k + z, minlength=len(docs) * k).reshape(-1, k)
        rng = np.random.default_rng([seed, iteration, own["block"][0].as_py()])
        b = Block(d, w, z, nd, _counted(far, terms, k), nk.copy(), alpha, beta, vbeta, rng)
        run(b)
        new = np.empty(len(z), np.int32)
        new[order] = b.topic
        return pa.table([own["doc"], own["term"], own["pos"], pa.array(new)], ["doc", "term", "pos", "topic"])

    kind = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    rows = tokens.select("doc", "term", "pos", "topic")
    got = _blocks(rows, nw.withColumnRenamed("nw", "n"), max(c.blocks, -(-size // BLOCK)))
    return got.applyInArrow(sample, f"doc {kind['doc']}, term {kind['term']}, pos {kind['pos']}, topic int")


def train(tokens: DataFrame, c: Config, iterations: int, prior: DataFrame | None = None, watch: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Tokens after ``iterations`` sweeps, each written to the shared folder.

    ``tokens`` may lack topics.  ``watch(i, tokens)`` runs after each sweep (to
    evaluate or save).  No token is lost or made: counts are checked.
    """
    spark, old, now, model = tokens.sparkSession, [], [], []
    t = table(tokens if "topic" in tokens.columns else initialise(tokens, c), now)
    prior = None if prior is None else table(prior, model)
    n = t.count()
    terms = t.select("term") if prior is None else t.select("term").union(prior.select("term"))
    vocabulary = terms.distinct().count()
    for i in range(1, iterations + 1):
        old, now = now, []
        t = table(sweep(t, c, i, vocabulary, prior), now)
        if t.count() != n:
            raise AssertionError("a sweep must keep the number of tokens")
        release(spark, old)
        if watch:
            watch(i, t)
    release(spark, model)
    return t


def incremental_train(tokens: DataFrame, model: DataFrame, c: Config, iterations: int, warm_up: int = 15) -> DataFrame:
    """Sweeps over new tokens with an older model's term counts, ``warm_up`` more at first."""
    return train(tokens, c, warm_up + iterations, model)


# ------------------------------------------------------------ evaluation


def perplexity(tokens: DataFrame, c: Config) -> DataFrame:
    """total, word and doc perplexity: exp of minus the mean log probability of the tokens.

    Blocks of whole documents meet the counts of their terms, and send two sums each.
    """
    # read five times; stays in the shared folder, as the result is lazy
    rows = table(tokens.groupBy("doc", "term", "topic").agg(F.count("*").alias("cnt")), [])
    totals = {r.topic: r.n for r in rows.groupBy("topic").agg(F.sum("cnt").alias("n")).collect()}  # K rows
    nk = np.array([totals.get(t, 0) for t in range(c.topics)], float)
    n = int(nk.sum())
    v = rows.select("term").distinct().count()
    k, beta, abar = c.topics, c.beta, c.alpha * c.topics
    a, den = (nk + c.alpha_as) * (c.alpha * k / (n + c.alpha_as * k)), nk + beta * v
    nw = rows.groupBy("term", "topic").agg(F.sum("cnt").alias("n"))

    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        (d, docs), (w, terms) = _numbered(own["doc"]), _numbered(own["term"])
        z, cnt, nw = own["topic"].to_numpy(), own["cnt"].to_numpy(), _counted(far, terms, k)
        nd = np.bincount(d.astype(np.int64) * k + z, cnt, minlength=len(docs) * k).reshape(-1, k) + a
        size, total = nd.sum(axis=1) - a.sum() + abar, 0.0
        for lo in range(0, len(d), max(1, CELLS // k)):
            i = slice(lo, lo + max(1, CELLS // k))
            total += (cnt[i] * np.log((nd[d[i]] * (nw[w[i]] + beta) / den).sum(axis=1) / size[d[i]])).sum()
        return pa.table([[float(total)], [float((cnt * np.log(nd[d, z] / size[d])).sum())]], ["total", "doc"])

    got = _blocks(rows, nw, max(c.blocks, -(-n // BLOCK))).applyInArrow(run, "total double, doc double")
    mean = got.agg(*(F.exp(-F.sum(x) / n).alias(x) for x in ("total", "doc")))
    grid = F.broadcast(tokens.sparkSession.createDataFrame([(t, float(x)) for t, x in enumerate(den)], "topic int, den double"))  # K rows
    word = nw.join(grid, "topic").agg(F.exp(-F.sum(F.col("n") * F.log((F.col("n") + beta) / F.col("den"))) / n).alias("word"))
    return mean.crossJoin(word).select("total", "word", "doc")  # one row each


def log_likelihood(tokens: DataFrame, c: Config) -> DataFrame:
    """word and doc parts of the joint log-likelihood."""
    n = tokens.count()
    v = tokens.select("term").distinct().count()
    k, beta, vb, abar = c.topics, c.beta, c.beta * v, c.alpha * c.topics
    tk = topic_counts(tokens)
    g = lambda x: lgamma(x if isinstance(x, Column) else F.lit(float(x)))
    words = term_counts(tokens).select((F.col("nw") + beta).alias("x")).agg(F.sum(g(F.col("x")) - g(beta)).alias("s"))
    per_topic = tk.select((F.col("nk") + vb).alias("x")).agg(F.sum(g(F.col("x"))).alias("t"), F.count("*").alias("used"))
    word = words.crossJoin(per_topic).select((F.col("s") + g(vb) * k - F.col("t") - g(vb) * (F.lit(k) - F.col("used"))).alias("word"))
    a = F.broadcast(tk.select("topic", alpha_k(F.col("nk"), n, c).alias("a")))
    per_doc = doc_counts(tokens).join(a, "topic").agg(F.sum(g(F.col("nd") + F.col("a")) - g(F.col("a"))).alias("s"))
    sizes = tokens.groupBy("doc").agg(F.count("*").alias("n")).agg(F.sum(g(F.col("n") + abar)).alias("t"), F.count("*").alias("docs"))
    doc = per_doc.crossJoin(sizes).select((F.col("s") - F.col("t") + g(abar) * F.col("docs")).alias("doc"))
    return word.crossJoin(doc)


METRICS = {"pplx": perplexity, "llh": log_likelihood}


# ------------------------------------------------------------ inference


def infer(bags: DataFrame, model: DataFrame, c: Config, burn_in: int = 5, sweeps: int = 5) -> DataFrame:
    """(doc, topic, p): each document's mean topic shares against a fixed model (term, topic, nw).

    A document meets only its own terms' counts; documents don't meet each other.
    """
    bags, model = table(bags, []), table(model, [])  # read several times; they stay in the shared folder, as the result is lazy
    totals = {r.topic: r.n for r in model.groupBy("topic").agg(F.sum("nw").alias("n")).collect()}  # K rows
    nk = np.array([totals.get(t, 0) for t in range(c.topics)], float)
    v = model.select("term").distinct().count()
    n = nk.sum()
    alpha = (nk + c.alpha_as) * (c.alpha * c.topics / (n + c.alpha_as * c.topics))
    den, beta, seed = nk + c.beta * v, c.beta, c.seed
    size = bags.agg(F.sum("cnt")).first()[0] or 0

    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        (d, docs), (w, terms) = _numbered(own["doc"]), _numbered(own["term"])
        phi, k = (_counted(far, terms, len(den)) + beta) / den, len(den)
        order = np.lexsort((w, d))
        cnt = own["cnt"].to_numpy()[order].astype(np.int64)
        d, w = np.repeat(d[order], cnt), np.repeat(w[order], cnt)
        length = np.bincount(d, minlength=len(docs))
        part, acc = np.cumsum(length) // INFER, np.zeros((len(docs), k))
        for lo in np.flatnonzero(np.diff(part, prepend=-1)):  # some documents at a time: their base values are kept
            hi = int(np.searchsorted(part, part[lo], "right"))
            acc[lo:hi] = _shares(docs[lo:hi], length[lo:hi], w[np.searchsorted(d, lo) : np.searchsorted(d, hi)], phi, alpha, seed, burn_in, sweeps)
        i, t = np.nonzero(acc)
        return pa.table([docs.take(pa.array(i)), pa.array(t.astype(np.int32)), pa.array(acc[i, t])], ["doc", "topic", "p"])

    kind = bags.schema["doc"].dataType.simpleString()
    got = _blocks(bags.where("cnt > 0").select("doc", "term", "cnt"), model.select("term", "topic", F.col("nw").alias("n")), max(c.blocks, -(-size // BLOCK)))
    return got.applyInArrow(run, f"doc {kind}, topic int, p double")


def _shares(docs: pa.Array, length: np.ndarray, w: np.ndarray, phi: np.ndarray, alpha: np.ndarray, seed: int, burn_in: int, sweeps: int) -> np.ndarray:
    """Mean topic shares of documents, side by side; each draws from a generator of its own, in the order of its tokens."""
    k, first = len(alpha), np.cumsum(length) - length
    z, u = np.empty(len(w), np.int64), np.empty((burn_in + sweeps, len(w)))
    for j, (doc, a, n) in enumerate(zip(docs.to_pylist(), first, length, strict=True)):
        rng = np.random.default_rng([seed, zlib.crc32(str(doc).encode())])
        z[a : a + n] = rng.integers(k, size=n)
        u[:, a : a + n] = rng.random((burn_in + sweeps, n))
    nd = np.bincount(np.repeat(np.arange(len(length)), length) * k + z, minlength=len(length) * k).reshape(-1, k).astype(float)
    long = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[long], -np.arange(length.max()), "left")
    acc = np.zeros((len(length), k))
    for s in range(burn_in + sweeps):
        for t, n in enumerate(active):
            d = long[:n]
            i = first[d] + t
            nd[d, z[i]] -= 1
            z[i] = _draws(u[s, i], phi[w[i]] * (nd[d] + alpha))
            nd[d, z[i]] += 1
        if s >= burn_in:
            acc += nd / length[:, None]
    return acc / max(sweeps, 1)


def top_terms(model: DataFrame, n: int = 10) -> DataFrame:
    """Each topic's terms of highest count (ties: lowest term)."""
    w = Window.partitionBy("topic").orderBy(F.desc("nw"), "term")
    return model.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
