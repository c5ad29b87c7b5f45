"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a whole text, the first letters of its longer
words (for inflected or compounded forms), and whether such a beginning occurs
several times, hashed to 32 bits.  The score is the logistic of
b + sum w_i + 1/2 sum_f [(sum v_if)^2 - sum v_if^2]  over the terms present, so
that a pair such as an insult and a mention of a group can weigh more than the
two words apart.

The model is fitted on a sample of labelled rows, of ``MAX_TRAIN`` rows in
expectation, drawn by a hash of the id.  A term gets parameters if its own
presence goes with the label (chi-square of ``LEAST_CHI2``), or if it belongs to a
pair of terms whose joint presence explains what a machine over the former terms
leaves over (``pair_terms``), however neutral each of the two is alone.  All other
terms are noise to a sample of this size: with parameters for all of them held-out
recall falls to a quarter.  In all but the last steps of the fit some terms are
dropped at random, so that one insult alone carries weight.  Scoring reads every row and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bound of the labelled sample, in expectation.
MAX_TRAIN = 12_000
#: Least chi-square of a term with the label, and least number of its texts.
LEAST_CHI2, LEAST_TEXTS = 16.0, 3
#: Members of pairs are in this share of the sample; least test statistic of a pair, and the least share of the residual variance.
PAIR_SHARE, LEAST_PAIR, LEAST_EXPLAINED = 0.05, 45.0, 0.02
RANK = 4
THRESHOLD = 0.7
#: Letters of the beginnings of longer words, and how often one must occur to count as repeated.
STEMS, REPEATED = (4, 5), (2, 3)
#: Share of a text's terms that a step of the fit sees; steps, and how many of them at the end see all.
SEEN, STEPS, LAST = 0.5, 600, 60
#: Terms that are looked up at a time; columns of pairs that are tested at a time.
PART, COLUMNS = 1 << 18, 256


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, bytewise on UTF-8."""
    low = C.LOWER[raw]
    if len(low) > 1:
        up = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][up] += 0x20
    return low


LETTER = C.byte_class(bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms (uint32) and their documents, ordered by both."""
    low = fold(raw)
    st, en, doc = C.words(low, off, LETTER)
    heads = np.flatnonzero((low & 0xC0) != 0x80)  # bytes that begin a character
    rank = np.searchsorted(heads, st)
    length = np.searchsorted(heads, en) - rank
    keyed = lambda d, h: (d.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    out = [keyed(doc, C.word_hashes(low, st, en))]
    for letters in STEMS:
        long_ = length > letters
        stem = np.sort(keyed(doc[long_], C.mix(C.word_hashes(low, st[long_], heads[rank[long_] + letters]) + np.uint64(77 + letters))))
        out.append(stem)
        for times in REPEATED:
            again = stem[times - 1 :][stem[times - 1 :] == stem[: len(stem) - times + 1]]
            out.append(keyed(again >> np.uint64(32), C.mix(again + np.uint64(times << 50))))
    key = np.unique(np.concatenate(out))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def place(vocab: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each term in a sorted vocabulary (int32), and whether it is there; in slices, as the driver's memory is small."""
    at, ok = np.zeros(len(t), np.int32), np.zeros(len(t), bool)
    for s in range(0, len(t) if len(vocab) else 0, PART):
        part = t[s : s + PART]
        got = np.minimum(np.searchsorted(vocab, part), len(vocab) - 1)
        at[s : s + PART], ok[s : s + PART] = got, vocab[got] == part
    return at, ok


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted uint32
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, i: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """i: term numbers, doc: their documents (ascending)."""
        z = np.full(n, self.bias)
        z += np.bincount(doc, self.w[i], n)
        for f in range(self.v.shape[1]):
            x = self.v[i, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return z

    def lookup(self, t: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and documents of the terms that have parameters."""
        at, ok = place(self.terms, t)
        return at[ok], doc[ok]

    def scores(self, t: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.lookup(t, doc), n), -30, 30)))


def counts(vocab: np.ndarray, t: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have each term, and the sum of y over them."""
    df, of_y = np.zeros(len(vocab)), np.zeros(len(vocab))
    for s in range(0, len(t), PART):
        at = np.searchsorted(vocab, t[s : s + PART])
        df += np.bincount(at, minlength=len(vocab))
        of_y += np.bincount(at, y[doc[s : s + PART]], len(vocab))
    return df, of_y


def marginal_terms(t: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Terms whose presence goes with the label."""
    n, pos = len(y), y.sum()
    vocab = np.unique(t)
    df, a = counts(vocab, t, doc, y)
    chi2 = n * (a * (n - df - pos + a) - (df - a) * (pos - a)) ** 2 / np.maximum(df * (n - df) * pos * (n - pos), 1)
    return vocab[(chi2 >= LEAST_CHI2) & (df >= LEAST_TEXTS)]


def pair_terms(t: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Members of pairs whose joint presence explains ``left``, the residuals of a model.

    For centred presences x and y of two terms, the squared sum of x y left over
    the sum of its squares is tested; it can't exceed the number of texts that
    speak for the pair.  The pair must also explain ``LEAST_EXPLAINED`` of the
    residual variance.  All pairs of terms in ``PAIR_SHARE`` of the texts are
    tested, by matrix products.
    """
    n = len(left)
    left = left - left.mean()
    vocab = np.unique(t)
    df, own = counts(vocab, t, doc, left)
    _, own2 = counts(vocab, t, doc, left**2)
    common = (df >= max(8, PAIR_SHARE * n)) & (df <= n - 8)
    vocab, df, own, own2 = vocab[common], df[common], own[common], own2[common]
    m = len(vocab)
    if not m:
        return vocab
    k, ok = place(vocab, t)
    k, d = k[ok], doc[ok]
    p = df / n
    p2, q, whole = p**2, 1 - 2 * p, (left**2).sum()
    keep = np.zeros(m, bool)
    heads = np.searchsorted(d, np.arange(0, n + 1024, 1024))

    def squares(joint, alone, total, w):
        """Sum of weighted (x y)^2 from the weights of texts with both terms, with one, and of all."""
        return q[w, None] * q * joint + (q * alone)[w, None] * p2 + p2[w, None] * (q * alone) + p2[w, None] * p2 * total

    for c in range(0, m, COLUMNS):
        w = slice(c, c + COLUMNS)
        both, square, times = (np.zeros((min(COLUMNS, m - c), m), np.float32) for _ in range(3))
        for b, s in enumerate(range(0, n, 1024)):
            x = np.zeros((min(1024, n - s), m), np.float32)
            x[d[heads[b] : heads[b + 1]] - s, k[heads[b] : heads[b + 1]]] = 1
            r = left[s : s + 1024].astype(np.float32)
            xw = x[:, w].T
            both += (xw * r) @ x
            square += (xw * r * r) @ x
            times += xw @ x
        told = (both - p[w, None] * own - own[w, None] * p) ** 2
        good = told >= LEAST_PAIR * squares(square, own2, whole, w)
        good &= told >= LEAST_EXPLAINED * whole * squares(times, df, n, w)
        good[np.arange(len(good)), np.arange(c, c + len(good))] = False
        keep[w] = good.any(1)
    return vocab[keep]


def descend(own: np.ndarray, t: np.ndarray, doc: np.ndarray, y: np.ndarray, rank: int, rate: float = 0.2, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Mini-batch AdaGrad on the log loss, over the terms ``own``."""
    n, pos, size = len(y), y.sum(), len(own)
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(own, float(np.log(pos / (n - pos))), np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    i, d = m.lookup(t, doc)
    gw, gv, gb = np.full(size, 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    heads = np.searchsorted(d, np.arange(n + 1))
    batch = min(512, max(16, n // 8))
    epochs, of = -(-STEPS // -(-n // batch)), LAST / STEPS
    for e in range(epochs):
        share = SEEN if e < (1 - of) * epochs else 1.0
        order = rng.permutation(n)
        for s in range(0, n, batch):
            docs = np.sort(order[s : s + batch])
            count = heads[docs + 1] - heads[docs]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(heads[docs], count)
            k, row = i[at], np.repeat(np.arange(len(docs)), count)
            seen = rng.random(len(k)) < share
            k, row = k[seen], row[seen]
            err = (1 / (1 + np.exp(-np.clip(m.margin(k, row, len(docs)), -30, 30))) - y[docs]) / len(docs)
            g = err.sum()
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
            g = np.bincount(k, err[row], size) + l2 * m.w / n
            gw += g * g
            m.w -= rate * g / np.sqrt(gw)
            for f in range(rank):
                x = m.v[k, f]
                total = np.bincount(row, x, len(docs))
                g = np.bincount(k, err[row] * (total[row] - x), size) + l2 * m.v[:, f] / n
                gv[:, f] += g * g
                m.v[:, f] -= 0.1 * rate * g / np.sqrt(gv[:, f])
    return m


def fit(t: np.ndarray, doc: np.ndarray, y: np.ndarray, rank: int = RANK) -> FactorizationMachine:
    """t, doc: terms by document; y: 0 or 1.  One class only: its rate for all."""
    n, pos = len(y), int(y.sum())
    if not n or not pos or pos == n:
        p = (pos + 0.5) / (n + 1)
        return FactorizationMachine(np.zeros(0, np.uint32), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, rank)))
    own = marginal_terms(t, doc, y)
    m = descend(own, t, doc, y, rank)
    more = np.union1d(own, pair_terms(t, doc, y - m.scores(t, doc, n)))
    return m if len(more) == len(own) else descend(more, t, doc, y, rank)


def held_out(folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def _features(b: pa.RecordBatch):
    raw, offsets = C.text_view(b.column("text"))
    for i, j in C.slices(offsets):
        t, doc = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32) * 4
        col = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(t.tobytes())])
        yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", "y", "th")), col], ["doc_id", "y", "th", "terms"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1, max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fit on labelled rows outside the held-out fold; null labels and repeated labels are dropped."""
    C.prepare(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, max_train / max(n, 1)) * (1 << 20)))
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(known), "doc_id")  # about max_train rows
    rows = C.arrow_map(text, _features, "doc_id long, y int, th long, terms binary").toArrow()
    if len(rows):  # a text counts once, however often it is copied
        order = np.asarray(rows.column("doc_id").combine_chunks()).argsort(kind="stable")
        key = np.stack([np.asarray(rows.column(c).combine_chunks()).astype(np.int64)[order] for c in ("th", "y")], 1)
        rows = rows.take(pa.array(order[np.sort(np.unique(key, axis=0, return_index=True)[1])])).combine_chunks()
    y = np.asarray(rows.column("y").combine_chunks(), dtype=float) if len(rows) else np.zeros(0)
    flat, off = C.text_view(rows.column("terms")) if len(rows) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    out = fit(flat.view(np.uint32), np.repeat(np.arange(len(y), dtype=np.int32), np.diff(off) // 4), y)
    del rows, flat
    C.trim()
    return out


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score per row; null and empty texts get the bias alone."""

    def kernel(b: pa.RecordBatch):
        raw, offsets = C.text_view(b.column("text"))
        out = np.zeros(b.num_rows)
        for i, j in C.slices(offsets):
            t, doc = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out[i:j] = model.scores(t, doc, j - i)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return C.arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty, extra columns are ignored, repeated rows get equal
    scores, and without labels every score is the same.
    """
    C.prepare(docs.sparkSession)
    out = score(docs, train(docs, labels, "toxic", folds, fold))
    return out.select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns.

    The text is scored inside the same scan that returns it, so there is no join.
    """
    C.prepare(docs.sparkSession)
    model = train(docs, labels)

    def kernel(b: pa.RecordBatch):
        raw, offsets = C.text_view(b.column("text"))
        out = np.zeros(b.num_rows)
        for i, j in C.slices(offsets):
            t, doc = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out[i:j] = model.scores(t, doc, j - i)
        yield b.filter(pa.array(out < threshold))

    return C.arrow_map(docs, kernel, docs.schema)
