"""Quality by regularised quadratic discriminant analysis of document statistics.

Every text becomes a vector of transformed statistics (lengths, letter case,
symbols, repetition).  Each class has a Gaussian whose covariance is shrunk
toward the pooled one and toward a diagonal.  The score is the posterior of
class 1 from the difference of the two Mahalanobis log densities, computed with
cached Cholesky factors.

Texts are read once: their statistics, a few numbers a document, are written
down, joined with the labels for the fit, and scored.  The class sums are
gathered over all labelled training rows; per task only a count, a sum vector
and a sum of products reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import held_out

THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digits", "exclaim", "bars", "symbols", "stops", "commas", "other_ascii",
    "non_ascii", "lines", "distinct", "top_word", "repeated_lines", "symbol_words",
)

_CLASSES = np.zeros((256, 9), np.float32)
for _k, _set in enumerate((bytes(range(65, 91)), bytes(range(48, 58)), b"!", b"|", b"%$&*#@^~=+", b".?", b",;:", b"()[]{}<>/\\\"'`_-", bytes(range(0x80, 0xC0)))):
    _CLASSES[list(_set), _k] = 1


def _share(x, n):
    """Square root of a share: steadies the variance of small counts."""
    return np.sqrt(np.maximum(x, 0) / np.maximum(n, 1))


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, len(NAMES)) transformed statistics; zeros for an empty text's shares."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    if len(raw):
        doc_of_byte = np.repeat(np.arange(n), np.diff(off))
        counts = np.bincount(doc_of_byte * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float32) @ _CLASSES
    else:
        counts = np.zeros((n, 9), np.float32)
    low = C.LOWER[raw]
    st, en, doc = C.words(low, off, C.SPACE_WORD)
    lens = (en - st).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, lens, n) / some
    sd = np.sqrt(np.maximum(np.bincount(doc, lens * lens, n) / some - mean**2, 0))
    h = C.word_hashes(low, st, en)
    key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    uniq, count = np.unique(key, return_counts=True)
    owner = (uniq >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    ends_symbol = (_CLASSES[low[en - 1]][:, [2, 3, 4]] > 0).any(1) if len(en) else np.zeros(0, bool)
    sym = np.bincount(doc, ends_symbol, n)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, ldoc = C.words(raw, off, line)
    lines = np.bincount(ldoc, minlength=n).astype(float)
    lkey = (ldoc.astype(np.uint64) << np.uint64(40)) | (C.word_hashes(raw, ls, le) >> np.uint64(24))
    lu = np.unique(lkey)
    again = lines - np.bincount((lu >> np.uint64(40)).astype(np.int64), minlength=n)
    up, dig, exc, bar, symb, stop, comma, other, cont = counts.T.astype(float)
    letters = np.maximum(size - cont, 1)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(sd), _share(up, letters), _share(dig, letters), _share(exc, some), _share(bar, some),
            _share(symb, some), _share(stop, some), _share(comma, some), _share(other, some), _share(cont, size), _share(lines, some),
            distinct / some, _share(top, some), _share(again, lines), _share(sym, some),
        ], 1,
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    center: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    root: np.ndarray
    const: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.const):
            return np.full(len(x), 0.5)
        x = (x - self.center) / self.scale
        d = [self.const[k] - 0.5 * (((x - self.mean[k]) @ self.root[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -700, 700)))


def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> Discriminant:
    """From each class's count, sum (p) and sum of products (p, p)."""
    p = total.shape[1]
    none = np.zeros(0)
    if count.min() < 2:
        return Discriminant(none, none, none, none, none)
    n = count.sum()
    center = total.sum(0) / n
    scale = np.sqrt(np.maximum(np.diag(square.sum(0)) / n - center**2, 1e-8))
    mean = (total / count[:, None] - center) / scale
    cov = []
    for k in (0, 1):
        m = total[k] / count[k]
        cov.append((square[k] / count[k] - np.outer(m, m)) / np.outer(scale, scale) * count[k] / (count[k] - 1))
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / n
    root, const = [], []
    for k in (0, 1):
        s = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
        s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + 1e-4 * np.eye(p)
        low = np.linalg.cholesky(s)
        root.append(np.linalg.inv(low))
        const.append(np.log(count[k] / n) - np.log(np.diag(low)).sum())
    return Discriminant(center, scale, mean, np.array(root), np.array(const))


def _by_slices(b: pa.RecordBatch) -> np.ndarray:
    raw, offsets = C.text_view(b.column("text"))
    return np.concatenate([statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.slices(offsets)])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of ``docs``, written to the shared folder."""
    C.prepare(docs.sparkSession)

    def kernel(b: pa.RecordBatch):
        x = _by_slices(b)
        flat = pa.array(x.reshape(-1))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], ["doc_id", "x"])

    return C.cut(C.arrow_map(docs.select("doc_id", "text"), kernel, "doc_id long, x array<double>"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("x").flatten()).reshape(b.num_rows, len(NAMES))


def train(stats: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Discriminant:
    """From the statistics of all labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    p = len(NAMES)

    def sums(batches):
        acc = np.zeros((2, 1 + p + p * p))
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b), np.asarray(b.column("y"))
                for k in (0, 1):
                    z = x[y == k]
                    acc[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(acc))], ["k", "s"])

    rows = stats.join(known, "doc_id").mapInArrow(sums, "k int, s array<double>").collect()
    acc = np.zeros((2, 1 + p + p * p))
    for r in rows:  # two short rows from each task
        acc[r.k] += np.array(r.s)
    return fit(acc[:, 0], acc[:, 1 : 1 + p], acc[:, 1 + p :].reshape(2, p, p))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty, extra columns are ignored, repeated rows get equal
    scores.  With fewer than two training rows of a class every score is 0.5.
    """
    stats = document_statistics(docs)
    model = train(stats, labels, folds, fold)

    def kernel(b: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_matrix(b)))], ["doc_id", "score"])

    out = C.arrow_map(stats, kernel, "doc_id long, score double")
    return out.select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
