"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases,
and so on.  Runs of an equal symbol become one symbol; then deterministic coin
tossing (the lowest bit in which a symbol differs from the one before, applied
until at most six labels remain) and the local maxima of the labels place the
phrase borders.  A border depends on a few symbols around it only, so equal
substrings get equal phrases inside, wherever they start.

The fingerprint holds the ``KEEP`` least hashes of the names of levels from
``FIRST_LEVEL`` up (phrases of about 20 bytes and more) and each text's last
name.  The likeness of two fingerprints estimates the Jaccard similarity of
their sets of names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ordered import cut_points, partitions, range_number

KEEP = 64
FIRST_LEVEL = 3
_NONE = np.uint64(2**32)  # after all 32-bit hashes

_a, _b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
_d = (_a ^ _b) & -(_a ^ _b)
#: Coin toss of byte b after byte a, at a * 256 + b.
TOSS = (2 * np.bitwise_count(np.maximum(_d - 1, 0).astype(np.uint8)) + ((_b & _d) != 0)).astype(np.uint8).reshape(-1)
del _a, _b, _d


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on byte labels; the first symbol of a text is compared with its complement."""
    prev = np.empty_like(label)
    prev[1:] = label[:-1]
    prev[first] = ~label[first]
    return TOSS[(prev.astype(np.uint16) << np.uint16(8)) | label]


def _toss_wide(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    prev = np.empty_like(x)
    prev[1:] = x[:-1]
    prev[first] = ~x[first]
    prev ^= x
    low = prev & (~prev + np.uint64(1))
    return 2 * np.bitwise_count(low - np.uint64(1)) + ((x & low) != 0).astype(np.uint8)


def parse_level(x: np.ndarray, count: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and their number per text.  x: symbols, no text empty."""
    heads = np.cumsum(count) - count
    is_head = np.zeros(len(x), bool)
    is_head[heads] = True
    same = np.zeros(len(x), bool)
    same[1:] = x[1:] == x[:-1]
    same &= ~is_head
    with np.errstate(over="ignore"):
        starts = np.flatnonzero(~same)  # runs become one symbol; neighbours then differ
        runs = np.diff(np.append(starts, len(x)))
        x, is_head = x[starts], is_head[starts]
        heads = np.flatnonzero(is_head)
        if x.dtype == np.uint8:
            label, wide = _toss(x, is_head), C.BYTE_CODE[x]
        else:
            label, wide = _toss_wide(x, is_head), x
        long_ = np.flatnonzero(runs > 1)
        wide[long_] = C.mix(wide[long_] + runs[long_].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for _ in range(3):
            label = _toss(label, is_head)
        border = is_head.copy()
        border[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        # neighbours in another text are no neighbours: a phrase isn't cut before a text's last symbol or after its first
        border[heads[1:] - 1] = is_head[heads[1:] - 1]
        after = heads[heads + 1 < len(border)] + 1
        border[after] = is_head[after]
        at = np.flatnonzero(border)
        size = np.diff(np.append(at, len(wide)))
        within = np.arange(len(wide)) - np.repeat(at, size)
        names = np.add.reduceat(wide * C.powers(int(size.max()) + 1)[within], at)
        names = C.mix(names + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(level))
    return names, np.add.reduceat(border.astype(np.int64), heads)


def sketches(raw: np.ndarray, off: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """(texts, keep) least name hashes (32 bits, ascending; _NONE where there are fewer)."""
    n = len(off) - 1
    size = np.diff(off)
    who = np.flatnonzero(size)
    x, count, level = raw, size[who], 0
    got_h, got_d = [], []
    while len(who):
        x, count = parse_level(x, count, level)
        level += 1
        doc = np.repeat(who, count)
        done = count == 1
        if level >= FIRST_LEVEL:
            got_h.append(x)
            got_d.append(doc)
        elif done.any():
            last = np.repeat(done, count)
            got_h.append(x[last])
            got_d.append(doc[last])
        if done.any():
            x = x[np.repeat(~done, count)]
            who, count = who[~done], count[~done]
    out = np.full((n, keep), _NONE)
    if got_h:
        key = np.sort((np.concatenate(got_d).astype(np.uint64) << np.uint64(32)) | (C.mix(np.concatenate(got_h)) >> np.uint64(32)))
        key = key[np.append(True, key[1:] != key[:-1])]
        doc = (key >> np.uint64(32)).astype(np.int64)
        rank = np.arange(len(key)) - np.searchsorted(doc, doc)
        ok = rank < keep
        out[doc[ok], rank[ok]] = key[ok] & np.uint64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of each row's sets; two empty sets are alike (1)."""
    keep = a.shape[1]
    both = np.sort(np.concatenate([a, b], 1), 1)
    real = both < _NONE
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, 1)
    shared = real & ~new & (rank <= keep)
    union = np.minimum(rank[:, -1], keep)
    return np.where(union > 0, shared.sum(1) / np.maximum(union, 1), 1.0)


def encode(s: np.ndarray) -> list[str]:
    """Fingerprint strings."""
    return [base64.b64encode(r[r < _NONE].astype(">u4").tobytes()).decode() for r in s]


def decode(text: str, keep: int = KEEP) -> np.ndarray:
    out = np.full(keep, _NONE)
    got = np.frombuffer(base64.b64decode(text), ">u4")
    out[: len(got)] = got
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """Sketches of texts, in slices of bounded size."""
    raw, off = C.text_view(pa.array(texts, pa.large_string()))
    return np.concatenate([np.zeros((0, KEEP), np.uint64), *(sketches(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.slices(off))])


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(batches):
    """Rows of one range in order, then the first row of the next range (kind 1)."""

    def rows(ids, texts, prints, following, following_print):
        nexts = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
        p, e = prints, fingerprints(edited)
        q = np.concatenate([p[1:], following_print])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(encode(p)), pa.array(encode(e)), pa.array(likeness(p, e)), pa.array(likeness(p, q)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    ids, texts, prints, end = [], [], np.zeros((0, KEEP), np.uint64), None
    for b in batches:
        kind = np.asarray(b.column("kind"))
        new = ["" if t is None else t for t in b.column("text").to_pylist()]
        own = int((kind == 0).sum())
        if own < len(new) and end is None:
            end = new[own]
        if not own:
            continue
        now = fingerprints(new[:own])
        if texts:  # the last row so far has waited for its successor
            yield rows(ids, texts, prints, new[0], now[:1])
        hold = own - 1
        if hold:
            yield rows(b.column("doc_id").to_pylist()[:hold], new[:hold], now[:hold], new[hold], now[hold:])
        ids, texts, prints = [b.column("doc_id")[hold].as_py()], [new[hold]], now[hold:]
    if texts:
        yield rows(ids, texts, prints, end or "", fingerprints([end or ""]))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in ascending doc_id (after the lowest
    comes the highest); null ids come last, rows of one id in order of their
    text's hash.  A single document is its own successor.  Null text counts as
    empty; the fingerprint of an empty text is empty.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    parts = partitions(docs)
    cuts = cut_points(docs, parts)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.coalesce(range_number(F.col("doc_id"), cuts), F.lit(0)).alias("pid"))
    # the first row of each range: at most one id from each partition
    top = docs.select("doc_id", range_number(F.col("doc_id"), cuts).alias("pid")).groupBy("pid").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()
    order = sorted((r.pid for r in top), reverse=True)
    after = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}  # the range that follows
    before = {q: p for p, q in after.items()}
    head = {r.pid: r.top for r in top}
    none = [q for q, t in head.items() if t is None]
    firsts = [t for t in head.values() if t is not None]
    heads = docs.where(F.col("doc_id").isin(firsts) if firsts else F.lit(False))
    if none:  # a range of null ids only
        heads = heads.union(docs.where("doc_id is null"))
    place = F.create_map(*(F.lit(x) for q in head for x in (q, before[q]))) if head else F.create_map(F.lit(0), F.lit(0))
    heads = heads.select("doc_id", "text", F.xxhash64("text").alias("th"), range_number(F.col("doc_id"), cuts).alias("q"))
    heads = heads.select("doc_id", "text", "th", place[F.col("q")].alias("pid"), F.lit(1).alias("kind"))
    rows = d.withColumn("kind", F.lit(0)).unionByName(heads)
    rows = rows.repartitionById(max(parts, len(cuts) + 1), F.col("pid")).sortWithinPartitions("pid", "kind", F.col("doc_id").desc_nulls_last(), "th")
    return C.stream_map(rows.select("doc_id", "text", "kind"), _run, _SCHEMA)
