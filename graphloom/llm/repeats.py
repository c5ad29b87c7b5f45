"""Repeated-passage removal with run-length compressed Burrows-Wheeler indexes.

A byte goes if a ``span``-byte string that covers it also starts anywhere else
in the corpus.  Strings are judged on the input; none crosses documents.

1. Anchors.  Every window of ``span`` bytes owns the leftmost least 32-byte hash
   inside it (a minimizer).  Equal windows have equal anchors at equal offsets,
   so they meet through the anchor's hash.  Consecutive windows of one anchor
   form a context; contexts partition the windows of a document.
2. Contexts are counted by hash (partial counts before the shuffle).  A context
   that occurs twice is repeated as a whole.  A context that occurs once, while
   its anchor occurs in other contexts, may be repeated in part.
3. One copy of each distinct context of such an anchor is gathered by anchor, in
   blocks of bounded size, and each batch of blocks gets a run-length
   compressed BWT.  At the ends of its runs it keeps sampled positions and the
   length of the match with the neighbouring suffix.  Inside a run, a match is
   the next position's match plus one byte, so the samples alone give the
   matching statistics of the whole batch against itself in one stream.
4. An anchor with more contexts than a block holds is spread over blocks; its
   windows are then also counted by hash across the blocks.
5. A search for a longer span may be confined to the runs that a search for a
   shorter one has covered: every part of a repeated string is repeated, so
   nothing is lost, and only those runs are read again.

Contexts that are equal as a whole are told by their hash alone (a second copy of
a string adds nothing to its matches), so one copy of each goes into an index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 400
#: A passage: at least so many whole words in a run of repeated strings of so many bytes.
PASSAGE_WORDS = 50
PASSAGE_SPAN = 160
KMER = 32
#: Distinct contexts of one anchor that are indexed together.
BLOCK = 4096
#: Bytes of contexts in one index, if no block is larger.
BATCH_BYTES = 1 << 19

_inv: np.ndarray | None = None


def inverse_powers(n: int) -> np.ndarray:
    """Inverses of ``common.powers`` modulo 2^64."""
    global _inv
    if _inv is None or len(_inv) < n:
        b = pow(int(C.powers(2)[1]), -1, 2**64)
        with np.errstate(over="ignore"):
            out = np.full(max(n, 1 << 20), np.uint64(b))
            out[0] = 1
            _inv = np.multiply.accumulate(out)
    return _inv[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which any substring's hash follows in O(1)."""
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(C.BYTE_CODE[raw] * C.powers(len(raw)), out=out[1:])
    return out


def anchors(raw: np.ndarray, off: np.ndarray, span: int):
    """Contexts of a run of documents of at most 2^20 bytes in all.

    Returns document, first and last window start, anchor position (all in
    bytes of ``raw``), anchor hash and context hash.
    """
    z = np.zeros(0, np.int64)
    kmer = min(KMER, span)
    w = span - kmer + 1
    n = len(raw) - kmer + 1
    if len(raw) < span:
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    with np.errstate(over="ignore"):
        pre = prefix_hash(raw)
        inv = inverse_powers(len(raw) + 1)
        h = C.mix((pre[kmer:] - pre[:-kmer]) * inv[:n])
        v = (h >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        m = n - w + 1
        blocks = -(-n // w)
        pad = np.full(blocks * w, np.uint64(2**64 - 1))
        pad[:n] = v
        grid = pad.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, 1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
        at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        doc_len = np.diff(off)
        long_ = np.flatnonzero(doc_len >= span)
        if not len(long_):
            return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
        ok = np.zeros(m + 1, np.int8)
        np.add.at(ok, off[long_], 1)
        np.add.at(ok, off[long_ + 1] - span + 1, -1)
        s = np.flatnonzero(np.cumsum(ok)[:m])
        a = at[s]
        new = np.ones(len(s), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
        head = np.flatnonzero(new)
        lo, hi, a = s[head], s[np.append(head[1:], len(s)) - 1], a[head]
        doc = np.searchsorted(off, lo, "right") - 1
        ctx = (pre[hi + span] - pre[lo]) * inv[lo]
        ctx = C.mix(C.mix(ctx + (hi - lo).astype(np.uint64)) + (a - lo).astype(np.uint64))
        return doc, lo, hi, a, h[a], ctx


def _pieces(b: pa.RecordBatch, span: int):
    """Bytes, offsets, row and place of the runs that are to be searched: whole texts, or those in ``runs``."""
    raw, offsets = C.text_view(b.column("text"))
    if "runs" not in b.schema.names:
        return raw, offsets, np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
    runs = b.column("runs")
    flat = runs.flatten()
    start, stop = np.asarray(flat.field("start")), np.asarray(flat.field("stop"))
    row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(runs.offsets)))
    parts = [raw[offsets[r] + x : offsets[r] + y] for r, x, y in zip(row, start, stop, strict=True)]
    return np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([[0], np.cumsum(stop - start)]), row, start


def _anchor_rows(span: int):
    def kernel(b: pa.RecordBatch):
        ids, th = b.column("doc_id"), b.column("th")
        raw, offsets, row, place = _pieces(b, span)
        for i, j in C.slices(offsets):
            start, end = offsets[i], offsets[j]
            step = (1 << 20) - span
            for base in range(start, max(end, start + 1), step if end - start > 1 << 20 else 1 << 20):
                stop = min(end, base + (1 << 20) - 1)
                if stop - base < span:
                    continue
                off = np.clip(offsets[i : j + 1], base, stop) - base
                doc, lo, hi, a, h, c = anchors(raw[base:stop], off, span)
                if not len(doc):
                    continue
                shift = base - offsets[i + doc] + place[i + doc]
                take = pa.array(row[i + doc])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), th.take(take), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array((lo + shift).astype(np.int64)), pa.array((hi - lo).astype(np.int32)), pa.array((a - lo).astype(np.int32))],
                    ["doc_id", "th", "h", "c", "lo", "more", "rel"],
                )

    return kernel


def anchor_table(keyed: DataFrame, span: int) -> DataFrame:
    return C.arrow_map(keyed, _anchor_rows(span), "doc_id long, th long, h long, c long, lo long, more int, rel int")


# ---------------------------------------------------------------- run-length index


def suffix_order(sym: np.ndarray, deep: int) -> np.ndarray:
    """Suffixes of ``sym`` (0 is a separator) ordered by their first ``deep`` symbols or more.

    Prefix doubling; only tied suffixes are sorted again.  Fewer than 2^21
    symbols, so that both ranks and the position share one 63-bit sort key.
    """
    n = len(sym)
    assert n < 1 << 21
    bits = max(1, int(sym.max()).bit_length())
    h = max(1, 42 // bits)
    key = np.zeros(n, np.uint64)
    ext = np.zeros(n + h, np.uint64)
    ext[:n] = sym
    for t in range(h):
        key = (key << np.uint64(bits)) | ext[t : t + n]
    low = np.uint64((1 << 21) - 1)
    packed = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    head = np.ones(n + 1, bool)
    head[1:n] = (packed[1:] >> np.uint64(21)) != (packed[:-1] >> np.uint64(21))
    rank = np.empty(n + 1, np.uint64)
    rank[n] = 0
    starts = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    rank[sa] = starts
    while h < deep:
        slots = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(slots):
            break
        p = sa[slots]
        nxt = np.minimum(p + h, n)
        packed = np.sort((rank[p] << np.uint64(42)) | (rank[nxt] << np.uint64(21)) | p.astype(np.uint64))
        p = (packed & low).astype(np.int64)
        sa[slots] = p
        k = packed >> np.uint64(21)
        first = np.ones(len(slots), bool)
        first[1:] = k[1:] != k[:-1]
        head[slots] = first
        at = np.maximum.accumulate(np.where(first, slots, 0))
        rank[p] = at
        h *= 2
    return sa


class RunIndex:
    """Run-length compressed BWT of separated strings with sampled run ends.

    ``runs`` are the BWT's run symbols and lengths.  For each boundary between
    runs, ``below`` and ``above`` are the sampled text positions at the run's
    end and the next run's start, and ``match`` the length of their common
    prefix inside their strings, as far as it reaches ``least``.
    """

    def __init__(self, parts: list[bytes], least: int):
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        lens = np.array([len(p) for p in parts])
        self.ends = np.cumsum(lens + 1) - 1
        present = np.zeros(256, bool)
        present[raw] = True
        code = np.cumsum(present).astype(np.uint16)
        sym = code[raw]
        sym[self.ends] = 0
        self.starts = self.ends - lens
        sa = suffix_order(sym, 2 * int(lens.max()) if len(lens) else 1)
        bwt = sym[sa - 1]
        edge = np.ones(len(sa), bool)
        edge[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        heads = np.flatnonzero(edge)
        self.runs = (bwt[heads], np.diff(np.append(heads, len(sa))))
        heads = heads[1:]
        self.below, self.above = sa[heads - 1], sa[heads]
        self.n = len(sa)
        self._match(raw, least)

    def _match(self, raw: np.ndarray, least: int) -> None:
        room = np.minimum(self._room(self.below), self._room(self.above))
        ok = room >= least
        self.below, self.above, room = self.below[ok], self.above[ok], room[ok]
        with np.errstate(over="ignore"):
            pre = prefix_hash(raw)
            inv = inverse_powers(len(raw) + 1)

            def same(length, which):
                x, y = self.below[which], self.above[which]
                return (pre[x + length] - pre[x]) * inv[x] == (pre[y + length] - pre[y]) * inv[y]

            every = np.arange(len(room))
            ok = same(np.full(len(room), least), every)
            self.below, self.above, room = self.below[ok], self.above[ok], room[ok]
            lo, hi = np.full(len(room), least), room
            every = np.arange(len(room))
            while len(lo) and (lo < hi).any():
                mid = (lo + hi + 1) // 2
                eq = same(mid, every)
                lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
            self.match = lo

    def _room(self, p: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, p)] - p

    def covered(self) -> np.ndarray:
        """Whether a repeated string of at least ``least`` bytes covers each position.

        The samples' matches are streamed in text order: a position's longest
        match is the sample's before it, less the distance.
        """
        diff = np.zeros(self.n + 1, np.int32)
        for p in (self.below, self.above):
            np.add.at(diff, p, 1)
            np.add.at(diff, p + self.match, -1)
        return np.cumsum(diff)[:-1] > 0


def true_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], x.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_SPANS = ["did", "th", "start", "stop", "key", "rel", "wh"]
_SPANS_SCHEMA = "did long, th long, start long, stop long, key long, rel int, wh long"


def _index_contexts(span: int, block: int):
    """Contexts ordered by (key, salt) -> repeated spans; windows of spread anchors."""

    def flush(rows):
        index = RunIndex([r[5] for r in rows], span)
        cov = index.covered()
        out = [[] for _ in _SPANS]
        for r, s, e in zip(rows, index.starts, index.ends, strict=True):
            key, nb, did, th, lo, text, n, rel = r
            if n == 1:
                for a, b in zip(*true_runs(cov[s:e]), strict=True):
                    for c, v in zip(out, (did, th, lo + a, lo + b, None, None, None), strict=True):
                        c.append(v)
            if nb > 1:
                raw = np.frombuffer(text, np.uint8)
                pre, inv = prefix_hash(raw), inverse_powers(len(raw) + 1)
                m = len(raw) - span + 1
                with np.errstate(over="ignore"):
                    wh = C.mix((pre[span:] - pre[:m]) * inv[:m]).view(np.int64)
                for w in range(m):
                    for c, v in zip(out, (did if n == 1 else None, th, lo + w, lo + w + span, key, rel - w, int(wh[w])), strict=True):
                        c.append(v)
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _SPANS)

    def run(batches):
        rows, group, size, last, start = [], 0, 0, None, 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for key, salt, nb, did, th, lo, text, n, rel in zip(*cols, strict=True):
                if (key, salt) != last:
                    last, start, group = (key, salt), len(rows), 0
                    if size > BATCH_BYTES:
                        yield flush(rows)
                        rows, size, start = [], 0, 0
                if size + len(text) + 1 >= (1 << 21) - 1:  # the group's rows so far go on to the next index
                    if start:
                        yield flush(rows[:start])
                        rows = rows[start:]
                    else:
                        yield flush(rows)
                        rows = []
                    start, size = 0, sum(len(r[5]) + 1 for r in rows)
                rows.append((key, nb, did, th, lo, text, n, rel))
                size += len(text) + 1
        if rows:
            yield flush(rows)

    return run


def _cut_contexts(span: int, part: int):
    """Documents with the places of their contexts -> context bytes."""

    def kernel(b: pa.RecordBatch):
        out = [[] for _ in range(8)]
        size = 0
        for did, th, text, need in zip(*(b.column(c).to_pylist() for c in ("did", "th", "text", "need")), strict=True):
            raw = (text or "").encode()
            pre = None
            for x in need:
                lo, more, rel, h = x["lo"], x["more"], x["rel"], x["h"]
                if not x["hot"]:
                    pieces = [(h, lo, lo + more, rel)]
                else:  # windows at alike offsets, by the bytes that all of them hold
                    if pre is None:
                        arr = np.frombuffer(raw, np.uint8)
                        pre, inv = prefix_hash(arr), inverse_powers(len(arr) + 1)
                    pieces = []
                    a = lo + rel
                    for t in range((rel - more) // part, rel // part + 1):
                        s, e = max(lo, a - part * t - part + 1), min(lo + more, a - part * t)
                        c0, c1 = a - part * t, a - part * t - part + 1 + span
                        with np.errstate(over="ignore"):
                            core = C.mix((pre[c1 : c1 + 1] - pre[c0 : c0 + 1]) * inv[c0 : c0 + 1])
                            key = C.mix(core ^ C.mix(np.array([h & (2**64 - 1)], np.uint64) + np.uint64(t)))
                        pieces.append((int(key.view(np.int64)[0]), s, e, a - s))
                for key, s, e, r in pieces:
                    for c, v in zip(out, (key, did, th, s, raw[s : e + span], x["n"], r, x["c"]), strict=True):
                        c.append(v)
                    size += e + span - s
            if size > 4 << 20:
                yield _ctx_batch(out)
                out, size = [[] for _ in range(8)], 0
        if out[0]:
            yield _ctx_batch(out)

    return kernel


_CTX = ["key", "did", "th", "lo", "ctx", "n", "rel", "c"]


def _ctx_batch(out):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _CTX)


def _merged_runs(least: int):
    """Overlapping spans of a text joined to runs of at least ``least`` bytes, in order."""

    def kernel(b: pa.RecordBatch):
        spans = b.column("spans")
        flat, ends = spans.flatten(), np.asarray(spans.offsets) - spans.offsets[0].as_py()
        start, stop = np.asarray(flat.field("start")), np.asarray(flat.field("stop"))
        row = np.repeat(np.arange(b.num_rows), np.diff(ends))
        order = np.lexsort((start, row))
        start, stop, row = start[order], stop[order], row[order]
        if not len(row):
            return
        wide = int(stop.max()) + 1  # texts one after the other, so that one running maximum does
        reach = np.maximum.accumulate(stop + row * wide)
        new = np.ones(len(row), bool)
        new[1:] = (start + row * wide)[1:] > reach[:-1]
        head = np.flatnonzero(new)
        row, start, stop = row[head], start[head], reach[np.append(head[1:], len(reach)) - 1] - row[head] * wide
        ok = stop - start >= least
        row, start, stop = row[ok], start[ok], stop[ok]
        n = np.bincount(row, minlength=b.num_rows)
        runs = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]))
        out = pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), runs], ["did", "th", "runs"])
        yield out.filter(pa.array(n > 0))

    return kernel


def repeated_spans(docs: DataFrame, span: int = SPAN, block: int = BLOCK, within: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(did, th, runs): places covered by repeated strings, by id and hash of the text.

    ``within``: an earlier result for a shorter span, to whose runs the search is
    confined.  Also the tables in the shared folder that the result still reads.
    """
    assert 1 <= span <= 1 << 16, "contexts must fit into an index"
    block = max(2, min(block, (13 << 17) // span))  # so that a block's contexts always fit into one index
    spark = docs.sparkSession
    C.prepare(spark)
    gone: list[str] = []
    left: list[str] = []
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    if within is not None:
        long_ = within.select("did", F.col("th").alias("sth"), F.filter("runs", lambda x: x["stop"] - x["start"] >= span).alias("runs")).where("size(runs) > 0")
        d = d.join(long_, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("did")) & (F.col("th") == F.col("sth"))).drop("did", "sth")
        d = C.cut(d, gone)
    every: list[str] = []
    a = C.cut(anchor_table(d, span).withColumn("did", F.coalesce("doc_id", F.lit(-(2**63)))).drop("doc_id"), every)
    # written down, so that the join below reads nothing but tables and Spark can split a hot anchor
    met = C.cut(a.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), every)
    a = C.cut(a.join(met, "h", "left_semi"), gone)  # a context alone with its anchor holds nothing repeated
    C.drop(spark, every)
    ctx = C.cut(
        a.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "lo", "more", "rel")).alias("at")), gone
    )
    sure = (
        a.join(ctx.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
        .select("did", "th", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + span).alias("stop"))
    )
    open_ = ctx.groupBy("h").agg(F.count("*").alias("nd"), F.min("n").alias("least")).where("nd > 1 and least = 1")
    need = (
        ctx.join(open_.select("h", "nd"), "h")
        .select("at.did", "at.th", F.struct("h", "c", "n", "at.lo", "at.more", "at.rel", (F.col("nd") > block // 2).alias("hot")).alias("x"))
        .groupBy("did", "th").agg(F.collect_list("x").alias("need"))
    )
    src = d.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), "th", "text")
    part = max(1, span * 4 // 25)
    cuts = C.cut(
        C.arrow_map(need.join(src, ["did", "th"]).select("did", "th", "text", "need"), _cut_contexts(span, part), "key long, did long, th long, lo long, ctx binary, n long, rel int, c long"),
        gone,
    )
    sizes = cuts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / (block * 3 // 4)))
    dealt = (
        cuts.join(sizes, "key")
        .withColumn("salt", F.pmod(F.xxhash64("c", "lo"), "nb"))
        .select("key", "salt", "nb", "did", "th", "lo", "ctx", "n", "rel")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = C.cut(C.stream_map(dealt.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt"), _index_contexts(span, block), _SPANS_SCHEMA), gone)
    whole = found.where("key is null").select("did", "th", "start", "stop")
    win = found.where("key is not null")
    again = win.groupBy("key", "rel", "wh").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    across = win.where("did is not null").join(again, ["key", "rel", "wh"], "left_semi").select("did", "th", "start", "stop")
    spans = sure.union(whole).union(across).groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    runs = C.cut(C.arrow_map(spans, _merged_runs(span), _RUNS_SCHEMA), left)
    C.drop(spark, gone)
    return runs, left


_RUNS_SCHEMA = "did long, th long, runs array<struct<start:long,stop:long>>"


def whole_words(text: bytes, start: int, stop: int) -> int:
    """Words between ASCII white space that lie wholly in a run of a text."""
    n = len(text[start:stop].split())
    if n and start and not text[start - 1 : start].isspace() and not text[start : start + 1].isspace():
        n -= 1
    if n and stop < len(text) and not text[stop : stop + 1].isspace() and not text[stop - 1 : stop].isspace():
        n -= 1
    return n


def without_runs(text: bytes, runs: list[dict]) -> bytes:
    out, at = [], 0
    for x in runs:
        out.append(text[at : x["start"]])
        at = x["stop"]
    return b"".join([*out, text[at:]])


_REMOVED = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("kept_text", pa.string())]


def _remove(words: int):
    def kernel(b: pa.RecordBatch):
        raw, offsets = C.text_view(b.column("text"))
        rows = [[] for _ in _REMOVED]
        for i, (runs, coarse) in enumerate(zip(b.column("runs").to_pylist(), b.column("coarse").to_pylist(), strict=True)):
            text = raw[offsets[i] : offsets[i + 1]].tobytes()
            kept = without_runs(text, runs or [])
            passages = sum(whole_words(text, x["start"], x["stop"]) >= words for x in coarse or [])
            for c, v in zip(rows, (len(text), len(text) - len(kept), len(runs or []), hashlib.sha256(kept).hexdigest(), passages, kept.decode("utf-8", "ignore")), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(rows, _REMOVED, strict=True))], ["doc_id", *(n for n, _ in _REMOVED)])

    return kernel


def remove_repeats(docs: DataFrame, span: int = SPAN, block: int = BLOCK, passage_span: int = PASSAGE_SPAN, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept_text per row of ``docs``.

    n_removed to kept_sha256 and kept_text are of the text without every byte that a
    repeated string of ``span`` bytes covers.  n_passages counts the runs covered by
    repeated strings of ``passage_span`` bytes that hold ``passage_words`` whole
    words or more: long passages whose bytes may be too few for ``span``.

    Null text counts as empty; rows may repeat, and then repeat each other's
    text.  Text shorter than a span has no repeats.  Where a removed run starts or
    ends inside a character, what is left of that character is dropped from
    kept_text (not from the digest).
    """
    coarse, old = repeated_spans(docs, min(passage_span, span), block)
    runs, _ = repeated_spans(docs, span, block, coarse)
    key = ["did", "th"]
    both = coarse.withColumnRenamed("runs", "coarse").join(runs, key, "left").select(F.col("did").alias("_did"), F.col("th").alias("_sth"), "runs", "coarse")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    j = d.join(both, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_did")) & (F.col("_th") == F.col("_sth")), "left").select("doc_id", "text", "runs", "coarse")
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return C.arrow_map(j, _remove(passage_words), "doc_id long, " + ", ".join(f"{n} {kinds[k]}" for n, k in _REMOVED))


def without_repeats(docs: DataFrame, span: int = PASSAGE_SPAN, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without repeated passages, n_chars, if there, set anew; all rows stay.

    A passage is a run of bytes covered by strings of ``span`` bytes that also start
    elsewhere; it goes if ``least_words`` words or more lie wholly in it.  Null texts
    stay null.  Columns may have any names.
    """
    runs, _ = repeated_spans(docs, span)
    row = docs.select(F.struct(*docs.columns).alias("row"))
    j = row.join(runs, (F.coalesce("row.doc_id", F.lit(-(2**63))) == F.col("did")) & (F.xxhash64("row.text") == F.col("th")), "left").select("row", "runs")
    names = docs.columns

    def kernel(b: pa.RecordBatch):
        cols = dict(zip(names, b.column("row").flatten(), strict=True))
        text = cols["text"].to_pylist()
        for i, runs in enumerate(b.column("runs").to_pylist()):
            if runs and text[i] is not None:
                raw = text[i].encode()
                go = [x for x in runs if whole_words(raw, x["start"], x["stop"]) >= least_words]
                if go:
                    text[i] = without_runs(raw, go).decode("utf-8", "ignore")
        cols["text"] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    out = C.arrow_map(j, kernel, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
