"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about a quarter of a million words.  Its words become
dense symbols; the suffix array of the symbols gives the Burrows-Wheeler
transform, which is held as a wavelet matrix with rank directories.  Benchmark
windows are searched backward, all at once; occurrences are located by walking
to sampled suffix positions, and their spans are merged per document.

Benchmark windows reach the shards by broadcast in blocks of at most
``BLOCK_BYTES`` of text, each block against all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 8
SHARD_WORDS = 1 << 18
SAMPLE = 16
#: Benchmark text per broadcast block.
BLOCK_BYTES = 8 << 20


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Full suffix array by prefix doubling; only ties are sorted again."""
    n = len(sym)
    bits = max(1, int(sym.max()).bit_length()) if n else 1
    idx = max(1, n.bit_length())
    h = max(1, (64 - idx) // bits)
    ext = np.zeros(n + h, np.uint64)
    ext[:n] = sym
    key = np.zeros(n, np.uint64)
    for t in range(h):
        key = (key << np.uint64(bits)) | ext[t : t + n]
    low = np.uint64((1 << idx) - 1)
    packed = np.sort((key << np.uint64(idx)) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    head = np.ones(n + 1, bool)
    head[1:n] = (packed[1:] >> np.uint64(idx)) != (packed[:-1] >> np.uint64(idx))
    rank = np.zeros(n + 1, np.int64)  # of a suffix, from 1; 0 is the empty one
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0)) + 1
    while True:
        slots = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(slots):
            return sa
        p = sa[slots]
        r1, r2 = rank[p], rank[np.minimum(p + h, n)]
        order = np.argsort(r1 * np.int64(n + 2) + r2, kind="stable")
        p, r1, r2 = p[order], r1[order], r2[order]
        sa[slots] = p
        first = np.ones(len(slots), bool)
        first[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
        head[slots] = first
        rank[p] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
        h *= 2


class Wavelet:
    """Wavelet matrix: rank of a symbol in a prefix, in one step per bit."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = (x >> b) & 1 == 1
            pad = np.zeros(-(-(len(x) + 1) // 64) * 64, np.uint8)
            pad[: len(x)] = one
            packed = np.packbits(pad, bitorder="little").view("<u8")
            directory = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=directory[1:])
            zeros = len(x) - int(directory[-1])
            self.levels.append((packed, directory, zeros))
            x = np.concatenate([x[~one], x[one]])

    @staticmethod
    def _ones(level, p):
        packed, directory, _ = level
        w = p >> 6
        mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return directory[w] + np.bitwise_count(packed[w] & mask)

    def rank(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c[i] among the first p[i]."""
        lo = np.zeros(len(c), np.int64)
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            bit = (c >> b) & 1 == 1
            a, z = self._ones(level, lo), self._ones(level, p)
            lo = np.where(bit, level[2] + a, lo - a)
            p = np.where(bit, level[2] + z, p - z)
        return p - lo

    def access_rank(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at p[i], and its occurrences before p[i]."""
        c, lo = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for level in self.levels:
            bit = (level[0][p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, z = self._ones(level, lo), self._ones(level, p)
            lo = np.where(bit, level[2] + a, lo - a)
            p = np.where(bit, level[2] + z, p - z)
            c = (c << 1) | bit
        return c, p - lo


class FMIndex:
    """FM-index of a symbol sequence (symbols from 1)."""

    def __init__(self, sym: np.ndarray):
        text = np.append(sym, 0)
        sa = suffix_array(text)
        self.n = len(text)
        sigma = int(text.max()) + 1
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.bwt = Wavelet(text[sa - 1].astype(np.int64), max(1, (sigma - 1).bit_length()))
        marked = (sa % SAMPLE == 0).astype(np.int64)
        self.marks = Wavelet(marked, 1)
        self.samples = sa[marked == 1]

    def search(self, pat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each pattern; symbols < 1 match nothing."""
        lo, hi = np.zeros(len(pat), np.int64), np.full(len(pat), self.n)
        width = pat.shape[1] if pat.ndim == 2 else 0
        live = np.flatnonzero(~((pat < 1) & (np.arange(width) < length[:, None])).any(1)) if len(pat) else np.zeros(0, int)
        dead = np.ones(len(pat), bool)
        dead[live] = False
        hi[dead] = 0
        for t in range(width - 1, -1, -1):
            on = live[t < length[live]]
            if len(on):
                c = pat[on, t]
                lo[on] = self.first[c] + self.bwt.rank(c, lo[on])
                hi[on] = self.first[c] + self.bwt.rank(c, hi[on])
                live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        rows = rows.copy()
        out, steps = np.full(len(rows), -1), 0
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            hit, before = self.marks.access_rank(at)
            found = hit == 1
            out[todo[found]] = self.samples[before[found]] + steps
            todo, at = todo[~found], at[~found]
            if len(todo):
                c, r = self.bwt.access_rank(at)
                rows[todo] = self.first[c] + r
            steps += 1
        return out


def windows(items: list[tuple[object, str]], width: int):
    """Distinct windows of word hashes of items, their lengths, and (window, item number)."""
    raw, off = C.text_view(pa.array([t or "" for _, t in items], pa.string()))
    low = C.LOWER[raw]
    st, en, doc = C.words(low, off, C.ALNUM_WORD)
    h = C.word_hashes(low, st, en)
    rows, owner = [], []
    for i in range(len(items)):
        a, b = np.searchsorted(doc, [i, i + 1])
        w = h[a:b]
        if len(w) >= width:
            rows.append(np.lib.stride_tricks.sliding_window_view(w, width))
            owner.append(np.full(len(w) - width + 1, i))
        elif len(w):
            rows.append(np.concatenate([w, np.zeros(width - len(w), np.uint64)])[None])
            owner.append(np.array([i]))
    if not rows:
        return np.zeros((0, width), np.uint64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    pat, inv = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([inv.reshape(-1), np.concatenate(owner)], 1), axis=0)
    return pat, (pat != 0).sum(1), pairs


_SPAN = "array<struct<start:long,stop:long,byte_start:long,byte_stop:long>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("byte_start", pa.int64()), ("byte_stop", pa.int64())]))


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(text: str | None, hits: list[dict]) -> str | None:
    """A text without its hit spans."""
    if not len(hits):
        return text
    raw, out, at = text.encode(), [], 0
    for x in hits:
        out.append(raw[at : x["byte_start"]])
        at = x["byte_stop"]
    return b"".join([*out, raw[at:]]).decode()


def _search(ids: list[str | None], pat, length, pairs, shard_words: int, width: int, cut: bool):
    """Batches of (row, text) -> row, text (without the hits, if ``cut``), n_words, hits, item_ids."""
    by_win = pairs[np.argsort(pairs[:, 0], kind="stable")]
    heads = np.searchsorted(by_win[:, 0], np.arange(len(pat) + 1))
    names = np.array([*ids, ""], dtype=object)

    def shard(parts):
        """Index the pieces (document, word hashes, offset) and note the hits of each document."""
        h = np.concatenate([p[1] for p in parts])
        vocab, inv = np.unique(h, return_inverse=True)
        lens = np.array([len(p[1]) for p in parts])
        starts = np.cumsum(lens + 1) - lens - 1
        text = np.ones(len(h) + len(parts), np.int64)  # 1 parts the pieces
        within = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
        text[np.repeat(starts, lens) + within] = inv + 2
        index = FMIndex(text)
        at = np.minimum(np.searchsorted(vocab, pat), len(vocab) - 1)
        lo, hi = index.search(np.where(vocab[at] == pat, at + 2, 0), length)
        count = hi - lo
        win = np.repeat(np.arange(len(pat)), count)
        if len(win):
            rows = np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count) + lo[win]
            pos = index.locate(rows)
            part = np.searchsorted(starts, pos, "right") - 1
            for p, q, w in zip(part.tolist(), (pos - starts[part]).tolist(), win.tolist(), strict=True):
                parts[p][0][-1].append((q + parts[p][2], w))

    def emit(docs):
        hits, items = [], []
        for _, _, st, en, found in docs:
            cover = _union([(q, q + int(length[w])) for q, w in found])
            hits.append([{"start": a, "stop": b, "byte_start": int(st[a]), "byte_stop": int(en[b - 1])} for a, b in cover])
            of = {names[i] for w in {w for _, w in found} for i in by_win[heads[w] : heads[w + 1], 1].tolist()}
            items.append(sorted(of - {None}))
        i = 0
        while i < len(docs):  # rows of one Arrow batch go out together
            b, k = docs[i][0]
            j = i
            while j < len(docs) and docs[j][0][0] is b:
                j += 1
            n = pa.array([len(d[2]) for d in docs[i:j]], pa.int64())
            cols = [c.slice(k, j - i) for c in b.columns]
            if cut and any(hits[i:j]):
                at = b.schema.get_field_index("text")
                cols[at] = pa.array([_cut(t, h) for t, h in zip(cols[at].to_pylist(), hits[i:j], strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*cols, n, pa.array(hits[i:j], _TYPE), pa.array(items[i:j], pa.list_(pa.string()))],
                [*b.schema.names, "n_words", "hits", "item_ids"],
            )
            i = j

    def run(batches):
        docs, parts, size = [], [], 0
        for b in batches:
            raw, offsets = C.text_view(b.column("text"))
            for i, j in C.slices(offsets):
                off = offsets[i : j + 1] - offsets[i]
                low = C.LOWER[raw[offsets[i] : offsets[j]]]
                st, en, doc = C.words(low, off, C.ALNUM_WORD)
                h = C.word_hashes(low, st, en)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    a, z = int(cuts[k]), int(cuts[k + 1])
                    docs.append(((b, i + k), None, st[a:z] - off[k], en[a:z] - off[k], []))
                    # a very long document goes in pieces that overlap by all but one word of a window
                    for s in range(0, max(z - a - width + 1, min(1, z - a)), shard_words) if len(pat) else ():
                        piece = h[a + s : min(z, a + s + shard_words + width - 1)]
                        if parts and size + len(piece) > shard_words:
                            shard(parts)
                            yield from emit(docs[:-1])
                            docs, parts, size = docs[-1:], [], 0
                        parts.append((docs[-1], piece, s))
                        size += len(piece)
            if not len(pat):
                yield from emit(docs)
                docs = []
        if parts:
            shard(parts)
        yield from emit(docs)

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, width: int = WINDOW, cut: bool = False) -> DataFrame:
    """row (all columns but text), text, n_words, hits, item_ids: one row per row of ``docs``.

    hits: disjoint spans of words (from 0) and bytes inside occurrences of
    benchmark windows; item_ids: distinct ids, as sorted strings, of the items
    they come from, whose rows may be several.  Items with a null id give hits
    but no id.  Null text has no words and no hits.  Items without words, and an
    empty benchmark, match nothing.  Repeated rows are judged each by itself; extra
    columns, whatever their names, are carried in ``row``.  With ``cut``, text
    comes without the hit spans.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    src = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")
    if blocks > 1:  # hits of several blocks meet by a row number that is written down
        src = C.cut(src.withColumn("at", F.monotonically_increasing_id()))
    out = None
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes of text
        pat, length, pairs = windows([(r.item_id, r.text) for r in rows], width)
        kind = T.StructType(src.schema.fields + T.StructType.fromDDL(f"n_words long, hits {_SPAN}, item_ids array<string>").fields)
        got = C.stream_map(src, _search([r.item_id for r in rows], pat, length, pairs, shard_words, width, cut and blocks == 1), kind)
        out = got if out is None else out.unionByName(got)
    if blocks > 1:
        hits = out.groupBy("at").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
        out = src.join(hits, "at").select("row", "text", "n_words", _merged("hits").alias("hits"), "item_ids")
        if cut:
            out = out.withColumn("text", _cut_column("text", "hits"))
    return out


def _merged(column: str):
    def one(xs):
        out = []
        for x in sorted(xs, key=lambda x: (x["start"], x["stop"])):
            if out and x["start"] <= out[-1]["stop"]:
                if x["stop"] > out[-1]["stop"]:
                    out[-1] |= {"stop": x["stop"], "byte_stop": x["byte_stop"]}
            else:
                out.append(dict(x))
        return out

    def run(spans: pd.Series) -> pd.Series:
        return spans.map(one)

    return F.pandas_udf(run, _SPAN)(column)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``find_hits``."""
    n = F.size("item_ids").cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_hit"),
        n.alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"),
    )


def _cut_column(text: str, hits: str):
    def run(t: pd.Series, h: pd.Series) -> pd.Series:
        return t.combine(h, _cut)

    return F.pandas_udf(run, "string")(text, hits)


def without_spans(docs: DataFrame, benchmark: DataFrame, drop_from: int | None = None) -> DataFrame:
    """``docs`` with benchmark spans cut from the text; rows with hits of ``drop_from`` items or more go."""
    found = find_hits(docs, benchmark, cut=True)
    if drop_from is not None:
        found = found.where(F.size("item_ids") < drop_from)
    return found.select(*("text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
