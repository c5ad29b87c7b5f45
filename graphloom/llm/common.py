"""Shared helpers: shared-folder checkpoints, Arrow text views and word hashing.

Kernels never build a Python string per word.  They work on the UTF-8 buffer of
an Arrow batch together with the document offsets, in slices of bounded size.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel looks at together (one document may exceed it).
SLICE_BYTES = 1 << 18
#: Rows and bytes that Spark hands to a Python worker at a time: bounds its memory.
ROWS_PER_BATCH = 2048
BATCH_BYTES = 2 << 20


_libc = None
with contextlib.suppress(OSError, AttributeError):  # not everywhere
    # Workers are reused: give large buffers back at once instead of keeping them in the heap.
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Return freed memory to the system; called when a task's batches are over."""
    if _libc is not None:
        _libc.malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory doesn't follow text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: ends its lineage.

    ``into`` collects the path, for ``drop``.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written by ``cut`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow text


def text_view(col) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 bytes, int64 offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        kind = np.int32
    else:
        kind = np.int64
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Consecutive document ranges (i, j) of at most ``limit`` bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(256, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _POW
    while len(_POW) < n or _POW[1] != _BASE:
        size = max(n, 2 * len(_POW))
        with np.errstate(over="ignore"):
            out = np.full(size, _BASE, np.uint64)
            out[0] = 1
            _POW = np.multiply.accumulate(out)
    return _POW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space: [^\x20\x09-\x0D]
SPACE_WORD = ~byte_class(b" \t\n\x0b\x0c\r")
#: Bytes of words of digits, lower-case letters and non-ASCII characters.
ALNUM_WORD = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


def words(low: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Starts, ends (bytes) and document number of each word, in text order."""
    if not len(low):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[low]
    cuts = np.zeros(len(low) + 1, bool)
    cuts[offsets[:-1]] = True  # a word never crosses documents
    prev = np.empty(len(low), bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | cuts[:-1]))
    nxt = np.empty(len(low), bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    last = cuts[1:].copy()
    last[-1] = True
    ends = np.flatnonzero(inside & (~nxt | last)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        coded = BYTE_CODE[low[at]] * powers(int(lens.max()) + 1)[within]
        return mix(np.add.reduceat(coded, first) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and where each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        p = powers(k + 1)
        out = np.zeros(n, np.uint64)
        for t in range(k):
            out += h[t : t + n] * p[t + 1]
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return mix(out[at] + np.uint64(k)), at


def arrow_map(df: DataFrame, kernel, schema: str) -> DataFrame:
    """mapInArrow with ``kernel(batch) -> iterable of record batches``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from kernel(b)
        trim()

    return df.mapInArrow(run, schema)


def stream_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with ``run(batches) -> iterable of record batches``."""

    def whole(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(whole, schema)
