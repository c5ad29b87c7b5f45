"""Token ids in directly addressable codes.

An id is split into chunks of eight bits.  Level k holds the k-th chunk of every
id that has one, and a bitmap that says which of them continue; a rank directory
over the bitmap leads from an id's chunk on one level to its next chunk.  Any
token is read by a few array look-ups, without decoding a block.

A file of the format holds some documents in ascending doc_id order:

    magic "DAC2" | levels, documents, tokens (uint32) | doc_id (int64 each)
    | a byte for each document: 1 if it has a doc_id | start of each document,
    and the end (uint64) | then for each level:
    chunks, chunk bytes, bitmap bytes, directory entries (uint64 each)
    | chunk bytes | bitmap | ranks before each 512 bits (uint64)

Files are the binary values of a Parquet table, so Spark's commit protocol makes
them whole and any store that Spark reads can hold them.
"""

from __future__ import annotations

import itertools
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ordered import cut_points, partitions, range_number

#: Tokens of a file, unless one document has more.
FILE_TOKENS = 1 << 18
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_000_000
#: New words that go to the library in one call, and in one text of a call.
CALL_WORDS, TEXT_WORDS = 2048, 64
#: Bytes of text that are encoded together.
TEXT_BYTES = 4 << 20
END = 1
_DIR = 512


class DirectCodes:
    """Encoder and reader of one file."""

    def __init__(self, blob: bytes):
        assert blob[:4] == b"DAC2", "not a file of this format"
        levels, docs, self.n_tokens = struct.unpack_from("<III", blob, 4)
        at = 16
        self.doc_ids = np.frombuffer(blob, "<i8", docs, at)
        at += 8 * docs
        self.named = np.frombuffer(blob, np.uint8, docs, at) == 1
        at += docs
        self.starts = np.frombuffer(blob, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            n, a, b, c = struct.unpack_from("<QQQQ", blob, at)
            at += 32
            chunks = np.frombuffer(blob, np.uint8, a, at)
            bits = np.frombuffer(blob, np.uint8, b, at + a)
            ranks = np.frombuffer(blob, "<u8", c, at + a + b).astype(np.int64)
            at += a + b + 8 * c
            self.levels.append((n, chunks, bits, ranks))

    @staticmethod
    def encode(ids: np.ndarray, doc_ids: list[int | None] | np.ndarray, starts: np.ndarray) -> bytes:
        """``doc_ids`` may be null: such documents are found by their place alone."""
        ids = ids.astype(np.uint32)
        named = np.array([x is not None for x in doc_ids], np.uint8)
        doc_ids = np.array([0 if x is None else x for x in doc_ids], np.int64)
        parts, left = [], ids
        while True:
            more = left >> np.uint32(8)
            go = more > 0
            pad = np.zeros(-(-max(len(left), 1) // _DIR) * _DIR, np.uint8)
            pad[: len(left)] = go
            bits = np.packbits(pad, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), _DIR // 8), dtype=np.int64)
            ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
            chunks = (left & np.uint32(255)).astype(np.uint8)
            parts.append(struct.pack("<QQQQ", len(left), len(chunks), len(bits), len(ranks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
            if not go.any():
                break
            left = more[go]
        head = b"DAC2" + struct.pack("<III", len(parts), len(doc_ids), len(ids))
        return head + doc_ids.astype("<i8").tobytes() + named.tobytes() + starts.astype("<u8").tobytes() + b"".join(parts)

    def _rank(self, level: int, p: int) -> int:
        """Continuations among the first p chunks of a level."""
        _, _, bits, ranks = self.levels[level]
        block = p // _DIR
        got = int(ranks[block])
        tail = bits[block * _DIR // 8 : p // 8 + 1]
        if len(tail):
            got += int(np.bitwise_count(tail[: p // 8 - block * _DIR // 8]).sum())
            if p % 8:
                got += int(bits[p // 8] & ((1 << p % 8) - 1)).bit_count()
        return got

    def token(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = level = 0
        while True:
            _, chunks, bits, _ = self.levels[level]
            out |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return out
            i = self._rank(level, i)
            level, shift = level + 1, shift + 8

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: on each level one slice, found by its rank."""
        n = b - a
        out, who = np.zeros(n, np.uint32), np.arange(n)
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            out[who] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            go = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a] == 1
            who = who[go]
            if level + 1 < len(self.levels):
                a = self._rank(level, a)
                b = a + len(who)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


_PUNCT = C.byte_class(b".,!|%$&*#?;:()")
_ALPHA = C.byte_class(bytes(range(97, 123)))


class WordEncoder:
    """Ids of whole texts through the tokenizers library, which sees each word once.

    Valid for tokenizers that lower-case, drop white space and never join across
    it, and that end a run of letters at ASCII punctuation: a text's ids are then
    those of its words, parted at white space and between an ASCII letter and the
    punctuation after it.  Texts with "<|", where special tokens may stand, go
    to the library whole, and so do all texts if ``_parts_at_words`` finds a
    tokenizer of another kind.  New words of letters alone go to it many at a
    time, as texts, if the vocabulary marks the ends of words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads would each keep a heap
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.by_word = self._parts_at_words(self.lib)
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._reset()

    @staticmethod
    def _parts_at_words(lib) -> bool:
        """Whether the library's normaliser and pre-tokenizer do what the word rule relies on.

        They are asked about a text with each kind of boundary: its parts must be
        those of its words by themselves, in lower case.
        """
        if lib.normalizer is None or lib.pre_tokenizer is None or lib.post_processor is not None and lib.post_processor.num_special_tokens_to_add(False):
            return False

        def parts(x: str) -> list[str]:
            return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(x))]

        words = ["Ab", "c", ".", "d1", "2,5", "É", "don't", "x-y", "!!", "\u0130Z", "e\u0301", "(q)", "ß.", "a_b"]
        for space in (" ", "\n", "\t ", "\r\n", "\x0b", "\x0c"):
            if parts(space + space.join(words) + space) != [p for w in words for p in parts(w)]:
                return False
        return parts("Ab") == ["ab"] and all(parts("a" + p + "b") == parts("a") + parts(p + "b") for p in map(chr, _PUNCT.nonzero()[0]))

    def _reset(self):
        self.number: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, np.int64)  # where each word's ids start; grows by doubling, as ids does
        self.ids = np.zeros(1 << 18, np.uint32)

    @staticmethod
    def _letters(w: bytes) -> bool:
        """Whether normalisation leaves a word as it is, one run of letters."""
        if w.isalpha():
            return True
        t = w.decode()
        return t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t)

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one by one, and how many each has."""
        lens, flat = [], []
        for k in range(0, len(words), CALL_WORDS):
            for e in self.lib.encode_batch_fast([w.decode() for w in words[k : k + CALL_WORDS]], add_special_tokens=False):
                ids = e.ids
                lens.append(len(ids))
                flat += ids
        return np.array(flat, np.uint32), np.array(lens, np.int64)

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, by the ends of words in the ids of joined texts."""
        flat = []
        texts = [b" ".join(words[k : k + TEXT_WORDS]).decode() for k in range(0, len(words), TEXT_WORDS)]
        for k in range(0, len(texts), CALL_WORDS // TEXT_WORDS):
            for e in self.lib.encode_batch_fast(texts[k : k + CALL_WORDS // TEXT_WORDS], add_special_tokens=False):
                flat += e.ids
        ids = np.array(flat, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or (len(ids) and at[-1] != len(ids)):
            return self._each(words)
        return ids, np.diff(at, prepend=0)

    def _learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if self._letters(w)] if self.ends.any() else []
        known = set(plain)
        parts = [(plain, self._joined), ([w for w in new if w not in known], self._each)]
        for words, how in parts:
            if words:
                ids, lens = how(words)
                n, at = len(self.number), int(self.first[len(self.number)])
                self.number.update(zip(words, range(n, n + len(words)), strict=True))
                while n + len(words) + 1 > len(self.first):
                    self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                while at + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.first[n + 1 : n + 1 + len(words)] = at + np.cumsum(lens)
                self.ids[at : at + len(ids)] = ids

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if not self.by_word:
            return self._each([raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)])
        low = C.LOWER[raw]
        whole = [d for d in range(len(off) - 1) if b"<|" in raw[off[d] : off[d + 1]].tobytes()] if b"<|" in raw.tobytes() else []
        inside = C.SPACE_WORD[low]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | (_ALPHA[low[:-1]] & _PUNCT[low[1:]])
        heads = off[:-1][off[:-1] < off[1:]]
        start[heads] = inside[heads]
        at = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside)).astype(np.int32)
        parts = [None, pa.py_buffer(at), pa.py_buffer(low[inside])]
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, parts).dictionary_encode()  # no Python object for each word
        if len(self.number) > CACHE_WORDS:
            self._reset()
        once = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.number.get, once, itertools.repeat(-1)), np.int64, len(once))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = [once[i] for i in missing.tolist()]
            self._learn(new)
            known[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        k = known[np.asarray(coded.indices)]
        n = self.first[k + 1] - self.first[k]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(self.first[k], n)]
        bound = np.searchsorted(np.flatnonzero(start), off)
        lens = total[bound[1:]] - total[bound[:-1]]
        if whole:
            parts = np.split(out, np.cumsum(lens)[:-1])
            for d in whole:
                e = self.lib.encode(raw[off[d] : off[d + 1]].tobytes().decode(), add_special_tokens=False)
                parts[d] = np.array(e.ids, np.uint32)
                lens[d] = len(e.ids)
            out = np.concatenate(parts)
        return out, lens


_made: dict[str, WordEncoder] = {}


def _writer(path: str, file_tokens: int, end: int):
    def run(batches):
        if path not in _made:
            _made[path] = WordEncoder(path)
        enc = _made[path]
        ids, lens, names, pid, seq, size, before = [], [], [], None, 0, 0, 0

        def file():
            n = np.concatenate(lens)
            starts = np.concatenate([[0], np.cumsum(n)])
            blob = DirectCodes.encode(np.concatenate(ids), names, starts)
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([blob], pa.binary())], ["pid", "seq", "before", "n", "file"])

        for b in batches:
            if not b.num_rows:
                continue
            pids = np.asarray(b.column("pid"))
            raw, offsets = C.text_view(b.column("text"))
            for i, j in C.slices(offsets, TEXT_BYTES):
                got, n = enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(n)
                got = np.insert(got, ends, end)
                n = n + 1
                at = np.concatenate([[0], np.cumsum(n)])
                for k in range(j - i):
                    if names and (size + n[k] > file_tokens or pids[i + k] != pid):
                        yield file()
                        seq, before = (seq + 1, before + size) if pids[i + k] == pid else (0, 0)
                        ids, lens, names, size = [], [], [], 0
                    pid = int(pids[i + k])
                    ids.append(got[at[k] : at[k + 1]])
                    lens.append(n[k : k + 1])
                    names.append(b.column("doc_id")[i + k].as_py())
                    size += int(n[k])
        if names:
            yield file()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, file_tokens: int = FILE_TOKENS, end: int = END) -> DataFrame:
    """Files (pid, seq, before, n, file) in ascending doc_id order, written to ``path``.

    pid numbers ranges of ids, seq the files of a range, before its ids in earlier files.

    Null text counts as empty (its only id is ``end``); rows without an id come
    first, and rows of one id, or of none, stand in order of their text's hash.  An
    empty table gives no files.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    cuts = cut_points(docs, partitions(docs))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), range_number(F.col("doc_id"), cuts).alias("pid"))
    d = d.repartitionById(len(cuts) + 1, F.col("pid")).sortWithinPartitions("pid", "doc_id", "th").select("doc_id", "text", "pid")
    files = C.stream_map(d, _writer(tokenizer, file_tokens, end), "pid int, seq long, before long, n long, file binary")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))  # fewer slices: words repeat more within one
    try:
        if path is None:
            return C.cut(files)
        files.write.parquet(path)
        return spark.read.parquet(path)
    finally:
        C.prepare(spark)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: decoded from the files."""
    spark = files.sparkSession
    per = {r.pid: r.n for r in files.groupBy("pid").agg(F.sum("n").alias("n")).collect()}  # a number for each range
    base, at = [], 0
    for pid in sorted(per):
        base.append((pid, at))
        at += per[pid]
    base = spark.createDataFrame(base, "pid int, base long")
    at = files.join(F.broadcast(base), "pid").select("file", (F.col("base") + F.col("before")).alias("at"))

    def run(batches):
        for b in batches:
            for blob, first in zip(b.column("file"), b.column("at").to_pylist(), strict=True):
                f = DirectCodes(blob.as_buffer().to_pybytes())
                n = np.diff(f.starts)
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=~f.named), pa.array(f.starts[:-1] + first), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return C.stream_map(at, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
