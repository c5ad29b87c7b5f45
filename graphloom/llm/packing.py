"""Optimal length buckets and token-budget batches.

Texts are cut into pieces of at most ``max_len`` tokens, so that the global
length histogram has at most ``max_len + 1`` bins, however long texts are.  A
dynamic programme over the histogram chooses the bucket boundaries that minimise
padding; each bucket's pieces are dealt into batches of as many pieces as the
token budget holds at the bucket's padded length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16384
#: Parts of a bucket that are numbered independently.
PARTS = 4096


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` ascend.  best[k][j] is the least padding of the first j lengths in
    k buckets.  The padding cost meets the quadrangle inequality, so the best
    last cut doesn't move left as j grows: divide and conquer finds a row of the
    table in O(n log n).  Ties take the leftmost cut and the fewest buckets.
    """
    n = len(lengths)
    if not n:
        return []
    length = np.array(lengths, np.int64)
    c = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    t = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) * length)])

    def cost(i, j):  # lengths[i:j] padded to lengths[j - 1]
        return length[j - 1] * (c[j] - c[i]) - (t[j] - t[i])

    every = np.arange(1, n + 1)
    prev = np.concatenate([[0], cost(np.zeros(n, int), every)])
    cuts, ends = [], [int(prev[n])]
    for _ in range(1, min(buckets, n)):
        now, cut = prev.copy(), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            v = prev[i] + cost(i, j)
            k = int(np.argmin(v))
            now[j], cut[j] = v[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        ends.append(int(now[n]))
        prev = now
    k = int(np.argmin(ends))
    out, j = [], n
    while True:
        out.append(int(length[j - 1]))
        if k == 0 or j == 0:
            break
        j = int(cuts[k - 1][j])
        k -= 1
        if j == 0:
            break
    return out[::-1]


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ ; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(docs: DataFrame, n_tokens: Column, max_len: int) -> DataFrame:
    """doc_id, piece, start, n_tokens: each text in pieces; an empty text is one of 0 tokens."""
    d = docs.select("doc_id", n_tokens.alias("total"))
    last = F.greatest((F.col("total") - 1).cast("long"), F.lit(0).cast("long"))
    return d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / max_len)))).select(
        "doc_id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len).cast("long")).alias("n_tokens")
    )


def pack(docs: DataFrame, n_tokens: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, bucket_len, batch, place.

    bucket counts from 0 by rising bucket_len, the length its pieces are padded
    to; batch counts from 0 within a bucket, place within a batch, by
    doc_id mod PARTS, doc_id and piece.  A batch holds max(1, budget div bucket_len)
    pieces.  Null text counts as empty; repeated rows are pieces of their own;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    p = pieces(docs, word_count(F.col("text")) if n_tokens is None else n_tokens, max_len)
    p = p.withColumn("part", F.pmod(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(PARTS)).cast("int"))
    p = cut(p)  # a few numbers per piece; texts are read once
    hist = {r.n_tokens: r.n for r in p.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most max_len + 1 rows
    bounds = boundaries(sorted(hist), [hist[k] for k in sorted(hist)], buckets)
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    p = p.withColumn("bucket", bucket.cast("int"))
    # at most buckets * PARTS rows
    size = {(r.bucket, r.part): r.n for r in p.groupBy("bucket", "part").agg(F.count("*").alias("n")).collect()}
    rows, at, now = [], 0, None
    for b, part in sorted(size):
        at = at if b == now else 0
        now = b
        rows.append((b, part, bounds[b], at))
        at += size[b, part]
    first = spark.createDataFrame(rows, "bucket int, part int, bucket_len long, base long")
    w = Window.partitionBy("bucket", "part").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    hold = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        p.join(F.broadcast(first), ["bucket", "part"])  # at most buckets * PARTS rows
        .withColumn("rank", F.col("base") + F.row_number().over(w) - 1)
        .select(
            "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len",
            F.floor(F.col("rank") / hold).alias("batch"), F.pmod("rank", hold).alias("place"),
        )
    )


def pack_sql(source: str = "documents", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same as DuckDB SQL; the dynamic programme is unrolled by bucket."""
    step = [
        "b1 AS (SELECT j, len * c - t AS v, 0 AS i FROM h)",
        *(
            f"b{k} AS (SELECT j, arg_min(v, (v, i)) AS v, arg_min(i, (v, i)) AS i FROM ("
            f"SELECT h.j, p.i AS i, p.v + h.len * (h.c - p.c) - (h.t - p.t) AS v FROM h JOIN "
            f"(SELECT j AS i, v, c, t FROM b{k - 1} JOIN h USING (j)) p ON p.i < h.j) GROUP BY j)"
            for k in range(2, buckets + 1)
        ),
    ]
    ends = " UNION ALL ".join(f"SELECT {k} AS k, v FROM b{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    back = [f"best AS (SELECT arg_min(k, (v, k)) AS k FROM ({ends}))"]
    cuts = " UNION ALL ".join(f"SELECT {k} AS k, j, i FROM b{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS total FROM {source}),
p AS (SELECT doc_id, piece, piece * {max_len} AS start, least(total - piece * {max_len}, {max_len}) AS n_tokens
  FROM (SELECT doc_id, total, unnest(range(0, greatest(total - 1, 0) // {max_len} + 1)) AS piece FROM d)),
g AS (SELECT n_tokens AS len, count(*) AS n FROM p GROUP BY 1),
h AS (SELECT len, row_number() OVER (ORDER BY len) AS j, sum(n) OVER (ORDER BY len) AS c, sum(n * len) OVER (ORDER BY len) AS t FROM g),
{", ".join(step + back)},
cuts AS ({cuts}),
walk AS (SELECT (SELECT k FROM best) AS k, (SELECT max(j) FROM h) AS j
  UNION ALL SELECT w.k - 1, c.i FROM walk w JOIN cuts c ON c.k = w.k AND c.j = w.j WHERE w.k > 1 AND c.i > 0),
b AS (SELECT row_number() OVER (ORDER BY len) - 1 AS bucket, len AS bucket_len, coalesce(lag(len) OVER (ORDER BY len), -1) AS below
  FROM walk JOIN h USING (j)),
r AS (SELECT p.*, b.bucket, b.bucket_len, row_number() OVER (
  PARTITION BY b.bucket ORDER BY p.doc_id % {PARTS}, p.doc_id, p.piece) - 1 AS rank
  FROM p JOIN b ON p.n_tokens > b.below AND p.n_tokens <= b.bucket_len)
SELECT doc_id, piece, start, n_tokens, bucket::INT AS bucket, bucket_len,
  (rank // greatest(1, {budget} // greatest(bucket_len, 1)))::BIGINT AS batch,
  (rank % greatest(1, {budget} // greatest(bucket_len, 1)))::BIGINT AS place FROM r"""
