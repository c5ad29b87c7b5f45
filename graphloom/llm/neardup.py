"""MinHash near-dedup with SuperMinHash signatures, banding, verification, union.

1. Every text becomes a set of five-word shingles (64-bit hashes).  One pass
   yields its size, a 128-bit commutative digest of the set and a SuperMinHash
   signature of 128 rows of 16 bits.
2. Texts with equal sets are one class; only its smallest id goes on.  Ids here
   are row keys that are written down with the texts, so repeated rows, rows
   of one doc_id with different texts and rows without a doc_id are told apart.
3. 32 bands of four rows make buckets.  A pair at similarity 0.75 misses all
   buckets with probability 5e-6.  Members are first checked against the
   smallest and the largest member of their bucket: a number of pairs linear in
   the bucket.  Verified links are joined into components.  In buckets that
   still hold several components, members are then checked against a member
   picked by hash, if it lies in another component.
4. For buckets that still hold several components, the largest one (the hub) is
   dealt into blocks, to which the members of its other components are sent;
   those also meet each other by bucket, in blocks of pairs.  Signatures tell
   which members of a block may have a link; their sets are then compared in the
   block, and of its links only those that join components leave it.  So no link
   between different texts is lost, and no task lists all pairs of a group.
5. Links are confirmed on full sets, by 100 * |A and B| >= 75 * |A or B|.

A signature that agrees in under half of its rows cannot belong to a pair at
0.75 (over five standard deviations away), so such pairs skip the full check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

ROWS, BANDS = 128, 32
SHINGLE = 5
#: Least number of agreeing signature rows of a pair that is checked on full sets.
LEAST_AGREE = 66
#: Rounds of checks against members picked by hash.
ROUNDS = 1
#: Members of a bucket that are compared in one task.
BLOCK = 512
#: Shingles whose permutation states are held at a time.
ELEMENTS = 1 << 16


def superminhash(h: np.ndarray, owner: np.ndarray, n: int, rows: int = ROWS) -> np.ndarray:
    """(n, rows) signatures as uint64; ``owner`` maps each element to its set.

    Element e places rank j (plus a uniform fraction) at position perm_e(j);
    a row keeps the least value.  Ranks are dealt layer by layer, all elements
    at once, and a set stops as soon as every row holds a value below the next
    rank: the early stop of the sequential algorithm.
    """
    best = np.full(n * rows, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for s in range(0, len(h), ELEMENTS):
            _deal(C.mix(h[s : s + ELEMENTS] + np.uint64(0x632BE59BD9B4E019)), owner[s : s + ELEMENTS], best, rows)
    return best.reshape(n, rows)


def _deal(state: np.ndarray, owner: np.ndarray, best: np.ndarray, rows: int) -> None:
    lo = int(owner[0])
    sets = int(owner[-1]) - lo + 1
    view = best[lo * rows : (lo + sets) * rows]
    local = owner - lo
    perm = np.empty((len(state), rows), np.uint8)
    perm[:] = np.arange(rows, dtype=np.uint8)
    flat = perm.reshape(-1)
    act = np.arange(len(state))
    for j in range(rows):
        st = state[act] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64)
        frac = C.mix(st) >> np.uint64(8)
        pick = (C.mix(st + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(rows - j) >> np.uint64(32)
        a = act * rows + j
        b = a + pick.astype(np.int64)
        pos = flat[b]
        flat[b] = flat[a]
        flat[a] = pos
        np.minimum.at(view, local[act] * rows + pos, (np.uint64(j) << np.uint64(56)) | frac)
        open_ = view.reshape(sets, rows).max(1) >= (np.uint64(j + 1) << np.uint64(56))
        more = open_[local[act]]
        if not more.any():
            return
        act = act[more]


def shingle_sets(low: np.ndarray, off: np.ndarray):
    """Distinct shingles of each document: (hashes, document), ordered by both."""
    st, en, doc = C.words(low, off, C.SPACE_WORD)
    wh = C.word_hashes(low, st, en)
    g, at = C.grams(wh, doc, SHINGLE)
    owner = doc[at]
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):  # the whole sequence is the only shingle
        first = np.searchsorted(doc, few)
        extra = np.empty(len(few), np.uint64)
        with np.errstate(over="ignore"):
            p = C.powers(SHINGLE + 1)
            for i, (f, d) in enumerate(zip(first, few, strict=True)):
                k = int(count[d])
                extra[i] = C.mix((wh[f : f + k] * p[1 : k + 1]).sum(keepdims=True) + np.uint64(k))[0]
        g, owner = np.concatenate([g, extra]), np.concatenate([owner, few])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[new], owner[new]
    return g, owner


def _sketch(b: pa.RecordBatch):
    ids, names = b.column("id"), b.column("doc_id")
    raw, offsets = C.text_view(b.column("text"))
    for i, j in C.slices(offsets):
        off = offsets[i : j + 1] - offsets[i]
        low = C.LOWER[raw[offsets[i] : offsets[j]]]
        g, owner = shingle_sets(low, off)
        n = j - i
        size = np.bincount(owner, minlength=n).astype(np.int64)
        s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        keys = np.zeros((n, BANDS), np.int64)
        if len(g):
            has = np.flatnonzero(size)
            first = np.searchsorted(owner, has)
            with np.errstate(over="ignore"):
                s1[has] = np.add.reduceat(C.mix(g + np.uint64(0xA0761D6478BD642F)), first)
                s2[has] = np.add.reduceat(C.mix(g ^ np.uint64(0xE7037ED1A0B428DB)), first)
            rank = np.cumsum(size > 0) - 1
            sig = superminhash(g, rank[owner], len(has))
            keys[has] = (C.mix(sig) >> np.uint64(48)).astype("<u2").view("<i8")
        flat = pa.array(keys.reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(i, n), names.slice(i, n), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat),
            ],
            ["id", "doc_id", "n_shingles", "s1", "s2", "keys"],
        )


def _sets(b: pa.RecordBatch):
    ids, keys = b.column("id"), b.column("keys")
    raw, offsets = C.text_view(b.column("text"))
    for i, j in C.slices(offsets):
        off = offsets[i : j + 1] - offsets[i]
        g, owner = shingle_sets(C.LOWER[raw[offsets[i] : offsets[j]]], off)
        size = np.bincount(owner, minlength=j - i)
        data = g.astype("<u8").tobytes()
        ends = np.zeros(j - i + 1, np.int32)
        np.cumsum(size * 8, out=ends[1:])
        yield pa.RecordBatch.from_arrays(
            [ids.slice(i, j - i), keys.slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])],
            ["id", "keys", "grams"],
        )


def _agree(b: pa.RecordBatch):
    """Pairs whose signatures agree in enough rows."""
    x = np.asarray(b.column("ka").flatten()).reshape(-1, BANDS).view("<u2")
    y = np.asarray(b.column("kb").flatten()).reshape(-1, BANDS).view("<u2")
    ok = pa.array((x == y).sum(1) >= LEAST_AGREE)
    yield b.select(["a", "b"]).filter(ok)


def _confirm(b: pa.RecordBatch):
    """Pairs at or above the threshold on full sets."""
    ok = np.zeros(b.num_rows, bool)
    ga, gb = b.column("ga"), b.column("gb")
    for i in range(b.num_rows):
        x, y = np.frombuffer(ga[i].as_buffer(), "<u8"), np.frombuffer(gb[i].as_buffer(), "<u8")
        if 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
            both = len(x) + len(y) - len(np.union1d(x, y))
            ok[i] = 100 * both >= 75 * (len(x) + len(y) - both)
    yield b.select(["a", "b"]).filter(pa.array(ok))


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of side 0 meet rows of side 1; a block of one side alone meets itself."""
    side = np.asarray(t.column("side").combine_chunks())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left if len(left) else right), (right if len(right) else left)


def _promising(t: pa.Table) -> pa.Table:
    """Rows of a block that agree in enough of the signature with a row of another component."""
    comp = np.asarray(t.column("comp").combine_chunks())
    sig = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(-1, BANDS).view("<u2")
    left, right = _sides(t)
    keep = np.zeros(t.num_rows, bool)
    for i in left:
        hit = right[((sig[right] == sig[i]).sum(1) >= LEAST_AGREE) & (comp[right] != comp[i])]
        if len(hit):
            keep[i] = True
            keep[hit] = True
    return t.select(["g1", "g2", "x", "y", "id", "comp", "side"]).filter(pa.array(keep))


def _joining(t: pa.Table) -> pa.Table:
    """Links of a block across components, as many as join its components.

    Intersections are products of 0/1 rows over the shingles that several rows
    have, in slices of columns.
    """
    ids = np.asarray(t.column("id").combine_chunks())
    comp = np.asarray(t.column("comp").combine_chunks())
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("grams").combine_chunks()]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    on = shared[col]
    row, col = row[on], number[col[on]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = _sides(t)
    both = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [s, s + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[i:j], col[i:j] - s] = 1
        both += part[left] @ part[right].T
    both = both.astype(np.int64)
    hit = (100 * both >= 75 * (size[left][:, None] + size[right][None] - both)) & (comp[left][:, None] != comp[right][None])
    parent = {c: c for c in comp.tolist()}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    for i, j in zip(*np.nonzero(hit), strict=True):
        u, v = find(int(comp[left[i]])), find(int(comp[right[j]]))
        if u != v:
            parent[u] = v
            a.append(int(min(ids[left[i]], ids[right[j]])))
            b.append(int(max(ids[left[i]], ids[right[j]])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Texts without words have n_shingles 0 and are linked with nothing; null
    text counts as empty.  Every row is judged by its own text: repeated rows
    give repeated result rows, and rows whose doc_id is null get a null
    component and are not linked (``deduplicated`` links them, and keeps one row
    of repeated ones).  Extra columns are ignored.  Ties don't occur: ids decide.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    gone: list[str] = []
    src = _with_key(docs.select("doc_id", "text"), "id", gone)
    out = _groups(src, gone, "doc_id is not null")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("component_id"))
    out = C.cut(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    C.drop(spark, gone)
    return out


def _with_key(docs: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """``docs`` written down with a unique number for each row."""
    return C.cut(docs.withColumn(name, F.monotonically_increasing_id()), into)


def _groups(src: DataFrame, gone: list[str], linked: str) -> DataFrame:
    """id, doc_id, n_shingles, first: one row per row of ``src`` (id, doc_id, text).

    first: doc_id and id of the first row of the row's group, by doc_id (nulls
    last), then id; null for texts without words.  Rows that aren't ``linked``
    make no groups.
    """
    sketch = C.cut(C.arrow_map(src.select("id", "doc_id", "text"), _sketch, "id long, doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), gone)
    full = sketch.where("n_shingles > 0").where(linked)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")).alias("first")
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), least)
    reps = C.cut(full.join(classes.select("id"), "id", "left_semi").select("id", "keys"), gone)

    bands = reps.select("id", F.posexplode("keys").alias("band", "key"))
    heads = bands.groupBy("band", "key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n")).where("lead < last")
    members = C.cut(bands.join(heads, ["band", "key"]), gone)

    wanted = members.select("id").distinct().join(reps, "id")
    sets = C.cut(
        C.arrow_map(src.select("id", "text").join(wanted, "id"), _sets, "id long, keys array<long>, grams binary"), gone
    )

    first = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).union(
        members.where("id <> last").select(F.col("id").alias("a"), F.col("last").alias("b"))
    ).distinct()
    links = C.cut(_verify(first, sets), gone)
    found = connected_components(links, "a", "b", gone)
    state = C.cut(wanted.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), gone)
    for k in range(ROUNDS):
        state, more = _merged(state, C.cut(_verify(_picked_pairs(members, state, k), sets), gone), gone)
        if not more:
            break
    state, _ = _merged(state, C.cut(_block_links(members, state, sets, gone), gone), gone)
    final = state.select("id", F.col("comp").alias("component"))
    member = classes.join(final, "id", "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), F.coalesce("component", "id").alias("comp"), "first"
    )
    member = member.drop("first").join(member.groupBy("comp").agg(F.min("first").alias("first")), "comp")
    s = sketch.drop("keys")
    out = s.join(member, (s.s1 == member.c1) & (s.s2 == member.c2) & (s.n_shingles == member.cn) & (s.n_shingles > 0), "left")
    return out.select("id", "doc_id", "n_shingles", "first")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near duplicates."""
    k, g = sets.select("id", "keys"), sets.select("id", "grams")
    near = pairs.join(k.select(F.col("id").alias("a"), F.col("keys").alias("ka")), "a").join(k.select(F.col("id").alias("b"), F.col("keys").alias("kb")), "b")
    near = C.arrow_map(near.select("a", "b", "ka", "kb"), _agree, "a long, b long")
    full = near.join(g.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return C.arrow_map(full.select("a", "b", "ga", "gb"), _confirm, "a long, b long")


def _merged(state: DataFrame, links: DataFrame, gone: list[str]) -> tuple[DataFrame, bool]:
    """Components after more links, and whether there were any.  Only components that meet are joined anew."""
    if links.isEmpty():
        return state, False
    ends = links.join(state.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(state.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    renamed = connected_components(ends.select("ca", "cb").distinct(), "ca", "cb", gone)
    out = state.join(renamed.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"))
    return C.cut(out, gone), True


def _picked_pairs(members: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Members with a member of their bucket, picked by hash, that lies in another component."""
    m = members.select("band", "key", "id").join(state, "id")
    pick = F.min(F.struct(F.xxhash64("id", "band", F.lit(k)), "id", "comp")).alias("p")
    heads = m.groupBy("band", "key").agg(pick, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    j = m.join(heads.select("band", "key", F.col("p.id").alias("lead"), F.col("p.comp").alias("main")), ["band", "key"]).where("comp <> main")
    return j.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _block_links(members: DataFrame, state: DataFrame, sets: DataFrame, gone: list[str]) -> DataFrame:
    """Links across components in buckets that hold several, enough to join what they join."""
    m = members.select("band", "key", "id").join(state, "id")
    by = m.groupBy("band", "key", "comp").agg(F.count("*").alias("n")).groupBy("band", "key")
    by = by.agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1")
    outs = C.cut(m.join(by, ["band", "key"]).where("comp <> main").select("band", "key", "id", "comp", "main", "comps"), gone)
    split = lambda n, b: F.pmod(F.xxhash64("id"), F.col(b)).alias(n)
    to_all = lambda b, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(b) - 1)).alias(n)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)

    others = outs.select("main", "id", "comp").distinct()
    hub = state.join(others.select(F.col("main").alias("comp")).distinct(), "comp", "left_semi").select(F.col("comp").alias("main"), "id")
    size = hub.groupBy("main").agg(F.count("*").alias("n")).join(others.groupBy("main").agg(F.count("*").alias("o")), "main")
    size = size.select("main", blocks("n").alias("bx"), blocks("o").alias("by"))
    of_hub = lambda df, side, x, y: df.join(size, "main").select(
        F.col("main").alias("g1"), F.lit(-1).cast("long").alias("g2"), x, y, "id", "comp", F.lit(side).alias("side")
    )
    rows = of_hub(hub.withColumn("comp", F.col("main")), 0, split("x", "bx"), to_all("by", "y"))
    rows = rows.unionByName(of_hub(others, 1, to_all("bx", "x"), split("y", "by")))

    many = outs.where("comps > 2")
    size = many.groupBy("band", "key").agg(blocks_of(F.count("*")).alias("b"))
    pair = many.join(size, ["band", "key"]).select("band", "key", "id", "comp", split("p", "b"), to_all("b", "q"))
    rows = rows.unionByName(pair.select(
        F.col("band").cast("long").alias("g1"), F.col("key").alias("g2"), (-1 - F.least("p", "q")).alias("x"), F.greatest("p", "q").alias("y"), "id", "comp",
        F.when(F.col("p") < F.col("q"), 0).otherwise(1).alias("side"),
    ))
    keyed = "g1 long, g2 long, x long, y long, id long, comp long, side int"
    near = rows.join(sets.select("id", "keys"), "id").groupBy("g1", "g2", "x", "y").applyInArrow(_promising, keyed)
    near = C.cut(near, gone).join(sets.select("id", "grams"), "id")
    return near.groupBy("g1", "g2", "x", "y").applyInArrow(_joining, "a long, b long").distinct()


def blocks_of(n):
    return F.ceil(n / BLOCK)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their group keeps: one row of each group, the first by doc_id.

    Rows without a doc_id take part, after all others.  Texts without words stay.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    gone: list[str] = []
    rows = _with_key(docs, "_row_key")
    found = _groups(rows.select(F.col("_row_key").alias("id"), "doc_id", "text"), gone, "true")
    kept = C.cut(found.where("first is null or first.id = id").select(F.col("id").alias("_row_key")))
    C.drop(spark, gone)
    return rows.join(kept, "_row_key", "left_semi").select(*docs.columns)
