"""License scans by diagonal voting.

Templates are license phrases and notices.  All rolling word k-gram hashes of a
text are joined to the templates' positions; each match votes for the diagonal
(word position minus template position) on which it lies.  Votes are counted by
document, template and diagonal; neighbouring diagonals (a few words inserted or
missing) are merged, and a merged group is verified by the share of the
template's k-grams that it holds.

Texts' k-grams that no template has are dropped where they are made (a semi-join
with the template hashes, which are few and fixed), so only votes move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

# Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Wording of license notices, by label.
NOTICES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

#: Diagonals at most so far apart are merged.
NEIGHBOUR = 3
#: Share of a notice's k-grams that verifies a span.
LEAST_SHARE = 0.75
PHRASE_GRAM, NOTICE_GRAM = 2, 4


def templates() -> list[tuple[int, str, str, int, bool]]:
    """(number, label, words, k, whether it is a base phrase)."""
    base = [(label, words, PHRASE_GRAM, True) for words, label in PHRASES.items()]
    more = [(label, words, NOTICE_GRAM, False) for label, texts in NOTICES.items() for words in texts]
    return [(i, *t) for i, t in enumerate(base + more)]


def _grams(low: np.ndarray, off: np.ndarray, k: int):
    st, en, doc = C.words(low, off, C.ALNUM_WORD)
    h = C.word_hashes(low, st, en)
    g, at = C.grams(h, doc, k)
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    return g, doc[at], at - first[doc[at]], np.bincount(doc, minlength=len(off) - 1)


def template_positions() -> list[tuple[int, int, int, int]]:
    """(hash, k, template, position) of every k-gram of every template."""
    out = []
    for i, _, text, k, _ in templates():
        raw = np.frombuffer(text.encode(), np.uint8)
        g, _, pos, _ = _grams(raw, np.array([0, len(raw)]), k)
        out += [(int(h), k, i, int(p)) for h, p in zip(g.view(np.int64), pos, strict=True)]
    return out


def _votes(known: dict[int, np.ndarray]):
    """Rows (rid, doc_id, n_words, k, h, pos): every k-gram that some template has; and one row per document."""

    def kernel(b: pa.RecordBatch):
        raw, offsets = C.text_view(b.column("text"))
        rid, ids = b.column("rid"), b.column("doc_id")
        for i, j in C.slices(offsets):
            low, off = C.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            st, en, doc = C.words(low, off, C.ALNUM_WORD)
            words = C.word_hashes(low, st, en)
            first = np.searchsorted(doc, np.arange(j - i))
            rows = [(np.arange(j - i), np.zeros(j - i, np.int64), np.zeros(j - i, np.uint64), np.full(j - i, -1))]
            for k, table in known.items():
                g, at = C.grams(words, doc, k)
                slot = np.minimum(np.searchsorted(table, g), len(table) - 1)
                hit = np.flatnonzero(table[slot] == g)
                rows.append((doc[at[hit]], np.full(len(hit), k), g[hit], at[hit] - first[doc[at[hit]]]))
            d, k, h, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
            n = np.bincount(doc, minlength=j - i)
            take = pa.array(i + d)
            yield pa.RecordBatch.from_arrays(
                [rid.take(take), ids.take(take), pa.array(n[d]), pa.array(k.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int64))],
                ["rid", "doc_id", "n_words", "k", "h", "pos"],
            )

    return kernel


def license_spans(votes: DataFrame) -> DataFrame:
    """Verified spans (rid, doc_id, template, label, base, first, last, share) from joined votes."""
    spark = votes.sparkSession
    pos = template_positions()
    where = spark.createDataFrame(pos, "h long, k int, template int, tpos int")
    size = {t: sum(1 for p in pos if p[2] == t) for t in {p[2] for p in pos}}
    info = spark.createDataFrame(
        [(i, label, len(text.split()), size[i], base) for i, label, text, _, base in templates()], "template int, label string, words int, grams int, base boolean"
    )
    on = votes.where("k > 0").join(F.broadcast(where), ["h", "k"])  # the fixed templates' positions
    diag = (
        on.withColumn("diag", F.col("pos") - F.col("tpos")).groupBy("rid", "doc_id", "template", "diag")
        .agg(F.collect_set("tpos").alias("hit"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        .join(F.broadcast(info), "template")
    )
    exact = diag.where("base and size(hit) = grams").select(
        "rid", "doc_id", "template", "label", "base", F.col("diag").alias("first"), (F.col("diag") + F.col("words") - 1).alias("last"), F.lit(1.0).alias("share")
    )
    # diagonals that lie close together vote as one
    w = Window.partitionBy("rid", "template").orderBy("diag")
    step = F.col("diag") - F.lag("diag").over(w) > NEIGHBOUR
    merged = (
        diag.where("not base").withColumn("run", F.sum(F.coalesce(step.cast("int"), F.lit(0))).over(w))
        .groupBy("rid", "doc_id", "template", "label", "base", "run")
        .agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min("lo").alias("first"), F.max("hi").alias("hi"), F.first("grams").alias("grams"))
        .withColumn("share", F.size("hit") / F.col("grams")).where(F.col("share") >= LEAST_SHARE)
        .select("rid", "doc_id", "template", "label", "base", "first", (F.col("hi") + NOTICE_GRAM - 1).alias("last"), "share")
    )
    return exact.unionByName(merged)


def votes(docs: DataFrame) -> DataFrame:
    """Template k-grams of every text, with one row (k = 0) for each document."""
    spark = docs.sparkSession
    C.prepare(spark)
    known: dict[int, list[int]] = {}
    for h, k, _, _ in template_positions():
        known.setdefault(k, []).append(h & (2**64 - 1))
    tables = {k: np.unique(np.array(v, np.uint64)) for k, v in known.items()}
    src = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    return C.cut(C.arrow_map(src, _votes(tables), "rid long, doc_id long, n_words long, k int, h long, pos long"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``.

    Null text has no words; labels are then empty strings and the score 0.  The
    score is the largest verified share of a template (1 for a base phrase).
    Repeated rows are scanned each by itself; extra columns are ignored.
    """
    v = votes(docs)
    base = F.col("base")
    label = F.when(base, F.col("label"))
    found = license_spans(v).groupBy("rid").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    all_ = v.where("k = 0").select("rid", "doc_id", "n_words").join(found, "rid", "left")
    none = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return all_.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), none("base_labels", ""), none("labels", ""), none("score", 0.0),
    )
