"""Readers of text inputs, as DataFrames of parsed lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.partition import wrapped_product


def parse_edges(lines: DataFrame, canonical: bool = False) -> DataFrame:
    """(src, dst, attr = 1) from white-space pairs in ``value``; '#' starts a comment; one field is an error."""
    v = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    p = F.split(F.trim("value"), r"\s+")
    ok = v.select(F.when(F.size(p) >= 2, p).otherwise(F.raise_error(F.concat(F.lit("no edge in line: "), F.col("value"))).cast("array<string>")).alias("p"))
    e = ok.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))
    if canonical:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.withColumn("attr", F.lit(1))


def edge_list_file(spark: SparkSession, path: str, canonical: bool = False) -> Graph:
    return Graph.from_edges(parse_edges(spark.read.text(path), canonical), 1)


def parse_bags(lines: DataFrame, own_ids: bool = True) -> DataFrame:
    """(doc, term, cnt) from lines ``doc term[:cnt] …``; a missing count is 1; repeated terms add up.

    Without ``own_ids`` lines hold terms only and get ids by partition and place.
    """
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.length(F.trim("value")) > 0)
    if own_ids:
        rows = rows.select(p[0].cast("long").alias("doc"), F.explode(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).alias("x"))
    else:
        rows = rows.select(F.monotonically_increasing_id().alias("doc"), F.explode(p).alias("x"))
    y = F.split("x", ":")
    return rows.select("doc", y[0].cast("int").alias("term"), F.coalesce(F.get(y, F.lit(1)).cast("int"), F.lit(1)).alias("cnt")).groupBy("doc", "term").agg(F.sum("cnt").alias("cnt"))


def bag_of_words(docs: DataFrame) -> DataFrame:
    """(doc, term, cnt) of lower-cased words of (doc_id, text); ``term`` is the word."""
    w = docs.select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("term"))
    return w.groupBy("doc", "term").agg(F.count("*").alias("cnt"))


def libsvm_long(spark: SparkSession, path: str) -> DataFrame:
    """(sample, label, feature, value) of a libsvm file; features from 0; rows without features keep one with nulls."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("sample"), F.split(F.trim("value"), r"\s+").alias("p"))
    rows = lines.select("sample", F.col("p")[0].cast("double").alias("label"), F.explode_outer(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("x"))
    y = F.split("x", ":")
    return rows.select("sample", "label", (y[0].cast("long") - 1).alias("feature"), y[1].cast("double").alias("value"))


def parse_ratings(lines: DataFrame) -> DataFrame:
    """(user, movie, rating, ts) from ``user,movie,rating,timestamp`` or the same parted by '::'."""
    p = F.split("value", "::|,")
    return lines.where(F.length("value") > 0).select(p[0].cast("long").alias("user"), p[1].cast("long").alias("movie"), p[2].cast("double").alias("rating"), p[3].cast("long").alias("ts"))


def rating_features(ratings: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """One-hot user, movie and day: (sample, feature, value), (sample, label, test), and the views' bounds.

    A sample is a rating, numbered by hash of its fields (equal rows are one
    sample); a fifth of them, by their time, is the test part.
    """
    u, m, lo, hi = ratings.agg(F.max("user"), F.max("movie"), F.min("ts"), F.max("ts")).first()
    day0, users, movies = lo // 86400, u + 1, m + 1
    views = (users, users + movies, users + movies + hi // 86400 - day0 + 1)
    day = (F.floor(F.col("ts") / 86400) - day0).cast("long")
    r = ratings.dropDuplicates().withColumn("sample", F.xxhash64("user", "movie", "rating", "ts"))
    f = F.explode(F.array(F.col("user"), F.col("movie") + users, day + views[1])).alias("feature")
    x = r.select("sample", f, F.lit(1.0).alias("value"))
    test = F.pmod(wrapped_product(F.col("ts")), F.lit(5).cast("decimal(20,0)")) == 0
    return x, r.select("sample", F.col("rating").alias("label"), test.alias("test")), views


def implicit_features(ratings: DataFrame, users: int, movies: int) -> DataFrame:
    """(user, feature, value): each user's rated movies, of value 1 / sqrt(how many), numbered after users and movies."""
    seen = ratings.select("user", "movie").distinct()
    n = seen.groupBy("user").agg(F.count("*").alias("n"))
    return seen.join(n, "user").select("user", (F.col("movie") + users + movies).alias("feature"), (F.lit(1.0) / F.sqrt("n")).alias("value"))


def parse_prize(files: DataFrame) -> DataFrame:
    """(movie, user, rating, day) from whole files: ``movie:`` headers, then ``user,rating,yyyy-MM-dd`` (or ``user``)."""
    blocks = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+:[^:]*(?=\n\d+:|$))"))).alias("b"))
    lines = blocks.select(F.split_part("b", F.lit(":"), F.lit(1)).cast("long").alias("movie"), F.explode(F.split(F.split_part("b", F.lit(":"), F.lit(2)), "\n")).alias("l")).where("length(trim(l)) > 0")
    p = F.split(F.trim("l"), ",")
    return lines.select("movie", p[0].cast("long").alias("user"), F.get(p, F.lit(1)).cast("double").alias("rating"), F.datediff(F.to_date(F.get(p, F.lit(2))), F.lit("1970-01-01")).alias("day"))


def probe_split(ratings: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, test): test is what ``probe`` (movie, user) names."""
    ids = probe.select("movie", "user").distinct()
    return ratings.join(ids, ["movie", "user"], "left_anti"), ratings.join(ids, ["movie", "user"], "left_semi")


def parse_ranking_features(lines: DataFrame) -> DataFrame:
    """(feature, sample, bin) from ``feature#bin,bin,…[#threshold,…]``; bins of 0 are implicit.

    A line has a bin for each sample: it is read in pieces, and never becomes an array of all its bins.
    """

    def run(batches):
        for batch in batches:
            for line in batch.column(0):
                yield from _line_bins(line.as_py())

    one = lines.where(F.length("value") > 0).select("value")
    return one.mapInArrow(run, "feature int, sample long, bin short")


def _line_bins(line: str, piece: int = 1 << 18):
    """Arrow batches of the bins other than 0 of one line."""
    head = line.index("#")
    feature, at, sample = int(line[:head]), head + 1, 0
    end = line.find("#", at)
    end = len(line) if end < 0 else end
    while at <= end:
        cut = end if at + piece >= end else line.find(",", at + piece, end)
        cut = end if cut < 0 else cut
        b = np.array(line[at:cut].split(","), dtype=np.int16)
        i = np.flatnonzero(b)
        yield pa.record_batch([np.full(len(i), feature, np.int32), i + sample, b[i]], ["feature", "sample", "bin"])
        at, sample = cut + 1, sample + len(b)


def parse_thresholds(lines: DataFrame) -> DataFrame:
    """(feature, bin, threshold) of lines that have thresholds."""
    p = F.split("value", "#")
    rows = lines.where(F.size(p) > 2).select(p[0].cast("int").alias("feature"), F.posexplode(F.split(p[2], ",")).alias("bin", "t"))
    return rows.select("feature", F.col("bin").cast("short").alias("bin"), F.col("t").cast("double").alias("threshold"))


def parse_list(lines: DataFrame, kind: str, name: str) -> DataFrame:
    """(sample, name) of one comma-separated line."""
    return lines.select(F.posexplode(F.split("value", ",")).alias("sample", "x")).select(F.col("sample").cast("long").alias("sample"), F.col("x").cast(kind).alias(name))


def sample_rows(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return rows.sample(False, fraction, seed)
