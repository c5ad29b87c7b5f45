"""Saving and loading models: JSON metadata beside Parquet or text data."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factor as FM
from ..operators.neural import RBM, Layer, Network

VERSION = "1.0"


def save_metadata(spark: SparkSession, path: str, kind: str, **meta) -> None:
    text = json.dumps({"class": kind, "version": VERSION, **meta}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str, kind: str) -> dict:
    """The metadata; an error if the class or version is another."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    if (meta["class"], meta["version"]) != (kind, VERSION):
        raise ValueError(f"{path} holds {meta['class']} {meta['version']}, not {kind} {VERSION}")
    return meta


def check_schema(df: DataFrame, ddl: str) -> DataFrame:
    """df, if it has the columns of ``ddl`` with their types; else an error."""
    from pyspark.sql.types import StructType

    for f in StructType.fromDDL(ddl).fields:
        if f.name not in df.columns or df.schema[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} is missing")
    return df


_FACTORS = "feature long, w double, v array<double>, degree long"


def save_factor_model(spark: SparkSession, path: str, m: FM.Model) -> None:
    save_metadata(spark, path, m.kind, rank=m.rank, bias=m.bias, views=list(m.views), classify=m.classify)
    m.params.write.mode("overwrite").parquet(f"{path}/data")


def load_factor_model(spark: SparkSession, path: str, kind: str) -> FM.Model:
    meta = load_metadata(spark, path, kind)
    data = check_schema(spark.read.parquet(f"{path}/data"), _FACTORS)
    return FM.Model(kind, meta["rank"], meta["bias"], data, tuple(meta["views"]), meta["classify"])


def save_linear(spark: SparkSession, path: str, w: DataFrame) -> None:
    """Weights with intercept 0."""
    save_metadata(spark, path, "logistic", intercept=0.0)
    w.write.mode("overwrite").parquet(f"{path}/data")


def load_linear(spark: SparkSession, path: str) -> DataFrame:
    load_metadata(spark, path, "logistic")
    return check_schema(spark.read.parquet(f"{path}/data"), "feature long, w double")


def topic_lines(model: DataFrame, transpose: bool = False) -> DataFrame:
    """``id<tab>k:count …`` in descending count (ties: lowest key), by term or, transposed, by topic."""
    key, other = ("topic", "term") if transpose else ("term", "topic")
    g = model.where("nw > 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("nw")).alias("n"), F.col(other).alias("k")))).alias("x"))
    cells = F.transform("x", lambda s: F.concat_ws(":", s["k"].cast("string"), (-s["n"]).cast("string")))
    return g.select(F.concat_ws("\t", F.col(key).cast("string"), F.array_join(cells, " ")).alias("value"))


def save_topics(spark: SparkSession, path: str, model: DataFrame, topics: int, transpose: bool = False, single: bool = False, **meta) -> None:
    """Term-topic counts as text lines; ``single`` merges them into one file."""
    save_metadata(spark, path, "topics", topics=topics, transpose=transpose, **meta)
    lines = topic_lines(model, transpose)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(f"{path}/data")


def parse_topic_lines(lines: DataFrame, transpose: bool = False) -> DataFrame:
    p = F.split("value", "\t")
    rows = lines.select(p[0].alias("a"), F.explode(F.split(p[1], " ")).alias("x"))
    y = F.split("x", ":")
    term, topic = (y[0], F.col("a")) if transpose else (F.col("a"), y[0])
    return rows.select(term.cast("int").alias("term"), topic.cast("int").alias("topic"), y[1].cast("long").alias("nw"))


def load_topics(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = load_metadata(spark, path, "topics")
    return parse_topic_lines(spark.read.text(f"{path}/data"), meta["transpose"]), meta


def save_local_topics(path: str, counts: dict[int, dict[int, int]]) -> None:
    """A model that fits the driver, as a local text file."""
    with open(path, "w") as f:
        for term in sorted(counts):
            f.write(f"{term}\t" + " ".join(f"{k}:{n}" for k, n in sorted(counts[term].items(), key=lambda x: (-x[1], x[0]))) + "\n")


def load_local_topics(path: str) -> dict[int, dict[int, int]]:
    out = {}
    with open(path) as f:
        for line in f:
            term, _, cells = line.rstrip("\n").partition("\t")
            out[int(term)] = {int(k): int(n) for k, _, n in (c.partition(":") for c in cells.split())}
    return out


def save_network(spark: SparkSession, path: str, net: Network) -> None:
    save_metadata(spark, path, "network", sizes=[[*l.weight.shape] for l in net.layers], kinds=[l.kind for l in net.layers], dropout=net.dropout)
    spark.createDataFrame([(net.flat().tolist(),)], "w array<double>").write.mode("overwrite").parquet(f"{path}/data")


def load_network(spark: SparkSession, path: str) -> Network:
    meta = load_metadata(spark, path, "network")
    w = np.array(spark.read.parquet(f"{path}/data").first().w)
    empty = [Layer(np.zeros((o, i)), np.zeros(o), k) for (o, i), k in zip(meta["sizes"], meta["kinds"], strict=True)]
    return Network(empty, meta["dropout"]).with_flat(w)


def save_rbm(spark: SparkSession, path: str, m: RBM) -> None:
    save_metadata(spark, path, "rbm", hidden=len(m.hidden), visible=len(m.visible), kinds=[m.visible_kind, m.hidden_kind])
    spark.createDataFrame([(m.flat().tolist(),)], "w array<double>").write.mode("overwrite").parquet(f"{path}/data")


def load_rbm(spark: SparkSession, path: str) -> RBM:
    meta = load_metadata(spark, path, "rbm")
    v, h = meta["visible"], meta["hidden"]
    return RBM(np.zeros((h, v)), np.zeros(v), np.zeros(h), *meta["kinds"]).with_flat(np.array(spark.read.parquet(f"{path}/data").first().w))


def write_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """One text file of ``value``, after an optional header."""
    if header is not None:
        head = df.sparkSession.createDataFrame([(0, header)], "_o int, value string")
        df = head.unionByName(df.select(F.lit(1).alias("_o"), "value")).coalesce(1).sortWithinPartitions("_o").select("value")
    df.coalesce(1).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return lines if header is None else lines.where(F.col("value") != header)
