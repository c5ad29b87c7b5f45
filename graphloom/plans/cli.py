"""Command line drivers: ``python -m graphloom.plans.cli COMMAND --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import factor as FM
from ..operators import linear as LR
from ..operators import ranktree as RT
from ..operators import topics as T
from ..sources import persist, readers
from .session import ship


def _held(samples: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(training, test) samples by a hash of the sample."""
    u = F.pmod(F.xxhash64("sample"), F.lit(1 << 20)) / float(1 << 20)
    return samples.where(u >= share), samples.where(u < share)


def topics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw corpus lines -> term-topic counts; prints the metric after each sweep."""
    bags = readers.parse_bags(spark.read.text(a.input), not a.generate_ids)
    if a.sample < 1:
        bags = bags.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < a.sample * (1 << 20))
    c = T.Config(a.topics, a.alpha, a.beta, a.alpha_as, a.algorithm, a.blocks, a.seed, a.init)

    def watch(i: int, t: DataFrame) -> None:
        if a.metric and i % a.every == 0:
            print(i, T.METRICS[a.metric](t, c).first().asDict())

    prior = persist.load_topics(spark, a.model)[0] if a.model else None
    out = T.train(T.tokens_from_bags(bags), c, a.iterations, prior, watch)
    persist.save_topics(spark, a.output, T.term_counts(out), a.topics, a.transpose, a.single)


def logistic(spark: SparkSession, a: argparse.Namespace) -> None:
    """libsvm -> weights; prints the held-out area under the curve."""
    rows = readers.libsvm_long(spark, a.input).persist()
    y = rows.select("sample", "label").distinct()
    x = rows.where("feature is not null and value <> 0").select("sample", "feature", "value")
    train, test = _held(y, a.test)
    w = LR.train(x.join(train, "sample", "left_semi"), train, LR.Config(a.iterations, a.step, a.l1, a.adagrad), mis=a.mis)
    persist.save_linear(spark, a.output, w)
    print(metrics.auc(test.join(LR.predict(x, test, w), "sample")).first().asDict())


def factors(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ratings -> factorization machine of one-hot user, movie and day; prints the held-out error."""
    x, y, views = readers.rating_features(readers.parse_ratings(spark.read.text(a.input)))
    x, train, test = x.persist(), y.where("not test").drop("test"), y.where("test").drop("test")
    mean = train.agg(F.avg("label")).first()[0] or 0.0
    centred = train.select("sample", (F.col("label") - mean).alias("label"))
    c = FM.Config(a.rank, a.iterations, a.step, (0.0, a.reg, a.reg), a.adagrad, False, a.fraction, reg=a.reg)
    m = FM.train(x.join(train, "sample", "left_semi"), centred, a.kind, c, views)
    persist.save_factor_model(spark, a.output, m)
    got = test.join(FM.predict(x, test, m), "sample").select("label", (F.col("score") + mean).alias("score"))
    print(metrics.rmse(got).first().asDict())


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parquet samples (query, doc, label) and features (query, doc, feature, bin) -> trees as text."""
    s, f = spark.read.parquet(a.samples), spark.read.parquet(a.features)
    c = RT.Config(a.trees, a.leaves, a.depth, a.rate, gains=tuple(map(float, a.gains.split(":"))))
    trees, scored = RT.boost(s, f, c)
    persist.write_lines(spark.createDataFrame([(RT.tree_text(trees, a.rate),)], "value string"), a.output)
    print(RT.ndcg_error(scored, c.gains).first().asDict())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(required=True)

    def add(run, *options):
        q = sub.add_parser(run.__name__, help=run.__doc__)
        q.set_defaults(run=run)
        for name, default in options:
            if isinstance(default, bool):
                q.add_argument(f"--{name}", action="store_true")
            elif default is None:
                q.add_argument(f"--{name}", required=name in ("input", "output", "samples", "features"))
            else:
                q.add_argument(f"--{name}", type=type(default), default=default)

    add(topics, ("input", None), ("output", None), ("topics", 10), ("iterations", 10), ("alpha", 0.1), ("beta", 0.01), ("alpha_as", 0.1), ("algorithm", "sparse"), ("blocks", 64), ("seed", 1), ("init", "random"), ("metric", "pplx"), ("every", 1), ("sample", 1.0), ("model", None), ("generate_ids", False), ("transpose", False), ("single", False))
    add(logistic, ("input", None), ("output", None), ("iterations", 10), ("step", 0.1), ("l1", 0.0), ("adagrad", False), ("mis", False), ("test", 0.2))
    add(factors, ("input", None), ("output", None), ("kind", "fm"), ("rank", 20), ("iterations", 40), ("step", 0.1), ("reg", 0.0), ("fraction", 1.0), ("adagrad", False))
    add(rank, ("samples", None), ("features", None), ("output", None), ("trees", 10), ("leaves", 8), ("depth", 8), ("rate", 0.1), ("gains", "0:1:3:7:15"))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
