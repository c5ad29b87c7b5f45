"""Logistic regression, factorization machines and metrics on line items.

A sample is a line item; its features are three numbers and one-hot supplier
and part (three views).  Labels: returned or not, and ten times the discount.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.exprs import dot, log1p_exp, sigmoid
from ..operators import factor as FM
from ..operators import linear as LR
from .lineage import table as table_of
from .registry import query, table

VIEWS = (10, 10_000, 10_000_000)
RANK = 2
X_SQL = """x AS (SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS sample, unnest([0, 1, 2, 10 + l_suppkey, 10000 + l_partkey])::BIGINT AS feature,
  unnest([l_quantity / 50, l_discount * 10, l_tax * 10, 1.0::DOUBLE, 1.0::DOUBLE]) AS value FROM lineitem) WHERE value <> 0)"""
Y_SQL = "y AS (SELECT l_orderkey * 8 + l_linenumber AS sample, max(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS label, max(l_discount * 10) AS target FROM lineitem GROUP BY 1)"
W0_SQL = "w0 AS (SELECT DISTINCT feature, ((feature % 7) - 3) * 0.01::DOUBLE AS w FROM x)"
P0_SQL = "p0 AS (SELECT feature, ((feature % 7) - 3) * 0.01::DOUBLE AS w, ((feature % 5) - 2) * 0.05::DOUBLE AS v0, ((feature % 6) - 2) * 0.05::DOUBLE AS v1, count(*) AS degree FROM x GROUP BY feature)"


def x(spark, d: str) -> DataFrame:
    one = F.lit(1.0)
    cells = [(F.lit(0).cast("long"), F.col("l_quantity") / 50), (F.lit(1).cast("long"), F.col("l_discount") * 10), (F.lit(2).cast("long"), F.col("l_tax") * 10), (F.col("l_suppkey") + 10, one), (F.col("l_partkey") + 10000, one)]
    e = F.explode(F.array(*(F.struct(f.alias("feature"), v.alias("value")) for f, v in cells))).alias("e")
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample"), e)
    return t.select("sample", "e.feature", "e.value").where("value <> 0")


def y(spark, d: str, target: bool = False) -> DataFrame:
    label = F.max(F.col("l_discount") * 10) if target else F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample")).agg(label.alias("label"))


def w0(xs: DataFrame) -> DataFrame:
    return xs.select("feature").distinct().withColumn("w", ((F.col("feature") % 7) - 3) * 0.01)


def p0(xs: DataFrame) -> DataFrame:
    v = F.array(((F.col("feature") % 5) - 2) * 0.05, ((F.col("feature") % 6) - 2) * 0.05)
    return xs.groupBy("feature").agg(F.count("*").alias("degree")).select("feature", (((F.col("feature") % 7) - 3) * 0.01).alias("w"), v.alias("v"), "degree")


def r(c, n: int = 8):
    return F.round(c, n) + F.lit(0.0)


_SIG = "(1 / (1 + exp(-({})))) "
_Z = "z{i} AS (SELECT y.sample, y.label, coalesce(m.z, 0) AS z FROM y LEFT JOIN (SELECT sample, sum(w * value) AS z FROM x JOIN w{i} USING (feature) GROUP BY 1) m USING (sample))"
_LOSS = "avg(CASE WHEN label > 0 THEN (CASE WHEN -z > 0 THEN -z + ln(1 + exp(z)) ELSE ln(1 + exp(-z)) END) ELSE (CASE WHEN z > 0 THEN z + ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END) END)"


def lr_sql(steps: int, c: LR.Config, mis: bool = False) -> str:
    out = [X_SQL, Y_SQL, W0_SQL]
    for i in range(1, steps + 1):
        out.append(_Z.format(i=i - 1))
        if mis:
            q = _SIG.format("CASE WHEN label > 0 THEN -z ELSE z END")
            out.append(f"q{i} AS (SELECT sample, label, {q} AS q FROM z{i - 1})")
            out.append(
                f"g{i} AS (SELECT feature, -ln((sum(CASE WHEN label > 0 THEN q * value ELSE 0 END) + {c.epsilon}::DOUBLE) / (sum(CASE WHEN label <= 0 THEN q * value ELSE 0 END) + {c.epsilon}::DOUBLE)) AS g FROM x JOIN q{i} USING (sample) GROUP BY 1)"
            )
        else:
            out.append(f"g{i} AS (SELECT feature, sum(value * ({_SIG.format('z')} - label)) / (SELECT count(*) FROM y) AS g FROM x JOIN z{i - 1} USING (sample) GROUP BY 1)")
        g = f"g{i}"
        if c.adagrad:
            old = f"+ coalesce((SELECT s FROM s{i - 1} o WHERE o.feature = n.feature), 0)" if i > 1 else ""
            out.append(f"s{i} AS (SELECT feature, g * g {old} AS s FROM g{i} n)")
            out.append(f"a{i} AS (SELECT feature, g / (0.0001::DOUBLE + sqrt(s)) AS g FROM g{i} JOIN s{i} USING (feature))")
            g = f"a{i}"
        step, shrink = LR.step_size(c, i, mis), c.l1 * c.step / math.sqrt(i)
        moved = f"(w - g * {step!r}::DOUBLE)"
        if shrink > 0:
            moved = f"sign({moved}) * greatest(0, abs({moved}) - {shrink!r}::DOUBLE)"
        out.append(f"w{i} AS (SELECT w.feature, CASE WHEN g IS NULL THEN w ELSE {moved} END AS w FROM w{i - 1} w LEFT JOIN {g} USING (feature))")
    return f"WITH {', '.join(out)} SELECT feature, round(w, 8) + 0.0 AS w FROM w{steps}"


def _lr(name: str, steps: int, c: LR.Config, mis: bool = False):
    def f(spark, d):
        xs = x(spark, d)
        w = LR.train(xs, y(spark, d), LR.replace_iterations(c, steps), w0(xs), mis)
        return w.select("feature", r("w").alias("w"))

    f.__name__ = name
    query(lr_sql(steps, c, mis))(f)


_lr("r01_train_sgd", 3, LR.Config(step=0.5))
_lr("r02_train_mis", 2, LR.Config(step=0.1), mis=True)
_lr("r07_update_l1", 2, LR.Config(step=0.5, l1=0.01))
_lr("r08_adagrad", 2, LR.Config(step=0.5, adagrad=True))
_HEAD = f"WITH {X_SQL}, {Y_SQL}, {W0_SQL}, {_Z.format(i=0)}"


@query(f"{_HEAD} SELECT sample, round(z, 8) + 0.0 AS z FROM z0")
def r03_forward(spark, d):
    xs = x(spark, d)
    return LR.margins(xs, y(spark, d), w0(xs)).select("sample", r("z").alias("z"))


@query(f"{_HEAD} SELECT feature, round(sum(value * ({_SIG.format('z')} - label)) / (SELECT count(*) FROM y), 10) + 0.0 AS g FROM x JOIN z0 USING (sample) GROUP BY 1")
def r04_gradient_sgd(spark, d):
    xs, ys = x(spark, d), y(spark, d)
    return LR.gradient_sgd(xs, LR.margins(xs, ys, w0(xs)), ys.count()).select("feature", r("g", 10).alias("g"))


@query(f"{_HEAD} SELECT round({_LOSS}, 8) AS loss FROM z0")
def r05_loss(spark, d):
    xs = x(spark, d)
    return LR.loss(LR.margins(xs, y(spark, d), w0(xs))).select(r("loss").alias("loss"))


@query(f"{_HEAD}, q AS (SELECT sample, label, {_SIG.format('CASE WHEN label > 0 THEN -z ELSE z END')} AS q FROM z0) SELECT feature, round(-ln((sum(CASE WHEN label > 0 THEN q * value ELSE 0 END) + 0.001::DOUBLE) / (sum(CASE WHEN label <= 0 THEN q * value ELSE 0 END) + 0.001::DOUBLE)), 8) + 0.0 AS g FROM x JOIN q USING (sample) GROUP BY 1")
def r06_gradient_mis(spark, d):
    xs, ys = x(spark, d), y(spark, d)
    return LR.gradient_mis(xs, LR.margins(xs, ys, w0(xs)), 1e-3).select("feature", r("g").alias("g"))


@query(f"{_HEAD}, g AS (SELECT feature, sum(value * ({_SIG.format('z')} - label)) / (SELECT count(*) FROM y) AS g FROM x JOIN z0 USING (sample) GROUP BY 1) SELECT feature, round(g * sqrt(0.0001::DOUBLE) / sqrt(g * g * (1 - 0.95::DOUBLE) + 0.0001::DOUBLE), 8) + 0.0 AS g FROM g")
def r09_adadelta(spark, d):
    xs, ys = x(spark, d), y(spark, d)
    g, _ = LR.adadelta(None, LR.gradient_sgd(xs, LR.margins(xs, ys, w0(xs)), ys.count()))
    return g.select("feature", r("g").alias("g"))


@query("SELECT i::INT AS i, round(0.5::DOUBLE / sqrt(i), 8) AS plain, round(0.5::DOUBLE * least(i / 11.0::DOUBLE, 1.0), 8) AS adagrad, round(0.5::DOUBLE / sqrt(10 + i), 8) AS mis FROM range(1, 21) t(i)")
def r10_steps(spark, d):
    c, a = LR.Config(step=0.5), LR.Config(step=0.5, adagrad=True)
    rows = [(i, round(LR.step_size(c, i), 8), round(LR.step_size(a, i), 8), round(LR.step_size(c, i, True), 8)) for i in range(1, 21)]
    return spark.createDataFrame(rows, "i int, plain double, adagrad double, mis double")


@query(f"{_HEAD} SELECT sample, round({_SIG.format('z')}, 8) AS score FROM z0")
def r11_predict(spark, d):
    xs = x(spark, d)
    return LR.predict(xs, y(spark, d), w0(xs)).select("sample", r("score").alias("score"))


# ------------------------------------------------------------ factorization

_VIEW = f"CASE WHEN feature < {VIEWS[0]} THEN 0 WHEN feature < {VIEWS[1]} THEN 1 WHEN feature < {VIEWS[2]} THEN 2 END"
_MVIEW = f"CASE WHEN feature >= {VIEWS[2]} THEN feature - {VIEWS[2]} ELSE {_VIEW} END"
_XB_SQL = f"xb AS (SELECT * FROM x UNION ALL SELECT sample, {VIEWS[2]} + k, 1.0 FROM (SELECT DISTINCT sample FROM x), range(3) t(k))"
_PB_SQL = P0_SQL.replace("p0 AS", "pb AS").replace("FROM x GROUP", "FROM xb GROUP")


def forward_sql(kind: str, i: int) -> list[str]:
    """CTEs f{i}: sample, score and what the gradient needs, from p{i}."""
    k = range(RANK)
    if kind == "fm":
        sums = ", ".join(f"sum(v{j} * value) AS s{j}, sum(v{j} * value * v{j} * value) AS q{j}" for j in k)
        pair = " + ".join(f"s{j} * s{j} - q{j}" for j in k)
        return [f"m{i} AS (SELECT sample, sum(w * value) AS lin, {sums} FROM x JOIN p{i} USING (feature) GROUP BY 1)", f"f{i} AS (SELECT *, (SELECT b FROM b{i}) + lin + 0.5::DOUBLE * ({pair}) AS score FROM m{i})"]
    cells = ", ".join(f"sum(CASE WHEN view = {u} THEN v{j} * value ELSE 0 END) AS c{u}_{j}" for u in range(3) for j in k)
    if kind == "bsfm":
        tot = ", ".join(f"c0_{j} + c1_{j} + c2_{j} AS s{j}, c0_{j} * c0_{j} + c1_{j} * c1_{j} + c2_{j} * c2_{j} AS q{j}" for j in k)
        pair = " + ".join(f"s{j} * s{j} - q{j}" for j in k)
        return [
            f"m{i} AS (SELECT sample, sum(w * value) AS lin, {cells} FROM (SELECT *, {_VIEW} AS view FROM x JOIN p{i} USING (feature)) GROUP BY 1)",
            f"n{i} AS (SELECT *, {tot} FROM m{i})", f"f{i} AS (SELECT *, (SELECT b FROM b{i}) + lin + 0.5::DOUBLE * ({pair}) AS score FROM n{i})",
        ]
    prod = " + ".join(f"c0_{j} * c1_{j} * c2_{j}" for j in k)
    return [f"m{i} AS (SELECT sample, {cells} FROM (SELECT *, {_MVIEW} AS view FROM xb JOIN p{i} USING (feature)) GROUP BY 1)", f"f{i} AS (SELECT *, {prod} AS score FROM m{i})"]


def step_sql(kind: str, i: int, c: FM.Config) -> list[str]:
    """CTEs r{i} (residuals), g{i} (gradients), p{i} and b{i}."""
    o, k = i - 1, range(RANK)
    m = f"{_SIG.format('score')} - label" if c.classify else "2 * (score - target)"
    out = [*forward_sql(kind, o), f"r{i} AS (SELECT f{o}.*, {m} AS m FROM y JOIN f{o} USING (sample))"]
    n = f"(SELECT count(*) FROM r{i})::DOUBLE"
    if kind == "fm":
        g = [f"value * m * (s{j} - v{j} * value)" for j in k]
        src = f"x JOIN r{i} USING (sample) JOIN p{o} USING (feature)"
    elif kind == "bsfm":
        g = [f"value * m * (s{j} - CASE {_VIEW} WHEN 0 THEN c0_{j} WHEN 1 THEN c1_{j} ELSE c2_{j} END)" for j in k]
        src = f"x JOIN r{i} USING (sample)"
    else:
        g = [f"value * m * CASE {_MVIEW} WHEN 0 THEN c1_{j} * c2_{j} WHEN 1 THEN c0_{j} * c2_{j} ELSE c0_{j} * c1_{j} END" for j in k]
        src = f"xb JOIN r{i} USING (sample)"
    gw = "value * m" if kind != "mvm" else "0.0"
    out.append(f"g{i} AS (SELECT feature, sum({gw}) / {n} AS gw, {', '.join(f'sum({e}) / {n} AS g{j}' for j, e in enumerate(g))} FROM {src} GROUP BY feature)")
    name, cols = f"g{i}", ["gw", *(f"g{j}" for j in k)]
    gb = f"(SELECT sum(m) / {n} FROM r{i})"
    if c.adagrad:
        old = lambda a: f"coalesce(o.s_{a}, 0) + " if i > 1 else ""
        frm = f"g{i} n LEFT JOIN s{o} o USING (feature)" if i > 1 else f"g{i} n"
        out.append(f"s{i} AS (SELECT feature, {', '.join(f'{old(a)}n.{a} * n.{a} AS s_{a}' for a in cols)} FROM {frm})")
        out.append(f"h{i} AS (SELECT feature, {', '.join(f'{a} / ({c.epsilon!r}::DOUBLE + sqrt(s_{a})) AS {a}' for a in cols)} FROM g{i} JOIN s{i} USING (feature))")
        out.append(f"t{i} AS (SELECT {gb} AS g, {gb} * {gb}{f' + (SELECT s FROM t{o})' if i > 1 else ''} AS s)")
        name, gb = f"h{i}", f"(SELECT g / ({c.epsilon!r}::DOUBLE + sqrt(s)) FROM t{i})"
    step = c.step if c.adagrad else c.step / math.sqrt(i)
    wd = f"(degree / {n})" if c.weighted else "1.0::DOUBLE"
    if kind == "mvm":
        l1, l2 = c.elastic * c.reg * step, (1 - c.elastic) * c.reg
        new = [f"(v{j} - (g{j} + v{j} * {l2!r}::DOUBLE * {wd}) * {step!r}::DOUBLE)" for j in k]
        if l1:
            new = [f"sign({e}) * greatest(0, abs({e}) - {wd} * {l1!r}::DOUBLE)" for e in new]
        new = [f"CASE WHEN g{j} = 0 THEN v{j} ELSE {e} END" for j, e in enumerate(new)]
        w, b = "w", "0.0::DOUBLE"
    else:
        l2s = c.step / math.sqrt(i) if kind == "fm" else step
        new = [f"v{j} - g{j} * {step!r}::DOUBLE - v{j} * {wd} * {l2s * c.l2[2]!r}::DOUBLE" for j in k]
        w = f"w - gw * {step!r}::DOUBLE - w * {wd} * {l2s * c.l2[1]!r}::DOUBLE"
        b = f"(SELECT b FROM b{o}) - {step!r}::DOUBLE * {gb} - {c.step / math.sqrt(i) * c.l2[0]!r}::DOUBLE * (SELECT b FROM b{o})"
    out.append(f"p{i} AS (SELECT p.feature, CASE WHEN gw IS NULL THEN w ELSE {w} END AS w, {', '.join(f'CASE WHEN gw IS NULL THEN v{j} ELSE {e} END AS v{j}' for j, e in enumerate(new))}, degree FROM p{o} p LEFT JOIN {name} USING (feature))")
    out.append(f"b{i} AS (SELECT {b} AS b)")
    return out


def _start(kind: str) -> list[str]:
    p = [_XB_SQL, _PB_SQL, "p0 AS (SELECT * FROM pb)"] if kind == "mvm" else [P0_SQL]
    return [X_SQL, Y_SQL, *p, "b0 AS (SELECT 0.1::DOUBLE AS b)" if kind != "mvm" else "b0 AS (SELECT 0.0::DOUBLE AS b)"]


def _setup(spark, d, kind: str, classify: bool):
    xs, ys = x(spark, d), y(spark, d, target=not classify)
    xb = FM.with_view_biases(xs, VIEWS) if kind == "mvm" else xs
    params = table_of(p0(xb), [])  # read by scores and gradients; stays in the shared folder, as the result is lazy
    return xs, xb, ys, FM.Model(kind, RANK, 0.0 if kind == "mvm" else 0.1, params, VIEWS, classify)


def _factor(kind: str, number: dict[str, str], c: FM.Config):
    def forward(spark, d):
        _, xb, _, m = _setup(spark, d, kind, True)
        return FM.score(xb, m).select("sample", r("score").alias("score"))

    def gradient(spark, d):
        _, xb, ys, m = _setup(spark, d, kind, c.classify)
        res = FM.residuals(FM.score(xb, m), ys, c.classify, m.bias)
        g = FM.backward(xb, res, m.params, kind, RANK, ys.count(), VIEWS)
        return g.select("feature", r("gw", 10).alias("gw"), *(r(F.col("gv")[k], 10).alias(f"g{k}") for k in range(RANK)))

    def train(spark, d):
        xs, _, ys, m = _setup(spark, d, kind, c.classify)
        m = FM.train(xs, ys, kind, c, VIEWS, m)
        return m.params.select("feature", r("w").alias("w"), *(r(F.col("v")[k]).alias(f"v{k}") for k in range(RANK)))

    for f, what in ((forward, "forward"), (gradient, "gradient"), (train, "train")):
        f.__name__ = f"{number[what]}_{kind}_{what}"
    query(f"WITH {', '.join(_start(kind) + forward_sql(kind, 0))} SELECT sample, round(score, 8) + 0.0 AS score FROM f0")(forward)
    steps = [s for i in range(1, c.iterations + 1) for s in step_sql(kind, i, c)]
    cols = "".join(f", round(g{j}, 10) + 0.0 AS g{j}" for j in range(RANK))
    plain = FM.Config(rank=RANK, classify=c.classify)
    query(f"WITH {', '.join(_start(kind) + step_sql(kind, 1, plain))} SELECT feature, round(gw, 10) + 0.0 AS gw{cols} FROM g1")(gradient)
    cols = "".join(f", round(v{j}, 8) + 0.0 AS v{j}" for j in range(RANK))
    query(f"WITH {', '.join(_start(kind) + steps)} SELECT feature, round(w, 8) + 0.0 AS w{cols} FROM p{c.iterations}")(train)


_factor("fm", {"forward": "f02", "gradient": "f05", "train": "f01"}, FM.Config(rank=RANK, iterations=2, step=0.1, l2=(0.01, 0.02, 0.03)))
_factor("bsfm", {"forward": "f18", "gradient": "f19", "train": "f17"}, FM.Config(rank=RANK, iterations=2, step=0.1, l2=(0.01, 0.02, 0.03), weighted=True, classify=False))
_factor("mvm", {"forward": "f11", "gradient": "f12", "train": "f10"}, FM.Config(rank=RANK, iterations=2, step=0.1, elastic=0.3, reg=0.02, weighted=True))


def _variant(name: str, kind: str, c: FM.Config):
    def f(spark, d):
        xs, _, ys, m = _setup(spark, d, kind, c.classify)
        m = FM.train(xs, ys, kind, c, VIEWS, m)
        return m.params.select("feature", r("w").alias("w"), *(r(F.col("v")[k]).alias(f"v{k}") for k in range(RANK)))

    f.__name__ = name
    steps = [s for i in range(1, c.iterations + 1) for s in step_sql(kind, i, c)]
    cols = "".join(f", round(v{j}, 8) + 0.0 AS v{j}" for j in range(RANK))
    query(f"WITH {', '.join(_start(kind) + steps)} SELECT feature, round(w, 8) + 0.0 AS w{cols} FROM p{c.iterations}")(f)


_variant("f07_fm_adagrad", "fm", FM.Config(rank=RANK, iterations=2, step=0.05, adagrad=True, l2=(0.01, 0.02, 0.03)))
_variant("f01_fm_train_regression", "fm", FM.Config(rank=RANK, iterations=2, step=0.05, classify=False))
_variant("f17_bsfm_train_classification", "bsfm", FM.Config(rank=RANK, iterations=1, step=0.1))
_variant("f20_bsfm_adagrad", "bsfm", FM.Config(rank=RANK, iterations=2, step=0.05, adagrad=True))
_variant("f10_mvm_train_regression", "mvm", FM.Config(rank=RANK, iterations=1, step=0.1, classify=False))
_variant("f14_mvm_adagrad", "mvm", FM.Config(rank=RANK, iterations=2, step=0.05, adagrad=True))


@query(f"WITH {', '.join(_start('fm') + forward_sql('fm', 0))}, z AS (SELECT label, score AS z FROM y JOIN f0 USING (sample)) SELECT round({_LOSS}, 8) AS loss FROM z")
def f04_fm_loss(spark, d):
    xs, _, ys, m = _setup(spark, d, "fm", True)
    return FM.loss(FM.residuals(FM.score(xs, m), ys, True, m.bias), True).select(r("loss").alias("loss"))


@query(f"WITH {', '.join(_start('bsfm') + forward_sql('bsfm', 0))} SELECT round(sqrt(avg((score - target) ** 2)), 8) AS loss FROM y JOIN f0 USING (sample)")
def f21_bsfm_loss(spark, d):
    xs, _, ys, m = _setup(spark, d, "bsfm", False)
    return FM.loss(FM.residuals(FM.score(xs, m), ys, False, m.bias), False).select(r("loss").alias("loss"))


@query()
def f08_minibatch(spark, d):
    c = FM.Config(fraction=0.25)
    return x(spark, d).select("sample").distinct().where(FM.sampled(c, 5))


@query(f"WITH {', '.join(_start('fm') + forward_sql('fm', 0))} SELECT sample, round({_SIG.format('score')}, 8) AS score FROM f0")
def f09_fm_predict(spark, d):
    xs, _, ys, m = _setup(spark, d, "fm", True)
    return FM.predict(xs, ys, m).select("sample", r("score").alias("score"))


@query(f"WITH {X_SQL} SELECT {_VIEW} AS view, count(*) AS n FROM x GROUP BY 1")
def f15_views(spark, d):
    return x(spark, d).groupBy(FM.view_of(F.col("feature"), VIEWS).alias("view")).agg(F.count("*").alias("n"))


@query(f"WITH {', '.join(_start('mvm') + forward_sql('mvm', 0))} SELECT sample, round({_SIG.format('score')}, 8) AS score FROM f0")
def f16_mvm_predict(spark, d):
    xs, _, ys, m = _setup(spark, d, "mvm", True)
    return FM.predict(xs, ys, m).select("sample", r("score").alias("score"))


@query()
def f14_mvm_equilibrated(spark, d):
    _, xb, ys, m = _setup(spark, d, "mvm", True)
    res = FM.residuals(FM.score(xb, m), ys, True)
    g, _ = FM.equilibrated(None, FM.backward(xb, res, m.params, "mvm", RANK, ys.count(), VIEWS), RANK, 1e-6, 1)
    return g.select("feature", *(r(F.col("gv")[k]).alias(f"g{k}") for k in range(RANK)))


@query(f"WITH {X_SQL} SELECT sample, feature, value FROM x")
def gc11_bipartite(spark, d):
    return x(spark, d)


@query(f"WITH {X_SQL}, {_XB_SQL} SELECT feature, count(*) AS degree FROM xb GROUP BY 1")
def gc12_bipartite_views(spark, d):
    return FM.with_view_biases(x(spark, d), VIEWS).groupBy("feature").agg(F.count("*").alias("degree"))


# ------------------------------------------------------------ metrics and scalars


@query("SELECT round((sum(rk * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(1 - p)), 8) AS auc FROM (SELECT p, avg(rn) OVER (PARTITION BY s) AS rk FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS p, l_quantity AS s, row_number() OVER (ORDER BY l_quantity) AS rn FROM lineitem))")
def n20_auc(spark, d):
    t = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"), F.col("l_quantity").alias("score"))
    return metrics.auc(t).select(r("auc").alias("auc"))


@query("SELECT round(sqrt(avg((l_quantity / 50 - l_discount * 10) ** 2)), 8) AS rmse FROM lineitem")
def n20_rmse(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("label"), (F.col("l_quantity") / 50).alias("score"))
    return metrics.rmse(t).select(r("rmse").alias("rmse"))


@query("SELECT c_custkey AS id, round(CASE WHEN a > 0 THEN a + ln(1 + exp(-a)) ELSE ln(1 + exp(a)) END, 8) AS softplus, round(1 / (1 + exp(-a)), 8) AS sigmoid FROM (SELECT c_custkey, c_acctbal / 1000 AS a FROM customer)")
def n19_log1pexp(spark, d):
    a = F.col("c_acctbal") / 1000
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), r(log1p_exp(a)).alias("softplus"), r(sigmoid(a)).alias("sigmoid"))


@query("SELECT a.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS dot, round(list_sum(list_transform(a.embedding::DOUBLE[], lambda z: 2 * z)), 6) + 0.0 AS scaled FROM embeddings a")
def n18_blas(spark, d):
    e = F.col("embedding").cast("array<double>")
    from ..functions.exprs import scale

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), r(dot(e, e), 6).alias("dot"), r(F.aggregate(scale(2.0, e), F.lit(0.0), lambda a, b: a + b), 6).alias("scaled"))
