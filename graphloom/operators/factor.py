"""Factorization machines: plain, block-structured and multi-view.

Samples are (sample, feature, value); parameters are (feature, w, v) with v an
array of ``rank`` factors.  Sums over factors are ``rank`` plain aggregates in
one pass, so they stay in generated code and combine before the shuffle.
Losses and gradients are means over the samples that take part, and samples
without features are scored by the bias alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import log1p_exp, sigmoid, soft_threshold
from ..plans.lineage import release, table
from .cells import frequent, with_params


@dataclass(frozen=True)
class Config:
    rank: int = 4
    iterations: int = 10
    step: float = 0.1
    l2: tuple[float, float, float] = (0.0, 0.0, 0.0)  # bias, w, v
    adagrad: bool = False
    classify: bool = True
    fraction: float = 1.0
    elastic: float = 0.0
    reg: float = 0.0
    weighted: bool = False
    epsilon: float = 1e-6
    rho: float = 1.0


@dataclass
class Model:
    kind: str  # fm, bsfm or mvm
    rank: int
    bias: float
    params: DataFrame  # feature, w, v, degree
    views: tuple[int, ...] = ()
    classify: bool = True


def initial(x: DataFrame, rank: int, seed: int = 11, scale: float = 0.01) -> DataFrame:
    """(feature, w, v, degree) with w 0 and hash-seeded factors in [-scale, scale)."""
    u = lambda k: (F.pmod(F.xxhash64("feature", F.lit(seed + k)), F.lit(1 << 20)) / float(1 << 19) - 1) * scale
    return x.groupBy("feature").agg(F.count("*").alias("degree")).select("feature", F.lit(0.0).alias("w"), F.array(*map(u, range(rank))).alias("v"), "degree")


def view_of(feature: Column, views: tuple[int, ...]) -> Column:
    """The number of the view whose cumulative exclusive bound covers a feature."""
    out = F.lit(None).cast("int")
    for k in range(len(views) - 1, -1, -1):
        out = F.when(feature < views[k], k).otherwise(out)
    return out


def with_view_biases(x: DataFrame, views: tuple[int, ...]) -> DataFrame:
    """One more feature of value 1 for each view, numbered after all features."""
    ids = x.select("sample").distinct()
    one = F.explode(F.array(*(F.struct(F.lit(views[-1] + k).cast("long").alias("feature"), F.lit(1.0).alias("value")) for k in range(len(views))))).alias("b")
    return x.unionByName(ids.select("sample", one).select("sample", F.col("b.feature").cast(x.schema["feature"].dataType).alias("feature"), "b.value"))


def _view_with_bias(views: tuple[int, ...]) -> Column:
    f = F.col("feature")
    return F.when(f >= views[-1], (f - views[-1]).cast("int")).otherwise(view_of(f, views))


def sampled(c: Config, i: int) -> Column:
    """Whether a sample belongs to iteration i's mini-batch (one in floor(1 / fraction))."""
    mod = max(1, int(1 / c.fraction))
    return F.pmod(F.xxhash64("sample", F.lit(i // mod)), F.lit(mod)) == i % mod


# ------------------------------------------------------------ forward


def _sum(e: Column, name: str) -> Column:
    return F.sum(e).alias(name)


def forward_fm(x: DataFrame, params: DataFrame, rank: int, hot: list[int] | None = None) -> DataFrame:
    """(sample, lin, s, q): sums of w x, v x and (v x)^2."""
    j = with_params(x, params.select("feature", "w", "v"), frequent(params) if hot is None else hot)
    xv = lambda k: F.col("v")[k] * F.col("value")
    a = j.groupBy("sample").agg(
        _sum(F.col("w") * F.col("value"), "lin"), *(_sum(xv(k), f"s{k}") for k in range(rank)), *(_sum(xv(k) * xv(k), f"q{k}") for k in range(rank))
    )
    return a.select("sample", "lin", F.array(*(f"s{k}" for k in range(rank))).alias("s"), F.array(*(f"q{k}" for k in range(rank))).alias("q"))


def forward_bsfm(x: DataFrame, params: DataFrame, rank: int, views: tuple[int, ...], hot: list[int] | None = None) -> DataFrame:
    """(sample, lin, s, q, sv): per factor the sum over views, the sum of squares, and each view's sum."""
    j = with_params(x, params.select("feature", "w", "v"), frequent(params) if hot is None else hot).withColumn("view", view_of(F.col("feature"), views))
    n = len(views)
    cell = lambda u, k: F.sum(F.when(F.col("view") == u, F.col("v")[k] * F.col("value")).otherwise(0.0)).alias(f"c{u}_{k}")
    a = j.groupBy("sample").agg(_sum(F.col("w") * F.col("value"), "lin"), *(cell(u, k) for u in range(n) for k in range(rank)))
    total = lambda k: sum((F.col(f"c{u}_{k}") for u in range(1, n)), F.col(f"c0_{k}"))
    square = lambda k: sum((F.col(f"c{u}_{k}") * F.col(f"c{u}_{k}") for u in range(1, n)), F.col(f"c0_{k}") * F.col(f"c0_{k}"))
    return a.select(
        "sample", "lin", F.array(*map(total, range(rank))).alias("s"), F.array(*map(square, range(rank))).alias("q"),
        F.array(*(F.array(*(f"c{u}_{k}" for k in range(rank))) for u in range(n))).alias("sv"),
    )


def predict_pairs(m: DataFrame, bias: float, rank: int) -> DataFrame:
    """score = b + lin + 1/2 sum_k (s_k^2 - q_k)."""
    pair = sum((F.col("s")[k] * F.col("s")[k] - F.col("q")[k] for k in range(rank)), F.lit(0.0))
    return m.withColumn("score", F.lit(bias) + F.col("lin") + pair * 0.5)


def forward_mvm(x: DataFrame, params: DataFrame, rank: int, views: tuple[int, ...], hot: list[int] | None = None) -> DataFrame:
    """(sample, sv): each view's sums of factors; x includes the view biases."""
    j = with_params(x, params.select("feature", "v"), frequent(params) if hot is None else hot).withColumn("view", _view_with_bias(views))
    n = len(views)
    cell = lambda u, k: F.sum(F.when(F.col("view") == u, F.col("v")[k] * F.col("value")).otherwise(0.0)).alias(f"c{u}_{k}")
    a = j.groupBy("sample").agg(*(cell(u, k) for u in range(n) for k in range(rank)))
    return a.select("sample", F.array(*(F.array(*(f"c{u}_{k}" for k in range(rank))) for u in range(n))).alias("sv"))


def _product(views: int, k: int, skip: int | None = None) -> Column:
    out = F.lit(1.0)
    for u in range(views):
        if u != skip:
            out = out * F.col("sv")[u][k]
    return out


def predict_products(m: DataFrame, rank: int, views: tuple[int, ...]) -> DataFrame:
    return m.withColumn("score", sum((_product(len(views), k) for k in range(1, rank)), _product(len(views), 0)))


# ------------------------------------------------------------ residuals and gradients


def residuals(scored: DataFrame, y: DataFrame, classify: bool, bias: float = 0.0) -> DataFrame:
    """Scored samples with label and m: sigmoid(score) - y, or 2 (score - label)."""
    j = y.join(scored, "sample", "left").withColumn("score", F.coalesce("score", F.lit(bias)))
    label = (F.col("label") > 0).cast("double")
    m = sigmoid(F.col("score")) - label if classify else (F.col("score") - F.col("label")) * 2
    return j.withColumn("m", m)


def loss(res: DataFrame, classify: bool) -> DataFrame:
    z = F.col("score")
    if classify:
        return res.agg(F.avg(F.when(F.col("label") > 0, log1p_exp(-z)).otherwise(log1p_exp(z))).alias("loss"))
    return res.agg(F.sqrt(F.avg(F.pow(z - F.col("label"), 2))).alias("loss"))


def _mean(name: str, n: Column, e: Column) -> Column:
    return (F.sum(e) / n).alias(name)


def backward(x: DataFrame, res: DataFrame, params: DataFrame, kind: str, rank: int, n: int, views: tuple[int, ...] = ()) -> DataFrame:
    """(feature, gw, gv): mean gradients by feature."""
    cols = {"fm": ["s"], "bsfm": ["s", "sv"], "mvm": ["sv"]}[kind]
    j = x.join(res.select("sample", "m", *cols), "sample")
    xm, value = F.col("value") * F.col("m"), F.col("value")
    if kind == "fm":  # the sum of x m (s - v x) by feature: v comes to the sums of x m s and x m x
        g = [xm * F.col("s")[k] for k in range(rank)]
    elif kind == "bsfm":
        view = view_of(F.col("feature"), views)
        g = [xm * (F.col("s")[k] - F.element_at("sv", view + 1)[k]) for k in range(rank)]
    else:
        j = j.withColumn("view", _view_with_bias(views))

        def others(k):
            out = F.lit(None).cast("double")
            for u in range(len(views)):
                out = F.when(F.col("view") == u, _product(len(views), k, u)).otherwise(out)
            return out

        g = [xm * others(k) for k in range(rank)]
    own = [_mean("xx", F.lit(float(n)), xm * value)] if kind == "fm" else []
    a = j.groupBy("feature").agg(_mean("gw", F.lit(float(n)), xm if kind != "mvm" else F.lit(0.0)), *(_mean(f"g{k}", F.lit(float(n)), e) for k, e in enumerate(g)), *own)
    if kind == "fm":
        a = a.join(params.select("feature", "v"), "feature").withColumns({f"g{k}": F.col(f"g{k}") - F.col("v")[k] * F.col("xx") for k in range(rank)})
    return a.select("feature", "gw", F.array(*(f"g{k}" for k in range(rank))).alias("gv"))


def adagrad(state: DataFrame | None, g: DataFrame, rank: int, epsilon: float, rho: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Scaled gradients and summed squares (sw, sv); a feature without a gradient keeps its state."""
    sq = g.select("feature", "gw", "gv", (F.col("gw") * F.col("gw")).alias("nw"), F.transform("gv", lambda a: a * a).alias("nv"))
    zero = F.array_repeat(F.lit(0.0), rank)
    if state is None:
        j = sq.select("feature", "gw", "gv", F.col("nw").alias("sw"), F.col("nv").alias("sv"))
    else:
        on = F.col("gw").isNotNull()
        decay = F.when(on, F.lit(rho)).otherwise(F.lit(1.0))
        j = state.join(sq, "feature", "full").select(
            "feature", "gw", "gv", (F.coalesce("sw", F.lit(0.0)) * decay + F.coalesce("nw", F.lit(0.0))).alias("sw"),
            F.zip_with(F.coalesce("sv", zero), F.coalesce("nv", zero), lambda a, b: a * F.when(on, F.lit(rho)).otherwise(F.lit(1.0)) + b).alias("sv"),
        )
    eps = F.lit(epsilon)
    out = j.where("gw is not null").select("feature", (F.col("gw") / (eps + F.sqrt("sw"))).alias("gw"), F.zip_with("gv", "sv", lambda a, b: a / (eps + F.sqrt(b))).alias("gv"))
    return out, j.select("feature", "sw", "sv")


def equilibrated(state: DataFrame | None, g: DataFrame, rank: int, epsilon: float, i: int, rho: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """As ``adagrad`` with squares of gradients times hash-seeded normal draws, averaged over i steps."""
    u = lambda k, t: (F.pmod(F.xxhash64("feature", F.lit(1009 * i + 31 * k + t)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    h = lambda k: F.sqrt(F.log(u(k, 0)) * -2) * F.cos(u(k, 1) * (2 * math.pi))
    probed = g.select("feature", (F.col("gw") * h(rank)).alias("gw"), F.array(*(F.col("gv")[k] * h(k) for k in range(rank))).alias("gv"))
    _, state = adagrad(state, probed, rank, epsilon, rho)
    eps = F.lit(epsilon)
    out = g.join(state, "feature").select("feature", (F.col("gw") / (eps + F.sqrt(F.col("sw") / i))).alias("gw"), F.zip_with("gv", "sv", lambda a, b: a / (eps + F.sqrt(b / i))).alias("gv"))
    return out, state


def update(params: DataFrame, g: DataFrame, kind: str, c: Config, i: int, n: int) -> DataFrame:
    """Parameters after one regularised step; features without a gradient stay."""
    step = c.step if c.adagrad else c.step / math.sqrt(i)
    l2_step = c.step / math.sqrt(i) if kind == "fm" else step
    j = params.join(g, "feature", "left")
    wd = F.col("degree") / float(n) if c.weighted and kind != "fm" else F.lit(1.0)
    if kind == "mvm":
        l1, l2 = c.elastic * c.reg * step, (1 - c.elastic) * c.reg

        def move(a, b):
            new = a - (b + a * l2 * wd) * step
            new = soft_threshold(new, wd * l1) if l1 > 0 else new
            return F.when(b == 0, a).otherwise(new)

        w = F.col("w")
    else:
        _, lw, lv = c.l2

        def move(a, b):
            return a - b * step - a * wd * (l2_step * lv)

        w = F.col("w") - F.col("gw") * step - F.col("w") * wd * (l2_step * lw)
    hit = F.col("gw").isNotNull()
    return j.select("feature", F.when(hit, w).otherwise(F.col("w")).alias("w"), F.when(hit, F.zip_with("v", "gv", move)).otherwise(F.col("v")).alias("v"), "degree")


# ------------------------------------------------------------ training and scoring


def score(x: DataFrame, model: Model, hot: list[int] | None = None) -> DataFrame:
    """(sample, score, …): margins or predicted values of the samples in x.  ``hot``: the frequent features, if known."""
    if model.kind == "fm":
        return predict_pairs(forward_fm(x, model.params, model.rank, hot), model.bias, model.rank)
    if model.kind == "bsfm":
        return predict_pairs(forward_bsfm(x, model.params, model.rank, model.views, hot), model.bias, model.rank)
    return predict_products(forward_mvm(x, model.params, model.rank, model.views, hot), model.rank, model.views)


def predict(x: DataFrame, ids: DataFrame, model: Model) -> DataFrame:
    """(sample, score) for all ids: probabilities if the model classifies."""
    x = with_view_biases(x, model.views) if model.kind == "mvm" else x
    s = ids.select("sample").join(score(x, model).select("sample", "score"), "sample", "left").withColumn("score", F.coalesce("score", F.lit(model.bias)))
    return s.withColumn("score", sigmoid(F.col("score"))) if model.classify else s


def train(x: DataFrame, y: DataFrame, kind: str, c: Config, views: tuple[int, ...] = (), model: Model | None = None) -> Model:
    """Fit by full or mini-batch gradient steps; a few scalars meet the driver in each.

    Parameters and state are written down after each step, so that its residuals
    and shuffles can go.
    """
    if kind == "bsfm" and c.rank < 2:
        raise ValueError("the block-structured machine needs a rank above 1")
    if kind == "mvm":
        x = with_view_biases(x, views)
    spark, old, now = x.sparkSession, [], []
    model = model or Model(kind, c.rank, 0.0, initial(x, c.rank), tuple(views), c.classify)
    model = replace(model, params=table(model.params, now))
    hot = frequent(model.params)
    state, bias_state = None, 0.0
    keep = {"fm": ["s"], "bsfm": ["s", "sv"], "mvm": ["sv"]}[kind]
    whole = int(1 / c.fraction) <= 1
    for i in range(1, c.iterations + 1):
        xb, yb = (x, y) if whole else (x.where(sampled(c, i)), y.where(sampled(c, i)))
        res = residuals(score(xb, model, hot), yb, c.classify, model.bias).select("sample", "m", *keep).persist()  # read by the sums and by the gradient
        n, total = res.agg(F.count("*"), F.sum("m")).first()
        if not n:
            res.unpersist()
            continue
        old, now = now, []
        g = backward(xb, res, model.params, kind, c.rank, n, model.views)
        gb = total / n
        if c.adagrad:
            g, state = adagrad(state, table(g, old), c.rank, c.epsilon, c.rho)
            state = table(state, now)
            bias_state = bias_state * c.rho + gb * gb
            gb /= c.epsilon + math.sqrt(bias_state)
        step = c.step if c.adagrad else c.step / math.sqrt(i)
        params = table(update(model.params, g, kind, c, i, n), now)
        bias = 0.0 if kind == "mvm" else model.bias - step * gb - c.step / math.sqrt(i) * c.l2[0] * model.bias
        model = replace(model, params=params, bias=bias)
        res.unpersist()
        res = g = None
        release(spark, old)
    return model
