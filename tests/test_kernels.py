"""Kernels against closed forms and brute force; learners against their objectives."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.exprs import probit_values
from graphloom.operators import factor as FM
from graphloom.operators import linear as LR
from graphloom.operators import neural as NN
from graphloom.operators import optim as O
from graphloom.operators import partition as P
from graphloom.operators import ranktree as RT
from graphloom.operators import samplers as S
from graphloom.operators import topics as T
from graphloom.operators.graph import Direction, Graph
from graphloom.sources import persist, readers


# ------------------------------------------------------------ graph fixture: a repeated edge, a loop, a lone and an undeclared vertex


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (6, 60.0), (1, 11.0)], "id long, attr double")
    e = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (2, 3, 3.0), (3, 3, 4.0), (4, 5, 5.0)], "src long, dst long, attr double")
    return Graph.build(v, e, {"attr": 0.0})


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_build_and_degrees(graph):
    assert pairs(graph.vertices) == {1: 10, 2: 20, 3: 30, 4: 40, 5: 0, 6: 60}
    assert pairs(graph.degrees()) == {1: 2, 2: 3, 3: 3, 4: 1, 5: 1}
    assert pairs(graph.degrees(Direction.IN)) == {2: 2, 3: 2, 5: 1}
    assert (graph.num_vertices(), graph.num_edges()) == (6, 5)
    assert graph.pick_random_vertex() in range(1, 7)


def test_neighbours(graph):
    assert pairs(graph.collect_neighbor_ids(Direction.EITHER)) == {1: [2, 2], 2: [1, 1, 3], 3: [2, 3, 3], 4: [5], 5: [4], 6: []}
    assert [tuple(x) for x in pairs(graph.collect_neighbors(Direction.OUT))[2]] == [(3, 30.0)]
    assert len(pairs(graph.collect_edges(Direction.IN))[2]) == 2
    with pytest.raises(ValueError):
        graph.collect_neighbor_ids(Direction.BOTH)


def test_subgraph_mask_and_messages(graph):
    sub = graph.subgraph(F.col("attr") >= 20, F.col("attr") > 3)
    assert {r.id for r in sub.vertices.collect()} == {2, 3, 4, 6} and [(r.src, r.dst) for r in sub.edges.collect()] == [(3, 3)]
    assert graph.mask(sub).edges.count() == 1
    assert pairs(graph.aggregate_messages(F.sum, to_dst=F.col("src_attr"), fields="src")) == {2: 20, 3: 50, 5: 40}
    act = graph.vertices.where("id in (2, 4)")
    got = {d: pairs(graph.aggregate_messages(F.sum, to_dst=F.col("attr"), fields="none", active=act, direction=d)) for d in Direction}
    assert got == {Direction.IN: {2: 3.0}, Direction.OUT: {3: 3.0, 5: 5.0}, Direction.BOTH: {}, Direction.EITHER: {2: 3.0, 3: 3.0, 5: 5.0}}


def test_wraparound_partition(spark):
    ids = [0, 1, -1, 12345678901, -(2**40), 2**62 + 7, -(2**63) + 9]

    def model(x, n):
        m = x * P.MIXING_PRIME % 2**64
        return abs(m - 2**64 if m >= 2**63 else m) % n

    df = spark.createDataFrame([(i, 0) for i in ids], "src long, dst long")
    assert [r.p for r in df.select(P.edge_1d(7).alias("p")).collect()] == [model(i, 7) for i in ids]
    with pytest.raises(ValueError):
        P.partition_id("nowhere", 3)
    assert P.ranges(10, 4) == [0, 3, 6, 8, 10]


def test_label_propagation_is_balanced(spark):
    e = spark.range(2000).select((F.col("id") % 400).alias("src"), (F.col("id") * 7 % 401).alias("dst"))
    n = P.by_label_propagation(e, 4).groupBy("pid").count().collect()
    assert sum(r["count"] for r in n) == 2000 and max(r["count"] for r in n) < 1.6 * 500


# ------------------------------------------------------------ samplers


W = np.array([0.1, 0.0, 0.2, 0.7])


@pytest.mark.parametrize("make", [S.FlatDist, S.CumulativeDist, S.AliasTable, S.FTree])
def test_samplers(make):
    d = make(W.copy())
    assert math.isclose(d.norm(), 1.0) and d.weight(1) == 0
    n = np.bincount([d.sample_from((i + 0.5) / 2000 * d.norm()) for i in range(2000)], minlength=4) / 2000
    assert np.abs(n - W).max() < 2e-3
    rng = np.random.default_rng(0)
    assert d.sample(rng) in (0, 2, 3)
    if make is not S.AliasTable:
        d.update(3, 0.3)
        d.update(5, 0.4)
        assert math.isclose(d.norm(), 1.0) and math.isclose(d.weight(5), 0.4)
    else:
        assert np.allclose(d.mass(), W[W > 0])
    assert make(np.array([1.0])).sample(rng) == 0


def test_metropolis_hastings_is_stationary():
    p, q = np.array([0.2, 0.5, 0.3]), np.array([0.6, 0.2, 0.2])
    flow = np.zeros((3, 3))
    for a, b in itertools.product(range(3), range(3)):
        u = (np.arange(2000) + 0.5) / 2000
        to = [S.metropolis_hastings(a, b, lambda k: p[k], lambda k: q[k], x) for x in u]
        for t in to:
            flow[a, t] += q[b] / 2000
    assert np.allclose(p @ flow, p, atol=1e-3)


# ------------------------------------------------------------ topic models


def ring_corpus(spark, docs=30, vocabulary=40, topics=4, length=60):
    r = np.random.default_rng(1)
    rows = []
    for d in range(docs):
        mine = r.integers(topics, size=2)
        for w in r.choice(mine, size=length) * (vocabulary // topics) + np.minimum(r.geometric(0.3, size=length) - 1, vocabulary // topics - 1):
            rows.append((d, int(w), 1))
    return spark.createDataFrame(rows, "doc long, term int, cnt int").groupBy("doc", "term").agg(F.sum("cnt").cast("int").alias("cnt"))


@pytest.mark.parametrize("algorithm", list(T.KERNELS))
def test_topic_models_learn(spark, algorithm):
    c = T.Config(topics=4, blocks=2, algorithm=algorithm)
    tokens = T.tokens_from_bags(ring_corpus(spark)).persist()
    start = T.initialise(tokens, c)
    llh = lambda t: sum(T.log_likelihood(t, c).first())
    before = llh(start)
    out = T.train(start, c, 6)
    assert out.count() == tokens.count() and llh(out) > before
    with pytest.raises(ValueError):
        T.kernel("nothing")


def test_inference_is_the_posterior_mean(spark):
    """Shares against the sum over all assignments of a few tokens."""
    c = T.Config(topics=2)
    model = {("a", 0): 9, ("a", 1): 1, ("b", 0): 2, ("b", 1): 6, ("c", 1): 4}
    bags = {30: ["a", "a", "b", "c"], 31: ["c", "b", "a"], 99: ["a"]}
    got = T.infer(
        spark.createDataFrame([(d, w, ws.count(w)) for d, ws in bags.items() for w in set(ws)], "doc long, term string, cnt long"),
        spark.createDataFrame([(w, k, n) for (w, k), n in model.items()], "term string, topic int, nw long"), c, 50, 20000,
    ).collect()
    nk = [sum(n for (_, k), n in model.items() if k == t) for t in range(2)]
    alpha = [(n + c.alpha_as) * c.alpha * 2 / (sum(nk) + c.alpha_as * 2) for n in nk]
    assert {x.doc for x in got} == set(bags)
    for d, ws in bags.items():
        mass = mean = 0.0
        for z in itertools.product(range(2), repeat=len(ws)):
            p = math.prod((model.get((w, k), 0) + c.beta) / (nk[k] + c.beta * 3) for w, k in zip(ws, z, strict=True))
            p *= math.prod(math.gamma(z.count(k) + alpha[k]) for k in range(2))
            mass, mean = mass + p, mean + p * z.count(0) / len(ws)
        assert abs(sum(x.p for x in got if x.doc == d and x.topic == 0) - mean / mass) < 0.04


def test_topics_save_load_infer(spark, tmp_path):
    c = T.Config(topics=4, blocks=2)
    bags = ring_corpus(spark)
    model = T.term_counts(T.initialise(T.tokens_from_bags(bags), c))
    for transpose, single in ((False, False), (True, True)):
        path = str(tmp_path / f"m{transpose}")
        persist.save_topics(spark, path, model, 4, transpose, single)
        got, meta = persist.load_topics(spark, path)
        assert sorted(map(tuple, got.collect())) == sorted((r.term, r.topic, r.nw) for r in model.collect()) and meta["topics"] == 4
    p = T.infer(bags.where("doc < 3"), model, c)
    assert {r.doc: round(r.s, 9) for r in p.groupBy("doc").agg(F.sum("p").alias("s")).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    again = T.infer(bags.where("doc < 3"), model, c)
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, again.collect()))
    local = {r.term: {} for r in model.collect()}
    for r in model.collect():
        local[r.term][r.topic] = r.nw
    persist.save_local_topics(str(tmp_path / "local"), local)
    assert persist.load_local_topics(str(tmp_path / "local")) == local


# ------------------------------------------------------------ regression and factorization


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(2)
    xs, ys = [], []
    for s in range(200):
        f = sorted(r.choice(12, size=4, replace=False).tolist())
        v = r.random(4)
        label = float(sum(x * (1 if k % 2 else -1) for k, x in zip(f, v, strict=True)) + 2 * (0 in f and 5 in f) > 0)
        xs += [(s, k, float(x)) for k, x in zip(f, v, strict=True)]
        ys.append((s, label))
    return spark.createDataFrame(xs, "sample long, feature long, value double").persist(), spark.createDataFrame([*ys, (999, 1.0)], "sample long, label double").persist()


@pytest.mark.parametrize("mis", [False, True])
def test_logistic_loss_falls(samples, mis):
    x, y = samples
    loss = [LR.loss(LR.margins(x, y, LR.train(x, y, LR.Config(iterations=i, step=0.5), mis=mis))).first().loss for i in (0, 2, 6)]
    assert loss[0] > loss[1] > loss[2]


@pytest.mark.parametrize("kind", ["fm", "bsfm", "mvm"])
def test_factor_gradients(spark, samples, kind):
    """Against central differences of the loss."""
    x, y = samples
    views = (4, 8, 12)
    xb = FM.with_view_biases(x, views) if kind == "mvm" else x
    n = y.count()
    base = {r.feature: (r.w, list(r.v), r.degree) for r in FM.initial(xb, 2, scale=0.5).collect()}

    def model(p):
        return FM.Model(kind, 2, 0.0, spark.createDataFrame([(k, *t) for k, t in p.items()], "feature long, w double, v array<double>, degree long"), views)

    def res(p):
        return FM.residuals(FM.score(xb, model(p)), y, True)

    g = {r.feature: r for r in FM.backward(xb, res(base), model(base).params, kind, 2, n, views).collect()}
    for f in (0, 5):
        hi, lo = ({**base, f: (base[f][0], [base[f][1][0] + e, base[f][1][1]], 1)} for e in (1e-4, -1e-4))
        num = (FM.loss(res(hi), True).first().loss - FM.loss(res(lo), True).first().loss) / 2e-4
        assert abs(g[f].gv[0] - num) < 1e-6


def test_factor_training_and_persistence(spark, samples, tmp_path):
    x, y = samples
    m = FM.train(x, y, "fm", FM.Config(rank=3, iterations=6, step=0.3, adagrad=True))
    before = FM.loss(FM.residuals(FM.score(x, FM.Model("fm", 3, 0.0, FM.initial(x, 3))), y, True), True).first().loss
    assert FM.loss(FM.residuals(FM.score(x, m), y, True, m.bias), True).first().loss < before
    persist.save_factor_model(spark, str(tmp_path / "fm"), m)
    again = persist.load_factor_model(spark, str(tmp_path / "fm"), "fm")
    a, b = pairs(FM.predict(x, y, m)), pairs(FM.predict(x, y, again))
    assert a.keys() == b.keys() and 999 in a and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(ValueError):
        persist.load_factor_model(spark, str(tmp_path / "fm"), "mvm")
    small = FM.train(x, y, "bsfm", FM.Config(rank=2, iterations=3, fraction=0.5), (4, 8, 12))
    assert small.params.count() == 12
    with pytest.raises(ValueError):
        FM.train(x, y, "bsfm", FM.Config(rank=1), (12,))


# ------------------------------------------------------------ ranking


def test_lambdas_by_hand(spark):
    rows = [(1, 0, 2, 0.3), (1, 1, 0, 0.3), (1, 2, 1, 0.9), (2, 0, 0, 0.0), (2, 1, 0, 1.0)]
    c = RT.Config(gains=(0.0, 1.0, 3.0))
    got = {(r.query, r.doc): (r["lambda"], r.weight) for r in RT.derivatives(spark.createDataFrame(rows, "query long, doc int, label int, score double"), c).collect()}
    order = [2, 1, 0]  # of equal scores the later document first
    disc = {d: 1 / math.log(k + 2) for k, d in enumerate(order)}
    gain, score, label = {0: 3.0, 1: 0.0, 2: 1.0}, {0: 0.3, 1: 0.3, 2: 0.9}, {0: 2, 1: 0, 2: 1}
    idcg = 3 / math.log(2) + 1 / math.log(3)
    lam, wt, s = dict.fromkeys(range(3), 0.0), dict.fromkeys(range(3), 0.0), 0.0
    for i, j in itertools.permutations(range(3), 2):
        if label[i] > label[j]:
            p = 2 / (1 + math.exp(2 * (score[i] - score[j])))
            d = (gain[i] - gain[j]) * abs(disc[i] - disc[j]) / idcg
            lam[i] += p * d
            lam[j] -= p * d
            wt[i] += p * (2 - p) * d
            wt[j] += p * (2 - p) * d
            s += 2 * p * d
    k = 10 * math.log1p(s) / s
    for d in range(3):
        assert np.allclose(got[1, d], (lam[d] * k, wt[d] * k))
    assert got[2, 0] == got[2, 1] == (0.0, 0.0)


def test_large_queries_by_blocks(spark):
    r = np.random.default_rng(6)
    rows = [(q, d, int(r.integers(0, 3)), float(r.random())) for q in (1, 2) for d in range(40)]
    s, c = spark.createDataFrame(rows, "query long, doc int, label int, score double"), RT.Config(gains=(0.0, 1.0, 3.0))
    a, b = ({(x.query, x.doc): (x["lambda"], x.weight) for x in RT.derivatives(s, c, block, small).collect()} for block, small in ((7, 0), (7, 64)))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_boosting_predicts_what_it_learned(spark):
    r = np.random.default_rng(3)
    rows = [(q, d, int(r.integers(0, 3))) for q in range(30) for d in range(5)]
    feats = [(q, d, 0, lab * 2 + int(r.integers(0, 2))) for q, d, lab in rows] + [(q, d, 1, int(r.integers(0, 4))) for q, d, _ in rows]
    s = spark.createDataFrame(rows, "query long, doc int, label int")
    f = spark.createDataFrame(feats, "query long, doc int, feature int, bin int")
    c = RT.Config(trees=2, leaves=4, rate=0.5, gains=(0.0, 1.0, 3.0))
    trees, out = RT.boost(s, f, c)
    assert RT.ndcg_error(out, c.gains).first().error < 0.05
    got, want = {(x.query, x.doc): x.score for x in RT.predict(s, f, trees, c.rate).collect()}, {(x.query, x.doc): x.score for x in out.collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert RT.tree_text(trees, c.rate).count("tree=") == 2


# ------------------------------------------------------------ networks and optimizers


@pytest.mark.parametrize("kinds", [["tanh", "softmax"], ["sigmoid", "identity"], ["softplus", "sigmoid"]])
def test_network_gradient(kinds):
    r = np.random.default_rng(4)
    net = NN.Network.create([3, 4, 2], kinds)
    x, t = r.normal(size=(5, 3)), np.eye(2)[r.integers(2, size=5)]
    g, _ = net.gradient(x, t)
    w = net.flat()
    for k in r.choice(len(w), 6, replace=False):
        e = np.zeros_like(w)
        e[k] = 1e-5
        num = (net.with_flat(w + e).gradient(x, t)[1] - net.with_flat(w - e).gradient(x, t)[1]) / 2e-5
        assert abs(g[k] - num) < 1e-5
    assert net.adversarial(x, t, 0.1).shape == x.shape


def test_updaters_and_lbfgs():
    a = np.diag([1.0, 5.0])
    for u in (O.Simple(0.1), O.Momentum(0.05, 0.5), O.AdaGrad(0.5), O.AdaDelta(1.0, epsilon=1e-2), O.Equilibrated(0.5, gamma=1.0)):
        w = np.array([2.0, -1.0])
        for i in range(1, 80):
            w = u(w, a @ w, i)
        assert w @ a @ w < 1.0
    rosen = lambda w: ((1 - w[0]) ** 2 + 100 * (w[1] - w[0] ** 2) ** 2, np.array([-2 * (1 - w[0]) - 400 * w[0] * (w[1] - w[0] ** 2), 200 * (w[1] - w[0] ** 2)]))
    out = O.lbfgs(rosen, np.array([-1.0, 1.0]), tolerance=1e-12)
    assert np.allclose(out.weights, 1, atol=1e-3)


def test_network_persistence(spark, tmp_path):
    net, rbm = NN.Network.create([3, 4, 2]), NN.RBM.create(5, 3)
    persist.save_network(spark, str(tmp_path / "n"), net)
    persist.save_rbm(spark, str(tmp_path / "r"), rbm)
    assert np.array_equal(persist.load_network(spark, str(tmp_path / "n")).flat(), net.flat())
    assert np.array_equal(persist.load_rbm(spark, str(tmp_path / "r")).flat(), rbm.flat())


def test_probit():
    p = np.array([0.001, 0.025, 0.5, 0.975, 0.999])
    back = [0.5 * math.erfc(-x / math.sqrt(2)) for x in probit_values(p)]
    assert np.allclose(back, p, atol=1e-7)
    assert probit_values(np.array([0.0, 1.0])).tolist() == [-np.inf, np.inf]


# ------------------------------------------------------------ readers


def test_readers(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    e = readers.parse_edges(lines("# c", "2 1", "", "3\t4 extra"), canonical=True)
    assert sorted(map(tuple, e.collect())) == [(1, 2, 1), (3, 4, 1)]
    with pytest.raises(Exception, match="no edge in line"):
        readers.parse_edges(lines("7")).collect()
    assert sorted(map(tuple, readers.parse_bags(lines("5 1 2:3 1")).collect())) == [(5, 1, 2), (5, 2, 3)]
    (tmp_path / "a.svm").write_text("1 1:0.5 3:2\n-1\n")
    assert sorted(tuple(r)[1:] for r in readers.libsvm_long(spark, str(tmp_path / "a.svm")).collect() if r.feature is not None) == [(1.0, 0, 0.5), (1.0, 2, 2.0)]
    prize = readers.parse_prize(lines("1:\n10,3,2005-09-06\n11,5,2005-05-13\n2:\n10,4,1970-01-02"))
    assert sorted(map(tuple, prize.collect())) == [(1, 10, 3.0, 13032), (1, 11, 5.0, 12916), (2, 10, 4.0, 1)]
    assert sorted(map(tuple, readers.parse_ranking_features(lines("0#0,2,1#0.5,1.5,9", "1#3,0,0")).collect())) == [(0, 1, 2), (0, 2, 1), (1, 0, 3)]
    assert readers.parse_thresholds(lines("0#0,2,1#0.5,1.5,9", "1#3,0,0")).count() == 3
    assert sorted(map(tuple, readers.parse_list(lines("2,0,1"), "short", "label").collect())) == [(0, 2), (1, 0), (2, 1)]
    x, y, views = readers.rating_features(readers.parse_ratings(lines("1,2,3.5,86400", "0::1::4::172800")))
    assert views == (2, 5, 7) and x.count() == 6 and y.count() == 2
    persist.write_lines(lines("a", "b"), str(tmp_path / "t"), header="h")
    assert sorted(r.value for r in persist.read_lines(spark, str(tmp_path / "t"), "h").collect()) == ["a", "b"]


# ------------------------------------------------------------ streams


def test_incremental_training(spark, samples, tmp_path):
    from graphloom.streaming.incremental import IncrementalFactors, IncrementalLogistic

    x, y = samples
    x.join(y, "sample").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample long, feature long, value double, label double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = IncrementalLogistic(LR.Config(iterations=3, step=0.5))
    stream.writeStream.foreachBatch(m.step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert m.batches == 2 and m.weights.count() == 12
    start, end = (LR.loss(LR.margins(x, y, w)).first().loss for w in (LR.zero_weights(x), m.weights))
    assert end < start
    f = IncrementalFactors("fm", FM.Config(rank=2, iterations=2))
    stream.writeStream.foreachBatch(f.step).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert f.model.params.count() == 12


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_features_do_not_meet_in_one_task(spark, samples, monkeypatch):
    """A feature that all samples have goes to the cells by broadcast; the others are dealt; the sums are the same."""
    from graphloom.operators import cells

    monkeypatch.setattr(cells, "HOT", 1)
    x, y = samples
    x = x.where("feature <> 3").unionByName(x.select("sample", F.lit(3).cast("long").alias("feature"), F.lit(0.5).alias("value")).distinct())
    assert cells.frequent(x) == [3]
    w = spark.createDataFrame([(k, 0.1 * k) for k in range(11)], "feature long, w double")
    want = {}
    for r in x.collect():
        want[r.sample] = want.get(r.sample, 0.0) + (0.1 * r.feature * r.value if r.feature < 11 else 0.0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        z = LR.margins(x, y, w)
        f = FM.score(x, FM.Model("fm", 3, 0.0, FM.initial(x, 3)))
        assert all("BroadcastHashJoin [feature" in plan(df) and "SortMergeJoin [feature" in plan(df) for df in (z, f))
        assert all(abs(r.z - want.get(r.sample, 0.0)) < 1e-12 for r in z.collect())
        one = [r.score for r in f.orderBy("sample").collect()]
        two = [r.score for r in FM.score(x, FM.Model("fm", 3, 0.0, FM.initial(x, 3)), []).orderBy("sample").collect()]
        assert np.allclose(one, two, atol=1e-12) and len(one) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_training_leaves_no_plan_behind(samples):
    """Weights are read from a table after each step, not from the plans of the steps before."""
    x, y = samples
    w = LR.train(x, y, LR.Config(iterations=3, step=0.5, adagrad=True))
    m = FM.train(x, y, "fm", FM.Config(rank=2, iterations=3, adagrad=True))
    assert all("FileScan parquet" in plan(df) and "Join" not in plan(df) and "Checkpoint" not in plan(df) for df in (w, m.params))


# ------------------------------------------------------------ command line


def test_command_line(spark, tmp_path, capsys):
    from graphloom.plans import cli

    r = np.random.default_rng(7)
    (tmp_path / "c.txt").write_text("\n".join(f"{d} " + " ".join(f"{t}:{1 + t % 3}" for t in r.integers(0, 20, 6)) for d in range(12)))
    cli.main(["topics", "--input", str(tmp_path / "c.txt"), "--output", str(tmp_path / "t"), "--topics", "3", "--iterations", "1", "--blocks", "2", "--single"])
    assert persist.load_topics(spark, str(tmp_path / "t"))[1]["topics"] == 3
    (tmp_path / "b.svm").write_text("\n".join(f"{1 if k % 2 else -1} {1 + k % 2}:1 3:{r.random():.3f}" for k in range(60)))
    cli.main(["logistic", "--input", str(tmp_path / "b.svm"), "--output", str(tmp_path / "w"), "--iterations", "3", "--step", "1"])
    assert persist.load_linear(spark, str(tmp_path / "w")).count() == 3
    (tmp_path / "r.csv").write_text("\n".join(f"{u},{m},{1 + (u + m) % 5},{86400 * (u * 7 + m) + m}" for u in range(1, 8) for m in range(1, 8)))
    cli.main(["factors", "--input", str(tmp_path / "r.csv"), "--output", str(tmp_path / "f"), "--rank", "2", "--iterations", "2", "--adagrad"])
    assert persist.load_factor_model(spark, str(tmp_path / "f"), "fm").rank == 2
    spark.createDataFrame([(q, d, d % 3) for q in range(6) for d in range(4)], "query long, doc int, label int").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(q, d, 0, d % 3) for q in range(6) for d in range(4)], "query long, doc int, feature int, bin int").write.parquet(str(tmp_path / "x"))
    cli.main(["rank", "--samples", str(tmp_path / "s"), "--features", str(tmp_path / "x"), "--output", str(tmp_path / "trees"), "--trees", "1", "--leaves", "3", "--gains", "0:1:3"])
    out = capsys.readouterr().out
    assert "total" in out and "auc" in out and "rmse" in out and "error" in out


def test_dropout_drops_other_units_in_each_step(spark):
    """Over several steps on one batch every hidden unit learns; a network thinned once would leave some as they were."""
    from graphloom.operators import neural as NN
    from graphloom.operators import optim as O

    r = np.random.default_rng(6)
    rows = [(r.normal(size=8).tolist(), np.eye(3)[i % 3].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "features array<double>, target array<double>").coalesce(1)
    net = NN.Network.create([8, 12, 3], ["sigmoid", "softmax"], dropout=[0.5, 0.0])
    one, _ = NN.train_network(df, net, O.AdaGrad(rate=0.05), 1)
    many, _ = NN.train_network(df, net, O.AdaGrad(rate=0.05), 10)
    moved = [np.abs(x.layers[0].weight - net.layers[0].weight).max(1) > 0 for x in (one, many)]
    assert moved[0].any() and moved[1].all()


def test_inference_against_a_plain_sampler(spark):
    """Shares of every document equal those of a sampler in lists and dictionaries that draws the same numbers."""
    import zlib

    bags = [(1, "apple", 3), (1, "pear", 2), (2, "rust", 4), (3, "apple", 1), (3, "unknown", 2), (21, "rust", 1)]
    model = [("apple", 0, 9), ("pear", 0, 4), ("rust", 1, 7), ("pear", 1, 1)]
    c = T.Config(topics=3)
    got = {(x.doc, x.topic): x.p for x in T.infer(spark.createDataFrame(bags, "doc long, term string, cnt long"), spark.createDataFrame(model, "term string, topic int, nw long"), c).collect()}

    nk = [sum(n for _, t, n in model if t == k) for k in range(3)]
    nw = {(w, t): n for w, t, n in model}
    vocabulary, want = 3, {}
    prior = [(n + c.alpha_as) * (c.alpha * 3 / (sum(nk) + c.alpha_as * 3)) for n in nk]
    for doc in (1, 2, 3, 21):
        words = [w for d, w, n in sorted(bags) if d == doc for _ in range(n)]
        rng = np.random.default_rng([c.seed, zlib.crc32(str(doc).encode())])
        z = [int(x) for x in rng.integers(3, size=len(words))]
        for s in range(10):
            for i, w in enumerate(words):
                z[i] = -1
                p = [(nw.get((w, k), 0) + c.beta) / (nk[k] + c.beta * vocabulary) * (z.count(k) + prior[k]) for k in range(3)]
                u = rng.random() * (p[0] + p[1] + p[2])
                z[i] = 0 if u < p[0] else 1 if u < p[0] + p[1] else 2
            for k in range(3):
                if s >= 5 and z.count(k):
                    want[doc, k] = want.get((doc, k), 0) + z.count(k) / len(words) / 5
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lanes_sample_each_token_once_and_each_document_once_a_step():
    r = np.random.default_rng(3)
    doc = np.sort(r.integers(0, 9, 200))
    b = T.Block(doc, r.integers(0, 5, 200), np.zeros(200, int), None, None, np.zeros(4), None, 0.0, 0.0, np.random.default_rng(1))
    steps = list(b.lanes(b.doc, b.term))
    assert sorted(np.concatenate(steps)) == list(range(200)) and len(steps) == np.bincount(doc).max()
    assert all(len(set(doc[i])) == len(i) for i in steps)


def test_blocks_grow_in_number_and_sweeps_leave_one_table(spark, monkeypatch):
    """Blocks hold BLOCK tokens on the average, also with many tokens; only the last sweep's table stays."""
    from pathlib import Path

    seen = []
    blocks = T._blocks
    monkeypatch.setattr(T, "BLOCK", 100)
    monkeypatch.setattr(T, "_blocks", lambda rows, counts, n: (seen.append(n), blocks(rows, counts, n))[1])
    tokens = T.tokens_from_bags(ring_corpus(spark))
    out = T.train(tokens, T.Config(topics=4, blocks=2, algorithm="ftree"), 3)
    assert seen == [18, 18, 18] and out.count() == 1800
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parent.parent
    before = len(list(folder.glob("table-*")))
    T.train(tokens, T.Config(topics=4, blocks=2), 3)
    assert len(list(folder.glob("table-*"))) == before + 1


def test_incremental_query_takes_all_warm_up_sweeps(spark, monkeypatch):
    import __spark_entry__ as entry

    took = []
    monkeypatch.setattr(T, "train", lambda tokens, c, iterations, model: took.append(iterations) or tokens)
    entry.queries()["l02_incremental_train"](spark, "/root/testdata/sf0.001")
    assert took == [16]


def test_documents_inferred_together(spark, monkeypatch):
    """Parts of a block that are sampled together don't change a document's shares."""
    c, bags = T.Config(topics=4, blocks=1), ring_corpus(spark)
    model = T.term_counts(T.initialise(T.tokens_from_bags(bags), c))
    want = sorted(map(tuple, T.infer(bags, model, c).collect()))
    monkeypatch.setattr(T, "INFER", 70)
    assert sorted(map(tuple, T.infer(bags, model, T.Config(topics=4, blocks=7)).collect())) == want


def test_perplexity_by_blocks(spark, monkeypatch):
    """Against sums over all tokens and topics, with blocks of few tokens; no row for each pair and topic."""
    c = T.Config(topics=5, blocks=1)
    tokens = T.initialise(T.tokens_from_bags(ring_corpus(spark)), c).where("topic <> 4")
    monkeypatch.setattr(T, "BLOCK", 300)
    df = T.perplexity(tokens, c)
    assert "FlatMapCoGroupsInArrow" in plan(df)
    rows = [(r.doc, r.term, r.topic) for r in tokens.collect()]
    nk, nd, nw, size = (Counter(f(r) for r in rows) for f in (lambda r: r[2], lambda r: (r[0], r[2]), lambda r: (r[1], r[2]), lambda r: r[0]))
    n, v = len(rows), len({r[1] for r in rows})
    a = [(nk[k] + c.alpha_as) * (c.alpha * 5 / (n + c.alpha_as * 5)) for k in range(5)]
    den = [nk[k] + c.beta * v for k in range(5)]
    total = sum(math.log(sum((nd[d, k] + a[k]) * (nw[w, k] + c.beta) / den[k] for k in range(5)) / (size[d] + c.alpha * 5)) for d, w, _ in rows)
    word = sum(math.log((nw[w, z] + c.beta) / den[z]) for _, w, z in rows)
    doc = sum(math.log((nd[d, z] + a[z]) / (size[d] + c.alpha * 5)) for d, _, z in rows)
    assert np.allclose(df.first(), [math.exp(-x / n) for x in (total, word, doc)], rtol=1e-10)


def test_long_ranking_lines_are_read_in_pieces(spark):
    """Bins of a line that spans many pieces, with thresholds after them."""
    from graphloom.sources import readers

    bins = [(7 * i) % 11 for i in range(5000)]
    line = "3#" + ",".join(map(str, bins)) + "#0.5,1.5"
    want = [(3, i, b) for i, b in enumerate(bins) if b]
    for piece in (1, 10, 1 << 18):
        got = [tuple(r.values()) for batch in readers._line_bins(line, piece) for r in batch.to_pylist()]
        assert got == want
    df = readers.parse_ranking_features(spark.createDataFrame([(line,), ("",), ("4#0,-2",)], "value string"))
    assert sorted(map(tuple, df.collect())) == [*want, (4, 1, -2)]
    assert "Generate" not in plan(df) and df.dtypes == [("feature", "int"), ("sample", "bigint"), ("bin", "smallint")]


def test_lambdas_deal_samples_once(spark):
    """Ranks, ideal gains and counts of a query come from one exchange of the samples."""
    s = spark.createDataFrame([(q, d, (q + d) % 3, float(d)) for q in range(20) for d in range(4)], "query long, doc int, label int, score double").repartition(3)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = RT._joined_parts
        kept = []
        RT._joined_parts = lambda t, c: (kept.append(plan(t)), got(t, c))[1]
        RT.derivatives(s, RT.Config())
    finally:
        RT._joined_parts = got
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert kept[0].count("hashpartitioning(query") == 1 and "Join" not in kept[0]
