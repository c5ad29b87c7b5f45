"""Generators, readers, topic models, ranking trees, networks and samplers."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import erfc, lgamma, probit
from ..operators import factor as FM
from ..operators import neural as NN
from ..operators import optim as O
from ..operators import ranktree as RT
from ..operators import samplers as S
from ..operators import topics as T
from ..sources import generators as G
from ..sources import persist, readers
from . import learner_queries as L
from .lineage import checkpoint_dir
from .lineage import table as table_of
from .registry import query, table


def r(c, n: int = 8):
    return F.round(c, n) + F.lit(0.0)


# ------------------------------------------------------------ sources


@query("SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2")
def io1_edge_list(spark, d):
    li = table(spark, d, "lineitem")
    lines = li.select(F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("# a comment",)], "value string"))
    return readers.parse_edges(lines, canonical=True).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS doc, (o_orderkey % 50)::INT AS term, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 3 END)::BIGINT AS cnt FROM orders GROUP BY 1, 2")
def io3_raw_corpus(spark, d):
    term, cnt = (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderkey") % 3
    cell = F.when(cnt == 0, term).otherwise(F.concat_ws(":", term, cnt.cast("string")))
    lines = table(spark, d, "orders").select(F.concat_ws(" ", F.col("o_custkey").cast("string"), cell).alias("value"))
    return readers.parse_bags(lines).groupBy("doc", "term").agg(F.sum("cnt").alias("cnt"))


@query("SELECT doc_id AS doc, w AS term, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2")
def io4_bag_of_words(spark, d):
    return readers.bag_of_words(table(spark, d, "documents"))


@query()
def io5_sample(spark, d):
    return readers.sample_rows(table(spark, d, "documents").select("doc_id"), 0.3)


@query("SELECT o_custkey AS user_id, o_orderkey AS movie, (o_totalprice::BIGINT % 5)::DOUBLE AS rating FROM orders")
def io20_ratings(spark, d):
    lines = table(spark, d, "orders").select(F.concat_ws("::", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), (F.bround("o_totalprice").cast("long") % 5).cast("string"), F.lit("0")).alias("value"))
    return readers.parse_ratings(lines).select(F.col("user").alias("user_id"), "movie", "rating")


@query("SELECT o_custkey AS user_id, count(*) AS n, round(min(1.0::DOUBLE / sqrt(k)), 8) AS value FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders) GROUP BY 1")
def io21_implicit(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("movie"))
    return readers.implicit_features(x, 0, 0).groupBy(F.col("user").alias("user_id")).agg(F.count("*").alias("n"), r(F.min("value")).alias("value"))


@query("SELECT (o_orderkey % 10 = 0) AS test, count(*) AS n FROM orders GROUP BY 1")
def io22_probe_split(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("movie"), F.col("o_orderkey").alias("user"))
    train, test = readers.probe_split(x, x.where("user % 10 = 0"))
    return train.select(F.lit(False).alias("test")).unionByName(test.select(F.lit(True).alias("test"))).groupBy("test").agg(F.count("*").alias("n"))


@query("SELECT (l_linenumber)::INT AS feature, count(*) AS n, sum(b)::BIGINT AS total FROM (SELECT l_linenumber, (l_quantity::INT % 4) AS b FROM lineitem) WHERE b <> 0 GROUP BY 1")
def io19_ranking_features(spark, d):
    # a feature's line is put together from pieces: no list of all its bins
    part = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity").cast("int") % 4).cast("string").alias("b"), F.pmod(F.xxhash64("l_orderkey"), F.lit(1024)).alias("part"))
    pieces = part.groupBy("l_linenumber", "part").agg(F.array_join(F.collect_list("b"), ",").alias("b"))
    lines = pieces.groupBy("l_linenumber").agg(F.array_join(F.collect_list("b"), ",").alias("bins")).select(F.concat_ws("#", F.col("l_linenumber").cast("string"), "bins").alias("value"))
    return readers.parse_ranking_features(lines).groupBy("feature").agg(F.count("*").alias("n"), F.sum("bin").alias("total"))


@query("SELECT count(*) AS edges, min(dst) AS dst, count(DISTINCT src) AS leaves FROM (SELECT i AS src, 0 AS dst FROM range(1, 100) t(i))")
def gc10_star(spark, d):
    return G.star(spark, 100).edges.agg(F.count("*").alias("edges"), F.min("dst").cast("int").alias("dst"), F.count_distinct("src").alias("leaves"))


@query("SELECT r * 7 + c AS src, r * 7 + c + 1 AS dst, 1.0::DOUBLE AS attr FROM range(5) a(r), range(7) b(c) WHERE c < 6 UNION ALL SELECT r * 7 + c, r * 7 + c + 7, 1.0 FROM range(5) a(r), range(7) b(c) WHERE r < 4")
def gc9_grid(spark, d):
    return G.grid(spark, 5, 7).edges


@query()
def gc5_log_normal(spark, d):
    return G.log_normal_graph(spark, 500, 2.0, 0.8).edges


@query("SELECT 2000 AS n, true AS inside")
def gc8_rmat(spark, d):
    e = G.rmat(spark, 256, 2000).edges.distinct()
    return e.agg(F.count("*").cast("int").alias("n"), (F.max(F.greatest("src", "dst")) < 256).alias("inside"))


# ------------------------------------------------------------ topic models

K = 8
CFG = T.Config(topics=K, blocks=16)
TOK_SQL = f"""tok AS (SELECT doc, term, topic FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
  LATERAL (SELECT ((doc * 31 + length(term) * 7 + ascii(term)) % {K})::INT AS topic))"""


def tokens(spark, d) -> DataFrame:
    """Tokens whose topics are arithmetic on keys, so that SQL agrees."""
    w = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("term"))
    return w.withColumn("topic", _start())


@query(f"WITH {TOK_SQL} SELECT term, topic, count(*) AS nw FROM tok GROUP BY 1, 2")
def l06_term_counts(spark, d):
    return T.term_counts(tokens(spark, d))


@query(f"WITH {TOK_SQL} SELECT doc, topic, count(*) AS nd FROM tok GROUP BY 1, 2")
def l06_doc_counts(spark, d):
    return T.doc_counts(tokens(spark, d))


@query(f"WITH {TOK_SQL}, k AS (SELECT topic, count(*) AS nk, (SELECT count(*) FROM tok) AS n FROM tok GROUP BY 1) SELECT topic, nk, round((nk + 0.1::DOUBLE) * (0.1::DOUBLE * {K} / (n + 0.1::DOUBLE * {K})), 8) AS alpha FROM k")
def l07_topic_counts(spark, d):
    t = tokens(spark, d)
    return T.topic_counts(t).select("topic", "nk", r(T.alpha_k(F.col("nk"), t.count(), CFG)).alias("alpha"))


_LDA = f"""{TOK_SQL}, s AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT term)::DOUBLE AS v FROM tok),
 nk AS (SELECT k::INT AS topic, coalesce(c, 0)::DOUBLE AS nk, (coalesce(c, 0) + 0.1::DOUBLE) * (0.1::DOUBLE * {K} / (n + 0.1::DOUBLE * {K})) AS a, coalesce(c, 0) + 0.01::DOUBLE * v AS den
   FROM range({K}) r(k) LEFT JOIN (SELECT topic, count(*) AS c FROM tok GROUP BY 1) ON topic = k, s),
 nw AS (SELECT term, topic, count(*)::DOUBLE AS nw FROM tok GROUP BY 1, 2), nd AS (SELECT doc, topic, count(*)::DOUBLE AS nd FROM tok GROUP BY 1, 2),
 size AS (SELECT doc, count(*)::DOUBLE AS n FROM tok GROUP BY 1)"""


@query(f"""WITH {_LDA}, pair AS (SELECT doc, term, count(*) AS c FROM tok GROUP BY 1, 2),
 p AS (SELECT doc, term, any_value(c) AS c, sum((coalesce(nd, 0) + a) * (coalesce(nw, 0) + 0.01::DOUBLE) / den) AS p FROM pair CROSS JOIN nk LEFT JOIN nd USING (doc, topic) LEFT JOIN nw USING (term, topic) GROUP BY 1, 2)
 SELECT round((SELECT exp(-sum(c * ln(p / (size.n + 0.1::DOUBLE * {K}))) / any_value(s.n)) FROM p JOIN size USING (doc), s), 5) AS total,
 round((SELECT exp(-sum(nw * ln((nw + 0.01::DOUBLE) / den)) / any_value(s.n)) FROM nw JOIN nk USING (topic), s), 5) AS word,
 round((SELECT exp(-sum(nd * ln((nd + a) / (size.n + 0.1::DOUBLE * {K}))) / any_value(s.n)) FROM nd JOIN nk USING (topic) JOIN size USING (doc), s), 5) AS doc""")
def l14_perplexity(spark, d):
    return T.perplexity(tokens(spark, d), CFG).select(*(r(c, 5).alias(c) for c in ("total", "word", "doc")))


@query(f"""WITH {_LDA} SELECT round((SELECT sum(lgamma(nw + 0.01::DOUBLE) - lgamma(0.01::DOUBLE)) FROM nw) + {K} * lgamma(0.01::DOUBLE * v) - (SELECT sum(lgamma(den)) FROM nk), 3) AS word,
 round((SELECT sum(lgamma(nd + a) - lgamma(a)) FROM nd JOIN nk USING (topic)) - (SELECT sum(lgamma(n + 0.1::DOUBLE * {K})) - count(*) * lgamma(0.1::DOUBLE * {K}) FROM size), 3) AS doc FROM s""")
def l15_log_likelihood(spark, d):
    return T.log_likelihood(tokens(spark, d), CFG).select(r("word", 3).alias("word"), r("doc", 3).alias("doc"))


_KEPT_SQL = f"WITH {TOK_SQL} SELECT 'doc' AS kind, doc::VARCHAR AS key, count(*) AS n FROM tok GROUP BY 2 UNION ALL SELECT 'term', term, count(*) FROM tok GROUP BY 2"
_MOVED_SQL = f"{_KEPT_SQL} UNION ALL SELECT 'moved', '', 1 UNION ALL SELECT 'outside', '', 0"


def _start():
    """The topics that tokens() gives, as an expression of a token's keys."""
    return ((F.col("doc") * 31 + F.length("term") * 7 + F.ascii("term")) % K).cast("int")


def _all_tokens(spark, d) -> DataFrame:
    """Every token of every document, without topics."""
    return T.tokens_from_bags(tokens(spark, d).groupBy("doc", "term").agg(F.count("*").alias("cnt")))


def _kept(t: DataFrame) -> DataFrame:
    """Tokens of each document and of each term: what no sampler may change."""
    by = lambda c: t.groupBy(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return by("doc").unionByName(by("term"))


def _one(t: DataFrame, kind: str, n) -> DataFrame:
    return t.agg(n.cast("long").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("key"), "n")


def _moved(t: DataFrame) -> DataFrame:
    """What a sweep keeps, whether a tenth of the tokens have another topic than at the start, and topics out of range."""
    moved = F.sum((F.col("topic") != _start()).cast("int")) * 10 > F.count("*")
    return _kept(t).unionByName(_one(t, "moved", moved)).unionByName(_one(t, "outside", F.count_if(~F.col("topic").between(0, K - 1))))


def _sweeps(name: str, algorithm: str) -> None:
    def f(spark, d):
        return _moved(T.train(_all_tokens(spark, d).withColumn("topic", _start()), T.Config(topics=K, algorithm=algorithm), 1))

    f.__name__ = name
    query(_MOVED_SQL)(f)


def _init(name: str) -> None:
    def f(spark, d):
        t = T.initialise(_all_tokens(spark, d), T.Config(topics=K, init=name))
        return _kept(t).unionByName(_one(t, "topics", F.count_distinct("topic")))

    f.__name__ = f"l03_init_{name}"
    query(f"{_KEPT_SQL} UNION ALL SELECT 'topics', '', {K}")(f)


for _a, _n in zip(("frozen", "light", "sparse", "alias", "ftree"), range(8, 13), strict=True):
    _sweeps(f"l{_n:02d}_sweep_{_a}", _a)
for _i in ("random", "sparseterm", "sparsedoc"):
    _init(_i)


@query(_MOVED_SQL)
def l02_incremental_train(spark, d):
    """All tokens, with the operator's own warm-up sweeps."""
    t = _all_tokens(spark, d).withColumn("topic", _start())
    return _moved(T.incremental_train(t, T.term_counts(t), CFG, 1))


@query()
def l17_inference(spark, d):
    """Every document with the operator's own burn-in and sweeps."""
    t = tokens(spark, d)
    bags = t.groupBy("doc", "term").agg(F.count("*").alias("cnt"))
    return T.infer(bags, T.term_counts(t), CFG).select("doc", "topic", r("p").alias("p"))


@query(f"WITH {TOK_SQL}, n AS (SELECT term, topic, count(*) AS nw FROM tok GROUP BY 1, 2) SELECT topic, term, nw, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY nw DESC, term) AS rank FROM n) WHERE rank <= 10")
def l19_top_terms(spark, d):
    return T.top_terms(T.term_counts(tokens(spark, d))).select("topic", "term", "nw", "rank")


@query("SELECT term::VARCHAR || chr(9) || string_agg(topic || ':' || nw, ' ' ORDER BY nw DESC, topic) AS value FROM (SELECT (l_partkey % 200)::INT AS term, (l_suppkey % 8)::INT AS topic, count(*) AS nw FROM lineitem GROUP BY 1, 2) GROUP BY term")
def io10_topic_lines(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).cast("int").alias("term"), (F.col("l_suppkey") % 8).cast("int").alias("topic")).agg(F.count("*").alias("nw"))
    return persist.topic_lines(m)


@query("SELECT (l_partkey % 200)::INT AS term, (l_suppkey % 8)::INT AS topic, count(*) AS nw FROM lineitem GROUP BY 1, 2")
def io11_topic_lines_read(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).cast("int").alias("term"), (F.col("l_suppkey") % 8).cast("int").alias("topic")).agg(F.count("*").alias("nw"))
    return persist.parse_topic_lines(persist.topic_lines(m, transpose=True), transpose=True)


# ------------------------------------------------------------ ranking trees

GAINS = (0.0, 1.0, 3.0, 7.0, 15.0)
RC = RT.Config(gains=GAINS, trees=2, leaves=4, sigma=0.001)
S_SQL = """s AS (SELECT query, doc, label, score FROM (SELECT l_orderkey AS query, l_linenumber AS doc, max(least(floor(l_quantity / 10), 4))::INT AS label, max(l_extendedprice) / 1000 AS score FROM lineitem GROUP BY 1, 2))"""
F_SQL = """f AS (SELECT l_orderkey AS query, l_linenumber AS doc, unnest([0, 1])::INT AS feature, unnest([max(l_discount * 100)::INT, max(l_suppkey % 16)::INT])::INT AS bin FROM lineitem GROUP BY 1, 2)"""


def ranking(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("doc"))
    s = li.agg(F.max(F.least(F.floor(F.col("l_quantity") / 10), F.lit(4))).cast("int").alias("label"), (F.max("l_extendedprice") / 1000).alias("score"))
    b = li.agg(F.bround(F.max(F.col("l_discount") * 100)).cast("int").alias("b0"), F.max(F.col("l_suppkey") % 16).cast("int").alias("b1"))
    f = b.select("query", "doc", F.explode(F.array(F.struct(F.lit(0).alias("feature"), F.col("b0").alias("bin")), F.struct(F.lit(1).alias("feature"), F.col("b1").alias("bin")))).alias("e")).select("query", "doc", "e.feature", "e.bin")
    return s, f


_G = "CASE label WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 ELSE 15 END"
_IDCG = f"idcg AS (SELECT query, sum({_G} / ln(rk + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY label DESC, doc) AS rk FROM s) GROUP BY 1)"
_LAMBDA = f"""{S_SQL}, {_IDCG}, o AS (SELECT s.*, {_G} AS g, 1 / ln(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) + 1) AS disc FROM s),
 pr AS (SELECT a.query, a.doc AS i, b.doc AS j, 2 / (1 + exp(0.002::DOUBLE * (a.score - b.score))) AS p, (a.g - b.g) * abs(a.disc - b.disc) / idcg AS dl FROM o a JOIN o b ON a.query = b.query AND a.label > b.label JOIN idcg ON idcg.query = a.query WHERE idcg > 0),
 e AS (SELECT query, i AS doc, p * dl AS l, p * (2 - p) * dl AS w, p * dl AS part FROM pr UNION ALL SELECT query, j, -p * dl, p * (2 - p) * dl, p * dl FROM pr),
 q AS (SELECT query, sum(part) AS S FROM e GROUP BY 1),
 der AS (SELECT s.query, s.doc, coalesce(l * nrm, 0) AS lam, coalesce(w * nrm, 0) AS weight FROM s LEFT JOIN (SELECT query, doc, sum(l) AS l, sum(w) AS w FROM e GROUP BY 1, 2) x USING (query, doc)
   LEFT JOIN (SELECT query, CASE WHEN S > 0 THEN 10 * ln(1 + S) / S ELSE 1 END AS nrm FROM q) y USING (query))"""


@query(f"WITH {S_SQL}, {_IDCG} SELECT query, round(idcg, 8) AS idcg FROM idcg")
def t02_ideal_dcg(spark, d):
    return RT.ideal_dcg(ranking(spark, d)[0], GAINS).select("query", r("idcg").alias("idcg"))


@query("SELECT i::INT AS i, round(2 / (1 + exp(i / 10.0::DOUBLE)), 8) AS p FROM range(-50, 51) t(i)")
def t03_pair_sigmoid(spark, d):
    return spark.range(-50, 51).select(F.col("id").cast("int").alias("i"), r(F.lit(2.0) / (F.lit(1.0) + F.exp(F.col("id") / 10))).alias("p"))


@query(f"WITH {_LAMBDA} SELECT query, doc, round(lam, 7) + 0.0 AS lam, round(weight, 7) + 0.0 AS weight FROM der")
def t04_derivatives(spark, d):
    return RT.derivatives(ranking(spark, d)[0], RC).select("query", "doc", r("lambda", 7).alias("lam"), r("weight", 7).alias("weight"))


@query(f"WITH {S_SQL}, {_IDCG}, o AS (SELECT query, sum({_G} / ln(rk + 1)) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS rk FROM s) GROUP BY 1) SELECT round(avg(CASE WHEN idcg > 0 THEN 1 - dcg / idcg ELSE 0 END), 8) AS error FROM o JOIN idcg USING (query)")
def t05_ndcg_error(spark, d):
    return RT.ndcg_error(ranking(spark, d)[0], GAINS).select(r("error").alias("error"))


_HIST = f"{_LAMBDA}, {F_SQL}, h AS (SELECT 1 AS node, feature, bin, count(*) AS n, sum(lam) AS s, sum(weight) AS w FROM f JOIN der USING (query, doc) GROUP BY 2, 3)"


def _nodes(spark, d):
    s, f = ranking(spark, d)
    nodes = table_of(RT.derivatives(s, RC).withColumn("node", F.lit(1)), [])  # read by bins and by totals; stays in the shared folder, as results are lazy
    return nodes, f


@query(f"WITH {_HIST} SELECT node, feature, bin, n, round(s, 5) + 0.0 AS s, round(w, 5) + 0.0 AS w FROM h")
def t07_histograms(spark, d):
    return RT.histograms(*_nodes(spark, d)).where("n > 0").select("node", "feature", "bin", "n", r("s", 5).alias("s"), r("w", 5).alias("w"))


@query(f"WITH {_HIST} SELECT feature, bin, (sum(n) OVER a)::BIGINT AS n, round(sum(s) OVER a, 5) + 0.0 AS s, (sum(n) OVER b)::BIGINT AS n_right FROM h WINDOW a AS (PARTITION BY feature ORDER BY bin), b AS (PARTITION BY feature ORDER BY bin DESC)")
def t07_cumulated(spark, d):
    h = RT.histograms(*_nodes(spark, d)).where("n > 0").persist()
    left = RT.cumulated(h).select("feature", "bin", "n", r("s", 5).alias("s"))
    return left.join(RT.cumulated(h, right=True).select("feature", "bin", F.col("n").alias("n_right")), ["feature", "bin"])


_GAIN = f"{_HIST}, c AS (SELECT feature, bin, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s FROM h WINDOW o AS (PARTITION BY feature ORDER BY bin), a AS (PARTITION BY feature)), g AS (SELECT feature, bin, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM c WHERE nl >= 1 AND n - nl >= 1)"


@query(f"WITH {_GAIN} SELECT feature, bin, round(gain, 5) + 0.0 AS gain FROM g")
def t08_split_gains(spark, d):
    h = RT.histograms(*_nodes(spark, d)).where("n > 0")
    return RT.split_gains(h).select("feature", "bin", r("gain", 5).alias("gain"))


@query(f"WITH {_GAIN} SELECT feature, bin FROM g WHERE gain > 0 ORDER BY gain DESC, feature, bin LIMIT 1")
def t09_best_split(spark, d):
    return RT.best_splits(RT.histograms(*_nodes(spark, d)).where("n > 0")).select("feature", "bin")


@query(f"WITH {_LAMBDA} SELECT 1 AS node, round(sum(lam) / (sum(weight) + 1e-9::DOUBLE), 7) + 0.0 AS output FROM der")
def t10_leaf_output(spark, d):
    return RT.leaf_outputs(_nodes(spark, d)[0]).select("node", r("output", 7).alias("output"))


@query(f"WITH {S_SQL}, {F_SQL} SELECT CASE WHEN bin <= 7 THEN 2 ELSE 3 END::INT AS node, count(*) AS n FROM f WHERE feature = 1 GROUP BY 1")
def t12_route(spark, d):
    nodes, f = _nodes(spark, d)
    return RT.route(nodes, f, {1: (1, 7, 0.0)}).groupBy("node").agg(F.count("*").alias("n"))


@query("SELECT true AS falls")
def t01_boost(spark, d):
    s, f = ranking(spark, d)
    before = RT.ndcg_error(s.withColumn("score", F.lit(0.0)), GAINS).first().error
    _, out = RT.boost(s, f, RT.Config(gains=GAINS, trees=2, leaves=3, rate=0.5))
    return RT.ndcg_error(out, GAINS).select((F.col("error") < before).alias("falls"))


# ------------------------------------------------------------ networks


def digits(spark, d, classes: int = 10) -> DataFrame:
    target = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.pmod(F.col("label"), F.lit(classes))).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), target.alias("target"))


def _plain_network() -> NN.Network:
    w = np.array([[((i * 7 + j * 3) % 11 - 5) * 0.02 for j in range(64)] for i in range(10)])
    return NN.Network([NN.Layer(w, np.arange(10) * 0.01, "softmax")])


_FWD = """w AS (SELECT i, list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) * 0.02::DOUBLE) AS w FROM range(10) t(i)),
 z AS (SELECT vec_id, label, i, list_inner_product(embedding::DOUBLE[], w) + i * 0.01::DOUBLE AS z FROM embeddings, w),
 p AS (SELECT vec_id, label, i, exp(z - max(z) OVER m) / sum(exp(z - mx)) OVER m AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mx FROM z) WINDOW m AS (PARTITION BY vec_id))"""


@query(f"WITH {_FWD} SELECT vec_id, i::INT AS i, round(p, 8) AS p FROM p")
def n02_forward(spark, d):
    out = NN.predict(digits(spark, d), _plain_network())
    return out.select("vec_id", F.posexplode("output").alias("i", "p")).select("vec_id", "i", r("p").alias("p"))


@query(f"WITH {_FWD} SELECT round(-avg(ln(p)), 8) AS loss FROM p WHERE i = ((label % 10) + 10) % 10")
def n05_cross_entropy(spark, d):
    net = _plain_network()

    def batch(w, df):
        g, loss = net.with_flat(w).gradient(NN._matrix(df["features"]), NN._matrix(df["target"]))
        return g, loss, len(df)

    _, loss, n = O.summed_gradient(digits(spark, d), net.flat(), batch)
    return spark.createDataFrame([(round(loss / n, 8),)], "loss double")


@query(f"WITH {_FWD}, b AS (SELECT vec_id, any_value(label) AS label, arg_max(i, (p, -i)) AS i FROM p GROUP BY 1) SELECT round(avg(CASE WHEN i <> ((label % 10) + 10) % 10 THEN 1.0::DOUBLE ELSE 0 END), 8) AS error FROM b")
def n07_error_rate(spark, d):
    return NN.error_rate(NN.predict(digits(spark, d), _plain_network())).select(r("error").alias("error"))


@query("SELECT true AS falls")
def n04_train_network(spark, d):
    _, losses = NN.train_network(digits(spark, d), NN.Network.create([64, 16, 10]), O.AdaGrad(rate=0.05), 4)
    return spark.createDataFrame([(losses[-1] < losses[0],)], "falls boolean")


@query("SELECT true AS falls")
def n17_lbfgs(spark, d):
    _, losses = NN.train_network_lbfgs(digits(spark, d), NN.Network.create([64, 10], ["softmax"]), 3)
    return spark.createDataFrame([(losses[-1] < losses[0],)], "falls boolean")


@query("SELECT true AS falls")
def n09_train_rbm(spark, d):
    _, err = NN.train_rbm(digits(spark, d), NN.RBM.create(64, 16, "identity"), O.Momentum(rate=0.02, mu=0.5), 4)
    return spark.createDataFrame([(err[-1] < err[0],)], "falls boolean")


@query("SELECT 10 AS classes, true AS finite")
def n12_belief_network(spark, d):
    net, losses = NN.train_belief_network(digits(spark, d), [64, 12], 10, lambda: O.AdaGrad(rate=0.05), 1, 2)
    return spark.createDataFrame([(len(net.layers[-1].bias), bool(np.isfinite(losses).all()))], "classes int, finite boolean")


# ------------------------------------------------------------ samplers and scalars


@query("SELECT p_brand AS key, state, n FROM (SELECT p_brand, arg_min(p_size, (CASE WHEN c > u * t THEN 0 ELSE 1 END, p_size)) AS state, 1 AS n FROM (SELECT *, 0.4::DOUBLE AS u FROM (SELECT p_brand, p_size, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS c, sum(w) OVER (PARTITION BY p_brand) AS t FROM (SELECT p_brand, p_size, sum(p_retailprice) AS w FROM part GROUP BY 1, 2))) GROUP BY 1)")
def s04_weighted_draw(spark, d):
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_size").alias("state")).agg(F.sum("p_retailprice").alias("weight"))
    draws = w.select("key").distinct().withColumn("u", F.lit(0.4))
    return S.weighted_draw(w, draws, ["key"]).select("key", "state", F.lit(1).alias("n"))


@query(
    "SELECT kind, item::INT AS item, (1000 * weight / 10)::INT AS draws FROM (VALUES ('alias'), ('composite'), ('cumulative'), ('flat'), ('tree')) k(kind), "
    "(VALUES (0, 1.0), (1, 2.0), (2, 3.0), (3, 0.0), (4, 4.0)) w(item, weight)"
)
def s03_sampler_masses(spark, d):
    """Every sampler's draws over an even grid of base values: each item as often as its weight says."""
    w = np.array([1.0, 2.0, 3.0, 0.0, 4.0])
    kinds = {"flat": S.FlatDist(w), "cumulative": S.CumulativeDist(w), "alias": S.AliasTable(w), "tree": S.FTree(w), "composite": S.CompositeSampler(S.FlatDist(w / 2), S.FTree(w / 2))}
    rows = []
    for name, k in kinds.items():
        draws = np.bincount([k.sample_from((i + 0.5) / 1000 * k.norm()) for i in range(1000)], minlength=5)
        rows += [(name, i, int(n)) for i, n in enumerate(draws)]
    return spark.createDataFrame(rows, "kind string, item int, draws int")


@query("SELECT p_partkey AS id, round(lgamma(p_retailprice / 100), 6) AS lgamma FROM part")
def l15_lgamma(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r(lgamma(F.col("p_retailprice") / 100), 6).alias("lgamma"))


@query()
def t14_probit_erfc(spark, d):
    p = (F.col("p_size") + 0.5) / 60
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r(probit(p), 6).alias("probit"), r(erfc(p), 6).alias("erfc"))


@query("SELECT true AS equal")
def io06_factor_model_roundtrip(spark, d):
    """Scores after saving and loading equal those before."""
    xs, _, ys, m = L._setup(spark, d, "fm", True)
    checkpoint_dir(spark)
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/model-fm"
    persist.save_factor_model(spark, path, m)
    n = persist.load_factor_model(spark, path, "fm")
    a, b = FM.predict(xs, ys, m), FM.predict(xs, ys, n).withColumnRenamed("score", "again")
    return a.join(b, "sample").agg((F.max(F.abs(F.col("score") - F.col("again"))) < 1e-12).alias("equal"))


