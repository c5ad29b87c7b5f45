"""Graph, vertex and partitioner queries.

The graph: parts and suppliers as vertices (suppliers as -(key + 1)), line items
as edges part -> supplier with their quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partition as P
from ..operators import vertices as V
from ..operators.graph import Direction, Graph, attr_at, other_end, relative_direction
from .registry import query, table

PRIME = P.MIXING_PRIME
E_SQL = "e AS (SELECT l_partkey AS src, -(l_suppkey + 1) AS dst, l_quantity AS attr FROM lineitem)"
V_SQL = "v AS (SELECT p_partkey AS id, p_retailprice AS attr FROM part UNION ALL SELECT -(s_suppkey + 1), s_acctbal FROM supplier)"
T_SQL = f"{E_SQL}, {V_SQL}, t AS (SELECT e.src, e.dst, e.attr, s.attr AS src_attr, d.attr AS dst_attr FROM e JOIN v s ON s.id = e.src JOIN v d ON d.id = e.dst)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-(F.col("l_suppkey") + 1)).alias("dst"), F.col("l_quantity").alias("attr"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("attr"))
    s = table(spark, d, "supplier").select((-(F.col("s_suppkey") + 1)).alias("id"), F.col("s_acctbal").alias("attr"))
    return p.unionByName(s)


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(vertices(spark, d), edges(spark, d))


def r(c, n: int = 4):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def orders_graph(spark: SparkSession, d: str) -> Graph:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (-(F.col("o_orderkey") + 1)).alias("dst"), F.col("o_totalprice").alias("attr"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("attr"))
    return Graph(c, o)


# ------------------------------------------------------------ construction


@query(f"WITH {E_SQL}, {V_SQL}, k AS (SELECT * FROM v WHERE attr > 1000), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM k) SELECT ids.id, coalesce(k.attr, -1.0) AS attr FROM ids LEFT JOIN k USING (id)")
def gc1_graph_build(spark, d):
    twice = vertices(spark, d).where("attr > 1000")
    return Graph.build(twice.unionByName(twice), edges(spark, d), {"attr": -1.0}).vertices


@query(f"WITH {E_SQL} SELECT id, 7 AS attr FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)")
def gc2_from_edges(spark, d):
    return Graph.from_edges(edges(spark, d), 7).vertices


@query(f"WITH {E_SQL} SELECT src, dst, count(*) AS attr FROM e GROUP BY 1, 2")
def gc3_from_edge_tuples(spark, d):
    return Graph.from_edge_tuples(edges(spark, d), 0, unique=True).edges


@query("SELECT l_suppkey AS id, min(l_quantity) AS attr FROM lineitem GROUP BY 1")
def gc4_vertex_dedupe(spark, d):
    return V.dedupe(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("attr")))


@query(f"WITH {E_SQL} SELECT id, sum(n)::BIGINT AS attr FROM (SELECT src AS id, 1 AS n FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY 1")
def gc14_out_degree_graph(spark, d):
    return Graph.with_out_degrees(edges(spark, d)).vertices


# ------------------------------------------------------------ graph operators


@query(f"WITH {T_SQL} SELECT src, dst, count(*) AS n, round(sum(attr), 4) AS attr, any_value(src_attr) AS src_attr, any_value(dst_attr) AS dst_attr FROM t GROUP BY 1, 2")
def g01_triplets(spark, d):
    t = graph(spark, d).triplets()
    return t.groupBy("src", "dst").agg(F.count("*").alias("n"), r(F.sum("attr")).alias("attr"), F.first("src_attr").alias("src_attr"), F.first("dst_attr").alias("dst_attr"))


@query(f"WITH {V_SQL} SELECT id, round(attr * 2 + id, 4) AS attr FROM v")
def g02_map_vertices(spark, d):
    return graph(spark, d).map_vertices(attr=r(F.col("attr") * 2 + F.col("id"))).vertices


@query(f"WITH {E_SQL} SELECT src, dst, attr / 2 AS attr FROM e")
def g03_map_edges(spark, d):
    return graph(spark, d).map_edges(attr=F.col("attr") / 2).edges


@query(f"WITH {T_SQL} SELECT src, dst, round(attr * src_attr - dst_attr, 4) AS attr FROM t")
def g04_map_triplets(spark, d):
    return graph(spark, d).map_triplets(attr=r(F.col("attr") * F.col("src_attr") - F.col("dst_attr"))).edges


@query(f"WITH {E_SQL} SELECT dst AS src, src AS dst, attr FROM e")
def g05_reverse(spark, d):
    return graph(spark, d).reverse().edges


@query(f"WITH {T_SQL} SELECT src, dst, attr FROM t WHERE src_attr > 1200 AND dst_attr > 1200 AND attr < src_attr / 50")
def g06_subgraph(spark, d):
    return graph(spark, d).subgraph(F.col("attr") > 1200, F.col("attr") < F.col("src_attr") / 50).edges


@query(f"WITH {E_SQL} SELECT src, dst, attr FROM e WHERE (src, dst) IN (SELECT src, dst FROM e WHERE attr > 40)")
def g07_mask(spark, d):
    g = graph(spark, d)
    return g.mask(Graph(g.vertices, g.edges.where("attr > 40"))).edges


@query(f"WITH {E_SQL} SELECT src, dst, sum(attr) AS attr FROM e GROUP BY 1, 2")
def g08_group_edges(spark, d):
    return graph(spark, d).group_edges(attr=F.sum("attr")).edges


@query(f"WITH {T_SQL} SELECT id, round(sum(m), 3) AS msg FROM (SELECT src AS id, attr * dst_attr AS m FROM t UNION ALL SELECT dst, attr * src_attr FROM t) GROUP BY 1")
def g09_aggregate_messages(spark, d):
    m = graph(spark, d).aggregate_messages(F.sum, F.col("attr") * F.col("dst_attr"), F.col("attr") * F.col("src_attr"))
    return m.select("id", r("msg", 3).alias("msg"))


@query("SELECT o_custkey AS id, struct_pack(n := count(*), total := round(sum(o_totalprice), 2), top := max(o_totalprice)) IS NOT NULL AS ok, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1")
def g09_customer_orders(spark, d):
    """The flagship: each customer's orders as messages from order edges."""
    g = orders_graph(spark, d)
    merge = lambda m: F.struct(F.count(m).alias("n"), r(F.sum(m), 2).alias("total"), F.max(m).alias("top"))
    m = g.aggregate_messages(merge, to_src=F.col("attr"), fields="src")
    return m.select("id", F.col("msg").isNotNull().alias("ok"), "msg.n", "msg.total", "msg.top")


def _active(direction: Direction):
    ends = {"out": "src IN (SELECT id FROM a)", "in": "dst IN (SELECT id FROM a)", "both": "src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)", "either": "(src IN (SELECT id FROM a) OR dst IN (SELECT id FROM a))"}
    sql = f"WITH {E_SQL}, {V_SQL}, a AS (SELECT id FROM v WHERE attr > 1500) SELECT dst AS id, sum(attr) AS msg FROM e WHERE {ends[direction.value]} GROUP BY 1"

    def f(spark, d):
        g = graph(spark, d)
        return g.aggregate_messages(F.sum, to_dst=F.col("attr"), fields="none", active=g.vertices.where("attr > 1500"), direction=direction)

    f.__name__ = f"g10_active_{direction.value}"
    query(sql)(f)


for _d in Direction:
    _active(_d)


@query(f"WITH {E_SQL} SELECT id, max(m) AS msg FROM (SELECT src AS id, attr AS m FROM e WHERE attr > 25 UNION ALL SELECT dst, attr FROM e WHERE attr <= 25) GROUP BY 1")
def g11_map_reduce_triplets(spark, d):
    a = F.col("attr")
    return graph(spark, d).aggregate_messages(F.max, F.when(a > 25, a), F.when(a <= 25, a), fields="none")


@query(f"WITH {E_SQL}, {V_SQL}, g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1) SELECT id, coalesce(degree, 0) AS degree, attr FROM v LEFT JOIN g USING (id)")
def g12_outer_join_vertices(spark, d):
    g = graph(spark, d)
    return g.outer_join_vertices(g.degrees(Direction.OUT), degree=F.coalesce("degree", F.lit(0).cast("long")), attr=F.col("attr")).vertices


@query(f"WITH {E_SQL}, {V_SQL}, g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1) SELECT id, CASE WHEN degree IS NULL THEN attr ELSE round(attr + degree, 4) END AS attr FROM v LEFT JOIN g USING (id)")
def g13_join_vertices(spark, d):
    g = graph(spark, d)
    return g.join_vertices(g.degrees(Direction.OUT), attr=r(F.col("attr") + F.col("degree"))).vertices


@query("SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS num_vertices, (SELECT count(*) FROM lineitem) AS num_edges")
def g14_counts(spark, d):
    g = graph(spark, d)
    return g.vertices.agg(F.count("*").alias("num_vertices")).crossJoin(g.edges.agg(F.count("*").alias("num_edges")))  # one row each


def _degree(direction: Direction, sql: str):
    def f(spark, d):
        return graph(spark, d).degrees(direction)

    f.__name__ = f"g15_degrees_{direction.value}"
    query(f"WITH {E_SQL} {sql}")(f)


_degree(Direction.IN, "SELECT dst AS id, count(*) AS degree FROM e GROUP BY 1")
_degree(Direction.OUT, "SELECT src AS id, count(*) AS degree FROM e GROUP BY 1")
_degree(Direction.EITHER, "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")


@query(f"WITH {E_SQL}, {V_SQL}, g AS (SELECT src AS id, list_sort(list(dst)) AS neighbors FROM e GROUP BY 1) SELECT id, coalesce(list_aggregate(neighbors, 'string_agg', ','), '') AS neighbors FROM v LEFT JOIN g USING (id)")
def g16_neighbor_ids(spark, d):
    return graph(spark, d).collect_neighbor_ids(Direction.OUT).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {E_SQL}, {V_SQL}, g AS (SELECT e.dst AS id, count(*) AS n, min(e.src) AS first_id, round(sum(v.attr), 3) AS total FROM e JOIN v ON v.id = e.src GROUP BY 1) SELECT id, n, first_id, total FROM v LEFT JOIN g USING (id)")
def g17_neighbors(spark, d):
    n = graph(spark, d).collect_neighbors(Direction.IN)
    total = F.aggregate("neighbors", F.lit(0.0), lambda a, x: a + x["attr"])
    return n.select("id", F.when(F.col("neighbors").isNotNull(), F.size("neighbors").cast("long")).alias("n"), F.get("neighbors", F.lit(0))["id"].alias("first_id"), r(total, 3).alias("total"))


@query(f"WITH {E_SQL} SELECT src AS id, count(*) AS n, sum(attr) AS total, min(dst) AS first_dst FROM e GROUP BY 1")
def g18_collect_edges(spark, d):
    n = graph(spark, d).collect_edges(Direction.OUT)
    return n.select("id", F.size("edges").cast("long").alias("n"), F.aggregate("edges", F.lit(0.0), lambda a, x: a + x["attr"]).alias("total"), F.col("edges")[0]["dst"].alias("first_dst"))


@query(f"WITH {E_SQL}, {V_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT v.id, v.attr FROM v JOIN g USING (id) WHERE degree > 30")
def g19_filter(spark, d):
    prepare = lambda g: g.outer_join_vertices(g.degrees(), degree=F.col("degree"))
    return graph(spark, d).filter(prepare, vertex=F.col("degree") > 30).vertices


@query(
    f"WITH {V_SQL}, k AS (SELECT id, ((((id % 2147483647) + 2147483647) % 2147483647) * 48271 + 42 * 16807) % 2147483647 AS key FROM v) "
    "SELECT id FROM k ORDER BY key, id LIMIT 1"
)
def g20_pick_random_vertex(spark, d):
    g = graph(spark, d)
    return g.vertices.where(F.col("id") == F.lit(g.pick_random_vertex())).select("id")


@query("SELECT least(l_suppkey, l_partkey % 100) AS src, greatest(l_suppkey, l_partkey % 100) AS dst, sum(l_quantity) AS attr FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY 1, 2")
def g21_canonical_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_quantity").alias("attr"))
    return Graph.from_edges(e, 0).canonical_edges(attr=F.sum("attr"))


def _wrap_sql(x: str) -> str:
    m = f"((({x}::HUGEINT * {PRIME}) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616)"
    return f"abs(CASE WHEN {m} >= 9223372036854775808 THEN {m} - 18446744073709551616 ELSE {m} END)"


@query(f"WITH {E_SQL} SELECT pid, count(*) AS n, sum(attr) AS attr FROM (SELECT ({_wrap_sql('src')} % 8)::INT AS pid, attr FROM e) GROUP BY 1")
def g22_partition_by(spark, d):
    return graph(spark, d).partition_by("EdgePartition1D", 8).edges.groupBy("pid").agg(F.count("*").alias("n"), F.sum("attr").alias("attr"))


@query(f"WITH {T_SQL} SELECT src AS me, dst AS other, 'out' AS direction, src_attr AS mine, count(*) AS n FROM t GROUP BY 1, 2, 3, 4")
def g23_edge_views(spark, d):
    t = graph(spark, d).triplets()
    me = F.col("src")
    return t.select(me.alias("me"), other_end(me).alias("other"), relative_direction(me).alias("direction"), attr_at(me).alias("mine")).groupBy("me", "other", "direction", "mine").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ keyed vertices


@query(f"WITH {V_SQL} SELECT id, attr FROM v WHERE attr > 1000")
def v01_filter(spark, d):
    return V.filter_vertices(vertices(spark, d), F.col("attr") > 1000)


@query(f"WITH {V_SQL} SELECT id, attr * 2 AS attr FROM v")
def v02_map_values(spark, d):
    return V.map_values(vertices(spark, d), attr=F.col("attr") * 2)


@query(f"WITH {V_SQL} SELECT id, attr FROM v WHERE id NOT IN (SELECT id FROM v WHERE attr > 1500)")
def v03_minus(spark, d):
    v = vertices(spark, d)
    return V.minus(v, v.where("attr > 1500"))


@query(f"WITH {V_SQL} SELECT id, floor(attr / 100) AS attr FROM v WHERE floor(attr / 100) <> attr")
def v04_diff(spark, d):
    v = vertices(spark, d)
    return V.diff(v, v.select("id", F.floor(F.col("attr") / 100).cast("double").alias("attr")))


@query("SELECT c_custkey AS id, c_acctbal + coalesce(n, 0) AS attr FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def v05_left_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return V.left_join(c, o, attr=F.col("c_acctbal") + F.coalesce("n", F.lit(0)))


@query("SELECT c_custkey AS id, c_acctbal + n AS attr FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def v06_inner_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return V.inner_join(c, o, attr=F.col("c_acctbal") + F.col("n"))


@query("SELECT l_partkey AS id, sum(l_quantity) AS total, max(l_quantity) AS top FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def v07_aggregate_using_index(spark, d):
    index = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("m"))
    return V.aggregate_using_index(index, m, total=F.sum("m"), top=F.max("m"))


@query(f"WITH {V_SQL} SELECT id, CASE WHEN attr > 1500 THEN -attr ELSE attr END AS attr FROM v")
def v08_inner_join_keep_left(spark, d):
    v = vertices(spark, d)
    return V.inner_join_keep_left(v, v.where("attr > 1500").select("id", (-F.col("attr")).alias("attr")))


@query(f"WITH {E_SQL}, g AS (SELECT src, dst, max(attr) AS top FROM e GROUP BY 1, 2) SELECT e.src, e.dst, e.attr / g.top AS attr FROM e JOIN g USING (src, dst) WHERE e.attr > 10")
def v09_edge_inner_join(spark, d):
    e = edges(spark, d)
    return V.edge_inner_join(e.where("attr > 10"), e.groupBy("src", "dst").agg(F.max("attr").alias("top")), attr=F.col("attr") / F.col("top"))


@query(f"WITH {V_SQL} SELECT id, attr FROM v UNION ALL SELECT id, 0.0 FROM v WHERE id < 0")
def v12_union(spark, d):
    v = vertices(spark, d)
    return v.unionByName(v.where("id < 0").select("id", F.lit(0.0).alias("attr")))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem")
def v13_distinct(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()


@query("SELECT l_suppkey AS id, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def v14_reduce_by_key(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("SELECT o_orderkey AS id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS held FROM orders")
def v15_membership(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    probe, training = o.join(c, "o_custkey", "left_semi"), o.join(c, "o_custkey", "left_anti")
    return probe.select("id", F.lit(True).alias("held")).unionByName(training.select("id", F.lit(False).alias("held")))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def v16_number_rows(spark, d):
    return V.number_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ["id"])


@query("SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_quantity::INT, ' ' ORDER BY l_quantity DESC, l_linenumber) AS line FROM lineitem GROUP BY 1")
def v17_sorted_record(spark, d):
    item = F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    show = F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), (-s["q"]).cast("int").cast("string")))
    return g.select("id", F.array_join(show, " ").alias("line"))


@query("SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS top, round(sum(o_totalprice), 2) AS total FROM orders")
def v18_actions(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("top"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def v19_bernoulli(spark, d):
    return V.bernoulli(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 0.1, 3)


# ------------------------------------------------------------ partitioners


@query(f"WITH {E_SQL} SELECT DISTINCT src, dst, ({_wrap_sql('src')} % 7)::INT AS pid FROM e")
def p1_edge_1d(spark, d):
    return edges(spark, d).withColumn("pid", P.edge_1d(7)).select("src", "dst", "pid").distinct()


@query(f"WITH {E_SQL} SELECT DISTINCT src, dst, ((({_wrap_sql('src')} % 4) * 4 + ({_wrap_sql('dst')} % 4)) % 12)::INT AS pid FROM e")
def p2_edge_2d(spark, d):
    return edges(spark, d).withColumn("pid", P.edge_2d(12)).select("src", "dst", "pid").distinct()


@query(f"WITH {E_SQL} SELECT src, dst, 1 AS parts FROM e GROUP BY 1, 2")
def p3_random_cut(spark, d):
    return edges(spark, d).withColumn("pid", P.random_cut(8)).groupBy("src", "dst").agg(F.count_distinct("pid").cast("int").alias("parts"))


@query("SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, 1 AS parts FROM lineitem GROUP BY 1, 2")
def p4_canonical_cut(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).withColumn("pid", P.canonical_cut(8))
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct("pid").cast("int").alias("parts"))


_DEG_SQL = f"{E_SQL}, g AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), x AS (SELECT e.*, a.d AS ds, b.d AS dd FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst)"


@query(f"WITH {_DEG_SQL} SELECT pid, count(*) AS n, sum(attr) AS attr FROM (SELECT ({_wrap_sql('(CASE WHEN ds < dd THEN src ELSE dst END)')} % 8)::INT AS pid, attr FROM x) GROUP BY 1")
def p6_low_degree(spark, d):
    return P.by_low_degree(edges(spark, d), 8).groupBy("pid").agg(F.count("*").alias("n"), F.sum("attr").alias("attr"))


@query(f"WITH {E_SQL} SELECT pid, count(*) AS n, sum(attr) AS attr FROM (SELECT ({_wrap_sql('dst')} % 8)::INT AS pid, attr FROM e) GROUP BY 1")
def p7_by_destination(spark, d):
    return P.by_destination(edges(spark, d), 8).groupBy("pid").agg(F.count("*").alias("n"), F.sum("attr").alias("attr"))


@query(
    f"WITH {_DEG_SQL}, k AS (SELECT *, CASE WHEN ds >= dd THEN src ELSE dst END AS key FROM x), o AS (SELECT *, row_number() OVER (ORDER BY key, src, dst, attr) - 1 AS p, count(*) OVER () AS total FROM k) "
    "SELECT pid, count(*) AS n, sum(attr) AS attr FROM (SELECT (p // ceil(total / 8.0)::BIGINT)::INT AS pid, attr FROM o) GROUP BY 1"
)
def p8_balanced_by_key(spark, d):
    return P.balanced_by_key(edges(spark, d), 8).groupBy("pid").agg(F.count("*").alias("n"), F.sum("attr").alias("attr"))


@query()
def p9_label_propagation(spark, d):
    return P.by_label_propagation(edges(spark, d), 8).groupBy("pid").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS vertices FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT -(l_suppkey + 1) FROM lineitem)")
def p10_vertex_builder(spark, d):
    return Graph.from_edges(edges(spark, d), 0).vertices.agg(F.count("*").alias("vertices"))


_DEALT_SQL = {
    "byterm": f"SELECT ({_wrap_sql('src')} % 8)::INT AS pid FROM e",
    "bydoc": f"SELECT ({_wrap_sql('dst')} % 8)::INT AS pid FROM e",
    "edge2d": f"SELECT ((({_wrap_sql('src')} % 3) * 3 + ({_wrap_sql('dst')} % 3)) % 8)::INT AS pid FROM e",
    "dbh": f"SELECT ({_wrap_sql('(CASE WHEN ds < dd THEN src ELSE dst END)')} % 8)::INT AS pid FROM x",
    "bbr": "SELECT ((row_number() OVER (ORDER BY CASE WHEN ds >= dd THEN src ELSE dst END, src, dst, attr) - 1) // ceil((SELECT count(*) FROM x) / 8.0)::BIGINT)::INT AS pid FROM x",
    # where an edge lies, or chance, decides: only that every edge is dealt
    "direct": "SELECT -1 AS pid FROM e",
    "vsdlp": "SELECT -1 AS pid FROM e",
}


@query(f"WITH {_DEG_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS name, pid, count(*) AS n FROM ({sql}) GROUP BY pid" for name, sql in _DEALT_SQL.items()))
def p11_strategies(spark, d):
    """Edges of each part, by the names of all seven strategies."""
    out = None
    for name in _DEALT_SQL:
        e = P.partition_edges(name, edges(spark, d), 8)
        if name in ("direct", "vsdlp"):
            e = e.where("pid between 0 and 7").withColumn("pid", F.lit(-1))
        n = e.groupBy(F.col("pid").cast("int").alias("pid")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "pid", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT k::INT AS part, ((SELECT count(*) FROM orders) // 7 + CASE WHEN k < (SELECT count(*) FROM orders) % 7 THEN 1 ELSE 0 END)::BIGINT AS size FROM range(7) t(k)")
def p12_ranges(spark, d):
    at = P.ranges(table(spark, d, "orders").count(), 7)
    return spark.createDataFrame([(k, at[k + 1] - at[k]) for k in range(7)], "part int, size long")


@query(f"WITH {E_SQL}, q AS (SELECT src, ({_wrap_sql('dst')} % 8)::INT AS pid FROM e) SELECT src AS id, count(DISTINCT pid) AS copies FROM q GROUP BY 1")
def p_replication(spark, d):
    """Copies of each source vertex under a partitioning: the cost of a vertex cut."""
    return P.by_destination(edges(spark, d), 8).groupBy(F.col("src").alias("id")).agg(F.count_distinct("pid").alias("copies"))



