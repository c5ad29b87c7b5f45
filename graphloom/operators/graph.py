"""Property graphs as a pair of DataFrames.

``vertices`` has a unique ``id`` and attribute columns; ``edges`` has ``src``,
``dst`` and attribute columns and may repeat pairs (a directed multigraph).  In
expressions over triplets, a vertex attribute ``a`` appears as ``src_a`` and
``dst_a``; edge attributes keep their names.

Every operator is one logical plan: Catalyst prunes unused attributes and picks
the joins, and aggregations combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partition import partition_id


class Direction(Enum):
    IN = "in"
    OUT = "out"
    EITHER = "either"
    BOTH = "both"


def edge_ids(edges: DataFrame) -> DataFrame:
    """Distinct ids that edges mention: one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


class Graph:
    """A directed multigraph."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    # ------------------------------------------------------------ construction

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame, default: dict[str, object]) -> Graph:
        """Repeated ids keep their least row; ids that only edges have get ``default``."""
        attrs = [c for c in vertices.columns if c != "id"]
        one = vertices.groupBy("id").agg(F.min(F.struct(*attrs)).alias("_v")).select("id", F.col("_v"), F.lit(True).alias("_known"))
        ids = edge_ids(edges).unionByName(vertices.select("id")).distinct()
        v = ids.join(one, "id", "left").select(
            "id", *(F.when(F.col("_known"), F.col("_v").getField(a)).otherwise(F.lit(default.get(a))).alias(a) for a in attrs)
        )
        return Graph(v, edges)

    @staticmethod
    def from_edges(edges: DataFrame, default: object, name: str = "attr") -> Graph:
        return Graph(edge_ids(edges).withColumn(name, F.lit(default)), edges)

    @staticmethod
    def from_edge_tuples(pairs: DataFrame, default: object, unique: bool = False) -> Graph:
        """Edge attribute 1; with ``unique``, repeated pairs are summed."""
        edges = pairs.select("src", "dst").withColumn("attr", F.lit(1).cast("long"))
        if unique:
            edges = edges.groupBy("src", "dst").agg(F.sum("attr").alias("attr"))
        return Graph.from_edges(edges, default)

    @staticmethod
    def with_out_degrees(edges: DataFrame) -> Graph:
        """Vertices that have edges, with their out-degree."""
        v = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).cast("long").alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).cast("long").alias("n")))).alias("x"))
        return Graph(v.groupBy("x.id").agg(F.sum("x.n").alias("attr")), edges)

    # ------------------------------------------------------------ views and maps

    def _end(self, which: str) -> DataFrame:
        return self.vertices.select(*(F.col(c).alias(which if c == "id" else f"{which}_{c}") for c in self.vertices.columns))

    def triplets(self, src: bool = True, dst: bool = True) -> DataFrame:
        """Edges with the attributes of the ends that are asked for."""
        t = self.edges
        if src:
            t = t.join(self._end("src"), "src")
        if dst:
            t = t.join(self._end("dst"), "dst")
        return t

    def map_vertices(self, **columns: Column) -> Graph:
        return Graph(self.vertices.select("id", *(c.alias(k) for k, c in columns.items())), self.edges)

    def map_edges(self, **columns: Column) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst", *(c.alias(k) for k, c in columns.items())))

    def map_triplets(self, src: bool = True, dst: bool = True, **columns: Column) -> Graph:
        return Graph(self.vertices, self.triplets(src, dst).select("src", "dst", *(c.alias(k) for k, c in columns.items())))

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def subgraph(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices that pass; edges both of whose ends pass and that pass themselves."""
        if vertex is None and edge is None:
            return self
        kept = Graph(self.vertices if vertex is None else self.vertices.where(vertex), self.edges)
        t = kept.triplets() if edge is not None else kept.triplets_ids()
        if edge is not None:
            t = t.where(edge)
        return Graph(kept.vertices, t.select(*self.edges.columns))

    def triplets_ids(self) -> DataFrame:
        """Edges both of whose ends are vertices."""
        v = self.vertices.select("id")
        return self.edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def mask(self, other: Graph) -> Graph:
        """Vertices and edges that ``other`` has too, with this graph's attributes."""
        return Graph(self.vertices.join(other.vertices, "id", "left_semi"), self.edges.join(other.edges, ["src", "dst"], "left_semi"))

    def filter(self, preprocess: Callable[[Graph], Graph], vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Mask by the part of a transformed graph that passes."""
        return self.mask(preprocess(self).subgraph(vertex, edge))

    def group_edges(self, **merge: Column) -> Graph:
        """One edge for each pair; no partitioning is needed first."""
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(*(c.alias(k) for k, c in merge.items())))

    def canonical_edges(self, **merge: Column) -> DataFrame:
        """Edges with src < dst (loops dropped), merged by pair."""
        e = self.edges.where("src <> dst")
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        rest = [c for c in e.columns if c not in ("src", "dst")]
        return e.select(low.alias("src"), high.alias("dst"), *rest).groupBy("src", "dst").agg(*(c.alias(k) for k, c in merge.items()))

    # ------------------------------------------------------------ aggregation

    def aggregate_messages(
        self, merge: Callable[[Column], Column], to_src: Column | None = None, to_dst: Column | None = None,
        fields: str = "all", active: DataFrame | None = None, direction: Direction = Direction.EITHER,
    ) -> DataFrame:
        """(id, msg): messages over triplets, merged by receiver.

        ``fields`` names the ends whose attributes the messages use: none, src,
        dst or all.  With ``active`` (a frame of ids) only edges with an active
        end take part: OUT the source, IN the destination, BOTH both, EITHER one.
        """
        g = self if active is None else Graph(self.vertices, active_edges(self.edges, active, direction))
        t = g.triplets(fields in ("src", "all"), fields in ("dst", "all"))
        sends = []
        if to_src is not None:
            sends.append(F.struct(F.col("src").alias("id"), to_src.alias("m")))
        if to_dst is not None:
            sends.append(F.struct(F.col("dst").alias("id"), to_dst.alias("m")))
        msgs = t.select(F.explode(F.array(*sends)).alias("x")).select("x.id", "x.m") if len(sends) > 1 else t.select(sends[0].alias("x")).select("x.id", "x.m")
        return msgs.where("m is not null").groupBy("id").agg(merge(F.col("m")).alias("msg"))

    def outer_join_vertices(self, table: DataFrame, **columns: Column) -> Graph:
        """Vertices with columns of a left join; unmatched vertices see nulls."""
        v = self.vertices.join(table, "id", "left")
        return Graph(v.select("id", *(c.alias(k) for k, c in columns.items())), self.edges)

    def join_vertices(self, table: DataFrame, **columns: Column) -> Graph:
        """As ``outer_join_vertices``, but unmatched vertices keep their attributes."""
        v = self.vertices.join(table.withColumn("_hit", F.lit(True)), "id", "left")
        keep = [c for c in self.vertices.columns if c not in ("id", *columns)]
        new = (F.when(F.col("_hit"), c).otherwise(self.vertices[k]).alias(k) for k, c in columns.items())
        return Graph(v.select("id", *(self.vertices[c] for c in keep), *new), self.edges)

    # ------------------------------------------------------------ degrees and neighbours

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def degrees(self, direction: Direction = Direction.EITHER) -> DataFrame:
        """(id, degree); vertices of degree 0 are absent; a loop counts twice."""
        ends = {Direction.IN: F.col("dst"), Direction.OUT: F.col("src")}
        id_ = ends[direction] if direction in ends else F.explode(F.array("src", "dst"))
        return self.edges.select(id_.alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

    def _around(self, direction: Direction) -> DataFrame:
        """(id, other, edge attributes) as seen from each end."""
        if direction is Direction.BOTH:
            raise ValueError("BOTH is not a direction of neighbours; use EITHER")
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        views = []
        if direction in (Direction.OUT, Direction.EITHER):
            views.append(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), "src", "dst", *rest))
        if direction in (Direction.IN, Direction.EITHER):
            views.append(F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), "src", "dst", *rest))
        return self.edges.select(F.explode(F.array(*views)).alias("x")).select("x.*")

    def collect_neighbor_ids(self, direction: Direction) -> DataFrame:
        """(id, neighbors): sorted ids, one for each edge; an empty list where there is none."""
        got = self._around(direction).groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("neighbors"))
        return self.vertices.select("id").join(got, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))

    def collect_neighbors(self, direction: Direction) -> DataFrame:
        """(id, neighbors): structs of id and attributes, sorted."""
        attrs = [c for c in self.vertices.columns if c != "id"]
        other = self.vertices.select(F.col("id").alias("other"), *attrs)
        got = self._around(direction).select("id", "other").join(other, "other")
        got = got.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), *attrs))).alias("neighbors"))
        return self.vertices.select("id").join(got, "id", "left")

    def collect_edges(self, direction: Direction) -> DataFrame:
        """(id, edges) of the vertices that have edges."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self._around(direction).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", *rest))).alias("edges"))

    def pick_random_vertex(self, seed: int = 42) -> object:
        """The id whose key is least under a congruential step with a seed (ties: least id); only one row meets the driver."""
        key = F.pmod(F.pmod(F.col("id").cast("long"), F.lit(2**31 - 1)) * 48271 + seed * 16807, F.lit(2**31 - 1))
        row = self.vertices.select(F.min(F.struct(key.alias("key"), "id")).alias("x")).first()
        return None if row.x is None else row.x["id"]

    def partition_by(self, strategy: str, parts: int) -> Graph:
        """Edges with their partition number, dealt to partitions by it."""
        e = self.edges.withColumn("pid", partition_id(strategy, parts))
        return Graph(self.vertices, e.repartitionById(parts, F.col("pid").cast("int")))


def active_edges(edges: DataFrame, active: DataFrame, direction: Direction) -> DataFrame:
    """Edges with active ends; semi-joins, so active ids may repeat."""
    ids = active.select("id")
    s, d = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    if direction is Direction.OUT:
        return edges.join(s, "src", "left_semi")
    if direction is Direction.IN:
        return edges.join(d, "dst", "left_semi")
    if direction is Direction.BOTH:
        return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi")
    on = ids.distinct().withColumn("_on", F.lit(True))
    t = edges.join(on.select(F.col("id").alias("src"), F.col("_on").alias("_s")), "src", "left").join(on.select(F.col("id").alias("dst"), F.col("_on").alias("_d")), "dst", "left")
    return t.where("_s or _d").select(*edges.columns)


def other_end(id_: Column) -> Column:
    """The id at the other end of an edge; an error if ``id_`` is at neither."""
    return F.when(F.col("src") == id_, F.col("dst")).when(F.col("dst") == id_, F.col("src")).otherwise(F.raise_error(F.lit("the vertex is at neither end")).cast("long"))


def relative_direction(id_: Column) -> Column:
    return F.when(F.col("src") == id_, F.lit("out")).when(F.col("dst") == id_, F.lit("in"))


def attr_at(id_: Column, name: str = "attr") -> Column:
    """The attribute of a triplet's vertex ``id_``."""
    return F.when(F.col("src") == id_, F.col(f"src_{name}")).when(F.col("dst") == id_, F.col(f"dst_{name}"))
