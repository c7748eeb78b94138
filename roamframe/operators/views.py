"""Adapters: a view of some labels as one weighted graph, and wrapped graphs with derived columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.graph import Graph
from roamframe.route import Route


class GraphView:
    """Selected labels as one graph; where two labels hold an edge, the first listed counts.

    An edge's weight is its document if that is a number, ``null_weight`` if it has none, and
    ``missing_weight`` where there is no edge.  Edits return a new view; added edges get the first label.
    """

    def __init__(self, graph: Graph, labels: Sequence[str], null_weight: float = 1.0, missing_weight: float = float("inf")):
        self.graph, self.label_list, self.null_weight, self.missing_weight = graph, list(labels), null_weight, missing_weight

    def _new(self, graph: Graph) -> GraphView:
        return GraphView(graph, self.label_list, self.null_weight, self.missing_weight)

    def nodes(self) -> DataFrame:
        return self.graph.v.select("vid")

    def edges(self) -> DataFrame:
        """Distinct (src, dst)."""
        return self.graph.scan(self.label_list).select("src", "dst").distinct()

    def has_node(self, vid) -> bool:
        return self.graph.has_vertex(vid)

    def has_edge(self, src, dst) -> bool:
        return not self.edges().filter((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).limit(1).isEmpty()

    def successors(self, vid) -> DataFrame:
        return self.edges().filter(F.col("src") == F.lit(vid)).select(F.col("dst").alias("vid"))

    def predecessors(self, vid) -> DataFrame:
        return self.edges().filter(F.col("dst") == F.lit(vid)).select(F.col("src").alias("vid"))

    def out_edges(self, vid) -> DataFrame:
        return self.edges().filter(F.col("src") == F.lit(vid))

    def in_edges(self, vid) -> DataFrame:
        return self.edges().filter(F.col("dst") == F.lit(vid))

    def _degrees(self, end: str, name: str) -> DataFrame:
        counts = self.edges().groupBy(F.col(end).alias("vid")).agg(F.count("*").alias(name))
        return self.nodes().join(counts, "vid", "left").select("vid", F.coalesce(name, F.lit(0).cast("long")).alias(name))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst", "in_degree")

    def transpose(self) -> GraphView:
        return self._new(self.graph.transposed(self.label_list))

    def weights(self, pairs: DataFrame | None = None) -> DataFrame:
        """(src, dst, weight) of all edges, or of given pairs(src, dst)."""
        rank = F.array_position(F.array(*[F.lit(x) for x in self.label_list]), F.col("label"))
        rows = self.graph.e.filter(F.col("label").isin(self.label_list))
        undirected = [k for k, t in self.graph.edge_types.items() if t == "undirected"]
        rows = rows.select("src", "dst", "doc", "label").unionByName(rows.filter(F.col("label").isin(undirected) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "doc", "label"))
        best = rows.groupBy("src", "dst").agg(F.min_by(F.struct("doc"), rank)["doc"].alias("doc"))
        known = best.select("src", "dst", F.when(F.col("doc").isNull(), F.lit(self.null_weight)).otherwise(F.expr("try_cast(doc as double)")).alias("w"), F.lit(True).alias("there"))
        if pairs is None:
            return known.select("src", "dst", F.col("w").alias("weight"))
        return pairs.select("src", "dst").join(known, ["src", "dst"], "left").select("src", "dst", F.when(F.col("there"), F.col("w")).otherwise(F.lit(self.missing_weight)).alias("weight"))

    def attrs(self) -> DataFrame:
        """(vid, doc)."""
        return self.graph.v.select("vid", "doc")

    def add_nodes(self, nodes: DataFrame) -> GraphView:
        return self._new(self.graph.merge(Graph(nodes.select("vid").withColumn("doc", F.lit(None).cast(dict(self.graph.v.dtypes)["doc"])), self.graph.e.limit(0))))

    def add_edges(self, edges: DataFrame) -> GraphView:
        return self._new(self.graph.builder().add_edges(self.label_list[0], edges).freeze())

    def remove_nodes(self, ids: DataFrame) -> GraphView:
        return self._new(self.graph.remove_vertices(ids))

    def remove_edges(self, pairs: DataFrame) -> GraphView:
        keys = self.graph.e.filter(F.col("label").isin(self.label_list)).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        return self._new(self.graph.remove_edges(keys.select("label", "src", "dst")))

    def add_attr(self, docs: DataFrame) -> GraphView:
        return self._new(self.graph.set_documents(docs))

    def remove_attr(self, ids: DataFrame) -> GraphView:
        return self._new(self.graph.remove_documents(ids))

    def remove_all(self) -> GraphView:
        return self._new(self.graph.remove_vertices(self.graph.v))


def doc_weight(doc: Column, field: str = "weight") -> Column:
    """An edge weight that is a field of the document."""
    return doc.getField(field)


def wrap_graph(graph: Graph, columns: dict[str, Callable[[Column], Column]] | None = None, traversals: dict[str, Callable[[Route], Route]] | None = None) -> WrappedGraph:
    return WrappedGraph(graph, columns or {}, traversals or {})


class WrappedGraph(Graph):
    """A graph whose edges answer computed columns, and whose routes answer named traversals."""

    def __init__(self, graph: Graph, columns: dict[str, Callable[[Column], Column]], traversals: dict[str, Callable[[Route], Route]]):
        super().__init__(graph.v, graph.e, graph.edge_types, {**graph.settings, "traversals": {**graph.traversals, **traversals}})
        self.columns = dict(columns)

    def computed(self, route: Route, name: str) -> DataFrame:
        """The route's rows with a computed column, null where the document is."""
        return route.with_documents().withColumn(name, self.columns[name](F.col("doc")))


def single(step: Callable[[Route], Route]) -> Callable[[Route], DataFrame]:
    """A traversal with one result per vertex: (vid, to), null where there is none, the smallest where there are several."""

    def run(route: Route) -> DataFrame:
        lists = route.grouped(step)
        return lists.select(F.col("element").alias("vid"), F.get("items", F.lit(0)).alias("to"))

    return run
