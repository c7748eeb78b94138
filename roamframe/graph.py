"""Property graphs as two DataFrames.

``vertices(vid, kind, doc)`` is unique on vid, ``edges(label, src, dst, doc)`` on the three
keys.  A graph is immutable: every change returns a new one, and nothing runs until a
result is asked for.  Labels declared undirected are stored with the smaller end first and
seen from both ends.

Where this engine follows the documented intent of the model rather than an accident:
a null vertex document never erases one; removing an edge leaves its endpoints in the graph only if
they have a document or another edge; predicates on recursive traversals are always honoured;
round-robin merging never invents nulls; siblings leave out only the element itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.plans.scratch import cut, dealt

#: ``Graph.cached`` deals edges out by an end from this number on; fewer are joined as they are.
DEALT_EDGES = 1 << 18

if TYPE_CHECKING:
    from roamframe.route import Route

DAG, DIGRAPH, UNDIRECTED = "dag", "digraph", "undirected"
Labels = str | Iterable[str] | None
OnMissing = Callable[[list[tuple], Sequence, Sequence], Iterable[tuple]]


def label_list(labels: Labels) -> list[str] | None:
    if labels is None:
        return None
    return [labels] if isinstance(labels, str) else list(labels)


class VertexNotFound(LookupError):
    """No such vertex, and no default was given."""


class MissingDocuments(ValueError):
    """A list of documents is not as long as the list of vertices it goes with."""


class CyclicGraph(ValueError):
    """A label declared acyclic has a cycle."""


class Graph:
    def __init__(self, vertices: DataFrame, edges: DataFrame, edge_types: dict[str, str] | None = None, settings: dict | None = None):
        if "kind" not in vertices.columns:
            vertices = vertices.withColumn("kind", F.lit(None).cast("string"))
        if "doc" not in vertices.columns:
            vertices = vertices.withColumn("doc", F.lit(None).cast("string"))
        if "doc" not in edges.columns:
            edges = edges.withColumn("doc", F.lit(None).cast("string"))
        self.v, self.e = vertices.select("vid", "kind", "doc"), edges.select("label", "src", "dst", "doc")
        self.edge_types, self.settings = dict(edge_types or {}), dict(settings or {})
        self.traversals: dict[str, Callable[[Route], Route]] = dict(self.settings.pop("traversals", {}))

    # -- making graphs

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str = "string") -> Graph:
        return cls(spark.createDataFrame([], f"vid {id_type}, kind string, doc string"), spark.createDataFrame([], f"label string, src {id_type}, dst {id_type}, doc string"))

    @classmethod
    def from_edges(cls, edges: DataFrame, label: str | None = None, vertices: DataFrame | None = None, **more) -> Graph:
        """A graph over edges(src, dst[, label, doc]); vertices are the ends, and those given."""
        if label is not None:
            edges = edges.withColumn("label", F.lit(label))
        ends = edges.select(F.col("src").alias("vid")).unionByName(edges.select(F.col("dst").alias("vid"))).distinct()
        if vertices is not None:
            wide = vertices.select("vid", F.col("kind") if "kind" in vertices.columns else F.lit(None).cast("string").alias("kind"), F.col("doc") if "doc" in vertices.columns else F.lit(None).cast("string").alias("doc"), F.lit(True).alias("__own"))
            ends = ends.join(wide, "vid", "full_outer").select("vid", "kind", "doc")
        return cls(ends, edges, **more)

    @classmethod
    def from_triples(cls, triples: DataFrame, label: str = "to") -> Graph:
        """Edges(src, weight, dst) with the weight as document; counts are in the settings."""
        graph = cls.from_edges(triples.select("src", "dst", F.col("weight").alias("doc")), label)
        graph.settings |= {"vertex_count": graph.v, "edge_count": graph.e}
        return graph

    def builder(self) -> GraphBuilder:
        """A builder that starts from this graph."""
        return GraphBuilder(self.spark, self)

    def _with(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, edge_types: dict[str, str] | None = None) -> Graph:
        return Graph(self.v if vertices is None else vertices, self.e if edges is None else edges, self.edge_types if edge_types is None else edge_types, {**self.settings, "traversals": self.traversals})

    @property
    def spark(self) -> SparkSession:
        return self.e.sparkSession

    def cached(self, by: str | None = None) -> Graph:
        """Both tables written once to the shared folder and reread, for loops over them.

        ``by`` deals many edges out by that end and sorts them first, so that joins on it don't shuffle them again.
        """
        edges = cut(self.e)
        if by is not None and edges.count() >= DEALT_EDGES:
            edges = dealt(edges, by)
        return self._with(cut(self.v), edges)

    def __repr__(self) -> str:
        return f"Graph(edge_types={self.edge_types}, settings={sorted(self.settings)})"

    # -- scans and lookups

    def scan(self, labels: Labels = None) -> DataFrame:
        """edges(label, src, dst) in traversal direction; undirected labels appear both ways."""
        names = label_list(labels)
        rows = self.e.select("label", "src", "dst")
        if names is not None:
            rows = rows.filter(F.col("label").isin(names))
        both = [k for k, t in self.edge_types.items() if t == UNDIRECTED and (names is None or k in names)]
        if both:
            rows = rows.unionByName(rows.filter(F.col("label").isin(both) & (F.col("src") != F.col("dst"))).select("label", F.col("dst").alias("src"), F.col("src").alias("dst")))
        return rows

    def V(self, kind: str | Callable[[Column], Column] | None = None) -> Route:
        from roamframe.route import Route

        rows = self.v
        if kind is not None:
            rows = rows.filter(kind(F.col("kind")) if callable(kind) else F.col("kind").eqNullSafe(kind))
        return Route(self, rows.select("vid"), "vertex")

    def touching(self, labels: Labels) -> Route:
        """Distinct vertices at either end of an edge with one of the labels."""
        from roamframe.route import Route

        rows = self.e if labels is None else self.e.filter(F.col("label").isin(label_list(labels)))
        return Route(self, rows.select(F.col("src").alias("vid")).unionByName(rows.select(F.col("dst").alias("vid"))).distinct(), "vertex")

    def E(self, labels: Labels = None) -> Route:
        """All edges, or those with the labels, each once and used forward."""
        from roamframe.route import Route

        rows = self.e if labels is None else self.e.filter(F.col("label").isin(label_list(labels)))
        return Route(self, rows.select("label", "src", "dst", F.lit(True).alias("fwd")), "edge")

    def route(self, ids: DataFrame | Sequence) -> Route:
        """A route over given ids, in their order and with repeats, whether they exist or not."""
        from roamframe.route import Route

        if not isinstance(ids, DataFrame):
            kind = dict(self.v.dtypes)["vid"]
            return Route(self, self.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"vid {kind}, __o0 int"), "vertex", order=("__o0",))
        return Route(self, ids, "vertex")

    def get_vertex(self, vid) -> Route:
        """A handle, whether the vertex exists or not."""
        return self.route([vid])

    def get_vertex_or(self, vid, default=None) -> Route:
        """The vertex if it exists; else the default's handle, or VertexNotFound without one."""
        if self.has_vertex(vid):
            return self.get_vertex(vid)
        if default is None:
            raise VertexNotFound(vid)
        return self.get_vertex(default)

    def reload(self, route: Route) -> Route:
        """The vertices of another graph's route that exist here."""
        from roamframe.route import Route

        return Route(self, route.df.join(self.v.select("vid"), "vid", "left_semi"), "vertex", route.scope, route.order)

    def has_vertex(self, vid, labels: Labels = None) -> bool:
        rows = self.v if labels is None else self.touching(labels).df
        return not rows.filter(F.col("vid") == F.lit(vid)).limit(1).isEmpty()

    def get_edge(self, label: str, src, dst) -> Route:
        """The edge with these keys, or nothing."""
        route = self.E(label)
        keys = F.struct(F.lit(src), F.lit(dst))
        hit = F.struct("src", "dst") == keys
        if self.edge_types.get(label) == UNDIRECTED:
            hit = hit | (F.struct("dst", "src") == keys)
        return route.filter(hit)

    def labels(self) -> DataFrame:
        return self.e.select("label").distinct()

    def edge_graph(self, label: str) -> Graph:
        """The graph of one label, with its own vertices only."""
        rows = self.e.filter(F.col("label") == label)
        return self._with(self.v.join(self.touching(label).df, "vid", "left_semi"), rows)

    def ids_with_document(self) -> DataFrame:
        return self.v.filter("doc is not null").select("vid")

    def equals(self, other: Graph) -> bool:
        """Whether edges and documents are the same; settings don't count."""

        def same(a: DataFrame, b: DataFrame) -> bool:
            return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

        return same(self.v.select("vid", "doc"), other.v.select("vid", "doc")) and same(self.e, other.e)

    # -- new graphs from this one

    def transposed(self, labels: Labels = None) -> Graph:
        """All edges reversed; with labels, only those are kept.  Documents stay."""
        rows = self.e if labels is None else self.e.filter(F.col("label").isin(label_list(labels)))
        return self._with(edges=rows.select("label", F.col("dst").alias("src"), F.col("src").alias("dst"), "doc"))

    def remove_vertices(self, ids: DataFrame) -> Graph:
        """Without the vertices ids(vid), their documents and all their edges."""
        gone = ids.select("vid").distinct()
        edges = self.e
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("vid", end), end, "left_anti")
        return self._with(self.v.join(gone, "vid", "left_anti"), edges)

    def remove_edges(self, keys: DataFrame) -> Graph:
        """Without the edges keys(label, src, dst); ends that are left bare and have no document go too."""
        edges = self.e.join(keys.select("label", "src", "dst").distinct(), ["label", "src", "dst"], "left_anti")
        return self._pruned(edges)

    def remove_all_edges(self, label: str) -> Graph:
        return self._pruned(self.e.filter(F.col("label") != label))

    def _pruned(self, edges: DataFrame) -> Graph:
        held = edges.select(F.col("src").alias("vid")).unionByName(edges.select(F.col("dst").alias("vid"))).distinct().withColumn("__held", F.lit(True))
        own = self.v.join(self._ends(self.e), "vid", "left_anti")  # vertices that never had an edge stay
        rest = self.v.join(self._ends(self.e), "vid", "left_semi").join(held, "vid", "left").filter("__held or doc is not null").drop("__held")
        return self._with(own.unionByName(rest), edges)

    @staticmethod
    def _ends(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("src").alias("vid")).unionByName(edges.select(F.col("dst").alias("vid"))).distinct()

    def set_documents(self, docs: DataFrame) -> Graph:
        """New documents for docs(vid, doc); ids that are not in the graph become vertices."""
        new = docs.select("vid", F.col("doc").alias("__new"), F.lit(True).alias("__set"))
        rows = self.v.join(new, "vid", "full_outer")
        return self._with(rows.select("vid", "kind", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("doc")).alias("doc")))

    def set_edge_documents(self, docs: DataFrame) -> Graph:
        """New documents for docs(label, src, dst, doc) of edges that exist; they always replace."""
        new = docs.select("label", "src", "dst", F.col("doc").alias("__new"), F.lit(True).alias("__set"))
        rows = self.e.join(new, ["label", "src", "dst"], "left")
        return self._with(edges=rows.select("label", "src", "dst", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("doc")).alias("doc")))

    def update_documents(self, change: Callable[[Column], Column], where: Column) -> Graph:
        """``change`` applied to the documents of the vertices that meet ``where``."""
        return self._with(self.v.withColumn("doc", F.when(where, change(F.col("doc"))).otherwise(F.col("doc"))))

    def remove_documents(self, ids: DataFrame) -> Graph:
        """Without the documents of ids(vid); a vertex without edges goes with its document."""
        gone = ids.select("vid", F.lit(True).alias("__gone")).distinct()
        ends = self._ends(self.e).withColumn("__end", F.lit(True))
        rows = self.v.join(gone, "vid", "left").join(ends, "vid", "left").filter("__gone is null or __end")
        return self._with(rows.select("vid", "kind", F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("doc")).alias("doc")))

    def remove_edge_documents(self, keys: DataFrame) -> Graph:
        gone = keys.select("label", "src", "dst", F.lit(True).alias("__gone")).distinct()
        rows = self.e.join(gone, ["label", "src", "dst"], "left")
        return self._with(edges=rows.select("label", "src", "dst", F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("doc")).alias("doc")))

    def merge_with(self, merge_edge: Callable[[Column, Column], Column], merge_vertex: Callable[[Column, Column], Column], *others: Graph) -> Graph:
        """Union of the graphs; where two hold a document for the same key, the functions decide.  Settings are this graph's."""
        out = self
        for other in others:

            def joined(a: DataFrame, b: DataFrame, keys: list[str], decide: Callable[[Column, Column], Column]) -> DataFrame:
                a, b = a.withColumn("__a", F.lit(True)), b.withColumnRenamed("doc", "doc2").withColumn("__b", F.lit(True))
                if "kind" in b.columns:
                    b = b.withColumnRenamed("kind", "kind2")
                rows = a.join(b, keys, "full_outer")
                doc = F.when(F.col("doc").isNull(), F.col("doc2")).when(F.col("doc2").isNull(), F.col("doc")).otherwise(decide(F.col("doc"), F.col("doc2")))
                kind = [F.coalesce("kind2", "kind").alias("kind")] if "kind2" in rows.columns else []
                return rows.select(*keys, *kind, doc.alias("doc"))

            out = out._with(joined(out.v, other.v, ["vid"], merge_vertex), joined(out.e, other.e, ["label", "src", "dst"], merge_edge), {**other.edge_types, **out.edge_types})
        return out

    def merge(self, *others: Graph) -> Graph:
        """Union of the graphs; later documents win."""
        return self.merge_with(lambda a, b: b, lambda a, b: b, *others)

    # -- extension

    def register_traversal(self, name: str, step: Callable[[Route], Route]) -> Graph:
        """A graph whose routes answer ``route.call(name)`` with ``step``; documents and edges are shared."""
        out = self._with()
        out.traversals[name] = step
        return out


class GraphBuilder:
    """Collects vertices and edges with their order of arrival; ``freeze`` resolves repeats.

    ``unique``: the last document of an edge wins, null included.  ``weighted``: documents are
    numbers and add up, anything else counts as the default.  ``parallel``: all documents are kept,
    in order, with their count.
    """

    def __init__(self, spark: SparkSession, start: Graph | None = None):
        self.spark, self.start = spark, start
        self._vertices: list[DataFrame] = []
        self._edges: dict[str, list[DataFrame]] = {}
        self._rules: dict[str, tuple[str, float]] = {}
        self.edge_types: dict[str, str] = dict(start.edge_types) if start else {}
        self._calls = 0

    def _sequenced(self, rows: DataFrame, order: Column | None) -> DataFrame:
        self._calls += 1
        return rows.withColumn("__seq", F.struct(F.lit(self._calls).alias("call"), (F.lit(0) if order is None else order).alias("row")))

    def edge_rule(self, label: str, rule: str = "unique", default: float = 0.0) -> GraphBuilder:
        if rule not in ("unique", "weighted", "parallel"):
            raise ValueError(f"no edge rule {rule!r}")
        self._rules[label] = (rule, default)
        return self

    def add_vertices(self, rows: DataFrame, order: Column | None = None) -> GraphBuilder:
        """rows(vid[, kind, doc]); of several non-null documents the last wins."""
        if "kind" not in rows.columns:
            rows = rows.withColumn("kind", F.lit(None).cast("string"))
        if "doc" not in rows.columns:
            rows = rows.withColumn("doc", F.lit(None).cast("string"))
        self._vertices.append(self._sequenced(rows, order).select("vid", "kind", "doc", "__seq"))
        return self

    def add_edges(self, label: str, rows: DataFrame, edge_type: str | None = None, order: Column | None = None) -> GraphBuilder:
        """rows(src, dst[, doc]); the first call for a label fixes its edge type."""
        self.edge_types.setdefault(label, edge_type or DIGRAPH)
        if self.edge_types[label] == UNDIRECTED:
            doc = ["doc"] if "doc" in rows.columns else []
            low, high = F.least("src", "dst"), F.greatest("src", "dst")
            extra = [c for c in rows.columns if c not in ("src", "dst", "doc")]
            rows = rows.select(low.alias("src"), high.alias("dst"), *doc, *extra)
        if "doc" not in rows.columns:
            rows = rows.withColumn("doc", F.lit(None).cast("string"))
        self._edges.setdefault(label, []).append(self._sequenced(rows, order).select("src", "dst", "doc", "__seq"))
        return self

    def add_edges_from(self, label: str, src, targets: DataFrame | Sequence, edge_type: str | None = None, documents: Sequence | None = None, on_missing: OnMissing | None = None) -> GraphBuilder:
        """A star out of one vertex: targets(vid[, doc]), or a list of ids with a list of documents in the same order."""
        rows = self._star(targets, documents, on_missing)
        return self.add_edges(label, rows.withColumn("src", F.lit(src)).withColumnRenamed("vid", "dst"), edge_type)

    def add_edges_to(self, label: str, sources: DataFrame | Sequence, dst, edge_type: str | None = None, documents: Sequence | None = None, on_missing: OnMissing | None = None) -> GraphBuilder:
        """A star into one vertex: sources(vid[, doc]), or a list of ids with a list of documents in the same order."""
        rows = self._star(sources, documents, on_missing)
        return self.add_edges(label, rows.withColumn("dst", F.lit(dst)).withColumnRenamed("vid", "src"), edge_type)

    def _star(self, ends: DataFrame | Sequence, documents: Sequence | None, on_missing: OnMissing | None) -> DataFrame:
        """Rows(vid[, doc]).  Lists of unequal length go to ``on_missing``, which returns the (id, document) pairs to add; without it they raise."""
        if isinstance(ends, DataFrame):
            if documents is not None:
                raise TypeError("a DataFrame of ends brings its documents in its column doc")
            return ends
        if documents is None:
            return self.spark.createDataFrame([(v,) for v in ends], ["vid"])
        pairs = list(zip(ends, documents, strict=False))
        if len(ends) != len(documents):
            if on_missing is None:
                raise MissingDocuments(f"{len(ends)} vertices and {len(documents)} documents")
            pairs = list(on_missing(pairs, ends, documents))
        return self.spark.createDataFrame(pairs, ["vid", "doc"])

    def _resolved(self, label: str) -> DataFrame:
        rule, default = self._rules.get(label, ("unique", 0.0))
        rows = self._edges[label][0]
        for more in self._edges[label][1:]:
            rows = rows.unionByName(more)
        if self.start is not None:  # what the graph holds came first
            before = self.start.e.filter(F.col("label") == label).withColumn("__seq", F.struct(F.lit(0).alias("call"), F.lit(0).alias("row")))
            rows = before.select("src", "dst", F.col("doc").cast(dict(rows.dtypes)["doc"]).alias("doc"), "__seq").unionByName(rows)
        keyed = rows.groupBy("src", "dst")
        if rule == "weighted":
            out = keyed.agg(F.sum(F.coalesce(F.expr("try_cast(doc as double)"), F.lit(default))).alias("doc"))
        elif rule == "parallel":
            kept = F.array_sort(F.collect_list(F.struct("__seq", F.struct("doc").alias("d"))))
            out = keyed.agg(F.struct(F.count("*").alias("n"), F.transform(kept, lambda x: x["d"]["doc"]).alias("docs")).alias("doc"))
        else:
            out = keyed.agg(F.max(F.struct("__seq", "doc")).alias("last")).select("src", "dst", F.col("last.doc").alias("doc"))
        return out.withColumn("label", F.lit(label))

    def freeze(self) -> Graph:
        """The graph; labels with one document type are put together as they are, others as text."""
        parts = [self._resolved(k) for k in self._edges]
        if self.start is not None:
            parts.insert(0, self.start.e.filter(~F.col("label").isin(list(self._edges))))
        kinds = {dict(p.dtypes)["doc"] for p in parts}
        if len(kinds) > 1:
            parts = [p if dict(p.dtypes)["doc"] == "string" else p.withColumn("doc", F.to_json("doc") if dict(p.dtypes)["doc"].startswith("struct") else F.col("doc").cast("string")) for p in parts]
        if not parts:
            return self.start or Graph.empty(self.spark)
        edges = parts[0].select("label", "src", "dst", "doc")
        for p in parts[1:]:
            edges = edges.unionByName(p.select("label", "src", "dst", "doc"))
        docs = None
        for rows in self._vertices:
            docs = rows if docs is None else docs.unionByName(rows)
        vertices = None
        if docs is not None:
            best = F.max(F.when(F.col("doc").isNotNull(), F.struct("__seq", "doc"))).alias("best")
            vertices = docs.groupBy("vid").agg(F.max(F.struct("__seq", "kind"))["kind"].alias("kind"), best).select("vid", "kind", F.col("best.doc").alias("doc"))
        graph = Graph.from_edges(edges, vertices=vertices, edge_types=self.edge_types)
        if self.start is not None:  # its vertices too; its edges are there already
            graph = graph.merge_with(lambda a, b: a, lambda a, b: a, self.start._with(edges=self.start.e.limit(0)))
        for label, kind in self.edge_types.items():
            if kind == DAG:
                from roamframe.operators.algorithms import is_acyclic

                if not is_acyclic(graph, label):
                    raise CyclicGraph(label)
        return graph
