"""Routes: composable traversals as DataFrames.

A route is a bag of vertices (column ``vid``), edges (``label, src, dst, fwd``) or values
(``value``).  Traversals are equi-joins with the edge table and keep multiplicity; nothing
is deduplicated unless asked.  Functions that apply *per element* (look-ahead, sections,
grouped steps) are run once for all elements: the distinct elements are copied to a hidden
scope column, the function's traversals carry it along, and its orders, limits and
aggregates work inside it.  Order is opt-in: ``sort_by`` (or ``Graph.route``) gives a route order
columns, and the operators that depend on order raise without them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.graph import Graph, Labels
from roamframe.plans.ranking import positioned

_ELEMENT = {"vertex": ("vid",), "edge": ("label", "src", "dst"), "value": ("value",)}
Step = Callable[["Route"], "Route"]


class Unordered(ValueError):
    """The operator needs an order and the route has none."""


class Route:
    def __init__(self, graph: Graph, df: DataFrame, kind: str, scope: tuple[str, ...] = (), order: tuple[str, ...] = ()):
        self.graph, self.df, self.kind, self.scope, self.order = graph, df, kind, scope, order

    # -- plumbing

    def _new(self, df: DataFrame, kind: str | None = None, order: tuple[str, ...] | None = None) -> Route:
        return Route(self.graph, df, kind or self.kind, self.scope, self.order if order is None else order)

    @property
    def keys(self) -> tuple[str, ...]:
        return _ELEMENT[self.kind]

    @property
    def tracked(self) -> bool:
        return "path" in self.df.columns

    @property
    def carried(self) -> list[str]:
        """Columns that travel with an element: scopes, orders, path, branch."""
        drop = {*self.keys, "fwd"}
        return [c for c in self.df.columns if c not in drop]

    @property
    def element(self) -> Column:
        """The element as one value."""
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def _need_order(self, what: str) -> list[Column]:
        if not self.order:
            raise Unordered(f"{what} needs an ordered route; call sort_by first")
        return [F.col(c) for c in self.order]

    def _scoped(self) -> tuple[Route, str]:
        """A route of the distinct elements, each its own scope, and the scope column's name."""
        name = f"__s{len(self.scope)}"
        extra = ["fwd"] if self.kind == "edge" and "fwd" in self.df.columns else []
        rows = self.df.select(*self.keys, *extra).distinct()
        return Route(self.graph, rows.withColumn(name, self.element), self.kind, (name,)), name

    def __repr__(self) -> str:
        return f"Route({self.kind}, columns={self.df.columns}, scope={self.scope}, order={self.order})"

    def call(self, name: str) -> Route:
        """A traversal that was registered with the graph."""
        return self.graph.traversals[name](self)

    def then(self, *steps: Step) -> Route:
        """The steps one after another."""
        out = self
        for step in steps:
            out = step(out)
        return out

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    # -- steps over edges

    def _grown(self, df: DataFrame, kind: str) -> DataFrame:
        """Append the element arrived at to the path, where one is kept."""
        if not self.tracked:
            return df
        vid = dict(self.graph.v.dtypes)["vid"]
        step = path_entry(df, kind, vid)
        return df.withColumn("path", F.array_append("path", step))

    def _edges(self, labels: Labels, forward: bool) -> Route:
        if self.kind != "vertex":
            raise TypeError(f"edges are taken from vertices, not from a route of {self.kind}s")
        near = "src" if forward else "dst"
        edges = self.graph.scan(labels)
        df = self.df.join(edges, self.df["vid"] == edges[near]).select(*self.carried, "label", "src", "dst", F.lit(forward).alias("fwd"))
        return self._new(self._grown(df, "edge"), "edge")

    def out_e(self, labels: Labels = None, each: Step | None = None) -> Route:
        """Out-edges; ``each`` is applied to every vertex's own list of edges."""
        return self._edges(labels, True) if each is None else self.section(each, lambda r: r.out_e(labels))

    def in_e(self, labels: Labels = None, each: Step | None = None) -> Route:
        return self._edges(labels, False) if each is None else self.section(each, lambda r: r.in_e(labels))

    def both_e(self, labels: Labels = None, each: Step | None = None) -> Route:
        """In-edges, then out-edges; a self-loop comes twice."""
        if each is not None:
            return self.section(each, lambda r: r.both_e(labels))
        first, second = self.in_e(labels), self.out_e(labels)
        return first._new(first.df.unionByName(second.df))

    def _ends(self, end: Column) -> Route:
        if self.kind != "edge":
            raise TypeError(f"ends are taken from edges, not from a route of {self.kind}s")
        return self._new(self._grown(self.df.select(*self.carried, end.alias("vid")), "vertex"), "vertex")

    def out_v(self) -> Route:
        return self._ends(F.col("src"))

    def in_v(self) -> Route:
        return self._ends(F.col("dst"))

    def both_v(self) -> Route:
        """Both ends of each edge, the in-vertex first."""
        return self._ends(F.explode(F.array("dst", "src")))

    def other_v(self) -> Route:
        """The end that the traversal did not come from."""
        return self._ends(F.when(F.col("fwd"), F.col("dst")).otherwise(F.col("src")))

    def same_v(self) -> Route:
        """The end that the traversal came from."""
        return self._ends(F.when(F.col("fwd"), F.col("src")).otherwise(F.col("dst")))

    def followed_forward(self) -> Route:
        return self.filter(F.col("fwd"))

    def followed_reverse(self) -> Route:
        return self.filter(~F.col("fwd"))

    def out(self, labels: Labels = None, each: Step | None = None) -> Route:
        return self.out_e(labels, each).in_v()

    def in_(self, labels: Labels = None, each: Step | None = None) -> Route:
        return self.in_e(labels, each).out_v()

    def both(self, labels: Labels = None, each: Step | None = None) -> Route:
        return self.both_e(labels, each).other_v()

    def grouped(self, step: Step) -> DataFrame:
        """(element, items): per row of the route the sorted list of what ``step`` gives, empty lists included."""
        scoped, name = self._scoped()
        found = step(scoped)
        lists = found.df.groupBy(F.col(name).alias("__k")).agg(F.array_sort(F.collect_list(found.element)).alias("__items"))
        rows = self.df.withColumn("__k2", self.element).join(lists, F.col("__k2").eqNullSafe(F.col("__k")), "left")
        none = F.array().cast(dict(lists.dtypes)["__items"])
        return rows.select(*self.scope, F.col("__k2").alias("element"), F.coalesce("__items", none).alias("items"))

    def out_e_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.out_e(labels))

    def in_e_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.in_e(labels))

    def both_e_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.both_e(labels))

    def out_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.out(labels))

    def in_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.in_(labels))

    def both_grouped(self, labels: Labels = None) -> DataFrame:
        return self.grouped(lambda r: r.both(labels))

    def _sorted_siblings(self, step: Step, key: Callable[[Route], Column], prepare: Step | None) -> Route:
        scoped, name = self._scoped()
        found = step(scoped)
        if prepare is not None:
            found = prepare(found)
        ranked = found.df.withColumn("__rank", F.row_number().over(W.partitionBy(name).orderBy(key(found), *found.keys)))
        ranked = ranked.withColumnRenamed(name, "__k")
        rows = self.df.select(*self.carried, self.element.alias("__from")).join(ranked, F.col("__from") == F.col("__k"))
        order = f"__o{len(self.order)}"
        return self._new(rows.select(*self.carried, *found.keys, F.col("__from").alias(f"{order}f"), F.col("__rank").alias(order)), found.kind, (*self.order, f"{order}f", order))

    def out_sorted(self, labels: Labels, key: Callable[[Route], Column], prepare: Step | None = None) -> Route:
        """Out-neighbours, ordered by the key among the neighbours of one vertex.

        ``prepare`` may add columns for the key, such as a field of the documents.
        """
        return self._sorted_siblings(lambda r: r.out(labels), key, prepare)

    def in_sorted(self, labels: Labels, key: Callable[[Route], Column], prepare: Step | None = None) -> Route:
        return self._sorted_siblings(lambda r: r.in_(labels), key, prepare)

    def _counted(self, ends: Sequence[str], labels: Labels, name: str) -> DataFrame:
        edges = self.graph.scan(labels)
        hits = edges.select(F.col(ends[0]).alias("__v"))
        for end in ends[1:]:
            hits = hits.unionByName(edges.select(F.col(end).alias("__v")))
        counts = hits.groupBy("__v").agg(F.count("*").alias(name))
        return self.df.join(counts, self.df["vid"] == counts["__v"], "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    def out_edge_count(self, labels: Labels = None) -> DataFrame:
        return self._counted(["src"], labels, "count")

    def in_edge_count(self, labels: Labels = None) -> DataFrame:
        return self._counted(["dst"], labels, "count")

    def both_edge_count(self, labels: Labels = None) -> DataFrame:
        """A self-loop counts twice."""
        return self._counted(["src", "dst"], labels, "count")

    degree, in_degree, out_degree = both_edge_count, in_edge_count, out_edge_count

    def siblings_grouped(self, to_parent: Step, from_parent: Step) -> DataFrame:
        """(element, items): per element the other children of its parents."""
        return self.grouped(lambda r: r._siblings(to_parent, from_parent))

    def siblings(self, to_parent: Step, from_parent: Step) -> Route:
        """All other children of each element's parents."""
        scoped, name = self._scoped()
        found = scoped._siblings(to_parent, from_parent)
        return self._joined_back(found, name)

    def _siblings(self, to_parent: Step, from_parent: Step) -> Route:
        """Inside a scope of single elements: parents' children except the element."""
        found = from_parent(to_parent(self))
        return found.filter(~F.col(self.scope[-1]).eqNullSafe(found.element))

    def iter(self, n: int, step: Step) -> Route:
        """The step applied n times."""
        return self.then(*[step] * n)

    # -- filters

    def filter(self, condition: Column | str) -> Route:
        return self._new(self.df.filter(condition))

    def remove(self, condition: Column) -> Route:
        """Without the rows that meet the condition; rows for which it is null stay."""
        return self._new(self.df.filter(~F.coalesce(condition, F.lit(False))))

    def with_documents(self) -> DataFrame:
        """The route's rows with the column ``doc``; null where there is none."""
        if self.kind == "vertex":
            return self.df.join(self.graph.v.select("vid", "doc"), "vid", "left")
        if self.kind == "edge":
            docs = self.graph.e
            rows = self.df.join(docs, ["label", "src", "dst"], "left")
            mirrored = [k for k, t in self.graph.edge_types.items() if t == "undirected"]
            if mirrored:
                back = docs.filter(F.col("label").isin(mirrored)).select("label", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("doc").alias("__doc"))
                rows = rows.join(back, ["label", "src", "dst"], "left").withColumn("doc", F.coalesce("doc", "__doc")).drop("__doc")
            return rows
        return self.df.withColumn("doc", F.lit(None))

    def documents(self) -> Route:
        """The elements' documents as values, nulls for missing ones."""
        return self._new(self.with_documents().select(*self.carried, F.col("doc").alias("value")), "value")

    def where_doc(self, test: Callable[[Column], Column]) -> Route:
        rows = self.with_documents().filter(test(F.col("doc")))
        return self._new(rows.drop("doc"))

    def has_document(self) -> Route:
        return self.where_doc(lambda d: d.isNotNull())

    def has_property(self, name: str, value) -> Route:
        """Documents with this value under this name; null matches a missing one."""
        return self.where_doc(lambda d: d.getField(name).eqNullSafe(F.lit(value)))

    def is_(self, value) -> Route:
        return self.filter(self.element.eqNullSafe(F.lit(value)))

    def isnt(self, value) -> Route:
        return self.filter(~self.element.eqNullSafe(F.lit(value)))

    def one_of(self, values: Iterable | DataFrame) -> Route:
        """Elements among the values: a list, or a DataFrame of one column."""
        if isinstance(values, DataFrame):
            return self._new(self.df.join(values.toDF("__x").distinct(), self.element == F.col("__x"), "left_semi"))
        return self.filter(self.element.isin(list(values)))

    def none_of(self, values: Iterable | DataFrame) -> Route:
        if isinstance(values, DataFrame):
            return self._new(self.df.join(values.toDF("__x").distinct(), self.element == F.col("__x"), "left_anti"))
        return self.remove(self.element.isin(list(values)))

    def with_(self, computed: Callable[[Route], Column], value) -> Route:
        """Elements whose computed value equals ``value``, or is in it if it is a set or list."""
        column = computed(self)
        return self.filter(column.isin(list(value)) if isinstance(value, (set, list, frozenset)) else column.eqNullSafe(F.lit(value)))

    def of_kind(self, kind: str | Callable[[Column], Column]) -> Route:
        kinds = self.graph.v.select("vid", F.col("kind").alias("__kind"))
        rows = self.df.join(kinds, "vid")
        hit = kind(F.col("__kind")) if callable(kind) else F.col("__kind") == kind
        return self._new(rows.filter(hit).drop("__kind"))

    def with_id(self, test) -> Route:
        return self.filter(test(F.col("vid")) if callable(test) else F.col("vid").eqNullSafe(F.lit(test)))

    def not_id(self, test) -> Route:
        return self.remove(test(F.col("vid")) if callable(test) else F.col("vid").eqNullSafe(F.lit(test)))

    def exists(self) -> Route:
        """The elements that are in the graph."""
        side = self.graph.v.select("vid") if self.kind == "vertex" else self.graph.scan()
        return self._new(self.df.join(side, list(self.keys), "left_semi"))

    def edges_with_label(self, label: str) -> Route:
        """The vertices that an edge of the label touches."""
        return self._new(self.df.join(self.graph.touching(label).df, "vid", "left_semi"))

    def lookahead(self, step: Step, min: int | None = None, max: int | None = None) -> Route:
        """Elements for which the step finds something, or between min and max results (none counts as 0)."""
        return self._looked(step, min, max, True)

    def neg_lookahead(self, step: Step, min: int | None = None, max: int | None = None) -> Route:
        """The elements that ``lookahead`` with the same arguments drops."""
        return self._looked(step, min, max, False)

    def _looked(self, step: Step, low: int | None, high: int | None, keep: bool) -> Route:
        scoped, name = self._scoped()
        found = step(scoped).df
        rows = self.df.withColumn("__k2", self.element)
        if low is None and high is None:
            hits = found.select(F.col(name).alias("__k")).distinct()
            return self._new(rows.join(hits, F.col("__k2") == F.col("__k"), "left_semi" if keep else "left_anti").drop("__k2"))
        counts = found.groupBy(F.col(name).alias("__k")).agg(F.count("*").alias("__n"))
        n = F.coalesce("__n", F.lit(0))
        hit = (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True))
        joined = rows.join(counts, F.col("__k2") == F.col("__k"), "left")
        return self._new(joined.filter(hit if keep else ~hit).drop("__k", "__k2", "__n"))

    def is_cycle(self, step: Step) -> Route:
        """Elements among their own children: one hop of the step comes back."""
        return self.lookahead(lambda r: (lambda x: x.filter(x.element.eqNullSafe(F.col(x.scope[-1]))))(step(r)))

    def no_cycle(self, step: Step) -> Route:
        return self.neg_lookahead(lambda r: (lambda x: x.filter(x.element.eqNullSafe(F.col(x.scope[-1]))))(step(r)))

    def with_set(self, decide: str, step: Step | None = None) -> Route:
        """``keep`` or ``remove``, of the elements that ``step`` gives (by default this route's own), those in this route's set."""
        other = self if step is None else step(self)
        mine = self.df.select(*self.scope, self.element.alias("__x")).distinct()
        keys = [*self.scope]
        rows = other.df.withColumn("__x", other.element)
        return other._new(rows.join(mine, [*keys, "__x"], "left_semi" if decide == "keep" else "left_anti").drop("__x"))

    def except_route(self, earlier: Route) -> Route:
        """Without the elements that an earlier route has seen."""
        return self.none_of(earlier.df.select(earlier.element.alias("x")))

    def distinct(self) -> Route:
        """Each element once (within its scope); the first in order if there is one."""
        if self.order:
            return self.distinct_by(lambda r: r.element)
        return self._new(self.df.dropDuplicates([*self.scope, *self.keys]))

    def distinct_by(self, key: Callable[[Route], Column]) -> Route:
        """The first element of each key, in the route's order."""
        order = self._need_order("distinct_by")
        rank = F.row_number().over(W.partitionBy(*self.scope, key(self)).orderBy(*order))
        return self._new(self.df.withColumn("__n", rank).filter("__n = 1").drop("__n"))

    def prevent_cycles(self) -> Route:
        """Everything before the first repeated element."""
        return self._until_repeat(lambda element: F.lit(False))

    def no_cycles(self, on_cycle: Callable[[Column], Column] | None = None) -> Route:
        """The route itself, or an error when read if an element repeats.

        ``on_cycle`` decides about a repeated element instead: true keeps it and goes on, anything else ends the route before it.
        """
        return self._until_repeat(on_cycle)

    def _until_repeat(self, goes_on: Callable[[Column], Column] | None) -> Route:
        order = self._need_order("cutting at a repeat")
        placed = positioned(self.df, order, "__p", self.scope)
        again = F.row_number().over(W.partitionBy(*self.scope, self.element).orderBy("__p"))
        marked = placed.withColumn("__again", again)
        stops = F.col("__again") > 1
        if goes_on is not None:
            stops = stops & ~F.coalesce(goes_on(self.element), F.lit(False))
        # one row per scope
        cuts = marked.filter(stops).groupBy(*self.scope).agg(F.min("__p").alias("__cut"))
        if self.scope:
            rows = marked.join(cuts, list(self.scope), "left")
        else:
            rows = marked.withColumn("__cut", cuts.scalar())
        if goes_on is None:
            rows = rows.withColumn("__ok", F.when(F.col("__cut").isNotNull(), F.raise_error(F.lit("an element repeats in the route"))).otherwise(F.lit(True))).filter("__ok").drop("__ok")
        return self._new(rows.filter("__cut is null or __p < __cut").drop("__p", "__again", "__cut"))

    def random_sample(self, share: float, seed: int = 0) -> Route:
        """Each element with this probability; equal elements of a scope share their fate, so the same seed gives the same rows on any partitioning."""
        if not 0 <= share <= 1:
            raise ValueError(f"no probability: {share}")
        drawn = F.xxhash64(F.lit(seed), *[F.col(c) for c in self.scope], self.element).bitwiseAND(F.lit((1 << 53) - 1))
        return self.filter(drawn < F.lit(int(share * (1 << 53))))

    def pluck(self, condition: Column) -> Route:
        """The first element that meets the condition."""
        return self.filter(condition).take(1)

    def range_route(self, key: Callable[[Route], Column], low=None, high=None, descending: bool = False, include_low: bool = True, include_high: bool = False) -> Route:
        """The elements whose key lies in a range, in key order."""
        column = key(self)
        out = self
        if low is not None:
            out = out.filter(column >= F.lit(low) if include_low else column > F.lit(low))
        if high is not None:
            out = out.filter(column <= F.lit(high) if include_high else column < F.lit(high))
        return out.sort_by(key, descending)

    # -- per-element sub-queries, branches, shape

    def _joined_back(self, found: Route, name: str, origin: str | None = None) -> Route:
        """The rows of ``found`` for every row of this route whose element is their scope."""
        inner = found.df.withColumnRenamed(name, "__k")
        keep = self.carried
        rows = self.df.select(*keep, self.element.alias("__from")).join(inner, F.col("__from").eqNullSafe(F.col("__k")))
        own = [c for c in found.df.columns if c != name and c not in keep]
        extra = [F.col("__from").alias(origin)] if origin else []
        # a row repeated in this route keeps its own place in the order
        order = tuple(c for c in (*self.order, *found.order) if c in keep or c in own)
        return Route(self.graph, rows.select(*keep, *own, *extra), found.kind, self.scope, order)

    def section(self, f: Step, section: Step) -> Route:
        """Per element f(section(element)), put together."""
        scoped, name = self._scoped()
        return self._joined_back(f(section(scoped)), name)

    def context(self, f: Callable[[Route, Column], Route], section: Step) -> Route:
        """Per element f(section(element), element); the element is the column ``origin`` of the result."""
        scoped, name = self._scoped()
        return self._joined_back(f(section(scoped), F.col(name)), name, "origin")

    def sorted_section(self, key: Callable[[Route], Column], section: Step) -> Route:
        """Sections, each sorted by the key."""
        return self.section(lambda r: r.sort_by(key), section)

    def gather(self) -> Route:
        """One row with the list of all elements (per scope), in order if there is one."""
        if self.order:
            both = F.array_sort(F.collect_list(F.struct(*self.order, self.element.alias("__x"))))
            value = F.transform(both, lambda s: s["__x"])
        else:
            value = F.collect_list(self.element)
        grouped = self.df.groupBy(*self.scope) if self.scope else self.df.groupBy()
        return self._new(grouped.agg(value.alias("value")), "value", ())

    def spread(self, kind: str = "value") -> Route:
        """Lists flattened by one level; ``kind`` vertex makes vertices of ids."""
        name = "vid" if kind == "vertex" else "value"
        order = f"__o{len(self.order)}"
        rows = self.df.select(*self.carried, F.posexplode("value").alias(order, name))
        return self._new(rows, kind, (*self.order, order))

    def values(self, *columns: Column, name: str = "value") -> Route:
        """A projection: the route as values."""
        value = columns[0] if len(columns) == 1 else F.struct(*columns)
        return self._new(self.df.select(*self.carried, value.alias("value")), "value")

    def keep(self, column: Column) -> Route:
        """A projection without nulls."""
        return self.values(column).filter(F.col("value").isNotNull())

    def make_pairs(self, first: Callable[[Route], Column], second: Callable[[Route], Column] | None = None) -> Route:
        """(element, f) or (f0, f1) per element, as values."""
        a, b = (lambda r: r.element, first) if second is None else (first, second)
        return self.values(F.struct(a(self).alias("first"), b(self).alias("second")))

    def branch(self, *steps: Step) -> list[Route]:
        """The route through each of the steps."""
        return [step(self) for step in steps]

    def keyed_branch(self, **steps: Step) -> dict[str, Route]:
        return {name: step(self) for name, step in steps.items()}

    # -- order and limits

    def sort_by(self, key: Callable[[Route], Column], descending: bool = False) -> Route:
        """Order by the key; ties keep the order that the route had, then go by element."""
        name = f"__k{len([c for c in self.df.columns if c.startswith('__k')])}"
        value = key(self)
        if descending:  # order columns always ascend
            ranked = self.df.withColumn("__sort", value)
            place = positioned(ranked, [F.col("__sort").desc(), *[F.col(c) for c in self.order], *self.keys], name, self.scope)
            return self._new(place.drop("__sort"), order=(name,))
        rows = self.df.withColumn(name, value)
        ties = self.order or tuple(self.keys)
        return self._new(rows, order=(name, *ties))

    def by_doc(self, field: Callable[[Column], Column], name: str = "value") -> Route:
        """Carry a part of the document as a column of the route."""
        rows = self.with_documents()
        return self._new(rows.withColumn(name, field(F.col("doc"))).drop("doc"))

    def _places(self, what: str) -> DataFrame:
        return positioned(self.df, self._need_order(what), "__p", self.scope)

    def take(self, n: int) -> Route:
        """The first n elements (per scope)."""
        order = self._need_order("take")
        if not self.scope:
            return self._new(self.df.orderBy(*order).limit(n))
        return self._new(self._places("take").filter(F.col("__p") <= n).drop("__p"))

    def first(self) -> Route:
        return self.take(1)

    def nth(self, n: int) -> Route:
        """The element at a place, counted from 0."""
        return self._new(self._places("nth").filter(F.col("__p") == n + 1).drop("__p"))

    def last(self) -> Route:
        rows = self._places("last")
        top = F.max("__p").over(W.partitionBy(*self.scope)) if self.scope else rows.agg(F.max("__p")).scalar()
        return self._new(rows.withColumn("__top", top).filter("__p = __top").drop("__p", "__top"))

    def take_drop(self, steps: Sequence[int]) -> Route:
        """Take steps[0], drop steps[1], take steps[2], … and end with the steps."""
        return self._alternate(steps, True)

    def drop_take(self, steps: Sequence[int]) -> Route:
        return self._alternate(steps, False)

    def _alternate(self, steps: Sequence[int], taking: bool) -> Route:
        hit, at = F.lit(False), 0
        for n in steps:
            if taking and n > 0:
                hit = hit | F.col("__p").between(at + 1, at + n)
            at += n
            taking = not taking
        return self._new(self._places("take and drop").filter(hit).drop("__p"))

    # -- aggregates

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.scope).agg(F.count("*").alias("count")) if self.scope else self.df.agg(F.count("*").alias("count"))

    def _key(self, key: Callable[[Route], Column] | None) -> Column:
        return (self.element if key is None else key(self)).alias("key")

    def group_count(self, key: Callable[[Route], Column] | None = None) -> DataFrame:
        """(key, count)."""
        return self.df.groupBy(*self.scope, self._key(key)).agg(F.count("*").alias("count"))

    def sorted_group_count(self, key: Callable[[Route], Column] | None = None) -> DataFrame:
        return self.group_count(key).orderBy(*self.scope, "key")

    def group_by_count(self, key: Callable[[Route], Column] | None = None, more_than_once: bool = False) -> DataFrame:
        """(count, keys): the set of keys that occur so often; ``more_than_once`` leaves out 1."""
        counts = self.group_count(key)
        if more_than_once:
            counts = counts.filter("count <> 1")
        return counts.groupBy(*self.scope, "count").agg(F.array_sort(F.collect_set("key")).alias("keys"))

    def sorted_group_by_count(self, key: Callable[[Route], Column] | None = None) -> DataFrame:
        return self.group_by_count(key).orderBy(*self.scope, "count")

    def index_by(self, key: Callable[[Route], Column], value: Callable[[Route], Column] | None = None) -> DataFrame:
        """(key, value) with each key's last value in order."""
        order = self._need_order("index_by")
        kept = (self.element if value is None else value(self)).alias("value")
        return self.df.select(*self.scope, key(self).alias("key"), kept, F.struct(*order).alias("__o")).groupBy(*self.scope, "key").agg(F.max_by("value", "__o").alias("value"))

    def index_by_multi(self, keys: Callable[[Route], Column], value: Callable[[Route], Column] | None = None) -> DataFrame:
        """As ``index_by``, with every element under each of several keys."""
        return self._new(self.df.withColumn("__key", F.explode(keys(self)))).index_by(lambda r: F.col("__key"), value)

    # -- paths

    def with_paths(self) -> Route:
        """Keep each element's path from here on."""
        vid = dict(self.graph.v.dtypes)["vid"]
        return self._new(self.df.withColumn("path", F.array(path_entry(self.df, self.kind, vid))))

    reset_path = with_paths

    def no_path(self) -> Route:
        return self._new(self.df.drop("path"))

    def paths(self) -> Route:
        """The paths as values: vertex, edge, vertex, …; an untracked element is a path of itself."""
        tracked = self if self.tracked else self.with_paths()
        rows = tracked.df.withColumnRenamed("path", "value")
        return self._new(rows.select(*[c for c in self.carried if c != "path"], "value"), "value")

    def subgraph(self, as_reference: bool = False) -> Graph:
        """The graph of all edges on the route's paths, with the documents of their ends.

        ``as_reference`` writes every edge reversed.
        """
        steps = self.df.select(F.explode("path").alias("p")).filter("p.t = 'e'").select("p.label", "p.src", "p.dst").distinct()
        edges = steps.join(self.graph.e, ["label", "src", "dst"], "left")
        if as_reference:
            edges = edges.select("label", F.col("dst").alias("src"), F.col("src").alias("dst"), "doc")
        ends = Graph._ends(steps)
        return self.graph._with(self.graph.v.join(ends, "vid", "left_semi"), edges.select("label", "src", "dst", "doc"))


def path_entry(df: DataFrame, kind: str, id_type: str) -> Column:
    """An element as a step of a path: ``t`` is v, e or x (a value)."""
    none = F.lit(None)
    if kind == "edge":
        fields = ("e", F.col("label"), F.col("src"), F.col("dst"), none, F.col("fwd"), none)
    elif kind == "vertex":
        fields = ("v", none, none, none, F.col("vid"), none, none)
    else:
        fields = ("x", none, none, none, none, none, F.col("value").cast("string"))
    kinds = ("string", "string", id_type, id_type, id_type, "boolean", "string")
    names = ("t", "label", "src", "dst", "vid", "fwd", "value")
    return F.struct(*[(F.lit(f) if isinstance(f, str) else f).cast(k).alias(n) for f, k, n in zip(fields, kinds, names, strict=True)])


def merge_exhaustive(*routes: Route) -> Route:
    """The routes one after another, with the column ``branch``."""
    parts = [r.df.withColumn("branch", F.lit(k)) for k, r in enumerate(routes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return routes[0]._new(out, order=("branch", *routes[0].order) if all(r.order == routes[0].order for r in routes) else ())


def merge_round_robin(*routes: Route, chunk: int = 32) -> Route:
    """The routes interleaved in chunks: the first chunk of each, then the second of each, …"""
    parts = []
    for k, r in enumerate(routes):
        placed = positioned(r.df, r._need_order("merge_round_robin"), "__p", r.scope)
        parts.append(placed.drop(*[c for c in r.order if c.startswith("__")]).withColumn("branch", F.lit(k)).withColumn("__turn", F.floor((F.col("__p") - 1) / chunk)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return routes[0]._new(out, order=("__turn", "branch", "__p"))
