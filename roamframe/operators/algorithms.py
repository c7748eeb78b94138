"""Graph algorithms as loops of joins and aggregates.

The frontier and what is known so far are the only state; each round is written to the
shared folder, so plans stay short and a lost executor costs a round's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.graph import Graph, Labels
from roamframe.operators.components import star_components
from roamframe.plans.scratch import cut, stored
from roamframe.route import Route


class NotUndirected(TypeError):
    """The algorithm is for undirected labels."""


def _need_undirected(graph: Graph, label: str) -> None:
    if graph.edge_types.get(label) != "undirected":
        raise NotUndirected(label)


def edge_list(graph: Graph, labels: Labels) -> DataFrame:
    """Distinct (src, dst), in the shared folder."""
    return cut(graph.scan(labels).select("src", "dst").distinct())


def is_acyclic(graph: Graph, labels: Labels = None) -> bool:
    """Peels vertices without in-edges until none is left, or none can be peeled."""
    edges = edge_list(graph, labels)
    while True:
        inner = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        before, after = edges.count(), inner.count()
        if after == 0 or before == after:
            return after == 0
        edges = inner


def reachable(edges: DataFrame, start: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(origin, vid, level): what each start(origin, vid) reaches over edges(src, dst), itself at level 0."""
    frontier = stored(start.select("origin", "vid").distinct().withColumn("level", F.lit(0)), "level")
    seen = frontier
    for level in range(1, max_levels + 1):
        step = frontier.join(edges, frontier["vid"] == edges["src"]).select("origin", F.col("dst").alias("vid")).distinct()
        frontier = stored(step.join(seen.select("origin", "vid"), ["origin", "vid"], "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier), "seen") if level % 8 == 0 else seen.unionByName(frontier)
    raise RuntimeError(f"still reaching new vertices after {max_levels} levels")


def strongly_connected_components(edges: DataFrame, vertices: DataFrame | None = None, singletons: bool = True) -> DataFrame:
    """(vid, component) by forward colouring and backward collection.

    Each round every vertex takes the smallest id that reaches it; the vertices of one colour
    that reach the colour's own vertex are a component.  Vertices without in- or out-edges
    among the rest are peeled first.  Without ``singletons``, components of one vertex are left
    out, self-loop or not.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    ends = edges.select(F.col("src").alias("vid")).unionByName(edges.select(F.col("dst").alias("vid"))).distinct()
    left = cut(ends if vertices is None else ends.unionByName(vertices.select("vid")).distinct())
    done: DataFrame | None = None

    def add(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    while not left.isEmpty():
        while True:  # peel
            inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            inner = cut(inner)
            same = inner.count() == edges.count()
            edges = inner
            if same:
                break
        held = edges.select(F.col("src").alias("vid")).distinct()
        bare = left.join(held, "vid", "left_anti")
        add(cut(bare.select("vid", F.col("vid").alias("component"))))
        left = cut(left.join(held, "vid", "left_semi"))
        if left.isEmpty():
            break
        colour = cut(left.select("vid", F.col("vid").alias("c")))
        while True:
            lower = edges.join(colour, edges["src"] == colour["vid"]).groupBy(F.col("dst").alias("vid")).agg(F.min("c").alias("c2"))
            new = cut(colour.join(lower, "vid", "left").select("vid", F.least("c", F.coalesce("c2", "c")).alias("c"), (F.col("c2") < F.col("c")).alias("moved")))
            moved = not new.filter("moved").isEmpty()
            colour = new.select("vid", "c")
            if not moved:
                break
        a, b = colour.withColumnRenamed("vid", "src").withColumnRenamed("c", "ca"), colour.withColumnRenamed("vid", "dst").withColumnRenamed("c", "cb")
        within = cut(edges.join(a, "src").join(b, "dst").filter("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.filter("vid = c").select(F.col("c").alias("origin"), "vid")
        found = cut(reachable(within, roots).select("vid", F.col("origin").alias("component")))
        add(found)
        left = cut(left.join(found.select("vid"), "vid", "left_anti"))
        for end in ("src", "dst"):
            edges = edges.join(found.select(F.col("vid").alias(end)), end, "left_anti")
        edges = cut(edges.select("src", "dst"))
    if done is None:
        done = left.select("vid", F.col("vid").alias("component"))
    # a component goes by its smallest vertex
    names = done.groupBy("component").agg(F.min("vid").alias("low"), F.count("*").alias("n"))
    out = done.join(names if singletons else names.filter("n > 1"), "component")
    return out.select("vid", F.col("low").alias("component"))


def strongly_connected_subgraphs(graph: Graph, label: str, new_label: str, singletons: bool = True) -> Graph:
    """The graph with each component's inner edges added under a new label."""
    comp = cut(strongly_connected_components(edge_list(graph, label), graph.touching(label).df, singletons))
    edges = graph.e.filter(F.col("label") == label)
    a, b = comp.select(F.col("vid").alias("src"), F.col("component").alias("ca")), comp.select(F.col("vid").alias("dst"), F.col("component").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").filter("ca = cb").select(F.lit(new_label).alias("label"), "src", "dst", "doc")
    return graph._with(edges=graph.e.unionByName(inner))


def connected_components(graph: Graph, label: str) -> DataFrame:
    """(vid, component) of an undirected label."""
    _need_undirected(graph, label)
    return star_components(graph.e.filter(F.col("label") == label))


def elementary_cycles(edges: DataFrame, max_length: int = 100) -> DataFrame:
    """(cycle): all elementary circuits, from their smallest vertex and with it repeated at the end."""
    edges = cut(edges.select("src", "dst").distinct())
    # a circuit stays inside a component
    comp = strongly_connected_components(edges, singletons=False)
    a, b = comp.select(F.col("vid").alias("src"), F.col("component").alias("ca")), comp.select(F.col("vid").alias("dst"), F.col("component").alias("cb"))
    inner = cut(edges.join(a, "src").join(b, "dst").filter("ca = cb and src <> dst").select("src", "dst"))
    out = edges.filter("src = dst").select(F.array("src", "dst").alias("cycle"))
    walks = cut(inner.filter("dst > src").select("src", F.array("src", "dst").alias("walk"), F.col("dst").alias("at")))
    nxt = inner.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for _ in range(max_length):
        if walks.isEmpty():
            return out
        step = walks.join(nxt, F.col("at") == F.col("a"))
        out = out.unionByName(step.filter("b = src").select(F.array_append("walk", F.col("b")).alias("cycle")))
        walks = cut(step.filter("b > src and not array_contains(walk, b)").select("src", F.array_append("walk", F.col("b")).alias("walk"), F.col("b").alias("at")))
    raise RuntimeError(f"circuits longer than {max_length} edges")


def shortest_path(graph: Graph, label: str, starts: DataFrame, accept: Callable[[Column], Column], cost: Callable[[Column], Column] | None = None, max_rounds: int = 1000) -> DataFrame:
    """(path, cost): the cheapest path from any of starts(vid) to a vertex that ``accept`` takes; no row if there is none.

    ``cost`` makes a non-negative number of an edge's document, 1 by default.  Ties go to the
    smallest path.
    """
    weight = F.lit(1.0) if cost is None else cost(F.col("doc")).cast("double")
    rows = graph.e.filter(F.col("label") == label).withColumn("w", weight)
    if graph.edge_types.get(label) == "undirected":
        rows = rows.select("src", "dst", "w").unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    edges = cut(rows.select("src", "dst", "w"))
    best = cut(starts.select("vid").distinct().select("vid", F.lit(0.0).alias("cost"), F.array("vid").alias("path")))
    frontier = best
    for _ in range(max_rounds):
        if frontier.isEmpty():
            break
        step = frontier.join(edges, F.col("vid") == F.col("src")).filter("not array_contains(path, dst)")
        step = step.select(F.col("dst").alias("vid"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
        # what costs more than an accepted end is no part of the answer
        bound = best.filter(accept(F.col("vid"))).agg(F.min("cost").alias("b")).first()["b"]
        if bound is not None:
            step = step.filter(F.col("cost") <= bound)
        step = step.groupBy("vid").agg(F.min(F.struct("cost", "path")).alias("q")).select("vid", "q.cost", "q.path")
        known = best.select("vid", F.struct("cost", "path").alias("k"))
        frontier = cut(step.join(known, "vid", "left").filter(F.col("k").isNull() | (F.struct("cost", "path") < F.col("k"))).drop("k"))
        both = best.unionByName(frontier).groupBy("vid").agg(F.min(F.struct("cost", "path")).alias("q"))
        best = cut(both.select("vid", "q.cost", "q.path"))
    else:
        raise RuntimeError(f"paths were still improving after {max_rounds} rounds")
    return best.filter(accept(F.col("vid"))).agg(F.min(F.struct("cost", "path")).alias("q")).filter("q is not null").select("q.path", "q.cost")


def dominators(edges: DataFrame, entry, max_rounds: int = 1000) -> DataFrame:
    """(vid, doms): the array of vertices on every path from the entry, for all that it reaches."""
    edges = cut(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    start = spark.createDataFrame([(entry, entry)], f"origin {kind}, vid {kind}")
    live = cut(reachable(edges, start).select("vid"))
    inner = cut(edges.join(live.withColumnRenamed("vid", "src"), "src", "left_semi").filter(F.col("dst") != F.lit(entry)))
    state = cut(live.select("vid", F.when(F.col("vid") == F.lit(entry), F.array("vid")).alias("doms")))  # null: all vertices
    for _ in range(max_rounds):
        incoming = inner.join(state.withColumnRenamed("vid", "src"), "src").filter("doms is not null")
        # a vertex is common to all counted predecessors if it occurs as often as they are many
        known = incoming.groupBy("dst").agg(F.count("*").alias("n"))
        common = incoming.select("dst", F.explode("doms").alias("d")).groupBy("dst", "d").agg(F.count("*").alias("k")).join(known, "dst").filter("k = n")
        lists = known.select("dst").join(common.groupBy("dst").agg(F.collect_list("d").alias("ds")), "dst", "left")
        found = lists.select(F.col("dst").alias("vid"), F.array_sort(F.array_union(F.coalesce("ds", F.array().cast(f"array<{kind}>")), F.array("dst"))).alias("new"))
        new = cut(state.join(found, "vid", "left").select("vid", F.coalesce("new", "doms").alias("doms"), (~F.coalesce("new", "doms").eqNullSafe(F.col("doms"))).alias("moved")))
        moved = not new.filter("moved").isEmpty()
        state = new.select("vid", "doms")
        if not moved:
            return state
    raise RuntimeError(f"dominators had not settled after {max_rounds} rounds")


def immediate_dominators(edges: DataFrame, entry) -> DataFrame:
    """(vid, idom); the entry is its own."""
    doms = cut(dominators(edges, entry))
    sizes = doms.select(F.col("vid").alias("d"), F.size("doms").alias("n"))
    strict = doms.select("vid", F.explode(F.array_except("doms", F.array("vid"))).alias("d")).join(sizes, "d")
    best = strict.groupBy("vid").agg(F.max_by("d", "n").alias("idom"))
    return doms.select("vid").join(best, "vid", "left").select("vid", F.coalesce("idom", "vid").alias("idom"))


def dominator_depth(idoms: DataFrame) -> DataFrame:
    """(vid, depth): steps to the vertex that is its own immediate dominator; null if the chain comes to none."""
    idoms = cut(idoms.select("vid", "idom"))
    here = cut(idoms.select("vid", F.col("idom").alias("at"), F.when(F.col("vid") == F.col("idom"), 0).alias("depth")))
    roots = idoms.filter("vid = idom").select(F.col("vid").alias("root"))
    for level in range(1, idoms.count() + 1):
        hit = here.join(roots, F.col("at") == F.col("root"), "left").withColumn("depth", F.when(F.col("depth").isNull() & F.col("root").isNotNull(), level).otherwise(F.col("depth"))).drop("root")
        up = idoms.select(F.col("vid").alias("x"), F.col("idom").alias("up"))
        here = cut(hit.join(up, F.col("at") == F.col("x"), "left").select("vid", F.coalesce("up", "at").alias("at"), "depth"))
        if here.filter("depth is null").isEmpty() or hit.filter(f"depth = {level}").isEmpty():
            break
    return here.select("vid", F.col("depth").cast("int").alias("depth"))


def dominance_frontiers(edges: DataFrame, entry) -> DataFrame:
    """(vid, frontier): pairs where vid dominates a predecessor of the other vertex and not, strictly, that vertex.

    Only vertices with two predecessors or more are in a frontier.
    """
    edges = cut(edges.select("src", "dst").distinct())
    doms = cut(dominators(edges, entry))
    live = edges.join(doms.select(F.col("vid").alias("src")), "src", "left_semi")
    join_nodes = edges.groupBy("dst").agg(F.count("*").alias("n")).filter("n >= 2").select("dst")
    over = live.join(join_nodes, "dst").join(doms.select(F.col("vid").alias("src"), "doms"), "src").select("dst", F.explode("doms").alias("vid")).distinct()
    strict = doms.select(F.col("vid").alias("dst"), F.explode(F.array_except("doms", F.array("vid"))).alias("vid"))
    return over.join(strict, ["dst", "vid"], "left_anti").select("vid", F.col("dst").alias("frontier"))


def breadth_first(route: Route, step: Callable[[Route], Route], max_levels: int = 10_000) -> DataFrame:
    """(vid, level): every element that the step reaches, once."""
    seen = cut(route.df.select("vid").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, max_levels + 1):
        found = step(Route(route.graph, frontier.select("vid"), "vertex")).df.select("vid").distinct()
        frontier = stored(found.join(seen.select("vid"), "vid", "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier), "seen") if level % 8 == 0 else seen.unionByName(frontier)
    raise RuntimeError(f"still reaching new vertices after {max_levels} levels")


def vertices_between(edges: DataFrame, start, end, max_length: int = 200) -> DataFrame:
    """(vid): the vertices on simple paths from start to end, both ends included."""
    edges = cut(edges.select("src", "dst").distinct())
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    # only vertices that start reaches and that reach end can lie on a path
    ahead = reachable(edges, spark.createDataFrame([(start, start)], f"origin {kind}, vid {kind}")).select("vid")
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(end, end)], f"origin {kind}, vid {kind}")).select("vid")
    both = cut(ahead.join(back, "vid"))
    inner = cut(edges.join(both.withColumnRenamed("vid", "src"), "src").join(both.withColumnRenamed("vid", "dst"), "dst").select("src", "dst"))
    walks = cut(spark.createDataFrame([([start], start)], f"walk array<{kind}>, at {kind}"))
    out = walks.filter(F.lit(start) == F.lit(end)).select("walk")
    for _ in range(max_length):
        step = walks.filter(F.col("at") != F.lit(end)).join(inner, F.col("at") == F.col("src")).filter("not array_contains(walk, dst)")
        walks = cut(step.select(F.array_append("walk", F.col("dst")).alias("walk"), F.col("dst").alias("at")))
        if walks.isEmpty():
            return out.select(F.explode("walk").alias("vid")).distinct()
        out = out.unionByName(walks.filter(F.col("at") == F.lit(end)).select("walk"))
    raise RuntimeError(f"paths longer than {max_length} edges")
