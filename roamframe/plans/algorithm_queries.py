"""Queries over recursion, algorithms, motifs and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.graph import Graph
from roamframe.operators import algorithms as A
from roamframe.operators import layout as L
from roamframe.operators import motifs as M
from roamframe.operators import ordered as O
from roamframe.operators import recursion as R
from roamframe.plans.ranking import positioned
from roamframe.plans.registry import FOLLOWS_SQL, NEXT_SQL, PLACED_SQL, TRADE_SQL, query, values
from roamframe.route import Route
from roamframe.sources import fixtures as X
from roamframe.sources import tables as T


def _joined(column: str = "value") -> F.Column:
    return F.concat_ws(">", column)


def _next(r: Route) -> Route:
    return r.out("next")


def _firsts(spark: SparkSession, sf: str) -> tuple[Graph, Route]:
    """The chains of orders, and each customer's first order."""
    g = T.next_order(spark, sf).cached(by="src")
    return g, g.V().where_doc(lambda d: d["nth"] == 1)


_FIRSTS = ", s AS (SELECT 'order:' || o AS vid FROM (SELECT min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey))"


# -- recursion


@query(_FIRSTS + ", r AS (SELECT vid AS start, vid, 0 AS hop FROM s UNION ALL SELECT start, dst, hop + 1 FROM r JOIN e ON src = vid WHERE hop < 6) SELECT vid, hop AS level FROM r", NEXT_SQL, recursive=True)
def recurse_all_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Every order within six steps of a customer's first."""
    _, start = _firsts(spark, sf)
    return R.all_(start, _next, depth=6).df.select("vid", F.col("__level").alias("level"))


@query(_FIRSTS + ", r AS (SELECT vid, 0 AS hop FROM s UNION ALL SELECT dst, hop + 1 FROM r JOIN e ON src = vid) SELECT vid, hop AS level FROM r WHERE vid NOT IN (SELECT src FROM e)", NEXT_SQL, recursive=True)
def recurse_deepest(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's last order, by walking the whole chain."""
    _, start = _firsts(spark, sf)
    return R.deepest(start, _next).df.select("vid", F.col("__level").alias("level"))


_WALK = ", r AS (SELECT DISTINCT src AS vid, [src] AS path, 0 AS hop FROM e UNION ALL SELECT dst, list_append(path, dst), hop + 1 FROM r JOIN e ON src = vid WHERE hop < {n} AND NOT list_contains(path[:-2], vid)) "


@query(_WALK.format(n=3) + "SELECT vid, hop AS level, count(*) AS n FROM r GROUP BY 1, 2", FOLLOWS_SQL, recursive=True)
def recurse_all_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """On a cyclic graph: a repeat is given and not followed."""
    g = T.follows(spark, sf).cached()
    return R.all_(g.V(), lambda r: r.out("follows"), depth=3).df.groupBy("vid", F.col("__level").alias("level")).agg(F.count("*").alias("n"))


@query(", r AS (SELECT DISTINCT src AS vid, 0 AS hop FROM e UNION ALL SELECT dst, hop + 1 FROM r JOIN e ON src = vid WHERE hop < 3) SELECT vid, hop AS level, count(*) AS n FROM r GROUP BY 1, 2", FOLLOWS_SQL, recursive=True)
def recurse_all_with_cycles(spark: SparkSession, sf: str) -> DataFrame:
    g = T.follows(spark, sf).cached()
    return R.all_with_cycles(g.V(), lambda r: r.out("follows"), depth=3).df.groupBy("vid", F.col("__level").alias("level")).agg(F.count("*").alias("n"))


@query(_WALK.format(n=2) + "SELECT array_to_string(CASE WHEN list_contains(path[:-2], vid) THEN path[:-2] ELSE path END, '>') AS path FROM r", FOLLOWS_SQL, recursive=True)
def recurse_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = T.follows(spark, sf).cached()
    return R.all_paths(g.V(), lambda r: r.out("follows"), depth=2).df.select(_joined().alias("path"))


@query(", r AS (SELECT DISTINCT src AS vid, [src] AS path, 0 AS hop FROM e UNION ALL SELECT dst, list_append(path, dst), hop + 1 FROM r JOIN e ON src = vid WHERE hop < 2) SELECT array_to_string(path, '>') AS path FROM r", FOLLOWS_SQL, recursive=True)
def recurse_all_paths_with_cycles(spark: SparkSession, sf: str) -> DataFrame:
    g = T.follows(spark, sf).cached()
    return R.all_paths_with_cycles(g.V(), lambda r: r.out("follows"), depth=2).df.select(_joined().alias("path"))


@query(_FIRSTS + ", r AS (SELECT vid, [vid] AS path FROM s WHERE vid IN (SELECT src FROM e) UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN e ON src = vid) SELECT array_to_string(path, '>') AS path FROM r WHERE vid NOT IN (SELECT src FROM e)", NEXT_SQL, recursive=True)
def recurse_deepest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain of each customer with more than one order."""
    _, start = _firsts(spark, sf)
    return R.deepest_paths(start.lookahead(_next), _next).df.select(_joined().alias("path"))


_TO = ", r AS (SELECT 'nation:0' AS vid, ['nation:0'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN e ON src = vid WHERE vid NOT IN ('nation:3', 'nation:14') AND NOT list_contains(path[:-2], vid)) "


@query(_TO + "SELECT array_to_string(path, '>') AS path FROM r WHERE vid IN ('nation:3', 'nation:14')", TRADE_SQL, recursive=True)
def recurse_all_paths_to(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return R.all_paths_to(g.get_vertex("nation:0"), lambda e: e.isin("nation:3", "nation:14"), lambda r: r.out("trade")).df.select(_joined().alias("path"))


@query(_TO + "SELECT vid, count(*) AS n FROM r WHERE vid IN ('nation:3', 'nation:14') GROUP BY 1", TRADE_SQL, recursive=True)
def recurse_search(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return R.search(g.get_vertex("nation:0"), lambda e: e.isin("nation:3", "nation:14"), lambda r: r.out("trade")).group_count().toDF("vid", "n")


_CYC = ", r AS (SELECT DISTINCT src AS vid, [src] AS path FROM e UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN e ON src = vid WHERE NOT list_contains(path[:-2], vid)) "


@query(_CYC + "SELECT array_to_string(path, '>') AS path FROM r WHERE len(path) > 1 AND vid = path[1]", TRADE_SQL, recursive=True)
def recurse_cycle_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every closed path, from each of its vertices."""
    g = T.trade(spark, sf).cached()
    return R.all_cycle_paths(g.V().lookahead(lambda r: r.out("trade")), lambda r: r.out("trade")).df.select(_joined().alias("path"))


@query(_CYC + "SELECT vid, count(*) AS n FROM r WHERE len(path) > 1 AND vid = path[1] GROUP BY 1", TRADE_SQL, recursive=True)
def recurse_cycles(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return R.all_cycles(g.V().lookahead(lambda r: r.out("trade")), lambda r: r.out("trade")).group_count().toDF("vid", "n")


def _placed(spark: SparkSession, sf: str) -> Graph:
    """A forest: regions hold nations, nations hold customers."""
    nation, customer = T.read(spark, sf, "nation"), T.read(spark, sf, "customer")
    edges = nation.select(T.kinded("region", "n_regionkey").alias("src"), T.kinded("nation", "n_nationkey").alias("dst"))
    return Graph.from_edges(edges.unionByName(customer.select(T.kinded("nation", "c_nationkey").alias("src"), T.kinded("customer", "c_custkey").alias("dst"))), "holds")


_FOREST = ", t AS (SELECT vid, [vid] AS path FROM (SELECT DISTINCT src AS vid FROM e WHERE src LIKE 'region:%') WHERE {start} UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN e ON src = vid WHERE {go}) "
_BEFORE = "NOT (src = (SELECT x.src FROM e x WHERE x.dst = 'nation:14') AND dst {op} 'nation:14')"


def _is_region(e: F.Column) -> F.Column:
    return e.startswith("region:")


#: By name: control, and in SQL which starts and children are met and what is emitted.
_CONTROLS = {
    "plain": (None, "true", "true", "true"),
    "continue": (lambda p, e: R.continue_(), "true", "true", "false"),
    "skip_regions": (lambda p, e: F.when(_is_region(e), R.continue_()).otherwise(R.emit_()), "true", "src LIKE 'region:%'", "vid NOT LIKE 'region:%'"),
    "emit": (lambda p, e: R.emit_(), "true", "false", "true"),
    "cut": (lambda p, e: F.when(e == "nation:14", R.cut_()).otherwise(R.emit_and_continue()), "true", _BEFORE.format(op=">="), "true"),
    "emit_and_cut": (lambda p, e: F.when(e == "nation:14", R.emit_and_cut()).otherwise(R.emit_and_continue()), "true", _BEFORE.format(op=">") + " AND src <> 'nation:14'", "true"),
    "ignore": (lambda p, e: F.when(e == "nation:14", R.cut_()).when(e.startswith("customer:"), R.ignore()).otherwise(R.emit_and_continue()), "true", "src LIKE 'region:%' AND " + _BEFORE.format(op=">="), "true"),
    "emit_and_chain": (lambda p, e: F.when(_is_region(e), R.emit_and_chain()).otherwise(R.emit_and_continue()), "vid = 'region:0'", "true", "true"),
    "chain": (lambda p, e: F.when(_is_region(e), R.chain()).otherwise(R.emit_and_continue()), "vid = 'region:0'", "true", "vid NOT LIKE 'region:%'"),
}


def _control(name: str, control, start: str, go: str, emit: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = _placed(spark, sf)
        out = R.descend(g.V().filter(_is_region(F.col("vid"))), lambda r: r.out("holds"), control=control, ordered=True)
        return positioned(out.df, [F.col(c) for c in out.order], "place").select("place", "vid")

    run.__name__ = f"descend_{name}"
    query(_FOREST.format(start=start, go=go) + f"SELECT row_number() OVER (ORDER BY path) AS place, vid FROM t WHERE {emit}", PLACED_SQL, recursive=True)(run)


for _name, _how in _CONTROLS.items():
    _control(_name, *_how)


@query(_FOREST.format(start="true", go="true") + "SELECT array_to_string(path, '>') AS path FROM t", PLACED_SQL, recursive=True)
def descents_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Paths instead of elements."""
    g = _placed(spark, sf)
    return R.descend(g.V().filter(_is_region(F.col("vid"))), lambda r: r.out("holds"), paths=True).df.select(_joined().alias("path"))


@query(values("path", [("a",), ("b",), ("b>c",), ("b>c>d",), ("e",)]))
def descents_reset_path(spark: SparkSession, sf: str) -> DataFrame:
    """A reset empties the path before the element, for what is below it and for its later siblings."""
    g = Graph.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "src string, dst string"), "to")
    told = lambda p, e: F.when(e == "b", R.reset_path(R.emit_and_continue())).otherwise(R.emit_and_continue())
    return R.descend(g.get_vertex("a"), lambda r: r.out("to"), control=told, paths=True).df.select(_joined().alias("path"))


# -- algorithms on the trade graph


_REACH = ", p AS (SELECT src, dst FROM e), c AS (SELECT src AS a, dst AS b FROM p UNION SELECT a, dst FROM c JOIN p ON src = b) "


@query(_REACH + "SELECT vid, coalesce((SELECT min(x.b) FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a = vid AND x.b < vid), vid) AS component FROM (SELECT src AS vid FROM e UNION SELECT dst FROM e)", TRADE_SQL, recursive=True)
def algo_strong_components(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return A.strongly_connected_components(A.edge_list(g, "trade"), g.touching("trade").df)


@query(_REACH + "SELECT src, dst, doc FROM e WHERE EXISTS (SELECT 1 FROM c WHERE a = dst AND b = src)", TRADE_SQL, recursive=True)
def algo_strong_subgraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The edges inside components under a new label."""
    g = T.trade(spark, sf).cached()
    return A.strongly_connected_subgraphs(g, "trade", "inner", singletons=False).e.filter("label = 'inner'").select("src", "dst", "doc")


@query("SELECT doc_id AS vid, min(doc_id) OVER (PARTITION BY text) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def algo_connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return A.connected_components(T.same_text(spark, sf), "same_text")


_CYCLE_SQL = ", r AS (SELECT src AS root, dst AS tip, [src, dst] AS walk FROM e WHERE dst >= src UNION ALL SELECT root, dst, list_append(walk, dst) FROM r JOIN e ON src = tip WHERE tip <> root AND dst >= root AND (dst = root OR NOT list_contains(walk, dst))) "


@query(_CYCLE_SQL + "SELECT array_to_string(walk, '>') AS cycle FROM r WHERE tip = root", TRADE_SQL, recursive=True)
def algo_cycles(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return A.elementary_cycles(A.edge_list(g, "trade")).select(_joined("cycle").alias("cycle"))


_SHORT = ", r AS (SELECT 'nation:0' AS tip, ['nation:0'] AS path, 0 AS cost UNION ALL SELECT dst, list_append(path, dst), cost + {w} FROM r JOIN e ON src = tip WHERE NOT list_contains(path, dst)) "


@query(_SHORT.format(w="1") + "SELECT array_to_string(path, '>') AS path, CAST(cost AS DOUBLE) AS cost FROM r WHERE tip IN ('nation:3', 'nation:14') ORDER BY cost, path LIMIT 1", TRADE_SQL, recursive=True)
def algo_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return A.shortest_path(g, "trade", g.get_vertex("nation:0").df, lambda v: v.isin("nation:3", "nation:14")).select(_joined("path").alias("path"), "cost")


@query(_SHORT.format(w="doc") + "SELECT array_to_string(path, '>') AS path, CAST(cost AS DOUBLE) AS cost FROM r WHERE tip IN ('nation:8', 'nation:14') ORDER BY cost, path LIMIT 1", TRADE_SQL, recursive=True)
def algo_cheapest_path(spark: SparkSession, sf: str) -> DataFrame:
    """Least sum of documents to the first of several ends."""
    g = T.trade(spark, sf).cached()
    return A.shortest_path(g, "trade", g.get_vertex("nation:0").df, lambda v: v.isin("nation:8", "nation:14"), cost=lambda d: d).select(_joined("path").alias("path"), "cost")


_DOM = """, live AS (SELECT 'nation:0' AS v UNION SELECT dst FROM live JOIN e ON src = v),
without AS (SELECT v AS gone, 'nation:0' AS v FROM live WHERE v <> 'nation:0' UNION SELECT gone, dst FROM without JOIN e ON src = v WHERE dst <> gone),
dom AS (SELECT a.v AS d, b.v AS vid FROM live a JOIN live b ON a.v = b.v OR a.v = 'nation:0' OR NOT EXISTS (SELECT 1 FROM without w WHERE w.gone = a.v AND w.v = b.v)),
depth AS (SELECT vid, count(*) AS n FROM dom GROUP BY 1),
idom AS (SELECT vid, coalesce((SELECT d FROM dom x JOIN depth ON depth.vid = x.d WHERE x.vid = l.vid AND x.d <> x.vid ORDER BY n DESC LIMIT 1), vid) AS idom FROM depth l) """


@query(_DOM + "SELECT vid, idom FROM idom", TRADE_SQL, recursive=True)
def algo_immediate_dominators(spark: SparkSession, sf: str) -> DataFrame:
    return A.immediate_dominators(A.edge_list(T.trade(spark, sf), "trade"), "nation:0")


@query(_DOM + "SELECT vid, CAST(n - 1 AS INTEGER) AS depth FROM depth", TRADE_SQL, recursive=True)
def algo_dominator_depth(spark: SparkSession, sf: str) -> DataFrame:
    return A.dominator_depth(A.immediate_dominators(A.edge_list(T.trade(spark, sf), "trade"), "nation:0"))


@query(_DOM + "SELECT DISTINCT x.d AS vid, e.dst AS frontier FROM e JOIN dom x ON x.vid = e.src WHERE (SELECT count(*) FROM e y WHERE y.dst = e.dst) >= 2 AND NOT EXISTS (SELECT 1 FROM dom z WHERE z.d = x.d AND z.vid = e.dst AND z.d <> z.vid)", TRADE_SQL, recursive=True)
def algo_dominance_frontiers(spark: SparkSession, sf: str) -> DataFrame:
    return A.dominance_frontiers(A.edge_list(T.trade(spark, sf), "trade"), "nation:0")


@query(", r AS (SELECT 'nation:0' AS vid, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN e ON src = vid WHERE level < 30) SELECT vid, min(level) AS level FROM r GROUP BY 1", TRADE_SQL, recursive=True)
def algo_breadth_first(spark: SparkSession, sf: str) -> DataFrame:
    g = T.trade(spark, sf).cached()
    return A.breadth_first(g.get_vertex("nation:0"), lambda r: r.out("trade"))


@query(_SHORT.format(w="0") + "SELECT DISTINCT unnest(path) AS vid FROM r WHERE tip = (SELECT max(b.dst) FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'nation:0' AND b.dst <> 'nation:0')", TRADE_SQL, recursive=True)
def algo_vertices_between(spark: SparkSession, sf: str) -> DataFrame:
    """To the greatest vertex two steps away."""
    g = T.trade(spark, sf).cached()
    end = g.get_vertex("nation:0").iter(2, lambda r: r.out("trade")).isnt("nation:0").df.agg(F.max("vid")).first()[0]
    return A.vertices_between(A.edge_list(g, "trade"), "nation:0", end)


@query("SELECT false AS trade, true AS next_order")
def algo_acyclic(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(A.is_acyclic(T.trade(spark, sf), "trade"), A.is_acyclic(T.next_order(spark, sf), "next"))], "trade boolean, next_order boolean")


# -- order-dependent algorithms, on graphs with known results


def _flow(name: str) -> O.FlowGraph:
    return O.FlowGraph.from_pairs(X.ENTRY[name], X.pairs(name))


def _golden(name: str, columns: str, kinds: str, rows: list[tuple], run) -> None:
    def call(spark: SparkSession, sf: str) -> DataFrame:
        return spark.createDataFrame(run(spark), ", ".join(f"{c.strip()} {k}" for c, k in zip(columns.split(","), kinds.split(), strict=True)))

    call.__name__ = name
    casts = ", ".join(f"CAST({c.strip()} AS {'VARCHAR' if k == 'string' else 'INTEGER'}) AS {c.strip()}" for c, k in zip(columns.split(","), kinds.split(), strict=True))
    query(f"SELECT {casts} FROM ({values(columns, rows)})")(call)


_ENTERED = _FOREST.format(start="vid = 'region:0'", go="true")


def _walk(name: str, order: str, run) -> None:
    """Numbers of what region 0 holds, in one of a flow graph's orders."""

    def call(spark: SparkSession, sf: str) -> DataFrame:
        numbered = run(O.FlowGraph.of(_placed(spark, sf), "holds", "region:0"))
        return spark.createDataFrame(list(numbered.items()), "vid string, n int")

    call.__name__ = name
    query(_ENTERED + f"SELECT vid, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS n FROM t", PLACED_SQL, recursive=True)(call)


# '~' sorts after every id: an element follows all that it holds
_walk("order_post_order", "list_append(path, '~')", lambda f: f.post_order_numbering())
_walk("order_reverse_post_order", "list_append(path, '~') DESC", lambda f: f.reverse_post_order_numbering())
_walk("order_breadth_first", "len(path), path", lambda f: {v: n for n, v in enumerate(f.breadth_first())})


@query(_ENTERED + "SELECT string_agg(vid, ' ' ORDER BY path) AS text FROM t", PLACED_SQL, recursive=True)
def order_prewalk_fold(spark: SparkSession, sf: str) -> DataFrame:
    walked = O.FlowGraph.of(_placed(spark, sf), "holds", "region:0").prewalk_reduce("", lambda acc, v: f"{acc} {v}" if acc else v)
    return spark.createDataFrame([(walked,)], "text string")


_golden(
    "order_intervals", "graph, members", "string string",
    [("flow", "A,B,C,D,F,G,J,S"), ("flow", "E,H"), ("flow", "I"), ("flow", "K"), ("flow2", "A,S"), ("flow2", "B"), ("flow2", "C,D,E"), ("flow2", "F,G,H,I"), ("flow2", "J,K"), ("flow2", "L,M,N"), ("flow2", "O"), ("flow2", "P,Q")],
    lambda s: [(g, ",".join(sorted(i))) for g in ("flow", "flow2") for i in _flow(g).intervals()],
)
_golden(
    "order_loop_tree", "graph, head, tail, parent, depth", "string string string string int",
    [("p46", "head", "body", None, 0), ("double", "head", "body", None, 0), ("double", "body-head", "body-body", "head>body", 1), ("irreducible", "2", "1", None, 0), ("loops", "01", "09", None, 0), ("loops", "03", "08", "01>09", 1), ("loops", "03", "04", "03>08", 2), ("loops", "04", "07", "03>08", 2), ("loops", "07", "10", "03>08", 2)],
    lambda s: [(g, h, t, ">".join(x["parent"]) if x["parent"] else None, x["depth"]) for g in ("p46", "double", "irreducible", "loops") for (h, t), x in _flow(g).loop_tree().items()],
)
_golden(
    "order_loop_info", "vid, depth", "string int",
    [("entry", 0), ("result", 0), ("head", 1), ("body", 1), ("body-entry", 1), ("body-result", 1), ("body-head", 2), ("body-body", 2)],
    lambda s: [(v, x["depth"]) for v, x in _flow("double").loop_info().items()],
)


@query(values("block", [("a,b,c",), ("c,d",), ("d,e,f",), ("g,h",)]))
def order_biconnected_components(spark: SparkSession, sf: str) -> DataFrame:
    found = O.biconnected_components(X.fixture(spark, "blocks", edge_type="undirected"), "to")
    return found.groupBy("component", F.col("block").alias("b")).agg(F.concat_ws(",", F.array_sort(F.collect_list("vid"))).alias("block")).select("block")


_SPLIT = """
, m AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)
, r AS (SELECT a AS gone, min(b) AS vid FROM m GROUP BY 1 UNION SELECT gone, b FROM r JOIN m ON a = vid WHERE b <> gone)
, c AS (SELECT a AS v, b AS vid FROM m UNION SELECT v, b FROM c JOIN m ON a = vid)
SELECT DISTINCT v AS vid FROM c WHERE v <> vid AND NOT EXISTS (SELECT 1 FROM r WHERE gone = v AND r.vid = c.vid)
"""


def _partners(spark: SparkSession, sf: str) -> Graph:
    """Suppliers' and customers' nations of the trade graph's strongest edges, without direction."""
    best = T.trade(spark, sf, top=1).e
    pairs = best.select(F.lit("trade").alias("label"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(T.trade(spark, sf).v, pairs, {"trade": "undirected"})


@query(_SPLIT, TRADE_SQL.replace("r <= 2", "r <= 1"), recursive=True)
def order_articulation_points(spark: SparkSession, sf: str) -> DataFrame:
    return O.articulation_points(_partners(spark, sf), "trade")


# -- recipes


@query("SELECT vid, CAST(out_n AS BIGINT) AS out_n, CAST(in_n AS BIGINT) AS in_n FROM (" + values("vid, out_n, in_n", [("a", 1, 0), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 2), ("f", 0, 1)]) + ")")
def recipe_degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    r = X.fixture(spark, "betweenness", "next").V()
    return r.out_degree("next").withColumnRenamed("count", "out_n").join(r.in_degree("next").withColumnRenamed("count", "in_n"), "vid").select("vid", "out_n", "in_n")


@query("SELECT vid, CAST(n AS BIGINT) AS n FROM (" + values("vid, n", [("a", 15), ("b", 29), ("c", 21), ("d", 21), ("e", 29), ("f", 15)]) + ")")
def recipe_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    """How often each vertex lies on a shortest path between two vertices, both ways along edges."""
    g = X.fixture(spark, "betweenness", "next").cached()
    paths = R.all_paths(g.V(), lambda r: r.both("next"))
    ends = paths.df.select("value", F.element_at("value", 1).alias("a"), F.element_at("value", -1).alias("b"), F.size("value").alias("n")).distinct()
    least = ends.groupBy("a", "b").agg(F.min("n").alias("n"))
    return ends.join(least, ["a", "b", "n"]).select(F.explode("value").alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))


@query(values("path", [("a>b>c>a",), ("b>c>a>b",), ("c>a>b>c",)]))
def recipe_cycle_detection(spark: SparkSession, sf: str) -> DataFrame:
    g = X.fixture(spark, "knows", "knows").cached()
    return R.all_cycle_paths(g.V(), lambda r: r.out("knows")).df.select(_joined().alias("path"))


@query(values("buyer, n, items", [("alice", 4, "10,8"), ("alice", 5, "2,9"), ("alice", 6, "1"), ("bob", 2, "10,6,8"), ("bob", 3, "7,9"), ("jon", 2, "1,3,5"), ("jon", 3, "2,4"), ("jack", 2, "10,6,8"), ("jack", 3, "2,4"), ("jill", 2, "1,3,5"), ("jill", 3, "7,9")]).replace("SELECT *", "SELECT buyer, CAST(n AS BIGINT) AS n, items") + " WHERE buyer <> 'alice'")
def recipe_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    """Items that those who share purchases bought, by how many paths lead to them."""
    g = X.purchases(spark)
    r = g.V("person").filter("vid <> 'person:alice'").context(lambda s, e: s.in_("bought").filter(F.col("vid") != e).remove(F.col("vid") == "person:alice").out("bought"), lambda x: x.out("bought"))
    own = g.E("bought").df.select(F.col("src").alias("origin"), F.col("dst").alias("vid"))
    counts = r.df.join(own, ["origin", "vid"], "left_anti").groupBy("origin", "vid").agg(F.count("*").alias("n"))
    return counts.groupBy(T.key_of(F.col("origin")).alias("buyer"), "n").agg(F.concat_ws(",", F.array_sort(F.collect_list(T.key_of(F.col("vid"))))).alias("items"))


@query(values("job, software, created, application", [("blueprintsJob1", "blueprints", "12/16/2015", "appStephen2"), ("rexsterJob1", "rexster", "12/15/2015", "appStephen1")]))
def recipe_multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that a person's applications led to, with a field of the first edge: nested bindings as joins."""
    g = X.job_graph(spark)
    created = g.get_vertex("stephen").out_e("created").with_documents().select(F.col("dst").alias("application"), F.col("doc").alias("created"))
    software = g.E("appliesTo").df.select(F.col("src").alias("application"), F.col("dst").alias("software"))
    jobs = g.E("completes").df.select(F.col("dst").alias("application"), F.col("src").alias("job"))
    return created.join(software, "application").join(jobs, "application").select("job", "software", "created", "application")


# -- motifs and layout


_MIRROR = ", m AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) "


@query(_MIRROR + "SELECT s.src AS v0, s.dst AS v1, y.b AS v2 FROM e s JOIN m y ON y.a = s.dst JOIN m z ON z.a = y.b AND z.b = s.src WHERE s.src <> s.dst AND y.b NOT IN (s.src, s.dst)", TRADE_SQL)
def motif_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return M.shapes(T.trade(spark, sf), 3, "trade")


@query(_MIRROR + "SELECT s.src AS vid, count(*) AS squares FROM e s JOIN m y ON y.a = s.dst JOIN m z ON z.a = y.b JOIN m w ON w.a = z.b AND w.b = s.src WHERE s.src <> s.dst AND y.b NOT IN (s.src, s.dst) AND z.b NOT IN (s.src, s.dst, y.b) AND NOT EXISTS (SELECT 1 FROM m t WHERE t.a = s.src AND t.b = y.b) GROUP BY 1", TRADE_SQL)
def motif_squares(spark: SparkSession, sf: str) -> DataFrame:
    return M.squares(T.trade(spark, sf), "trade")


@query("SELECT src, dst, CAST(a - b AS DOUBLE) AS vx, 0.0::DOUBLE AS vy, CAST(abs(a - b) AS DOUBLE) AS length FROM (SELECT src, dst, CAST(split_part(src, ':', 2) AS INTEGER) AS a, CAST(split_part(dst, ':', 2) AS INTEGER) AS b FROM e)", TRADE_SQL)
def layout_edges_measured(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and lengths, with the vertices on a line by their number."""
    g = T.trade(spark, sf)
    vertices = g.v.select("vid", T.key_of(F.col("vid")).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return L.measured(L.edge_table(g, "trade"), vertices).select("src", "dst", "vx", "vy", "length")


@query("SELECT CAST(25 AS BIGINT) AS vertices, true AS finite, true AS apart")
def layout_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Five iterations: every vertex has a finite place, and no two share one."""
    done = L.run(T.trade(spark, sf).cached(), 5, "trade")
    finite = F.bool_and(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < 1e12))
    return done.vertices.agg(F.count("*").alias("vertices"), finite.alias("finite"), (F.count_distinct("x", "y") == F.count("*")).alias("apart"))
