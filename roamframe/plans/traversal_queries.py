"""Queries over the commerce graph: construction, scans, steps, filters, sections, order, aggregates, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.graph import Graph, GraphBuilder
from roamframe.functions import paths as P
from roamframe.operators.views import GraphView, single, wrap_graph
from roamframe.plans.registry import FOLLOWS_SQL, commerce_query, query
from roamframe.route import Route, merge_exhaustive, merge_round_robin
from roamframe.sources import tables as T


def _rows(route: Route, name: str = "vid") -> DataFrame:
    return route.df.select(F.col(route.keys[0]).alias(name))


def _brand(r: Route, brand: str = "Brand#2") -> Route:
    return r.has_property("brand", brand)


def _text(column: str) -> F.Column:
    return F.concat_ws(",", F.array_sort(F.col(column)))


@query("""
SELECT 'nation:' || c_nationkey AS vid, count(*) AS n FROM customer WHERE c_custkey IN (
    SELECT o_custkey FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' GROUP BY o_custkey HAVING count(*) >= 2)
GROUP BY 1""")
def flagship_brand_buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who bought at least two items of a brand, per nation."""
    buyers = T.commerce(spark, sf).V("customer").lookahead(lambda r: _brand(r.out("placed").out("contains")), min=2)
    return buyers.out("lives_in").group_count().select(F.col("key").alias("vid"), F.col("count").alias("n"))


# -- construction


@query("SELECT 'nation:' || n_nationkey AS vid, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS doc FROM nation")
def graph_add_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Documents replace earlier ones; a null never does."""
    rows = T.read(spark, sf, "nation").select(T.kinded("nation", "n_nationkey").alias("vid"), F.col("n_name").alias("doc"), "n_nationkey")
    builder = GraphBuilder(spark).add_vertices(rows.select("vid", "doc"))
    builder.add_vertices(rows.filter("n_nationkey % 3 = 0").select("vid", F.concat(F.lit("new "), "doc").alias("doc")))
    builder.add_vertices(rows.filter("n_nationkey % 2 = 0").select("vid", F.lit(None).cast("string").alias("doc")))
    loop = rows.limit(1).select(F.col("vid").alias("src"), F.col("vid").alias("dst"))
    return builder.add_edges("self", loop).freeze().v.select("vid", "doc")


def _contains(spark: SparkSession, sf: str, rule: str) -> Graph:
    rows = T.contains_rows(spark, sf)
    return GraphBuilder(spark).edge_rule("contains", rule).add_edges("contains", rows, order=F.col("nth")).freeze()


@query("""SELECT src, dst, doc FROM (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_quantity AS doc,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_shipdate DESC) AS r FROM lineitem) WHERE r = 1""")
def graph_edges_unique(spark: SparkSession, sf: str) -> DataFrame:
    """The last document of a repeated edge wins."""
    return _contains(spark, sf, "unique").e.select("src", "dst", "doc")


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, sum(l_quantity) AS doc FROM lineitem GROUP BY 1, 2")
def graph_edges_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a repeated edge add up."""
    return _contains(spark, sf, "weighted").e.select("src", "dst", "doc")


@query("""SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, count(*) AS n,
    string_agg(CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_suppkey, l_shipdate) AS docs FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def graph_edges_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a repeated edge, in order."""
    rows = _contains(spark, sf, "parallel").e.filter("doc.n > 1")
    return rows.select("src", "dst", F.col("doc.n").alias("n"), F.concat_ws(",", F.transform("doc.docs", lambda d: d.cast("bigint").cast("string"))).alias("docs"))


@query("SELECT 'hub' AS src, 'nation:' || n_nationkey AS dst, n_name AS doc FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'hub', NULL FROM region")
def graph_add_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from one vertex to many, and from many to one."""
    nations = T.read(spark, sf, "nation").select(T.kinded("nation", "n_nationkey").alias("vid"), F.col("n_name").alias("doc"))
    regions = T.read(spark, sf, "region").select(T.kinded("region", "r_regionkey").alias("vid"))
    return GraphBuilder(spark).add_edges_from("out", "hub", nations).add_edges_to("in", regions, "hub").freeze().e.select("src", "dst", "doc")


@commerce_query("SELECT vid, CASE WHEN kind = 'nation' THEN 'set' ELSE r_name END AS doc FROM v LEFT JOIN region ON vid = 'region:' || r_regionkey WHERE kind IN ('region', 'nation') UNION ALL SELECT 'extra', 'set'")
def graph_set_documents(spark: SparkSession, sf: str) -> DataFrame:
    """New documents, also for ids that are new."""
    g = T.commerce(spark, sf)
    plain = Graph(g.v.filter("kind in ('region', 'nation')").select("vid", "kind", F.col("doc.name").alias("doc")), g.e.filter("label = 'in_region'").select("label", "src", "dst"))
    new = g.V("nation").df.select("vid", F.lit("set").alias("doc")).unionByName(spark.createDataFrame([("extra", "set")], "vid string, doc string"))
    return plain.set_documents(new).v.select("vid", "doc")


@query("SELECT 'region:' || r_regionkey AS vid, CASE WHEN r_regionkey < 2 THEN lower(r_name) ELSE r_name END AS doc FROM region")
def graph_update_document(spark: SparkSession, sf: str) -> DataFrame:
    regions = T.read(spark, sf, "region").select(T.kinded("region", "r_regionkey").alias("vid"), F.lit("region").alias("kind"), F.col("r_name").alias("doc"))
    g = Graph(regions, Graph.empty(spark).e)
    return g.update_documents(F.lower, F.col("vid").isin("region:0", "region:1")).v.select("vid", "doc")


@commerce_query("SELECT kind, count(*) AS n FROM v WHERE kind <> 'part' OR vid IN (SELECT dst FROM e WHERE label = 'contains') OR vid IN (SELECT dst FROM e WHERE label = 'supplies') GROUP BY 1")
def graph_remove_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices without edges go with their documents."""
    g = T.commerce(spark, sf)
    return g.remove_documents(g.V("part").df).v.groupBy("kind").agg(F.count("*").alias("n"))


@commerce_query("SELECT label, count(*) AS n FROM e WHERE src NOT IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 0) AND dst NOT IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY 1")
def graph_remove_vertices(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    gone = g.route(["region:0"]).in_("in_region").df
    return g.remove_vertices(gone).e.groupBy("label").agg(F.count("*").alias("n"))


@commerce_query("SELECT label, count(*) AS n FROM e WHERE NOT (label = 'lives_in' AND dst = 'nation:3') GROUP BY 1")
def graph_remove_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    return g.remove_edges(g.route(["nation:3"]).in_e("lives_in").df).e.groupBy("label").agg(F.count("*").alias("n"))


@commerce_query("SELECT DISTINCT label FROM e WHERE label <> 'contains'")
def graph_remove_all_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).remove_all_edges("contains").labels()


@commerce_query("SELECT label, dst AS src, src AS dst FROM e WHERE label IN ('lives_in', 'in_region')")
def graph_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).transposed(["lives_in", "in_region"]).e.select("label", "src", "dst")


@query("SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 3 AS doc FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END FROM customer WHERE c_custkey % 2 = 1")
def graph_merge_with(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of edges that both graphs hold are added by the resolver."""
    rows = T.read(spark, sf, "customer").select("c_custkey", T.kinded("customer", "c_custkey").alias("src"), T.kinded("nation", "c_nationkey").alias("dst"))
    one = Graph.from_edges(rows.filter("c_custkey % 2 = 0 or c_custkey % 3 <> 0").select("src", "dst", F.lit(1).alias("doc")), "lives_in")
    two = Graph.from_edges(rows.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").select("src", "dst", F.lit(2).alias("doc")), "lives_in")
    return one.merge_with(lambda a, b: a + b, lambda a, b: b, two).e.select("src", "dst", "doc")


@query("SELECT 'nation:' || n_nationkey AS vid, CASE WHEN n_regionkey = 1 THEN 'later' ELSE n_name END AS doc FROM nation")
def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Later documents win."""
    rows = T.read(spark, sf, "nation").select(T.kinded("nation", "n_nationkey").alias("vid"), F.col("n_name").alias("doc"), "n_regionkey")
    none = Graph.empty(spark).e
    return Graph(rows.select("vid", "doc"), none).merge(Graph(rows.filter("n_regionkey = 1").select("vid", F.lit("later").alias("doc")), none)).v.select("vid", "doc")


@commerce_query("SELECT a.label, a.src, a.dst FROM e a WHERE a.label = 'in_region' AND a.dst = 'region:1' AND a.src IN (SELECT dst FROM e WHERE label = 'based_in') UNION ALL SELECT a.label, a.src, a.dst FROM e a JOIN e b ON a.dst = b.src AND b.label = 'in_region' AND b.dst = 'region:1' WHERE a.label = 'based_in'")
def graph_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of the edges on a route's paths."""
    route = T.commerce(spark, sf).route(["region:1"]).with_paths().in_("in_region").in_("based_in")
    return route.subgraph().e.select("label", "src", "dst")


@query("SELECT 'customer:' || c_custkey AS vid, 'nation:' || c_nationkey AS other FROM customer UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer")
def graph_undirected_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of an undirected label, whichever way it was added."""
    rows = T.read(spark, sf, "customer").select(T.kinded("customer", "c_custkey").alias("src"), T.kinded("nation", "c_nationkey").alias("dst"))
    g = GraphBuilder(spark).add_edges("lives_in", rows, "undirected").freeze()
    scan = g.scan("lives_in")
    return scan.select(F.col("src").alias("vid"), F.col("dst").alias("other"))


@query("SELECT src, dst, doc AS weight FROM e", FOLLOWS_SQL)
def graph_from_triples(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.follows(spark, sf).e.select("src", F.col("doc").cast("bigint").alias("weight"), "dst")
    return Graph.from_triples(rows).e.select("src", "dst", F.col("doc").alias("weight"))


@query("SELECT src, dst, CAST(doc AS DOUBLE) * 2 AS doc FROM e", FOLLOWS_SQL)
def graph_builder_extends(spark: SparkSession, sf: str) -> DataFrame:
    """A builder that starts from a graph adds to its edges' weights."""
    g = T.follows(spark, sf)
    return g.builder().edge_rule("follows", "weighted").add_edges("follows", T.follows_rows(spark, sf).withColumn("doc", F.lit(1.0))).freeze().e.select("src", "dst", "doc")


# -- scans and lookups


@commerce_query("SELECT kind, count(*) AS n FROM v GROUP BY 1")
def scan_all_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).V().df.withColumn("kind", T.kind_of(F.col("vid"))).groupBy("kind").agg(F.count("*").alias("n"))


@commerce_query("SELECT vid FROM v WHERE kind = 'supplier'")
def scan_vertices_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("supplier"))


@commerce_query("SELECT src AS vid FROM e WHERE label IN ('based_in', 'in_region') UNION SELECT dst FROM e WHERE label IN ('based_in', 'in_region')")
def scan_vertices_with_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).touching(["based_in", "in_region"]))


@commerce_query("SELECT label, count(*) AS n FROM e GROUP BY 1")
def scan_all_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).E().df.groupBy("label").agg(F.count("*").alias("n"))


@commerce_query("SELECT label, src, dst, true AS fwd FROM e WHERE label = 'in_region'")
def scan_edges_with_label(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).E("in_region").df


@query("SELECT 'nobody' AS vid")
def lookup_get_vertex(spark: SparkSession, sf: str) -> DataFrame:
    """A handle needs no vertex."""
    return _rows(T.commerce(spark, sf).get_vertex("nobody"))


@query("SELECT 'nation:7' AS vid UNION ALL SELECT 'region:0'")
def lookup_get_vertex_or_default(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    return _rows(g.get_vertex_or("nation:7")).unionByName(_rows(g.get_vertex_or("nobody", "region:0")))


@commerce_query("SELECT vid FROM v WHERE kind = 'nation' AND vid IN (SELECT dst FROM e WHERE label = 'based_in')")
def lookup_reload(spark: SparkSession, sf: str) -> DataFrame:
    """The elements of a route that another graph has."""
    g = T.commerce(spark, sf)
    return _rows(g.edge_graph("based_in").reload(g.V("nation")))


@query("SELECT 'nation:3' AS vid, true AS known, true AS touched UNION ALL SELECT 'nation:99', false, false")
def lookup_has_vertex(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    return spark.createDataFrame([(v, g.has_vertex(v), g.has_vertex(v, "in_region")) for v in ("nation:3", "nation:99")], "vid string, known boolean, touched boolean")


@query("SELECT 'region:2' AS vid")
def lookup_exists(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).route(["region:2", "nobody"]).exists())


@query("SELECT 'in_region' AS label, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation WHERE n_nationkey = 4")
def lookup_get_edge(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    to = T.read(spark, sf, "nation").filter("n_nationkey = 4").first()["n_regionkey"]
    return g.get_edge("in_region", "nation:4", f"region:{to}").df.select("label", "src", "dst")


@commerce_query("SELECT vid FROM v WHERE kind = 'nation' AND vid IN (SELECT dst FROM e WHERE label = 'lives_in')")
def lookup_edges_with_label(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("nation").edges_with_label("lives_in"))


@commerce_query("SELECT DISTINCT label FROM e")
def lookup_labels(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).labels()


@commerce_query("SELECT vid FROM v WHERE kind = 'region'")
def lookup_ids_with_document(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).ids_with_document().filter(F.col("vid").startswith("region:"))


@query("SELECT 'nation:' || n_nationkey AS vid, n_name AS name FROM nation")
def element_documents(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).V("nation").with_documents().select("vid", F.col("doc.name").alias("name"))


@query("SELECT true AS same, false AS other")
def graph_equality(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf).edge_graph("in_region")
    return spark.createDataFrame([(g.equals(g.transposed().transposed()), g.equals(g.transposed()))], "same boolean, other boolean")


# -- steps


@commerce_query("SELECT label, src, dst FROM e WHERE src LIKE 'supplier:%' AND label = 'based_in'")
def step_out_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).V("supplier").out_e("based_in").df.select("label", "src", "dst")


@commerce_query("SELECT label, src, dst, false AS fwd FROM e WHERE dst LIKE 'nation:%' AND label IN ('lives_in', 'based_in')")
def step_in_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).V("nation").in_e(["lives_in", "based_in"]).df.select("label", "src", "dst", "fwd")


@query("SELECT src AS vid, src, dst, true AS fwd FROM e UNION ALL SELECT dst, src, dst, false FROM e", FOLLOWS_SQL)
def step_both_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A self-loop comes twice."""
    r = T.follows(spark, sf).V().both_e("follows")
    return r.df.select(F.when(F.col("fwd"), F.col("src")).otherwise(F.col("dst")).alias("vid"), "src", "dst", "fwd")


@commerce_query("SELECT b.dst AS vid, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND b.label = 'contains' WHERE a.label = 'placed' GROUP BY 1")
def step_out_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops; multiplicity is kept."""
    return T.commerce(spark, sf).V("customer").out("placed").out("contains").group_count().toDF("vid", "n")


@commerce_query("SELECT a.src AS vid FROM e a WHERE a.label = 'in_region' AND a.dst = 'region:2'")
def step_in(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).get_vertex("region:2").in_("in_region"))


@query("SELECT vid, count(*) AS n FROM (SELECT dst AS vid FROM e UNION ALL SELECT src FROM e) GROUP BY 1", FOLLOWS_SQL)
def step_both(spark: SparkSession, sf: str) -> DataFrame:
    return T.follows(spark, sf).V().both("follows").group_count().toDF("vid", "n")


def _grouped(name: str, sql: str, call) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = T.commerce(spark, sf)
        return call(g).select(F.col("element").alias("vid"), F.concat_ws(",", F.transform("items", lambda x: x if not name.endswith("edges_grouped") else x["dst"])).alias("items"))

    run.__name__ = name
    commerce_query(sql)(run)


_grouped("step_out_grouped", "SELECT vid, coalesce(string_agg(dst, ',' ORDER BY dst), '') AS items FROM v LEFT JOIN e ON src = vid AND label = 'in_region' WHERE kind IN ('nation', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("nation", "region")).out_grouped("in_region"))
_grouped("step_in_grouped", "SELECT vid, coalesce(string_agg(src, ',' ORDER BY src), '') AS items FROM v LEFT JOIN e ON dst = vid AND label = 'in_region' WHERE kind IN ('nation', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("nation", "region")).in_grouped("in_region"))
_grouped("step_both_grouped", "SELECT vid, coalesce(string_agg(o, ',' ORDER BY o), '') AS items FROM v LEFT JOIN (SELECT src AS x, dst AS o FROM e WHERE label = 'in_region' UNION ALL SELECT dst, src FROM e WHERE label = 'in_region') ON x = vid WHERE kind IN ('nation', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("nation", "region")).both_grouped("in_region"))
_grouped("step_out_edges_grouped", "SELECT vid, coalesce(string_agg(dst, ',' ORDER BY label, src, dst), '') AS items FROM v LEFT JOIN e ON src = vid AND label = 'based_in' WHERE kind IN ('supplier', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("supplier", "region")).out_e_grouped("based_in"))
_grouped("step_in_edges_grouped", "SELECT vid, coalesce(string_agg(dst, ',' ORDER BY label, src, dst), '') AS items FROM v LEFT JOIN e ON dst = vid AND label = 'based_in' WHERE kind IN ('nation', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("nation", "region")).in_e_grouped("based_in"))
_grouped("step_both_edges_grouped", "SELECT vid, coalesce(string_agg(d, ',' ORDER BY s, d), '') AS items FROM v LEFT JOIN (SELECT src AS x, src AS s, dst AS d FROM e WHERE label = 'in_region' UNION ALL SELECT dst, src, dst FROM e WHERE label = 'in_region') ON x = vid WHERE kind IN ('nation', 'region') GROUP BY 1", lambda g: g.V(lambda k: k.isin("nation", "region")).both_e_grouped("in_region"))


@query("SELECT 'customer:' || o_custkey AS customer, 'order:' || o_orderkey AS vid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, 'order:' || o_orderkey) AS INTEGER) AS place FROM orders")
def step_out_sorted(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("customer").out_sorted("placed", lambda x: F.col("total"), lambda x: x.by_doc(lambda d: d["total"], "total"))
    return r.df.select(F.col(r.order[-2]).alias("customer"), "vid", F.col(r.order[-1]).alias("place"))


@query("SELECT 'nation:' || s_nationkey AS nation, 'supplier:' || s_suppkey AS vid, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, 'supplier:' || s_suppkey) AS INTEGER) AS place FROM supplier")
def step_in_sorted(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("nation").in_sorted("based_in", lambda x: F.col("balance"), lambda x: x.by_doc(lambda d: d["balance"], "balance"))
    return r.df.select(F.col(r.order[-2]).alias("nation"), "vid", F.col(r.order[-1]).alias("place"))


@commerce_query("SELECT src AS vid FROM e WHERE label = 'in_region' UNION ALL SELECT dst FROM e WHERE label = 'based_in' UNION ALL SELECT unnest([dst, src]) FROM e WHERE label = 'in_region'")
def step_edge_ends(spark: SparkSession, sf: str) -> DataFrame:
    """out_v, in_v and both_v."""
    g = T.commerce(spark, sf)
    return _rows(g.E("in_region").out_v()).unionByName(_rows(g.E("based_in").in_v())).unionByName(_rows(g.E("in_region").both_v()))


@commerce_query("SELECT 'other' AS end_, src AS vid FROM e WHERE label = 'in_region' UNION ALL SELECT 'same', dst FROM e WHERE label = 'in_region'")
def step_other_and_same(spark: SparkSession, sf: str) -> DataFrame:
    edges = T.commerce(spark, sf).V("region").in_e("in_region")
    return edges.other_v().df.select(F.lit("other").alias("end_"), "vid").unionByName(edges.same_v().df.select(F.lit("same").alias("end_"), "vid"))


@commerce_query("SELECT true AS fwd, count(*) AS n FROM e WHERE label = 'in_region' UNION ALL SELECT false, count(*) FROM e WHERE label IN ('based_in', 'lives_in')")
def step_followed(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("nation").both_e(["in_region", "based_in", "lives_in"])
    rows = r.followed_forward().df.unionByName(r.followed_reverse().df)
    return rows.groupBy("fwd").agg(F.count("*").alias("n"))


@commerce_query("""SELECT vid, (SELECT count(*) FROM e WHERE src = vid) AS out_n, (SELECT count(*) FROM e WHERE dst = vid AND label <> 'placed') AS in_n,
    (SELECT count(*) FROM e WHERE src = vid) + (SELECT count(*) FROM e WHERE dst = vid) AS degree FROM v WHERE kind IN ('nation', 'region')""")
def step_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    r = g.V(lambda k: k.isin("nation", "region"))
    labels = ["in_region", "lives_in", "based_in", "contains", "supplies"]
    out = r.out_edge_count().withColumnRenamed("count", "out_n").join(r.in_edge_count(labels).withColumnRenamed("count", "in_n"), "vid")
    return out.join(r.degree().withColumnRenamed("count", "degree"), "vid").select("vid", "out_n", "in_n", "degree")


@query("SELECT src AS vid, count(*) + (SELECT count(*) FROM e b WHERE b.dst = a.src) AS n FROM e a GROUP BY 1", FOLLOWS_SQL)
def step_degree_with_loops(spark: SparkSession, sf: str) -> DataFrame:
    """A self-loop adds two."""
    return T.follows(spark, sf).V().degree("follows").select("vid", F.col("count").alias("n"))


@commerce_query("SELECT b.src AS vid FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src WHERE a.label = 'in_region' AND b.label = 'in_region'")
def step_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("nation").siblings(lambda r: r.out("in_region"), lambda r: r.in_("in_region")))


@commerce_query("SELECT vid, coalesce(string_agg(b.src, ',' ORDER BY b.src), '') AS items FROM v LEFT JOIN e a ON a.src = vid AND a.label = 'in_region' LEFT JOIN e b ON a.dst = b.dst AND a.src <> b.src AND b.label = 'in_region' WHERE kind = 'nation' GROUP BY 1")
def step_siblings_grouped(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("nation").siblings_grouped(lambda r: r.out("in_region"), lambda r: r.in_("in_region"))
    return r.select(F.col("element").alias("vid"), F.concat_ws(",", "items").alias("items"))


@query("SELECT c.dst AS vid, count(*) AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src GROUP BY 1", FOLLOWS_SQL)
def step_iter(spark: SparkSession, sf: str) -> DataFrame:
    return T.follows(spark, sf).V().iter(3, lambda r: r.out("follows")).group_count().toDF("vid", "n")


# -- filters


@commerce_query("SELECT vid FROM v WHERE kind = 'nation' AND vid IN (SELECT dst FROM e WHERE label = 'based_in')")
def filter_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("nation").lookahead(lambda r: r.in_("based_in")))


@commerce_query("SELECT vid FROM v WHERE kind = 'customer' AND (SELECT count(*) FROM e WHERE src = vid AND label = 'placed') BETWEEN 8 AND 12")
def filter_lookahead_between(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("customer").lookahead(lambda r: r.out("placed"), min=8, max=12))


@commerce_query("SELECT vid FROM v WHERE kind = 'customer' AND (SELECT count(*) FROM e WHERE src = vid AND label = 'placed') <= 6")
def filter_lookahead_max(spark: SparkSession, sf: str) -> DataFrame:
    """None at all counts as within the maximum."""
    return _rows(T.commerce(spark, sf).V("customer").lookahead(lambda r: r.out("placed"), max=6))


@commerce_query("SELECT vid FROM v WHERE kind = 'customer' AND vid NOT IN (SELECT src FROM e WHERE label = 'placed' AND dst IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'P'))")
def filter_neg_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("customer").neg_lookahead(lambda r: r.out("placed").has_property("status", "P")))


@commerce_query("SELECT vid FROM v WHERE kind = 'customer' AND NOT (SELECT count(*) FROM e WHERE src = vid AND label = 'placed') BETWEEN 8 AND 12")
def filter_neg_lookahead_between(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("customer").neg_lookahead(lambda r: r.out("placed"), min=8, max=12))


@commerce_query("SELECT vid FROM v WHERE kind = 'nation' AND vid IN (SELECT a.dst FROM e a WHERE label = 'based_in' AND (SELECT count(*) FROM e b WHERE b.src = a.src AND b.label = 'supplies') >= 50)")
def filter_lookahead_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("nation").lookahead(lambda r: r.in_("based_in").lookahead(lambda s: s.out("supplies"), min=50)))


@commerce_query("SELECT 'is' AS f, vid FROM v WHERE vid = 'region:1' UNION ALL SELECT 'isnt', vid FROM v WHERE kind = 'region' AND vid <> 'region:1'")
def filter_is_isnt(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("region")
    return r.is_("region:1").df.select(F.lit("is").alias("f"), "vid").unionByName(r.isnt("region:1").df.select(F.lit("isnt").alias("f"), "vid"))


@commerce_query("SELECT 'one' AS f, vid FROM v WHERE vid IN ('region:1', 'region:3') UNION ALL SELECT 'none', vid FROM v WHERE kind = 'nation' AND vid NOT IN (SELECT dst FROM e WHERE label = 'based_in')")
def filter_one_of_none_of(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    one, none = g.V("region").one_of(["region:1", "region:3"]), g.V("nation").none_of(g.V("supplier").out("based_in").df)
    return one.df.select(F.lit("one").alias("f"), "vid").unionByName(none.df.select(F.lit("none").alias("f"), "vid"))


@query("SELECT 'customer:' || c_custkey AS vid FROM customer WHERE c_nationkey IN (3, 5) OR c_nationkey = 7")
def filter_with(spark: SparkSession, sf: str) -> DataFrame:
    """By a computed value, or membership of a set."""
    r = T.commerce(spark, sf).V("customer").out_e("lives_in")
    some, one = r.with_(lambda x: F.col("dst"), {"nation:3", "nation:5"}), r.with_(lambda x: F.col("dst"), "nation:7")
    return _rows(some.out_v()).unionByName(_rows(one.out_v()))


@query("SELECT 'part:' || p_partkey AS vid FROM part WHERE p_brand = 'Brand#3'")
def filter_has_property(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("part").has_property("brand", "Brand#3"))


@commerce_query("SELECT vid FROM v WHERE kind IN ('region', 'nation')")
def filter_has_property_null(spark: SparkSession, sf: str) -> DataFrame:
    """A null value matches documents without the property."""
    return _rows(T.commerce(spark, sf).V(lambda k: k.isin("region", "nation")).has_property("segment", None))


@commerce_query("SELECT dst AS vid FROM e WHERE src = 'customer:1'")
def filter_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).get_vertex("customer:1").out().of_kind(lambda k: k.isin("order", "nation")))


@query("SELECT 'with' AS f, 'region:4' AS vid UNION ALL SELECT 'not', 'region:' || r_regionkey FROM region WHERE r_regionkey <> 4")
def filter_with_id(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("region")
    return r.with_id("region:4").df.select(F.lit("with").alias("f"), "vid").unionByName(r.not_id("region:4").df.select(F.lit("not").alias("f"), "vid"))


@query("SELECT 'is' AS f, src AS vid FROM e WHERE src = dst UNION ALL SELECT 'no', vid FROM (SELECT DISTINCT src AS vid FROM e) WHERE vid NOT IN (SELECT src FROM e WHERE src = dst)", FOLLOWS_SQL)
def filter_is_cycle(spark: SparkSession, sf: str) -> DataFrame:
    r = T.follows(spark, sf).V()
    step = lambda x: x.out("follows")
    return r.is_cycle(step).df.select(F.lit("is").alias("f"), "vid").unionByName(r.no_cycle(step).df.select(F.lit("no").alias("f"), "vid"))


@commerce_query("SELECT DISTINCT b.dst AS vid FROM e a JOIN e b ON a.src = b.src WHERE a.dst = 'part:7' AND a.label = 'contains' AND b.label = 'contains' AND b.dst <> 'part:7'")
def filter_with_set(spark: SparkSession, sf: str) -> DataFrame:
    """Parts bought together with one, without the set started from."""
    return _rows(T.commerce(spark, sf).get_vertex("part:7").with_set("remove", lambda r: r.in_("contains").out("contains")).distinct())


@query("SELECT 'customer:' || c AS vid FROM (SELECT c_nationkey, min('customer:' || c_custkey) AS m, min_by(c_custkey, 'customer:' || c_custkey) AS c FROM customer GROUP BY 1)")
def filter_distinct_by(spark: SparkSession, sf: str) -> DataFrame:
    """The first customer of each nation."""
    edges = T.commerce(spark, sf).V("customer").out_e("lives_in").sort_by(lambda r: F.col("src"))
    return edges.distinct_by(lambda r: F.col("dst")).df.select(F.col("src").alias("vid"))


@commerce_query("SELECT DISTINCT dst AS vid FROM e WHERE label = 'based_in' EXCEPT SELECT dst FROM e WHERE label = 'lives_in' AND src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_except_seen(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    seen = g.V("customer").has_property("segment", "BUILDING").out("lives_in")
    return _rows(g.V("supplier").out("based_in").distinct().except_route(seen))


@query("""SELECT ts_rank, event_type FROM (SELECT *, min(CASE WHEN again > 1 THEN ts_rank END) OVER () AS cut FROM (
    SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS ts_rank, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS again FROM events)) WHERE ts_rank < cut""")
def filter_prevent_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Everything before the first repeat."""
    rows = T.read(spark, sf, "events").select(F.col("event_type").alias("value"), "ts", "event_id")
    r = Route(Graph.empty(spark), rows, "value").sort_by(lambda x: F.struct("ts", "event_id")).prevent_cycles()
    placed = r.take_drop([1_000_000])
    from pyspark.sql import Window as W

    return placed.df.select(F.row_number().over(W.orderBy("ts", "event_id")).cast("bigint").alias("ts_rank"), F.col("value").alias("event_type"))


@query("SELECT 'part:' || p_partkey AS vid FROM part WHERE p_size = 10 ORDER BY p_retailprice, p_partkey LIMIT 1")
def filter_pluck(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    prices = T.read(spark, sf, "part").select(T.kinded("part", "p_partkey").alias("vid"), "p_size", "p_retailprice", "p_partkey")
    return _rows(g.route(prices).sort_by(lambda r: F.struct("p_retailprice", "p_partkey")).pluck(F.col("p_size") == 10))


@query("SELECT 'supplier:' || s_suppkey AS vid FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal < 3000")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("supplier").by_doc(lambda d: d["balance"], "balance")
    return _rows(r.range_route(lambda x: F.col("balance"), 1000, 3000, descending=True))


# -- sections, branches, shape


@query("SELECT 'customer:' || o_custkey AS customer, 'order:' || o_orderkey AS vid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, 'order:' || o_orderkey) AS r FROM orders) WHERE r <= 2")
def section_first_two(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer the two smallest orders: sections sorted and cut one by one."""
    g = T.commerce(spark, sf)
    r = g.V("customer").context(lambda s, e: s.by_doc(lambda d: d["total"], "total").sort_by(lambda x: F.col("total")).take(2), lambda x: x.out("placed"))
    return r.df.select(F.col("origin").alias("customer"), "vid")


@commerce_query("SELECT a.src AS customer, b.dst AS vid FROM e a JOIN e b ON a.dst = b.src AND b.label = 'in_region' WHERE a.label = 'lives_in'")
def section_context(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("customer").context(lambda s, e: s.out("in_region"), lambda x: x.out("lives_in"))
    return r.df.select(F.col("origin").alias("customer"), "vid")


@commerce_query("SELECT b.src AS vid FROM e a JOIN e b ON a.src = b.dst AND b.label = 'based_in' WHERE a.label = 'in_region' AND a.dst = 'region:0'")
def section_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).get_vertex("region:0").section(lambda s: s.in_("based_in"), lambda r: r.in_("in_region")))


@query("SELECT 'supplier:' || s_suppkey AS vid FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, 'supplier:' || s_suppkey) AS r FROM supplier) WHERE r = 1")
def section_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each sorted section."""
    g = T.commerce(spark, sf)
    return _rows(g.V("nation").section(lambda s: s.by_doc(lambda d: d["balance"], "b").sort_by(lambda x: F.col("b")).first(), lambda r: r.in_("based_in")))


@query("SELECT string_agg('region:' || r_regionkey, ',' ORDER BY r_regionkey) AS items FROM region")
def shape_gather(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("region").sort_by(lambda x: F.col("vid")).gather()
    return r.df.select(F.concat_ws(",", "value").alias("items"))


@query("SELECT 'nation:' || n_nationkey AS vid FROM nation")
def shape_spread(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(T.commerce(spark, sf).V("nation").gather().spread("vertex"))


@query("SELECT 'nation:' || n_nationkey AS first, 'region:' || n_regionkey AS second FROM nation")
def shape_make_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("nation").out_e("in_region").make_pairs(lambda x: F.col("src"), lambda x: F.col("dst"))
    return r.df.select("value.first", "value.second")


@commerce_query("SELECT 0 AS branch, dst AS vid FROM e WHERE label = 'in_region' UNION ALL SELECT 1, src FROM e WHERE label = 'based_in'")
def branch_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("nation")
    return merge_exhaustive(*r.branch(lambda x: x.out("in_region"), lambda x: x.in_("based_in"))).df.select("branch", "vid")


@commerce_query("SELECT 'home' AS name, count(*) AS n FROM e WHERE label = 'lives_in' UNION ALL SELECT 'orders', count(*) FROM e WHERE label = 'placed'")
def branch_keyed(spark: SparkSession, sf: str) -> DataFrame:
    branches = T.commerce(spark, sf).V("customer").keyed_branch(home=lambda r: r.out("lives_in"), orders=lambda r: r.out("placed"))
    parts = [r.count().select(F.lit(k).alias("name"), F.col("count").alias("n")) for k, r in branches.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT CAST(row_number() OVER (ORDER BY turn, branch, p) AS BIGINT) AS place, vid FROM (
    SELECT 0 AS branch, 'nation:' || n_nationkey AS vid, row_number() OVER (ORDER BY 'nation:' || n_nationkey) AS p, (row_number() OVER (ORDER BY 'nation:' || n_nationkey) - 1) // 10 AS turn FROM nation
    UNION ALL SELECT 1, 'supplier:' || s_suppkey, row_number() OVER (ORDER BY 'supplier:' || s_suppkey), (row_number() OVER (ORDER BY 'supplier:' || s_suppkey) - 1) // 10 FROM supplier)""")
def branch_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    g = T.commerce(spark, sf)
    both = merge_round_robin(g.V("nation").sort_by(lambda r: F.col("vid")), g.V("supplier").sort_by(lambda r: F.col("vid")), chunk=10)
    from roamframe.plans.ranking import positioned

    return positioned(both.df, [F.col(c) for c in both.order], "place").select("place", "vid")


# -- order, limits, aggregates


def _by_balance(spark: SparkSession, sf: str) -> Route:
    return T.commerce(spark, sf).V("customer").by_doc(lambda d: d["balance"], "balance").sort_by(lambda r: F.col("balance"))


@query("SELECT 'customer:' || c_custkey AS vid, CAST(row_number() OVER (ORDER BY c_acctbal, 'customer:' || c_custkey) AS BIGINT) AS place FROM customer")
def order_sort_by(spark: SparkSession, sf: str) -> DataFrame:
    from roamframe.plans.ranking import positioned

    r = _by_balance(spark, sf)
    return positioned(r.df, [F.col(c) for c in r.order], "place").select("vid", "place")


@query("SELECT vid FROM (SELECT 'customer:' || c_custkey AS vid, row_number() OVER (ORDER BY c_acctbal, 'customer:' || c_custkey) AS p FROM customer) WHERE p <= 5 OR p BETWEEN 9 AND 15")
def order_take_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_by_balance(spark, sf).take_drop([5, 3, 7]))


@query("SELECT vid FROM (SELECT 'customer:' || c_custkey AS vid, row_number() OVER (ORDER BY c_acctbal, 'customer:' || c_custkey) AS p FROM customer) WHERE p BETWEEN 2 AND 3 OR p BETWEEN 7 AND 10")
def order_drop_take(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_by_balance(spark, sf).drop_take([1, 2, 3, 4]))


@query("""SELECT vid FROM (SELECT 'customer:' || c_custkey AS vid, row_number() OVER (ORDER BY c_acctbal, 'customer:' || c_custkey) AS p, count(*) OVER () AS n FROM customer) WHERE p IN (1, 2, 3, 8) OR p = n""")
def order_take_nth_last(spark: SparkSession, sf: str) -> DataFrame:
    r = _by_balance(spark, sf)
    return _rows(r.take(3)).unionByName(_rows(r.nth(7))).unionByName(_rows(r.last()))


@query("SELECT 'nation:' || c_nationkey AS key, count(*) AS count FROM customer GROUP BY 1")
def aggregate_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return T.commerce(spark, sf).V("customer").out("lives_in").sorted_group_count()


@query("SELECT n AS count, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT 'nation:' || s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) GROUP BY 1")
def aggregate_group_by_count(spark: SparkSession, sf: str) -> DataFrame:
    r = T.commerce(spark, sf).V("supplier").out("based_in").sorted_group_by_count()
    return r.select("count", _text("keys").alias("keys"))


@query("SELECT n AS count, count(*) AS n_keys FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 1 GROUP BY 1")
def aggregate_more_than_once(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.contains_rows(spark, sf).select(F.struct("src", "dst").alias("value"))
    r = Route(Graph.empty(spark), rows, "value").group_by_count(more_than_once=True)
    return r.select("count", F.size("keys").cast("bigint").alias("n_keys"))


@query("SELECT 'nation:' || c_nationkey AS key, max_by('customer:' || c_custkey, c_custkey) AS value FROM customer GROUP BY 1")
def aggregate_index_by(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's last customer."""
    r = T.commerce(spark, sf).V("customer").out_e("lives_in").sort_by(lambda x: T.key_of(F.col("src")).cast("bigint"))
    return r.index_by(lambda x: F.col("dst"), lambda x: F.col("src"))


@query("SELECT key, max_by(vid, n) AS value FROM (SELECT 'supplier:' || s_suppkey AS vid, s_suppkey AS n, unnest(['nation:' || s_nationkey, 'parity:' || (s_suppkey % 2)]) AS key FROM supplier) GROUP BY 1")
def aggregate_index_by_multi(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda: T.key_of(F.col("src")).cast("bigint")
    r = T.commerce(spark, sf).V("supplier").out_e("based_in").sort_by(lambda x: n())
    return r.index_by_multi(lambda x: F.array("dst", F.concat(F.lit("parity:"), (n() % 2).cast("string"))), lambda x: F.col("src"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_name LIKE '%1%' GROUP BY 1")
def host_filter_map_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Selection by substring, projection, frequencies."""
    r = T.commerce(spark, sf).V("customer").where_doc(lambda d: d["name"].contains("1")).by_doc(lambda d: d["segment"], "segment")
    return r.values(F.col("segment")).group_count().toDF("segment", "n")


# -- paths


def _paths(spark: SparkSession, sf: str) -> Route:
    return T.commerce(spark, sf).V("region").with_paths().in_("in_region").in_("based_in")


_PATH_SQL = "SELECT {} FROM e a JOIN e b ON b.dst = a.src WHERE a.label = 'in_region' AND b.label = 'based_in'"


@commerce_query(_PATH_SQL.format("b.src AS vid, a.dst || '>' || a.src || '>' || b.src AS ids, 5 AS length"))
def path_full(spark: SparkSession, sf: str) -> DataFrame:
    r = _paths(spark, sf)
    return r.df.select("vid", F.concat_ws(">", P.vertex_ids(F.col("path"))).alias("ids"), F.size("path").alias("length"))


@commerce_query(_PATH_SQL.format("b.src || '>' || a.src || '>' || a.dst AS ids"))
def path_vertices_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).df.select(F.concat_ws(">", F.transform(P.path_vertices(F.col("path")), lambda s: s["vid"])).alias("ids"))


@commerce_query(_PATH_SQL.format("'based_in>in_region' AS labels, true AS reverse"))
def path_edges_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    edges = P.path_edges(F.col("path"))
    return _paths(spark, sf).df.select(F.concat_ws(">", F.transform(edges, lambda s: s["label"])).alias("labels"), F.forall(edges, lambda s: ~s["fwd"]).alias("reverse"))


@commerce_query(_PATH_SQL.format("a.dst || '>' || a.src AS trimmed, b.src AS newest"))
def path_subpath(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf).df.select(F.concat_ws(">", P.vertex_ids(P.subpath(path, 2))).alias("trimmed"), F.concat_ws(">", P.vertex_ids(P.subpath(path, 0, 1))).alias("newest"))


@commerce_query(_PATH_SQL.format("b.src AS first, 3 AS rest"))
def path_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking restarted; the reverse path begins with the newest step."""
    r = _paths(spark, sf).reset_path().out("based_in")
    return r.df.select(F.element_at(P.reverse_path(F.col("path")), -1)["vid"].alias("first"), F.size("path").alias("rest"))


@query("SELECT count(*) AS n, sum(CASE WHEN a.src = b.src AND a.dst = b.dst THEN 1 ELSE 0 END)::BIGINT AS cyclic FROM e a JOIN e b ON a.dst = b.src", FOLLOWS_SQL)
def path_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that use one edge twice."""
    r = T.follows(spark, sf).V().with_paths().out("follows").out("follows")
    return r.df.agg(F.count("*").alias("n"), F.count(P.cyclic_path(F.col("path"))).alias("cyclic"))


@commerce_query("SELECT vid, vid AS text FROM v WHERE kind = 'region' UNION ALL SELECT src, dst || ' <-in_region- ' || src FROM e WHERE label = 'in_region'")
def path_printed(spark: SparkSession, sf: str) -> DataFrame:
    """Untracked elements are paths of themselves; printed forms."""
    g = T.commerce(spark, sf)
    plain = g.V("region").paths().df.select(F.col("value")[0]["vid"].alias("vid"), P.text(F.col("value")).alias("text"))
    tracked = g.V("region").with_paths().in_("in_region").df.select("vid", P.text(F.col("path")).alias("text"))
    return plain.unionByName(tracked)


# -- extension


@query("SELECT src, dst, CAST(doc AS DOUBLE) AS weight FROM e", FOLLOWS_SQL)
def view_weights(spark: SparkSession, sf: str) -> DataFrame:
    return GraphView(T.follows(spark, sf), ["follows"]).weights()


@query("SELECT 'a' AS src, 'b' AS dst, 4.0::DOUBLE AS weight UNION ALL SELECT 'c', 'd', 9.0 UNION ALL SELECT 'a', 'd', 33.0")
def view_weight_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of an edge with a number, without a document, and of a missing edge."""
    rows = spark.createDataFrame([("near", "a", "b", 4.0), ("xyz", "c", "d", None), ("far", "d", "b", None)], "label string, src string, dst string, doc double")
    view = GraphView(Graph.from_edges(rows), ["near", "xyz"], null_weight=9.0, missing_weight=33.0)
    return view.weights(spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "d")], "src string, dst string"))


@commerce_query("SELECT vid, (SELECT count(*) FROM e WHERE src = vid AND label IN ('lives_in', 'in_region')) AS out_degree, (SELECT count(*) FROM e WHERE dst = vid AND label IN ('lives_in', 'in_region')) AS in_degree FROM v WHERE kind IN ('nation', 'region')")
def view_degrees(spark: SparkSession, sf: str) -> DataFrame:
    view = GraphView(T.commerce(spark, sf), ["lives_in", "in_region"])
    return view.out_degrees().join(view.in_degrees(), "vid").filter("vid like 'nation:%' or vid like 'region:%'").select("vid", "out_degree", "in_degree")


@commerce_query("SELECT vid, min(dst) AS \"to\" FROM v LEFT JOIN e ON src = vid AND label = 'in_region' WHERE kind IN ('nation', 'region') GROUP BY 1")
def wrapper_single_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    """A named traversal with one result per vertex, null where there is none."""
    g = T.commerce(spark, sf)
    return single(lambda r: r.out("in_region"))(g.V(lambda k: k.isin("nation", "region")))


@query("SELECT src, dst, CAST(doc AS DOUBLE) * 10 AS weight FROM e", FOLLOWS_SQL)
def wrapper_computed_weight(spark: SparkSession, sf: str) -> DataFrame:
    g = wrap_graph(T.follows(spark, sf), {"weight": lambda d: d * 10}, {"onwards": lambda r: r.out("follows")})
    return g.computed(g.E("follows"), "weight").select("src", "dst", "weight")


@query("SELECT dst AS vid, count(*) AS n FROM e GROUP BY 1", FOLLOWS_SQL)
def wrapper_registered_traversal(spark: SparkSession, sf: str) -> DataFrame:
    g = T.follows(spark, sf).register_traversal("onwards", lambda r: r.out("follows"))
    return g.V().call("onwards").group_count().toDF("vid", "n")
