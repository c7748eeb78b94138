from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roamframe.graph import CyclicGraph, Graph, GraphBuilder, MissingDocuments, VertexNotFound
from roamframe.functions import paths as P
from roamframe.operators.views import GraphView
from roamframe.route import Route, Unordered, merge_round_robin
from roamframe.sources import text as X
from roamframe.sources.fixtures import fixture


def ids(route, column: str = "vid") -> list:
    return sorted(r[0] for r in route.df.select(column).collect())


@pytest.fixture(scope="module")
def knows(spark) -> Graph:
    return fixture(spark, "knows", "knows").cached()


def edges(spark, rows, doc: str = "string"):
    return spark.createDataFrame(rows, f"src string, dst string, doc {doc}")


def test_edge_rules(spark):
    rows = [("a", "b", None), ("b", "c", None), ("a", "b", "1"), ("b", "c", None)]
    g = GraphBuilder(spark).add_edges("n", edges(spark, rows), order=F.monotonically_increasing_id()).freeze()
    assert {(r["src"], r["dst"], r["doc"]) for r in g.e.collect()} == {("a", "b", "1"), ("b", "c", None)}
    weights = [("a", "b", w) for w in (10.0, 2.0, 2.0, 2.0, 2.0, 5.0)] + [("b", "c", 11.0), ("x", "y", None)]
    g = GraphBuilder(spark).edge_rule("w", "weighted", 0.5).add_edges("w", edges(spark, weights, "double")).freeze()
    assert {(r["src"], r["doc"]) for r in g.e.collect()} == {("a", 23.0), ("b", 11.0), ("x", 0.5)}
    parallel = [("a", "b", str(k)) for k in range(7)] + [("b", "c", "x"), ("b", "c", None), ("x", "y", None)]
    g = GraphBuilder(spark).edge_rule("p", "parallel").add_edges("p", edges(spark, parallel), order=F.monotonically_increasing_id()).freeze()
    assert sorted(r["doc"]["n"] for r in g.e.collect()) == [1, 2, 7]
    with pytest.raises(ValueError):
        GraphBuilder(spark).edge_rule("p", "other")


def test_stars_from_lists_need_a_document_a_vertex(spark):
    g = GraphBuilder(spark).add_edges_from("s", "hub", ["a", "b"], documents=["1", "2"]).add_edges_to("t", ["c"], "hub").freeze()
    assert {(r["src"], r["dst"], r["doc"]) for r in g.e.collect()} == {("hub", "a", "1"), ("hub", "b", "2"), ("c", "hub", None)}
    with pytest.raises(MissingDocuments):
        GraphBuilder(spark).add_edges_from("s", "hub", ["a", "b"], documents=["1"])
    told = GraphBuilder(spark).add_edges_to("s", ["a", "b"], "hub", documents=["1"], on_missing=lambda pairs, ends, docs: [*pairs, ("b", None)]).freeze()
    assert {(r["src"], r["doc"]) for r in told.e.collect()} == {("a", "1"), ("b", None)}


def test_random_sample_is_repeatable_and_near_its_share(knows, spark):
    r = knows.route(spark.range(10_000).select(F.col("id").cast("string").alias("vid")))
    some = ids(r.random_sample(0.3, 7))
    assert 2_700 < len(some) < 3_300 and some == ids(Route(knows, r.df.repartition(7), "vertex").random_sample(0.3, 7)) != ids(r.random_sample(0.3, 8))
    assert not ids(r.random_sample(0.0)) and len(ids(r.random_sample(1.0))) == 10_000
    with pytest.raises(ValueError):
        r.random_sample(1.5)


def test_a_label_declared_acyclic_has_to_be(spark):
    chain = edges(spark, [("a", "b", None), ("b", "c", None)])
    assert GraphBuilder(spark).add_edges("d", chain, "dag").freeze().e.count() == 2
    with pytest.raises(CyclicGraph):
        GraphBuilder(spark).add_edges("d", chain.unionByName(edges(spark, [("c", "a", None)])), "dag").freeze()


def test_undirected_labels_are_one_edge_seen_from_both_ends(spark):
    g = GraphBuilder(spark).add_edges("u", edges(spark, [("b", "a", "1"), ("a", "b", "2"), ("c", "c", None)]), "undirected", order=F.monotonically_increasing_id()).freeze()
    assert g.e.count() == 2
    assert ids(g.get_vertex("a").out("u")) == ["b"] and ids(g.get_vertex("b").out("u")) == ["a"] and ids(g.get_vertex("c").out("u")) == ["c"]
    assert [r["doc"] for r in g.get_vertex("b").out_e("u").with_documents().collect()] == ["2"]


def test_lookups(knows):
    assert knows.has_vertex("a") and not knows.has_vertex("z") and knows.has_vertex("a", "knows")
    assert ids(knows.get_vertex("z")) == ["z"] and ids(knows.get_vertex_or("z", "a")) == ["a"]
    with pytest.raises(VertexNotFound):
        knows.get_vertex_or("z")
    assert knows.get_edge("knows", "a", "b").df.count() == 1 and knows.get_edge("knows", "b", "a").df.isEmpty()


def test_changes_return_new_graphs(spark, knows):
    one = spark.createDataFrame([("a",)], "vid string")
    smaller = knows.remove_vertices(one)
    assert smaller.e.count() == 2 and knows.e.count() == 5
    docs = spark.createDataFrame([("a", "A"), ("new", "N")], "vid string, doc string")
    named = knows.set_documents(docs)
    assert ids(named.V().has_document()) == ["a", "new"]
    bare = named.remove_documents(named.V().df)
    assert not bare.has_vertex("new") and bare.has_vertex("a")
    cut = named.remove_all_edges("knows")
    assert ids(cut.V()) == ["a", "new"]
    edge = knows.E().filter("src = 'a' and dst = 'b'").df.select("label", "src", "dst", F.lit("x").alias("doc"))
    told = knows.set_edge_documents(edge)
    assert told.e.filter("doc = 'x'").count() == 1 and told.remove_edge_documents(edge).e.filter("doc is not null").isEmpty()
    assert knows.equals(knows.transposed().transposed()) and not knows.equals(knows.transposed())
    assert knows.merge(named).equals(named)


def test_order_has_to_be_given(knows):
    with pytest.raises(Unordered):
        knows.V().take(1)
    assert ids(knows.V().sort_by(lambda r: F.col("vid"), descending=True).take(2)) == ["c", "d"]
    r = knows.route(["c", "a", "b", "a", "d"])
    assert ids(r.prevent_cycles()) == ["a", "b", "c"]
    with pytest.raises(Exception, match="repeats"):
        r.no_cycles().df.collect()
    assert ids(r.no_cycles(lambda e: F.lit(False))) == ["a", "b", "c"]
    assert ids(r.no_cycles(lambda e: e == "a")) == ["a", "a", "b", "c", "d"]
    assert ids(r.distinct()) == ["a", "b", "c", "d"]
    assert ids(r.drop_take([1, 2, 1, 1])) == ["a", "b", "d"] and ids(r.last()) == ["d"]


def test_round_robin_has_no_holes(knows):
    many, few = knows.route([f"m{k:02d}" for k in range(70)]), knows.route(["x"])
    both = merge_round_robin(many, few)
    rows = [r["vid"] for r in both.df.orderBy(*both.order).collect()]
    assert len(rows) == 71 and rows[32] == "x" and None not in rows


def test_nested_scopes(knows):
    friends = knows.V().lookahead(lambda r: r.out("knows").lookahead(lambda s: s.out("knows"), min=2))
    assert ids(friends) == ["b", "c"]  # a and c have two
    assert ids(knows.V().lookahead(lambda r: r.out("knows"), max=0)) == ["d"]


def test_multiplicity_is_kept(knows):
    r = knows.route(["a", "a"]).out("knows")
    assert ids(r) == ["b", "b", "d", "d"]
    assert ids(knows.route(["a", "a"]).section(lambda s: s.out("knows"), lambda x: x.out("knows"))) == ["c", "c"]
    assert [len(x["items"]) for x in knows.route(["d", "a"]).out_grouped("knows").orderBy("element").collect()] == [2, 0]


def test_paths_and_printing(knows):
    r = knows.get_vertex("a").with_paths().out("knows").in_("knows")
    shown = {x["text"] for x in X.render(r).collect()}
    assert shown == {"a -knows-> b <-knows- a", "a -knows-> d <-knows- a", "a -knows-> d <-knows- c"}
    again = r.df.select(P.cyclic_path(F.col("path")).isNotNull().alias("c"))
    assert sorted(x["c"] for x in again.collect()) == [False, True, True]
    assert r.subgraph().e.count() == 3
    assert {(x["src"], x["dst"]) for x in r.subgraph(as_reference=True).e.collect()} == {("b", "a"), ("d", "a"), ("d", "c")}
    X.use(knows)
    assert ids(X.v("a")) == ["a"] and X.e("a", "knows", "b").df.count() == 1
    X.use(None)
    with pytest.raises(LookupError):
        X.v("a")


def test_view_edits(spark, knows):
    view = GraphView(knows, ["knows"])
    pair = spark.createDataFrame([("d", "z")], "src string, dst string")
    more = view.add_edges(pair)
    assert more.has_edge("d", "z") and more.has_node("z") and not view.has_edge("d", "z")
    assert not more.remove_edges(pair).has_edge("d", "z")
    assert not more.remove_nodes(spark.createDataFrame([("a",)], "vid string")).has_node("a")
    assert view.remove_all().nodes().isEmpty()
    assert {r["vid"] for r in view.successors("a").collect()} == {"b", "d"} and {r["vid"] for r in view.transpose().predecessors("a").collect()} == {"b", "d"}
