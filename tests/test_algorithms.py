from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roamframe.graph import Graph
from roamframe.operators import algorithms as A
from roamframe.operators import ordered as O
from roamframe.operators import recursion as R
from roamframe.operators.components import star_components
from roamframe.sources import fixtures as X


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def table(df) -> dict:
    return {r[0]: r[1] for r in df.collect()}


#: Immediate dominators of published example graphs.
IDOMS = {
    "cyclic": "X:X T:X C:X E:C M:E B:X D:X G:D",
    "flow": "S:S C:S B:S A:S K:S I:S F:C G:C J:G E:B H:E D:A",
    "irreducible": "5:5 4:5 3:5 2:5 1:5",
    "loops": "07:04 01:01 04:03 06:04 03:01 02:01 09:08 05:04 10:08 08:07",
}


@pytest.mark.parametrize("name", sorted(IDOMS))
def test_immediate_dominators(spark, name):
    want = dict(x.split(":") for x in IDOMS[name].split())
    assert table(A.immediate_dominators(frame(spark, X.pairs(name)), X.ENTRY[name])) == want


def test_dominance_frontiers(spark):
    got: dict = {}
    for r in A.dominance_frontiers(frame(spark, X.pairs("cyclic")), "X").collect():
        got.setdefault(r["vid"], set()).add(r["frontier"])
    assert got == {"T": {"B"}, "C": {"C", "D"}, "E": {"C", "D"}, "M": {"C"}, "B": {"D"}, "D": {"D"}, "G": {"D"}}


def test_strong_components_against_a_plain_closure(spark):
    rng = random.Random(4)
    pairs = {(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(22)}
    reach = {v: {v} for p in pairs for v in p}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    assert table(A.strongly_connected_components(frame(spark, pairs), frame(spark, pairs).selectExpr("src as vid").union(frame(spark, pairs).selectExpr("dst")))) == want


def test_elementary_circuits(spark):
    found = {tuple(r["cycle"]) for r in A.elementary_cycles(frame(spark, X.pairs("flow"))).collect()}
    assert {frozenset(c) for c in found} == {frozenset(x) for x in ("IK", "IKSCF", "IKSCG", "BEHKS", "EH")} and len(found) == 5
    assert all(c[0] == c[-1] == min(c) for c in found)


def test_components_of_stars_chains_and_loops(spark):
    pairs = [(k, k + 1) for k in range(0, 60, 2)] + [(0, k) for k in range(1, 30, 2)] + [(100 + k, 101 + k) for k in range(40)] + [(7000, 7000), (None, 3)]
    got = table(star_components(spark.createDataFrame(pairs, "src int, dst int")))
    parent = {v: v for p in pairs if None not in p for v in p}
    for _ in range(70):
        for a, b in pairs:
            if a is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_paths(spark):
    g = X.fixture(spark, "loops").cached()
    start = g.get_vertex("01").df
    assert A.shortest_path(g, "to", start, lambda v: v == "10").first()["path"] == ["01", "03", "04", "05", "07", "08", "10"]
    assert A.shortest_path(g, "to", start, lambda v: v == "99").isEmpty()
    assert sorted(r["vid"] for r in A.vertices_between(A.edge_list(g, "to"), "04", "07").collect()) == ["04", "05", "06", "07"]
    assert table(A.breadth_first(g.get_vertex("08"), lambda r: r.out("to"))) == {"08": 0, "03": 1, "09": 1, "10": 1, "04": 2, "01": 2, "07": 2, "05": 3, "06": 3, "02": 3}


def test_recursion_bounds(spark):
    g = X.fixture(spark, "knows", "knows").cached()
    with pytest.raises(R.TooDeep):
        R.all_with_cycles(g.get_vertex("a"), lambda r: r.out("knows"), max_levels=4)
    assert R.all_with_cycles(g.get_vertex("a"), lambda r: r.out("knows"), depth=4).df.count() > 0
    assert sorted(r["vid"] for r in R.deepest(g.get_vertex("a"), lambda r: r.out("knows")).df.collect()) == ["d", "d"]
    gated = R.all_(g.get_vertex("a"), lambda r: r.out("knows"), element_pred=lambda e: e != "b")
    assert sorted(r["vid"] for r in gated.df.collect()) == ["a", "b", "d"]
    cut = R.all_cycle_paths(g.get_vertex("a"), lambda r: r.out("knows"), complete=False)
    assert [r["value"] for r in cut.df.collect()] == [["a", "b", "c", "a"]]


pairs_strategy = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25)


@settings(max_examples=60, deadline=None)
@given(pairs_strategy)
def test_orders_of_any_flow_graph(pairs):
    g = O.FlowGraph.from_pairs(pairs[0][0], pairs)
    post, pre = g.postwalk(), g.prewalk()
    assert sorted(post) == sorted(pre) == sorted(g.successors) == sorted(g.breadth_first())
    assert pre[0] == post[-1] == g.entry
    parts = g.intervals()
    assert sorted(v for p in parts for v in p) == sorted(post)
    # an interval is entered at its header only: all but one vertex have their predecessors inside
    for p in parts:
        assert sum(not p.issuperset(g.predecessors[v]) for v in p) <= 1
    for (head, tail), loop in g.loop_tree().items():
        assert head in g.successors[tail] and loop["depth"] >= 0


@settings(max_examples=60, deadline=None)
@given(pairs_strategy)
def test_blocks_and_cut_vertices(pairs):
    near: dict = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def part(start, without=None):
        seen, todo = {start}, [start]
        while todo:
            for w in near[todo.pop()] - seen - {without}:
                seen.add(w)
                todo.append(w)
        return seen

    if not near:
        return
    live = part(min(near))
    inner = [(a, b) for a, b in pairs if a in live and b in live]
    blocks, cuts = O._blocks(inner)
    want = {v for v in live if len(live) > 2 and part(next(iter(live - {v})), v) != live - {v}}
    assert cuts == want
    assert all(any({a, b} <= x for x in blocks) for a, b in inner if a != b)


def test_fold_ends_early():
    g = O.FlowGraph.from_pairs("A", X.pairs("simple"))

    def stop(acc, v):
        if v == "T":
            raise O.Done(acc)
        return acc + v

    assert g.prewalk_reduce("", stop) == "ABD"
    assert g.breadth_first_reduce(0, lambda n, v: n + 1) == 6
    assert g.reverse_postwalk_reduce("", lambda a, v: a + v)[0] == "A" and g.postwalk_reduce("", lambda a, v: a + v)[-1] == "A"


def test_undirected_only(spark):
    with pytest.raises(A.NotUndirected):
        A.connected_components(X.fixture(spark, "blocks"), "to")
    got = {r["vid"] for r in O.articulation_points(X.fixture(spark, "blocks", edge_type="undirected"), "to").filter(F.col("vid").isNotNull()).collect()}
    assert got == {"c", "d"}


@pytest.mark.parametrize(
    ("control", "want"),
    [
        (None, (0, 1, 2, 3, -1, 0, 1, 2, 3, -2)),
        (lambda p, e: R.continue_(), ()),
        (lambda p, e: F.when(e == 0, R.continue_()).otherwise(R.emit_()), (1, 2, 3, -1, 1, 2, 3, -2)),
        (lambda p, e: F.when(e == 2, R.cut_()).otherwise(R.emit_and_continue()), (0, 1, -1, 0, 1, -2)),
        (lambda p, e: F.when(e == 2, R.emit_and_cut()).otherwise(R.emit_and_continue()), (0, 1, 2, -1, 0, 1, 2, -2)),
        (lambda p, e: F.when(e.isin(0, 1), R.emit_and_continue()).when(e == 2, R.cut_()).otherwise(R.ignore()), (0, 1, 0, 1)),
        (lambda p, e: F.when(e == 0, R.chain()).otherwise(R.emit_and_continue()), (1, 2, 3)),
    ],
)
def test_controls_of_a_descent(spark, control, want):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src bigint, dst bigint"), "child")
    out = R.descend(g.route([0, -1, 0, -2]), lambda r: r.out("child"), control=control, ordered=True)
    assert tuple(r["vid"] for r in out.df.orderBy(*out.order).collect()) == want


def test_orders_of_a_small_flow_graph():
    flow = O.FlowGraph.from_pairs(X.ENTRY["simple"], X.pairs("simple"))
    assert flow.postwalk() == list("DBECTA") and flow.reverse_postwalk() == list("ATCEBD")
    assert "".join(flow.prewalk()) == "ABDTCE" and "".join(flow.breadth_first()) == "ABTDCE"


def test_articulation_points_of_blocks(spark):
    assert {r["vid"] for r in O.articulation_points(X.fixture(spark, "blocks", edge_type="undirected"), "to").collect()} == {"c", "d"}


def test_silent_branches_end_or_ask(spark):
    chain = Graph.from_edges(spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long"), "to")

    def found(**more) -> list:
        return sorted(r["vid"] for r in R.descend(chain.route([0]), lambda r: r.out("to"), emit=lambda p, e: e.isin(0, 5), **more).df.collect())

    assert found() == [0, 5]
    assert found(max_silent_levels=2) == [0]
    assert found(max_silent_levels=2, on_silent=lambda path, element, levels: element >= 3) == [0, 5]
    assert found(max_silent_levels=2, on_silent=lambda path, element, levels: levels < 4) == [0]


def test_deepest_leaves_are_told_level_by_level(spark):
    """What is returned is read, not joined with the edges again: all paths of all levels went through one shuffle."""
    g = Graph.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("e", "f")], "src string, dst string"), "knows")
    step = lambda r: r.out("knows")
    paths = R.deepest_paths(g.V(), step).df
    assert sorted(">".join(r["value"]) for r in paths.collect()) == ["a>b>d", "b>d", "c>a>b>d", "d", "e>f", "f"]
    deepest = R.deepest(g.V(), step, ordered=True)
    assert [r["vid"] for r in deepest.df.orderBy(*deepest.order).collect()] == ["d", "d", "d", "d", "f", "f"]
    # an element that only the bound cut off is no leaf
    assert sorted(r["vid"] for r in R.deepest(g.V(), step, depth=1).df.collect()) == ["d", "d", "f", "f"]
    for df in (paths, R.deepest(g.V(), step).df):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_dealt_edges_are_not_shuffled_by_joins(spark, monkeypatch):
    monkeypatch.setattr("roamframe.graph.DEALT_EDGES", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = Graph.from_edges(spark.range(1000).selectExpr("id as src", "id + 1 as dst"), "next").cached(by="src")
        out = g.V().out("next").df
        assert out.count() == 1000
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
