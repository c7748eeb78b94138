"""Printed forms: literals for vertices and edges in tests and consoles.

``v("a")``, ``e("a", "knows", "b")`` and ``render`` of a route are inverse to each other up to order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.graph import Graph
from roamframe.functions import paths
from roamframe.route import Route

_DEFAULT: list[Graph] = []


def use(graph: Graph | None) -> None:
    """Set or clear the graph that literals are bound to."""
    _DEFAULT[:] = [] if graph is None else [graph]


def _graph(graph: Graph | None) -> Graph:
    if graph is None and not _DEFAULT:
        raise LookupError("no graph is given and none is set")
    return graph or _DEFAULT[0]


def v(vid, graph: Graph | None = None) -> Route:
    return _graph(graph).get_vertex(vid)


def e(src, label: str, dst, graph: Graph | None = None) -> Route:
    return _graph(graph).get_edge(label, src, dst)


def render(route: Route) -> DataFrame:
    """(text): ``a`` for vertices, ``a -label-> b`` for edges in the direction of travel, whole paths where tracked."""
    if route.tracked:
        return route.df.select(paths.text(F.col("path")).alias("text"))
    if route.kind == "edge":
        ahead = F.concat(F.col("src").cast("string"), F.lit(" -"), "label", F.lit("-> "), F.col("dst").cast("string"))
        back = F.concat(F.col("dst").cast("string"), F.lit(" <-"), "label", F.lit("- "), F.col("src").cast("string"))
        return route.df.select(F.when(F.col("fwd"), ahead).otherwise(back).alias("text"))
    return route.df.select(route.element.cast("string").alias("text"))
