"""Closed walks of distinct vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.graph import Graph, Labels


def _mirrored(graph: Graph, labels: Labels) -> tuple[DataFrame, DataFrame]:
    out = graph.e.filter(F.col("label").isin([labels] if isinstance(labels, str) else list(labels))).select(F.col("src").alias("a"), F.col("dst").alias("b")) if labels is not None else graph.e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return out, out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b")))


def shapes(graph: Graph, sides: int, labels: Labels = "to") -> DataFrame:
    """(v0 … v{sides-1}): closed undirected walks of distinct vertices, the first step along an out-edge."""
    out, both = _mirrored(graph, labels)
    walks = out.filter("a <> b").select(F.col("a").alias("v0"), F.col("b").alias("v1"))
    for k in range(2, sides):
        step = both.select(F.col("a").alias("__a"), F.col("b").alias(f"v{k}"))
        new = F.col(f"v{k}")
        fresh = F.lit(True)
        for j in range(k):
            fresh = fresh & (new != F.col(f"v{j}"))
        walks = walks.join(step, F.col(f"v{k - 1}") == F.col("__a")).filter(fresh).drop("__a")
    closing = both.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return walks.join(closing, (F.col(f"v{sides - 1}") == F.col("__a")) & (F.col("v0") == F.col("__b"))).drop("__a", "__b")


def squares(graph: Graph, labels: Labels = "to") -> DataFrame:
    """(vid, squares): 4-cycles that start at each vertex, without those whose first three vertices are a triangle."""
    _, both = _mirrored(graph, labels)
    diagonal = both.select(F.col("a").alias("v0"), F.col("b").alias("v2")).distinct()
    open_ = shapes(graph, 4, labels).join(diagonal, ["v0", "v2"], "left_anti")
    return open_.groupBy(F.col("v0").alias("vid")).agg(F.count("*").alias("squares"))
