"""Connected components by alternating large-star and small-star contraction.

Every step is a keyed aggregate and an equi-join, so a hub vertex costs its degree in
thin rows and nothing is gathered on the driver but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.plans.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge already runs from the larger to the smaller id
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Map each vertex that an edge touches to the smallest vertex of its component.

    Returns ``(vid, component)``.  Self-loops and repeated or reversed edges are
    allowed, rows with a null end are ignored, and an empty input gives an empty result.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    ends = clean.select(F.col("a").alias("vid")).unionByName(clean.select(F.col("b").alias("vid"))).distinct()
    state = stored(clean.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or (mark["n"], mark["x"]) == seen:
            break
        seen = (mark["n"], mark["x"])
        state = stored(_small_star(_large_star(state)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    heads = state.groupBy("u").agg(F.min("v").alias("head"))
    return ends.join(heads, ends["vid"] == heads["u"], "left").select("vid", F.coalesce("head", "vid").alias("component"))
