"""Force-directed layout, one iteration at a time.

State is a vertex table (vid, x, y, dx, dy, px, py, mass, size, degree, squares) and an edge table
(src, dst, weight, vx, vy, length, angle); a ``Layout`` holds both with the adaptive speed.  An iteration is
a few joins and sums, and its result goes to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.graph import Graph
from roamframe.operators.motifs import squares
from roamframe.plans.scratch import cut

# Fixed values of the force model.
COEFFICIENT, LOCAL_RADIUS, NEAREST, TOUCHING = 25.0, 40.0, 0.0001, 0.01
GLOBAL_UNTIL, GRAVITY_FROM, GRAVITY_TO, GRAVITY, GRAVITY_Y = 250, 150, 450, -0.04, 0.75
JITTER, LEAST_EFFICIENCY, MAX_RISE, TURN = 0.02, 0.05, 0.5, 0.05


@dataclass(frozen=True)
class Layout:
    vertices: DataFrame
    edges: DataFrame
    vertex_count: int
    edge_count: int
    iteration: int = 0
    speed: float = 1.0
    efficiency: float = 1.0
    swinging: float = 0.0
    traction: float | None = None
    friction: float = 0.0
    default_gravity: float = 0.0
    seed: int = 1
    history: list = field(default_factory=list)


def vertex_table(graph: Graph, labels="to", seed: int = 1) -> DataFrame:
    """Random places in [-50, 50)², velocities along them, mass and size 1, degree and squares."""
    x, y = F.floor(F.rand(seed) * 100) - 50.0, F.floor(F.rand(seed + 1) * 100) - 50.0
    push = 500 + F.floor(F.rand(seed + 2) * 500)
    placed = cut(graph.v.select("vid", x.cast("double").alias("x"), y.cast("double").alias("y"), push.cast("double").alias("push")))
    degree = graph.V().degree(labels).withColumnRenamed("count", "degree")
    rows = placed.join(degree, "vid").join(squares(graph, labels), "vid", "left")
    return rows.select("vid", "x", "y", (F.col("x") * F.col("push")).alias("dx"), (F.col("y") * F.col("push")).alias("dy"), (F.col("x") * F.col("push")).alias("px"), (F.col("y") * F.col("push")).alias("py"), F.lit(1.0).alias("mass"), F.lit(1.0).alias("size"), "degree", F.coalesce("squares", F.lit(0).cast("long")).alias("squares"))


def edge_table(graph: Graph, labels="to") -> DataFrame:
    """(src, dst, weight) with the weight from the document, 1 where it is no number."""
    rows = graph.e if labels is None else graph.e.filter(F.col("label").isin([labels] if isinstance(labels, str) else list(labels)))
    return rows.select("src", "dst", F.coalesce(F.expr("try_cast(doc as double)"), F.lit(1.0)).alias("weight"))


def measured(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with vector (source minus target), length and heading."""
    a = vertices.select(F.col("vid").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = vertices.select(F.col("vid").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    rows = edges.select("src", "dst", "weight").join(a, "src").join(b, "dst").withColumn("vx", F.col("ax") - F.col("bx")).withColumn("vy", F.col("ay") - F.col("by"))
    return rows.select("src", "dst", "weight", "vx", "vy", F.hypot("vx", "vy").alias("length"), F.atan2("vy", "vx").alias("angle"))


def start(graph: Graph, labels="to", seed: int = 1, default_gravity: float = 0.0) -> Layout:
    vertices = cut(vertex_table(graph, labels, seed))
    edges = cut(measured(edge_table(graph, labels), vertices))
    return Layout(vertices, edges, vertices.count(), edges.count(), default_gravity=default_gravity, seed=seed)


def repulsion(vertices: DataFrame, coefficient: float, radius: float | None) -> DataFrame:
    """(vid, fx, fy): the push of all others, or of those within the radius, found by grid cells."""
    a = vertices.select("vid", "x", "y", "mass")
    b = vertices.select(F.col("vid").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("mass").alias("om"))
    if radius is None:
        pairs = a.join(b, F.col("vid") != F.col("o"))  # every pair has a force
    else:
        near = F.array(*[F.struct((F.floor(F.col("ox") / radius) + i).alias("cx"), (F.floor(F.col("oy") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        cells = b.withColumn("cell", F.explode(near))
        own = F.struct(F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
        pairs = a.withColumn("cell", own).join(cells, "cell").filter("vid <> o")
    ux, uy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    gap = F.hypot(ux, uy)
    reach = F.greatest(gap, F.lit(0.01))
    masses = coefficient * F.col("mass") * F.col("om")
    # each pair acts from both of its ends
    factor = 2 * (masses / (reach * reach) / 0.5 if radius is None else masses / (reach * reach / 20))
    felt = pairs.filter(gap > NEAREST) if radius is None else pairs.filter((gap > NEAREST) & (gap < radius))
    return felt.groupBy("vid").agg(F.sum(ux * factor).alias("fx"), F.sum(uy * factor).alias("fy"))


def attraction(edges: DataFrame, vertices: DataFrame, influence: float, coefficient: float) -> DataFrame:
    """(vid, fx, fy): the pull along edges, doubled in weight at squares; ends that touch are pushed apart."""
    squared = vertices.select("vid", (F.col("squares") > 0).alias("sq"))
    rows = edges.join(squared.toDF("src", "sa"), "src").join(squared.toDF("dst", "sb"), "dst")
    weight = F.pow(F.when(F.col("sa") | F.col("sb"), 2.0).otherwise(1.0) * F.col("weight"), F.lit(influence)) * coefficient
    sign = F.when(F.col("length") > TOUCHING, -1.0).otherwise(1.0)
    pulled = rows.select("src", "dst", (F.col("vx") * weight * sign).alias("fx"), (F.col("vy") * weight * sign).alias("fy"))
    ends = pulled.select(F.col("src").alias("vid"), "fx", "fy").unionByName(pulled.select(F.col("dst").alias("vid"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))
    return ends.groupBy("vid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def gravity_at(iteration: int, default: float) -> float:
    return GRAVITY if GRAVITY_FROM < iteration < GRAVITY_TO else default


def tuning(vertices: DataFrame) -> tuple[float, float]:
    """Sums of swinging (change of velocity) and traction (mean of old and new), by mass."""
    swing = F.col("mass") * F.hypot(F.col("px") - F.col("dx"), F.col("py") - F.col("dy"))
    pull = 0.5 * F.col("mass") * F.hypot(F.col("px") + F.col("dx"), F.col("py") + F.col("dy"))
    row = vertices.agg(F.sum(swing), F.sum(pull)).first()
    return row[0] or 0.0, row[1] or 0.0


def _paced(layout: Layout, swinging: float, traction: float) -> tuple[float, float]:
    """Speed and efficiency of the step."""
    n, efficiency = layout.vertex_count, layout.efficiency
    chaos = JITTER * min(10.0, TURN * math.sqrt(n) * traction / n**2)
    if traction and swinging / traction > 2.0:
        efficiency *= 0.5 if efficiency > LEAST_EFFICIENCY else 1.0
        chaos = max(chaos, JITTER)
    target = chaos * efficiency * traction / swinging if swinging else layout.speed
    if swinging > chaos * traction:
        efficiency *= 0.7 if efficiency > LEAST_EFFICIENCY else 1.0
    elif layout.speed > 1000:
        efficiency *= 1.3
    return layout.speed + min(target - layout.speed, MAX_RISE * layout.speed), efficiency


def moved(vertices: DataFrame, speed: float, friction: float, seed: int) -> DataFrame:
    """Positions after the step: velocities turned by a small random angle, slowed where they swing."""
    turn = TURN * F.rand(seed)
    rows = vertices.withColumn("turn", turn).withColumn("vx", F.col("dx") * F.cos("turn") - F.col("dy") * F.sin("turn")).withColumn("vy", F.col("dx") * F.sin("turn") + F.col("dy") * F.cos("turn"))
    factor: Column = speed / (1 + F.sqrt(speed * F.col("mass") * F.hypot(F.col("px") - F.col("vx"), F.col("py") - F.col("vy"))))
    return rows.select("vid", (F.col("x") + F.col("vx") * factor).alias("x"), (F.col("y") + F.col("vy") * factor).alias("y"), (F.col("vx") * friction).alias("dx"), (F.col("vy") * friction).alias("dy"), F.col("vx").alias("px"), F.col("vy").alias("py"), "mass", "size", "degree", "squares")


def step(layout: Layout) -> Layout:
    """One iteration."""
    n, i = layout.vertex_count, layout.iteration
    if not n:
        return replace(layout, iteration=i + 1)
    traction = 3500 * n if layout.traction is None else layout.traction
    friction = max(0.2, min(0.95, 1 - TURN * traction / n**1.8))
    push = COEFFICIENT * max(0.2, min(50.0 / i if i else 4.0, 4.0))
    pushed = repulsion(layout.vertices, push, None if i < GLOBAL_UNTIL else LOCAL_RADIUS)
    pulled = attraction(layout.edges, layout.vertices, 0.0 if i < GLOBAL_UNTIL else 0.5, COEFFICIENT)
    force = pushed.unionByName(pulled).groupBy("vid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    pull = gravity_at(i, layout.default_gravity) * COEFFICIENT * F.col("mass")
    felt = layout.vertices.join(force, "vid", "left").withColumn("dx", F.col("dx") + F.coalesce("fx", F.lit(0.0)) + F.col("x") * pull).withColumn("dy", F.col("dy") + F.coalesce("fy", F.lit(0.0)) + F.col("y") * pull * GRAVITY_Y).drop("fx", "fy")
    felt = cut(felt)
    swinging, traction = tuning(felt)
    speed, efficiency = _paced(layout, swinging, traction)
    vertices = cut(moved(felt, speed, friction, layout.seed + 10 + i))
    return replace(layout, vertices=vertices, edges=cut(measured(layout.edges, vertices)), iteration=i + 1, speed=speed, efficiency=efficiency, swinging=swinging, traction=traction, friction=friction)


def run(graph: Graph, iterations: int, labels="to", seed: int = 1) -> Layout:
    """A layout after so many iterations; positions are in ``vertices``."""
    layout = start(graph, labels, seed)
    for _ in range(iterations):
        layout = step(layout)
    return layout
