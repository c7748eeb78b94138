"""Small graphs with known results."""

from __future__ import annotations

from pyspark.sql import SparkSession

from roamframe.graph import Graph

# Edge lists of published example graphs, as "from to" pairs.
EDGES = {
    "simple": "A>T A>B T>C T>B C>B B>D C>E E>D",
    "cyclic": "X>T X>B X>C T>B B>D C>E E>D E>M M>C D>G G>D",
    "p46": "entry>head head>body body>head head>result",
    "double": "entry>head head>body-entry body-result>body body>head head>result body-entry>body-head body-head>body-body body-body>body-head body-head>body-result",
    "flow": "S>C S>B S>A C>F C>G F>I G>I G>J I>K K>I K>S B>E B>A E>H H>E H>K A>D",
    "irreducible": "5>4 5>3 4>1 1>2 3>2 2>1",
    "flow2": "S>A S>B A>B B>C C>D C>E D>F E>F E>J E>C F>C F>G F>L I>F G>I G>B J>K K>J L>J L>N L>M M>N M>L N>L M>O G>O H>O H>S G>H O>P P>O P>Q Q>P",
    "loops": "01>02 01>03 02>03 03>04 04>05 04>06 05>07 06>07 04>03 07>04 07>08 08>03 08>09 09>01 08>10 10>07",
    "betweenness": "a>b b>c b>d c>e d>e e>f",
    "knows": "a>b b>c c>a a>d c>d",
    "blocks": "a>b b>c c>a c>d d>e e>f f>d g>h",
    "square": "a>b b>c c>d d>a d>e e>f f>c a>g g>b",
}
ENTRY = {"simple": "A", "cyclic": "X", "p46": "entry", "double": "entry", "flow": "S", "irreducible": "5", "flow2": "S", "loops": "01"}


def pairs(name: str) -> list[tuple[str, str]]:
    return [tuple(e.split(">")) for e in EDGES[name].split()]


def fixture(spark: SparkSession, name: str, label: str = "to", edge_type: str | None = None) -> Graph:
    rows = pairs(name)
    if edge_type == "undirected":
        rows = sorted({(min(p), max(p)) for p in rows})
    return Graph.from_edges(spark.createDataFrame(rows, "src string, dst string"), label, edge_types={label: edge_type} if edge_type else None)


def job_graph(spark: SparkSession) -> Graph:
    """People, jobs, software and applications."""
    people = ("stephen", "matthias")
    software = ("blueprints", "rexster", "frames")
    rows = [
        ("created", "stephen", "appStephen1", "12/15/2015"), ("created", "stephen", "appStephen2", "12/16/2015"), ("created", "matthias", "appMatthias1", "12/17/2015"),
        ("appliesTo", "appStephen1", "rexster", None), ("appliesTo", "appStephen2", "blueprints", None), ("appliesTo", "appMatthias1", "blueprints", None),
        ("completes", "rexsterJob1", "appStephen1", None), ("completes", "blueprintsJob1", "appStephen2", None), ("completes", "blueprintsJob2", "appMatthias1", None),
    ]
    kinds = {**dict.fromkeys(people, "person"), **dict.fromkeys(software, "software")}
    ids = sorted({r[1] for r in rows} | {r[2] for r in rows})
    vertices = [(i, kinds.get(i, "job" if "Job" in i else "application"), i) for i in ids]
    return Graph(spark.createDataFrame(vertices, "vid string, kind string, doc string"), spark.createDataFrame(rows, "label string, src string, dst string, doc string"))


#: Who bought which item.
BOUGHT = {"alice": (3, 4, 5, 6, 7), "bob": (1, 2, 3, 4, 5), "jon": (6, 7, 8, 9, 10), "jack": (1, 3, 5, 7, 9), "jill": (2, 4, 6, 8, 10)}


def purchases(spark: SparkSession) -> Graph:
    rows = [(f"person:{p}", f"item:{i}") for p, items in BOUGHT.items() for i in items]
    edges = spark.createDataFrame(rows, "src string, dst string")
    ids = sorted({x for r in rows for x in r})
    vertices = spark.createDataFrame([(i, i.split(":")[0]) for i in ids], "vid string, kind string")
    return Graph.from_edges(edges, "bought", vertices)
