"""Graphs over tables: declarative mappings from Parquet to vertices and edges.

Keys of different tables overlap, so vertex ids are kinded, ``kind:key`` as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.graph import Graph


def kinded(kind: str, key: Column | str) -> Column:
    """The id of a kind's vertex."""
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def kind_of(vid: Column) -> Column:
    return F.substring_index(vid, ":", 1)


def key_of(vid: Column) -> Column:
    return F.substring_index(vid, ":", -1)


@dataclass(frozen=True)
class VertexMap:
    """Vertices of a kind from a table's rows; ``fields`` go into the document under these names."""

    kind: str
    table: str
    key: str
    fields: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeMap:
    """Edges of a label from a table's rows, between (kind, column) ends; ``unique`` drops repeated ends."""

    label: str
    table: str
    src: tuple[str, str]
    dst: tuple[str, str]
    unique: bool = False


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def graph_of(spark: SparkSession, sf_dir: str, vertices: Sequence[VertexMap], edges: Sequence[EdgeMap]) -> Graph:
    """A lazily read graph.  Documents are one struct with the fields of all kinds, so that a query reads only what it names."""
    names: dict[str, str] = {}
    for v in vertices:
        kinds = dict(read(spark, sf_dir, v.table).dtypes)
        names |= {n: kinds[c] for n, c in v.fields.items()}
    parts = []
    for v in vertices:
        doc = F.struct(*[(F.col(v.fields[n]) if n in v.fields else F.lit(None)).cast(t).alias(n) for n, t in sorted(names.items())])
        parts.append(read(spark, sf_dir, v.table).select(kinded(v.kind, v.key).alias("vid"), F.lit(v.kind).alias("kind"), doc.alias("doc")))
    rows = []
    for e in edges:
        pairs = read(spark, sf_dir, e.table).select(F.col(e.src[1]).alias("src"), F.col(e.dst[1]).alias("dst"))
        if e.unique:  # over the short keys, before they become ids
            pairs = pairs.distinct()
        rows.append(pairs.select(F.lit(e.label).alias("label"), kinded(e.src[0], "src").alias("src"), kinded(e.dst[0], "dst").alias("dst")))
    v, e = parts[0], rows[0]
    for p in parts[1:]:
        v = v.unionByName(p)
    for r in rows[1:]:
        e = e.unionByName(r)
    return Graph(v, e)


COMMERCE_VERTICES = (
    VertexMap("region", "region", "r_regionkey", {"name": "r_name"}),
    VertexMap("nation", "nation", "n_nationkey", {"name": "n_name"}),
    VertexMap("customer", "customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    VertexMap("supplier", "supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    VertexMap("part", "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}),
    VertexMap("order", "orders", "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}),
)
COMMERCE_EDGES = (
    EdgeMap("in_region", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    EdgeMap("lives_in", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    EdgeMap("based_in", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    EdgeMap("placed", "orders", ("customer", "o_custkey"), ("order", "o_orderkey")),
    EdgeMap("contains", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), True),
    EdgeMap("supplies", "lineitem", ("supplier", "l_suppkey"), ("part", "l_partkey"), True),
)


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders with six labels."""
    return graph_of(spark, sf_dir, COMMERCE_VERTICES, COMMERCE_EDGES)


def contains_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, doc, nth): order to part with the quantity, and a total order among repeats."""
    return read(spark, sf_dir, "lineitem").select(kinded("order", "l_orderkey").alias("src"), kinded("part", "l_partkey").alias("dst"), F.col("l_quantity").alias("doc"), F.struct("l_linenumber", "l_suppkey", "l_shipdate").alias("nth"))


def next_order(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order to the same customer's next one, by date and key."""
    by_customer = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select(kinded("order", "o_orderkey").alias("src"), kinded("order", F.lead("o_orderkey").over(by_customer)).alias("dst"), F.row_number().over(by_customer).alias("nth"))
    vertices = rows.select(F.col("src").alias("vid"), F.lit("order").alias("kind"), F.struct("nth").alias("doc"))
    return Graph(vertices, rows.filter("dst is not null").select(F.lit("next").alias("label"), "src", "dst"))


def trade(spark: SparkSession, sf_dir: str, top: int = 2) -> Graph:
    """Customer's nation to supplier's nation: each nation's ``top`` partners by lines, without itself; the doc is the number of lines."""
    line, orders = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = rows.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("doc"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("doc"), "s_nationkey"))).filter(F.col("r") <= top)
    vertices = read(spark, sf_dir, "nation").select(kinded("nation", "n_nationkey").alias("vid"), F.lit("nation").alias("kind"), F.col("n_name").alias("doc"))
    return Graph(vertices, best.select(F.lit("trade").alias("label"), kinded("nation", "c_nationkey").alias("src"), kinded("nation", "s_nationkey").alias("dst"), "doc"))


def follows_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): event type to the same user's next event type, one row per pair of events."""
    by_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(by_user).alias("dst"))
    return rows.filter("dst is not null")


def follows(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types with how often one follows another as weight."""
    counts = follows_rows(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").cast("double").alias("doc"))
    return Graph.from_edges(counts, "follows")


def same_text(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents with equal texts, each linked to the first of its kind; undirected."""
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.col("doc_id"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = docs.join(first, "h").filter("doc_id <> first").select(F.lit("same_text").alias("label"), F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    return Graph(docs.select(F.col("doc_id").alias("vid")), pairs, {"same_text": "undirected"})
