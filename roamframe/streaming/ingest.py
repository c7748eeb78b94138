"""Edges that arrive as a stream.

The engine's traversals are batch queries; what streams is the edge table.  ``edge_weights`` is a
stateful aggregate that a sink can keep up to date, and ``append_edges`` lands a stream in files from
which a graph is read, each micro-batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roamframe.graph import Graph


def edge_weights(edges: DataFrame, label: str, event_time: str | None = None, watermark: str | None = None, window: str | None = None) -> DataFrame:
    """Summed weights of edges(src, dst, weight): streaming or not, per event-time window if one is given.

    With a watermark, state of windows that are over is dropped and rows later than that are ignored.
    """
    keys = [F.col("src"), F.col("dst")]
    if window is not None:
        if event_time is None:
            raise ValueError("a window needs an event time")
        if watermark is not None:
            edges = edges.withWatermark(event_time, watermark)
        keys.append(F.window(event_time, window).alias("window"))
    out = edges.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("doc"))
    return out.withColumn("label", F.lit(label))


def append_edges(edges: DataFrame, label: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of edges(src, dst[, doc]) to Parquet under ``folder``; the sink's log makes it exactly once."""
    rows = edges.withColumn("label", F.lit(label))
    if "doc" not in rows.columns:
        rows = rows.withColumn("doc", F.lit(None).cast("string"))
    writer = rows.select("label", "src", "dst", "doc").writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def graph_of(spark, folder: str) -> Graph:
    """The graph of the edges landed so far; repeated keys count once, with any one of their documents."""
    rows = spark.read.parquet(folder).groupBy("label", "src", "dst").agg(F.max("doc").alias("doc"))
    return Graph.from_edges(rows)
