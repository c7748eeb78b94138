from __future__ import annotations

from pyspark.sql import functions as F

from roamframe.streaming.ingest import append_edges, edge_weights, graph_of


def test_landed_edges_make_a_graph(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b")], "src string, dst string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        append_edges(stream, "to", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    g = graph_of(spark, str(tmp_path / "out"))
    assert g.e.count() == 2 and {r["vid"] for r in g.get_vertex("a").out("to").df.collect()} == {"b"}


def test_weights_add_up_per_window(spark):
    rows = spark.createDataFrame([("a", "b", 1.0, "2024-01-01 00:10:00"), ("a", "b", None, "2024-01-01 00:50:00"), ("a", "b", 5.0, "2024-01-01 01:10:00")], "src string, dst string, weight double, t string").withColumn("t", F.to_timestamp("t"))
    assert [r["doc"] for r in edge_weights(rows, "to").collect()] == [7.0]
    assert sorted(r["doc"] for r in edge_weights(rows, "to", "t", "1 hour", "1 hour").collect()) == [2.0, 5.0]
