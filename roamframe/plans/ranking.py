"""Global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.plans.scratch import cut


def positioned(df: DataFrame, keys: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with 1-based positions in the order of ``keys``, per ``within`` group or overall.

    Overall positions come from a range partitioning: rows are numbered inside their
    partition and shifted by the counts of the partitions before, one row each.
    """
    if within:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*keys)).cast("long"))
    parted = cut(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    counts = parted.groupBy("__part").agg(F.count("*").alias("n"))
    shift = counts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__shift"))
    local = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    # as many rows as shuffle partitions
    return parted.withColumn(name, local.cast("long")).join(F.broadcast(shift), "__part").withColumn(name, F.col(name) + F.col("__shift")).drop("__part", "__shift")
