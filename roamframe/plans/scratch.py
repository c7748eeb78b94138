"""Reliable intermediate storage.

Iterative operators cut lineage with reliable checkpoints.  The folder is the one
the cluster names in ``spark.checkpoint.dir``; only where a local session names none (a
unit test, a notebook) is a temporary folder set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set to a temporary one if there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="roamframe-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it with a short lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``cut``, dealt out and sorted by ``key``: joins on it take the rows where they are."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    # a checkpoint keeps how its rows are dealt out only if the plan was fixed before it ran
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a checkpoint, the result can be column-pruned and filtered at the scan, so
    a wide table can serve several narrow readers.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/roamframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
