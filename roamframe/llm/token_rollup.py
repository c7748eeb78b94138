"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert, a delete, or a revised count.  Each becomes signed amounts, a batch
of changes is summed by key, and the sums are committed under the batch's id.  Totals are
the sum of committed deltas, so nothing is ever recounted.  A batch counts once: its
folder is complete when Spark's success marker is there, committing it again does
nothing, and what a failed attempt left is overwritten.  Compaction folds all batches up
to an id into a snapshot, whose marker makes it take effect at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.llm._tokens import DEFAULT_VOCABULARY, encoder
from roamframe.plans.workers import prepared

KEYS = ("source", "lang", "tokenizer")
AMOUNTS = ("n_docs", "n_tokens", "n_chars")
SCHEMA = ", ".join([*(f"{k} string" for k in KEYS), *(f"{a} bigint" for a in AMOUNTS)])


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        counts = [len(encode(t.as_py() or "")) // 4 for t in batch.column(at)]
        kept = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, type=pa.int64())], [*names, "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(source, lang, n_chars, old_tokens if there, n_tokens) of every whole text; null counts as empty."""
    extra = [F.col("old_tokens").cast("bigint").alias("old_tokens")] if "old_tokens" in docs.columns else []
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), *extra, "text")
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text")
    return prepared(rows).mapInArrow(partial(_counted, vocabulary=vocabulary), f"{fields}, n_tokens bigint")


def inserted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Signed amounts of new rows(source, lang, n_chars, n_tokens)."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("bigint").alias("n_docs"), F.col("n_tokens"), F.col("n_chars"))


def deleted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Signed amounts of rows that go."""
    return inserted(rows, tokenizer).select(*KEYS, *[(-F.col(a)).alias(a) for a in AMOUNTS])


def moved(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Signed amounts of rows that leave one tokenizer version for another, their counts unchanged."""
    return deleted(rows, old).unionByName(inserted(rows, new))


def revised(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Signed amounts of rows whose count changes from old_tokens to n_tokens."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("bigint").alias("n_docs"), (F.col("n_tokens") - F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"), F.lit(0).cast("bigint").alias("n_chars"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(a).alias(a) for a in AMOUNTS])


class TokenRollup:
    """Totals under a shared folder.

    Null sources and languages are keys of their own, null texts count no characters and no tokens, rows that
    repeat count each time, and a batch without rows is committed too.  One writer at a time: of two that commit one id
    at once, the later replaces what the earlier wrote, and a reader may meet the folder half written; the caller has
    to see to that.  Any number of readers and any number of repeated deliveries are safe.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/{kind}=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _frozen(self) -> int:
        return max(self._committed("snapshot"), default=-1)

    def commit(self, batch_id: int, signed: DataFrame) -> bool:
        """Commit a batch; False if its id was committed before, and then nothing changes."""
        if batch_id in self._committed("batch"):
            return False
        if batch_id <= self._frozen():
            raise ValueError(f"batch {batch_id} comes after the snapshot that closed its id")
        _summed(signed).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """Totals over all committed batches; keys whose rows are all deleted drop out."""
        frozen = self._frozen()
        parts = [f"{self.folder}/batch={b}" for b in self._committed("batch") if b > frozen]
        if frozen >= 0:
            parts.append(f"{self.folder}/snapshot={frozen}")
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return _summed(rows).filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> int:
        """Fold all committed batches into a snapshot; returns the highest id that it holds."""
        top = max(self._committed("batch"), default=-1)
        if top > self._frozen():
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/snapshot={top}")
        return top
