"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.llm import exact_dedup, html_template, matroska, mixing, ngram_jaccard, packing, secrets, token_rollup, toxicity, url_reputation
from roamframe.plans.scratch import checkpoint_dir

# The URL rules of the contract.
URL_RULES = (
    url_reputation.Rule("net", "/", "block"),
    url_reputation.Rule("example.net", "/en/", "allow"),
    url_reputation.Rule("example.com", "/de/", "block"),
    url_reputation.Rule("org", "/fr/", "allow"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", F.col("__tokens").alias("tokens"), F.col("__weight").alias("weight"), F.col("__epoch").alias("epoch"),
        F.col("__block").alias("block"), F.col("__block_order").alias("block_order"), F.col("__row_order").alias("row_order"),
    )


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.to_media(_table(spark, sf_dir, "documents")))


def op5_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    host, path = url_reputation.split_url(F.col("url"))
    # a page's path ends in the id of the document it shows, and that document's labels are the page's outcome
    shown = pages.select(host.alias("host"), F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})", 1).alias("id")).filter("id <> ''")
    judged = labels.select(F.col("doc_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")).filter("bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    outcomes = shown.select("host", F.col("id").cast("bigint").alias("doc_id")).join(judged, "doc_id").select("host", "bad")
    return url_reputation.filter_urls(pages, URL_RULES, outcomes)


def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_prompted(_table(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 inserts every document under a count estimated from its length, batch 2 moves all of them to the tokenizer's version, batch 3 revises the counts to it.

    Batches 2 and 3 are delivered twice, batch 2 once more after it was folded into a snapshot.
    """
    docs = _table(spark, sf_dir, "documents")
    version = "byte_bpe_50k"
    length = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    estimate = F.floor(length / 4).cast("bigint")
    rollup = token_rollup.TokenRollup(spark, f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    new = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length.alias("n_chars"), estimate.alias("n_tokens"))
    rollup.commit(1, token_rollup.inserted(new, "length_estimate"))
    relabelled = token_rollup.moved(new, "length_estimate", version)
    rollup.commit(2, relabelled)
    rollup.compact()
    rollup.commit(2, relabelled)
    counted = token_rollup.revised(token_rollup.count_tokens(docs.withColumn("old_tokens", estimate)), version)
    rollup.commit(3, counted)
    rollup.commit(3, counted)
    return rollup.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_toxicity, op3_temperature_mixing, op4_matroska, op5_site_template,
        op6_ngram_jaccard, op7_host_reputation, op8_bloom_dedup, op9_vector_packing, op10_token_rollup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op8_bloom_dedup": r"""
        WITH f AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM f
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
}
