"""Exact deduplication behind a two-pass Bloom filter, in DataFrame operations only.

Pass one hashes every text to two filter positions and counts them; positions that more
than one row set become a bitmap of fixed size.  Pass two probes the bitmap: a text both
of whose positions are set is possibly repeated, and only such rows are shuffled and
grouped; all others pass straight through.  A false positive costs a row of shuffle and
never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.plans.scratch import cut, stored

#: Bits of the filter: 16 MB broadcast, whatever the input.  Beyond some hundred million
#: rows it fills up and more rows are shuffled; raise it with the executors' memory.
FILTER_BITS = 2**27
#: Bits in one value of bitmap_construct_agg.
_PER_BITMAP = 32768
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def fingerprint(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256)


def _position(sha: Column, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(salt)), F.lit(bits))


def repeat_filter(hashes: DataFrame, column: str = "sha", bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the filter positions that at least two rows set."""
    where = hashes.select(F.explode(F.array(_position(F.col(column), 0, bits), _position(F.col(column), 1, bits))).alias("pos"))
    many = where.groupBy("pos").count().filter("count > 1")
    return many.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))


def possibly_repeated(rows: DataFrame, filters: DataFrame, column: str = "sha", bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``repeated``; no row is moved."""
    out = rows
    tests = []
    for salt in (0, 1):
        pos = _position(F.col(column), salt, bits)
        side = filters.select(F.col("bucket").alias(f"__b{salt}"), F.col("bitmap").alias(f"__m{salt}"))
        out = out.withColumn(f"__p{salt}", pos)
        # at most bits / 8 bytes by construction
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(F.col(f"__p{salt}")) == F.col(f"__b{salt}"), "left")
        bit = F.bitmap_bit_position(F.col(f"__p{salt}"))
        byte = F.conv(F.hex(F.substring(F.col(f"__m{salt}"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
    return out.select(*rows.columns, (tests[0] & tests[1]).alias("repeated"))


def _best(repeated: DataFrame) -> DataFrame:
    """Per text that occurs more than once: the row that stays and the group's size."""
    best = repeated.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("neg"), "doc_id")).alias("b"), F.count("*").alias("group_size"))
    return cut(best.filter("group_size > 1").select("sha", F.col("b.doc_id").alias("keep_id"), (-F.col("b.neg")).alias("keep_n"), "group_size"))


def _fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), fingerprint(F.col("text")).alias("sha"))


def duplicate_groups(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space; null and blank texts are all
    equal to the empty text.  The row with the most code points stays, then the smallest
    doc_id.  Rows that repeat both doc_id and text count each in group_size and are all
    marked kept if theirs is the doc_id that stays; a null doc_id sorts first.  Other
    columns are ignored; an empty table gives no rows.
    """
    thin = stored(_fingerprints(docs), "fingerprints")
    marked = possibly_repeated(thin, cut(repeat_filter(thin, bits=bits)), bits=bits)
    best = _best(marked.filter("repeated").select("doc_id", "n", "sha"))
    single = marked.filter("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    several = marked.filter("repeated").join(best, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))).alias("kept"),
        "sha",
    )
    return single.unionByName(several).withColumnRenamed("sha", "text_sha256")


def drop_repeats(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one row per distinct text.

    Null and empty texts are one text, of which one row stays; of rows that agree in doc_id and text too, one stays.
    An empty table stays empty.
    """
    thin = stored(_fingerprints(docs), "fingerprints")
    filters = cut(repeat_filter(thin, bits=bits))
    best = _best(possibly_repeated(thin, filters, bits=bits).filter("repeated").select("doc_id", "n", "sha"))
    # clashing names of the caller's columns stay untouched inside one struct
    packed = docs.select(F.struct("*").alias("__row"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), fingerprint(F.col("text")).alias("sha"))
    marked = possibly_repeated(packed, filters, bits=bits)
    straight = marked.filter("not repeated").select("__row.*")
    held = marked.filter("repeated").join(best, "sha", "left")
    alone = held.filter("group_size is null").select("__row.*")
    chosen = held.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).dropDuplicates(["sha"]).select("__row.*")
    return straight.unionByName(alone).unionByName(chosen)
