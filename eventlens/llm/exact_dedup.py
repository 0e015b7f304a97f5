"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of their normalised text, rows of shared
lengths by a hash of a short prefix, and only rows that still share both are
hashed whole. The two coarse levels never leave the scan as rows: each is a
count per key (combined before the shuffle), and the keys that occur more
than once are folded into a bit filter of fixed size. A text whose bit is
clear has no equal; the whole-text hash is evaluated for the others alone,
inside the scan, so no text is ever shuffled. Keys that merely share a bit
cost one hash more and are told apart by it.

Null texts count as empty. Extra columns are ignored, an empty table gives an
empty result. Rows with a null id are members of their group; a null id is
kept only if the group has no other. Of repeated rows (same id, same text)
one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import numbered, only, prepare, stored

#: Bits of the survivor filter: 65,536 words of 64 bits, 512 KB whatever the input.
FILTER_BITS = 1 << 22
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def bit_filter(keys: DataFrame, size: int) -> DataFrame:
    """One row, one array: the words of a bit set of ``size`` bits over the column ``bit``."""
    words = (
        keys.select(F.shiftright("bit", 6).cast("int").alias("word"), (F.col("bit") % 64).cast("int").alias("at"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    )
    every = keys.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("word"))
    whole = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
    return whole.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("filter")
    )


def in_filter(bits: DataFrame, bit: Column) -> Column:
    """Whether a bit of a stored ``bit_filter`` is set."""
    word = F.element_at(bits.scalar(), (F.shiftright(bit, 6) + 1).cast("int"))
    return F.getbit(word, (bit % 64).cast("int")) == 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``id, norm_len, keep_id, group_size, kept``.

    With ``digests`` also ``digest``, the SHA-256 of every normalised text; only
    then are texts without an equal hashed whole.
    """
    prepare(docs.sparkSession)
    norm = normalised(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        norm.alias("norm"),
        F.length(norm).alias("norm_len"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix_hash"),
    )
    coarse = F.pmod(F.xxhash64("norm_len", "prefix_hash"), F.lit(FILTER_BITS))
    # Length, then prefix within the length, in one scan: a length that occurs once goes with its only prefix.
    by_prefix = keyed.groupBy("norm_len", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    bits = stored(bit_filter(by_prefix.filter("n > 1").select(coarse.alias("bit")), FILTER_BITS), "exact-filter")

    hit = in_filter(bits, coarse)
    full = F.sha2("norm", 256)
    kept_columns = ["id", "norm_len", F.when(hit, full).alias("full")] + ([full.alias("digest")] if digests else [])
    seen = stored(keyed.select(*kept_columns).withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = (
        seen.filter("full IS NOT NULL")
        .groupBy("norm_len", "full")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("norm_len", "full", F.col("first.id").alias("keep"), F.col("first.row").alias("keep_row"), "n")
    )
    return seen.join(groups, ["norm_len", "full"], "left").select(
        "id",
        "norm_len",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        *(["digest"] if digests else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    rows, row = numbered(docs, "exact-input")
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    named = rows.select(name.alias("id"), F.col(text_col).alias("text"))
    return only(rows, row, exact_groups(named, "id", "text").filter("kept").select("id.row"))
