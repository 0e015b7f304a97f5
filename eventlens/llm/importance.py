"""Importance resampling towards a target distribution over hashed word n-grams.

Texts of a batch are joined with a separator that no word contains, one regex
pass finds all words with their places, and ``searchsorted`` over the places
of the texts tells which text a word is of; runs of words whose first and last
word lie in different texts are masked before ``bincount``. Every run of 1 to
``ngrams`` consecutive words is a feature; its bucket is the CRC-32 of its
UTF-8 words, joined by one space, modulo ``buckets``.

Two scans of the documents: the first sums one vector of bucket counts a task,
then the vectors of tasks in a tree; the second adds up each document's gains.
No text and no feature is shuffled; the driver gets two vectors of ``buckets``
numbers. The draw adds Gumbel noise, a function of seed and id, to the weight
and keeps the highest scores, which is sampling without replacement in
proportion to the importance weights. Places in that order come from a sort of
ids and scores by ranges, never in one task.

Null and empty texts have no features, weight 0, and are never drawn unless
``min_words`` is 0. A null id is written as ``null`` in the noise and is last
among equal scores. Repeated rows are separate rows with equal scores, in any
order among themselves. Extra columns are ignored. An empty table of documents
gives an empty result; without target texts the weights favour rare buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import byte_batches, prepare, shuffle_width, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\n"
BUCKETS = 10_000


def batch_features(texts: list[bytes], ngrams: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words a text, and per n-gram length the text and the bucket of every feature."""
    joined = SEPARATOR.join(texts).lower()  # of bytes: A-Z only
    starts = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    names: dict[bytes, int] = {}
    found = np.fromiter(
        (m.start() << 24 | names.setdefault(m.group(), len(names)) for m in WORD.finditer(joined)), dtype=np.int64
    )
    if len(names) >= 1 << 24:
        raise ValueError("more distinct words in a batch than their numbers can hold")
    text_of, word = np.searchsorted(starts, found >> 24, side="right") - 1, found & ((1 << 24) - 1)
    spelled = list(names)
    texts_of, bucket_of = [], []
    for n in range(1, ngrams + 1):
        count = max(word.size - n + 1, 0)
        inside = text_of[:count] == text_of[n - 1 : n - 1 + count]
        if n == 1:
            grams, which = [(i,) for i in range(len(spelled))], word
        else:
            runs = np.stack([word[i : i + count] for i in range(n)], axis=1)[inside]
            grams, which = np.unique(runs, axis=0, return_inverse=True)
            grams, which = grams.tolist(), which.reshape(-1)
        crc = np.fromiter((zlib.crc32(b" ".join([spelled[i] for i in g])) % buckets for g in grams), dtype=np.int64, count=len(grams))
        texts_of.append(text_of[:count][inside])
        bucket_of.append(crc[which] if crc.size else np.zeros(0, np.int64))
    return np.bincount(text_of, minlength=len(texts)), texts_of, bucket_of


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def _summed(buckets: int):
    """Adds up the vectors of a partition; one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for vector in batch["counts"]:
                total += vector.values.to_numpy()
        yield _vector(total)

    return add


def _vector(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])


def bucket_counts(docs: DataFrame, text_col: str = "text", ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in byte_batches(batches, "text"):
            for found in batch_features(_texts(batch), ngrams, buckets)[2]:
                total += np.bincount(found, minlength=buckets)
        yield _vector(total)

    vectors = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "counts array<bigint>")
    for width in (shuffle_width(docs.sparkSession), 1):
        vectors = vectors.repartition(width).mapInArrow(_summed(buckets), "counts array<bigint>")
    return np.array(vectors.first()["counts"], dtype=np.int64)


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source, smoothed by one a bucket, rounded down."""
    b = counts.size
    ratio = ((target + 1.0) * (float(counts.sum()) + b)) / ((counts + 1.0) * (float(target.sum()) + b))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def document_weights(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngrams: int = 1
) -> DataFrame:
    """One row per document: ``id, n_words, n_features, weight``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in byte_batches(batches, "text"):
            n_words, texts_of, bucket_of = batch_features(_texts(batch), ngrams, gain.size)
            n_features, weight = np.zeros((2, batch.num_rows), np.int64)
            for text, bucket in zip(texts_of, bucket_of, strict=True):
                n_features += np.bincount(text, minlength=batch.num_rows)
                np.add.at(weight, text, gain[bucket])
            arrays = [batch["id"], *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place, 1, 2, 3..., in ``order``: sorted by ranges, places counted range by range."""
    spark = rows.sparkSession
    placed = stored(
        rows.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "ranked-rows",
    )
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(sizes, default=0) + 1):  # as many as there are ranges
        offsets.append(before)
        before += sizes.get(p, 0)
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), (part + 1).cast("int"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, offset + within + 1).drop("place")


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = 10,
    min_words: int = 20,
    ngrams: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """One row per document: ``id, n_words, n_features, weight, score, rank``; ``rank`` is null for those not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` of 100 are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, ngrams, buckets), bucket_counts(target, target_text_col, ngrams, buckets))
    weighed = document_weights(docs, gain, id_col, text_col, ngrams)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "importance-scores")
    eligible = scored.filter(F.col("n_words") >= min_words)
    draw = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id")]
    places = ranked(eligible, order)
    drawn = places.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest)
