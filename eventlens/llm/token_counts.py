"""Token counts through a digest cache.

The cache is a Parquet table of content digest, tokenizer digest and count.
Documents are joined to it by the SHA-256 of their normalised text and of the
tokenizer file; the misses are reduced to one text a digest, encoded, and
appended. Counts are then read from the cache alone. Copies are encoded once,
and a run that is repeated, or was cut off after its append, encodes nothing
twice. Rows that two writers append for one digest agree, and one is read.

Normalisation turns each run of ASCII white space into one space; it is meant
for tokenizers that drop white space (``drops_space``) and is skipped for
others. Encoding such a text remembers the counts of its space-separated
chunks, which is exact as no token spans white space; every chunk goes to the
library whole, with special strings handled as its default.

Null text counts as empty (0 bytes, 0 tokens). Null and repeated ids are fine,
extra columns are ignored, an empty table adds nothing to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import prepare, stored
from eventlens.session import scratch_path

#: Most chunks whose counts a worker remembers.
MEMO_CHUNKS = 500_000

_CACHE = "content string, tokenizer string, n_tokens bigint"
_loaded: dict[str, tuple] = {}


def _counter(version: str, definition: str):
    """The tokenizer and its remembered chunk counts, once for each worker."""
    if version not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[version] = (Tokenizer.from_str(definition), {})
    return _loaded[version]


def count_tokens(texts: list[str], version: str, definition: str, drops_space: bool) -> list[int]:
    tokenizer, memo = _counter(version, definition)
    if not drops_space:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    counts = []
    for text in texts:
        chunks = text.encode().split()
        if new := list({c for c in chunks if c not in memo}):
            if len(memo) > MEMO_CHUNKS:
                memo.clear()
                new = list(set(chunks))
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                encoded = tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
                memo.update(zip(part, [len(e.ids) for e in encoded], strict=True))
        counts.append(sum(map(memo.__getitem__, chunks)))
    return counts


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    drops_space: bool = True,
    cache: str | None = None,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens``.

    ``cache`` is a folder that all executors reach; without one a new cache is
    made in the shared scratch folder.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver, of fixed size
        definition = f.read()
    version = hashlib.sha256(definition.encode()).hexdigest()
    definition_of = spark.sparkContext.broadcast(definition)
    cache = cache or scratch_path(spark, "token-cache")

    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_space else text
    keyed = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        content.alias("text"), F.sha2(content, 256).alias("content"),
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = count_tokens(pdf.text.tolist(), version, definition_of.value, drops_space)
            yield pd.DataFrame({"content": pdf.content, "tokenizer": version, "n_tokens": n})

    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)  # the table exists from now on
    known = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    misses = keyed.select("content", "text").join(known, "content", "left_anti").dropDuplicates(["content"])
    misses.mapInPandas(encode, _CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    counts = known.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    rows = stored(keyed.select("id", "n_bytes", "content"), "token-digests")
    return rows.join(counts, "content").select("id", "n_bytes", "n_tokens")
