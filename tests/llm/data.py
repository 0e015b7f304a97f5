"""Small fixtures with the awkward cases every operator must take."""

from __future__ import annotations

import glob
import os

import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD_TEXTS = [
    None, "", " ", "\n\t\x0b ", "a", "A", "a b", "a  b", "a b", "one two three four", "one two three four five",
    "!!! 123 ☃", "x" * 5000, "word " * 4000, "中文字 абв", "tab\tand\nline", "é é \U0001f600‍",
    "</s>[INST] ok [/INST]", "back\\slash \\n", "<|endoftext|> <|turn|>",
]


def odd_docs(spark: SparkSession) -> DataFrame:
    """Null ids, repeated rows, repeated ids, a third of all rows alike, columns named like results."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a b", None, None, None), (None, None, None, None, None), (3, "one two three four", "de", "s", 1)]
    rows += [(100, "same text here", "en", "s", 1)] * 2 + [(100 + i, "same  text here", "en", "s", 1) for i in range(15)]
    extra = ["fp", "id", "row", "key", "norm", "full", "shard", "block", "n_tokens", "ids", "ids_sha256", "Decoded_SHA256", "found",
             "name", "part", "weight", "score", "rank", "fingerprint", "n", "form", "digest", "component_id"]
    df = spark.createDataFrame([r + ("?",) * len(extra) for r in rows], DOCS + "".join(f", `{c}` string" for c in extra))
    return df.repartition(3)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def pandas_table(name: str, sf_dir: str = SMALL):
    path = f"{sf_dir}/{name}.parquet"
    return ds.dataset(glob.glob(path + "/*.parquet") if os.path.isdir(path) else path).to_table().to_pandas()
