import hashlib

import public_tokenizers as tokenizers
from tokenizers import Tokenizer

from eventlens.llm.token_counts import token_counts
from tests.llm.data import SMALL, empty_docs, odd_docs

PATH = tokenizers.path("word_bpe_49k.json")


def expected(rows, path=PATH):
    library = Tokenizer.from_file(path)
    encode = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    return sorted((str(i), len((t or "").encode()), encode(t)) for i, t in rows)


def got(df):
    return sorted((str(r.id), r.n_bytes, r.n_tokens) for r in df.collect())


def test_equals_library(spark):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs(spark)):
        assert got(token_counts(docs, PATH)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_spacing_and_special_strings(spark):
    texts = ["a\x1cb", "a\x85b c", "a  b", "x<|endoftext|>y", "<|ENDOFTEXT|>", "e ́x", "İ ǅ", "don't  'll", "\x0b\x0c1 2", "ß\r\nß"]
    rows = list(enumerate(texts))
    assert got(token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH)) == expected(rows)


def test_cache_is_used_and_grows_by_misses_only(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(i, f"text {i % 5}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(token_counts(docs, PATH, cache=cache)) == expected(rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == 5
    # Counts come from the cache: a wrong one, stored first for a new digest, is what a later run returns.
    version = hashlib.sha256(open(PATH, encoding="utf-8").read().encode()).hexdigest()
    digest = hashlib.sha256(b"new text").hexdigest()
    spark.createDataFrame([(digest, version, 99), (digest, "other tokenizer", 1)], stored.schema).write.mode("append").parquet(cache)
    more = docs.union(spark.createDataFrame([(50, "new\ttext"), (51, "unseen")], docs.schema))
    found = dict((r.id, r.n_tokens) for r in token_counts(more, PATH, cache=cache).collect())
    assert found[50] == 99 and found[51] == expected([(0, "unseen")])[0][2]
    assert spark.read.parquet(cache).count() == 8


def test_tokenizer_that_keeps_space(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [(0, "a  b\n\n c"), (1, None), (2, " lead")]
    assert got(token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), path, drops_space=False)) == expected(rows, path)


def test_empty(spark):
    assert token_counts(empty_docs(spark), PATH).count() == 0
