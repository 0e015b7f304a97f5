import hashlib
import re

import public_tokenizers as tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from eventlens.llm.byte_bpe import read_ranks
from tests.llm.data import SMALL, empty_docs, odd_docs, pandas_table
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_simhash import slow_components, slow_fingerprint


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def expected(rows, items):
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(t), (i, t))
    rows = list(first.values())
    names = {i: c for i, _, c in slow_components([(k, slow_fingerprint(t)) for k, (_, t) in enumerate(rows)])}
    best = {}
    for k, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0)):
        best.setdefault(names[str(k)], (i, t))
    rows = list(best.values())
    bad = {i for i, *_, c in slow_hits(list(enumerate([t for _, t in rows])), items) if c}
    return [r for k, r in enumerate(rows) if str(k) not in bad]


def chain(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        if name != "byte_bpe":
            assert docs.columns == before.columns
    return docs


@pytest.mark.parametrize("make", [odd_docs, lambda s: s.read.parquet(f"{SMALL}/documents.parquet")])
def test_stages_against_brute_force(spark, make):
    docs = make(spark)
    items = [(r.item_id, r.text) for r in pandas_table("benchmark").itertuples()]
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizers.path(corpus_pipeline.TOKENIZER)), special_tokens={})
    want = expected([(r.doc_id, r.text) for r in docs.collect()], items)
    got = chain(spark, docs).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), library.encode_ordinary(t)) for i, t in want)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, SMALL).collect()] == [1]


def test_clashing_columns_are_renamed(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id bigint, text string, n_tokens string, N_TOKENS_ string, ids string")
    got = corpus_pipeline.byte_bpe(spark, docs, SMALL)
    assert got.columns == ["doc_id", "n_tokens__", "N_TOKENS_", "ids_", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert got.first()["n_tokens__"] == "x"


def test_a_run_leaves_one_table(spark, monkeypatch):
    import os

    left = corpus_pipeline.run(spark, SMALL)
    base = os.path.dirname(left.scratch.removeprefix("file://").removeprefix("file:"))
    mine = [f for f in os.listdir(base) if f.startswith(("pipeline-", "simhash-", "exact-", "document-grams", "contaminated"))]
    assert os.path.basename(left.scratch) in mine
    before = set(mine)
    corpus_pipeline.run(spark, SMALL)
    after = {f for f in os.listdir(base) if f.startswith(("pipeline-", "simhash-", "exact-", "document-grams", "contaminated"))}
    assert len(after - before) == 1


def test_empty(spark):
    assert chain(spark, empty_docs(spark)).count() == 0


def test_registered():
    names = list(entry.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
