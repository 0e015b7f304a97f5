import hashlib
import random

import public_tokenizers as tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.llm import byte_bpe
from eventlens.llm.byte_bpe import RankMap, encode_rows, merge_long, parts, read_ranks, single_pass
from tests.llm.data import SMALL, empty_docs, odd_docs

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def expected(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        out.append((str(key), len(ids), *digests, ids))
    return sorted(out)


def got(docs):
    rows = encode_rows(docs, PATH, tokenizers.PATTERN, with_ids=True).collect()
    return sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in rows)


def test_equals_library_on_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(docs) == expected(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_equals_library_on_odd_texts(spark, library):
    docs = odd_docs(spark)
    assert got(docs) == expected(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_equals_library_on_random_spacing(spark, library):
    rng = random.Random(3)
    alphabet = "abzé中 \t\n\r   \x1c\x85'!,.0123'sT中\U0001f600"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(library, rows)


def test_forgetting_words_does_not_matter(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TASK_WORDS", 5)
    rows = [(i, f"word {i} again and again, {'x' * (i * 40)}") for i in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(library, rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(categories=["L"]), min_size=1, max_size=300))
def test_heap_equals_library(text):
    ranks = read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert merge_long(text.encode(), ranks) == library.encode_ordinary(text)


def test_one_pass_in_rank_order_is_enough():
    ranks = read_ranks(PATH)
    assert single_pass(ranks) and single_pass(read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")))
    # "abc" only comes from a merge of a greater rank, so one pass would miss it.
    assert not single_pass({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4})


def test_rank_map_finds_every_part():
    ranks = read_ranks(PATH)
    words = [b" the", b"x", b"", b"Erreth", "é中".encode(), b" " * 7]
    counts, first, length = RankMap(ranks).merges(words)
    at = 0
    for word, n in zip(words, counts, strict=True):
        want = sorted((ranks[word[i:j]], i, j - i) for i in range(len(word)) for j in range(i + 2, len(word) + 1) if word[i:j] in ranks)
        assert [(i, k) for _, i, k in want] == list(zip(first[at : at + n].tolist(), length[at : at + n].tolist(), strict=True))
        at += n
    assert parts(b"abcd", 0b10011) == [b"a", b"bcd"]


def test_empty(spark):
    assert got(empty_docs(spark)) == []
