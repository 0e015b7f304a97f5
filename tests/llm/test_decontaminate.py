import random
import re

import pytest

from eventlens.llm import decontaminate
from eventlens.llm.decontaminate import contamination, drop_contaminated
from tests.llm.data import SMALL, empty_docs, odd_docs


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((str(key), len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def fast(docs, items):
    return sorted((str(r.id), r.n_words, r.n_hit, list(r.items), r.contaminated) for r in contamination(docs, items).collect())


def rows(df):
    return [(r[0], r.text) for r in df.collect()]


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = slow(rows(docs), rows(items))
    assert fast(docs, items) == want and any(r[4] for r in want)
    clean = {r[0] for r in want if not r[4]}
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, items).collect()) == sorted(clean)


def test_pieces_cover_every_word_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 40)
    rng = random.Random(2)
    for n in (0, 1, 30, 200, 500):
        text = " ".join(rng.choice(["a", "bb", "x" * 100, "é"]) for _ in range(n))
        all_words, seen = decontaminate.words_of(text), []
        for words, begin, end, place in decontaminate._pieces(text):
            assert all_words[place : place + len(words)] == words
            assert (place == 0 or begin >= 26) and (place + len(words) == len(all_words) or len(words) - end >= 26)
            seen += words[begin:end]
        assert seen == all_words


@pytest.mark.parametrize(("bound", "piece"), [(0, 1 << 19), (100_000, 1 << 19), (100_000, 60)])
def test_small_vocabulary_short_items_and_ties(spark, monkeypatch, bound, piece):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", bound)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    rng = random.Random(4)
    text = lambda n, k: " ".join(rng.choice("aAbcdé")[:1] + str(rng.randint(0, k)) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 12, 13, 14, 30]), 1)) for i in range(25)]
    items += [(None, items[3][1]), (25, items[4][1]), (4, items[4][1]), (26, None), (27, "!!")]
    docs = [(i, text(rng.choice([0, 2, 5, 13, 60]), 1)) for i in range(60)]
    docs += [(100 + i, f"{text(20, 9)} {items[i][1]}\n{items[i + 1][1]} {text(5, 9)}") for i in range(20)]
    docs += [(200, "a0 " * 400), (None, items[0][1]), (201, None)]
    made = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert fast(*made) == slow(docs, items)


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "same text here"), (2, "word " * 14)], "item_id bigint, text string")
    assert fast(docs, items) == slow([(r.doc_id, r.text) for r in docs.collect()], rows(items))
    assert drop_contaminated(docs, items).columns == docs.columns
    assert contamination(empty_docs(spark), items).count() == 0
    assert {r[2] for r in fast(docs, items.limit(0))} == {0}
