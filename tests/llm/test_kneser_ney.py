import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import kneser_ney as kn
from eventlens.llm.kneser_ney import discounts, perplexities, quality
from eventlens.llm.shards import Block
from tests.llm.data import SMALL, empty_docs, odd_docs


def words_of(text):
    return (None, *(text or "").encode().lower().split(), None)


def grams_of(text, order):
    """Each token after at most ``order - 1`` before it; None is the boundary."""
    w = words_of(text)
    return [w[max(0, i + 1 - order) : i + 1] for i in range(1, len(w))]


class Slow:
    """An ordinary word-level model with dictionaries, by the textbook's recursion."""

    def __init__(self, texts, order):
        self.order = order
        seen = Counter(g for t in texts for g in grams_of(t, order))
        three = {g: n for g, n in seen.items() if len(g) == 3}
        two = Counter(g[1:] for g in three)
        two.update({g: n for g, n in seen.items() if len(g) == 2})
        self.n = {3: three, 2: two, 1: Counter(g[1:] for g in two)}
        self.d = {k: discounts(*(sum(n == c for n in level.values()) for c in (1, 2, 3, 4))) for k, level in self.n.items()}
        self.total, self.cut = defaultdict(float), defaultdict(float)
        for k, level in self.n.items():
            for g, n in level.items():
                self.total[k, g[:-1]] += n
                self.cut[k, g[:-1]] += self.d[k][min(n, 3) - 1]
        self.words = [g[0] for g in self.n[1]]

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        k, own = len(gram), (len(gram), gram[:-1])
        if not self.total[own]:
            return self.p(gram[1:])
        n = self.n[k].get(gram, 0)
        mine = n - self.d[k][min(n, 3) - 1] if n else 0
        return (mine + self.cut[own] * self.p(gram[1:])) / self.total[own]


def wanted(slow, rows):
    return sorted((str(r.id), len(words_of(r.text)) - 1, -sum(math.log10(slow.p(g)) for g in grams_of(r.text, slow.order))) for r in rows)


def found(rows):
    return sorted((str(r.id), r.n_tokens, math.log10(r.perplexity) * r.n_tokens) for r in rows)


def alike(got, want):
    return all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, b[2]) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_equals_an_ordinary_word_model_and_sums_to_one(spark, order):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd_docs(spark).select("doc_id", "text")).withColumnRenamed("doc_id", "id")
    trusted = docs.filter("id % 2 = 0")
    slow = Slow([r.text for r in trusted.collect()], order)
    frequent = max((g for g in slow.n[2] if None not in g), key=slow.n[2].get)
    for context in ((None,), (b"unseen-word",), frequent[:1], *([frequent, (b"unseen-word", frequent[0])] if order == 3 else [])):
        assert abs(sum(slow.p((*context, w)) for w in [*slow.words, b"never seen"]) - 1) < 1e-9
    assert alike(found(perplexities(docs, trusted, order=order).collect()), wanted(slow, docs.collect()))


@pytest.mark.parametrize("full", [True, False])
def test_a_full_filter_and_split_shards_change_nothing(spark, monkeypatch, full):
    if full:
        monkeypatch.setattr(kn, "key_filter", lambda model, order: np.full((kn.SHARDS, 8), 255, np.uint8))
    else:
        monkeypatch.setattr(kn, "SCAN_TASKS", 1)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text").repartition(5)
    trusted = docs.filter("id % 3 = 0")
    slow = Slow([r.text for r in trusted.collect()], 3)
    assert alike(found(perplexities(docs, trusted, order=3).collect()), wanted(slow, docs.collect()))


def test_back_off_counts_the_words_before(spark):
    """After 40 words and after one, 40 times each: the lower order tells them apart, without a bound."""
    rows = [(i, f"w{i} wide x y") for i in range(40)] + [(100 + i, "one deep x y") for i in range(40)]
    trusted = spark.createDataFrame(rows, "id bigint, text string")
    asked = spark.createDataFrame([(0, "new wide"), (1, "new deep"), (None, None)], "id bigint, text string")
    got = {r.id: r.perplexity for r in perplexities(asked, trusted).collect()}
    assert got[0] < got[1] and got[None] > 1
    slow = Slow([t for _, t in rows], 2)
    assert slow.p((b"wide",)) > 20 * slow.p((b"deep",))


def test_without_trusted_text_every_token_is_unknown(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, None), (3, "")], "id bigint, text string")
    got = perplexities(docs, docs.limit(0)).collect()
    assert {(r.id, r.n_tokens, r.perplexity) for r in got} == {(2**53 + 1, 3, 1.0), (None, 1, 1.0), (3, 1, 1.0)}


def test_good_text_stays_and_bad_text_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.id: r.kept for r in quality(docs, labels).collect()}
    assert len(kept) == docs.count()
    rows = labels.filter("toxic = 0").collect()
    good, bad = ([kept[r.doc_id] for r in rows if r.quality == q and r.doc_id in kept] for q in (1, 0))
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_thresholds_by_language_and_without_labels(spark):
    rows = [(i, f"plain words {i % 3} here" if i % 2 else "mots simples ici", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, "zq zx zv", "en"), (101, "zq", None), (None, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality(docs, labels).collect()
    cuts = {r.lang: r.threshold for r in got}
    assert cuts["en"] != cuts["fr"] and cuts["de"] == cuts[None] and all(r.kept for r in got if r.id is not None and r.id < 60)
    assert not next(r.kept for r in got if r.id == 100)
    free = quality(docs, labels.limit(0)).collect()
    assert len(free) == len(rows) and all(r.kept and r.threshold is None for r in free)
    assert quality(empty_docs(spark), labels).count() == 0


def test_the_model_is_fitted_on_all_trusted_text(spark):
    """27,000 trusted ids, of which four in five are learned from."""
    text = F.format_string("w%s of x%s%s", F.col("id") % 90, F.col("id") % 7, F.when(F.col("id") % 11 == 0, F.lit(" rare")).otherwise(F.lit("")))
    docs = spark.range(27_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    learned = [r.text for r in docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").collect()]
    assert len(learned) > 20_000
    some = docs.filter("doc_id < 200").withColumnRenamed("doc_id", "id").collect()
    got = {r.id: math.log10(r.perplexity) * r.n_tokens for r in quality(docs, labels).filter("id < 200").collect()}
    slow = Slow(learned, 2)
    assert all(abs(got[int(i)] - total) < 1e-6 for i, _, total in wanted(slow, some))


@pytest.mark.parametrize("words, pairs, partitions", [(0, 0, 8), (16, 40, 200), (1 << 16, 1 << 17, 200)])
def test_frequent_words_and_more_shards_change_nothing(spark, monkeypatch, words, pairs, partitions):
    monkeypatch.setattr(kn, "HOT_WORDS", words)
    monkeypatch.setattr(kn, "HOT_PAIRS", pairs)
    monkeypatch.setattr(kn, "shuffle_width", lambda _: partitions)
    monkeypatch.setattr(kn, "MERGE_GRAMS", 50)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text").repartition(3)
    trusted = docs.filter("id % 3 = 0")
    slow = Slow([r.text for r in trusted.collect()], 2)
    assert alike(found(perplexities(docs, trusted).collect()), wanted(slow, docs.collect()))


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_rows_of_ids_are_exact_whatever_the_filters_hold(spark, monkeypatch, bits):
    monkeypatch.setattr(kn, "ID_BITS", bits)
    rows = [(i % 300, f"t{i}") for i in range(700)] + [(None, "none")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    for step in (7, 2, 1000):
        ids = spark.range(0, 900, step)
        got = sorted(r.text for r in kn.rows_of(texts, ids).collect())
        assert got == sorted(t for i, t in rows if i is not None and i % step == 0)
    narrow = spark.range(0, 900, 7).select(F.col("id").cast("int").alias("id"))
    assert kn.rows_of(texts, narrow).count() == sum(i is not None and i % 7 == 0 for i, _ in rows)


def test_a_block_and_a_merge_hold_few_numbers_a_token():
    """Bytes a token beyond what goes in, at the peak of making messages and of merging grams."""
    rng = np.random.default_rng(0)
    block = Block()
    for i in range(400):
        block.add(str(i), " ".join(f"w{x}" for x in rng.zipf(1.3, 1000) % 20_000))
    tokens = 400 * 1001
    t = kn.tokens_of(block, 2)
    grams = kn.merged(t.second, t.before, t.word, t.hashed.size)
    parts = [kn.unpack_grams(kn._held(*(t.hashed[x] for x in grams[:3]), grams[3]))] * 4
    whole = parts[0][-1].size * len(parts)
    hot = kn.Hot(np.sort(t.hashed)[::9], np.zeros(t.hashed[::9].size), np.arange(3), np.zeros(3))
    del t, grams
    filled = np.full((16, 1 << 10), 0x55, np.uint8)

    def peak(make) -> int:
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        make()
        most = tracemalloc.get_traced_memory()[1] - before
        tracemalloc.stop()
        return most

    assert peak(lambda: kn._messages(block, filled, hot, 16, 2)) < 80 * tokens
    assert peak(lambda: kn._joined(parts)) < 110 * whole


@pytest.mark.parametrize("size", [0, 1, 5000])
def test_packed_grams_come_back(size):
    rng = np.random.default_rng(size)
    words = np.unique(rng.integers(0, 1 << 47, 300, np.uint64) * np.uint64(2))
    second, before, word = rng.integers(0, words.size, (3, size))
    grams = kn.merged(second, before, word, words.size)
    own, *back = kn.unpack_grams(kn.pack_grams(words, *grams))
    assert (own == words).all() and all((a == b).all() for a, b in zip(back, grams, strict=True))
    halves = [(words, *kn.merged(second[k::2], before[k::2], word[k::2], words.size)) for k in (0, 1)]
    used, *joined = kn.unpack_grams(kn._joined(halves))
    assert (used == words).all() and all((a == b).all() for a, b in zip(joined, grams, strict=True))
