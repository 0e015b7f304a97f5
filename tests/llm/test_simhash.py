import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventlens.llm.components import components
from eventlens.llm import simhash
from eventlens.llm.simhash import composite_keys, fingerprint_links, fingerprints, simhash_components
from tests.llm.data import SMALL, empty_docs, odd_docs


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    names = {}
    for i, f in rows:
        if i is not None:
            names[find(f)] = min(names.get(find(f), i), i)
    return sorted((str(i), f, str(names.get(find(f)))) for i, f in rows)


def rows_of(df):
    return sorted((str(r.id), r.fp % 2**64, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("make", [odd_docs, lambda s: s.read.parquet(f"{SMALL}/documents.parquet")])
def test_components_match_brute_force(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    assert rows_of(simhash_components(docs)) == slow_components(rows)


def test_fingerprint_equals_native_hash(spark):
    words = ["alpha", "beta", "gamma", "déjà", "vu"]
    native = [spark.range(1).select(F.xxhash64(F.lit(" ".join(words[i : i + 4])))).first()[0] % 2**64 for i in range(2)]
    assert int(fingerprints([" ".join(words)])[0]) == native[0] & native[1]


def test_composite_keys_meet_within_four_bits():
    rng = random.Random(5)
    fps, other = [], []
    for _ in range(4000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        fps.append(x), other.append(y)
    sets = []
    for values in (fps, other):
        rows, keys = composite_keys(np.array(values, dtype=np.uint64))
        own = [set() for _ in values]
        for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
            own[r].add(k)
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_links_connect_a_large_ball(spark):
    rng = random.Random(1)
    values = {0x0123456789ABCDEF}
    while len(values) < 600:
        x = rng.choice(sorted(values)) if rng.random() < 0.2 else 0x0123456789ABCDEF
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        values.add(x)
    signed = [int(v - 2**64 if v >= 2**63 else v) for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in links)
    reach = components(spark.createDataFrame([(r.a, r.b) for r in links], "a bigint, b bigint"))
    assert [(r.n, r.roots) for r in reach.agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).collect()] == [(600, 1)]


def test_components_of_chains_loops_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 200), (300, 301), (301, 300), (302, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_and_too_many_bits(spark):
    assert simhash_components(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        fingerprint_links(spark.createDataFrame([], "fp bigint"), 5)


def test_long_texts_and_white_space_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [" \t".join(rng.choice(["a", "B", "é", "word"]) + "\x0b" * rng.randint(0, 2) for _ in range(n)) for n in (0, 1, 3, 4, 5, 700, 40)]
    texts += [None, "  ", " x", "x \n", "\n\nA  b\r"]
    want = [slow_fingerprint(t) for t in texts]
    for hashes in (3, 1 << 15):
        monkeypatch.setattr(simhash, "HASHES", hashes)
        assert fingerprints(texts).tolist() == want
