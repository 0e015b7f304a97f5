import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from eventlens.llm import weighted_fingerprint as wf
from tests.llm.data import SMALL, empty_docs, odd_docs


def bag(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w)


def similarity(a, b):
    a, b = bag(a), bag(b)
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a or b else 1.0


def hashed(term, i):
    return xxhash.xxh64_intdigest(struct.pack("<i", i), seed=term & (2**64 - 1))


def slow_fingerprint(text):
    samples = []
    for i in range(wf.SAMPLES):
        best = None
        for word, count in bag(text).items():
            # Spark's hash of two columns: the hash of the first is the seed of the second.
            term = xxhash.xxh64_intdigest(word.encode(), seed=42)
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", term), seed=42)
            one, two = hashed(seed, 2 * i), hashed(seed, 2 * i + 1)
            u1, u2, u3, u4 = (((h >> 32 if k == 0 else h & 0xFFFFFFFF) + 0.5) * 2.0**-32 for h in (one, two) for k in (0, 1))
            c, r, b = -math.log(u3 * u4), -math.log(u1 * u2), math.log(u1) / math.log(u1 * u2)
            t = math.floor(math.log(count) / r + b)
            a = c * math.exp(-r * (t + 1 - b))
            assert a == pytest.approx(c * u2 * math.exp(-r * t))
            value = int(math.sqrt(c * u2 * math.exp(-r * t)) * 2.0**36) << 24 | ((two >> 8 ^ one ^ t) & (2**24 - 1))
            best = value if best is None else min(best, value)
        samples.append("g" * wf.DIGITS if best is None else f"{best & (2**24 - 1):06x}")
    return "".join(samples)


def slow_likeness(a, b):
    parts = [(a[i : i + wf.DIGITS], b[i : i + wf.DIGITS]) for i in range(0, len(a), wf.DIGITS)]
    return sum(x == y for x, y in parts) / len(parts)


def slow_rows(rows):
    """Of distinct ids, nulls last."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    own = [slow_fingerprint(t) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[after][1][:half]
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[k], slow_fingerprint(edited),
            slow_likeness(own[k], slow_fingerprint(edited)), slow_likeness(own[k], own[after]),
        ))
    return out


def test_brute_force(spark):
    docs = odd_docs(spark).groupBy("doc_id").agg(F.max("text").alias("text"), F.lit(1).alias("fp"), F.lit(2).alias("part"))
    got = wf.edited_fingerprints(docs)
    assert got.columns == "id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, slow_rows([(r.doc_id, r.text) for r in docs.collect()])))


def test_whole_table_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(wf, "RANGE_BYTES", 4000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted(rows, reverse=True)
    got = {r.id: r for r in wf.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == slow_likeness(got[i].fingerprint, got[after[0]].fingerprint)
    for i, text in order[::23]:
        assert got[i].fingerprint == slow_fingerprint(text)


def test_repeated_and_null_ids(spark):
    docs = odd_docs(spark)
    got = wf.edited_fingerprints(docs).collect()
    want = sorted((str(r.doc_id), len(r.text or "")) for r in docs.collect())
    assert sorted((str(r.id), r.n_chars) for r in got) == want
    by_text = {(r.id, r.n_chars): r.fingerprint for r in got}
    assert by_text[(4, 1)] == by_text[(5, 1)]  # a and A: words are lower-cased
    assert by_text[(0, 0)] == by_text[(1, 0)] == by_text[(2, 1)] and len({r.fingerprint for r in got}) > 10


def test_collisions_estimate_the_weighted_similarity(spark):
    pairs = [("a a a b", "a b b b"), ("a b c d", "c d e f"), ("x " * 30 + "y", "x " * 10 + "y z"), ("p q r", "p q r")]
    # Every number stands for another set of words of the same weights.
    rows = [(k, n, side, " ".join(f"{w}{n}" for w in pair[side].split())) for k, pair in enumerate(pairs) for n in range(60) for side in (0, 1)]
    signed = wf.fingerprints(spark.createDataFrame(rows, "k int, n int, side int, text string"), ["k", "n", "side"])
    both = signed.groupBy("k", "n").pivot("side", [0, 1]).agg(F.first("fingerprint"))
    found = both.withColumn("like", wf.likeness("0", "1")).groupBy("k").agg(F.avg("like").alias("like")).collect()
    for r in found:
        assert r.like == pytest.approx(similarity(*pairs[r.k]), abs=0.035)  # 2880 samples


def test_long_text_in_pieces(spark):
    text = ("word é " * 30_000) + "x" * 70_000 + " tail\n" * 40_000
    docs = spark.createDataFrame([(1, text), (2, "word é tail")], "doc_id bigint, text string")
    got = {r.id: r.fingerprint for r in wf.edited_fingerprints(docs).collect()}
    assert got == {1: slow_fingerprint(text), 2: slow_fingerprint("word é tail")}


def test_single_and_empty(spark):
    assert wf.edited_fingerprints(empty_docs(spark)).count() == 0
    one = wf.edited_fingerprints(spark.createDataFrame([(9, "ab cd")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_native(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = wf.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1
