import numpy as np
from pyspark.sql import functions as F

from eventlens.llm import langid
from eventlens.llm.langid import (
    PAD, _back_through_time, _new_network, _softmax, _steps, drop_unidentified, fit_language_model, language_column, score_floor,
    pooled, positions, train, training_rows, windows_of,
)
from tests.llm.data import SMALL, empty_docs, odd_docs


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    net = _new_network(["a", "b"], rng, 4)
    for p in net.parameters():
        p[...] = p * 0.5
    d = net.forward
    d.inputs, d.gates, d.candidate, d.out = (x.astype(np.float64) for x in d.parameters())
    symbols = rng.integers(0, 5, (6, 3))
    labels = np.array([0, 1, 0])

    def loss(saved=None):
        states = [s[0] for s in _steps(d, symbols, True)]
        p = _softmax(np.stack([d.out @ h for h in states]).astype(np.float64))
        return -np.log(p[:, labels, np.arange(3)]).sum()

    saved = list(_steps(d, symbols, True))
    error = _softmax(np.stack([d.out @ s[0] for s in saved]).astype(np.float64))
    error[:, labels, np.arange(3)] -= 1
    for parameter, grad in zip(d.parameters(), _back_through_time(d, symbols, saved, error), strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in parameter.shape)
            if parameter is d.inputs:
                at = (at[0], int(symbols[0, 0]))
            old = parameter[at]
            parameter[at] = old + 1e-3
            up = loss()
            parameter[at] = old - 1e-3
            down = loss()
            parameter[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_every_position_has_probabilities_and_pooling_is_their_mean():
    rng = np.random.default_rng(1)
    net = _new_network(["a", "b", "c"], rng, 5)
    text = "héllo wörld " * 30
    windows = windows_of(text.encode())
    p = positions(net, windows)
    real = (windows != PAD).T
    assert p.shape == (langid.WINDOW, 3, len(windows)) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert real.sum() == len(text.encode())
    mean = np.array([p[:, k, :][real].mean() for k in range(3)])
    got, share = pooled(net, ["x", text, ""])
    assert np.allclose(got[1], mean, atol=1e-5) and np.allclose(share[1].sum(), 1) and not got[2].any()


def test_training_separates_two_alphabets():
    rng = np.random.default_rng(2)
    parts = ["".join(rng.choice(list("abcd" if i % 2 else "efgd"), 96)) for i in range(200)]
    net = train(np.concatenate([windows_of(p.encode()) for p in parts]), np.arange(200) % 2, ["x", "y"], steps=20, batch=32)
    got, _ = pooled(net, ["efgefg", "abcabc" * 100])
    assert got.argmax(axis=1).tolist() == [0, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = fit_language_model(training_rows(docs))
    assert net.languages == ["de", "en", "es", "fr"]
    held = docs.filter("crc32(cast(doc_id AS string)) % 5 = 0").withColumn("found", language_column(net, F.col("text")))
    rows = held.select("lang", "found.*").collect()
    right = sum(r[0] == r[1] for r in rows)  # label, prediction
    assert right >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    net = fit_language_model(docs, sample_docs=20)
    rows = docs.select("text", language_column(net, F.col("text")).alias("f")).select("text", "f.*").collect()
    for r in rows:
        assert (r["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["lang"] == "und" or r["lang"] in net.languages
    kept = drop_unidentified(docs, net)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["lang"] != "und" for r in rows)
    floor = score_floor(docs, net)
    assert drop_unidentified(docs, net, min_score=1.1).count() == 0 and 0 <= floor <= 0.5
    stay = [r for r in rows if r["lang"] != "und" and r["score"] >= floor]
    assert drop_unidentified(docs, net, min_score=floor).count() == len(stay)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert drop_unidentified(docs, None).count() == 1 and score_floor(docs, None) == 0.0
    assert fit_language_model(docs) is None and fit_language_model(empty_docs(spark)) is None
    assert docs.select(language_column(None, F.col("text"))["lang"]).first()[0] == "und"
    assert empty_docs(spark).select(language_column(None, F.col("text"))).count() == 0
