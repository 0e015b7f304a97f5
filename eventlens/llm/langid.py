"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes (the last one padded), and two
gated recurrent layers read each window from both ends. Every byte position
gets a probability for each language from both states; the mean over all
positions of the whole text is the document's distribution. Windows begin
with a zero state, so a text of any length needs bounded memory.

The network is trained with backpropagation through time in numpy on the
driver, on a bounded sample: about ``sample_docs`` documents a language,
chosen by a hash of their id, and ``sample_windows`` windows from evenly
spread places of each whole text. It reads bytes only; ids pick the sample and
labels are targets. With no labelled document every result is ``und``.

A null text, or one without a letter, is ``und`` with score 0. Prediction
depends on the text alone, so ties and repeated rows get equal results. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import give_back, prepare, remainder

WINDOW = 96
HIDDEN = 12
PAD = 256
#: Documents of each language and windows of each document that training may read.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 6
STEPS = 300
#: Windows that are read side by side.
LANES = 4096


@dataclass
class Direction:
    """Update gate, reset gate and candidate of one direction, stacked by rows."""

    inputs: np.ndarray  # 3H x 257, one column a symbol
    gates: np.ndarray  # 2H x H
    candidate: np.ndarray  # H x H
    out: np.ndarray  # languages x H

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.out]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.parameters(), *self.backward.parameters(), self.bias]


def _new_network(languages: list[str], rng: np.random.Generator, hidden: int) -> Network:
    def direction() -> Direction:
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        return Direction(draw(3 * hidden, PAD + 1), draw(2 * hidden, hidden), draw(hidden, hidden), draw(len(languages), hidden))

    return Network(languages, direction(), direction(), np.zeros((len(languages), 1), np.float32))


def _steps(d: Direction, symbols: np.ndarray, keep: bool):
    """States after each symbol (rows of ``symbols`` are time steps); with ``keep`` also what training needs."""
    hidden = d.candidate.shape[0]
    h = np.zeros((hidden, symbols.shape[1]), np.float32)
    for row in symbols:
        x = d.inputs[:, row]
        gates = d.gates @ h
        gates += x[: 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:hidden], gates[hidden:]
        c = d.candidate @ (r * h)
        c += x[2 * hidden :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        yield (new, (h, z, r, c)) if keep else new
        h = new


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over axis -2, in place."""
    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def positions(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities, time x languages x windows."""
    symbols = np.ascontiguousarray(windows.T)
    logits = np.empty((symbols.shape[0], len(net.languages), symbols.shape[1]), np.float32)
    for t, h in enumerate(_steps(net.backward, symbols[::-1], False)):
        logits[-1 - t] = net.backward.out @ h
    for t, h in enumerate(_steps(net.forward, symbols, False)):
        logits[t] += net.forward.out @ h
    logits += net.bias
    return _softmax(logits)


def _back_through_time(d: Direction, symbols: np.ndarray, saved: list, error: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction, given the error of the logits by time step."""
    hidden = d.candidate.shape[0]
    g_gates, g_cand, g_out = np.zeros_like(d.gates), np.zeros_like(d.candidate), np.zeros_like(d.out)
    g_x = np.empty((symbols.shape[0], 3 * hidden, symbols.shape[1]), np.float32)
    carry = np.zeros_like(saved[0][0])
    for t in range(symbols.shape[0] - 1, -1, -1):
        new, (h, z, r, c) = saved[t]
        g_out += error[t] @ new.T
        g = d.out.T @ error[t] + carry
        g_c = g * z * (1 - c * c)
        g_z = g * (c - h) * z * (1 - z)
        g_rh = d.candidate.T @ g_c
        g_r = g_rh * h * r * (1 - r)
        both = np.concatenate([g_z, g_r])
        g_cand += g_c @ (r * h).T
        g_gates += both @ h.T
        carry = g * (1 - z) + g_rh * r + d.gates.T @ both
        g_x[t] = np.concatenate([both, g_c])
    flat = g_x.transpose(1, 0, 2).reshape(3 * hidden, -1)
    order = np.argsort(symbols, axis=None, kind="stable")
    seen, starts = np.unique(symbols.ravel()[order], return_index=True)
    g_in = np.zeros_like(d.inputs)
    g_in[:, seen] = np.add.reduceat(flat[:, order], starts, axis=1)
    return [g_in, g_gates, g_cand, g_out]


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = 256,
    rate: float = 0.01, hidden: int = HIDDEN, seed: int = 7,
) -> Network:
    """Adam on the cross entropy of every position that isn't padding, in ``steps`` batches whatever the sample's size."""
    rng = np.random.default_rng(seed)
    net = _new_network(languages, rng, hidden)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    step = 0
    while step < steps:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch)[: steps - step]:
            own = order[at : at + batch]
            symbols = np.ascontiguousarray(windows[own].T)
            ahead = list(_steps(net.forward, symbols, True))
            behind = list(_steps(net.backward, symbols[::-1], True))
            logits = np.stack([net.forward.out @ a[0] + net.backward.out @ b[0] for a, b in zip(ahead, behind[::-1], strict=True)])
            error = _softmax(logits + net.bias)
            error[:, labels[own], np.arange(len(own))] -= 1
            real = symbols != PAD
            error *= real[:, None, :] / max(1, real.sum())
            grads = [
                *_back_through_time(net.forward, symbols, ahead, error),
                *_back_through_time(net.backward, symbols[::-1], behind, error[::-1]),
                error.sum(axis=(0, 2))[:, None],
            ]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            pace = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m in zip(net.parameters(), grads, moment, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= (pace * m[0] / (np.sqrt(m[1]) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def pooled(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean position probabilities of each text, and the share of its positions labelled with each language."""
    n = len(net.languages)
    mean, share = np.zeros((len(texts), n)), np.zeros((len(texts), n))
    waiting: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def read(windows: np.ndarray, owner: np.ndarray) -> None:
        p = positions(net, windows)
        real = (windows != PAD).T
        top = p.argmax(axis=1)
        p *= real[:, None, :]
        np.add.at(mean, owner, p.sum(axis=0).T)
        np.add.at(share, owner, np.stack([((top == k) & real).sum(axis=0) for k in range(n)], axis=1))

    held = 0
    for i, text in enumerate(texts):
        own = windows_of(text.encode())
        waiting.append(own)
        owners.append(np.full(len(own), i))
        held += len(own)
        if held >= LANES or i == len(texts) - 1:
            windows, owner = np.concatenate(waiting), np.concatenate(owners)
            for at in range(0, held, LANES):
                read(windows[at : at + LANES], owner[at : at + LANES])
            waiting, owners, held = [], [], 0
    total = np.maximum(share.sum(axis=1, keepdims=True), 1)
    return mean / total, share / total


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, per_doc: int) -> tuple[np.ndarray, list[str]]:
    """A bounded sample of training windows and their languages, the same for the same rows."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.int16), []
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30))
    bar = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * 1.2 * per_language / n) + 1))])
    size = F.octet_length(text_col)
    picked = usable.filter(draw < bar[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), draw.alias("draw"),
        F.transform(
            F.sequence(F.lit(0), F.lit(per_doc - 1)),
            lambda i: F.substring(F.col(text_col).cast("binary"), (i * F.greatest(F.lit(0), size - WINDOW) / max(1, per_doc - 1)).cast("int") + 1, F.lit(WINDOW)),
        ).alias("parts"),
    )
    rows = picked.orderBy("draw", "lang", "parts").limit(2 * per_language * len(counts)).collect()
    parts = [(bytes(p), r["lang"]) for r in rows for p in dict.fromkeys(bytes(p) for p in r["parts"])]
    return np.concatenate([windows_of(p) for p, _ in parts]), [lang for _, lang in parts]


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, per_doc: int = SAMPLE_WINDOWS,
) -> Network | None:
    """The trained network, or None if no row has a label and a letter."""
    prepare(docs.sparkSession)
    windows, langs = sample_windows(docs, id_col, text_col, lang_col, sample_docs, per_doc)
    if not langs:
        return None
    languages = sorted(set(langs))
    at = {k: i for i, k in enumerate(languages)}
    return train(windows, np.array([at[x] for x in langs]), languages)


def language_column(net: Network | None, text: Column) -> Column:
    """A struct ``lang, score, shares`` for a text column; ``shares``: part of the positions labelled with each language."""
    kind = "struct<lang: string, score: double, shares: map<string, double>>"
    if net is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.expr("cast(map() as map<string, double>)").alias("shares"))

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            mean, share = pooled(net, [t or "" for t in texts])
            best = mean.argmax(axis=1)
            yield pd.DataFrame({
                "lang": [net.languages[i] for i in best],
                "score": np.clip(mean[np.arange(len(best)), best], 0, 1),
                "shares": [dict(zip(net.languages, map(float, s), strict=True)) for s in share],
            })
        give_back()

    found = predict(text)
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.struct(
        F.when(has_letter, found["lang"]).otherwise(F.lit("und")).alias("lang"),
        F.when(has_letter, found["score"]).otherwise(F.lit(0.0)).alias("score"),
        found["shares"].alias("shares"),
    )


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: four of five, by crc32 of the id."""
    return docs.filter(remainder(id_col, 5) != 0)


def score_floor(
    docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> float:
    """Half the lowest score of a labelled document, held out of training, whose language the network names right.

    Over all such documents; 0 if there are none.
    """
    if net is None:
        return 0.0
    held_out = docs.filter((remainder(id_col, 5) == 0) & F.col(lang_col).isNotNull())
    found = held_out.select(F.col(lang_col).alias("label"), language_column(net, F.col(text_col)).alias("found"))
    lowest = found.filter("found.lang = label").agg(F.min("found.score")).first()[0]
    return 0.5 * (lowest or 0.0)


def drop_unidentified(docs: DataFrame, net: Network | None, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The documents whose language is found (not ``und``) with at least ``min_score``, with their own columns.

    Without a network, where nothing could be learned, those with a letter.
    """
    columns = docs.columns
    prepare(docs.sparkSession)
    if net is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    found = language_column(net, F.col(text_col))
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("doc"), found.alias("found"))
    return rows.filter((F.col("found.lang") != "und") & (F.col("found.score") >= min_score)).select("doc.*")
