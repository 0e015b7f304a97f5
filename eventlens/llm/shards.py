"""Counts and look-ups of tokens in context, sharded by the token.

Texts become tokens (words between ASCII white space, A-Z lower-cased, and one
end) in context of the token before. Contexts are classes: ``COARSE`` classes
by the last bytes of the word, each with ``FINE`` classes by its hash, and one
class for the start of a text. Their number is fixed, so whatever is counted
by context alone fits in small arrays, while everything counted by token lives
in the token's shard and grows with the corpus.

A worker gathers its texts into blocks and sends one packed message per block
and shard: the distinct (token, class) pairs, how often each occurs, and in
scoring messages in which texts. A frequent word thus costs a shard at most
one pair for each class in a block, or one entry for each class and text.
"""

from __future__ import annotations

import itertools
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import give_back, shuffle_width

COARSE, FINE = 8, 8
#: Classes of the level nearest the data, the start of a text being the last.
CLASSES = COARSE * FINE + 1
SUFFIX_BYTES = 2
#: Characters of the texts that one block packs.
BLOCK_CHARS = 5_000_000
END = np.uint64(0)


def coarse_of(fine: np.ndarray) -> np.ndarray:
    """Parent class of each class; the start's parent is its own."""
    return fine // FINE


#: Classes of each level, from the data up: fine, coarse, and one without context.
LEVEL_CLASSES = (CLASSES, int(coarse_of(np.array([CLASSES - 1]))[0]) + 1, 1)


def distinct(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a rising array, and the place of each element's among them."""
    new = np.ones(rising.size, bool)
    new[1:] = rising[1:] != rising[:-1]
    return rising[new], np.cumsum(new) - 1


def levels(token_of: np.ndarray, class_of: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Rows of each level, from the data up, in token order: their token, their class, and their row a level up."""
    pair, parent = distinct(token_of * LEVEL_CLASSES[1] + coarse_of(class_of))  # rises, as the rows do
    tokens, above = distinct(pair // LEVEL_CLASSES[1])
    return (
        [token_of, pair // LEVEL_CLASSES[1], tokens],
        [class_of, pair % LEVEL_CLASSES[1], np.zeros(tokens.size, np.int64)],
        [parent, above],
    )


def find_rows(level: int, row_token: np.ndarray, row_class: np.ndarray, token: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Row of each (token, class) at a level, -1 where there is none; unknown tokens are -1."""
    rows = row_token * LEVEL_CLASSES[level] + row_class
    if not rows.size:
        return np.full(token.size, -1)
    wanted = token * LEVEL_CLASSES[level] + class_of
    place = np.minimum(np.searchsorted(rows, wanted), rows.size - 1)
    return np.where((rows[place] == wanted) & (token >= 0), place, -1)


def find_tokens(known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token among the known ones (sorted), -1 for others."""
    if not known.size:
        return np.full(tokens.size, -1)
    at = np.minimum(np.searchsorted(known, tokens), known.size - 1)
    return np.where(known[at] == tokens, at, -1)


def pack(*arrays, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if values.size else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def opened(message: bytes) -> tuple:
    """A packed message, with the token and the class of each pair in place of its code."""
    tokens, steps, *rest = unpack(message)
    code = np.cumsum(steps, dtype=np.int64)
    return tokens, code // CLASSES, code % CLASSES, *rest


class Block:
    """Texts of one worker, to be packed together."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)  # a new word gets the next number
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.chars = 0

    def add(self, key, text: str | None) -> None:
        words = text.encode().lower().split() if text else []
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.ids.append(key)
        self.chars += len(text or "") + 50

    def entries(self, shards: int, by_text: bool) -> Iterator[tuple[int, tuple]]:
        """For each shard (the first always) its tokens and, sorted, their pairs, counts and texts."""
        n = len(self.number)
        hashed = word_hashes(self)
        suffix = np.fromiter((xxhash.xxh32_intdigest(w[-SUFFIX_BYTES:]) for w in self.number), np.int64, n)
        fine = np.append((suffix % COARSE) * FINE + (hashed >> np.uint64(40)).astype(np.int64) % FINE, CLASSES - 1)
        hashed = np.append(hashed, END)
        shard_of = (hashed % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashed, shard_of))  # tokens by shard, then by hash
        place = np.empty(n + 1, np.int64)
        place[order] = np.arange(n + 1)

        lengths = np.array([t.size for t in self.tokens], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        token = np.full(int(lengths.sum()) + lengths.size, n, np.int64)
        inner = np.ones(token.size, bool)
        inner[ends] = False
        token[inner] = np.concatenate([*self.tokens, np.zeros(0, np.int32)])
        context = np.empty_like(token)
        context[1:] = fine[token[:-1]]
        context[ends - lengths] = CLASSES - 1
        key = place[token] * CLASSES + context
        texts = len(self.tokens)
        if by_text:
            key = key * texts + np.repeat(np.arange(texts), lengths + 1)
        key, count = np.unique(key, return_counts=True)
        pair = key // texts if by_text else key
        bounds = np.searchsorted(pair // CLASSES, np.searchsorted(shard_of[order], np.arange(shards + 1)))
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a == b and s:
                continue
            own, first = np.unique(pair[a:b], return_index=True)
            tokens, token_of = np.unique(own // CLASSES, return_inverse=True)
            uses = np.diff(np.append(first, b - a))
            code = token_of * CLASSES + own % CLASSES  # rises, so its steps pack well
            message = [hashed[order[tokens]], narrow(np.diff(code, prepend=0))]
            if by_text:
                message += [narrow(uses), narrow(key[a:b] % texts), narrow(count[a:b])]
            else:
                message += [narrow(count[a:b])]
            yield s, tuple(message)


def word_hashes(block: Block) -> np.ndarray:
    """Hashes of a block's distinct words, in order of their numbers; none is 0."""
    return np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in block.number), np.uint64, len(block.number))


def text_blocks(batches: Iterator[pd.DataFrame], most: int = BLOCK_CHARS) -> Iterator[Block]:
    block = Block()
    for pdf in batches:
        for key, text in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
            block.add(key, text)
            if block.chars >= most:
                yield block
                block = Block()
    if block.ids:
        yield block


def shard_counts(docs: DataFrame, build: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """``shard, model``: what ``build(shard, tokens, token_of, class_of, count)`` makes of the counts of column ``text``."""
    shards = shuffle_width(docs.sparkSession)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in text_blocks(batches):
            rows = [(s, pack(*m)) for s, m in block.entries(shards, False) if m[0].size]
            yield pd.DataFrame(rows, columns=["shard", "message"])
        give_back()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, classes, counts = [], [], []
        for message in pdf.message:
            tokens, token_of, class_of, count = opened(message)
            hashes.append(tokens[token_of])
            classes.append(class_of)
            counts.append(count.astype(np.int64))
        tokens, token_of = np.unique(np.concatenate(hashes), return_inverse=True)
        pair, inverse = np.unique(token_of * CLASSES + np.concatenate(classes), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(counts), pair.size).astype(np.int64)
        model = build(key[0], tokens, pair // CLASSES, pair % CLASSES, count)
        del hashes, classes, counts, tokens, token_of, pair, inverse, count
        give_back()
        return pd.DataFrame({"shard": [key[0]], "model": [model]})

    texts = docs.select(F.lit(None).cast("int").alias("id"), "text")
    return texts.mapInPandas(send, "shard int, message binary").groupBy("shard").applyInPandas(merge, "shard int, model binary")


def score_texts(docs: DataFrame, models: DataFrame, score: Callable[[bytes | None, tuple], np.ndarray], width: int) -> DataFrame:
    """``id, n_tokens, sums`` for each row of ``docs`` (id, text).

    ``score(model, (tokens, token_of, class_of))`` gives ``width`` numbers for
    each (token, class) pair of a message; a text's sums add them over its tokens.
    """
    spark = docs.sparkSession
    shards = shuffle_width(spark)
    id_type = docs.schema["id"].dataType.simpleString()
    # Ids travel as text: pandas makes floats of a column of numbers and nulls, inside structs too.
    texts = docs.select(F.to_json(F.struct("id")).alias("id"), "text")
    sent = "shard int, block bigint, message binary, ids array<string>, n_tokens array<bigint>"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for i, block in enumerate(text_blocks(batches)):
            name = TaskContext.get().partitionId() << 32 | i
            head = block.ids
            lengths = [t.size + 1 for t in block.tokens]
            rows = [(s, name, pack(*m), head if s == 0 else None, lengths if s == 0 else None) for s, m in block.entries(shards, True)]
            yield pd.DataFrame(rows, columns=["shard", "block", "message", "ids", "n_tokens"])
        give_back()

    def answer(key: tuple, messages: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        known = model.model.iloc[0] if len(model) else None
        answers = []
        for data in messages.message:
            tokens, token_of, class_of, uses, text, count = opened(data)
            values = score(known, (tokens, token_of, class_of))
            texts = np.flatnonzero(np.bincount(text))
            pair = np.repeat(np.arange(uses.size), uses.astype(np.int64))
            times = count.astype(np.float64)
            sums = np.stack([np.bincount(text, values[pair, k] * times)[texts] for k in range(width)], axis=1)
            answers.append(pack(narrow(texts), sums))
        give_back()
        return pd.DataFrame({"block": messages.block, "answer": answers, "ids": messages.ids, "n_tokens": messages.n_tokens})

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf.ids.notna()].iloc[0]
        total = np.zeros((len(head.n_tokens), width))
        for data in pdf.answer:
            texts, sums = unpack(data)
            total[texts] += sums
        return pd.DataFrame({"id": list(head.ids), "n_tokens": list(head.n_tokens), "sums": list(total)})

    answers = (
        texts.mapInPandas(send, sent).groupBy("shard")
        .cogroup(models.groupBy("shard"))
        .applyInPandas(answer, "block bigint, answer binary, ids array<string>, n_tokens array<bigint>")
    )
    rows = answers.groupBy("block").applyInPandas(gather, "id string, n_tokens bigint, sums array<double>")
    return rows.select(F.from_json("id", f"id {id_type}")["id"].alias("id"), "n_tokens", "sums")
