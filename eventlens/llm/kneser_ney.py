"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are words between ASCII white space (A-Z lower-cased), and a boundary
that ends every text and stands before its first word. The model has two or
three orders (``order``): a token after the two before it, after the one before
it, and alone. The highest order counts occurrences; a lower one counts the distinct
tokens found before its gram, except that grams that start a text, which have
none, count occurrences. Each order has three discounts from its counts of
counts; what they free in a context is spread over the order below, and the
lowest interpolates with a uniform base of the trusted tokens and one unknown.

Blocks of texts send their distinct grams, packed, to the shard of the middle
word. There the sums of both orders with context are whole; what a word has
alone is summed in the word's own shard and goes back to the shards that asked.
The logarithm of a probability is then a sum over the grams that end at a
token: a word has its probability alone and what its context frees, a seen gram
of two or three words corrects that and adds what it frees as a context, an
unseen one adds nothing. Texts send their words to the words' shards and the distinct grams
they hold to the shard of the middle word, where those grams' sums of all orders
are, and get sums of logarithms back. Words, pairs and contexts whose bit in a
filter of the model's keys (hashes of 64 bits) is clear are left out. Words and
pairs that trusted text has most often, at most ``HOT_WORDS`` and ``HOT_PAIRS``, are
looked up where the text is, in a table that goes to all tasks; all others are
sent. A shard is copied by its part of the trusted tokens, so that one task answers
what an even sixteenth of ``SCAN_TASKS`` tasks of the scan would send, and at most ``UNEVEN`` of that more.

The model is fitted on the whole texts of all trusted rows outside the held-out
fifth. They are picked out of the scan by two bit filters of fixed size, and by a
join of the few rows that these leave in doubt. The number of shards follows
``spark.sql.shuffle.partitions``. The driver gets counts of counts, a number for each
shard, the frequent words and pairs, and the filter, at most ``FILTER_BITS`` bits;
with more grams than it suits, more are sent in vain and the results are the same.

Trusted rows with crc32(id) mod 5 = 0 are left out of training. Their
perplexities give, for each language, the quantile above which documents are
rejected; a language without such rows takes the quantile over all. If there
are none at all the threshold is null and everything is kept.

Null and empty texts consist of their end, and are judged like others; a null
language is a group of its own. Ties with the threshold are kept. Repeated rows
get equal results, extra columns are ignored. Without trusted rows every token
is the unknown one, at probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import array_sums, give_back, prepare, remainder, shuffle_width, stored
from eventlens.llm.exact_dedup import bit_filter, in_filter
from eventlens.llm.shards import Block, find_tokens, narrow, pack, text_blocks, unpack, word_hashes

#: Part of held-out trusted documents that the threshold keeps.
QUANTILE = 0.98
#: Bits of the filter over trusted ids.
ID_BITS = 1 << 24
#: Tokens of the longest grams, 2 or 3.
ORDER = 2
#: Bits of the filter for each gram, and most bits in all (32 MB).
BITS_A_GRAM, FILTER_BITS = 32, 1 << 28
#: Characters of the texts that are scored together: more of them share the words of a message.
SCORE_CHARS = 14_000_000
#: Least shards of the model, and pages of its filter; tasks of the scan that a sixteenth of the messages may be from.
SHARDS, SCAN_TASKS = 16, 32
#: Part by which a task's share of them may be larger before its shard is copied once more.
UNEVEN = 0.25
#: Shuffle partitions for each shard of the model.
SHARD_PARTITIONS = 4
#: Words and pairs looked up where the text is.
HOT_WORDS, HOT_PAIRS = 1 << 16, 1 << 17
#: Tokens whose keys are looked up at a time where the text is.
LOOKED_UP = 1 << 18
#: Grams of one shard that are merged at a time.
MERGE_GRAMS = 4_000_000
BOUNDARY = np.uint64(0)
#: Words are told apart by 46 bits of their hash, bits 0 and 1 being fixed: among a million, two are alike once in 140 models.
WORD_BITS = np.uint64((1 << 48) - 2)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the grams ``a b``, which are odd; keys of words are even."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93))
    for step in (32, 29, 32):
        x = (x ^ (x >> np.uint64(step))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def as_context(pairs: np.ndarray) -> np.ndarray:
    """Keys of pairs as contexts, which are in the shard of their second word, unlike the pairs themselves."""
    return mix(pairs, np.full(pairs.size, 1, np.uint64))


def model_shards(spark: SparkSession) -> int:
    """A multiple of the filter's pages, so that all of a shard's keys are on one."""
    return SHARDS * -(-shuffle_width(spark) // (SHARDS * SHARD_PARTITIONS))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Numbers as narrow as they go, first all their low bytes, which packs best."""
    values = narrow(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.copy()


def from_planes(held: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(held.T).view(f"u{held.shape[0]}").ravel()


def pack_sorted(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Rising keys as steps, then arrays of numbers."""
    return pack(*map(planes, (np.diff(keys, prepend=np.uint64(0)), *arrays)))


def unpack_sorted(data: bytes) -> tuple:
    steps, *arrays = map(from_planes, unpack(data))
    return np.cumsum(steps, dtype=np.uint64), *arrays


def runs(before: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a gram, in order, is the first with its context."""
    first = np.ones(before.size, bool)
    first[1:] = (before[1:] != before[:-1]) | (second[1:] != second[:-1])
    return first


def pack_grams(words: np.ndarray, second: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Rising words, and merged grams of their numbers with counts: middle words, and last words after one context, as steps."""
    steps = np.where(runs(before, second), word, np.diff(word, prepend=0))
    return pack_sorted(words, second, np.diff(before, prepend=0), steps, n)


def unpack_grams(data: bytes) -> tuple:
    words, second, before, steps, n = unpack_sorted(data)
    before, word = np.cumsum(before, dtype=np.int64), np.cumsum(steps, dtype=np.int64)
    at = np.flatnonzero(runs(before, second))
    word -= np.repeat(word[at] - steps[at].astype(np.int64), np.diff(np.append(at, word.size)))
    return words, second, before, word, n


@dataclass
class Tokens:
    """A block's tokens in order: numbers of a word, of the two before it, and of its text."""

    hashed: np.ndarray  #: even hash of each word, the boundary last
    word: np.ndarray
    before: np.ndarray
    second: np.ndarray  #: two before; the boundary again for the first word of a text, and for all in a model of order 2
    first: np.ndarray
    text: np.ndarray


def tokens_of(block: Block, order: int) -> Tokens:
    hashed = np.append(word_hashes(block) & WORD_BITS | np.uint64(2), BOUNDARY)
    lengths = np.array([t.size for t in block.tokens], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    edge = hashed.size - 1
    word = np.full(int(lengths.sum()) + lengths.size, edge, np.int32)
    inner = np.ones(word.size, bool)
    inner[ends] = False
    word[inner] = np.concatenate([*block.tokens, np.zeros(0, np.int32)])
    first = np.zeros(word.size, bool)
    first[ends - lengths] = True
    before = np.append(np.int32(edge), word[:-1])  # a text's last token is the boundary, so the next one starts after it
    second = np.where(first | (order < 3), np.int32(edge), np.append(np.int32(edge), before[:-1]))
    return Tokens(hashed, word, before, second, first, np.repeat(np.arange(lengths.size, dtype=np.int32), lengths + 1))


def merged(second: np.ndarray, before: np.ndarray, word: np.ndarray, size: int, n: np.ndarray | None = None) -> tuple:
    """Distinct grams of three as numbers below ``size``, by the middle word, and how often each occurs."""
    context, context_of = np.unique(before.astype(np.int64) * size + second, return_inverse=True)
    gram, gram_of = np.unique(context_of * size + word, return_inverse=True)
    own = context[gram // size]
    return own % size, own // size, gram % size, np.bincount(gram_of, n, gram.size).astype(np.int64)


class Shard:
    """Grams whose middle word falls into one shard, and the orders that end in them.

    A gram after the boundary is the start of a text: a gram of two, as all are
    in a model of order 2.
    """

    def __init__(self, data: bytes, order: int):
        self.words, second, self.before, self.word, self.n = unpack_grams(data)
        self.second = second.astype(np.int64)
        size = self.words.size
        start = (self.words[self.before] == BOUNDARY) | (order < 3)
        self.pair, self.pair_of = np.unique(self.before * size + self.word, return_inverse=True)
        self.n2 = np.bincount(self.pair_of, np.where(start, self.n, 1), self.pair.size).astype(np.int64)
        self.three = np.flatnonzero(~start)
        self.n3 = self.n[self.three]
        self.context, self.context_of = np.unique(self.before[self.three] * size + self.second[self.three], return_inverse=True)
        self.triple = self.context_of * size + self.word[self.three]  # rises, as the grams do

    def stats(self) -> list[float]:
        return [float((n == k).sum()) for n in (self.n2, self.n3) for k in (1, 2, 3, 4)]

    def alone(self) -> tuple[np.ndarray, np.ndarray]:
        """Words, and before how many of them each word of the shard's pairs was found."""
        count = np.bincount(self.pair % self.words.size, minlength=self.words.size)
        return self.words[count > 0], count[count > 0]

    def keys(self) -> np.ndarray:
        """Keys of the pairs, and of the contexts of two words."""
        size = self.words.size
        two = mix(self.words[self.context % size], self.words[self.context // size])
        return np.concatenate([mix(self.words[self.pair // size], self.words[self.pair % size]), as_context(two)])

    def smooth(self, p1: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets what pairs, contexts of two words and grams of three add; returns the contexts of one word, and what they add.

        ``p1`` is by word, ``two`` and ``three`` are the discounts of those orders.
        """
        size = self.words.size
        before = self.pair // size
        p2, freed2, total = smoothed(self.n2, two, before, size, p1[self.pair % size])
        below = p2[self.pair_of[self.three]]
        p3, freed3, _ = smoothed(self.n3, three, self.context_of, self.context.size, below)
        self.adds2 = np.log10(p2 / (freed2[before] * p1[self.pair % size]))
        self.frees3 = np.log10(freed3)
        self.adds3 = np.log10(p3 / (freed3[self.context_of] * below))
        return self.words[total > 0], np.log10(freed2[total > 0])

    def log10(self, words: np.ndarray, second: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What grams of numbered ``words`` add to what their last words have alone."""
        size = self.words.size
        second, before, word = (find_tokens(self.words, words)[x.astype(np.int64)] for x in (second, before, word))
        pair = np.where((before >= 0) & (word >= 0), find_tokens(self.pair, before * size + word), -1)
        context = np.where((before >= 0) & (second >= 0), find_tokens(self.context, before * size + second), -1)
        triple = np.where((pair >= 0) & (context >= 0), find_tokens(self.triple, context * size + word), -1)
        return sum(np.where(at >= 0, np.append(own, 0.0)[at], 0.0) for at, own in ((pair, self.adds2), (context, self.frees3), (triple, self.adds3)))


def smoothed(n: np.ndarray, discount: np.ndarray, context: np.ndarray, contexts: int, below: np.ndarray) -> tuple:
    """Probabilities of an order's grams, what each context frees, and the sum of its counts."""
    cut = discount[np.minimum(n, 3) - 1]
    total = np.bincount(context, n, contexts)
    freed = np.bincount(context, cut, contexts) / np.maximum(total, 1)
    return (n - cut) / total[context] + freed[context] * below, freed, total


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Of counts 1, 2 and more; where counts of counts are missing, within 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    own = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(own, 0.05, [0.95, 1.95, 2.95])


@dataclass
class Orders:
    """What all shards share: discounts of the orders, the sum of the lowest one's counts, and an unknown word's probability."""

    order: int
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    total: float
    unknown: float
    load: np.ndarray  #: part of the trusted tokens after words of each shard

    def alone(self, count: np.ndarray) -> np.ndarray:
        return (count - self.one[np.minimum(count.astype(np.int64), 3) - 1]) / self.total + self.unknown

    def model(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[Shard]]:
        """Words of one shard, rising, what they add, and the shard's grams."""
        parts, shards = [(np.zeros(0, np.uint64), np.zeros(0))], [Shard(x, self.order) for x in rows.grams.dropna()]
        for words, count in map(unpack_sorted, rows.own.dropna()):
            parts.append((words, np.log10(self.alone(count))))
        for shard in shards:
            p1 = np.zeros(shard.words.size)
            for words, count in map(unpack_sorted, rows.asked.dropna()):
                p1[np.searchsorted(shard.words, words)] = self.alone(count)
            parts.append(shard.smooth(p1, self.two, self.three))
        words, word_of = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(word_of, np.concatenate([v for _, v in parts]), words.size), shards


def fit(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, Orders]:
    """The model of each shard: its grams, what it asked for of words alone, and of its own words alone."""
    shards = model_shards(trusted.sparkSession)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in text_blocks(batches):
            t = tokens_of(block, order)
            second, before, word, n = merged(t.second, t.before, t.word, t.hashed.size)
            to = shard_of(t.hashed, shards)[before]
            by_shard = np.argsort(to, kind="stable")
            rows = []
            for own in np.split(by_shard, np.flatnonzero(np.diff(to[by_shard])) + 1):
                rows.append((to[own[0]], _held(t.hashed[second[own]], t.hashed[before[own]], t.hashed[word[own]], n[own])))
            yield pd.DataFrame(rows, columns=["shard", "grams"])
        give_back()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, parts, size = b"", [], 0
        for i, data in enumerate(pdf.grams, 1):
            parts.append(unpack_grams(data))
            size += parts[-1][-1].size
            if size >= MERGE_GRAMS or i == len(pdf):
                held = _joined(parts)
                parts, size = [], 0
                if i < len(pdf):
                    parts = [unpack_grams(held)]
                    size = parts[0][-1].size
        own = Shard(held, order)
        rows = pd.DataFrame({"shard": [key[0]], "grams": [held], "stats": [own.stats()], "tokens": [int(own.n.sum())]})
        del own, parts
        give_back()
        return rows

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asking, data in zip(pdf.shard, pdf.grams, strict=True):
                words, count = Shard(data, order).alone()
                to = shard_of(words, shards)
                rows = [(s, asking, pack_sorted(words[to == s], count[to == s])) for s in np.unique(to)]
                yield pd.DataFrame(rows, columns=["own", "asking", "words"])

    def reply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(x) for x in pdf.words]
        words, word_of = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        count = np.bincount(word_of, np.concatenate([n for _, n in parts]), words.size).astype(np.int64)
        stats = [float(count.sum()), float(words.size), *(float((count == k).sum()) for k in (1, 2, 3, 4))]
        rows = [(key[0], None, pack_sorted(words, count), stats)]
        rows += [(a, pack_sorted(w, count[np.searchsorted(words, w)]), None, None) for a, (w, _) in zip(pdf.asking, parts, strict=True)]
        return pd.DataFrame(rows, columns=["shard", "asked", "own", "stats"])

    texts = trusted.select(F.lit(None).cast("int").alias("id"), "text")
    sent = texts.mapInPandas(send, "shard int, grams binary").groupBy("shard")
    held = stored(sent.applyInPandas(merge, "shard int, grams binary, stats array<double>, tokens bigint"), "trusted-grams")
    asked = held.select("shard", "grams").mapInPandas(ask, "own int, asking int, words binary").groupBy("own")
    alone = stored(asked.applyInPandas(reply, "shard int, asked binary, own binary, stats array<double>"), "trusted-words")

    two, three = (discounts(*x) for x in array_sums(held, "stats", 8).reshape(2, 4))
    total, kinds, *ones = array_sums(alone.filter("own IS NOT NULL"), "stats", 6)
    one = discounts(*ones)
    cut = one @ np.array([ones[0], ones[1], kinds - ones[0] - ones[1]])
    unknown = (cut / total if total else 1.0) / (kinds + 1)
    load = np.zeros(shards)
    for row in held.select("shard", "tokens").collect():  # one a shard
        load[row["shard"]] = row["tokens"]
    load /= max(load.sum(), 1.0)

    none = F.lit(None).cast("binary")
    grams = held.select("shard", "grams", none.alias("asked"), none.alias("own"))
    model = grams.unionByName(alone.select("shard", none.alias("grams"), "asked", "own"))
    return model, Orders(order, one, two, three, total, unknown, load)


def _held(second: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Grams of hashes with their counts, merged and packed."""
    words, number = np.unique(np.concatenate([second, before, word]), return_inverse=True)
    *own, n = merged(*number.reshape(3, -1), words.size, n)
    return pack_grams(words, *own, n)


def _joined(parts: list[tuple]) -> bytes:
    """Unpacked grams of several parts, merged and packed."""
    words = np.unique(np.concatenate([own for own, *_ in parts]))
    place = [np.searchsorted(words, own).astype(np.int32) for own, *_ in parts]
    grams = [np.concatenate([of[part[k]] for of, part in zip(place, parts, strict=True)]) for k in (1, 2, 3)]
    n = np.concatenate([part[4] for part in parts])
    parts.clear()  # their memory is needed
    *own, n = merged(*grams, words.size, n)
    return pack_grams(words, *own, n)


def key_filter(model: DataFrame, order: int) -> np.ndarray:
    """Bits for the keys, in bytes, a page for the shards alike modulo ``SHARDS``; they follow the counted keys up to ``FILTER_BITS``."""
    pages, bits = SHARDS, 64

    def keys_of(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        for shard, grams, own in zip(pdf["shard"], pdf.grams, pdf.own, strict=True):
            if grams is not None:
                yield shard, Shard(grams, order).keys()
            elif own is not None:
                yield shard, unpack_sorted(own)[0]

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"size": [keys.size for _, keys in keys_of(pdf)]}, dtype="int64")

    held = model.filter("grams IS NOT NULL OR own IS NOT NULL").select("shard", "grams", "own")
    keys = held.mapInPandas(sizes, "size bigint").agg(F.sum("size")).first()[0] or 0
    while bits * pages < keys * BITS_A_GRAM and bits * pages * 2 <= FILTER_BITS:
        bits *= 2

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(shard % pages, pack(narrow(np.diff(np.unique(_place(keys, bits)), prepend=0)))) for shard, keys in keys_of(pdf)]
            yield pd.DataFrame(rows, columns=["page", "places"])
        give_back()

    def page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(bits, bool)
        for data in pdf.places:
            own[np.cumsum(unpack(data)[0], dtype=np.int64)] = True
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    placed = held.mapInPandas(places, "page int, places binary").groupBy("page")
    found = np.zeros((pages, bits // 8), np.uint8)
    for row in placed.applyInPandas(page, "page int, bits binary").collect():  # at most FILTER_BITS
        found[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return found


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(found: np.ndarray, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
    at = _place(keys, found.shape[1] * 8)
    return (found[shards % found.shape[0], at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Hot:
    """Frequent words, rising, and pairs of them (number of the first times the words, and of the second); what each adds."""

    words: np.ndarray
    values: np.ndarray
    pairs: np.ndarray
    adds: np.ndarray


def frequent(model: DataFrame, orders: Orders) -> Hot:
    """Each shard's part of ``HOT_WORDS`` words and, in a model of order 2, ``HOT_PAIRS`` pairs, the most frequent it has."""
    words_each = -(-HOT_WORDS // orders.load.size)

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, data in zip(pdf["shard"], pdf.grams, strict=True):
                own = Shard(data, orders.order)
                size = own.words.size
                before, word = own.pair // size, own.pair % size
                share, freed, total = smoothed(own.n2, orders.two, before, size, np.zeros(before.size))
                words = np.argsort(-total, kind="stable")[: min(words_each, int((total > 0).sum()))]
                most = np.argsort(-own.n2, kind="stable")[: int(HOT_PAIRS * orders.load[shard]) if orders.order < 3 else 0]
                pairs = own.words[np.stack([before[most], word[most]], axis=1)]
                yield pd.DataFrame({"hot": [pack(own.words[words], freed[words], pairs, share[most], freed[before[most]])]})
        give_back()

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, count in map(unpack_sorted, pdf.own):
                at = find_tokens(own, words)
                yield pd.DataFrame({"hot": [pack(np.flatnonzero(at >= 0), count[at[at >= 0]])]})
        give_back()

    tops = model.filter("grams IS NOT NULL").select("shard", "grams").mapInPandas(top, "hot binary").collect()  # the bounded table
    parts = [unpack(row["hot"]) for row in tops] or [(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 2), np.uint64), np.zeros(0), np.zeros(0))]
    words, freed, found, share, freed_before = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_word = np.argsort(words)
    words, freed = words[by_word], freed[by_word]
    p1 = np.ones(words.size)
    for row in model.filter("own IS NOT NULL").select("own").mapInPandas(alone, "hot binary").collect():
        at, count = unpack(row["hot"])
        p1[at] = orders.alone(count)
    first, second = (find_tokens(words, x) for x in found.T)
    held = (first >= 0) & (second >= 0)
    first, second, share, rest = first[held], second[held], share[held], freed_before[held]
    pairs = first * words.size + second
    by_pair = np.argsort(pairs)
    rest = rest * p1[second]
    return Hot(words, np.log10(p1 * freed), pairs[by_pair], np.log10((share + rest) / rest)[by_pair])


NONE = np.uint64(1)


def _messages(block: Block, bits: np.ndarray, hot: Hot, shards: int, order: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Of each text of the block, whose words go: words that the model can't know, and the sum of what frequent words and pairs add; for each shard the other
    words and grams it may know, with texts and counts."""
    t, texts = tokens_of(block, order), len(block.tokens)
    block.number, block.tokens = {}, []  # their memory is needed
    hashed = np.append(t.hashed, NONE)  # stands for what the model can't know
    home = shard_of(hashed, shards)
    by_shard = np.lexsort((hashed, home))
    hashed, home = hashed[by_shard], home[by_shard]
    size = hashed.size
    number = np.empty(size, np.int32)
    number[by_shard] = np.arange(size, dtype=np.int32)
    none, known = number[-1], may_hold(bits, hashed, home)
    word, before, second, text, inner = number[t.word], number[t.before], number[t.second], t.text, ~t.first
    del t
    unknown = np.bincount(text[~known[word]], minlength=texts)
    edges = np.searchsorted(home, np.arange(shards + 1))

    at_hot = find_tokens(hot.words, hashed)
    sums = np.bincount(text, np.append(hot.values, 0.0)[at_hot][word], texts)
    at = (known & (at_hot < 0))[word]
    entry, count = np.unique(word[at].astype(np.int64) * texts + text[at], return_counts=True)
    own, first = np.unique(entry // texts, return_index=True)
    alone = (own, np.append(first, entry.size), entry, count)

    seen, after = np.zeros(word.size, bool), np.zeros(word.size, bool)
    found = np.full(word.size, -1, np.int32)  # place among the frequent pairs
    for start in range(0, word.size, LOOKED_UP):  # the keys of few tokens are held at a time
        some = slice(start, start + LOOKED_UP)
        w, b = word[some], before[some]
        seen[some] = may_hold(bits, mix(hashed[b], hashed[w]), home[b]) & known[w]
        if hot.pairs.size:
            one, two = at_hot[b], at_hot[w]
            found[some] = find_tokens(hot.pairs, np.where((one >= 0) & (two >= 0), one * hot.words.size + two, -1))
        if order > 2:
            after[some] = may_hold(bits, as_context(mix(hashed[second[some]], hashed[b])), home[b]) & inner[some]
    if hot.pairs.size:
        sums += np.bincount(text, np.append(hot.adds, 0.0)[found], texts)
        seen &= found < 0
    at = np.flatnonzero((seen | after) & known[before])
    word, second = np.where(seen[at], word[at], none).astype(np.int64), np.where(after[at], second[at], none)
    before, text = before[at].astype(np.int64), text[at]
    del seen, after, found, inner, at
    two, two_of = np.unique(before * size + second, return_inverse=True)
    three, three_of = np.unique(two_of * size + word, return_inverse=True)
    entry, count = np.unique(three_of * texts + text, return_counts=True)
    first = np.searchsorted(entry, np.arange(three.size + 1) * texts)
    two_of_gram = two[three // size]
    before, second, word = two_of_gram // size, two_of_gram % size, three % size

    made: list[bytes | None] = []
    for s in range(shards):
        a, b = np.searchsorted(alone[0], edges[s : s + 2])
        c, d = np.searchsorted(before, edges[s : s + 2])
        if a == b and c == d:
            made.append(None)
            continue
        words = (pack_sorted(hashed[alone[0][a:b]]), *_uses(*alone[1:], a, b, texts))
        held, place = np.unique(hashed[np.concatenate([second[c:d], before[c:d], word[c:d]])], return_inverse=True)
        made.append(pack(words, (pack_sorted(held, *place.reshape(3, -1)), *_uses(first, entry, count, c, d, texts)), texts, level=3))
    return unknown, sums, made


def _uses(first: np.ndarray, entry: np.ndarray, count: np.ndarray, a: int, b: int, texts: int) -> tuple:
    """Number of texts of each of the things ``a`` to ``b``, steps between those texts, and how often each has it."""
    own = slice(first[a], first[b])
    steps = np.diff(entry[own] % max(texts, 1), prepend=0) % max(texts, 1)
    return planes(np.diff(first[a : b + 1])), planes(steps), planes(count[own])


def perplexities(docs: DataFrame, trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id, n_tokens, perplexity`` of each row of ``docs`` (id, text) under the model of ``trusted`` (text)."""
    spark = prepare(docs.sparkSession)
    model, orders = fit(trusted.select(F.col(text_col).alias("text")), order)
    bits = spark.sparkContext.broadcast(pack(key_filter(model, order)))  # executors keep it on disk too
    hot = spark.sparkContext.broadcast(frequent(model, orders))
    id_type = docs.schema["id"].dataType.simpleString()
    # Ids travel as text: pandas makes floats of a column of numbers and nulls, inside structs too.
    texts = docs.select(F.to_json(F.struct("id")).alias("id"), F.col(text_col).alias("text"))
    salts = np.maximum(1, np.ceil(orders.load * texts.rdd.getNumPartitions() * SHARDS / SCAN_TASKS - UNEVEN)).astype(int).tolist()
    shards = len(salts)

    unknown = float(np.log10(orders.unknown))
    models = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(F.lit(salts), F.col("shard")) - 1)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        columns = ["shard", "salt", "block", "message", "ids", "n_tokens", "total"]
        (own_bits,) = unpack(bits.value)
        for i, block in enumerate(text_blocks(batches, SCORE_CHARS)):
            lengths = [t.size + 1 for t in block.tokens]
            missed, sums, made = _messages(block, own_bits, hot.value, shards, order)
            give_back()
            head = (0, task % salts[0], task << 32 | i, None, block.ids, lengths, (missed * unknown + sums).tolist())
            rows = [(s, task % salts[s], task << 32 | i, m, None, None, None) for s, m in enumerate(made) if m is not None]
            yield pd.DataFrame([head, *rows], columns=columns)
        give_back()

    def answer(key: tuple, messages: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known, value, grams = orders.model(held)
        answers = []
        for data in messages.message:
            if data is None:
                answers.append(None)
                continue
            (packed, *own_uses), (packed_grams, *gram_uses), texts = unpack(data)
            at = find_tokens(known, unpack_sorted(packed)[0])
            alone = np.where(at >= 0, np.append(value, 0.0)[at], unknown)
            words, *numbers = unpack_sorted(packed_grams)
            more = grams[0].log10(words, *numbers) if grams else np.zeros(numbers[0].size)
            own_uses, gram_uses = ([from_planes(x) for x in uses] for uses in (own_uses, gram_uses))
            own_uses[1], gram_uses[1] = (np.cumsum(steps, dtype=np.int64) % texts for steps in (own_uses[1], gram_uses[1]))
            uses, text, count = (np.concatenate([x.astype(np.int64) for x in pair]) for pair in zip(own_uses, gram_uses, strict=True))
            found, place = np.unique(text, return_inverse=True)
            sums = np.bincount(place, np.repeat(np.concatenate([alone, more]), uses) * count, found.size)
            answers.append(pack(narrow(found), sums))
        del known, value, grams
        give_back()
        return pd.DataFrame({**{c: messages[c] for c in ("block", "ids", "n_tokens", "total")}, "answer": answers})

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf.ids.notna()].iloc[0]
        total = np.array(head.total, float)
        for data in pdf.answer:
            if data is not None:
                found, sums = unpack(data)
                total[found] += sums
        n = np.array(head.n_tokens)
        return pd.DataFrame({"id": list(head.ids), "n_tokens": n, "perplexity": 10 ** (-total / n)})

    sent = "shard int, salt int, block bigint, message binary, ids array<string>, n_tokens array<bigint>, total array<double>"
    answers = (
        texts.mapInPandas(send, sent).groupBy("shard", "salt")
        .cogroup(models.groupBy("shard", "salt"))
        .applyInPandas(answer, "block bigint, ids array<string>, n_tokens array<bigint>, total array<double>, answer binary")
    )
    rows = answers.groupBy("block").applyInPandas(gather, "id string, n_tokens bigint, perplexity double")
    return rows.select(F.from_json("id", f"id {id_type}")["id"].alias("id"), "n_tokens", "perplexity")


def rows_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is among the distinct ``ids``; texts are shuffled where two filters of fixed size leave doubt."""
    if ids.schema["id"].dataType != texts.schema["id"].dataType:  # equal ids may have unlike hashes
        return texts.join(ids, "id", "left_semi")
    first, second = (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(ID_BITS)) for i in (0, 1))
    near = in_filter(stored(bit_filter(ids.select(first.alias("bit")), ID_BITS), "id-filter"), first)
    # What passes without being an id sets the second filter: what passes the first and not that one is an id.
    false = texts.filter(near).select("id").join(ids, "id", "left_anti")
    doubt = in_filter(stored(bit_filter(false.select(second.alias("bit")), ID_BITS), "id-doubts"), second)
    return texts.filter(near & ~doubt).unionByName(texts.filter(near & doubt).join(ids, "id", "left_semi").select(*texts.columns))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    order: int = ORDER,
) -> DataFrame:
    """``id, lang, n_tokens, perplexity, threshold, kept`` for each row of ``docs``.

    ``labels`` (id_col, quality, toxic) names the trusted documents: quality 1 and not toxic.
    """
    spark = prepare(docs.sparkSession)
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    learned = good.filter(remainder("id", 5) != 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trusted = rows_of(texts, learned)
    named = texts.select(F.struct("id", "lang").alias("id"), "text")
    scored = stored(perplexities(named, trusted, order=order).select("id.id", "id.lang", "n_tokens", "perplexity"), "perplexities")
    held = scored.filter(remainder("id", 5) == 0).join(good, "id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000).alias("cut")
    by_lang = stored(held.groupBy("lang").agg(cut), "quality-cuts")
    overall = stored(held.agg(cut), "quality-cut")
    threshold = F.coalesce("cut", overall.select("cut").scalar())
    joined = scored.alias("s").join(by_lang.alias("c"), F.col("s.lang").eqNullSafe(F.col("c.lang")), "left")
    return joined.select(
        "s.id", "s.lang", "n_tokens", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"),
    )
