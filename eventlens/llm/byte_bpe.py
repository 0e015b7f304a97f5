"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern. Each task numbers the distinct words
of its input as they come, hands every new word on once as an array of bytes,
and then each text as its word numbers; a later step of the same stage puts
texts together again. Nothing is shuffled, no text travels twice, and both
steps forget their words together when these exceed ``TASK_WORDS``.

Spark's higher-order functions fold the ranked merges over every distinct
word. The word's boundaries, one between any two bytes at first, are the bits
of a number. Its merges, the parts of it that the constant rank map lists, are
folded in order of rank: a part whose two ends are boundaries, with a single
boundary inside, loses that one. One pass in this order is the library's
repeated choice of the least rank, because every token of a trained vocabulary
comes from its own bytes by merges of lesser ranks (``single_pass`` checks
it): when a rank's turn comes, a part between two boundaries has merged inside
just as the token alone would have. Decoding concatenates the tokens' bytes.

Words of over ``FOLD_BYTES`` bytes, the bits of the number, are merged in the
worker with a heap instead, with the same result.

Null text counts as empty: no ids. Ids of rows may be null or repeated; each
row is encoded by itself. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import give_back, prepare

FOLD_BYTES = 61
TASK_WORDS = 300_000

_BASE, _ODD = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 22


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; the file has one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankMap:
    """The rank map, arranged to look up every part of many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)  # most parts that are no tokens end here
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for token, rank in ranks.items():
            by_length.setdefault(len(token), []).append((token, rank))
        for length, pairs in by_length.items():
            data = np.frombuffer(b"".join(t for t, _ in pairs), np.uint8).reshape(-1, length)
            value = np.zeros(len(pairs), np.uint64)
            for k in range(length):
                value = value * _BASE + data[:, k] + np.uint64(1)
            order = np.argsort(value)
            self.tables[length] = value[order], np.array([r for _, r in pairs])[order]
            self.sieve[value * _ODD >> np.uint64(64 - _SIEVE_BITS)] = True

    def merges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word (of ``FOLD_BYTES`` at most) its number of merges; of all merges, by word and rank, first byte and length.

        Ranks are below 2^22.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        end_of, word_of = np.repeat(first + sizes, sizes), np.repeat(np.arange(len(words)), sizes)
        at, value = np.arange(data.size), data.astype(np.uint64) + np.uint64(1)
        found = []
        for length in range(2, max(self.tables) + 1):
            inside = at + length <= end_of[at]
            at, value = at[inside], value[inside]
            if not at.size:
                break
            value = value * _BASE + data[at + length - 1] + np.uint64(1)
            if length not in self.tables:
                continue
            known, ranks = self.tables[length]
            maybe = np.flatnonzero(self.sieve[value * _ODD >> np.uint64(64 - _SIEVE_BITS)])
            place = np.minimum(np.searchsorted(known, value[maybe]), known.size - 1)
            hit = known[place] == value[maybe]
            starts = at[maybe[hit]]
            word = word_of[starts]
            # Word, rank, first byte and length in one number, so that sorting it sorts them all.
            found.append(word << 38 | ranks[place[hit]] << 16 | (starts - first[word]) << 8 | length)
        keys = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        return np.bincount(keys >> 38, minlength=len(words)), keys >> 8 & 0xFF, keys & 0xFF


_maps: list[tuple[dict, RankMap]] = []


def _rank_map(ranks: dict[bytes, int]) -> RankMap:
    """The rank map of a worker's last ranks, made once."""
    if not _maps or _maps[0][0] is not ranks:
        _maps[:] = [(ranks, RankMap(ranks))]
    return _maps[0][1]


def fold_merges(merges: Column, bounds: Column) -> Column:
    """Boundaries left when the merges, in order of rank, are folded over the boundaries of all bytes."""

    def step(state: Column, merge: Column) -> Column:
        # Bits of the part that differ from its two ends: one, if it is a single boundary inside.
        odd = state.bitwiseAND(merge["span"]).bitwiseXOR(merge["ends"])
        return F.when(F.bit_count(odd) == 1, state.bitwiseAND(F.bitwise_not(odd))).otherwise(state)

    return F.aggregate(merges, bounds, step)


def parts(word: bytes, bounds: int) -> list[bytes]:
    """The word cut at its boundaries."""
    out, start = [], 0
    bounds &= bounds - 1  # without the one before the first byte
    while bounds:
        end = (bounds & -bounds).bit_length() - 1
        out.append(word[start:end])
        start = end
        bounds &= bounds - 1
    return out


def single_pass(ranks: dict[bytes, int]) -> bool:
    """Whether each token comes from its own bytes by one pass over its merges in order of rank."""
    words = [t for t in ranks if 1 < len(t) <= FOLD_BYTES]
    counts, first, length = RankMap(ranks).merges(words)
    at, state = np.cumsum(counts) - counts, np.array([(1 << (len(w) + 1)) - 1 for w in words], np.int64)
    one = np.int64(1)
    ends = one << first | one << (first + length)
    span = (one << (first + length + 1)) - (one << first)
    for k in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > k)
        odd = (state[own] & span[at[own] + k]) ^ ends[at[own] + k]
        state[own] = np.where(np.bitwise_count(odd) == 1, state[own] & ~odd, state[own])
    return all(f"{b:b}".count("1") == 2 for b in state.tolist())


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over linked parts."""
    parts = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[p + q], i, p + q) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, token = heapq.heappop(heap)
        j = after[i] if parts[i] else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != token:
            continue  # one of the two has gone into another token
        parts[i], parts[j], after[i] = token, b"", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (pair := parts[a] + parts[b]) in ranks:
                heapq.heappush(heap, (ranks[pair], a, pair))
    return [ranks[p] for p in parts if p]


class _Words:
    """Distinct words of a task by number."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.number: dict[str, int] = {}

    def numbers(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Packed word numbers of each text, and the words that are new."""
        number, before = self.number, len(self.number)
        packed = []
        for text in texts:
            words = self.find(text) if text else []
            packed.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32).tobytes())
        return packed, list(number)[before:] if len(number) > before else []


def _word_rows(new: list[str], table: RankMap, fresh: bool, schema: pa.Schema) -> pa.RecordBatch:
    words = [w.encode() for w in new]
    folded = [w if len(w) <= FOLD_BYTES else b"" for w in words]
    counts, first, length = table.merges(folded)
    one = np.int64(1)
    ends = one << first | one << (first + length)
    span = (one << (first + length + 1)) - (one << first)
    merges = pa.StructArray.from_arrays([pa.array(span), pa.array(ends)], fields=list(schema.field("merges").type.value_type))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), merges)
    columns = {
        "word": pa.array(words, pa.binary()),
        "bounds": pa.array([(1 << (len(w) + 1)) - 1 if w else None for w in folded], pa.int64()),
        "merges": lists,
        "fresh": pa.array([fresh and i == 0 for i in range(len(words))]),
    }
    return _batch(columns, len(words), schema)


def _batch(columns: dict[str, pa.Array], rows: int, schema: pa.Schema) -> pa.RecordBatch:
    """The columns, and nulls for others."""
    made = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def encode_rows(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``id, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the decimal ids joined by commas, and of the bytes they
    decode to. With ``with_ids`` also ``ids``.
    """
    spark = prepare(docs.sparkSession)
    ranks = read_ranks(ranks_path)  # a file of the driver, of fixed size
    if not single_pass(ranks):
        raise ValueError("the ranks are not those of byte-pair training")
    ranks_of = spark.sparkContext.broadcast(ranks)
    id_type = docs.schema[id_col].dataType.simpleString()
    row_schema = f"id {id_type}, numbers binary, word binary, bounds bigint, merges array<struct<span: bigint, ends: bigint>>, fresh boolean"
    arrow = _arrow_schema(spark, row_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, fresh = _Words(pattern), _rank_map(ranks_of.value), True
        for batch in batches:
            packed, new = words.numbers(batch.column(1).to_pylist())
            for at in range(0, len(new), 20_000):
                yield _word_rows(new[at : at + 20_000], table, fresh, arrow)
                fresh = False
            yield _batch({"id": batch.column(0), "numbers": pa.array(packed, pa.binary())}, batch.num_rows, arrow)
            if len(words.number) > TASK_WORDS:
                words.number.clear()
                fresh = True
        del words
        give_back()

    out_schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if with_ids else ""
    )
    out_arrow = _arrow_schema(spark, out_schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Encoded(ranks_of.value)
        for batch in batches:
            out = known.read(batch, with_ids)
            if out["id"]:
                yield pa.RecordBatch.from_pydict({k: out[k] for k in out_arrow.names}, schema=out_arrow)
        del known
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, row_schema)
    folded = rows.withColumn("bounds", F.when(F.col("bounds").isNotNull(), fold_merges(F.col("merges"), F.col("bounds"))))
    return folded.drop("merges").mapInArrow(assemble, out_schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


class _Encoded:
    """Ids and decoded bytes of a task's words by number."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.clear()

    def clear(self) -> None:
        self.ids: list[list[int]] = []
        self.texts: list[str] = []
        self.decoded: list[bytes] = []

    def add(self, word: bytes, bounds: int | None) -> None:
        ids = merge_long(word, self.ranks) if bounds is None else [self.ranks[p] for p in parts(word, bounds)]
        self.ids.append(ids)
        self.texts.append(",".join(map(str, ids)))
        self.decoded.append(b"".join([self.token[i] for i in ids]))

    def read(self, batch: pa.RecordBatch, with_ids: bool) -> dict[str, list]:
        """Learn the batch's words and put its texts together, in row order."""
        names = batch.schema.names
        keys, packed, words, bounds, fresh = (batch.column(names.index(c)).to_pylist() for c in ("id", "numbers", "word", "bounds", "fresh"))
        out: dict[str, list] = {"id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for i, word in enumerate(words):
            if fresh[i]:
                self.clear()
            if word is not None:
                self.add(word, bounds[i])
                continue
            numbers = np.frombuffer(packed[i], np.int32).tolist()
            text = ",".join([self.texts[n] for n in numbers])
            out["id"].append(keys[i])
            out["n_tokens"].append(text.count(",") + 1 if text else 0)
            out["ids_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([self.decoded[n] for n in numbers])).hexdigest())
            if with_ids:
                out["ids"].append([x for n in numbers for x in self.ids[n]])
        return out
