"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary
Golay code has a codeword within distance 3 of every 23-bit word. A segment's
keys are the codewords within distance 4 of it: one if the nearest is at
distance 2 or less, six otherwise. Two words at distance 2 or less share a
key, because the word halfway between them decodes to a codeword that both
list. Of four differing bits, the two better segments hold two at most, so
both of these share a key, and a pair of segments makes one composite key of
24 bits. Fingerprints that meet under a key are verified bit by bit.

Rows with the same fingerprint are one class from the start, so copies make
neither keys nor pairs. Under one key, links are found by walking from one
member to all unvisited members within reach; this emits fewer links than the
key has members and loses no connection. Components then contract by
alternating large and small stars over stored tables.

Null and empty texts have fingerprint zero, which links like any other. A
null id takes part but never names a component unless nothing else can.
Repeated rows come back as often as they came in. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import give_back, numbered, only, popcount, prepare, shuffle_width, stored
from eventlens.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101


#: ASCII white space as one space, A-Z lower-cased.
_PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes whose bits are counted together.
HASHES = 1 << 15


def _joined(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, joined by single spaces, with the first and the last place of each."""
    data = np.frombuffer((text or "").encode().translate(_PLAIN), np.uint8)
    space = data == 32
    first = ~space
    first[1:] &= space[:-1]
    keep = ~space
    keep[:-1] |= first[1:]  # the space before a word
    joined = data[keep].tobytes().lstrip(b" ")
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)) if joined else np.zeros(0, np.int64)
    return joined, np.append(0, ends[:-1] + 1)[: ends.size], ends


def fingerprints(texts, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each text: a bit is set if it is set in over half of the shingle hashes.

    Hashes are made and counted ``HASHES`` at a time, within long texts too.
    """
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes, owners, held = [], [], 0
    digest = xxhash.xxh64_intdigest

    def count() -> None:
        nonlocal held
        if held:
            bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *(h.size for h in hashes[:-1])])
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            np.add.at(total, owners, [h.size for h in hashes])
            hashes.clear(), owners.clear()
            held = 0

    for i, text in enumerate(texts):
        joined, starts, ends = _joined(text)
        if not joined:
            continue
        if starts.size > shingle_words:
            starts, ends = starts[: starts.size - shingle_words + 1], ends[shingle_words - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        for at in range(0, starts.size, HASHES):
            pairs = zip(starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist(), strict=True)
            own = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
            hashes.append(own), owners.append(i)
            held += own.size
            if held >= HASHES:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by the high 12 bits of a word, and for each syndrome the errors to its keys (padded with -1)."""
    rest = np.zeros(1 << 12, dtype=np.int64)
    for high in range(1 << 12):
        word = high << 11
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        rest[high] = word
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            found[int(rest[error >> 11]) ^ (error & 0x7FF)].append(error)
    width = max(map(len, found))
    errors = np.array([e + [-1] * (width - len(e)) for e in found], dtype=np.int64)
    return rest, errors, np.array([len(e) for e in found])


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices (12 bits) of the codewords within distance 4, padded with -1."""
    rest, errors, _ = _golay()
    segment = segment.astype(np.int64)
    own = errors[rest[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(own < 0, -1, (segment[:, None] ^ own) >> 11)


def composite_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the input and their composite keys, each pair of segments in turn."""
    parts = [segment_keys((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)) for at, size in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        left, right = parts[i][:, :, None], parts[j][:, None, :]
        at = np.nonzero((left >= 0) & (right >= 0))
        rows.append(at[0])
        keys.append(pair << 24 | parts[i][at[0], at[1]] << 12 | parts[j][at[0], at[2]])
    return np.concatenate(rows), np.concatenate(keys)


def walk_links(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect exactly what all links within ``max_bits`` connect."""
    rest = members
    links = []
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = popcount(rest ^ at) <= max_bits
            if near.any():
                for other in rest[near]:
                    links.append((int(at), int(other)))
                    queue.append(other)
                rest = rest[~near]
    return links


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, keys = composite_keys(pdf.fp.to_numpy().view(np.uint64))
        yield pd.DataFrame({"key": keys.astype(np.int32), "fp": pdf.fp.to_numpy()[rows]})


def _link_rows(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by key; the last key of a batch waits for the next one."""
        key, fp = np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, int)
            sizes = np.diff(np.append(starts, key.size))
            two = starts[sizes == 2]
            two = two[popcount(fp[two] ^ fp[two + 1]) <= max_bits]
            a, b = [fp[two]], [fp[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if more := walk_links(fp[s : s + n], max_bits):
                    x, y = np.array(more, dtype=np.uint64).T
                    a.append(x), b.append(y)
            return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        for pdf in batches:
            key = np.concatenate([key, pdf.key.to_numpy()])
            fp = np.concatenate([fp, pdf.fp.to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if key.size else 0
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield links(key, fp)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` between distinct values of the column ``fp`` (bigint), enough to connect every component."""
    if not 0 <= max_bits <= 4:
        raise ValueError("composite keys find up to 4 differing bits")
    keyed = fps.mapInPandas(_key_rows, "key int, fp bigint")
    by_key = keyed.repartition(shuffle_width(fps.sparkSession), "key").sortWithinPartitions("key")
    return by_key.mapInPandas(_link_rows(max_bits), "a bigint, b bigint").distinct()


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: ``id, fp`` (bigint), ``component_id`` (the smallest id in reach)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints(texts.tolist(), shingle_words).view(np.int64))
        give_back()

    seen = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "simhash-rows")
    classes = seen.groupBy("fp").agg(F.min("id").alias("first"))
    links = stored(fingerprint_links(classes.select("fp"), max_bits), "simhash-links")
    reach = components(links)
    rooted = classes.join(reach, classes.fp == reach.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "simhash-names")
    return seen.join(named, "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component the row with the smallest id (of those with it the first stored), with its own columns."""
    rows, row = numbered(docs, "simhash-input")
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = simhash_components(rows.select(name.alias("id"), F.col(text_col).alias("text")), "id", "text", **options)
    return only(rows, row, found.filter("id = component_id").select("id.row"))
