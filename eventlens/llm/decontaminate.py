"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters. A window is ``WINDOW`` consecutive words of a benchmark item, or
the whole item if it is shorter. Of every ``WINDOW - GRAM + 1`` consecutive
word grams the ones with the least hash are kept, on both sides, so each
shared window shares at least one kept gram. Items shorter than a window are
looked up by one gram of their own length. Kept grams pass a bit set of fixed
size made of the benchmark's grams, meet them in a join, and are extended word
by word to both sides; a document word counts as hit if the extended run
covers a window. Equality is decided on words, never on hashes.

Documents go through one scan. Their rows are numbered and stored before the
join, so a lost executor cannot renumber them. The benchmark side is broadcast
only while its counted grams stay below ``BROADCAST_GRAMS``; beyond that the
join shuffles, and Spark splits skewed keys.

Null and empty texts have no words and are never contaminated. Items without
words match nothing; an item with a null id makes hits but is not listed.
Repeated documents are judged row by row, repeated items count once. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import prepare, stored

WINDOW = 13
GRAM = 5
#: Bits of the set that kept grams must pass before they leave the scan: 2 MB whatever the benchmark's size.
FILTER_BITS = 24
BROADCAST_GRAMS = 100_000
#: Most words whose hashes a worker remembers.
MEMO_WORDS = 100_000
#: Bytes of a text taken at a time, and words hashed together.
PIECE_BYTES = 1 << 19
PIECE_WORDS = 1 << 16
_MARGIN = 2 * WINDOW

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _grams(words: np.ndarray, start_of: np.ndarray, end_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place on, and whether they lie in one text."""
    n = words.size
    whole = np.arange(n) + k <= end_of
    value = np.full(n, np.uint64(k))
    for j in range(k):
        value[: n - j] = value[: n - j] * _ODD + words[j:]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value, whole


def _slide(values: np.ndarray, width: int, pick, fill: int) -> np.ndarray:
    """``pick`` over each value and the ``width - 1`` after it; ``fill`` past the end."""
    padded = np.concatenate([values, np.full(width, np.uint64(fill))])
    out, have = padded, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: out.size - step], out[step:])
        have += step
    return out[: values.size]


def kept_grams(words: np.ndarray, lengths: np.ndarray, shorter: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Places, gram lengths and hashes of the winnowed grams of concatenated texts.

    ``shorter`` lists gram lengths of which every gram is kept.
    """
    ends = np.cumsum(lengths)
    start_of, end_of = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    places, sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in (*((GRAM,) if words.size >= WINDOW else ()), *(-k for k in shorter if k <= words.size)):
        value, whole = _grams(words, start_of, end_of, abs(k))
        if k > 0:
            width = WINDOW - GRAM + 1
            least = _slide(np.where(whole, value, np.uint64(2**64 - 1)), width, np.minimum, 2**64 - 1)
            least[np.arange(words.size) + WINDOW > end_of] = 0  # not a window of one text
            before = _slide(least[::-1], width, np.maximum, 0)[::-1]  # best of the windows that hold the gram
            whole &= before == value
        at = np.flatnonzero(whole)
        places.append(at)
        sizes.append(np.full(at.size, k))
        hashes.append(value[at])
    return np.concatenate(places), np.concatenate(sizes), np.concatenate(hashes), start_of, end_of


def _pieces(text: str | None) -> Iterator[tuple[list[bytes], int, int, int]]:
    """A text's words piece by piece: the words, where the piece's own begin and end, and the place of the first word.

    A margin of words of the pieces before and after is on either side, so every window of an own word is whole.
    """
    data = (text or "").encode().translate(_TO_WORDS)
    if len(data) <= PIECE_BYTES:
        words = data.split()
        yield words, 0, len(words), 0
        return

    def chunks() -> Iterator[list[bytes]]:
        at = 0
        while at < len(data):
            end = data.find(b" ", at + PIECE_BYTES)
            end = len(data) if end < 0 else end
            yield data[at:end].split()
            at = end

    before: list[bytes] = []  # the margin, or less at the start of the text
    own: list[bytes] = []
    after: list[bytes] = []
    place = 0
    for words in chunks():
        after += words
        if len(after) < _MARGIN:
            continue
        if own:
            yield before + own + after[:_MARGIN], len(before), len(before) + len(own), place - len(before)
            place += len(own)
            before = (before + own)[-_MARGIN:]
        own, after = after, []
    own += after
    yield before + own, len(before), len(before) + len(own), place - len(before)


def _contexts(texts, shorter: tuple[int, ...], passes=None) -> tuple[list[int], list[list[dict]]]:
    """Per text its number of words and its kept grams with the words a window around them can reach."""
    n_words, found = [0] * len(texts), [[] for _ in texts]
    held: list[tuple] = []  # text, words, own begin and end, place
    size = 0
    for i, text in enumerate(texts):
        for words, begin, end, place in _pieces(text):
            n_words[i] += end - begin
            if words:
                held.append((i, words, begin, end, place))
                size += len(words)
            if size >= PIECE_WORDS:
                _piece_contexts(held, shorter, passes, found)
                held, size = [], 0
    if held:
        _piece_contexts(held, shorter, passes, found)
    return n_words, found


def _piece_contexts(held: list[tuple], shorter: tuple[int, ...], passes, found: list[list[dict]]) -> None:
    memo = _contexts.memo
    flat = [w for _, words, *_ in held for w in words]
    lengths = np.array([len(words) for _, words, *_ in held])
    hashed = np.fromiter(map(memo.__getitem__, flat), dtype=np.uint64, count=len(flat))
    places, sizes, grams, start_of, end_of = kept_grams(hashed, lengths, shorter)
    pieces = np.searchsorted(np.cumsum(lengths), places, side="right")
    begins, ends = (np.array([h[k] for h in held]) for k in (2, 3))
    within = places - start_of[places]
    ok = (within >= begins[pieces]) & (within < ends[pieces])
    if passes is not None:
        bit = grams >> np.uint64(64 - FILTER_BITS)
        ok &= (passes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    chosen = (a[ok].tolist() for a in (places, sizes, grams, pieces))
    for place, size, gram, piece in zip(*chosen, strict=True):
        k = abs(size)
        reach = WINDOW - k if size > 0 else 0
        first, last = int(start_of[place]), int(end_of[place])
        lo, hi = max(first, place - reach), min(last, place + k + reach)
        text, _, _, _, offset = held[piece]
        found[text].append({
            "gram": gram - 2**64 if gram >= 2**63 else gram, "size": size, "pos": place - first + offset,
            "lead": place - lo, "near": b" ".join(flat[lo:hi]).decode(),
        })


_contexts.memo = _Hashes()

_GRAM_ROW = "gram: bigint, size: int, pos: int, lead: int, near: string"


def _gram_column(column: Column, shorter: tuple[int, ...], passes=None) -> Column:
    @F.pandas_udf(f"struct<n_words: bigint, grams: array<struct<{_GRAM_ROW}>>>")
    def grams(texts: pd.Series) -> pd.DataFrame:
        n_words, found = _contexts(texts.tolist(), shorter, None if passes is None else passes.value)
        return pd.DataFrame({"n_words": n_words, "grams": found})

    return grams(column)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joined grams extended to both sides; those that cover a window."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            k, doc, item = abs(r.size), r.near.split(" "), r.item_near.split(" ")
            a, b = r.lead, r.item_lead
            if doc[a : a + k] != item[b : b + k]:
                continue
            left = right = 0
            if r.size > 0:
                while left < min(a, b) and doc[a - left - 1] == item[b - left - 1]:
                    left += 1
                a, b = a + k, b + k
                while right < min(len(doc) - a, len(item) - b) and doc[a + right] == item[b + right]:
                    right += 1
                if left + k + right < WINDOW:
                    continue
            out.append((r.row, r.item_id, r.pos - left, r.pos + k + right))
        yield pd.DataFrame(out, columns=["row", "item_id", "lo", "hi"])


def benchmark_grams(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, tuple[int, ...]]:
    """The kept grams of every item, stored, and the lengths of the items shorter than a window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("int")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int32")

    sized = items.select("item_id", "text", n_words("text").alias("n"))
    short = tuple(sorted(r.n for r in sized.filter(f"n BETWEEN 1 AND {WINDOW - 1}").select("n").distinct().collect()))
    grams = sized.filter("n > 0").select("item_id", "n", F.explode(_gram_column(F.col("text"), short)["grams"]).alias("g"))
    own = (F.col("g.size") > 0) | (-F.col("g.size") == F.col("n"))  # short grams: of items of just that length
    return stored(
        grams.filter(own).select(
            "item_id", "g.gram", "g.size", F.col("g.lead").alias("item_lead"), F.col("g.near").alias("item_near")
        ).distinct(),
        "benchmark-grams",
    ), short


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, items`` (sorted strings)``, contaminated``."""
    spark = prepare(docs.sparkSession)
    grams, short = benchmark_grams(benchmark, item_col, item_text_col)
    bits = grams.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).cast("int").alias("bit")).distinct()
    # At most 2^24 small integers, whatever the benchmark's size; packed into bytes of the set.
    by_byte = bits.groupBy(F.shiftright("bit", 3).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, bit & 7)")).alias("byte")
    )
    passes = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in by_byte.toLocalIterator():
        passes[r["at"]] = r["byte"]

    scanned = docs.select(
        F.col(id_col).alias("id"),
        _gram_column(F.col(text_col), short, spark.sparkContext.broadcast(passes)).alias("found"),
    )
    rows = stored(
        scanned.select("id", "found.n_words", "found.grams").withColumn("row", F.monotonically_increasing_id()),
        "document-grams",
    )
    near = rows.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.size", "g.pos", "g.lead", "g.near")
    side = F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams
    runs = near.join(side, ["gram", "size"]).mapInPandas(_runs, "row bigint, item_id string, lo bigint, hi bigint")
    # Intervals and items of a document; a word counts once however many runs hold it.
    spans = runs.select("row", "lo", "hi").distinct().groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["hi"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(s["end"], x["lo"]))).alias("n"),
        ),
        lambda s: s["n"],
    )
    items = runs.select("row", "item_id").distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item_id")).alias("items")
    )
    hits = spans.select("row", covered.alias("n_hit")).join(items, "row")
    joined = rows.select("row", "id", "n_words").join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns.

    Contamination depends on the text alone, so documents go by the digest of
    theirs; no text is stored or numbered for it.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    found = contamination(docs.select(digest.alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text", **options)
    name = "digest"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    bad = stored(found.filter("contaminated").select(F.col("id").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, digest).join(bad, name, "left_anti").drop(name)
