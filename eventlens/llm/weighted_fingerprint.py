"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its lower-cased words (runs of other than ASCII white
space), weighted by how often they occur. For term ``k`` of weight ``S`` and
sample ``i``, with ``r`` and ``c`` drawn from Gamma(2, 1) and ``b`` from
Uniform(0, 1) by hashes of ``(k, i)`` alone::

    t = floor(ln S / r + b)        a = c exp(-r (t + 1 - b))

``r`` and ``b`` come from two independent exponentials ``x = r b`` and
``y = r (1 - b)``, of which ``y = -ln u`` for a uniform ``u``; so
``a = c u exp(-r t)``, and a term that occurs once (``t = 0``) needs no more
than ``c`` and ``u``.

The sample is the pair ``(k, t)`` of least ``a``. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, the sum of the
lesser weights over the sum of the greater ones, so the share of equal samples
(``likeness``) estimates it with a standard error of at most
``0.5 / sqrt(SAMPLES)``.

One sample is one long number, the root of ``a`` in fixed point above 24 bits
that name ``(k, t)``, so a fingerprint is the minimum of each of ``SAMPLES`` numbers over
the terms: a hash aggregate of primitive columns, combined before any shuffle.
Terms go by their 64-bit hash. Counting a text's terms sorts the hashes of its
words in one array; long texts are split in pieces at white space first, so
that only hashes of their words are held.

Null texts count as empty. A text without words has a fingerprint of its own,
equal to that of every such text and to no other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import prepare, shuffle_width, stored

SAMPLES = 48
#: Hexadecimal digits of one sample in a fingerprint.
DIGITS = 6
PIECE_CHARS = 1 << 16
#: Text of one range of ids at most on average; ranges are dealt to tasks, some on average to each.
RANGE_BYTES = 256 << 20
RANGES_A_TASK = 2
#: Ids drawn a range to find its bounds; bounds decide where rows go, never what comes out.
SAMPLE_IDS = 64
_NAME_BITS = 24
_NAME = (1 << _NAME_BITS) - 1
_SPACE = r"[\x20\x09-\x0D]+"


def _word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in the order of the hashes."""
    pieces = F.when(
        F.length(text) > PIECE_CHARS,
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE_CHARS}}}[^\x20\x09-\x0D]*"), 0),
    ).otherwise(F.array(text))
    words = F.transform(
        pieces, lambda p: F.transform(F.array_remove(F.split(F.lower(p), _SPACE), ""), lambda w: F.xxhash64(w))
    )
    return F.sort_array(F.flatten(words))


def _halves(hashed: str) -> tuple[str, str]:
    """Two numbers inside (0, 1) of the halves of a hash."""
    return f"((shiftrightunsigned({hashed}, 32) + 0.5D) * {2.0**-32!r}D)", f"((({hashed} & 4294967295L) + 0.5D) * {2.0**-32!r}D)"


def _sample(i: int) -> Column:
    """Sample ``i`` of one weighted term as one number; null for no term.

    ``a`` is below 46, so its root has three bits before the point and 36 after it.
    """
    one, two = f"xxhash64(term, {2 * i})", f"xxhash64(term, {2 * i + 1})"
    (u1, u2), (u3, u4) = _halves(one), _halves(two)
    least = f"(-ln({u3} * {u4}) * {u2})"
    name = f"(shiftrightunsigned({two}, 8) ^ {one})"
    number = "shiftleft(CAST(sqrt({a}) * {scale!r}D AS BIGINT), {bits}) | ({name} & {mask}L)"
    once = number.format(a=least, scale=2.0**36, bits=_NAME_BITS, name=name, mask=_NAME)
    r = f"(-ln({u1} * {u2}))"
    t = f"floor((log_weight - ln({u1})) / {r})"
    often = number.format(a=f"{least} * exp(-{r} * {t})", scale=2.0**36, bits=_NAME_BITS, name=f"({name} ^ {t})", mask=_NAME)
    return F.expr(f"CASE WHEN log_weight = 0D THEN {once} WHEN log_weight > 0D THEN {often} END")


def weighted_terms(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per row and distinct term: the keys, ``term`` and ``log_weight``; one of nulls for no term."""
    hashes = rows.select(*keys, _word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    last = F.transform("_h", lambda x, i: F.when(F.equal_null(x, F.get("_h", i + 1)), None).otherwise(i))
    ends = hashes.select(*keys, "_h", F.filter(last, lambda i: i.isNotNull()).alias("_e"))
    terms = F.transform(
        "_e",
        lambda e, i: F.struct(
            F.get("_h", e).alias("term"),
            F.log((e - F.coalesce(F.get("_e", i - 1), F.lit(-1))).cast("double")).alias("log_weight"),
        ),
    )
    return ends.select(*keys, F.inline_outer(terms))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per distinct keys: the keys and ``fingerprint``, of all texts of those keys together.

    Rows keep their partitioning if the keys hold its columns; otherwise one
    row of ``SAMPLES`` numbers for each task and key is shuffled.
    """
    least = [F.min(_sample(i)).alias(f"_s{i}") for i in range(SAMPLES)]
    signed = weighted_terms(rows, keys, text).groupBy(*keys).agg(*least)
    none = "g" * DIGITS  # no sample
    parts = [f"coalesce(lower(lpad(hex(_s{i} & {_NAME}L), {DIGITS}, '0')), '{none}')" for i in range(SAMPLES)]
    return signed.select(*keys, F.expr(f"concat({', '.join(parts)})").alias("fingerprint"))


def likeness(one: str, other: str) -> Column:
    """The share of equal samples of the fingerprints in two columns, 0 to 1; null if one is null."""
    places = range(1, SAMPLES * DIGITS, DIGITS)
    same = [f"CAST(substring(`{one}`, {p}, {DIGITS}) = substring(`{other}`, {p}, {DIGITS}) AS INT)" for p in places]
    return F.expr(f"({' + '.join(same)}) / {float(SAMPLES)}D")


def _id_ranges(docs: DataFrame, ids: str, text: str) -> tuple[Column, int]:
    """The number of each id's range, and tasks for them; ids of a higher range are greater, null ids are in range 0."""
    width = shuffle_width(docs.sparkSession)
    size = docs.agg(F.count(ids).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    ranges = max(RANGES_A_TASK * width, -(-(size["bytes"] or 0) // RANGE_BYTES))
    share = min(1.0, SAMPLE_IDS * ranges / max(size["n"], 1))
    drawn = sorted(r[0] for r in docs.select(ids).filter(F.col(ids).isNotNull()).sample(share, seed=1).collect())
    bounds = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []
    if not bounds:
        return F.lit(0), 1
    # Binary search: the number of bounds that are not greater than the id.
    kind = docs.schema[ids].dataType.simpleString()
    table = F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<{kind}>")
    number = F.aggregate(
        F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]).cast("array<int>"),
        F.lit(0),
        lambda at, step: at + F.when(F.get(table, at + step - 1) <= F.col(ids), step).otherwise(0),
    )
    return number, max(width, -(-ranges // RANGES_A_TASK))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against an edited copy and against the next document, in descending order of ids.

    The edited copy has its last ``floor(n / 2)`` code points replaced by the
    first as many (or all) of the next document; after the last document comes
    the first. One row per document: ``id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Null ids come last; equal ids are ordered by the hash of the text, then the
    text, so equal rows are interchangeable. Rows of one id lie in one range. A
    single document is its own next one, an empty table gives an empty result,
    extra columns are ignored.

    Texts are shuffled once, to the range of their id. A range's first row is
    read again as the row that follows the range before it.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part, width = _id_ranges(base, "id", "text")
    ranged = base.withColumn("part", part)
    # The greatest id of each range (null if it has none), one row a range, and the range that is read before it.
    tops = sorted((r["part"], r["id"]) for r in ranged.groupBy("part").agg(F.max("id").alias("id")).collect())
    heads = [(p, i, tops[(k + 1) % len(tops)][0]) for k, (p, i) in enumerate(tops)]
    kind = base.schema["id"].dataType.simpleString()
    heads = F.broadcast(docs.sparkSession.createDataFrame(heads, f"part int, top {kind}, target int"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    firsts = (
        ranged.join(heads, "part")
        .filter(F.equal_null("id", "top"))
        .groupBy("target", "id")
        .agg(least)
        .select("id", F.col("least.text").alias("text"), F.col("target").alias("part"), F.lit(True).alias("extra"))
    )
    firsts = stored(firsts, "range-heads")
    both = ranged.withColumn("extra", F.lit(False)).unionByName(firsts).repartition(width, "part")
    own_id = F.when(~F.col("extra"), F.col("id"))
    order = Window.partitionBy("part").orderBy(own_id.desc_nulls_last(), "extra", F.xxhash64("text"), "text")
    half = F.floor(F.length("text") / F.lit(2)).cast("int")
    seen = both.select(
        "part", "id", "text", "extra", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next")
    )
    length = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.col("next"), F.lit(1), half))
    nothing = F.lit(None)
    about = seen.withColumn("edited", edited).select(
        "part",
        "at",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("which"), "extra", "id", length.cast("bigint").alias("n_chars"),
                    F.sha2("edited", 256).alias("edited_sha256"), nothing.cast("string").alias("text"),
                ),
                *(
                    F.struct(
                        F.lit(k).alias("which"), "extra", nothing.cast(kind).alias("id"), nothing.cast("bigint").alias("n_chars"),
                        nothing.cast("string").alias("edited_sha256"), F.col(text).alias("text"),
                    )
                    for k, text in ((1, "text"), (2, "edited"))
                ),
            )
        ),
    )
    signed = fingerprints(
        about.filter("which < 2 OR NOT extra"), ["part", "at", "which", "extra", "id", "n_chars", "edited_sha256"]
    )
    # By place, then kind: a document's row, its own and the edited fingerprint, then the next document's row and own.
    line = Window.partitionBy("part").orderBy("at", "which")
    own, changed, following = (F.lead("fingerprint", k).over(line) for k in (1, 2, 4))
    found = signed.select(
        "which", "extra", "id", "n_chars", "edited_sha256",
        own.alias("fingerprint"), changed.alias("edited_fingerprint"), following.alias("next_fingerprint"),
    ).filter("which = 0 AND NOT extra")
    return found.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
