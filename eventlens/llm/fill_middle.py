"""Fill-in-middle rearrangement of documents, cut between units by an indexable skip list.

A text's units are its lines, ``[^\\n]*\\n|[^\\n]+``. Over them lies a skip
list: every unit is a node of lane 0, a unit's tower height is geometric (a
hash of its place), and each lane is headed by a sentinel of full height.
Every link carries two widths, the units and the code points it passes. A cut
rank is reached from the top lane down, along links whose units still fit; the
code points passed on the way are the exact offset of the cut, and appending
or cutting needs no second look at the text before it.

``prefix <P>``, ``suffix <S>`` and ``middle <M>`` are marked by the control
strings below, in one of two orders; a text that holds one of them stays
plain, so that ``restore`` finds each mark at its first occurrence.

Which documents are rearranged, where they are cut, and which order they take
follows from a digest of seed and id alone: a repeated run, or a task that is
run again, gives the same rows. Null texts count as empty; empty texts are
plain with no units. A null id is written as ``null`` in the digest. Rows are
independent: repeated ids and rows are treated alike, extra columns are
ignored, an empty table gives an empty result. A worker holds one Arrow batch
(bounded in bytes) and the list of one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import byte_batches, prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
#: Each lane holds about one in ``2 ** LANE_BITS`` nodes of the lane below.
LANE_BITS = 2


@dataclass(frozen=True)
class Lane:
    """Links of one level: node ``i`` leads to ``i + 1``; ``down`` is the node's place in the lane below."""

    down: np.ndarray
    units: np.ndarray
    chars: np.ndarray


def tower_heights(count: int) -> np.ndarray:
    """Geometric heights of the towers of ``count`` places, the same for every text."""
    with np.errstate(over="ignore"):
        h = (np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    low = h & (~h + np.uint64(1))  # lowest set bit: its place is geometric
    return np.where(low == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // LANE_BITS


class SkipList:
    """The widths of a sequence of units, indexable by unit rank."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.size = int(lengths.size)
        # Lane 0: the head, of width zero, then one node a unit; a link's widths are those of the unit it passes.
        heights = np.concatenate([[64], tower_heights(self.size)])
        place = np.arange(self.size + 1)
        units = np.concatenate([np.ones(self.size, np.int64), [0]])
        chars = np.concatenate([lengths.astype(np.int64), [0]])
        self.lanes = [Lane(place, units, chars)]
        height = 1
        while self.lanes[-1].units.size > 4 and (heights >= height).sum() < heights.size:
            stays = np.flatnonzero(heights >= height)
            below = self.lanes[-1]
            self.lanes.append(Lane(stays, np.add.reduceat(below.units, stays), np.add.reduceat(below.chars, stays)))
            heights = heights[stays]
            height += 1

    def offset(self, rank: int) -> int:
        """Code points before the cut that follows ``rank`` units."""
        if not 0 <= rank <= self.size:
            raise ValueError(f"rank {rank} outside 0..{self.size}")
        node, passed, chars = 0, 0, 0
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            while passed < rank and passed + lane.units[node] <= rank:
                passed += int(lane.units[node])
                chars += int(lane.chars[node])
                node += 1
                if node == lane.units.size:  # the lane's last link leads to the end
                    return chars
            node = int(lane.down[node]) if level else node
        return chars


def unit_lengths(text: str) -> np.ndarray:
    return np.fromiter((m.end() - m.start() for m in UNIT.finditer(text)), dtype=np.int64)


def decisions(name: str, seed: int) -> tuple[int, ...]:
    """The first four 32-bit groups of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def rearrange(text: str, name: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the output."""
    lanes = SkipList(unit_lengths(text))
    n = lanes.size
    first, second, whether, order = decisions(name, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or whether % 100 >= rate:
        return n, PLAIN, None, None, text
    a, b = sorted((lanes.offset(first % (n + 1)), lanes.offset(second % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_rate:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given, from its output and form."""
    if form == PLAIN:
        return output
    lead, then = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    one, rest = output[len(lead) :].split(then, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == SPM else one + middle + two


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    with_digests: bool = False,
) -> DataFrame:
    """One row per document: ``id, n, form, prefix_chars, middle_chars, output``.

    ``rate`` of 100 documents are rearranged, ``spm_rate`` of 100 of those with
    the suffix first. With ``with_digests``, SHA-256 digests of the output and
    of the text restored from it (``output_sha256, restored_sha256``) stand in
    place of the output.
    """
    prepare(docs.sparkSession)
    last = [("output_sha256", pa.string()), ("restored_sha256", pa.string())] if with_digests else [("output", pa.string())]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *last]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(source, "text"):
            out: list[list] = [[] for _ in made]
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, form, a, m, output = rearrange(text, name, seed, rate, spm_rate)
                shown = [output]
                if with_digests:
                    shown = [hashlib.sha256(t.encode()).hexdigest() for t in (output, restore(output, form))]
                for column, value in zip(out, (n, form, a, m, *shown), strict=True):
                    column.append(value)
            arrays = [batch["id"], *(pa.array(c, t) for c, (_, t) in zip(out, made, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *(c for c, _ in made)])

    types = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in made)
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, {types}")
