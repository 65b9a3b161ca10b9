"""Substring joins: which terms of a list occur in which texts.

A list of checked size becomes one array literal and is tested inside the text's row. A longer
list becomes a table of hashes: a term is known by the hashes of its first and of its last bytes,
a power of two of them, which together cover it. Rolling hashes of a text meet the table in a
pass whose cost does not depend on the number of terms; every hit is compared byte by byte.
Terms of less than four bytes are found by an automaton. A band of the list, bounded in
characters, is held by every Python worker; a list of several bands costs a pass for each. Texts
never move: only the hits leave the scan.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexiloom.functions.vectors import let
from lexiloom.session import cut_lineage

MAX_LITERAL_TERMS = 512
#: Characters of the distinct terms of a band; with terms of 24 its tables take some 100 MB in a worker.
BAND_CHARS = 16_000_000
#: Bytes of texts that are hashed at a time.
_WINDOW = 1 << 20
#: The least number of bytes of a hash; shorter terms are left to the automaton.
_LEAST = 4

#: The terms of the band a worker scans; one at a time.
_BUILT: dict[str, _Terms] = {}


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column without nulls, one behind the other, and the rows' bounds."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]


def bounded_terms(terms: DataFrame, columns: list[str], limit: int = MAX_LITERAL_TERMS) -> list | None:
    """The rows of a term table if there are at most ``limit``, else None.

    Which form a join takes must not change its rows: in both, a NULL or empty term matches nothing.
    """
    rows = terms.select(*columns).limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def any_term_in(text: Column, terms: list[str]) -> Column:
    """True if any of the (few) terms occurs in the text; case-insensitive."""
    terms = [t for t in terms if t]
    if not terms:
        return F.lit(False)
    lowered = F.array(*[F.lower(F.lit(t)) for t in terms])
    return F.coalesce(let(F.lower(text), lambda held: F.exists(lowered, lambda t: F.contains(held, t))), F.lit(False))


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) that begin at every position where so many are left."""
    rolled, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < width and len(rolled) > size:
        rolled = rolled[:-size] * np.uint64(0x9E3779B97F4A7C15) + rolled[size:]
        rolled ^= rolled >> np.uint64(29)
        size *= 2
    return rolled if size == width else np.empty(0, np.uint64)


def _spread(hashes: np.ndarray) -> np.ndarray:
    return hashes * np.uint64(0xC2B2AE3D27D4EB4F)


class _Terms:
    """Terms of a band, each with its number in the list."""

    def __init__(self, needles: pa.Array):
        content, bounds = byte_view(needles)
        self.content, self.bounds = content, bounds
        lengths = np.diff(bounds)
        self.automaton = ahocorasick.Automaton()
        for number in np.flatnonzero(lengths < _LEAST):
            self.automaton.add_word(needles[int(number)].as_py(), int(number))
        if len(self.automaton):
            self.automaton.make_automaton()
        #: Per width of a hash: which first bytes there are, and per length the pairs of hashes with the terms' numbers.
        self.widths: dict[int, tuple[np.ndarray, int, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
        powers = np.zeros(len(lengths), np.int64)
        long = lengths >= _LEAST
        powers[long] = 1 << np.floor(np.log2(lengths[long])).astype(np.int64)
        for width in np.unique(powers[long]).tolist():
            own = np.flatnonzero(powers == width)
            first = np.empty(len(own), np.uint64)
            last = np.empty(len(own), np.uint64)
            for low in range(0, len(own), 4096):
                part = own[low : low + 4096]
                for ends, kept in ((bounds[part], first), (bounds[part + 1] - width, last)):
                    kept[low : low + 4096] = _rolled_rows(content[ends[:, None] + np.arange(width)[None, :]])
            shift = 64 - max(10, (32 * len(own)).bit_length())
            starts = np.zeros(1 << (64 - shift), bool)
            starts[_spread(first) >> np.uint64(shift)] = True
            by_length = {}
            for length in np.unique(lengths[own]).tolist():
                at = np.flatnonzero(lengths[own] == length)
                keys = _spread(first[at]) ^ last[at]
                order = np.argsort(keys, kind="stable")
                by_length[length] = keys[order], own[at][order]
            self.widths[width] = starts, shift, by_length

    def hits(self, content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``row, number`` of the terms inside each of the texts that lie one behind the other."""
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.automaton):
            for row, (low, high) in enumerate(zip(bounds, bounds[1:])):
                found = {number for _, number in self.automaton.iter(content[low:high].tobytes().decode())}
                rows.append(np.full(len(found), row))
                numbers.append(np.array(sorted(found), np.int64))
        for width, (starts, shift, by_length) in self.widths.items():
            for begin in range(0, len(content), _WINDOW):
                rolled = _rolled(content[begin : begin + _WINDOW + 2 * width], width)
                at = np.flatnonzero(starts[_spread(rolled[:_WINDOW]) >> np.uint64(shift)])
                for length, (keys, own) in by_length.items():
                    here = at[at + length - width < len(rolled)]
                    row = np.searchsorted(bounds, here + begin, "right") - 1
                    inside = here + begin + length <= bounds[row + 1]
                    here, row = here[inside], row[inside]
                    asked = _spread(rolled[here]) ^ rolled[here + length - width]
                    low = np.searchsorted(keys, asked, "left")
                    known = keys[np.minimum(low, len(keys) - 1)] == asked
                    here, row, asked, low = here[known], row[known], asked[known], low[known]
                    high = np.searchsorted(keys, asked, "right")
                    # Mostly one term a hash; where two share it, both are compared.
                    for more in range(int((high - low).max(initial=0))):
                        kept = low + more < high
                        number, place = own[(low + more)[kept]], here[kept] + begin
                        same = self._equal(number, content, place, length)
                        rows.append(row[kept][same])
                        numbers.append(number[same])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(numbers)]), axis=1)
        return pairs[0], pairs[1]

    def _equal(self, number: np.ndarray, content: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        same = np.ones(len(number), bool)
        step = max(1, _WINDOW // length)
        span = np.arange(length)[None, :]
        for low in range(0, len(number), step):
            part = slice(low, low + step)
            same[part] = (self.content[self.bounds[number[part]][:, None] + span] == content[place[part][:, None] + span]).all(axis=1)
        return same


def _rolled_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of every row of bytes, as :func:`_rolled` has it."""
    rolled, size = rows.astype(np.uint64) + np.uint64(1), 1
    while size < rows.shape[1]:
        rolled = rolled[:, :-size] * np.uint64(0x9E3779B97F4A7C15) + rolled[:, size:]
        rolled ^= rolled >> np.uint64(29)
        size *= 2
    return rolled[:, 0]


def _terms(band: Broadcast) -> _Terms:
    name, needles = band.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _Terms(needles)
    return _BUILT[name]


def _scan(haystacks: DataFrame, needles: pa.Array) -> DataFrame:
    """``text_id, needle`` for every needle in a haystack, once per row."""
    shared = haystacks.sparkSession.sparkContext.broadcast((os.urandom(8).hex(), needles))
    out = T.StructType([haystacks.schema["text_id"], T.StructField("needle", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known = _terms(shared), shared.value[1]
        for batch in batches:
            rows, numbers = terms.hits(*byte_view(batch.column(1)))
            for low in range(0, max(len(rows), 1), 65_536):
                part = slice(low, low + 65_536)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[part])), known.take(pa.array(numbers[part]))], names=["text_id", "needle"])

    return haystacks.mapInArrow(find, out)


def containments(
    texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str, term: str, band_chars: int = BAND_CHARS
) -> DataFrame:
    """Distinct ``(text_id, term_id)`` with the (non-empty) term inside the text, whatever the case.

    Both sides are put into lower case by Spark, so that letters of any script are treated alike
    here and in the literal form. A null text or term matches nothing. The list is counted, then
    taken in bands of at most some ``band_chars`` characters; how many there are changes no row.
    """
    haystacks = texts.select(F.col(text_id).alias("text_id"), F.lower(text).alias("haystack")).where("haystack <> ''")
    needles = terms.select(F.col(term_id).alias("term_id"), F.lower(term).alias("needle")).where("needle <> ''")
    listed = needles.select("needle").distinct()
    total = listed.agg(F.sum(F.length("needle"))).first()[0] or 0
    bands = max(1, -(-total // band_chars))
    if bands > 1:
        listed, haystacks = cut_lineage(listed), cut_lineage(haystacks)
    found = None
    for band in range(bands):
        own = listed.where(F.pmod(F.xxhash64("needle"), F.lit(bands)) == band).toArrow()
        hits = _scan(haystacks, own.column(0).combine_chunks())
        found = hits if found is None else found.unionByName(hits)
    return found.join(needles, "needle").select(F.col("text_id").alias(text_id), F.col("term_id").alias(term_id)).distinct()
