"""Packing tokenised documents into training sequences by the sum-of-squares rule.

Every task packs the rows of its own partition online: nothing is shuffled and nothing meets
in one place. A document goes, whole, into the partly filled window whose fill level leaves the
least sum of squared window counts over the levels; the counts stand in an array with one place
a level, so a choice costs two array reads and a minimum whatever the number of windows. A
document of several windows' length first fills whole windows of its own.

A sequence is padded to the window length unless its length is a power of two, so windows at
such a level waste nothing and are left out of the squares. The windows still open when the
rows end, or when ``MAX_OPEN`` are open, are settled: the fullest are filled up with what the
emptiest hold, cutting documents at the seams, and the last one is dealt into powers of two.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from lexiloom.llm.tables import query, table

#: Tokens of a full sequence.
WINDOW = 2048
#: The token that ends every document.
END_TOKEN = 1
#: Windows kept open in a task; beyond it they are settled and packing goes on.
MAX_OPEN = 4096
#: Characters encoded at once; texts are cut where no token can span the cut.
STRETCH = 1 << 16
#: A stretch with a longer run without such a place is left to the reference encoder.
LONGEST_RUN = 1 << 12
#: Bytes of token ids per output batch.
FLUSH = 4 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"

#: A character and the blank after it. A token never reaches from one to the other.
_SEAM = re.compile(r"\S(?=[ \n])")
_LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONGEST_RUN, LONGEST_RUN))


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as one letter: itself if it prints, else one from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level vocabulary file, the same as its reference encoder gives.

    The ranks of the file drive a faster encoder; stretches with very long runs, on which that
    one is slow, and texts with a special token go through the reference encoder.
    """

    def __init__(self, path: str) -> None:
        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        letters = _byte_of_letter()
        ranks = {
            bytes(letters[c] for c in word): rank
            for word, rank in content["model"]["vocab"].items() if word not in self.special
        }
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            seam = _SEAM.search(text, at + STRETCH)
            if seam is None:
                break
            yield text[at : seam.end()]
            at = seam.end()
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        """The text's ids with the end token, as unsigned 32-bit numbers."""
        made: list[np.ndarray] = []
        for part in self.stretches(text):
            if any(s in part for s in self.special) or _LONG_RUN.search(part):
                found = self.reference.encode(part, add_special_tokens=False).ids
            else:
                found = self.fast.encode_ordinary(part)
            made.append(np.array(found, dtype="<u4"))
        return np.concatenate([*made, np.array([END_TOKEN], dtype="<u4")])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


class Piece:
    """A run of one document's tokens."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:length], self.total),
            Piece(self.doc_id, self.start + length, self.ids[length:], self.total),
        )


def is_power(length: int) -> bool:
    return length > 0 and length & (length - 1) == 0


class SumOfSquares:
    """Online packing of pieces; finished sequences are taken from :attr:`done`."""

    #: Above any change of the sum, for levels without a window.
    CLOSED = 1 << 60

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.squared = np.array([not is_power(n) and 0 < n < window for n in range(window + 1)])
        # What the sum changes by when a window leaves a level, and when one enters it.
        self.leave = np.full(window + 1, self.CLOSED, dtype=np.int64)
        self.leave[0] = 0
        self.enter = self.squared.astype(np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.done: list[list[Piece]] = []

    def _count(self, level: int, change: int) -> None:
        n = self.counts[level] = self.counts[level] + change
        self.enter[level] = (2 * n + 1) * self.squared[level]
        self.leave[level] = (1 - 2 * n) * self.squared[level] if n else self.CLOSED

    def level_for(self, length: int) -> int:
        """The fill level (0: a new window) with the least sum after placing; of equals the fullest."""
        change = self.leave[: self.window - length + 1] + self.enter[length:]
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece: Piece) -> None:
        length = len(piece.ids)
        level = self.level_for(length)
        window = self.open[level].pop() if level else []
        if level:
            self._count(level, -1)
        window.append(piece)
        if level + length == self.window:
            self.done.append(window)
            return
        self.open[level + length].append(window)
        self._count(level + length, 1)
        if self.counts.sum() > self.max_open:
            self.settle()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.done.append([Piece(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.place(Piece(doc_id, whole, ids[whole:], len(ids)))

    def settle(self) -> None:
        """Close all open windows without padding."""
        waiting: deque[list[Piece]] = deque()
        for level in range(self.window - 1, 0, -1):
            (self.done if is_power(level) else waiting).extend(self.open[level])
            self.open[level] = []
            if self.counts[level]:
                self._count(level, -int(self.counts[level]))
        while waiting:
            window = waiting.popleft()
            room = self.window - sum(len(p.ids) for p in window)
            while room and waiting:
                piece = waiting[-1].pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    waiting[-1].append(rest)
                window.append(piece)
                room -= len(piece.ids)
                if not waiting[-1]:
                    waiting.pop()
            self.done.extend([window] if not room else powers(window))


def powers(window: list[Piece]) -> list[list[Piece]]:
    """The pieces dealt into sequences whose lengths are falling powers of two."""
    made: list[list[Piece]] = []
    left = sum(len(p.ids) for p in window)
    pieces = deque(window)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        sequence: list[Piece] = []
        while size:
            piece = pieces.popleft()
            if len(piece.ids) > size:
                piece, rest = piece.cut(size)
                pieces.appendleft(rest)
            sequence.append(piece)
            size -= len(piece.ids)
        made.append(sequence)
    return made


def _as_batch(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    for sequence_id, sequence in enumerate(sequences, first):
        offset, length = 0, sum(len(p.ids) for p in sequence)
        for p in sequence:
            rows.append((p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.total, sequence_id, offset, length))
            offset += len(p.ids)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of every document and the sequences they stand in.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers, ``start`` its
    place in the document, ``offset`` its place in the sequence. ``sequence_id`` is unique, not
    gapless: the partition's number in its upper half. No sequence needs padding: its length is
    ``window`` or a power of two. A null text is empty and gives the end token alone; repeated
    rows and rows without a ``doc_id`` are documents of their own; an empty table gives no
    rows; further columns of ``docs`` are not read. ``vocabulary`` is the path of a byte-level
    vocabulary file (default: the public one of 50,257 ids), readable by the workers.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, state = encoder_of(path), SumOfSquares(window, max_open)
        given, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = batch.column("doc_id")
            for row, text in enumerate(batch.column("text")):
                tokens = encoder.ids(text.as_py())
                state.add(ids[row].as_py(), tokens)
                held += tokens.nbytes
                if held > FLUSH and state.done:
                    yield _as_batch(state.done, given)
                    given, held, state.done = given + len(state.done), 0, []
        state.settle()
        if state.done:
            yield _as_batch(state.done, given)

    return rows.mapInArrow(packed, PIECES)


@query("op11_sum_of_squares_packing")
def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length"
    )
