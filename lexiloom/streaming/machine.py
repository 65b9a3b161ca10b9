"""Document status as a machine with keyed state, event-time order and timeouts.

The latest status written (``operators.status``) says nothing about whether it could be reached.
Here every event is judged against the state its document is in: it is accepted if the machine
allows the transition, else illegal and without effect. A document that stays in ``processing``
for longer than allowed fails by timeout.

The stream holds events back until the watermark has passed them and applies them in event
order, so the micro-batches they came in do not matter. An event that comes when the watermark
has passed it is late: Spark leaves it out, and :func:`late_events` finds it in the log. Held
events are bounded by the watermark's delay; besides, the state is one short row per document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that each state may be left for; the empty one is a document's before its first event.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "": ("not_started", "processing"),
    "not_started": ("processing",),
    "processing": ("completed", "failed"),
    "completed": ("processing",),
    "failed": ("not_started", "processing"),
}
#: The state that times out, and what it becomes.
WAITING, TIMED_OUT = "processing", "failed"

_MOVES = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("asked", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
    T.StructField("outcome", T.StringType()),
])
_STATE = "held string"

Move = tuple[int, int | None, str, str, str, str]


@dataclass
class Machine:
    """State of one document; times are microseconds."""

    status: str = ""
    since: int = 0
    pending: list[tuple[int, int, str]] = field(default_factory=list)

    def deadline(self, stall: int | None) -> int | None:
        return None if stall is None or self.status != WAITING else self.since + stall

    def pass_time(self, until: int | None, stall: int | None) -> Iterator[Move]:
        """Time goes on to ``until`` (without end if None): the document may time out."""
        deadline = self.deadline(stall)
        if deadline is not None and (until is None or deadline < until):
            yield (deadline, None, TIMED_OUT, self.status, TIMED_OUT, "timeout")
            self.status, self.since = TIMED_OUT, deadline

    def apply(self, at: int, seq: int, asked: str, stall: int | None) -> Iterator[Move]:
        yield from self.pass_time(at, stall)
        before, legal = self.status, asked in TRANSITIONS.get(self.status, ())
        if legal:
            self.status, self.since = asked, at
        yield (at, seq, asked, before, self.status, "accepted" if legal else "illegal")


def _events(events: DataFrame, key: str, *more: str) -> DataFrame:
    """Key, time in microseconds, number and asked status; rows without a key or a time are left out."""
    known = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    return known.select(
        F.col(key).cast("string").alias("document_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("status", F.lit("")).alias("status"), *more,
    )


def _shown(moves: DataFrame) -> DataFrame:
    return moves.select("document_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "seq", "asked", "before", "after", "outcome")


def transitions(events: DataFrame, stall: int | None = None, key: str = "document_id") -> DataFrame:
    """What every event of a table did: ``document_id, ts, seq, asked, before, after, outcome``.

    ``events`` has ``ts, seq, status``; equal times are ordered by ``seq``, then by status.
    ``stall`` is the longest time in ``processing``, in seconds; timeouts are rows without
    ``seq``. The state of a document depends on all its events before, so they pass one task in
    order, which holds one state whatever their number.
    """
    limit = None if stall is None else stall * 1_000_000
    ordered = _events(events, key).repartition("document_id").sortWithinPartitions("document_id", "at", "seq", "status")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine = None, Machine()
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, seq, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != current:
                    rows += [(current, *m) for m in machine.pass_time(None, limit)]
                    current, machine = doc, Machine()
                rows += [(doc, *m) for m in machine.apply(at, seq, asked, limit)]
            yield _batch(rows)
        yield _batch([(current, *m) for m in machine.pass_time(None, limit)])

    return _shown(ordered.mapInArrow(walk, _MOVES))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_MOVES.names)


def stream_transitions(events: DataFrame, delay: str, stall: int | None = None, key: str = "document_id") -> DataFrame:
    """The same rows out of a stream, each when the watermark (``delay`` behind) has passed it.

    A timeout is reported once the watermark has passed it; a late event has no row.
    """
    limit = None if stall is None else stall * 1_000_000
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine()
        if state.exists:
            held = json.loads(state.get[0])
            machine = Machine(held["status"], held["since"], [tuple(p) for p in held["pending"]])
        for batch in batches:
            machine.pending += zip(batch["at"].tolist(), batch["seq"].tolist(), batch["status"].tolist())
        mark = state.getCurrentWatermarkMs()
        machine.pending.sort()
        ready = [p for p in machine.pending if p[0] <= mark * 1000]
        machine.pending = machine.pending[len(ready):]
        moves = [m for p in ready for m in machine.apply(*p, limit)]
        moves += machine.pass_time(mark * 1000, limit)
        state.update((json.dumps(machine.__dict__),))
        waits = [t for t in (machine.deadline(limit), machine.pending[0][0] if machine.pending else None) if t is not None]
        if waits:
            state.setTimeoutTimestamp(max(min(waits) // 1000 + 1, mark + 1))
        if moves:
            yield pd.DataFrame([(keys[0], *m) for m in moves], columns=_MOVES.names).astype({"seq": "Int64"})

    timed = _events(marked, key, "ts").groupBy("document_id")
    return _shown(timed.applyInPandasWithState(step, _MOVES, _STATE, "append", GroupStateTimeout.EventTimeTimeout))


def late_events(events: DataFrame, moves: DataFrame, until: str, key: str = "document_id") -> DataFrame:
    """Logged events up to a time the stream has passed that it has no row for: those that came late."""
    passed = events.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    seen = moves.where("seq is not null").select(F.col("document_id").alias(key), "seq").distinct()
    return passed.join(seen, [key, "seq"], "left_anti")
