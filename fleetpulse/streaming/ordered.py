"""Rows of a stream in the order of their time, whatever the order of files and micro-batches.

Structured Streaming gives no order. Each key therefore has a buffer in its state: a new row waits there until the watermark,
`delay` seconds behind the newest row seen so far in the whole stream, has passed its time. Then the key's rows up to the watermark are
released in the order of (ts, sample_id) and go through `step` in chunks, together with what the key remembers of
the rows before. A timer is set at the oldest row that waits, so a key without new rows is called as soon as the watermark gets there.

A row is late only if it is not after the last released row of its key, which the watermark had passed: it comes back
with `late = true`, without what is worked out from its place, and changes nothing. A second row with time and id of a known one is late, too,
and comes back when the known one is released, or after. Rows that are
`keep` seconds behind the watermark are dropped by Spark before they get here, and counted in the progress of the query
(`numRowsDroppedByWatermark`); so nothing is lost without a trace.

State per key: the rows of the last `delay` seconds, the position of the last released row and what `step` remembers. The rows lie in
a map in RocksDB, in pieces of SLOT_SECONDS that are written once and read when the watermark passes them, so that a micro-batch moves only
rows that come or go and a task never holds all that wait. Memory of a call: HELD_ROWS new rows of one key (the narrow columns alone),
the rows of one slot, and one chunk of results.

The end of a stream: the last `delay` seconds wait for newer rows. `with_heartbeats` adds a source of rows that only tell
the time, which moves the watermark when nothing else comes, and `heartbeat` writes such a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY_SECONDS = 600
KEEP_SECONDS = 366 * 86400
CHUNK_ROWS = 4096
SLOT_SECONDS = 3600  # of a piece of waiting rows
HELD_ROWS = 1 << 18  # new rows that a call holds before it puts them into their slots
CLOCK = "event_clock"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Rows = dict[str, np.ndarray]
Step = Callable[[Rows, tuple | None], tuple[pd.DataFrame, tuple]]

_ARRAYS = {"long": np.int64, "int": np.int64, "double": np.float64, "string": object}


def on_clock(rows: DataFrame, delay: int = DELAY_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """Rows with the column CLOCK, on which the watermark runs. Both times are moved `keep` seconds ahead, so that late
    rows stay in front of the watermark Spark drops rows by, while the watermark's value is that of the rows' own time."""
    return rows.withColumn(CLOCK, F.timestamp_seconds(F.col("ts") + F.lit(keep))).withWatermark(CLOCK, f"{delay + keep} seconds")


def with_heartbeats(rows: DataFrame, path: str) -> DataFrame:
    """`rows` and the heartbeats that files in the folder `path` bring: rows with a time and nothing else."""
    spark = rows.sparkSession
    spark.createDataFrame([], "ts long").write.mode("append").parquet(path)
    beats = spark.readStream.schema("ts long").parquet(path)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "ts"]
    return rows.unionByName(beats.select("ts", *others))


def heartbeat(spark: SparkSession, path: str, ts: int) -> None:
    """Tell streams that read the folder `path` that all rows up to `ts`, less their delay, have come."""
    spark.createDataFrame([(ts,)], "ts long").write.mode("append").parquet(path)


def _joined(parts: Sequence[Rows], kinds: Mapping[str, str]) -> Rows:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0, _ARRAYS[k]) for c, k in kinds.items()}


def _picked(rows: Rows, which: np.ndarray | slice) -> Rows:
    return {c: a[which] for c, a in rows.items()}


def _in_blocks(parts: Iterator[Rows], kinds: Mapping[str, str], size: int) -> Iterator[Rows]:
    """The same rows in blocks of `size` rows or a little more; the last block may be smaller, and nothing gives none."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part["ts"])
        if n >= size:
            yield _joined(held, kinds)
            held, n = [], 0
    if n:
        yield _joined(held, kinds)


def _packed(rows: Rows, kinds: Mapping[str, str]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c], pa.string() if k == "string" else None) for c, k in kinds.items()], list(kinds))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes, kinds: Mapping[str, str]) -> Rows:
    with pa.ipc.open_stream(data) as reader:
        table = reader.read_all()
    return {c: table[c].to_numpy().astype(_ARRAYS[k], copy=False) for c, k in kinds.items()}


class _InOrder(StatefulProcessor):
    """The buffer, the release and the memory of one key; see `in_order`."""

    def __init__(self, by: Sequence[str], kinds: Mapping[str, str], order: Sequence[str], output: Sequence[str], results: Sequence[str], step: Step, memory: str, chunk_rows: int):
        self.by, self.kinds, self.order, self.output, self.results = list(by), dict(kinds), list(order), list(output), list(results)
        self.step, self.memory, self.chunk_rows = step, memory, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        released = ", ".join(f"released_{c} {self.kinds[c]}" for c in self.order)
        index = "slots array<long>, pieces array<long>, oldest array<long>, timer long"
        self.handle = handle
        self.position = handle.getValueState("position", f"{index}, {released}, {self.memory}")
        self.waiting = handle.getMapState("waiting", "slot long, piece long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._advance(key, rows, timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, iter(()), timerValues.getCurrentWatermarkInMs() // 1000)

    def _frame(self, key: tuple, source: Rows, at: np.ndarray, late: bool, found: pd.DataFrame | None) -> pd.DataFrame:
        out = {c: source[c][at] for c in ("sample_id", "ts")} | dict(zip(self.by, key))
        for c in self.results:
            out[c] = found[c].to_numpy() if found is not None else source[c][at] if c in source else None
        return pd.DataFrame({**out, "late": late}, index=range(len(at)), columns=self.output)

    def _gathered(self, batches: Iterator[pd.DataFrame]) -> Iterator[Rows]:
        for batch in batches:
            batch = batch[batch["sample_id"].notna()]  # not the heartbeats
            yield {c: batch[c].to_numpy(dtype=_ARRAYS[kind]) for c, kind in self.kinds.items()}

    def _is_late(self, rows: Rows, last: tuple) -> np.ndarray:
        """Which rows are not after the last released one."""
        n = len(rows["ts"])
        if last[0] is None:
            return np.zeros(n, bool)
        after, equal = np.zeros(n, bool), np.ones(n, bool)
        for c, value in zip(self.order, last):
            after |= equal & (rows[c] > value)
            equal &= rows[c] == value
        return ~after

    def _put(self, index: dict[int, list[int]], slot: int, rows: Rows) -> None:
        """Let the rows, all of one slot, wait as another piece of it."""
        entry = index.setdefault(slot, [0, int(rows["ts"].min())])
        self.waiting.updateValue((slot, entry[0]), (_packed(rows, self.kinds),))
        entry[0] += 1
        entry[1] = min(entry[1], int(rows["ts"].min()))

    def _take(self, index: dict[int, list[int]], slot: int) -> Rows:
        """The rows of a slot in order, which leave the state."""
        parts = []
        for piece in range(index.pop(slot)[0]):
            parts.append(_unpacked(self.waiting.getValue((slot, piece))[0], self.kinds))
            self.waiting.removeKey((slot, piece))
        rows = _joined(parts, self.kinds)
        return _picked(rows, np.lexsort([rows[c] for c in reversed(self.order)]))

    def _advance(self, key: tuple, batches: Iterator[pd.DataFrame], horizon: int) -> Iterator[pd.DataFrame]:
        old, n = self.position.get(), len(self.order)
        index = {slot: [pieces, oldest] for slot, pieces, oldest in zip(*old[:3])} if old else {}
        timer = old[3] if old else None
        last = tuple(old[4 : 4 + n]) if old else (None,) * n
        remembered = tuple(old[4 + n :]) if old and last[0] is not None else None

        for new in _in_blocks(self._gathered(batches), self.kinds, HELD_ROWS):
            late = self._is_late(new, last)
            if late.any():
                yield self._frame(key, new, np.flatnonzero(late), True, None)
                new = _picked(new, ~late)
            slots = new["ts"] // SLOT_SECONDS
            new = _picked(new, np.argsort(slots, kind="stable"))
            found, begins = np.unique(np.sort(slots), return_index=True)
            for slot, begin, end in zip(found.tolist(), begins, [*begins[1:], len(slots)]):
                self._put(index, slot, _picked(new, slice(begin, end)))

        repeats: list[Rows] = []
        for block in _in_blocks(self._released(index, horizon, repeats), self.kinds, self.chunk_rows):
            while repeats:
                repeated = repeats.pop()
                yield self._frame(key, repeated, np.arange(len(repeated["ts"])), True, None)
            for begin in range(0, len(block["ts"]), self.chunk_rows):
                chunk = _picked(block, slice(begin, begin + self.chunk_rows))
                found, remembered = self.step(chunk, remembered)
                if len(found):
                    yield self._frame(key, chunk, found["at"].to_numpy(), False, found)
            last = tuple(block[c][-1].item() if hasattr(block[c][-1], "item") else block[c][-1] for c in self.order)
        for repeated in repeats:
            yield self._frame(key, repeated, np.arange(len(repeated["ts"])), True, None)

        oldest = min((entry[1] for entry in index.values()), default=None)
        due = None if oldest is None else oldest * 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        slots = sorted(index)
        blank = (None,) * len(_names(self.memory))
        state = (slots, [index[s][0] for s in slots], [index[s][1] for s in slots], due)
        self.position.update((*state, *last, *(remembered if remembered is not None else blank)))

    def _released(self, index: dict[int, list[int]], horizon: int, repeats: list[Rows]) -> Iterator[Rows]:
        """Rows up to the horizon, slot by slot and in order; rows that repeat another of the slot go to `repeats`."""
        for slot in sorted(s for s, entry in index.items() if entry[1] <= horizon):
            rows = self._take(index, slot)
            repeat = np.ones(len(rows["ts"]), bool)
            for c in self.order:
                repeat &= rows[c] == np.roll(rows[c], 1)
            repeat[0] = False
            if repeat.any():
                repeats.append(_picked(rows, repeat))
                rows = _picked(rows, ~repeat)
            ready = int(np.searchsorted(rows["ts"], horizon, "right"))
            if ready < len(rows["ts"]):
                self._put(index, slot, _picked(rows, slice(ready, None)))
            if ready:
                yield _picked(rows, slice(0, ready))


def in_order(
    rows: DataFrame,
    by: Sequence[str],
    values: Mapping[str, str],
    step: Step,
    results: Mapping[str, str],
    memory: str,
    tie: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """`sample_id, ts, <by>, <results>, late` for rows of `on_clock`.

    `step` takes rows in order (arrays of `ts`, `sample_id` and `values`) and what it remembered after the key's rows before
    (None at first), and gives a frame of `results`, one row for each that it wants to give out, with a column `at` (the
    row's place in the arrays), and what to remember, a tuple as in the DDL `memory`. `tie` orders rows beyond `sample_id`.

    The session's streams keep their state in RocksDB from then on, which this kind of state requires.
    """
    rows.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    kinds = {"ts": "long", "sample_id": "long", **values}
    output = {"sample_id": "long", "ts": "long", **dict.fromkeys(by, "string"), **results, "late": "boolean"}
    return (
        rows.select(*by, "ts", "sample_id", *values, CLOCK)
        .groupBy(*by)
        .transformWithStateInPandas(
            _InOrder(by, kinds, ["ts", "sample_id", *tie], list(output), list(results), step, memory, chunk_rows),
            ", ".join(f"`{c}` {kind}" for c, kind in output.items()),
            "append",
            "EventTime",
        )
    )


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]
