"""Order-dependent folds: where the next group begins depends on all before it.

Where no key has more than ``CHUNK`` rows, each key's rows are sorted by Spark and streamed through one task in Arrow batches with a constant state.  Only sizes
and times are looked at, cut by cut; all other columns pass through as they are.

A hot key spreads over tasks (``spread``): rows are ordered by range, and each range is taken in chunks.  A chunk tells, for every row at which a group could
begin because the one before it must end by then, how many groups begin from there on and what the last of them holds: each row's next cut comes from running
sums, and cuts are followed by pointer doubling.  These summaries, some rows of a group's length for each chunk, are composed in order, key by key; then every chunk numbers its
rows from the state it begins with.  Sizes and times alone go through these steps, and the numbers are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

# Limits of a batch.
OVERHEAD, MAX_BYTES, MAX_EVENTS, MAX_SPAN_MS = 26, 1_048_576, 10_000, 86_400_000


CHUNK = 1_000_000
"""Rows of a key that one task takes in a row."""


@dataclass(frozen=True)
class Rotation:
    """An object ends with the row that fills it."""

    target: int
    columns: tuple[str, ...]

    def next(self, sums: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For a group that begins at each row, where the next one begins; len + 1 if it is still open at the end, len if it is full there."""
        before = np.concatenate([[0], sums[:-1]])
        return np.searchsorted(sums, before + self.target) + 1

    def entry(self, count: int, total: int, since: int, sums: np.ndarray, times: np.ndarray) -> int:
        """Rows that still belong to an open group."""
        return int(np.searchsorted(sums, self.target - total)) + 1

    def reach(self, sums: np.ndarray) -> int:
        return int(np.searchsorted(sums, self.target)) + 1


@dataclass(frozen=True)
class Batching:
    """A batch ends before the row that it has no room for."""

    max_events: int
    max_bytes: int
    max_span: int
    columns: tuple[str, ...]

    def next(self, sums: np.ndarray, times: np.ndarray) -> np.ndarray:
        at, before = np.arange(len(sums)), np.concatenate([[0], sums[:-1]])
        stop = np.minimum(at + self.max_events, np.minimum(np.searchsorted(sums, before + self.max_bytes, side="right"), np.searchsorted(times, times + self.max_span, side="right")))
        stop = np.maximum(stop, at + 1)
        return np.where(stop >= len(sums), len(sums) + 1, stop)  # one that is full at the end is closed by the next row

    def entry(self, count: int, total: int, since: int, sums: np.ndarray, times: np.ndarray) -> int:
        fits = min(self.max_events - count, int(np.searchsorted(sums, self.max_bytes - total, side="right")), int(np.searchsorted(times, since + self.max_span, side="right")))
        return len(sums) + 1 if fits >= len(sums) else max(0, fits)

    def reach(self, sums: np.ndarray) -> int:
        return min(self.max_events, int(np.searchsorted(sums, self.max_bytes, side="right")))


def _segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Runs of rows with equal values of the first ``keys`` columns, as these values and the arrays of the others."""
    held: list[list[np.ndarray]] = []
    last: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            own = [int(c[i]) for c in columns[:keys]]
            if held and own != last:
                yield last, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            last = own
            held.append([c[i:j] for c in columns[keys:]])
    if held:
        yield last, [np.concatenate(x) for x in zip(*held, strict=True)]


def _summary(rule: Rotation | Batching, sizes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a segment, as far as an open group can reach into it: running sums, times, groups that begin from each row on, and of the last of them its rows, bytes and first time
    (0 rows: it is full)."""
    n, sums = len(sizes), np.cumsum(sizes)
    after = rule.next(sums, times)
    jump, steps = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
    while (steps[jump] > 0).any():
        steps, jump = steps + steps[jump], jump[jump]
    k = min(n, rule.reach(sums) + 1)
    last = jump[:k]
    open_ = after[last] > n
    held = np.where(open_, n - last, 0)
    return sums[:k], times[:k], steps[:k] + 1, held, np.where(open_, sums[-1] - sums[last] + sizes[last], 0), times[last]


def spread(records: DataFrame, keys: list[str], order: list[str], rule: Rotation | Batching, name: str, chunk: int = CHUNK) -> DataFrame:
    """``records`` numbered by ``rule``, with the rows of each key dealt to as many tasks as they have ranges and chunks."""
    spark, path, kept = records.sparkSession, scratch(records.sparkSession, "fold"), [c for c in records.columns if c != name]
    ids = {"_id": F.monotonically_increasing_id(), "_key": F.xxhash64(*keys)}
    records.select(*kept).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns(ids).write.parquet(path)
    there = spark.read.parquet(path)
    sizes = [F.col(c).cast("long").alias(f"_v{i}") for i, c in enumerate(rule.columns)]
    sizes += [F.lit(0).cast("long").alias("_v1")] * (len(sizes) < 2)
    chunks = F.shiftleft(F.shiftright("_id", 33), 31) + F.floor(F.col("_id").bitwiseAND((1 << 33) - 1) / chunk).cast("long")
    narrow = there.select(chunks.alias("_chunk"), "_key", "_id", *sizes)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, key), (_, size, time) in _segments(batches, 2):
            parts = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in _summary(rule, size, time)]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([key]), pa.array([len(size)]), pa.array([int(size.sum())]), *parts], SUMMARY_NAMES)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (-1, 0, 0, 0)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                part, key, n, total = (batch.column(c)[i].as_py() for c in range(4))
                sums, times, begun, held, rest, since = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in range(4, 10))
                if key != now:
                    now, state = key, (-1, 0, 0, 0)
                out.append((part, key, *state))
                number, count, had, first = state
                at = rule.entry(count, had, first, sums, times) if count else 0
                if at < n and at < len(begun):
                    state = (number + int(begun[at]), int(held[at]), int(rest[at]), int(since[at]))
                elif at == n:
                    state = (number, 0, 0, 0)
                else:
                    state = (number, count + n, had + total, first)
            columns = zip(*out, strict=True) if out else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], STATE_NAMES)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, number, count, had, first), (ids, size, time) in _segments(batches, 6):
            sums, n = np.cumsum(size), len(size)
            at = min(n, rule.entry(count, had, first, sums, time) if count else 0)
            after, out = rule.next(sums, time), np.full(n, number, np.int64)
            while at < n:
                number += 1
                stop = min(n, int(after[at]))
                out[at:stop] = number
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], ["_id", name])

    summaries = narrow.repartition("_chunk").sortWithinPartitions("_chunk", "_id").mapInArrow(summarised, SUMMARY)
    states = summaries.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInArrow(composed, STATE)
    rows = narrow.join(states, ["_chunk", "_key"]).select(*STATE_NAMES, "_id", "_v0", "_v1").repartition("_chunk").sortWithinPartitions("_chunk", "_id")
    numbers = rows.mapInArrow(numbered, f"_id long, {name} long")
    return there.join(numbers, "_id").select(*kept, name)


SUMMARY = "_chunk long, _key long, n long, total long, sums binary, times binary, begun binary, held binary, rest binary, since binary"
STATE = "_chunk long, _key long, number long, count long, had long, first long"
SUMMARY_NAMES, STATE_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (SUMMARY, STATE))


def hot(records: DataFrame, keys: list[str | Column], chunk: int = CHUNK) -> bool:
    """Whether some key has more rows than one task should take."""
    return bool(records.groupBy(*keys).count().where(F.col("count") > chunk).limit(1).count())


def _numbered(
    records: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, fold: Callable[[], Callable], near: list[str | Column] | None = None
) -> DataFrame:
    """``records`` with a number: ``fold()`` makes a function that takes whether a key begins and the ``columns`` of a part of that key, and gives the numbers."""
    kept = [c for c in records.columns if c != name]
    fields = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in kept), f"{name} long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = fold(), None
        for batch in batches:
            key = batch.column(len(kept)).to_numpy()
            if not len(key):
                continue
            values = [batch.column(kept.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            out = [number(key[i] != last if i == 0 else True, *(v[i:j] for v in values)) for i, j in zip(cuts, cuts[1:])]
            last = key[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate(out), pa.int64())], [*kept, name])

    rows = records.select(*kept, F.xxhash64(*keys).alias("_fold_key"))
    return rows.repartition(*(near or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def rotate(records: DataFrame, keys: list[str], order: list[str], size: str, target: int, chunk: int = CHUNK, near: list[str | Column] | None = None) -> DataFrame:
    """Number the objects of each key (``seq``): add a record, then cut if the size has reached ``target``.

    With ``near``, which the keys determine, rows that share it come out of one task, by key and in order; the caller knows that none is ``hot``.
    """
    if near is None and hot(records, keys, chunk):
        return spread(records, keys, order, Rotation(target, (size,)), "seq", chunk)

    def fold() -> Callable:
        seq = total = 0

        def number(begins: bool, sizes: np.ndarray) -> np.ndarray:
            nonlocal seq, total
            if begins:
                seq = total = 0
            sums, out, at, before = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0, 0
            while at < len(sizes):
                stop = int(np.searchsorted(sums, before + target - total)) + 1  # the record that fills the object belongs to it
                out[at:stop] = seq
                if stop > len(sizes):
                    total += int(sums[-1]) - before
                else:
                    seq, total, before = seq + 1, 0, int(sums[stop - 1])
                at = stop
            return out

        return number

    return _numbered(records, keys, order, [size], "seq", fold, near)


def batches(
    records: DataFrame, keys: list[str], order: list[str], cost: str, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BYTES, max_span: int = MAX_SPAN_MS, chunk: int = CHUNK
) -> DataFrame:
    """Number the batches of each key (``batch``), whose order begins with the time: before a record, close a batch that it would overfill or overstretch."""
    if hot(records, keys, chunk):
        return spread(records, keys, order, Batching(max_events, max_bytes, max_span, (cost, "timestamp")), "batch", chunk)

    def fold() -> Callable:
        batch = count = total = first = 0

        def number(begins: bool, costs: np.ndarray, times: np.ndarray) -> np.ndarray:
            nonlocal batch, count, total, first
            if begins:
                batch = count = total = 0
            sums, out, at, before = np.cumsum(costs), np.empty(len(costs), np.int64), 0, 0
            while at < len(costs):
                if count == 0:
                    first = int(times[at])
                fits = min(
                    at + max_events - count, int(np.searchsorted(sums, before + max_bytes - total, side="right")), int(np.searchsorted(times, first + max_span, side="right"))
                )
                stop = min(len(costs), max(fits, at + (count == 0)))  # an empty batch takes any record
                out[at:stop] = batch
                count, total = count + stop - at, total + (int(sums[stop - 1]) - before if stop else 0)
                if stop < len(costs):
                    batch, count, total = batch + 1, 0, 0
                at, before = stop, int(sums[stop - 1]) if stop else 0
            return out

        return number

    return _numbered(records, keys, order, [cost, "timestamp"], "batch", fold)
