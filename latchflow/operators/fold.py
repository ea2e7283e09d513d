"""State machines folded over the time order of each key.

Rows are hash-partitioned by key, sorted inside the partition, and streamed once through Arrow
batches; memory holds one state and one batch, never a group. A key that is too large for one
task is cut into slices (see ``slices``) that run side by side. A slice needs the state its
predecessor ends in. A machine that can tell what a slice does to any entry state (``transfer``) is linked
in one round: every slice sends its small table, and the driver follows them in order. Of other
machines slices report the end state for assumed entry states; the driver
links these small records, and slices whose true entry state was not yet tried run again. The
emitted rows always come from the true entry state, so results equal a single ordered pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.operators.slices import SLICE, Layout, task_count
from latchflow.plans.session import shared_dir


class Fold:
    """One state machine. Subclasses are small picklable objects.

    ``inputs`` are the columns handed to ``run``; ``outputs`` the columns it returns. Where keys
    may be sliced the first input is the time.
    """

    inputs: tuple[str, ...] = ()
    outputs: T.StructType = T.StructType()

    def fresh(self):
        """State before the first row of a key."""
        raise NotImplementedError

    def enter(self, key: tuple):
        """State before the first row of this key."""
        return self.fresh()

    def transfer(self, *columns: list):
        """What a whole slice does to any entry state, as a small table; None if it would not be small."""
        return None

    def follow(self, table, entry: tuple) -> tuple:
        """Frozen end state of a slice with this table, for a frozen entry state."""
        raise NotImplementedError

    def run(self, state, *columns: list) -> tuple[list, ...]:
        """Apply consecutive rows of one key, given as columns; returns the output columns.

        ``state`` is changed in place.
        """
        raise NotImplementedError

    def freeze(self, state, at: int) -> tuple:
        """Hashable form of ``state`` without anything that cannot matter at time ``at`` or later."""
        raise NotImplementedError

    def thaw(self, frozen: tuple):
        """State of a frozen form."""
        raise NotImplementedError

    def idle(self, at: int) -> tuple:
        """Frozen form at ``at`` of a state that has seen rows but holds nothing pending."""
        raise NotImplementedError


def _values(column: pa.Array) -> list:
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _segments(batch: pa.RecordBatch, keys: Sequence[str], inputs: Sequence[str]):
    """Runs of equal keys in a batch, each with its input columns."""
    ends = np.unique(
        np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys])
    ).tolist()
    columns = [_values(batch.column(n)) for n in inputs]
    start = 0
    for end in ends:
        key = tuple(batch.column(k)[start].as_py() for k in keys)
        yield key, [c[start:end] for c in columns]
        start = end


def _emitter(fold: Fold, keys: Sequence[str], entries: dict[tuple, tuple]) -> Callable:
    """Rows with the fold's outputs appended; passed-through columns stay in Arrow."""
    out_types = [_arrow_type(f.dataType) for f in fold.outputs]
    names = [f.name for f in fold.outputs]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in stream:
            if not batch.num_rows:
                continue
            results = [[] for _ in names]
            for key, columns in _segments(batch, keys, fold.inputs):
                if key != current:
                    current = key
                    state = fold.thaw(entries[key]) if key in entries else fold.enter(key)
                for whole, part in zip(results, fold.run(state, *columns)):
                    whole += part
            added = [pa.array(v, t) for v, t in zip(results, out_types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, *names]
            )

    return run


def _prober(fold: Fold, keys: Sequence[str], trials: dict[tuple, list[tuple]]) -> Callable:
    """End states of slices, one record per assumed entry state."""

    def record(key: tuple, pairs: list, at: int) -> list:
        return [
            (pickle.dumps(key), pickle.dumps(entry), pickle.dumps(fold.freeze(state, at)))
            for entry, state in pairs
        ]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pairs, at, done = None, [], 0, []
        for batch in stream:
            if not batch.num_rows:
                continue
            for key, columns in _segments(batch, keys, fold.inputs):
                if key != current:
                    done += record(current, pairs, at)
                    current = key
                    pairs = [(entry, fold.thaw(entry)) for entry in trials.get(key, ())]
                at = columns[0][-1]
                for _, state in pairs:
                    fold.run(state, *columns)
        done += record(current, pairs, at)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary()) for v in zip(*done)], ["slice_key", "entry", "ends"]
            )

    return run


def _tabler(fold: Fold, keys: Sequence[str]) -> Callable:
    """The transfer table of each slice, from its columns in whole."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, None, []

        def close():
            if current is not None:
                done.append((pickle.dumps(current), pickle.dumps(fold.transfer(*held))))

        for batch in stream:
            if not batch.num_rows:
                continue
            for key, columns in _segments(batch, keys, fold.inputs):
                if key != current:
                    close()
                    current, held = key, [[] for _ in columns]
                for whole, part in zip(held, columns):
                    whole += part
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*done)], ["slice_key", "found"])

    return run


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(),
    }[kind]


def _entry_states(
    placed: DataFrame, keys: Sequence[str], time: str, fold: Fold
) -> dict[tuple, tuple]:
    """True entry state of every slice of the hot keys.

    ``placed`` holds sorted slices and is already cut from its lineage. Everything kept here is
    per slice, of which there is a bounded number. The first assumption is that nothing is
    pending, which is right wherever a slice starts after a quiet time. All end states reported so far are tried as
    entry states of the next slice, so machines that forget quickly settle in two or three
    rounds and periodic ones as soon as their few phases are known.
    """
    full = (*keys, SLICE)
    starts: dict[tuple, list[tuple[int, int]]] = {}
    for row in placed.groupBy(*full).agg(F.min(time).alias("_at")).collect():
        starts.setdefault(tuple(row[k] for k in keys), []).append((row[SLICE], row["_at"]))
    for line in starts.values():
        line.sort()
    first = {key: fold.freeze(fold.enter(key), line[0][1]) for key, line in starts.items()}
    if type(fold).transfer is not Fold.transfer:
        entries = _followed(placed, full, fold, starts, first)
        if entries is not None:
            return entries
    known: dict[tuple, dict[tuple, tuple]] = {}
    trials = {(*key, line[0][0]): [first[key]] for key, line in starts.items()}
    for key, line in starts.items():
        for number, at in line[1:]:
            trials[(*key, number)] = [fold.idle(at)]
    while trials:
        chosen = placed.where(F.col(SLICE).isin(sorted({k[-1] for k in trials})))
        probe = chosen.mapInArrow(
            _prober(fold, full, trials), "slice_key binary, entry binary, ends binary"
        )
        for row in probe.collect():
            slice_key, entry, ends = (pickle.loads(bytes(v)) for v in row)
            known.setdefault(slice_key, {})[entry] = ends
        trials = {}
        for key, line in starts.items():
            trials.update(_open_trials(key, line, fold, first[key], known))
    return {
        (*key, number): entry
        for key, line in starts.items()
        for number, entry in _linked(key, line, fold, first[key], known)
    }


def _followed(placed, full, fold, starts, first) -> dict[tuple, tuple] | None:
    """Entry states by the slices' tables, which take one job; None if a slice has no small table."""
    rows = placed.mapInArrow(_tabler(fold, full), "slice_key binary, found binary").collect()
    tables = {pickle.loads(bytes(r["slice_key"])): pickle.loads(bytes(r["found"])) for r in rows}
    if any(table is None for table in tables.values()):
        return None
    entries = {}
    for key, line in starts.items():
        entry = first[key]
        for i, (number, _) in enumerate(line):
            entries[(*key, number)] = entry
            if i + 1 < len(line):
                ends = fold.follow(tables[(*key, number)], entry)
                entry = fold.freeze(fold.thaw(ends), line[i + 1][1])
    return entries


def _linked(key, line, fold, fresh, known):
    """Slices whose true entry state is settled, in order, each with that state."""
    entry = fresh
    for i, (number, _) in enumerate(line):
        yield number, entry
        ends = known.get((*key, number), {})
        if entry not in ends or i + 1 == len(line):
            return
        entry = fold.freeze(fold.thaw(ends[entry]), line[i + 1][1])


def _open_trials(key, line, fold, fresh, known):
    """Entry states still to be tried for one key; empty once its chain is complete."""
    settled = sum(1 for _ in _linked(key, line, fold, fresh, known))
    last = line[settled - 1][0]
    entries = dict(_linked(key, line, fold, fresh, known))
    if settled == len(line):
        return {}
    found = {(*key, last): [entries[last]]}
    for (before, _), (number, at) in zip(line[settled - 1 :], line[settled:]):
        tried = known.get((*key, number), {})
        ends = known.get((*key, before), {}).values()
        new = {fold.freeze(fold.thaw(end), at) for end in ends} - set(tried)
        if new:
            found[(*key, number)] = sorted(new, key=repr)
    return found


def fold_ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, layout: Layout
) -> DataFrame:
    """Append the outputs of ``fold`` to every row of ``df``; rows of a key are taken in ``order``."""
    keys, order = list(keys), list(order)
    # A given number keeps AQE from merging small shuffles: the work is Python time, not bytes.
    tasks = task_count(df.sparkSession, layout.total)
    schema = T.StructType(df.schema.fields + fold.outputs.fields)
    if not layout.hot:
        placed = df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
        return placed.mapInArrow(_emitter(fold, keys, {}), schema)
    shared_dir(df.sparkSession)
    staged = layout.assign(df)
    cold = staged.where(F.col(SLICE).isNull()).drop(SLICE)
    cold = cold.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
    full = [*keys, SLICE]
    hot = staged.where(F.col(SLICE).isNotNull())
    hot = hot.repartition(tasks, *full).sortWithinPartitions(*full, *order).checkpoint()
    entries = _entry_states(hot, keys, layout.time, fold)
    sliced_schema = T.StructType(hot.schema.fields + fold.outputs.fields)
    return (
        hot.mapInArrow(_emitter(fold, full, entries), sliced_schema)
        .drop(SLICE)
        .unionByName(cold.mapInArrow(_emitter(fold, keys, {}), schema))
    )
