"""Event-time order for stateful streams: rows wait in state until the watermark has passed them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.shuffle import ExternalSorter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of one frame that a processor sends.
CHUNK = 10_000
#: Characters of waiting rows in one list entry; Spark reads up to 10,000 entries at once.
BLOCK = 4096
#: Memory of a worker (MB) above which due rows are sorted on disk.
SORT_MB = 400
DELAY = "10 seconds"
#: Groups that traps are spread over by a hash. A call per group costs far more than its rows, so their number is
#: fixed and not that of the traps. It bounds the tasks that a stream can use, and has to stay for a checkpoint.
GROUPS = 512
#: What a processor sends: rows as one text of columns, for the rows' own columns cost far more.
SENT = "found string"


class Ordered(StatefulProcessor):
    """Applies each trap's rows strictly in time order, however the input is cut into micro-batches.

    A key is a group of traps. Its rows are kept until the watermark is later than their time; then a timer hands
    them to ``apply``, trap by trap and in order. Rows of one time are always released together. What arrives
    behind the watermark goes to ``too_late`` and changes no state. ``kinds`` names the columns with their
    types, the time in microseconds first; ``order`` names the columns to sort by; rows have their trap_id as one more
    column at the end. Rows come and wait as blocks of text, and due ones beyond a worker's memory are sorted on
    disk. ``keeps`` names the states with one value per trap; a group's values are read together.
    """

    kinds: dict[str, str] = {}
    order: Sequence[str] = ()
    keeps: dict[str, str] = {}
    #: Columns of the rows that ``apply`` and ``too_late`` give.
    names: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first_us long, last_us long, rows string")
        self.kept = {name: handle.getMapState(name, "trap_id long", kind) for name, kind in self.keeps.items()}
        self.settled = None

    def apply(self, trap: int, rows: Iterable[Sequence], mark_us: int, own: dict[str, tuple | None]) -> Iterator[tuple]:
        """One trap's rows in order, all before ``mark_us``; there may be none, when the time of ``wake`` has come.

        ``own`` holds the trap's values of all states, and is to hold the new ones (or none) at the end.
        """
        raise NotImplementedError

    def too_late(self, rows: list[tuple]) -> Iterable[tuple]:
        raise NotImplementedError

    def wake(self, own: dict[str, tuple | None]) -> int | None:
        """Time (us) at which ``apply`` is to be called with these values though there may be no rows."""
        return None

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"found": [json.dumps(dict(zip(self.names, map(list, zip(*rows)))))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            fresh, late = [], []
            for since, until, text in zip(*(frame[name].tolist() for name in ("first_us", "last_us", "rows"))):
                if mark > 0 and since // 1000 < mark:
                    found = json.loads(text)
                    late += (r for r in found if r[0] // 1000 < mark)
                    fresh += _blocks((r[0], json.dumps(r)) for r in found if r[0] // 1000 >= mark)
                else:
                    fresh.append((since, until, text))
            if fresh:
                self.waiting.appendList(fresh)
                soonest = min(r[0] for r in fresh)
                first = soonest if first is None else min(first, soonest)
            if late:
                yield self.frame(list(self.too_late(late)))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, rest, any_due = timerValues.getCurrentWatermarkInMs(), [], False
        if self.settled == (key, mark):  # an earlier timer of this batch has done all
            return
        self.settled = (key, mark)

        def due():
            nonlocal any_due
            for first, last, text in self.waiting.get():
                if first // 1000 >= mark:
                    rest.append((first, last, text))
                    continue
                any_due, rows = True, json.loads(text)
                if last // 1000 < mark:
                    yield from rows
                else:
                    yield from (r for r in rows if r[0] // 1000 < mark)
                    rest.extend(_blocks((r[0], json.dumps(r)) for r in rows if r[0] // 1000 >= mark))

        places = [-1, *(list(self.kinds).index(c) for c in self.order)]
        rows = ExternalSorter(SORT_MB).sorted(due(), key=lambda r: [(r[i] is not None, r[i]) for i in places])
        if any_due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        times = [r[0] // 1000 + 1 for r in rest]
        for chunk in chunks(self._applied(rows, mark * 1000, times)):
            yield self.frame(chunk)
        if times:
            # one timer is enough: it wakes for what comes first, and then for the next
            self.handle.registerTimer(min(times))

    def _applied(self, rows: Iterable[Sequence], mark_us: int, times: list[int]) -> Iterator[tuple]:
        """What becomes of all traps that have rows or whose time has come; adds to ``times`` when traps have to wake."""
        held = {name: {trap: tuple(value) for (trap,), value in state.iterator()} for name, state in self.kept.items()}

        def applied(trap, own_rows):
            stored = {name: values.pop(trap, None) for name, values in held.items()}
            own = dict(stored)
            at = self.wake(own)
            if own_rows or (at is not None and at <= mark_us):
                yield from self.apply(trap, own_rows, mark_us, own)
                at = self.wake(own)
            for name, value in own.items():
                if value is None and stored[name] is not None:
                    self.kept[name].removeKey((trap,))
                elif value != stored[name]:
                    self.kept[name].updateValue((trap,), value)
            if at is not None:
                times.append(-(-at // 1000))

        for trap, own_rows in groupby(rows, key=lambda r: r[-1]):
            yield from applied(trap, own_rows)
        for values in held.values():
            for trap in list(values):
                yield from applied(trap, ())

    def close(self) -> None:
        pass


def in_order(marked: DataFrame, processor: Ordered, sends: str = SENT, groups: int = GROUPS) -> DataFrame:
    """What a processor sends of a marked stream (trap_id and the columns of ``kinds``).

    Rows are texts from the start, and each task sends its rows of a group as blocks, as they will wait.
    """
    group = F.pmod(F.xxhash64("trap_id"), F.lit(groups)).cast("int").alias("trap_group")
    values = [_json(name, kind) for name, kind in (*processor.kinds.items(), ("trap_id", "long"))]
    texts = marked.select(group, "t_us", F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")).alias("row"))
    blocks = texts.mapInArrow(_sent_blocks, "trap_group int, first_us long, last_us long, rows string")
    return blocks.groupBy("trap_group").transformWithStateInPandas(processor, sends, "Append", "EventTime")


def _json(name: str, kind: str) -> Column:
    if kind != "string":
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))
    listed = F.to_json(F.array(F.col(name)))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _sent_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        found: dict[int, list[tuple[int, str]]] = {}
        for group, t, text in zip(*(column.to_pylist() for column in batch.columns)):
            found.setdefault(group, []).append((t, text))
        sent = [(group, *block) for group, rows in found.items() for block in _blocks(rows)]
        if sent:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*sent), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["trap_group", "first_us", "last_us", "rows"])


def _blocks(rows: Iterable[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    """Texts of rows, given with their times, as longer texts of bounded length, each with its first and last time."""
    part, times, size = [], [], 0
    for t, text in rows:
        if part and size + len(text) > BLOCK:
            yield min(times), max(times), f"[{','.join(part)}]"
            part, times, size = [], [], 0
        part.append(text)
        times.append(t)
        size += len(text)
    if part:
        yield min(times), max(times), f"[{','.join(part)}]"


def chunks(rows: Iterable[Sequence]) -> Iterator[list[Sequence]]:
    rows = iter(rows)
    while chunk := list(islice(rows, CHUNK)):
        yield chunk


def received(found: DataFrame, shape: T.StructType) -> DataFrame:
    """The rows behind texts of ``SENT``."""
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in shape.fields])
    opened = found.select(F.from_json("found", lists, {"mode": "FAILFAST"}).alias("_found"))
    columns = opened.select(*(F.col(f"_found.{n}").alias(n) for n in shape.names))
    return columns.select(F.explode(F.arrays_zip(*shape.names)).alias("_row")).select("_row.*")


def with_beats(rows: DataFrame, beats: DataFrame | None, delay: str, key: str = "trap_id") -> DataFrame:
    """The stream under a watermark that clock beats (frame_ts) move on too, without their rows.

    Beats let a silent fleet's last rows out: rows wait until something later than the delay was seen.
    """
    if beats is not None:
        rows = rows.unionByName(beats.select("frame_ts"), allowMissingColumns=True)
    marked = rows.withWatermark("frame_ts", delay)
    # naming the time keeps this filter above the watermark, which has to see the beats
    return marked.where(F.when(F.col("frame_ts").isNotNull(), F.col(key)).isNotNull())


_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def packed(columns: Sequence[str]) -> Column:
    """Further columns as one text, which passes through state whatever their types."""
    if not columns:
        return F.lit("{}")
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **_TIMES})


def opened(text: str, schema) -> Column:
    return F.from_json(text, schema, _TIMES)
