"""Sequence operators on streams as stateful processors with timers.

An episode's state is a short list of rows and a few numbers. It leaves when a row that ``end`` marks as the last has come, or, without any such mark, when the
watermark is ``silence`` beyond the episode's latest event time: a timer then closes the episode and gives out what waited for its end. Rows of an episode come
in order over batches; those that come all together behind the watermark are dropped by Spark, and an episode that goes on after it was closed begins anew.

These need a state store with column families (``use_state_store``), set before a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that are given out at once.
MOST = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Closing(StatefulProcessor):
    """Keeps a tuple of numbers and a list of rows for each episode and closes it by an end mark or by silence.

    ``rows_schema`` and ``schema`` are those of the list and the tuple. ``fold`` gets (key, list, tuple or None, new rows, whether the episode ends) and returns (list, tuple, output);
    a new row is its order and the values of ``taken``. Each call to the state store is a round trip from Python, so an episode has one value, which holds the list too, and
    one timer: if the episode has gone on when it expires, it is set anew."""

    rows_schema, schema = "", ""

    def __init__(self, taken: list[str], silence_ms: int, columns: list[str]):
        self.taken, self.silence_ms, self.columns = taken, silence_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, Row(*self.columns)
        waiting = f"waiting array<struct<{self.rows_schema}>>, " if self.rows_schema else ""
        self.kept = handle.getValueState("kept", f"{waiting}{self.schema}, due long, timer long")

    def fold(self, key, waiting: list[tuple], numbers: tuple | None, new: list[tuple], closed: bool) -> tuple[list[tuple], tuple, list[tuple]]:
        raise NotImplementedError

    def _known(self) -> tuple[list[tuple], tuple | None, int | None, int | None]:
        """The waiting rows, the numbers, when silence ends the episode, and the timer that is set."""
        found = self.kept.get()
        if found is None:
            return [], None, None, None
        *numbers, due, timer = found
        return [tuple(r) for r in numbers.pop(0)] if self.rows_schema else [], tuple(numbers), due, timer

    def _keep(self, waiting: list[tuple], numbers: tuple, due: int, timer: int) -> None:
        self.kept.update((*([waiting] if self.rows_schema else []), *numbers, due, timer))

    def _given(self, key, out: list[tuple]) -> Iterator[Row]:
        for lo in range(0, len(out), MOST):
            yield self.out(key[0], *(list(c) for c in list(zip(*out[lo : lo + MOST], strict=True))[1:]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, latest, closed = [], 0, False
        for _, _, at, last, *lists in rows:  # as _packed has them
            new += zip(*lists, strict=True)
            latest, closed = max(latest, at or 0), closed or last
        new.sort(key=itemgetter(0))
        waiting, numbers, due, timer = self._known()
        waiting, numbers, out = self.fold(key[0], waiting, numbers, new, closed)
        if not closed:
            due = max(latest + self.silence_ms, due or 0, timerValues.getCurrentWatermarkInMs() + 1)
            if timer is None:
                self.handle.registerTimer(timer := due)
            self._keep(waiting, numbers, due, timer)
        elif timer is not None:
            self.handle.deleteTimer(timer)
            self.kept.clear()
        yield from self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, numbers, due, _ = self._known()
        if numbers is None:
            return
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            self._keep(waiting, numbers, due, due)
            return
        _, _, out = self.fold(key[0], waiting, numbers, [], True)
        self.kept.clear()
        yield from self._given(key, out)


def _packed(frames: DataFrame, taken: list[str], key: str, order: str, end: str | None, time: str) -> DataFrame:
    """(key, latest time, the same in ms, whether the last row is among them, lists of the order and the taken columns): the rows of a key that come together in an Arrow
    batch as one row, as a row of its own costs Python more than all else."""
    kinds = dict(frames.dtypes)
    own = {"__order": order, **{f"__value{i}": c for i, c in enumerate(taken)}}
    last = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = frames.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.unix_millis(F.col(time)).alias("__at"), last.alias("__last"), *(F.col(c).alias(n) for n, c in own.items()))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                many = pa.Table.from_batches([batch]).group_by("__key", use_threads=False)
                found = many.aggregate([("__time", "max"), ("__at", "max"), ("__last", "any"), *((n, "list") for n in own)])
                found = found.select(["__key", "__time_max", "__at_max", "__last_any", *(f"{n}_list" for n in own)]).rename_columns(["__key", "__time", "__at", "__last", *own])
                yield from found.combine_chunks().to_batches()

    return rows.mapInArrow(work, f"__key {kinds[key]}, __time {kinds[time]}, __at long, __last boolean, " + ", ".join(f"{n} array<{kinds[c]}>" for n, c in own.items()))


def _process(frames: DataFrame, processor: Closing, schema: str, key: str, order: str, end: str | None, time: str, delay: str) -> DataFrame:
    first, *others = (part.split(" ", 1) for part in schema.split(", "))
    lists = ", ".join(f"{n} array<{kind}>" for n, kind in others)
    rows = _packed(frames, processor.taken, key, order, end, time).withWatermark("__time", delay)
    found = rows.groupBy("__key").transformWithState(processor, f"{' '.join(first)}, {lists}", "Append", "EventTime")
    return found.select(first[0], F.inline(F.arrays_zip(*(n for n, _ in others))))


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class _LookAround(Closing):
    rows_schema, schema = "o:long,v:double", "sent long, first_order long, first_value double"

    def __init__(self, back: int, ahead: int, *rest):
        super().__init__(*rest)
        self.back, self.ahead = back, ahead

    def fold(self, key, waiting, numbers, new, closed):
        rows = waiting + [(o, float(v)) for o, v in new]
        sent, first, edge = numbers or (-1, *rows[0])
        at, last, out = dict(rows), rows[-1][0], []
        for o, _ in rows:
            if o <= sent or (o + self.ahead > last and not closed):
                continue
            out.append((key, o, at.get(o - self.back, edge), at[min(o + self.ahead, last)], o - self.back < first, o + self.ahead > last))
            sent = o
        return [r for r in rows if r[0] > last - self.back - self.ahead - 1], (sent, first, edge), out


def look_around(frames: DataFrame, value: str, back: int, ahead: int, time: str, silence_ms: int, delay: str, key: str = "episode_index", order: str = "frame_index", end: str | None = None) -> DataFrame:
    """(key, order, back_value, ahead_value, back_pad, ahead_pad) once the ``ahead`` frames behind a row, or the episode's end, are seen.

    State holds the last back + ahead rows. Beyond the episode stands the edge value."""
    schema = f"{key} {dict(frames.dtypes)[key]}, {order} long, back_value double, ahead_value double, back_pad boolean, ahead_pad boolean"
    return _process(frames, _LookAround(back, ahead, [value], silence_ms, _columns(schema)), schema, key, order, end, time, delay)


class _Record(Closing):
    schema = "n long"

    def __init__(self, fps: float, *rest):
        super().__init__(*rest)
        self.fps = fps

    def fold(self, key, waiting, numbers, new, closed):
        n = numbers[0] if numbers else 0
        return [], (n + len(new),), [(key, o, n + i, (n + i) / self.fps) for i, (o,) in enumerate(new)]


def record(frames: DataFrame, fps: float, time: str, silence_ms: int, delay: str, key: str = "episode_index", order: str = "event_id", end: str | None = None) -> DataFrame:
    """(key, order, frame_index, timestamp): a counter for each episode numbers frames as they arrive."""
    kinds = dict(frames.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, frame_index long, timestamp double"
    return _process(frames, _Record(fps, [], silence_ms, _columns(schema)), schema, key, order, end, time, delay)


class _PreRoll(Closing):
    rows_schema, schema = "o:long,t:double,b:long", "saving boolean"

    def __init__(self, seconds: float, max_bytes: int | None, *rest):
        super().__init__(*rest)
        self.seconds, self.max_bytes = seconds, max_bytes

    def fold(self, key, waiting, numbers, new, closed):
        saving, held, out = bool(numbers[0]) if numbers else False, sum(r[2] for r in waiting), []
        at = 0  # rows of the list before this have left
        for o, t, e, *size in new:
            b = size[0] if size else 0
            if e and not saving:
                out += [(key, r[0]) for r in waiting[at:] if t - r[1] <= self.seconds]
                waiting, at, held, saving = [], 0, 0, True
                out.append((key, int(o)))
            elif saving:
                out.append((key, int(o)))
                saving = not e
            else:
                waiting.append((int(o), float(t), int(b)))
                held += int(b)
                # The row that has just come stays, however large it is.
                while at < len(waiting) - 1 and (t - waiting[at][1] > self.seconds or (self.max_bytes is not None and held > self.max_bytes)):
                    held -= waiting[at][2]
                    at += 1
        return waiting[at:], (saving,), out


def pre_roll(frames: DataFrame, event: str, clock: str, seconds: float, time: str, silence_ms: int, delay: str, size: str | None = None, max_bytes: int | None = None, key: str = "episode_index", order: str = "frame_index", end: str | None = None) -> DataFrame:
    """(key, order): while saving is off, the rows of the last ``seconds`` wait in state, the latest of at most ``max_bytes`` by the column ``size``; an event lets
    them out and saving goes on until the next event."""
    schema = f"{key} {dict(frames.dtypes)[key]}, {order} long"
    return _process(frames, _PreRoll(seconds, max_bytes, [clock, event, *([size] if size else [])], silence_ms, _columns(schema)), schema, key, order, end, time, delay)


class _RowFeatures(Closing):
    schema = "before double, n long, reference double, command double, was boolean"

    def __init__(self, dt: float, limit: int, *rest):
        super().__init__(*rest)
        self.dt, self.limit = dt, limit

    def fold(self, key, waiting, numbers, new, closed):
        before, n, reference, command, was = numbers or (None, 0, None, None, False)
        out = []
        for o, v, on in new:
            n += 1
            if on:
                reference, command = reference if was else float(v), float(v)
            was = bool(on)
            out.append((key, int(o), 0.0 if before is None else (v - before) / self.dt, n >= self.limit, reference, command))
            before = float(v)
        return [], (before, n, reference, command, was), out


def row_features(frames: DataFrame, value: str, dt: float, limit: int, enabled: str, time: str, silence_ms: int, delay: str, key: str = "episode_index", order: str = "frame_index", end: str | None = None) -> DataFrame:
    """(key, order, velocity, truncated, reference, command): the step from the last row, whether ``limit`` rows have gone by, the value
    at the last rising edge of ``enabled`` and the last one while it held."""
    schema = f"{key} {dict(frames.dtypes)[key]}, {order} long, velocity double, truncated boolean, reference double, command double"
    return _process(frames, _RowFeatures(dt, limit, [value, enabled], silence_ms, _columns(schema)), schema, key, order, end, time, delay)


def without_replays(frames: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each row once, however often it is sent again before the watermark passes it; progress reports count the dropped ones (``dropped_replays``)."""
    return frames.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def dropped_replays(progress: list) -> int:
    return sum(int(o["customMetrics"].get("numDroppedDuplicateRows", 0)) for p in progress for o in p["stateOperators"])


def observed(progress: list, name: str, metric: str) -> int:
    """The sum of a metric that a stream's ``observe`` has reported with each batch."""
    return sum(int(p["observedMetrics"][name][metric] or 0) for p in progress if name in p["observedMetrics"])
