"""Stateful processors for what streaming SQL can't express.

All are used through `run`, which groups a stream by key and gives each processor typed state. Within a micro-batch
a key's rows are taken in the order of (ts, seq); across batches in order of arrival. Time is event time in
milliseconds. Output rows are (key, tag, ts, payload): `tag` tells the main output from the side outputs, and
payload is JSON, so that one stream can be split by tag.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("payload", T.StringType()),
])

_LONG = T.StructType([T.StructField("v", T.LongType())])
_DOUBLE = T.StructType([T.StructField("v", T.DoubleType())])
_EVENT = T.StructType([T.StructField("t", T.LongType()), T.StructField("s", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("k", T.StringType())])

MAIN, SIDE, LATE, ALARM, TIMEOUT = "main", "side", "late", "alarm", "timeout"


def millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class Processor(StatefulProcessor):
    """Hands a key's events to `on_event` in order and collects what `emit` is given.

    Input columns beside the key: ts (timestamp), seq (long), value (double), kind (string).
    """

    #: Names of single values and of lists, with their schemas.
    values: dict[str, T.StructType] = {}
    lists: dict[str, T.StructType] = {}
    echo = ""
    kind: str | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = {n: handle.getValueState(n, s) for n, s in self.values.items()}
        self.held = {n: handle.getListState(n, s) for n, s in self.lists.items()}

    def get(self, name: str, default=None):
        return self.state[name].get()[0] if self.state[name].exists() else default

    def put(self, name: str, value) -> None:
        self.state[name].update((value,))

    def drop(self, *names: str) -> None:
        for n in names:
            (self.state.get(n) or self.held[n]).clear()

    def emit(self, tag: str, ms: int | None, **payload) -> None:
        if self.echo:
            payload["kind"] = self.kind
        self.rows.append((self.key, tag, None if ms is None else moment(ms), json.dumps(payload, sort_keys=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.key, self.rows = str(key[0]), []
        frames = [f for f in rows if len(f)]
        if frames:
            frame = pd.concat(frames).sort_values(["ts", "seq"], kind="stable")
            for ts, seq, value, kind in zip(frame["ts"], frame["seq"], frame["value"], frame["kind"], strict=True):
                self.kind = kind
                self.on_event(millis(ts), int(seq), None if pd.isna(value) else float(value), kind, timerValues)
        yield self.frame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.key, self.rows = str(key[0]), []
        self.on_timer(expiredTimerInfo.getExpiryTimeInMs(), timerValues)
        yield self.frame()

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=OUTPUT.names)
        out["ts"] = pd.to_datetime(out["ts"])
        return out

    def on_event(self, ms: int, seq: int, value: float | None, kind: str | None, timers) -> None:
        raise NotImplementedError

    def on_timer(self, ms: int, timers) -> None:
        pass

    def close(self) -> None:
        pass


class Limiter(Processor):
    """The first `most` events of a key pass; the next one raises an alarm, further ones are dropped until `reset_ms` after the first."""

    values = {"count": _LONG, "first": _LONG}

    def __init__(self, most: int = 10, reset_ms: int = 24 * 3_600_000):
        self.most, self.reset = most, reset_ms

    def on_event(self, ms, seq, value, kind, timers):
        first = self.get("first")
        if first is None or ms >= first + self.reset:
            self.put("first", ms)
            self.put("count", 0)
            self.handle.registerTimer(ms + self.reset)
        n = self.get("count", 0) + 1
        self.put("count", n)
        if n <= self.most:
            self.emit(MAIN, ms, seq=seq, n=n)
        elif n == self.most + 1:
            self.emit(ALARM, ms, seq=seq, n=n)

    def on_timer(self, ms, timers):
        if self.get("first") is not None and self.get("first") + self.reset <= ms:
            self.drop("count", "first")


class Jump(Processor):
    """Alarms when the value differs from the last one by more than `threshold`."""

    values = {"last": _DOUBLE}

    def __init__(self, threshold: float = 10.0):
        self.threshold = threshold

    def on_event(self, ms, seq, value, kind, timers):
        if value is None:
            return
        last = self.get("last")
        if last is not None and abs(value - last) > self.threshold:
            self.emit(ALARM, ms, last=last, now=value)
        self.put("last", value)


class Rising(Processor):
    """Alarms if, from a first rise on, the value does not fall for `for_ms` of event time; equal values are neutral."""

    values = {"last": _DOUBLE, "rises": _LONG, "timer": _LONG}

    def __init__(self, for_ms: int = 10_000):
        self.for_ms = for_ms

    def on_event(self, ms, seq, value, kind, timers):
        if value is None:
            return
        last, timer = self.get("last"), self.get("timer")
        self.put("last", value)
        if last is None or value == last:
            return
        if value < last:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.drop("timer", "rises")
            return
        self.put("rises", self.get("rises", 0) + 1)
        if timer is None:
            self.put("timer", ms + self.for_ms)
            self.handle.registerTimer(ms + self.for_ms)

    def on_timer(self, ms, timers):
        if self.get("timer") == ms:
            self.emit(ALARM, ms, rises=self.get("rises", 0))
            self.drop("timer")


class RisingNow(Processor):
    """The rising alarm in processing time: for mode ProcessingTime.

    A first rise starts a timer of `for_ms`; a fall deletes it and sets the count of rises to zero; equal values are
    neutral. When it is due with a rise counted, the alarm goes out; the count stays, and the next rise starts a timer.
    """

    values = {"last": _DOUBLE, "rises": _LONG, "timer": _LONG}

    def __init__(self, for_ms: int = 10_000):
        self.for_ms = for_ms

    def on_event(self, ms, seq, value, kind, timers):
        if value is None:
            return
        last, timer = self.get("last"), self.get("timer")
        self.put("last", value)
        if last is None or value == last:
            return
        if value < last:
            if timer is not None:
                self.handle.deleteTimer(timer)
                self.drop("timer")
            self.put("rises", 0)
            return
        self.put("rises", self.get("rises", 0) + 1)
        if timer is None:
            due = timers.getCurrentProcessingTimeInMs() + self.for_ms
            self.put("timer", due)
            self.handle.registerTimer(due)

    def on_timer(self, ms, timers):
        if self.get("timer") == ms:
            if self.get("rises", 0) >= 1:
                self.emit(ALARM, ms, rises=self.get("rises"))
            self.drop("timer")


class Timed(Processor):
    """The general keyed process function: passes each event on with the watermark, keeps its time, and registers timers; with `cancel`, an event deletes the timer before its own.

    `after_ms` counts from the event's time in mode EventTime and from the clock in mode ProcessingTime; a firing tells its
    time domain. One operator has one domain; a program that needs both runs two.
    """

    values = {"seen": _LONG, "timer": _LONG}

    def __init__(self, after_ms: int = 10_000, domain: str = "EventTime", cancel: bool = False):
        self.after, self.domain, self.cancel = after_ms, domain, cancel

    def on_event(self, ms, seq, value, kind, timers):
        self.emit(MAIN, ms, seq=seq, watermark=timers.getCurrentWatermarkInMs() if self.domain == "EventTime" else None)
        self.put("seen", ms)
        base = ms if self.domain == "EventTime" else timers.getCurrentProcessingTimeInMs()
        if self.cancel and (old := self.get("timer")) is not None:
            self.handle.deleteTimer(old)
        self.put("timer", base + self.after)
        self.handle.registerTimer(base + self.after)

    def on_timer(self, ms, timers):
        self.emit(TIMEOUT, ms, domain=self.domain, seen=self.get("seen"))


class CountWindow(Processor):
    """A tumbling count window: at every `size`-th event, its first event and the sum."""

    values = {"n": _LONG, "first": _LONG, "sum": _DOUBLE}

    def __init__(self, size: int = 3):
        self.size = size

    def on_event(self, ms, seq, value, kind, timers):
        n = self.get("n", 0) + 1
        if n == 1:
            self.put("first", seq)
            self.put("sum", 0.0)
        self.put("sum", self.get("sum") + (value or 0.0))
        if n == self.size:
            self.emit(MAIN, ms, first=self.get("first"), sum=self.get("sum"))
            self.drop("n", "first", "sum")
        else:
            self.put("n", n)


class SlidingCount(Processor):
    """At every `slide`-th event, the first and the sum of the last `size` events at most."""

    values = {"n": _LONG}
    lists = {"rows": _EVENT}

    def __init__(self, size: int = 5, slide: int = 2):
        self.size, self.slide = size, slide

    def on_event(self, ms, seq, value, kind, timers):
        rows = ([tuple(r) for r in self.held["rows"].get()] + [(ms, seq, value, kind)])[-self.size :]
        self.held["rows"].put(rows)
        n = self.get("n", 0) + 1
        self.put("n", n)
        if n % self.slide == 0:
            self.emit(MAIN, ms, first=rows[0][1], sum=sum(r[2] or 0.0 for r in rows), size=len(rows))


class OverRows(Processor):
    """For each event, count and mean over it and the `preceding` ones before it."""

    lists = {"rows": _EVENT}

    def __init__(self, preceding: int = 2):
        self.preceding = preceding

    def on_event(self, ms, seq, value, kind, timers):
        rows = ([tuple(r) for r in self.held["rows"].get()] + [(ms, seq, value, kind)])[-self.preceding - 1 :]
        self.held["rows"].put(rows)
        some = [r[2] for r in rows if r[2] is not None]
        self.emit(MAIN, ms, seq=seq, cnt=len(rows), avg=sum(some) / len(some) if some else None)


class TruncatingSum(Processor):
    """A running sum cut to a whole number at every step."""

    values = {"total": _LONG}

    def on_event(self, ms, seq, value, kind, timers):
        if value is not None:
            total = int(self.get("total", 0) + value)
            self.put("total", total)
            self.emit(MAIN, ms, total=total)


class Counter(Processor):
    """Counts a key's events; keyed by a constant, all events."""

    values = {"n": _LONG}

    def on_event(self, ms, seq, value, kind, timers):
        n = self.get("n", 0) + 1
        self.put("n", n)
        self.emit(MAIN, ms, n=n, length=len(kind or ""))


class RestoredCounter(Processor):
    """Counts a key's events from what earlier tasks had counted: several restored counts, as after a change of parallelism, are added up.

    Initial state: rows (key, n), any number a key, given to `run` as `restored`.
    """

    values = {"n": _LONG}

    def handleInitialState(self, key, initialState, timerValues):
        self.put("n", self.get("n", 0) + int(initialState["n"].sum()))

    def on_event(self, ms, seq, value, kind, timers):
        n = self.get("n", 0) + 1
        self.put("n", n)
        self.emit(MAIN, ms, n=n, length=len(kind or ""))


class KindCounts(Processor):
    """Counts a key's events by kind, in map state."""

    def init(self, handle):
        super().init(handle)
        self.counts = handle.getMapState("counts", T.StructType([T.StructField("k", T.StringType())]), _LONG)

    def on_event(self, ms, seq, value, kind, timers):
        n = (self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0) + 1
        self.counts.updateValue((kind,), (n,))
        self.emit(MAIN, ms, kind=kind, n=n)


class LateRouter(Processor):
    """Tags events behind the watermark. Runs in processing time, where late rows still arrive."""

    def on_event(self, ms, seq, value, kind, timers):
        self.emit(LATE if ms < timers.getCurrentWatermarkInMs() else MAIN, ms, seq=seq)


#: What a trigger may ask for: nothing, a result, a result and an empty window, an empty window.
CONTINUE, FIRE, FIRE_AND_PURGE, PURGE = "continue", "fire", "fire_and_purge", "purge"


class Trigger:
    """When windows fire. This one fires on every event and on processing-time timers, and not when the watermark passes the end.

    `every_ms`: a processing-time timer that far after a window's first event, and again after each firing; None sets none.
    """

    every_ms: int | None = None

    def on_event(self, ms: int, value: float | None, n: int) -> str:
        """`n`: events in the window, this one included."""
        return FIRE

    def on_processing_time(self, n: int) -> str:
        return FIRE

    def on_event_time(self, n: int) -> str:
        return CONTINUE


class CountTrigger(Trigger):
    """Fires at every `n`-th event of a window and empties it."""

    def __init__(self, n: int):
        self.n = n

    def on_event(self, ms, value, n):
        return FIRE_AND_PURGE if n >= self.n else CONTINUE


class EndTrigger(Trigger):
    """Fires once, when the watermark passes the window's end, and empties it."""

    def on_event(self, ms, value, n):
        return CONTINUE

    def on_event_time(self, n):
        return FIRE_AND_PURGE


class EveryTrigger(Trigger):
    """Fires at processing-time intervals."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def on_event(self, ms, value, n):
        return CONTINUE


_WINDOW = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("sum", T.DoubleType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType()),
    T.StructField("first_value", T.DoubleType()), T.StructField("due", T.LongType()),
])


class TriggeredWindow(Processor):
    """Event-time windows of `size_ms` every `slide_ms` that fire as their trigger says, until the watermark passes the end plus `lateness_ms`.

    Before computing, one event, the first, is evicted if a window holds more than `most`. A window's state is its count,
    its sum and its first two events, so an event costs the same however many came before. Events whose windows have
    all closed go to the late side output. One operator has one time mode: processing-time timers need a trigger with
    `every_ms` and run in mode ProcessingTime, where windows close with the first event or timer after their time.
    """

    def __init__(self, size_ms: int = 10_000, slide_ms: int = 5_000, lateness_ms: int = 1_000, most: int = 5, trigger: Trigger | None = None):
        self.size, self.slide, self.lateness, self.most, self.trigger = size_ms, slide_ms, lateness_ms, most, trigger or Trigger()

    def init(self, handle):
        super().init(handle)
        self.windows = handle.getMapState("windows", _LONG, _WINDOW)

    def starts(self, ms: int) -> list[int]:
        last = ms - ms % self.slide
        return [s for s in range(last, ms - self.size, -self.slide)]

    def on_event(self, ms, seq, value, kind, timers):
        now = timers.getCurrentWatermarkInMs()
        live = [s for s in self.starts(ms) if s + self.size + self.lateness > now]
        if not live:
            self.emit(LATE, ms, seq=seq)
            return
        for s in sorted(live):
            there = tuple(self.windows.getValue((s,))) if self.windows.containsKey((s,)) else None
            n, total, first, second, first_value, due = there or (0, 0.0, seq, None, value or 0.0, None)
            if there is None or due is None:
                due = self.set_timers(s, timers)
            second = seq if n == 1 else second
            self.apply(s, (n + 1, total + (value or 0.0), first, second, first_value, due), self.trigger.on_event(ms, value, n + 1))

    def set_timers(self, start: int, timers) -> int | None:
        """A processing-time timer is kept with the window; event-time ones are at its end and at its close."""
        if self.trigger.every_ms is not None:
            due = timers.getCurrentProcessingTimeInMs() + self.trigger.every_ms
            self.handle.registerTimer(due)
            return due
        self.handle.registerTimer(start + self.size)
        self.handle.registerTimer(start + self.size + self.lateness)
        return start + self.size

    def apply(self, start: int, window: tuple, asked: str) -> None:
        n, total, first, second, first_value, due = window
        if asked in (FIRE, FIRE_AND_PURGE) and n:
            out = n > self.most
            self.emit(MAIN, start + self.size, first=second if out else first, n=n - out, sum=total - first_value if out else total)
        if asked in (PURGE, FIRE_AND_PURGE):
            self.windows.removeKey((start,))
        else:
            self.windows.updateValue((start,), window)

    def on_timer(self, ms, timers):
        now = timers.getCurrentWatermarkInMs()
        for (start,), window in [((int(k[0]),), tuple(v)) for k, v in self.windows.iterator()]:
            closed = start + self.size + self.lateness <= (ms if self.trigger.every_ms is None else now)
            if self.trigger.every_ms is not None and window[-1] == ms:
                self.apply(start, (*window[:-1], None if closed else self.set_timers(start, timers)), self.trigger.on_processing_time(window[0]))
            elif self.trigger.every_ms is None and start + self.size == ms:
                self.apply(start, window, self.trigger.on_event_time(window[0]))
            if closed and self.windows.containsKey((start,)):
                self.windows.removeKey((start,))


class Consecutive(Processor):
    """`times` neighbouring events of kind `hit` within `within_ms`; overlapping runs all count."""

    lists = {"run": _EVENT}

    def __init__(self, hit: str = "fail", times: int = 2, within_ms: int = 3_000):
        self.hit, self.times, self.within = hit, times, within_ms

    def on_event(self, ms, seq, value, kind, timers):
        if kind != self.hit:
            self.drop("run")
            return
        run = ([tuple(r) for r in self.held["run"].get()] + [(ms, seq, value, kind)])[-self.times :]
        self.held["run"].put(run)
        if len(run) == self.times and ms - run[0][0] < self.within:
            self.emit(ALARM, ms, first=run[0][0], last=ms, n=self.times)


class FollowedBy(Processor):
    """A `first` event and a later `then` event within `within_ms`: matches, and timeouts of what stays unmatched."""

    lists = {"open": _EVENT}

    def __init__(self, first: str = "create", then: str = "pay", within_ms: int = 30 * 60_000):
        self.first, self.then, self.within = first, then, within_ms

    def on_event(self, ms, seq, value, kind, timers):
        open_ = [tuple(r) for r in self.held["open"].get()]
        if kind == self.first:
            self.held["open"].put([*open_, (ms, seq, value, kind)])
            self.handle.registerTimer(ms + self.within)
        elif kind == self.then and open_:
            for r in open_:
                if ms - r[0] < self.within:
                    self.emit(MAIN, ms, first=r[0], then=ms)
            self.keep([r for r in open_ if ms - r[0] >= self.within])

    def keep(self, rows):
        self.held["open"].put(rows) if rows else self.drop("open")

    def on_timer(self, ms, timers):
        open_ = [tuple(r) for r in self.held["open"].get()]
        for r in open_:
            if r[0] + self.within <= ms:
                self.emit(TIMEOUT, r[0] + self.within, first=r[0])
        self.keep([r for r in open_ if r[0] + self.within > ms])


class Reconciler(Processor):
    """Two sides (kinds `left` and `right`) matched by key; each side holds one event, a newer one replaces it.

    What is unmatched `within_ms` after it came goes to the side output; with None, it waits for ever.
    """

    values = {"left": _LONG, "right": _LONG, "due": _LONG}

    def __init__(self, left: str = "pay", right: str = "receipt", within_ms: int | None = None):
        self.sides, self.within = {left: "left", right: "right"}, within_ms

    def on_event(self, ms, seq, value, kind, timers):
        own = self.sides[kind]
        other = "right" if own == "left" else "left"
        if (there := self.get(other)) is not None and (self.within is None or abs(ms - there) <= self.within):
            self.emit(MAIN, ms, **{own: ms, other: there})
            self.drop("left", "right", "due")
            return
        self.put(own, ms)
        if self.within is not None:
            self.put("due", ms + self.within)
            self.handle.registerTimer(ms + self.within)

    def on_timer(self, ms, timers):
        if self.get("due") != ms:
            return
        for side in ("left", "right"):
            if (at := self.get(side)) is not None:
                self.emit(SIDE, at, side=side)
        self.drop("left", "right", "due")


def run(stream: DataFrame, key: str, processor: Processor, time_mode: str = "EventTime", output_mode: str = "append", event_time: str = "", echo: str = "",
        restored: DataFrame | None = None) -> DataFrame:
    """`processor` over `stream` by `key`. The stream has ts (with a watermark), seq, value and kind; the RocksDB state store must be set.

    event_time: the output column (ts) by which windows may follow. echo: "kind" adds each event's kind to its payload.
    restored: rows (key, ...) of state saved earlier, for processors that take an initial state.
    """
    processor.echo = echo
    events = stream.selectExpr(f"CAST({key} AS STRING) AS _key", "ts", "CAST(seq AS BIGINT) AS seq", "CAST(value AS DOUBLE) AS value", "CAST(kind AS STRING) AS kind")
    return events.groupBy("_key").transformWithStateInPandas(processor, OUTPUT, output_mode, time_mode, None if restored is None else restored.withColumnRenamed("key", "_key").groupBy("_key"), event_time)
