"""Event patterns over batches: consecutive events, followed-by with timeouts, reconciliation, alarms, limits.

`order` lists the columns that order a key's events. Times are timestamps; `within` and `tolerance` are interval
strings. A pattern must end strictly within its interval.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _span(text: str) -> Column:
    return F.expr(f"INTERVAL '{text}'")


def consecutive(df: DataFrame, key: str, order: list[str], hit: Column, times: int, within: str, ts: str = "ts") -> DataFrame:
    """(key, first_ts, last_ts, n): every run of `times` neighbouring events that all satisfy `hit`, overlapping runs included."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = df.select(key, *dict.fromkeys([*order, ts]), hit.alias("_hit"))
    ahead = marked.withColumn("_hits", F.sum(F.col("_hit").cast("int")).over(by.rowsBetween(0, times - 1))).withColumn("last_ts", F.lead(ts, times - 1).over(by))
    found = ahead.where((F.col("_hits") == times) & F.col("last_ts").isNotNull() & (F.col("last_ts") < F.col(ts) + _span(within)))
    return found.select(key, F.col(ts).alias("first_ts"), "last_ts", F.lit(times).cast("bigint").alias("n"))


def followed_by(df: DataFrame, key: str, order: list[str], first: Column, then: Column, within: str, carry: dict[str, str] | None = None, ts: str = "ts") -> DataFrame:
    """For every `first` event, the earliest later `then` event of its key: (key, first_ts, then_ts, matched, timeout_ts).

    `carry` names columns of the second event to keep (old name: new name). Relaxed contiguity: other events may
    stand between. Unmatched events carry the time at which they time out.
    """
    carry = carry or {}
    # from the last event back: the frame then only grows, and a key of n events takes n steps
    ahead = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(then, F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in carry])), ignorenulls=True).over(ahead)
    opened = df.withColumn("_then", later).where(first)
    inside = F.coalesce(F.col("_then.ts") < F.col(ts) + _span(within), F.lit(False))
    kept = lambda name: F.when(inside, F.col(f"_then.{name}"))
    return opened.select(
        key, F.col(ts).alias("first_ts"), kept("ts").alias("then_ts"), *[kept(c).alias(n) for c, n in carry.items()], inside.alias("matched"),
        F.when(~inside, F.col(ts) + _span(within)).alias("timeout_ts"),
    )


def reconcile(left: DataFrame, right: DataFrame, key: str, tolerance: str | None = None, ts: str = "ts") -> DataFrame:
    """Full outer match of two sides on `key`: (key, left_ts, right_ts, side) with side both, left or right.

    With a tolerance, pairs further apart count as a left and a right row of their own.
    """
    a = left.select(F.col(key), F.col(ts).alias("left_ts"))
    b = right.select(F.col(key).alias("_key"), F.col(ts).alias("right_ts"))
    on = F.col(key) == F.col("_key")
    if tolerance:
        gap = _span(tolerance)
        on = on & (F.col("left_ts") <= F.col("right_ts") + gap) & (F.col("right_ts") <= F.col("left_ts") + gap)
    side = F.when(F.col("_key").isNull(), "left").when(F.col(key).isNull(), "right").otherwise("both")
    return a.join(b, on, "full_outer").select(F.coalesce(key, "_key").alias(key), "left_ts", "right_ts", side.alias("side"))


def jumps(df: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """Events whose value differs from the key's last one by more than `threshold`: with last_value and value."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("last_value", last).where(F.abs(F.col(value) - F.col("last_value")) > threshold)


def rising_runs(df: DataFrame, key: str, order: list[str], value: str, at_least: str, ts: str = "ts") -> DataFrame:
    """Runs in which the value never falls, that rise at least once and last `at_least` from their first rise on.

    (key, first_rise, last_ts, rises): an event-time form of the rising alarm. A fall ends a run, equal values don't count.
    """
    by = Window.partitionBy(key).orderBy(*order)
    change = F.signum(F.col(value) - F.lag(value).over(by))
    stepped = df.withColumn("_c", F.coalesce(change, F.lit(0.0)))
    run = stepped.withColumn("_run", F.sum((F.col("_c") < 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rise = F.when(F.col("_c") > 0, F.col(ts))
    out = run.groupBy(key, "_run").agg(F.min(rise).alias("first_rise"), F.max(ts).alias("last_ts"), F.count(rise).alias("rises"))
    return out.where(F.col("first_rise") + _span(at_least) <= F.col("last_ts")).drop("_run")


def limited(df: DataFrame, keys: list[str], order: list[str], most: int, keep_dropped: bool = False, reset: timedelta | None = None, ts: str = "ts") -> DataFrame:
    """`df` with `click_no` and `tag`: pass for the first `most` rows of a key and alarm for the next one.

    With `reset`, a key's count starts anew with its first row at or after that time since the count's first row
    (`order` must then begin with `ts`; rows without a time count together). Periods follow from one another, so a key's
    rows are numbered in one ordered pass, in Arrow batches of bounded size. Without `reset` the count goes on for ever;
    rows beyond the limit then go before the exchange, so that a hot key sends at most `most` + 1 rows a task; with
    `keep_dropped` they stay, tagged drop.
    """
    numbered = df.withColumn("click_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if reset is not None:
        numbered = _by_period(numbered, reset, ts)
    if not keep_dropped:
        numbered = numbered.where(F.col("click_no") <= most + 1)
    tag = F.when(F.col("click_no") <= most, "pass").when(F.col("click_no") == most + 1, "alarm").otherwise("drop")
    return numbered.withColumn("click_no", F.col("click_no").cast("bigint")).withColumn("tag", tag)


def _by_period(numbered: DataFrame, reset: timedelta, ts: str) -> DataFrame:
    """`click_no` counted within periods; rows come by key and in order, each key's first with number 1."""
    span, never = reset // timedelta(microseconds=1), -(1 << 62)
    timed = numbered.withColumn("_micros", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(never)))
    schema = T.StructType([*[f for f in numbered.schema.fields if f.name != "click_no"], T.StructField("click_no", T.IntegerType())])

    def run(batches):
        start, count = 0, 0  # of the open period
        for batch in batches:
            number, at = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("click_no", "_micros"))
            out = number.astype(np.int32)
            firsts = np.flatnonzero(number == 1)
            bounds = np.unique(np.concatenate(([0], firsts, [len(number)])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if number[a] == 1:
                    start, count = int(at[a]), 0
                while a < b:
                    if at[a] >= start + span:
                        start, count = int(at[a]), 0
                    end = b if at[b - 1] < start + span else a + int(np.searchsorted(at[a:b], start + span))
                    out[a:end] = np.arange(count + 1, count + 1 + end - a)
                    count += end - a
                    a = end
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=schema.names)

    return timed.mapInArrow(run, schema)
