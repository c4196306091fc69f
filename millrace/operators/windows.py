"""Time windows, count windows and row frames.

Time windows are half-open and aligned to the epoch; `window_end` is their end. They work on batches and streams.
Count windows and row frames are for batches; `streaming.processors` has their streaming forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arriving(df: DataFrame, ts: str = "ts") -> DataFrame:
    """`df` with the time of processing as its time: what processing-time windows group by."""
    return df.withColumn(ts, F.current_timestamp())


def tumble(df: DataFrame, keys: list[str], size: str, aggs: list[Column], ts: str = "ts") -> DataFrame:
    return _grouped(df, keys, F.window(ts, size), aggs)


def hop(df: DataFrame, keys: list[str], size: str, slide: str, aggs: list[Column], ts: str = "ts") -> DataFrame:
    return _grouped(df, keys, F.window(ts, size, slide), aggs)


def hop_sums(df: DataFrame, keys: list[str], size: str, slide: str, sums: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Sliding windows of sums by panes: rows are added up once a slide, and the panes, not the rows, are then dealt to the windows they lie in.

    `slide` divides `size`; a count is the sum of ones.
    """
    pane = df.groupBy(*keys, F.window(ts, slide)["start"].alias("_pane")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    first = F.col("_pane") - F.expr(f"INTERVAL '{size}'") + F.expr(f"INTERVAL '{slide}'")
    dealt = pane.withColumn("window_start", F.explode(F.sequence(first, F.col("_pane"), F.expr(f"INTERVAL '{slide}'"))))
    out = dealt.groupBy(*keys, "window_start").agg(*[F.sum(n).alias(n) for n in sums])
    return out.select(*keys, "window_start", (F.col("window_start") + F.expr(f"INTERVAL '{size}'")).alias("window_end"), *sums)


def averages_text(df: DataFrame, key: str, size: str, value: str, ts: str = "ts", bounds: bool = False) -> DataFrame:
    """(key, window_end, info): a full window's average as text; with `bounds`, the window's edges in milliseconds too. Nulls are passed over, nothing gives 0."""
    out = tumble(df, [key], size, [F.avg(value).alias("_avg")], ts)
    edges = F.format_string(", Window [%d,%d]", *[F.unix_millis(F.col(c).cast("timestamp")) for c in ("window_start", "window_end")]) if bounds else F.lit("")
    text = F.concat(F.lit("Key: "), F.col(key).cast("string"), edges, F.lit(", AvgTemp: "), F.coalesce("_avg", F.lit(0.0)).cast("string"))
    return out.select(key, "window_end", text.alias("info"))


def _grouped(df: DataFrame, keys: list[str], window: Column, aggs: list[Column]) -> DataFrame:
    out = df.groupBy(*keys, window.alias("window")).agg(*aggs)
    return out.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "window")])


def session(df: DataFrame, keys: list[str], gap: str, aggs: list[Column], ts: str = "ts") -> DataFrame:
    """Sessions of each key; events exactly one gap apart belong together."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(*aggs)
    return out.select(*keys, F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), *[c for c in out.columns if c not in (*keys, "window")])


def with_window(df: DataFrame, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """All columns plus window_start and window_end: the table-valued form."""
    placed = df.withColumn("_w", F.window(ts, size, slide) if slide else F.window(ts, size))
    return placed.select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def count_windows(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """`df` with (window_no, position) of full windows of `size` rows a key; rows of an unfilled window go."""
    by = Window.partitionBy(*keys)
    n = F.row_number().over(by.orderBy(*order))
    numbered = df.withColumn("_n", n).withColumn("_total", F.count("*").over(by))
    full = numbered.where(F.col("_n") <= F.col("_total") - F.col("_total") % size)
    return full.select(*df.columns, F.floor((F.col("_n") - 1) / size).cast("bigint").alias("window_no"), (F.pmod(F.col("_n") - 1, F.lit(size)) + 1).alias("position"))


def sliding_count(df: DataFrame, keys: list[str], order: list[str], size: int, slide: int, aggs: dict[str, Column]) -> DataFrame:
    """A row at every `slide`-th arrival of a key, aggregated over its last `size` rows at most; `aggs` are aggregate columns by name."""
    by = Window.partitionBy(*keys).orderBy(*order)
    frame = by.rowsBetween(-(size - 1), Window.currentRow)
    framed = df.withColumn("firing", F.row_number().over(by)).withColumns({name: agg.over(frame) for name, agg in aggs.items()})
    return framed.where(F.col("firing") % slide == 0).withColumn("firing", (F.col("firing") / slide).cast("bigint"))


def behind_watermark(df: DataFrame, keys: list[str], order: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """`df` with `mark`, the watermark as each row of a key arrives (the latest time so far less `delay`), and `late`, whether the row is behind it.

    A batch replay of what a stream would call late; without keys all rows are ordered in one task, for small inputs.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("mark", F.max(ts).over(so_far) - F.expr(f"INTERVAL '{delay}'"))
    return marked.withColumn("late", F.col(ts) < F.col("mark"))


def evicted(rows: Column, most: int = 5) -> Column:
    """A window's ordered rows after eviction: one row, the first, goes if there are more than `most`."""
    return F.when(F.size(rows) > most, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)


def over_rows(df: DataFrame, keys: list[str], order: list[str], preceding: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the current row and the `preceding` ones before it."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-preceding, Window.currentRow)
    return df.withColumns({name: agg.over(frame) for name, agg in aggs.items()})
