"""Top-k rows of groups. Ties are broken by the given columns, so results are stable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "row_num") -> DataFrame:
    """The first k rows of each group: Catalyst keeps k rows a group and task before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_values(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k largest values of each key, with ranks from 1; nulls are passed over."""
    some = df.where(F.col(value).isNotNull()).select(*keys, value)
    return top_rows(some, keys, [F.desc(value)], k, "rank")


def top_of_window(counts: DataFrame, size_in: str, item: str, count: str, k: int, parts: int = 32) -> DataFrame:
    """Streaming form over window counts: (window_end, items) with the k largest (count, item), largest first.

    `counts` has a `window` column; `size_in` is the slide of those windows, at which their ends are told apart. A
    window's items are first dealt to `parts` groups, each of which passes its k largest on: no task gets them all.
    """
    pair = F.struct(F.col(count).alias("count"), F.col(item).alias("item"))
    largest = lambda pairs: F.slice(F.sort_array(pairs, asc=False), 1, k).alias("items")
    part = F.pmod(F.xxhash64(item), F.lit(parts)).alias("part")
    by_part = counts.groupBy(F.window(F.window_time("window"), size_in).alias("p"), part).agg(largest(F.collect_list(pair)))
    by_end = by_part.groupBy(F.window(F.window_time("p"), size_in).alias("w")).agg(largest(F.flatten(F.collect_list("items"))))
    return by_end.select(F.col("w.end").alias("window_end"), "items")


def ordered_pairs(pairs, largest_first: bool = True):
    """An array of (count, key) structs in order of count, ties by key."""
    sign = -1 if largest_first else 1
    return F.array_sort(pairs, lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] * sign < b["count"] * sign, -1).otherwise(1)).otherwise(F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
