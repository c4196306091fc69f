"""Aggregations that need more than one built-in: two-level counts, exact distinct users, ordered folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pv_uv(df: DataFrame, user: str, window: Column) -> DataFrame:
    """(window, pv, uv): views and distinct users. Level one groups by window and user, which spreads hot windows and works on streams."""
    per_user = df.groupBy(window.alias("window"), user).agg(F.count("*").alias("n"))
    return per_user.groupBy("window").agg(F.sum("n").alias("pv"), F.count("*").alias("uv"))


def counts_by(df: DataFrame, outer: list[Column | str], inner: str) -> DataFrame:
    """Counts of `inner` within `outer`, as an array of (count, key), largest first; `total` is the sum."""
    outer = [F.col(c) if isinstance(c, str) else c for c in outer]
    first = df.groupBy(*outer, F.col(inner).alias("key")).agg(F.count("*").alias("count"))
    names = [c for c in first.columns if c not in ("key", "count")]
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("minus"), "key")))
    listed = first.groupBy(*names).agg(F.sum("count").alias("total"), pairs.alias("pairs"))
    return listed.withColumn("pairs", F.transform("pairs", lambda p: F.struct((-p["minus"]).alias("count"), p["key"].alias("key"))))


def first_of(*order: str) -> Column:
    """The first row of a group in the given order, as a struct: the reduce that keeps its left argument."""
    return F.min_by(F.struct("*"), F.struct(*order))


def truncating_sum(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, total): a running sum of a key's ordered values that is cut to a whole number at every step.

    A key's rows are held in one array; `truncating_sum_by_batches` is for keys too large for that.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    fold = F.aggregate(rows, F.lit(0), lambda total, row: (total + row["_value"]).cast("int"))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(fold.alias("total"))


def truncating_sum_by_batches(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """`truncating_sum` for hot keys. Each step needs the one before, so a key's rows pass through one task in order, in Arrow batches, but only the total is held."""
    by = Window.partitionBy(key).orderBy(*order, value)
    numbered = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(by))
    rows = numbered.select(key, F.col(value).cast("double").alias("_value"), "_n")
    schema = T.StructType([rows.schema[key], T.StructField("total", T.IntegerType())])

    def run(batches):
        held, total = None, 0  # the open key, as an array of one
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, totals, values = [], [], batch.column(1).to_numpy()
            number = batch.column(2).to_numpy()
            starts = np.union1d([0], np.flatnonzero(number == 1)).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if number[a] == 1:
                    if held is not None:
                        keys.append(held)
                        totals.append(total)
                    held, total = batch.column(0).slice(a, 1), 0
                for v in values[a:b].tolist():
                    total = int(total + v)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(totals, pa.int32())], names=schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([held, pa.array([total], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that satisfy the condition, and the others (nulls among them)."""
    yes = F.coalesce(condition, F.lit(False))
    return df.where(yes), df.where(~yes)
