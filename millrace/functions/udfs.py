"""User-defined functions under their SQL names: scalar, table, aggregate, and top-two table aggregate.

Each has a built-in form, which plans should prefer; the Python forms serve SQL text that names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.records import sensor_text
from millrace.operators.topk import top_values


@F.pandas_udf(T.StringType())
def format_info(sensor: pd.Series, name: pd.Series, temperature: pd.Series) -> pd.Series:
    """Arrow-batched form of `sensor_text`."""
    rows = zip(sensor, name, temperature, strict=True)
    return pd.Series(["Invalid Sensor Data" if pd.isna(s) or n is None or pd.isna(t) else f"Sensor[id={int(s)}, name={n}, temp={t:.2f}°C]" for s, n, t in rows])


@F.udtf(returnType=T.StructType([T.StructField("fname", T.StringType()), T.StructField("len", T.IntegerType())]))
class NameTable:
    """One row for a name: the name with a prefix, and its length; none for null."""

    def eval(self, name: str) -> Iterator[tuple[str, int]]:
        if name is not None:
            yield f"new:{name}", len(name)


@F.pandas_udf(T.DoubleType())
def average(values: pd.Series) -> float:
    """Sum over count; nulls are passed over, nothing gives null."""
    return values.mean() if values.notna().any() else None


def name_struct(name: Column) -> Column:
    """Built-in form of NameTable."""
    return F.struct(F.concat(F.lit("new:"), name).alias("fname"), F.length(name).alias("len"))


def register(spark: SparkSession) -> None:
    spark.udf.register("format_info", format_info)
    spark.udf.register("average", average)
    spark.udtf.register("name_table", NameTable)


def format_info_builtin(df: DataFrame, sensor: str, name: str, temperature: str) -> DataFrame:
    return df.withColumn("info", sensor_text(F.col(sensor), F.col(name), F.col(temperature)))


def top_two(df: DataFrame, key: str, value: str) -> DataFrame:
    """The table aggregate: the two largest values of each key, ties kept apart, with their rank."""
    return top_values(df, [key], value, 2)
