"""Record schemas, and parsers from text lines with explicit types.

Parsers take a DataFrame with a string column `value` and work alike on batches and streams. Business records carry
epoch seconds, which become the timestamp `ts`; observations carry milliseconds. Fields that do not parse are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def schema(fields: str) -> T.StructType:
    """A struct from "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


OBSERVATION = schema("id int, name string, temperature double, time bigint")
USER_BEHAVIOR = schema("user_id bigint, item_id bigint, category_id int, behavior string, time bigint")
AD_CLICK = schema("user_id bigint, ad_id bigint, province string, city string, time bigint")
LOGIN = schema("user_id bigint, ip string, status string, time bigint")
ORDER = schema("order_id bigint, status string, payment_id string, time bigint")
RECEIPT = schema("payment_id string, channel string, time bigint")

BEHAVIORS = ("pv", "buy", "cart", "fav")
ACCESS_TIME = "dd/MM/yyyy:HH:mm:ss Z"


def parse_csv(lines: DataFrame, fields: T.StructType, millis: bool = False, value: str = "value") -> DataFrame:
    """Positional comma-separated fields, cast to `fields`, with `ts` from its `time` field (kept in milliseconds).

    Short lines leave the missing fields null; empty fields of string type stay empty.
    """
    parts = F.split(F.col(value), ",", -1)
    cell = lambda i, f: F.get(parts, i) if isinstance(f.dataType, T.StringType) else F.trim(F.get(parts, i)).try_cast(f.dataType)
    out = lines.select(*[cell(i, f).alias(f.name) for i, f in enumerate(fields.fields)])
    time = F.col("time") if millis else F.col("time") * 1000
    return out.withColumn("time", time).withColumn("ts", F.timestamp_millis("time"))


def parse_behavior(lines: DataFrame) -> DataFrame:
    """User behaviour with unknown actions as null."""
    out = parse_csv(lines, USER_BEHAVIOR)
    return out.withColumn("behavior", F.when(F.col("behavior").isin(*BEHAVIORS), F.col("behavior")))


def parse_access_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Space-separated access lines: ip ident user time zone method url, and `parse_error` (null where all went well).

    Fewer than six tokens are malformed; six tokens (no url) or an unreadable time fail to parse.
    """
    parts = F.split(F.trim(F.col(value)), "\\s+")
    moment = F.try_to_timestamp(F.concat_ws(" ", F.get(parts, 3), F.get(parts, 4)), F.lit(ACCESS_TIME))
    names = ("ip", "ident", "auth_user", "log_time", "time_zone", "method", "url")
    error = F.when(F.size(parts) < 6, F.concat(F.lit("Malformed line: "), F.col(value))).when(
        F.get(parts, 6).isNull() | moment.isNull(), F.concat(F.lit("Parsing failed: "), F.col(value))
    )
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], moment.alias("ts"), error.alias("parse_error"))


def routed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the error rows."""
    return parsed.where("parse_error IS NULL").drop("parse_error"), parsed.where("parse_error IS NOT NULL").select("parse_error")


def tokens(lines: DataFrame, pattern: str = "\\s+", value: str = "value") -> DataFrame:
    """One row `word` for each non-empty token; null lines give none."""
    return lines.select(F.explode(F.split(F.col(value), pattern)).alias("word")).where(F.trim("word") != "")


def key_value(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(key).cast("string").alias("key"), as_column(value).cast("string").alias("value"))


def behavior_by_name(name: str | Column) -> Column:
    """The action of an upper-case name; null for blank or unknown names."""
    table = F.create_map(*[x for b in BEHAVIORS for x in (F.lit(b.upper()), F.lit(b))])
    return F.try_element_at(table, F.upper(F.trim(F.col(name) if isinstance(name, str) else name)))


def sensor_text(sensor: Column, name: Column, temperature: Column) -> Column:
    """A readable line; any missing part makes the reading invalid."""
    line = F.format_string("Sensor[id=%d, name=%s, temp=%.2f°C]", sensor, name, temperature)
    return F.when(sensor.isNull() | name.isNull() | temperature.isNull(), F.lit("Invalid Sensor Data")).otherwise(line)


def random_int(most: int, seed: int | None = None) -> Column:
    """A whole number from 1 to `most`."""
    if most <= 0:
        raise ValueError("the largest number must be above 0")
    return (F.floor(F.rand(seed) * most) + 1).cast("int")


def merged_counts(left: Column, right: Column) -> Column:
    """Two maps of counts, added key by key."""
    both = F.array_distinct(F.concat(F.map_keys(left), F.map_keys(right)))
    total = lambda k: F.coalesce(F.try_element_at(left, k), F.lit(0)) + F.coalesce(F.try_element_at(right, k), F.lit(0))
    return F.map_from_arrays(both, F.transform(both, total))
