"""Streaming SQL's window syntax, rewritten to Spark SQL.

Group windows TUMBLE(ts, size), HOP(ts, slide, size) and SESSION(ts, gap), their _START and _END functions, the
table functions TABLE(TUMBLE|HOP(TABLE t, DESCRIPTOR(ts), ...)) and COLLECT become window(), session_window(),
sub-queries with window_start and window_end, and collect_list. Text inside quotes that looks like a window call is
rewritten too; keep such text out of the statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_INTERVAL = r"INTERVAL\s+'(\d+)'\s+(\w+)"
_COLUMN = r"([\w.`]+)"


def _length(number: str, unit: str) -> str:
    return f"'{number} {unit.lower()}'"


def _window(kind: str, column: str, lengths: list[str]) -> str:
    if kind == "SESSION":
        return f"session_window({column}, {lengths[0]})"
    return f"window({column}, {', '.join(reversed(lengths))})"  # HOP names the slide before the size


def rewrite(sql: str) -> str:
    """The statement in Spark SQL."""

    def lengths(text: str) -> list[str]:
        return [_length(*m) for m in re.findall(_INTERVAL, text, re.I)]

    def from_table(m: re.Match) -> str:
        window = _window(m[1].upper(), m[3], lengths(m[4]))
        return f"(SELECT *, _w.start AS window_start, _w.end AS window_end FROM (SELECT *, {window} AS _w FROM {m[2]}))"

    def grouped(m: re.Match) -> str:
        call = _window(m[1].upper(), m[3], lengths(m[4]))
        return call + ("." + m[2].lower() if m[2] else "")

    spans = rf"((?:\s*,\s*{_INTERVAL})+)".replace("(\\d+)", "\\d+").replace("(\\w+)", "\\w+")
    sql = re.sub(rf"TABLE\s*\(\s*(TUMBLE|HOP)\s*\(\s*TABLE\s+{_COLUMN}\s*,\s*DESCRIPTOR\s*\(\s*{_COLUMN}\s*\){spans}\s*\)\s*\)", from_table, sql, flags=re.I)
    sql = re.sub(rf"\b(TUMBLE|HOP|SESSION)(?:_(START|END))?\s*\(\s*{_COLUMN}{spans}\s*\)", grouped, sql, flags=re.I)
    return re.sub(r"\bCOLLECT\s*\(", "collect_list(", sql, flags=re.I)


def spark_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(rewrite(sql))
