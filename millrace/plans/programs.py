"""The runnable programs: text lines in, named result tables out.

A program takes the lines of its input (a batch or a stream, column `value`) and a JobConfig and returns DataFrames by
name: "main" and its side outputs. Batches use the batch operators; streams use built-in streaming operators or, where
those can't say it, the stateful processors.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import records
from millrace.operators import aggregates, patterns
from millrace.sources import readers
from millrace.sources.config import JobConfig
from millrace.streaming import jobs, processors


def _seconds(n: int) -> str:
    return f"{n} seconds"


def hot_items(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    behaviors = records.parse_behavior(lines)
    return {"main": jobs.hot_items(behaviors, c.watermark, c.top, _seconds(c.window), _seconds(c.slide))}


def pv_uv(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    return {"main": jobs.pv_uv(records.parse_behavior(lines), c.watermark, _seconds(c.window))}


def hot_pages(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    good, bad = records.routed(records.parse_access_log(lines))
    return {"main": jobs.grouped_counts(good.select("ts", "ip", "url"), "ip", "url", c.watermark, _seconds(c.window), _seconds(c.slide), c.top), "errors": bad}


def _events(df: DataFrame, value: Column, kind: Column, ooo: str) -> DataFrame:
    """What the processors read; a stream has no row numbers, so rows of one instant keep their order of arrival."""
    seq = F.lit(0) if df.isStreaming else F.monotonically_increasing_id()
    return jobs.marked(df.withColumns({"seq": seq.cast("bigint"), "value": value.cast("double"), "kind": kind}), ooo)


def ads_by_province(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    """Clicks by province and ad, less those beyond a user's limit for an ad in 24 hours; alarms aside."""
    most = int(c.extra.get("limit", 10))
    clicks = records.parse_csv(lines, records.AD_CLICK)
    if lines.isStreaming:
        keyed = _events(clicks.withColumn("key", F.concat_ws(":", "user_id", "ad_id")), F.lit(0.0), F.col("province"), c.watermark)
        tagged = processors.run(keyed, "key", processors.Limiter(most), event_time="ts", echo="kind")
        parts = F.split("key", ":")
        rows = tagged.select("tag", "ts", F.get(parts, 0).cast("bigint").alias("user_id"), F.get(parts, 1).cast("bigint").alias("ad_id"), F.get_json_object("payload", "$.kind").alias("province"))
    else:
        numbered = clicks.withColumn("seq", F.monotonically_increasing_id())
        rows = patterns.limited(numbered, ["user_id", "ad_id"], ["ts", "seq"], most, reset=timedelta(hours=24)).withColumn("tag", F.when(F.col("tag") == "pass", processors.MAIN).otherwise(F.col("tag")))
    kept = rows.where(F.col("tag") == processors.MAIN).select("ts", "province", "ad_id")
    size = F.window("ts", _seconds(c.window))
    if lines.isStreaming:
        main = kept.groupBy(size.alias("w"), "province", "ad_id").agg(F.count("*").alias("count")).select(F.col("w.end").alias("window_end"), "province", "ad_id", "count")
    else:
        main = aggregates.counts_by(kept, [size.alias("w"), "province"], "ad_id").select(F.col("w.end").alias("window_end"), "province", "total", "pairs")
    return {"main": main, "alarms": rows.where(F.col("tag") == processors.ALARM).select("user_id", "ad_id", "ts")}


def login_alarm(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    times, within = int(c.extra.get("times", 2)), int(c.extra.get("within", 3))
    logins = records.parse_csv(lines, records.LOGIN)
    if lines.isStreaming:
        events = _events(logins, F.lit(0.0), F.col("status"), c.watermark)
        return {"main": processors.run(events, "user_id", processors.Consecutive("fail", times, within * 1000))}
    ordered = logins.withColumn("seq", F.monotonically_increasing_id())
    return {"main": patterns.consecutive(ordered, "user_id", ["ts", "seq"], F.col("status") == "fail", times, _seconds(within))}


def order_payment(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    within = int(c.extra.get("within", 1800))
    orders = records.parse_csv(lines, records.ORDER)
    if lines.isStreaming:
        events = _events(orders, F.lit(0.0), F.col("status"), c.watermark)
        out = processors.run(events, "order_id", processors.FollowedBy("create", "pay", within * 1000))
        return {"main": out.where(F.col("tag") == processors.MAIN), "timeouts": out.where(F.col("tag") == processors.TIMEOUT)}
    ordered = orders.withColumn("seq", F.monotonically_increasing_id())
    out = patterns.followed_by(ordered, "order_id", ["ts", "seq"], F.col("status") == "create", F.col("status") == "pay", _seconds(within), {"payment_id": "payment_id"})
    return {"main": out.where("matched").drop("matched", "timeout_ts"), "timeouts": out.where("NOT matched").select("order_id", "first_ts", "timeout_ts")}


def reconciliation(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    """Orders against receipts: lines of both kinds come mixed; order lines have four fields, receipts three.

    Without `within` in the settings any gap matches, as no timer ends the wait.
    """
    within = c.extra.get("within")
    count = F.size(F.split("value", ",", -1))
    pays = records.parse_csv(lines.where(count == 4), records.ORDER).where("status = 'pay' AND payment_id != ''").select("payment_id", "ts")
    receipts = records.parse_csv(lines.where(count == 3), records.RECEIPT).select("payment_id", "ts")
    if lines.isStreaming:
        both = pays.withColumn("side", F.lit("pay")).unionByName(receipts.withColumn("side", F.lit("receipt")))
        events = _events(both, F.lit(0.0), F.col("side"), c.watermark)
        out = processors.run(events, "payment_id", processors.Reconciler(within_ms=None if within is None else int(within) * 1000))
        return {"main": out.where(F.col("tag") == processors.MAIN), "unmatched": out.where(F.col("tag") == processors.SIDE)}
    out = patterns.reconcile(pays, receipts, "payment_id", None if within is None else _seconds(int(within)))
    return {"main": out.where("side = 'both'"), "unmatched": out.where("side != 'both'")}


def app_market(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    """Behaviours counted by channel; the channel is the line's category."""
    behaviors = records.parse_behavior(lines).withColumn("channel", F.col("category_id"))
    return {"main": jobs.app_market(behaviors, c.watermark, _seconds(c.window))}


def word_count(lines: DataFrame, c: JobConfig) -> dict[str, DataFrame]:
    return {"main": jobs.word_count(lines)}


PROGRAMS: dict[str, Callable[[DataFrame, JobConfig], dict[str, DataFrame]]] = {
    f.__name__: f for f in (hot_items, pv_uv, hot_pages, ads_by_province, login_alarm, order_payment, reconciliation, app_market, word_count)
}


def lines_of(spark: SparkSession, c: JobConfig, streaming: bool) -> DataFrame:
    """From files if the settings name an input, else from a Kafka topic, else from a socket."""
    if c.input:
        return readers.text_lines(spark, c.input, streaming)
    if c.topic:
        return readers.kafka_lines(spark, f"{c.host}:{c.port}", c.topic, "latest", c.group or None, c.partitions)
    return readers.socket_lines(spark, c.host, c.port)
