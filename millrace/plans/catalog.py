"""The registered queries and their DuckDB equivalents.

Every query runs over whole tables. Events stand in for the record streams: an event's type is its action, its user
the item, address or key. Orders of rows end in event_id, so that results do not depend on the plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import records, udfs
from millrace.operators import aggregates, partitioning, patterns, topk, windows
from millrace.operators.spread import scratch
from millrace.plans.window_sql import spark_sql
from millrace.sinks import writers
from millrace.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["ts", "event_id"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.where(F.col("event_type") == kind) if kind else df


def joined_pairs(pairs: str) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["count"])), ",")


HOP = "SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) + to_minutes(5 * (k + 1)::BIGINT) AS window_end FROM events, range(12) r(k)"


@query(f"""
WITH hops AS ({HOP}), counts AS (SELECT window_end, user_id AS item_id, count(*) AS view_count FROM hops WHERE event_type = 'view' GROUP BY ALL)
SELECT window_end, item_id, view_count, row_number() OVER (PARTITION BY window_end ORDER BY view_count DESC, item_id) AS row_num
FROM counts QUALIFY row_num <= 5""")
def hot_items_top5(spark, sf_dir):
    views = events(spark, sf_dir, "view").select("ts", F.col("user_id").alias("item_id"))
    counts = windows.hop_sums(views, ["item_id"], "1 hour", "5 minutes", {"view_count": F.lit(1).cast("bigint")})
    ranked = topk.top_rows(counts, ["window_end"], [F.desc("view_count"), "item_id"], 5)
    return ranked.select("window_end", "item_id", "view_count", F.col("row_num").cast("bigint").alias("row_num"))


@query(f"""
WITH hops AS ({HOP}), counts AS (SELECT window_end, user_id AS item_id, count(*) AS view_count FROM hops WHERE event_type = 'view' GROUP BY ALL)
SELECT window_end, item_id, view_count FROM counts QUALIFY row_number() OVER (PARTITION BY window_end ORDER BY view_count DESC, item_id) <= 5""")
def hot_items_sql(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("mr_behavior")
    spark_sql(spark, """
        SELECT user_id AS item_id, count(*) AS view_count, HOP_END(ts, INTERVAL '5' MINUTE, INTERVAL '1' HOUR) AS window_end
        FROM mr_behavior WHERE event_type = 'view' GROUP BY user_id, HOP(ts, INTERVAL '5' MINUTE, INTERVAL '1' HOUR)""").createOrReplaceTempView("mr_item_counts")  # fmt: skip
    return spark_sql(spark, """
        SELECT window_end, item_id, view_count FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY window_end ORDER BY view_count DESC, item_id) AS row_num FROM mr_item_counts)
        WHERE row_num <= 5""")


@query("""
SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS pv, count(DISTINCT user_id) AS uv
FROM events WHERE event_type = 'view' GROUP BY 1""")
def pv_uv_hourly(spark, sf_dir):
    out = aggregates.pv_uv(events(spark, sf_dir, "view"), "user_id", F.window("ts", "1 hour"))
    return out.select(F.col("window.end").alias("window_end"), "pv", "uv")


@query("""
SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS pv, count(DISTINCT user_id) AS uv
FROM events WHERE event_type = 'view' GROUP BY 1""")
def pv_uv_sql(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("mr_behavior")
    return spark_sql(spark, """
        SELECT TUMBLE_END(ts, INTERVAL '1' HOUR) AS window_end, COUNT(*) AS pv, COUNT(DISTINCT user_id) AS uv
        FROM mr_behavior WHERE event_type = 'view' GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)""")


GROUPED = """
counts AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, user_id % 7 AS province, user_id AS ad, count(*) AS n FROM {source} GROUP BY ALL)
SELECT window_end, province, sum(n)::BIGINT AS total, string_agg(ad || '=' || n, ',' ORDER BY n DESC, ad) AS ads FROM counts GROUP BY ALL"""
#: A count starts with a key's first click, and anew with the first one 24 hours later or more.
LIMITED = """RECURSIVE clicks AS (SELECT * FROM events WHERE event_type = 'click'),
starts AS (
  SELECT user_id, event_type, min(ts) AS start FROM clicks GROUP BY ALL UNION ALL
  SELECT s.user_id, s.event_type, min(c.ts) AS start FROM starts AS s JOIN clicks AS c ON c.user_id = s.user_id AND c.event_type = s.event_type AND c.ts >= s.start + INTERVAL 24 HOURS GROUP BY ALL),
numbered AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.event_type, s.start ORDER BY c.ts, c.event_id) AS click_no
  FROM clicks AS c ASOF JOIN starts AS s ON c.user_id = s.user_id AND c.event_type = s.event_type AND c.ts >= s.start)"""


def _by_province(clicks: DataFrame) -> DataFrame:
    placed = clicks.select("ts", (F.col("user_id") % 7).alias("province"), F.col("user_id").alias("ad"))
    out = aggregates.counts_by(placed, [F.window("ts", "1 hour").alias("window"), "province"], "ad")
    return out.select(F.col("window.end").alias("window_end"), "province", "total", joined_pairs("pairs").alias("ads"))


@query("WITH " + GROUPED.format(source="events WHERE event_type = 'click'"))
def ad_clicks_by_province(spark, sf_dir):
    return _by_province(events(spark, sf_dir, "click"))


@query("WITH " + GROUPED.format(source="events WHERE event_type = 'click'"))
def ad_clicks_by_province_sql(spark, sf_dir):
    events(spark, sf_dir, "click").createOrReplaceTempView("mr_clicks")
    counts = spark_sql(spark, """
        SELECT window_end, user_id % 7 AS province, user_id AS ad, COUNT(*) AS n
        FROM TABLE(TUMBLE(TABLE mr_clicks, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_end, user_id % 7, user_id""")  # fmt: skip
    counts.createOrReplaceTempView("mr_ad_counts")
    return spark_sql(spark, """
        SELECT window_end, province, SUM(n) AS total, array_join(transform(sort_array(COLLECT(struct(-n AS m, ad AS ad))), x -> x.ad || '=' || CAST(-x.m AS STRING)), ',') AS ads
        FROM mr_ad_counts GROUP BY window_end, province""")


LIMIT = 2


def _limited(spark, sf_dir) -> DataFrame:
    """Clicks tagged by a limit of LIMIT in 24 hours and key: low enough that the given tables reach it."""
    clicks = events(spark, sf_dir, "click").select("event_id", "ts", "user_id", "event_type")
    return patterns.limited(clicks, ["user_id", "event_type"], ORDER, LIMIT, reset=timedelta(hours=24))


@query(f"WITH {LIMITED}, " + GROUPED.format(source=f"numbered WHERE click_no <= {LIMIT}"))
def ad_clicks_limited_by_province(spark, sf_dir):
    return _by_province(_limited(spark, sf_dir).where("tag = 'pass'"))


@query(f"WITH {LIMITED} SELECT event_id, user_id, click_no FROM numbered WHERE click_no <= {LIMIT}")
def ad_click_limited(spark, sf_dir):
    return _limited(spark, sf_dir).where("tag = 'pass'").select("event_id", "user_id", "click_no")


@query(f"WITH {LIMITED} SELECT user_id, event_type AS ad, ts AS alarm_ts FROM numbered WHERE click_no = {LIMIT + 1}")
def ad_click_alarm(spark, sf_dir):
    return _limited(spark, sf_dir).where("tag = 'alarm'").select("user_id", F.col("event_type").alias("ad"), F.col("ts").alias("alarm_ts"))


@query("""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS click_no FROM events WHERE event_type = 'click')
SELECT event_id, user_id, click_no FROM numbered WHERE click_no <= 10""")
def ad_click_limited_for_ever(spark, sf_dir):
    """The limit without a reset, which keeps a few rows a key and task before the exchange."""
    return patterns.limited(events(spark, sf_dir, "click"), ["user_id", "event_type"], ORDER, 10).where("tag = 'pass'").select("event_id", "user_id", "click_no")


@query(f"""
WITH {LIMITED}, panes AS (SELECT time_bucket(INTERVAL 5 SECONDS, ts) AS pane, user_id % 7 AS province, count(*) AS n FROM numbered WHERE click_no <= {LIMIT} GROUP BY ALL)
SELECT pane + to_seconds(5 * (k + 1)::BIGINT) AS window_end, province, sum(n)::BIGINT AS clicks FROM panes, range(720) r(k) GROUP BY ALL""")
def page_ad_clicks(spark, sf_dir):
    """An hour's clicks by province, anew every five seconds."""
    placed = _limited(spark, sf_dir).where("tag = 'pass'").select("ts", (F.col("user_id") % 7).alias("province"))
    return windows.hop_sums(placed, ["province"], "1 hour", "5 seconds", {"clicks": F.lit(1).cast("bigint")}).drop("window_start")


@query("SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, user_id % 4 AS channel, event_type AS behavior, count(*) AS n FROM events GROUP BY ALL")
def app_market_by_channel(spark, sf_dir):
    placed = events(spark, sf_dir).select("ts", (F.col("user_id") % 4).alias("channel"), F.col("event_type").alias("behavior"))
    return windows.tumble(placed, ["channel", "behavior"], "1 hour", [F.count("*").alias("n")]).drop("window_start")


HITS = "hits AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) + to_minutes(30 * (k + 1)::BIGINT) AS window_end, event_type AS ip, props AS url, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL)"


@query(f"""
WITH {HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ip, window_end ORDER BY n DESC, url) AS rn, sum(n) OVER (PARTITION BY ip, window_end) AS hits FROM hits)
SELECT ip, window_end, max(hits)::BIGINT AS hits, string_agg(url || '=' || n, ',' ORDER BY rn) AS urls FROM ranked WHERE rn <= 5 GROUP BY ALL""")
def hot_urls_top5_per_key(spark, sf_dir):
    hits = events(spark, sf_dir).select("ts", F.col("event_type").alias("ip"), F.col("props").alias("url"))
    counts = windows.hop_sums(hits, ["ip", "url"], "1 hour", "30 minutes", {"n": F.lit(1).cast("bigint")})
    by = Window.partitionBy("ip", "window_end")
    ranked = counts.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), "url")), "hits": F.sum("n").over(by)}).where("rank <= 5")
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("rank", "url", "n"))), lambda p: F.concat_ws("=", p["url"], p["n"]))
    return ranked.groupBy("ip", "window_end").agg(F.max("hits").alias("hits"), F.array_join(pairs, ",").alias("urls"))


@query("""
WITH counts AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, user_id AS ip, count(*) AS hits FROM events GROUP BY ALL)
SELECT window_end, ip, hits, row_number() OVER (PARTITION BY window_end ORDER BY hits DESC, ip) AS row_num FROM counts QUALIFY row_num <= 5""")
def hot_ips_top5(spark, sf_dir):
    counts = windows.tumble(events(spark, sf_dir).select("ts", F.col("user_id").alias("ip")), ["ip"], "1 hour", [F.count("*").alias("hits")])
    return topk.top_rows(counts, ["window_end"], [F.desc("hits"), "ip"], 5).select("window_end", "ip", "hits", F.col("row_num").cast("bigint").alias("row_num"))


@query(r"""
WITH words AS (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM words WHERE word != '' GROUP BY word""")
def word_count(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    return records.tokens(lines).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(event_id) AS cnt, round(avg(value), 6) AS avg_value FROM events GROUP BY user_id")
def group_count_avg(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("event_id").alias("cnt"), F.round(F.avg("value"), 6).alias("avg_value"))


OVER = """SELECT event_id, user_id, count(*) OVER w AS cnt, round(avg(value) OVER w, 6) AS avg_value FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


@query(OVER)
def over_rows_3(spark, sf_dir):
    out = windows.over_rows(events(spark, sf_dir), ["user_id"], ORDER, 2, {"cnt": F.count("*"), "mean": F.avg("value")})
    return out.select("event_id", "user_id", "cnt", F.round("mean", 6).alias("avg_value"))


@query(OVER)
def over_rows_sql(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("mr_events")
    return spark_sql(spark, OVER.replace("FROM events", "FROM mr_events"))


@query("""
WITH marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    return windows.session(events(spark, sf_dir), ["user_id"], "30 minutes", [F.count("*").alias("n")])


@query("""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS t FROM events)
SELECT user_id, ((n - 1) // 3)::BIGINT AS window_no, event_id AS first_event, value AS first_value FROM numbered WHERE n <= t - t % 3 AND n % 3 = 1""")
def count_window_3(spark, sf_dir):
    rows = windows.count_windows(events(spark, sf_dir), ["user_id"], ORDER, 3).where("position = 1")
    return rows.select("user_id", "window_no", F.col("event_id").alias("first_event"), F.col("value").alias("first_value"))


@query("""
SELECT user_id, (n // 2)::BIGINT AS firing, first_event, total FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, first_value(event_id) OVER w AS first_event, round(sum(value) OVER w, 4) AS total
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n % 2 = 0""")
def count_window_5_2(spark, sf_dir):
    out = windows.sliding_count(events(spark, sf_dir), ["user_id"], ORDER, 5, 2, {"first_event": F.first("event_id"), "sum": F.sum("value")})
    return out.select("user_id", "firing", "first_event", F.round("sum", 4).alias("total"))


DAYS = "SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end FROM events"


@query(f"""WITH d AS ({DAYS})
SELECT user_id, window_end, min_by(event_id, struct_pack(t := ts, i := event_id)) AS first_event, round(sum(value), 4) AS total, count(*) AS n FROM d GROUP BY ALL""")
def window_first_and_sum(spark, sf_dir):
    first = F.min_by("event_id", F.struct(*ORDER)).alias("first_event")
    out = windows.tumble(events(spark, sf_dir), ["user_id"], "1 day", [first, F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n")])
    return out.drop("window_start")


@query(f"""WITH d AS ({DAYS}) SELECT window_end, 'Count[id=' || user_id || ', count=' || count(*) || ']' AS info FROM d GROUP BY user_id, window_end""")
def window_count_text(spark, sf_dir):
    counts = windows.tumble(events(spark, sf_dir), ["user_id"], "1 day", [F.count("*").alias("n")])
    return counts.select("window_end", F.format_string("Count[id=%d, count=%d]", "user_id", "n").alias("info"))


@query(f"""
WITH d AS ({DAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_end ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, window_end) AS t FROM d)
SELECT user_id, window_end, count(*) AS kept, min_by(event_id, n) AS first_event FROM r WHERE NOT (t > 5 AND n = 1) GROUP BY ALL""")
def window_evicted(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct(*ORDER))).alias("rows")
    out = windows.tumble(events(spark, sf_dir), ["user_id"], "1 day", [rows]).withColumn("rows", windows.evicted(F.col("rows")))
    return out.select("user_id", "window_end", F.size("rows").cast("bigint").alias("kept"), F.get("rows", F.lit(0))["event_id"].alias("first_event"))


@query("SELECT event_id, value, CASE WHEN value >= 30 THEN 'high' ELSE 'low' END AS tag FROM events")
def split_high_low(spark, sf_dir):
    high, low = aggregates.split_by(events(spark, sf_dir).select("event_id", "value"), F.col("value") >= 30)
    return high.withColumn("tag", F.lit("high")).unionByName(low.withColumn("tag", F.lit("low")))


@query("""
SELECT * FROM (SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_value, value FROM events)
WHERE abs(value - last_value) > 10""")
def jump_alarm(spark, sf_dir):
    return patterns.jumps(events(spark, sf_dir), "user_id", ORDER, "value", 10.0).select("event_id", "user_id", "last_value", "value")


@query("""
WITH c AS (SELECT *, coalesce(sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS c FROM events),
r AS (SELECT *, sum(CASE WHEN c < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, min(ts) FILTER (c > 0) AS first_rise, max(ts) AS last_ts, count(*) FILTER (c > 0) AS rises FROM r GROUP BY user_id, run
HAVING min(ts) FILTER (c > 0) + INTERVAL 2 HOURS <= max(ts)""")
def rising_runs(spark, sf_dir):
    return patterns.rising_runs(events(spark, sf_dir), "user_id", ORDER, "value", "2 hours")


def _consecutive_sql(times: int, within: str) -> str:
    hits = " AND ".join(["event_type = 'error'", *[f"lead(event_type, {i}) OVER w = 'error'" for i in range(1, times)]])
    return f"""SELECT user_id, first_ts, last_ts, {times}::BIGINT AS n FROM (
      SELECT user_id, ts AS first_ts, lead(ts, {times - 1}) OVER w AS last_ts, {hits} AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE hit AND last_ts < first_ts + INTERVAL {within}"""


@query(_consecutive_sql(2, "12 HOURS"))
def consecutive_errors(spark, sf_dir):
    return patterns.consecutive(events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "error", 2, "12 hours")


@query(_consecutive_sql(3, "3 DAYS"))
def consecutive_errors_three(spark, sf_dir):
    return patterns.consecutive(events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "error", 3, "3 days")


FOLLOWED = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM e)
SELECT {columns} FROM p LEFT JOIN e AS t ON t.user_id = p.user_id AND t.n = p.m
WHERE p.event_type = 'view' AND {condition}"""
IN_TIME = "coalesce(t.ts < p.ts + INTERVAL 1 DAY, false)"


def _purchases(spark, sf_dir) -> DataFrame:
    return patterns.followed_by(
        events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "view", F.col("event_type") == "purchase", "1 day", {"event_id": "purchase_id"}
    )


@query(FOLLOWED.format(columns="p.user_id, p.ts AS first_ts, t.ts AS then_ts, t.event_id AS purchase_id", condition=IN_TIME))
def followed_by_purchase(spark, sf_dir):
    return _purchases(spark, sf_dir).where("matched").select("user_id", "first_ts", "then_ts", "purchase_id")


@query(FOLLOWED.format(columns="p.user_id, p.ts AS first_ts, p.ts + INTERVAL 1 DAY AS timeout_ts", condition=f"NOT {IN_TIME}"))
def purchase_timeout(spark, sf_dir):
    return _purchases(spark, sf_dir).where("NOT matched").select("user_id", "first_ts", "timeout_ts")


RECONCILED = """
WITH l AS (SELECT o_orderkey AS k, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT l_orderkey AS k, min(l_shipdate) AS ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(l.k, r.k) AS order_key, l.ts AS left_ts, r.ts AS right_ts, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side
FROM l FULL JOIN r ON l.k = r.k {condition}"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    paid = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("ts"))
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.min("l_shipdate").alias("ts"))
    return paid, back


@query(RECONCILED.format(condition=""))
def reconcile_orders(spark, sf_dir):
    return patterns.reconcile(*_sides(spark, sf_dir), "order_key")


@query(RECONCILED.format(condition="AND l.ts <= r.ts + INTERVAL 60 DAYS AND r.ts <= l.ts + INTERVAL 60 DAYS"))
def reconcile_orders_within(spark, sf_dir):
    return patterns.reconcile(*_sides(spark, sf_dir), "order_key", "60 days")


TOP2 = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank FROM events WHERE value IS NOT NULL QUALIFY rank <= 2"


@query(TOP2)
def top2_per_key(spark, sf_dir):
    return udfs.top_two(events(spark, sf_dir), "user_id", "value").withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT event_id, printf('Sensor[id=%d, name=%s, temp=%.2f°C]', user_id, event_type, value) AS info FROM events")
def udf_format(spark, sf_dir):
    return udfs.format_info_builtin(events(spark, sf_dir), "user_id", "event_type", "value").select("event_id", "info")


@query("SELECT event_id, 'Sensor[id=' || user_id || ', name=' || event_type || ', temp=' || (user_id % 90) || '.00°C]' AS info FROM events")
def udf_format_python(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", udfs.format_info(F.col("user_id"), F.col("event_type"), (F.col("user_id") % 90).cast("double")).alias("info"))


@query("SELECT event_id, 'new:' || event_type AS fname, length(event_type)::INTEGER AS len FROM events")
def udtf_lateral(spark, sf_dir):
    udfs.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("mr_names")
    return spark.sql("SELECT event_id, t.fname, t.len FROM mr_names, LATERAL name_table(event_type) AS t(fname, len)")


@query("SELECT event_id, 'new:' || event_type AS fname, length(event_type)::INTEGER AS len FROM events")
def udtf_builtin(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", udfs.name_struct(F.col("event_type")).alias("t")).select("event_id", "t.fname", "t.len")


@query("SELECT user_id, round(avg(value), 6) AS avg_value FROM events GROUP BY user_id")
def udaf_average(spark, sf_dir):
    udfs.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("mr_values")
    return spark.sql("SELECT user_id, round(average(value), 6) AS avg_value FROM mr_values GROUP BY user_id")


@query("""
SELECT user_id, list_reduce(list_prepend(0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: trunc(a + x))::INTEGER AS total
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def trunc_running_sum(spark, sf_dir):
    return aggregates.truncating_sum(events(spark, sf_dir), "user_id", ORDER, "value")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def partition_by_key(spark, sf_dir):
    """A repartition by key serves the aggregate without another exchange."""
    return partitioning.by_key(events(spark, sf_dir).select("user_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def partition_random(spark, sf_dir):
    return partitioning.shuffled(events(spark, sf_dir).select("event_type"), 8).groupBy("event_type").agg(F.count("*").alias("n"))


LINES = "concat('10.0.0.', user_id, ' - - ', strftime(ts, '%d/%m/%Y:%H:%M:%S'), CASE WHEN event_id % 50 = 0 THEN '' ELSE ' +0000 GET' || CASE WHEN event_id % 70 = 0 THEN '' ELSE ' /' || event_type END END)"


def _access_lines(spark, sf_dir) -> DataFrame:
    url = F.when(F.col("event_id") % 70 == 0, "").otherwise(F.concat(F.lit(" /"), "event_type"))
    tail = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit(" +0000 GET"), url))
    line = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" - - "), F.date_format("ts", "dd/MM/yyyy:HH:mm:ss"), tail)
    return events(spark, sf_dir).select(line.alias("value"))


@query(f"""
SELECT '10.0.0.' || user_id AS ip, 'GET' AS method, '/' || event_type AS url, epoch_ms(date_trunc('second', ts)) AS time, count(*) AS n
FROM events WHERE event_id % 50 != 0 AND event_id % 70 != 0 GROUP BY ALL""")
def access_log_parsed(spark, sf_dir):
    good, _ = records.routed(records.parse_access_log(_access_lines(spark, sf_dir)))
    return good.groupBy("ip", "method", "url", F.unix_millis("ts").alias("time")).agg(F.count("*").alias("n"))


@query(f"""
SELECT CASE WHEN event_id % 50 = 0 THEN 'Malformed line: ' ELSE 'Parsing failed: ' END || {LINES} AS parse_error
FROM events WHERE event_id % 50 = 0 OR event_id % 70 = 0""")
def access_log_errors(spark, sf_dir):
    return records.routed(records.parse_access_log(_access_lines(spark, sf_dir)))[1]


@query("SELECT user_id, event_id AS item_id, (user_id % 9)::INTEGER AS category_id, CASE WHEN event_type = 'view' THEN 'pv' END AS behavior, 1000 * epoch(date_trunc('second', ts))::BIGINT AS time FROM events")
def behavior_lines_parsed(spark, sf_dir):
    action = F.when(F.col("event_type") == "view", "pv").otherwise(F.col("event_type"))
    fields = ["user_id", "event_id", F.col("user_id") % 9, action, F.unix_seconds(F.col("ts").cast("timestamp"))]
    return records.parse_behavior(events(spark, sf_dir).select(F.concat_ws(",", *fields).alias("value"))).drop("ts")


@query("""SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS doc FROM events""")
def json_documents(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("doc"))


@query("SELECT event_type AS key, user_id::VARCHAR AS value FROM events")
def key_value_pairs(spark, sf_dir):
    return records.key_value(events(spark, sf_dir), "event_type", "user_id")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def merged_count_maps(spark, sf_dir):
    counts = lambda kind: events(spark, sf_dir, kind).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.create_map(F.lit(kind), "n").alias(f"{kind}_map"))
    none = F.create_map().cast("map<string,bigint>")
    both = counts("view").join(counts("click"), "user_id", "full_outer").withColumn("m", records.merged_counts(F.coalesce("view_map", none), F.coalesce("click_map", none)))
    pick = lambda key: F.coalesce(F.try_element_at("m", F.lit(key)), F.lit(0))
    return both.select("user_id", pick("view").alias("views"), pick("click").alias("clicks"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, ts, user_id FROM events WHERE event_type = 'error'")
def union_main_and_side(spark, sf_dir):
    columns = ["event_id", "ts", "user_id"]
    return events(spark, sf_dir, "view").select(columns).unionByName(events(spark, sf_dir, "error").select(columns))


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_id, user_id FROM events")
def tumble_table_function(spark, sf_dir):
    return windows.with_window(events(spark, sf_dir).select("ts", "event_id", "user_id"), "1 hour").drop("ts")


@query("""
WITH marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM numbered GROUP BY user_id, s""")
def session_sql(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("mr_events")
    return spark_sql(spark, """
        SELECT user_id, SESSION_START(ts, INTERVAL '30' MINUTE) AS session_start, COUNT(*) AS n
        FROM mr_events GROUP BY user_id, SESSION(ts, INTERVAL '30' MINUTE)""")


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 7")
def select_where(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "value").where(F.col("user_id") == 7)


DAILY_AVERAGE = "SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, avg(user_id + 0.5::DOUBLE) AS a, epoch_ms(date_trunc('day', ts)) AS s FROM events GROUP BY user_id, date_trunc('day', ts)"


@query(f"SELECT user_id, window_end, 'Key: ' || user_id || ', AvgTemp: ' || a AS info FROM ({DAILY_AVERAGE})")
def window_average_text(spark, sf_dir):
    """Full-window average as text, without the window; the averaged value is exact in both engines."""
    return windows.averages_text(events(spark, sf_dir).withColumn("v", F.col("user_id") + 0.5), "user_id", "1 day", "v")


@query(f"SELECT user_id, window_end, 'Key: ' || user_id || ', Window [' || s || ',' || (s + 86400000) || '], AvgTemp: ' || a AS info FROM ({DAILY_AVERAGE})")
def window_average_text_with_bounds(spark, sf_dir):
    return windows.averages_text(events(spark, sf_dir).withColumn("v", F.col("user_id") + 0.5), "user_id", "1 day", "v", bounds=True)


@query("SELECT (event_id % 1000)::INTEGER AS id, event_type AS name, (user_id % 50) + 0.5::DOUBLE AS temperature, epoch_us(ts) // 1000 AS time FROM events")
def observations_parsed(spark, sf_dir):
    lines = F.concat_ws(",", F.col("event_id") % 1000, "event_type", (F.col("user_id") % 50) + 0.5, F.unix_millis(F.col("ts").cast("timestamp")))
    return records.parse_csv(events(spark, sf_dir).select(lines.alias("value")), records.OBSERVATION, millis=True).drop("ts")


def _seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


SECONDS = "1000 * epoch(date_trunc('second', ts))::BIGINT AS time"


@query(f"SELECT user_id, event_id AS ad_id, event_type AS province, event_type || '-city' AS city, {SECONDS} FROM events")
def ad_clicks_parsed(spark, sf_dir):
    lines = F.concat_ws(",", "user_id", "event_id", "event_type", F.concat("event_type", F.lit("-city")), _seconds())
    return records.parse_csv(events(spark, sf_dir).select(lines.alias("value")), records.AD_CLICK).drop("ts")


@query(f"SELECT user_id, '10.0.0.' || event_id AS ip, event_type AS status, {SECONDS} FROM events")
def logins_parsed(spark, sf_dir):
    lines = F.concat_ws(",", "user_id", F.concat(F.lit("10.0.0."), "event_id"), "event_type", _seconds())
    return records.parse_csv(events(spark, sf_dir).select(lines.alias("value")), records.LOGIN).drop("ts")


@query(f"SELECT event_id AS order_id, event_type AS status, CASE WHEN event_type = 'purchase' THEN 'p' || event_id ELSE '' END AS payment_id, {SECONDS} FROM events")
def orders_parsed(spark, sf_dir):
    """Empty payment ids stay empty."""
    payment = F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), "event_id")).otherwise("")
    lines = F.concat_ws(",", "event_id", "event_type", payment, _seconds())
    return records.parse_csv(events(spark, sf_dir).select(lines.alias("value")), records.ORDER).drop("ts")


@query(f"SELECT 'p' || event_id AS payment_id, event_type AS channel, {SECONDS} FROM events")
def receipts_parsed(spark, sf_dir):
    lines = F.concat_ws(",", F.concat(F.lit("p"), "event_id"), "event_type", _seconds())
    return records.parse_csv(events(spark, sf_dir).select(lines.alias("value")), records.RECEIPT).drop("ts")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE trim(word) != '' GROUP BY word")
def word_count_by_single_spaces(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    return records.tokens(lines, " ").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE upper(event_type) WHEN 'PV' THEN 'pv' WHEN 'BUY' THEN 'buy' WHEN 'CART' THEN 'cart' WHEN 'FAV' THEN 'fav' END AS behavior FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PV' WHEN 1 THEN ' ' WHEN 2 THEN 'BUY' WHEN 3 THEN 'CART' WHEN 4 THEN 'FAV' ELSE 'LOOK' END AS event_type FROM events)")
def behavior_names(spark, sf_dir):
    """Actions by their names; blank and unknown ones are null."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("PV", " ", "BUY", "CART", "FAV", "LOOK")]), (F.col("event_id") % 6 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", records.behavior_by_name(names).alias("behavior"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error'")
def partition_global(spark, sf_dir):
    """A small result in one task."""
    return partitioning.in_one(events(spark, sf_dir, "error").select("user_id")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
WITH e AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 12 HOURS AS mark FROM events WHERE user_id % 20 = 3)
SELECT event_id, user_id, ts < mark AS late FROM e""")
def late_events(spark, sf_dir):
    """Events in order of arrival, told late or not by a watermark 12 hours behind: what a stream's side output gets."""
    own = events(spark, sf_dir).where("user_id % 20 = 3").select("event_id", "user_id", "ts")
    return windows.behind_watermark(own, [], ["event_id"], "12 hours").select("event_id", "user_id", "late")


@query("""
WITH e AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 12 HOURS AS mark FROM events),
w AS (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end FROM e)
SELECT event_type, window_end, count(*) FILTER (mark < window_end) AS on_time, count(*) FILTER (mark >= window_end AND mark < window_end + INTERVAL 6 HOURS) AS refining,
  count(*) FILTER (mark >= window_end + INTERVAL 6 HOURS) AS dropped FROM w GROUP BY ALL""")
def lateness_by_window(spark, sf_dir):
    """Of each key's daily windows: rows on time, rows that refine a fired window within the allowed lateness, rows too late."""
    placed = windows.behind_watermark(events(spark, sf_dir).select("event_type", "event_id", "ts"), ["event_type"], ["event_id"], "12 hours")
    end, allowed = F.window("ts", "1 day")["end"], F.expr("INTERVAL '6 hours'")
    rows = placed.select("event_type", "mark", end.alias("window_end"))
    return rows.groupBy("event_type", "window_end").agg(
        F.count_if(F.col("mark") < F.col("window_end")).alias("on_time"),
        F.count_if((F.col("mark") >= F.col("window_end")) & (F.col("mark") < F.col("window_end") + allowed)).alias("refining"),
        F.count_if(F.col("mark") >= F.col("window_end") + allowed).alias("dropped"),
    )


@query("SELECT event_id, user_id, event_type, round(value, 3) AS value FROM events")
def csv_round_trip(spark, sf_dir):
    """The CSV sink, read back by the CSV table source with its declared schema."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    own = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.round("value", 3).alias("value"))
    writers.csv_files(own, path)
    return readers.csv_table(spark, path, own.schema)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 = 0")
def text_lines_round_trip(spark, sf_dir):
    """Lines of text files, parsed."""
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    events(spark, sf_dir).where("event_id % 3 = 0").select(F.concat_ws(",", "event_id", "user_id", "event_type").alias("value")).write.text(path)
    return readers.from_csv_values(readers.text_lines(spark, path), records.schema("event_id bigint, user_id bigint, event_type string"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def upserted_last_rows(spark, sf_dir):
    """What an ordered upsert of all events leaves: each key's last row."""
    return writers.last_of_each(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ORDER).drop("event_id")
