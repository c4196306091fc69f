"""Hand-derived answers for the operators."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import records, udfs
from millrace.operators import aggregates, partitioning, patterns, topk, windows
from millrace.plans.window_sql import rewrite

READINGS = ["0001,equipment1,34.1,1762392490", "0002,equipment2,23.2,1762312490", "0001,equipment1,99.1,1762392100", "0003,equipment3,11.6,1761521490",
            "0001,equipment1,12.1,1762399490", "0004,equipment4,38.6,1764662490", "0005,equipment5,9.0,1764512490", "0001,equipment1,55.1,1762392480"]
START = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def readings(spark):
    lines = spark.createDataFrame([(x,) for x in READINGS], "value string").coalesce(1)
    return records.parse_csv(lines, records.OBSERVATION, millis=True).withColumn("seq", F.monotonically_increasing_id())


def at(s):
    return START + timedelta(seconds=s)


def test_parsers(spark):
    lines = spark.createDataFrame([("5,7,9,pv,10",), ("5,7,9,look,10",), ("5,x",), ("",), (None,)], "value string")
    got = [(r.user_id, r.item_id, r.category_id, r.behavior, r.time) for r in records.parse_behavior(lines).collect()]
    assert got == [(5, 7, 9, "pv", 10_000), (5, 7, 9, None, 10_000), (5, None, None, None, None), *[(None,) * 5] * 2]
    order = records.parse_csv(spark.createDataFrame([("3,create,,5",)], "value string"), records.ORDER).first()
    assert (order.order_id, order.payment_id, order.ts) == (3, "", datetime(1970, 1, 1, 0, 0, 5))


def test_access_log_routes_errors(spark):
    rows = ["1.1.1.1 - - 17/05/2015:10:05:43 +0000 GET /a", "1.1.1.1 - - 17/05/2015:10:05:43 +0000", "1.1.1.1 - - 17/05/2015:10:05:43 +0000 GET", "1.1.1.1 - - nonsense +0000 GET /a"]
    good, bad = records.routed(records.parse_access_log(spark.createDataFrame([(r,) for r in rows], "value string")))
    assert [(r.url, r.ts) for r in good.collect()] == [("/a", datetime(2015, 5, 17, 10, 5, 43))]
    assert [r.parse_error.split(":")[0] for r in bad.collect()] == ["Malformed line", "Parsing failed", "Parsing failed"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (None, "a", 2.0)], "id int, name string, t double")
    assert [r.info for r in udfs.format_info_builtin(df, "id", "name", "t").collect()] == ["Sensor[id=1, name=a, temp=2.00°C]", "Invalid Sensor Data"]
    assert [r[0] for r in df.select(udfs.format_info("id", "name", "t")).collect()] == ["Sensor[id=1, name=a, temp=2.00°C]", "Invalid Sensor Data"]
    assert [r[0] for r in spark.createDataFrame([("pv",), (" ",), ("zz",)], "n string").select(records.behavior_by_name("n")).collect()] == ["pv", None, None]
    assert {r[0] for r in spark.range(200).select(records.random_int(3, 1)).collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="above 0"):
        records.random_int(0)
    assert [r.word for r in records.tokens(spark.createDataFrame([(" a  b\tc ",), (None,)], "value string")).collect()] == ["a", "b", "c"]


def test_windows(readings):
    total = windows.tumble(readings, ["id"], "10 seconds", [F.count("*").alias("n"), F.round(F.sum("temperature"), 1).alias("s")])
    assert sorted((r.id, r.n, r.s) for r in total.collect()) == [(1, 4, 200.4), (2, 1, 23.2), (3, 1, 11.6), (4, 1, 38.6), (5, 1, 9.0)]
    over = windows.over_rows(readings.where("id = 1"), ["id"], ["time"], 2, {"mean": F.avg("temperature")})
    assert [round(r.mean, 4) for r in over.orderBy("time").collect()] == [99.1, 77.1, 62.7667, 33.7667]
    assert [r.temperature for r in windows.count_windows(readings, ["id"], ["seq"], 3).where("position = 1").collect()] == [34.1]
    sliding = windows.sliding_count(readings, ["id"], ["seq"], 5, 2, {"first": F.first("temperature")})
    assert [(r.firing, r.first) for r in sliding.orderBy("firing").collect()] == [(1, 34.1), (2, 34.1)]


def test_eviction(spark):
    df = spark.range(1).select(F.array(*[F.lit(i) for i in range(7)]).alias("a"), F.array(F.lit(1)).alias("b"))
    assert tuple(df.select(windows.evicted(F.col("a")), windows.evicted(F.col("b"))).first()) == ([1, 2, 3, 4, 5, 6], [1])


def test_patterns_on_readings(readings):
    assert sorted((r.last_value, r.temperature) for r in patterns.jumps(readings, "id", ["seq"], "temperature", 10).collect()) == [(12.1, 55.1), (34.1, 99.1), (99.1, 12.1)]
    assert {r.id: r.total for r in aggregates.truncating_sum(readings, "id", ["seq"], "temperature").collect()}[1] == 200
    high, low = aggregates.split_by(readings, F.col("temperature") >= 30)
    assert (high.count(), low.count()) == (4, 4)
    assert [r.temperature for r in topk.top_values(readings, ["id"], "temperature", 2).where("id = 1").orderBy("rank").collect()] == [99.1, 55.1]


def test_truncating_sum_by_batches_equals_the_fold(spark):
    rows = [(k, i, v) for k in (None, 1, 2, 7) for i, v in enumerate([0.9, -3.7, 12.25, 0.5, -0.5, 1.99, -40.01, 33.3] * 9)] + [(9, 0, None), (8, 0, -1.5)]
    df = spark.createDataFrame(rows, "id int, seq int, v double").repartition(3)
    got, want = (sorted(map(str, f(df, "id", ["seq"], "v").collect())) for f in (aggregates.truncating_sum_by_batches, aggregates.truncating_sum))
    assert got == want and len(got) == 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # keys then span batches
    try:
        assert sorted(map(str, aggregates.truncating_sum_by_batches(df, "id", ["seq"], "v").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert aggregates.truncating_sum_by_batches(df.limit(0), "id", ["seq"], "v").count() == 0


def test_login_failures(spark):
    rows = [(1, "fail", at(0), 0), (1, "fail", at(1), 1), (1, "success", at(2), 2), (1, "fail", at(3), 3), (1, "fail", at(6), 4), (2, "fail", at(0), 5)]
    df = spark.createDataFrame(rows, "user_id int, status string, ts timestamp, seq int")
    found = patterns.consecutive(df, "user_id", ["ts", "seq"], F.col("status") == "fail", 2, "3 seconds").collect()
    assert [(r.user_id, r.first_ts, r.last_ts, r.n) for r in found] == [(1, at(0), at(1), 2)]


def test_orders(spark):
    rows = [(1, "create", at(0), 0), (2, "create", at(0), 1), (2, "pay", at(0), 2), (1, "pay", at(1800), 3), (3, "pay", at(5), 4)]
    df = spark.createDataFrame(rows, "order_id int, status string, ts timestamp, seq int")
    out = patterns.followed_by(df, "order_id", ["ts", "seq"], F.col("status") == "create", F.col("status") == "pay", "30 minutes").collect()
    assert sorted((r.order_id, r.matched, r.timeout_ts) for r in out) == [(1, False, at(1800)), (2, True, None)]


def test_reconcile(spark):
    a = spark.createDataFrame([("x", at(0)), ("y", at(0))], "payment_id string, ts timestamp")
    b = spark.createDataFrame([("x", at(9)), ("z", at(0))], "payment_id string, ts timestamp")
    assert sorted((r.payment_id, r.side) for r in patterns.reconcile(a, b, "payment_id").collect()) == [("x", "both"), ("y", "left"), ("z", "right")]
    assert sorted((r.payment_id, r.side) for r in patterns.reconcile(a, b, "payment_id", "3 seconds").collect()) == [("x", "left"), ("x", "right"), ("y", "left"), ("z", "right")]


def test_limit_and_rising(spark):
    clicks = spark.createDataFrame([(1, at(i), i) for i in range(13)], "u int, ts timestamp, seq int")
    tags = [r.tag for r in patterns.limited(clicks, ["u"], ["ts", "seq"], 10, keep_dropped=True).orderBy("seq").collect()]
    assert tags == ["pass"] * 10 + ["alarm"] + ["drop"] * 2
    assert [r.tag for r in patterns.limited(clicks, ["u"], ["ts", "seq"], 10).orderBy("seq").collect()] == tags[:11]
    values = [1, 2, 2, 3, 1, 2]
    df = spark.createDataFrame([(1, at(5 * i), i, float(v)) for i, v in enumerate(values)], "u int, ts timestamp, seq int, v double")
    assert [(r.first_rise, r.last_ts, r.rises) for r in patterns.rising_runs(df, "u", ["ts", "seq"], "v", "10 seconds").collect()] == [(at(5), at(15), 2)]


def test_first_of_and_ordered_pairs(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "k int, o int, v string")
    assert df.groupBy("k").agg(aggregates.first_of("o").alias("f")).first().f.v == "a"
    pairs = spark.range(1).select(F.array(*[F.struct(F.lit(c).alias("count"), F.lit(k).alias("key")) for c, k in ((1, "z"), (3, "b"), (3, "a"))]).alias("p"))
    assert [(p["count"], p.key) for p in pairs.select(topk.ordered_pairs(F.col("p")).alias("p")).first().p] == [(3, "a"), (3, "b"), (1, "z")]


def test_partitioning(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    assert partitioning.in_one(df).rdd.getNumPartitions() == 1
    assert partitioning.by_key(df, "k", partitions=3).groupBy(F.spark_partition_id()).agg(F.count_distinct("k")).count() <= 3
    assert partitioning.shuffled(df, 4).count() == partitioning.rebalanced(df, 4).count() == 100


def test_window_sql():
    assert rewrite("SELECT TUMBLE_END(ts, INTERVAL '1' HOUR) FROM t GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)") == "SELECT window(ts, '1 hour').end FROM t GROUP BY window(ts, '1 hour')"
    assert rewrite("hop(ts, INTERVAL '5' MINUTE, INTERVAL '1' HOUR)") == "window(ts, '1 hour', '5 minute')"
    assert rewrite("SESSION_START(t.ts, INTERVAL '5' SECOND)") == "session_window(t.ts, '5 second').start"
    assert rewrite("SELECT hop FROM shop") == "SELECT hop FROM shop"


def test_a_limit_starts_anew_a_day_after_the_first_click(spark):
    """Ten pass, the eleventh alarms; the next day counts from the first click at or after 24 hours."""
    hours = [0, *[1] * 11, 23, 24, 25, *[26] * 9, 47, 48, 49]
    rows = [(1, at(3600 * h), i) for i, h in enumerate(hours)] + [(2, at(3600 * 24), 100), (2, None, 101), (2, None, 102)]
    clicks = spark.createDataFrame(rows, "u int, ts timestamp, seq int").repartition(4)
    got = {r.seq: (r.click_no, r.tag) for r in patterns.limited(clicks, ["u"], ["ts", "seq"], 10, True, timedelta(hours=24)).collect()}
    want, start, n = {}, None, 0
    for i, h in enumerate(hours):
        if start is None or h >= start + 24:
            start, n = h, 0
        n += 1
        want[i] = (n, "pass" if n <= 10 else "alarm" if n == 11 else "drop")
    assert {k: v for k, v in got.items() if k < 100} == want
    assert [got[k][0] for k in (101, 102, 100)] == [1, 2, 1]
    assert max(v[0] for v in want.values()) == 13 and [k for k, v in want.items() if v[0] == 1] == [0, 13, 25]


def test_periods_over_many_batches(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), at(rng.randrange(900_000)), i) for i in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.seq: r.click_no for r in patterns.limited(spark.createDataFrame(rows, "u int, ts timestamp, seq int"), ["u"], ["ts", "seq"], 3, True, timedelta(days=1)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    state = {}
    for u, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        start, n = state.get(u, (None, 0))
        if start is None or t >= start + timedelta(days=1):
            start, n = t, 0
        state[u] = (start, n + 1)
        assert got[i] == n + 1


def test_followed_by_grows_with_its_rows(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "create").otherwise("pay").alias("s"))
    began = time.time()
    out = patterns.followed_by(rows, "k", ["ts", "seq"], F.col("s") == "create", F.col("s") == "pay", "10 seconds")
    assert out.where("matched AND then_ts = first_ts + INTERVAL '1 second'").count() == 30_000
    assert time.time() - began < 20  # a frame computed anew for each row takes minutes


def test_panes_give_the_windows_that_rows_give(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), at(rng.randrange(4000)), rng.random()) for _ in range(200)] + [(1, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    got = windows.hop_sums(df, ["k"], "10 minutes", "2 minutes", {"n": F.lit(1), "s": F.col("v")})
    want = windows.hop(df, ["k"], "10 minutes", "2 minutes", [F.sum(F.lit(1)).alias("n"), F.sum("v").alias("s")])
    key = lambda r: (r.k, r.window_start, r.window_end, r.n, round(r.s, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_average_as_text(spark):
    df = spark.createDataFrame([(1, at(0), 1.5), (1, at(5), 2.5), (1, at(12), None)], "id int, ts timestamp, t double")
    assert [r.info for r in windows.averages_text(df, "id", "10 seconds", "t").orderBy("window_end").collect()] == ["Key: 1, AvgTemp: 2.0", "Key: 1, AvgTemp: 0.0"]
    assert windows.averages_text(df, "id", "10 seconds", "t", bounds=True).orderBy("window_end").first().info == "Key: 1, Window [1577836800000,1577836810000], AvgTemp: 2.0"


def test_late_rows_of_a_replay(spark):
    rows = [(0, at(0)), (1, at(100)), (2, at(97)), (3, at(99)), (4, at(50))]
    out = windows.behind_watermark(spark.createDataFrame(rows, "n int, ts timestamp"), [], ["n"], "2 seconds").orderBy("n").collect()
    assert [r.late for r in out] == [False, False, True, False, True]
