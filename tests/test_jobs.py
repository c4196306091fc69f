import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.records import schema
from millrace.streaming import jobs
from tests.streams import collect, stream_of, write_batch
from pyspark.sql import types as T

START = datetime(2020, 1, 1)
FAR = START + timedelta(days=9)


def fields(names):
    return T.StructType([*schema(names).fields, T.StructField("ts", T.TimestampType())])


BEHAVIOR = fields("user_id bigint, item_id bigint, behavior string")


def behaviors(n=300, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(9), rng.randrange(6), rng.choice(["pv", "pv", "buy"]), START + timedelta(seconds=30 * i + rng.randrange(20))) for i in range(n)]


def both(spark, tmp_path, rows, last, kind, job):
    """The job's result over the batch, and over a stream of the same rows whose last batch closes all windows."""
    a, b = len(rows) // 3, 2 * len(rows) // 3
    stream = stream_of(spark, [rows[:a], rows[a:b], rows[b:], [last]], kind, tmp_path / "in")
    batch = job(spark.createDataFrame(rows, kind)).collect()
    return sorted(map(str, batch)), sorted(map(str, collect(job(stream), tmp_path)))


@pytest.mark.parametrize("job", [
    lambda df: jobs.pv_uv(df, "1 minute"), lambda df: jobs.pv_uv_approximate(df, "1 minute"), lambda df: jobs.hot_items(df, "1 minute", 3),
    lambda df: jobs.grouped_counts(df, "behavior", "item_id", "1 minute", "1 hour"), lambda df: jobs.grouped_counts(df, "behavior", "item_id", "1 minute", "10 minutes", "5 minutes", 2),
    lambda df: jobs.sessions(df, "user_id", "3 minutes", "1 minute"),
    lambda df: jobs.app_market(df.withColumn("channel", F.col("user_id") % 2), "1 minute"),
], ids=["pv_uv", "approximate", "hot_items", "provinces", "hot_pages", "sessions", "market"])
def test_stream_equals_batch(spark, tmp_path, job):
    batch, stream = both(spark, tmp_path, behaviors(), (0, 0, "pv", FAR), BEHAVIOR, job)
    assert batch == stream and batch


def test_update_mode_refines_late_windows(spark, tmp_path):
    rows = [(1, 1, "pv", START), (2, 1, "pv", START + timedelta(minutes=50))]
    late = [(3, 1, "pv", START + timedelta(minutes=10))]
    stream = stream_of(spark, [rows, [(1, 1, "pv", START + timedelta(hours=1, seconds=10))], late], BEHAVIOR, tmp_path / "in")
    out = collect(jobs.pv_uv_approximate(stream, "30 seconds"), tmp_path, "update")
    assert [r.pv for r in out if r.window_end == START + timedelta(hours=1)] == [2, 3]


def test_running_counts(spark, tmp_path):
    lines = T.StructType([T.StructField("value", T.StringType())])
    stream = stream_of(spark, [[("tony tom  tony",)], [("tom x",)]], lines, tmp_path / "in")
    assert {tuple(r) for r in collect(jobs.word_count(stream), tmp_path, "complete")} == {("tony", 2), ("tom", 2), ("x", 1)}
    assert ("tom", 1) in {tuple(r) for r in collect(jobs.word_count(stream), tmp_path, "update")}


def two_streams(spark, tmp_path, left, right, kinds):
    for side, rows, kind in (("l", left, kinds[0]), ("r", right, kinds[1])):
        for i, batch in enumerate(rows):
            write_batch(spark, batch, kind, str(tmp_path / side), i)
    read = lambda side, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / side))
    return read("l", kinds[0]), read("r", kinds[1])


def test_orders_paid_in_time_or_timed_out(spark, tmp_path):
    kinds = fields("order_id bigint"), fields("order_id bigint, payment_id string")
    at = lambda m: START + timedelta(minutes=m)
    creates = [[(1, at(0)), (2, at(1)), (3, at(2))], [(99, FAR)]]
    pays = [[(1, "p1", at(10)), (2, "p2", at(45))], [(99, "p9", FAR)]]
    a, b = two_streams(spark, tmp_path, creates, pays, kinds)
    out = collect(jobs.paid_orders(a, b), tmp_path)
    assert sorted(((r.order_id, r.payment_id) for r in out if r.order_id != 99), key=str) == [(1, "p1"), (2, None), (3, None)]
    batch = jobs.paid_orders(spark.createDataFrame(creates[0], kinds[0]), spark.createDataFrame(pays[0], kinds[1])).collect()
    assert sorted(((r.order_id, r.payment_id) for r in batch), key=str) == [(1, "p1"), (2, None), (3, None)]


def test_reconciliation(spark, tmp_path):
    kinds = (fields("payment_id string"),) * 2
    at = lambda s: START + timedelta(seconds=s)
    a, b = two_streams(spark, tmp_path, [[("x", at(0)), ("y", at(1))], [("far", FAR)]], [[("x", at(2)), ("z", at(3))], [("far", FAR)]], kinds)
    out = collect(jobs.reconciled(a, b, "3 seconds"), tmp_path)
    assert sorted((r.payment_id, r.side) for r in out if r.payment_id != "far") == [("x", "both"), ("y", "pay only"), ("z", "receipt only")]


def test_tags_and_duplicates(spark, tmp_path):
    rows = behaviors(30) * 2
    df = spark.createDataFrame(rows, BEHAVIOR)
    assert jobs.deduplicated(df, ["user_id", "item_id", "behavior", "ts"], "1 minute").count() == len(set(rows))
    stream = stream_of(spark, [rows[:30], rows[30:]], BEHAVIOR, tmp_path / "in")
    assert len(collect(jobs.deduplicated(stream, ["user_id", "item_id", "behavior", "ts"], "1 day"), tmp_path)) == len(set(rows))
    tags = jobs.tagged(df, {"buy": F.col("behavior") == "buy", "low": F.col("item_id") < 2})
    assert {r.tag for r in tags.select("tag").distinct().collect()} == {"buy", "low", "main"}


def test_checkpoint_settings(spark, tmp_path):
    with pytest.raises(ValueError, match="negative"):
        jobs.Checkpoints("x", -1)
    lines = T.StructType([T.StructField("value", T.StringType())])
    stream = stream_of(spark, [[("a b",)]], lines, tmp_path / "in")
    seen = []

    def fails_once(df, batch):
        seen.append(batch)
        if len(seen) == 1:
            raise RuntimeError("lost")
        spark.streams.active[0].stop()

    tuned = jobs.Checkpoints(str(tmp_path / "c"), interval_ms=100, kept_batches=7, restarts=1)
    tuned.run(spark, stream.writeStream.foreachBatch(fails_once))
    assert seen == [0, 0] and spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "7"
    seen.clear()
    with pytest.raises(Exception, match="lost"):
        jobs.Checkpoints(str(tmp_path / "d"), interval_ms=100).run(spark, stream.writeStream.foreachBatch(fails_once))
