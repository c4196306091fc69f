import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import jobs
from millrace.streaming import processors as p
from tests.streams import EVENT, collect, outputs, stream_of

START = datetime(2020, 1, 1)
FAR = ("far", START + timedelta(days=3), 10**6, 0.0, "end")


@pytest.fixture(autouse=True)
def rocks(spark):
    jobs.state_settings(spark)


def at(s):
    return START + timedelta(seconds=s)


def ms(s):
    return p.millis(START) + int(s * 1000)


def run(spark, tmp_path, processor, batches, **options):
    stream = stream_of(spark, batches, EVENT, tmp_path / "in").withWatermark("ts", "0 seconds")
    return collect(p.run(stream, "key", processor), tmp_path, **options)


def events(values, key="a", kind="x", step=1):
    return [(key, at(i * step), i, float(v), kind) for i, v in enumerate(values)]


def test_limiter(spark, tmp_path):
    clicks = events(range(14))
    again = [("a", at(25 * 3600), 99, 0.0, "x")]
    rows = run(spark, tmp_path, p.Limiter(10), [clicks[:7], clicks[7:], again])
    assert [o[2]["n"] for o in outputs(rows, p.MAIN)] == [*range(1, 11), 1]
    assert [o[2]["seq"] for o in outputs(rows, p.ALARM)] == [10]


def test_jump_and_truncating_sum(spark, tmp_path):
    data = events([34.1, 99.1, 12.1, 55.1])
    rows = run(spark, tmp_path, p.Jump(10.0), [data[:2], data[2:]])
    assert [(o[2]["last"], o[2]["now"]) for o in outputs(rows)] == [(34.1, 99.1), (99.1, 12.1), (12.1, 55.1)]
    rows = run(spark, tmp_path / "b", p.TruncatingSum(), [data[:2], data[2:]])
    assert [o[2]["total"] for o in outputs(rows)] == [34, 133, 145, 200]


def test_count_windows_and_row_frames(spark, tmp_path):
    data = events([1, 2, 3, 4, 5, 6, 7])
    rows = run(spark, tmp_path, p.CountWindow(3), [data[:2], data[2:]])
    assert [(o[2]["first"], o[2]["sum"]) for o in outputs(rows)] == [(0, 6), (3, 15)]
    rows = run(spark, tmp_path / "b", p.SlidingCount(5, 2), [data[:4], data[4:]])
    assert [(o[2]["first"], o[2]["sum"]) for o in outputs(rows)] == [(0, 3), (0, 10), (1, 20)]
    rows = run(spark, tmp_path / "c", p.OverRows(2), [data[:3], data[3:]])
    assert [o[2]["avg"] for o in outputs(rows)] == [1, 1.5, 2, 3, 4, 5, 6]


def test_rising_alarm(spark, tmp_path):
    up = events([1, 2, 3, 4], step=4)
    rows = run(spark, tmp_path, p.Rising(10_000), [up, [("a", at(15), 9, 5.0, "x")], [FAR]])
    assert [o[0] for o in outputs(rows)] == ["a"]
    assert outputs(rows)[0][2]["rises"] in (3, 4)  # the fourth rise comes in the batch after the timer is due
    fall = events([1, 2, 1], step=2)
    assert run(spark, tmp_path / "b", p.Rising(10_000), [fall, [FAR]]) == []


def test_consecutive(spark, tmp_path):
    kinds = ["fail", "fail", "ok", "fail", "fail", "fail"]
    data = [("a", at(i), i, 0.0, k) for i, k in enumerate(kinds)] + [("b", at(0), 0, 0.0, "fail"), ("b", at(9), 1, 0.0, "fail")]
    rows = run(spark, tmp_path, p.Consecutive("fail", 2, 3000), [data[:4], data[4:]])
    assert sorted(o[2]["first"] for o in outputs(rows)) == [ms(0), ms(3), ms(4)]


def test_followed_by(spark, tmp_path):
    data = [("1", at(0), 0, 0.0, "create"), ("2", at(1), 1, 0.0, "create"), ("1", at(60), 2, 0.0, "pay"), ("3", at(61), 3, 0.0, "pay")]
    rows = run(spark, tmp_path, p.FollowedBy(within_ms=1_800_000), [data, [FAR]])
    assert outputs(rows, p.MAIN) == [("1", p.MAIN, {"first": ms(0), "then": ms(60)})]
    assert outputs(rows, p.TIMEOUT) == [("2", p.TIMEOUT, {"first": ms(1)})]


def test_reconciler(spark, tmp_path):
    data = [("1", at(0), 0, 0.0, "pay"), ("2", at(1), 1, 0.0, "receipt"), ("1", at(2), 2, 0.0, "receipt"), ("3", at(2), 3, 0.0, "pay")]
    end = [("far", at(9999), 9, 0.0, "pay")]
    rows = run(spark, tmp_path, p.Reconciler(within_ms=3000), [data, end])
    assert outputs(rows, p.MAIN) == [("1", p.MAIN, {"left": ms(0), "right": ms(2)})]
    assert sorted(outputs(rows, p.SIDE)) == [("2", p.SIDE, {"side": "right"}), ("3", p.SIDE, {"side": "left"})]
    assert len(outputs(run(spark, tmp_path / "b", p.Reconciler(), [data, end]), p.MAIN)) == 1


def test_triggered_window(spark, tmp_path):
    data = events([1] * 7)
    rows = run(spark, tmp_path, p.TriggeredWindow(10_000, 10_000, 1_000, 5), [data])
    assert [(o[2]["first"], o[2]["n"]) for o in outputs(rows, p.MAIN)] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 5), (1, 6)]


def test_late_rows_are_routed(spark, tmp_path):
    batches = [[("a", at(0), 0, 0.0, "x"), ("a", at(100), 1, 0.0, "x")], [("a", at(200), 2, 0.0, "x")], [("a", at(50), 3, 0.0, "x"), ("a", at(300), 4, 0.0, "x")]]
    stream = stream_of(spark, batches, EVENT, tmp_path / "in").withWatermark("ts", "2 seconds")
    rows = collect(p.run(stream, "key", p.LateRouter(), "ProcessingTime"), tmp_path, manual=True, batches=3)
    assert [o[2]["seq"] for o in outputs(rows, p.LATE)] == [3]
    assert sorted(o[2]["seq"] for o in outputs(rows, p.MAIN)) == [0, 1, 2, 4]


def test_counter_over_random_batches(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.choice("ab"), at(i), i, 0.0, "xyz") for i in range(60)]
    rows = run(spark, tmp_path, p.Counter(), [data[:13], data[13:40], data[40:]])
    for key in "ab":
        assert [o[2]["n"] for o in outputs(rows) if o[0] == key] == list(range(1, 1 + sum(d[0] == key for d in data)))


def test_counts_by_kind_in_map_state(spark, tmp_path):
    data = [("a", at(i), i, 0.0, k) for i, k in enumerate("xyxxy")]
    rows = run(spark, tmp_path, p.KindCounts(), [data[:2], data[2:]])
    assert [(o[2]["kind"], o[2]["n"]) for o in outputs(rows)] == [("x", 1), ("y", 1), ("x", 2), ("x", 3), ("y", 2)]


def test_trigger_results(spark, tmp_path):
    data = events([1] * 7)
    rows = run(spark, tmp_path, p.TriggeredWindow(10_000, 10_000, 1_000, 5, p.CountTrigger(3)), [data[:4], data[4:]])
    assert [(o[2]["first"], o[2]["n"]) for o in outputs(rows, p.MAIN)] == [(0, 3), (3, 3)]  # fired and emptied; the seventh waits
    rows = run(spark, tmp_path / "b", p.TriggeredWindow(10_000, 10_000, 1_000, 5, p.EndTrigger()), [data[:4], data[4:], [FAR], [FAR]])
    assert [(o[2]["first"], o[2]["n"], o[2]["sum"]) for o in outputs(rows, p.MAIN) if o[0] == "a"] == [(1, 6, 6)]


class Purging(p.Trigger):
    def on_event(self, ms, value, n):
        return p.PURGE if value > 5 else p.FIRE


def test_purge_empties_without_a_result(spark, tmp_path):
    rows = run(spark, tmp_path, p.TriggeredWindow(10_000, 10_000, 1_000, 5, Purging()), [events([1, 2, 9, 3])])
    assert [(o[2]["first"], o[2]["n"], o[2]["sum"]) for o in outputs(rows, p.MAIN)] == [(0, 1, 1), (0, 2, 3), (3, 1, 3)]


def in_processing_time(spark, tmp_path, processor, rows, seconds):
    """Outputs of a stream that is left running for some seconds after its rows."""
    import time
    import uuid

    stream = stream_of(spark, rows, EVENT, tmp_path / "in").withWatermark("ts", "0 seconds")
    name = "t" + uuid.uuid4().hex
    query = p.run(stream, "key", processor, "ProcessingTime").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    began = time.time()
    while time.time() - began < 90 and not any(r["numInputRows"] for r in query.recentProgress):
        time.sleep(0.2)
    time.sleep(seconds)
    query.stop()
    if query.exception():
        raise query.exception()
    return spark.table(name).collect()


def test_processing_time_trigger(spark, tmp_path):
    rows = in_processing_time(spark, tmp_path, p.TriggeredWindow(10_000, 10_000, 1_000, 5, p.EveryTrigger(1_000)), [events([1, 2, 3])], 6)
    fired = [(o[2]["first"], o[2]["n"], o[2]["sum"]) for o in outputs(rows, p.MAIN)]
    assert fired and set(fired) == {(0, 3, 6)}


def test_rising_alarm_in_processing_time(spark, tmp_path):
    rows = in_processing_time(spark, tmp_path, p.RisingNow(1_000), [events([1, 2, 2, 3]) + events([1, 2, 1], "b")], 6)
    assert [(o[0], o[2]["rises"]) for o in outputs(rows, p.ALARM)] == [("a", 2)]


def test_timers_of_both_domains(spark, tmp_path):
    rows = run(spark, tmp_path, p.Timed(10_000), [events([1, 2]), [FAR], [FAR]])
    assert [o[2] for o in outputs(rows, p.TIMEOUT) if o[0] == "a"] == [{"domain": "EventTime", "seen": ms(1)}] * 2
    rows = run(spark, tmp_path / "b", p.Timed(10_000, cancel=True), [events([1, 2]), [FAR], [FAR]])
    assert len([o for o in outputs(rows, p.TIMEOUT) if o[0] == "a"]) == 1
    rows = in_processing_time(spark, tmp_path / "c", p.Timed(500, "ProcessingTime"), [events([1])], 5)
    assert [o[2]["domain"] for o in outputs(rows, p.TIMEOUT)] == ["ProcessingTime"]


def test_restored_counts_are_added_up(spark, tmp_path):
    restored = spark.createDataFrame([("a", 5), ("a", 7), ("b", 1)], "key string, n bigint")
    stream = stream_of(spark, [events([1]), events([2])], EVENT, tmp_path / "in").withWatermark("ts", "0 seconds")
    rows = collect(p.run(stream, "key", p.RestoredCounter(), restored=restored), tmp_path)
    assert [o[2]["n"] for o in outputs(rows)] == [13, 14]
