import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import spread, windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    keys = [None, 1, 2] + [7] * 5
    return spark.createDataFrame([(rng.choice(keys), rng.randrange(50), i, float(i % 11)) for i in range(600)], "k int, t int, id int, v double").repartition(5)


def sets(df):
    return sorted(map(str, df.collect()))


def test_numbers(rows):
    got = spread.numbered(rows, ["k"], ["t", "id"], partitions=7)
    want = windows.over_rows(rows, ["k"], ["t", "id"], 10**6, {"row_no": F.count("*")})
    assert sets(got) == sets(want)


@pytest.mark.parametrize("block", [3, 40, 10**6])
def test_frames(rows, block):
    aggs = {"n": F.count("*"), "s": F.sum("v"), "f": F.first("id")}
    assert sets(spread.framed(rows, ["k"], ["t", "id"], aggs, 2, 0, block, 7)) == sets(windows.over_rows(rows, ["k"], ["t", "id"], 2, aggs))


def test_frames_that_look_ahead(rows):
    ahead = spread.framed(rows, ["k"], ["t", "id"], {"n": F.count("*")}, 1, 1, 4, 7)
    assert {r.n for r in ahead.where("k = 7").collect()} == {2, 3}
    assert ahead.where("k = 7 AND n = 2").count() == 2
    with pytest.raises(ValueError, match="beyond"):
        spread.framed(rows, ["k"], ["t", "id"], {}, 9, 0, 4)


def test_count_windows(rows):
    some = rows.where("k IS NOT NULL")
    assert sets(spread.count_windows(some, ["k"], ["t", "id"], 4, 7)) == sets(windows.count_windows(some, ["k"], ["t", "id"], 4))


def test_a_hot_key_is_cut_into_many_ranges(rows):
    placed = rows.where("k = 7").repartitionByRange(7, "k", "t", "id").groupBy(F.spark_partition_id()).count()
    assert placed.count() >= 5
