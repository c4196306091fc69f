import json
import sqlite3

import pytest

from millrace.functions import records
from millrace.sinks import writers
from millrace.sources import config, polling, readers
from tests.streams import collect


@pytest.fixture
def options(tmp_path):
    return {"client": "tests.fakes:files", "dir": str(tmp_path)}


def test_text_and_csv_files_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("0001,equipment1,34.1,1762392490\n0002,é,x,\n")
    path = str(tmp_path / "in")
    lines = readers.text_lines(spark, path)
    got = records.parse_csv(lines, records.OBSERVATION, millis=True).drop("ts").collect()
    assert [tuple(r) for r in got] == [(1, "equipment1", 34.1, 1762392490), (2, "é", None, None)]
    assert [r.value for r in collect(readers.text_lines(spark, path, True, 1), tmp_path)] == [r.value for r in lines.collect()]
    table = readers.csv_table(spark, path, records.OBSERVATION)
    assert table.count() == 2 and len(collect(readers.csv_table(spark, path, records.OBSERVATION, True), tmp_path)) == 2
    assert [r.id for r in readers.from_csv_values(lines, records.OBSERVATION).collect()] == [1, 2]
    writers.csv_files(table, str(tmp_path / "out"))
    assert readers.csv_table(spark, str(tmp_path / "out"), records.OBSERVATION).count() == 2
    assert [r.value for r in writers.as_csv_messages(table.limit(1)).collect()] == ["1,equipment1,34.1,1762392490"]


def test_kafka_options_and_topics():
    assert readers.kafka_options("h:1", "t", "latest", "g", 4) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest", "kafka.group.id": "g", "minPartitions": "4"}

    class TopicExistsError(Exception):
        pass

    class Admin:
        def __init__(self, error=None):
            self.error, self.made = error, []

        def create_topic(self, *a):
            if self.error:
                raise self.error
            self.made.append(a)

    assert readers.ensure_topic(Admin(), "t") and not readers.ensure_topic(Admin(TopicExistsError()), "t")
    with pytest.raises(RuntimeError):
        readers.ensure_topic(Admin(RuntimeError()), "t")


def test_jdbc_reads_an_embedded_database(spark, tmp_path):
    url = f"jdbc:derby:memory:mill{tmp_path.name};create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "ID int, NAME string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "T").save()
    assert readers.jdbc_table(spark, url, 'SELECT "ID", "NAME" FROM T WHERE "ID" > 6').count() == 3
    assert readers.jdbc_table(spark, url, "SELECT * FROM T", split=("ID", 0, 10, 3)).count() == 10


def test_generated_access_lines_parse(spark):
    good, bad = records.routed(records.parse_access_log(readers.access_lines(spark, streaming=False, total=50)))
    assert good.count() == 50 and bad.count() == 0


def poll(spark, source, tmp_path, batches=2, **options):
    polling.register(spark)
    return collect(spark.readStream.format(source).options(**options).load(), tmp_path, manual=True, batches=batches)


def test_polling_table(spark, tmp_path, options):
    (tmp_path / "table.json").write_text(json.dumps([[1, "a"], [2, "b"]]))
    full = poll(spark, "polling_table", tmp_path, **options, query="q", schema="id int, name string")
    assert len(full) >= 4 and {tuple(r) for r in full} == {(1, "a"), (2, "b")}
    new = poll(spark, "polling_table", tmp_path, 1, **options, query="q", schema="id int, name string", incremental="id")
    assert [tuple(r) for r in new] == [(1, "a"), (2, "b")]


def test_polling_key_and_search(spark, tmp_path, options):
    (tmp_path / "key-user").write_text("31.5")
    assert {tuple(r) for r in poll(spark, "polling_key", tmp_path, 1, **options)} == {("user", "31.5")}
    (tmp_path / "idx.json").write_text(json.dumps([{"n": i} for i in range(7)]))
    hits = spark.read.format("search_index").options(**options, index="idx", slices="2").load().collect()
    assert sorted(json.loads(r.value)["n"] for r in hits) == list(range(7))


def test_upserts(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    each = writers.upsert_batch("t", ["id"], {"client": "tests.fakes:sqlite", "dir": str(tmp_path)}, "sqlite", 2)
    each(spark.createDataFrame([(i, "a") for i in range(5)], "id int, name string").coalesce(1), 0)
    each(spark.createDataFrame([(3, "b"), (9, "b")], "id int, name string").coalesce(1), 1)
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        assert con.execute("SELECT id, name FROM t ORDER BY id").fetchall() == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "a"), (9, "b")]
    assert writers.upsert_sql("t", ["id", "x"], ["id"]) == "INSERT INTO t (id, x) VALUES (%s, %s) ON DUPLICATE KEY UPDATE x = VALUES(x)"


def test_the_last_row_of_a_key_is_upserted_last(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    rows = [(i % 3, f"{i:03}") for i in range(300)]
    writers.upsert_batch("t", ["id"], {"client": "tests.fakes:sqlite", "dir": str(tmp_path)}, "sqlite", 7)(spark.createDataFrame(rows, "id int, name string").coalesce(1), 0)
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        assert con.execute("SELECT id, name FROM t ORDER BY id").fetchall() == [(0, "297"), (1, "298"), (2, "299")]


def test_key_value_and_search_sinks(spark, tmp_path, options):
    df = spark.createDataFrame([(1, 30.5), (2, None)], "id int, temperature double")
    writers.key_value_batch(options, "temperature")(df, 0)
    writers.key_value_batch(options, "temperature", "id")(df, 0)
    assert (tmp_path / "key-user").read_text() == "30.5" and (tmp_path / "key-1").read_text() == "30.5" and not (tmp_path / "key-2").exists()
    writers.search_batch("docs", options, "id")(df, 0)
    assert json.loads((tmp_path / "docs-1").read_text()) == {"id": 1, "temperature": 30.5}
    assert list(tmp_path.glob("closed-*"))


def test_changelog(spark, tmp_path):
    each = writers.changelog_batch(str(tmp_path / "log"), ["k"])
    batches = [[("a", 1), ("b", 1)], [("a", 2), ("b", 1)], [("a", 3), ("c", 1)]]
    for i, rows in enumerate(batches):
        each(spark.createDataFrame(rows, "k string, n int"), i)
    got = [[tuple(r) for r in spark.read.parquet(f"{tmp_path}/log/batch_id={i}").orderBy("k", "n").collect()] for i in range(3)]
    assert got == [[("+I", "a", 1), ("+I", "b", 1)], [("-U", "a", 1), ("+U", "a", 2)], [("-U", "a", 2), ("+U", "a", 3), ("+I", "c", 1)]]


def test_ordered_upserts_keep_the_last_row_whatever_the_partitions(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, v INTEGER)")
    rows = [(i % 4, f"{(i * 7919) % 400:03}", (i * 7919) % 400) for i in range(400)]
    each = writers.upsert_batch("t", ["id"], {"client": "tests.fakes:sqlite", "dir": str(tmp_path)}, "sqlite", 7, order=["v"])
    each(spark.createDataFrame(rows, "id int, name string, v int").repartition(5), 0)
    with sqlite3.connect(tmp_path / "db.sqlite") as con:
        assert con.execute("SELECT id, name, v FROM t ORDER BY id").fetchall() == [(k, *max((n, v) for i, n, v in rows if i == k)) for k in range(4)]


def test_a_changelog_reads_the_last_values_only(spark, tmp_path):
    each = writers.changelog_batch(str(tmp_path / "log"), ["k"], order=["n"])
    make = lambda rows: spark.createDataFrame(rows, "k string, n int").repartition(3)
    each(make([("a", 1), ("a", 5), (None, 2)]), 0)
    each(make([("b", 1)]), 1)
    each(make([("a", 7), ("a", 6), (None, 2)]), 2)
    read = lambda i: sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/log/batch_id={i}").collect()), key=str)
    assert read(0) == [("+I", "a", 5), ("+I", None, 2)] and read(2) == [("+U", "a", 7), ("-U", "a", 5)]
    assert sorted(x.name for x in (tmp_path / "log/last").glob("batch_id=*")) == ["batch_id=1", "batch_id=2"]  # older ones are gone
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/log/last/batch_id=2").collect()} == {("a", 7), ("b", 1), (None, 2)}
    each(make([("a", 7), ("a", 6), (None, 2)]), 2)  # a repeated batch gives the same
    assert read(2) == [("+U", "a", 7), ("-U", "a", 5)]
    with pytest.raises(Exception, match="several rows of a key"):
        writers.changelog_batch(str(tmp_path / "other"), ["k"])(make([("a", 1), ("a", 2)]), 0)


class Rows:
    """A table whose polls are counted; `after` selects what a real query would."""

    polls = 0
    rows = [(9, "i"), (10, "j"), (11, "k"), (12, "l")]

    def query(self, sql, after):
        Rows.polls += 1
        return [r for r in self.rows if after is None or r[0] > int(after)]


def client(options):
    return Rows()


def test_a_restarted_poll_gives_each_row_once():
    options = {"client": "tests.test_connectors:client", "query": "q", "incremental": "id"}
    first = polling.TablePoll(options)
    rows, one = first.read(first.initialOffset())
    assert len(list(rows)) == 4 and one == {"poll": 1, "after": "12"}
    start, end = {"poll": 0, "after": "9"}, {"poll": 3, "after": "11"}  # three polls were planned before the restart
    Rows.polls = 0
    assert list(polling.TablePoll(options).readBetweenOffsets(start, end)) == [(10, "j"), (11, "k")] and Rows.polls == 1
    assert list(polling.TablePoll(options).readBetweenOffsets(start, {"poll": 2, "after": "9"})) == []
    full = polling.TablePoll({"client": "tests.test_connectors:client", "query": "q"})
    assert len(list(full.readBetweenOffsets({"poll": 0, "after": ""}, {"poll": 2, "after": ""}))) == 4


def test_offsets_order_numbers_by_size():
    assert sorted(["10", 9, "b", None, "a", "2.5"], key=polling.ordered) == [None, "2.5", 9, "10", "a", "b"]


def test_lines_are_pushed_in_turn_and_acknowledged():
    log = []

    class Producer:
        def send(self, topic, value):
            log.append(("send", topic, value))
            return type("Future", (), {"get": lambda self: log.append(("ack", value))})()

    assert writers.push_lines(["a\n", "b\r\n", ""], "t", Producer()) == 3
    assert log == [("send", "t", "a"), ("ack", "a"), ("send", "t", "b"), ("ack", "b"), ("send", "t", ""), ("ack", "")]


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("top: 3\nhot:\n  topic: clicks\n  window: 60\n  color: red\n")
    got = config.load(str(tmp_path / "c.yml"), "hot")
    assert (got.top, got.topic, got.window, got.extra, got.watermark) == (3, "clicks", 60, {"color": "red"}, "32 seconds")
    assert config.from_args(["--config", str(tmp_path / "c.yml"), "--section", "hot", "--top", "9"]).top == 9
    with pytest.raises(KeyError):
        config.load(str(tmp_path / "c.yml"), "none")
