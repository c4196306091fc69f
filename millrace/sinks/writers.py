"""Sinks: console and memory, CSV files, Kafka, upserts into a database, a key-value store, a search index, retractions.

Functions named `*_batch` return what `foreachBatch` takes; they also write plain batches when called with (df, 0).
Rows go out from the tasks: each task makes its own client from an importable factory, writes in groups, and closes
it. A failed task is retried, so writes should be idempotent: upserts and keyed writes are; the search index takes
ids for that.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.polling import client_of


def console(stream: DataFrame, mode: str = "append", prefix: str = "", checkpoint: str | None = None) -> StreamingQuery:
    named = stream.select(F.lit(prefix).alias("sink"), "*") if prefix else stream
    writer = named.writeStream.format("console").outputMode(mode).option("truncate", "false")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def csv_files(df: DataFrame, path: str, checkpoint: str | None = None, **options: str) -> StreamingQuery | None:
    if df.isStreaming:
        return df.writeStream.format("csv").options(**options).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    df.write.options(**options).csv(path)
    return None


def as_csv_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_csv(F.struct("*")).alias("value"))


def as_json_documents(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """At least once. Needs Spark's Kafka package on the class path."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}
    return messages.writeStream.format("kafka").options(**options).start()


def _groups(rows: Iterator, size: int) -> Iterator[list]:
    while group := list(islice(rows, size)):
        yield group


def _partition_writer(options: dict, size: int, write: Callable) -> Callable[[Iterator], None]:
    def run(rows: Iterator) -> None:
        client = None
        try:
            for group in _groups(iter(rows), size):
                client = client or client_of(options)
                write(client, group)
        finally:
            if client is not None and hasattr(client, "close"):
                client.close()

    return run


def upsert_sql(table: str, columns: list[str], keys: list[str], dialect: str = "mysql") -> str:
    """An insert that updates the row with the same key."""
    rest = [c for c in columns if c not in keys]
    marks = ", ".join(["%s" if dialect == "mysql" else "?"] * len(columns))
    head = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({marks})"
    if dialect == "mysql":
        return head + " ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in rest or keys)
    return head + f" ON CONFLICT ({', '.join(keys)}) DO " + ("UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "NOTHING")


def last_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; partial maxima go before the exchange, so a hot key sends a row a task."""
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return rows.select(*keys, "_row.*").select(*df.columns)


def upsert_batch(table: str, keys: list[str], options: dict, dialect: str = "mysql", size: int = 200, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Client: a DB-API connection (cursor, commit, close); a commit for each group of `size` rows.

    With `order`, only each key's last row in that order is written. Without it every row is, the rows of a key in the
    order in which the batch holds them.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        columns = df.columns
        sql = upsert_sql(table, columns, keys, dialect)

        def write(client, group):
            cursor = client.cursor()
            cursor.executemany(sql, [tuple(r[c] for c in columns) for r in group])
            client.commit()

        if order:
            last_of_each(df, keys, order).foreachPartition(_partition_writer(options, size, write))
            return
        # rows of a key go to one task in the batch's order: no two transactions wait for each other, and the last row stays
        placed = df.withColumn("_mr_at", F.monotonically_increasing_id()).repartition(*keys).sortWithinPartitions("_mr_at")
        placed.select(*columns).foreachPartition(_partition_writer(options, size, write))

    return each


def key_value_batch(options: dict, value: str, key: str | None = None, constant: str = "user", size: int = 500) -> Callable[[DataFrame, int], None]:
    """Client: set(key, value). Without a key column all values go to the one key `constant`, and the last to arrive stays."""

    def each(df: DataFrame, batch_id: int) -> None:
        def write(client, group):
            for r in group:
                client.set(constant if key is None else str(r[key]), str(r[value]))

        df.select(*([key] if key else []), value).where(F.col(value).isNotNull()).foreachPartition(_partition_writer(options, size, write))

    return each


def search_batch(index: str, options: dict, id_column: str | None = None, size: int = 500) -> Callable[[DataFrame, int], None]:
    """Client: bulk(index, documents, ids). Without an id column the index makes ids, and a retry may write twice."""

    def each(df: DataFrame, batch_id: int) -> None:
        def write(client, group):
            client.bulk(index, [json.loads(r["value"]) for r in group], [r["id"] for r in group] if id_column else None)

        ids = [F.col(id_column).cast("string").alias("id")] if id_column else []
        df.select(F.to_json(F.struct("*")).alias("value"), *ids).foreachPartition(_partition_writer(options, size, write))

    return each


def changelog_batch(path: str, keys: list[str], order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Turns the upserts of update mode into change rows under `path`: op +I, -U and +U, with the values.

    Beside the changes, each batch writes the last values of all keys under `path`/last, which is all that the next one
    reads; older ones are deleted once a newer one is whole. A repeated batch reads what its first run read and writes
    the same. `order` tells the last of several rows of a key in a batch; without it a key has one row a batch, as in
    update mode, and more are an error.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        spark, out, state = df.sparkSession, f"{path}/batch_id={batch_id}", f"{path}/last"
        values = [c for c in df.columns if c not in keys]
        earlier = [b for b in _batches(spark, state) if b < batch_id]
        if order:
            new = last_of_each(df, keys, order)
        else:
            one = F.when(F.count("*") == 1, F.first(F.struct(*values))).otherwise(F.raise_error(F.lit("several rows of a key without an order")).cast(df.select(F.struct(*values).alias("v")).schema["v"].dataType))
            new = df.groupBy(*keys).agg(one.alias("_row")).select(*keys, "_row.*").select(*df.columns)
        old = spark.read.parquet(f"{state}/batch_id={earlier[-1]}") if earlier else df.limit(0)
        there = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_old"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        both = new.select(*keys, F.struct(*values).alias("_new")).join(there, same, "full_outer")
        key = [F.when(F.col("_new").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)]
        both = both.select(*key, "_new", "_old")
        both.select(*keys, F.coalesce("_new", "_old").alias("v")).select(*keys, *[F.col(f"v.{v}").alias(v) for v in values]).select(*df.columns).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        changed = both.where("_new IS NOT NULL AND (_old IS NULL OR NOT (_old <=> _new))")
        entry = lambda op, row: F.struct(F.lit(op).alias("op"), row.alias("v"))
        rows = F.when(F.col("_old").isNull(), F.array(entry("+I", F.col("_new")))).otherwise(F.array(entry("-U", F.col("_old")), entry("+U", F.col("_new"))))
        changes = changed.select(*keys, F.explode(rows).alias("c")).select("c.op", *keys, *[F.col(f"c.v.{v}").alias(v) for v in values])
        changes.select("op", *df.columns).write.mode("overwrite").parquet(out)
        for number in earlier[:-1]:
            _delete(spark, f"{state}/batch_id={number}")

    return each


def _delete(spark, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def push_lines(lines: Iterable[str], topic: str, producer, delay: float = 0.0) -> int:
    """Sends lines in turn through an injected producer (`send(topic, value)` gives a future whose `get()` waits for the acknowledgement); how many went.

    For tests and trials: one line at a time, each acknowledged before the next, `delay` seconds apart.
    """
    sent = 0
    for line in lines:
        producer.send(topic, line.rstrip("\r\n")).get()
        sent += 1
        if delay:
            time.sleep(delay)
    return sent


def _batches(spark, path: str) -> list[int]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).start()
