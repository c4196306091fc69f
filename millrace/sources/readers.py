"""Sources: text and CSV files, sockets, Kafka, relational tables, in-memory rows, generated access lines.

Batch and streaming readers share their schemas. Credentials come from options or the environment, never from code.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_lines(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of a file or folder, as UTF-8, in a column `value`; splits never cut a line."""
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False, **options: str) -> DataFrame:
    """The file-system table: CSV with a declared schema."""
    reader = (spark.readStream if streaming else spark.read).schema(schema).options(**options)
    return reader.csv(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket; for trials only, since nothing can be replayed."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_options(servers: str, topic: str, offsets: str = "earliest", group: str | None = None, partitions: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets}
    if group:
        out["kafka.group.id"] = group
    if partitions:
        out["minPartitions"] = str(partitions)
    return out


def kafka_lines(spark: SparkSession, servers: str, topic: str, offsets: str = "earliest", group: str | None = None, partitions: int | None = None) -> DataFrame:
    """Message values as text. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, offsets, group, partitions))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def kafka_csv(spark: SparkSession, servers: str, topic: str, schema: T.StructType, offsets: str = "latest", **more) -> DataFrame:
    """The Kafka table in CSV format."""
    return from_csv_values(kafka_lines(spark, servers, topic, offsets, **more), schema)


def from_csv_values(lines: DataFrame, schema: T.StructType) -> DataFrame:
    return lines.select(F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " ")).alias("r")).select("r.*")


def ensure_topic(admin, topic: str, partitions: int = 1, replicas: int = 1) -> bool:
    """Create a topic through an injected admin client (`create_topic(name, partitions, replicas)`); whether it was new.

    A client's error whose class is named TopicExists... or TopicAlreadyExists... means that it was there.
    """
    try:
        admin.create_topic(topic, partitions, replicas)
    except Exception as e:
        if type(e).__name__.startswith(("TopicExists", "TopicAlreadyExists")):
            return False
        raise
    return True


def jdbc_table(spark: SparkSession, url: str, query: str, driver: str | None = None, user: str | None = None, password: str | None = None, fetch: int = 1000,
               split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query over a relational database. `split` (column, lowest, highest, partitions) reads in parallel ranges.

    User and password default to MILLRACE_DB_USER and MILLRACE_DB_PASSWORD.
    """
    options = {"url": url, "fetchsize": str(fetch), "driver": driver, "user": user or os.environ.get("MILLRACE_DB_USER"), "password": password or os.environ.get("MILLRACE_DB_PASSWORD")}
    if split:
        column, low, high, parts = split
        options |= {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    else:
        options["query"] = query
    return spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v is not None}).load()


def rows(spark: SparkSession, values: list[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(values, schema)


ADDRESSES = ("83.149.9.216", "83.149.24.197", "46.105.14.53", "110.136.166.128")
PATHS = ("/", "/blog/tags/puppet", "/images/logo.png", "/style2.css", "/projects/xdotool", "/robots.txt", "/presentations/intro.html")


def access_lines(spark: SparkSession, per_second: int = 10, seed: int = 1, streaming: bool = True, total: int = 100) -> DataFrame:
    """Random access-log lines: a stream at a rate, or `total` lines. Timestamps are the time of generation."""
    base = spark.readStream.format("rate").option("rowsPerSecond", per_second).load() if streaming else spark.range(total).withColumn("timestamp", F.current_timestamp())
    pick = lambda values, s: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(s) * len(values)) + 1).cast("int"))
    stamp = F.date_format("timestamp", "dd/MM/yyyy:HH:mm:ss")
    return base.select(F.concat(pick(ADDRESSES, seed), F.lit(" - - "), stamp, F.lit(" +0000 GET "), pick(PATHS, seed + 1)).alias("value"))
