"""Runs a stream over rows in chosen micro-batches, and collects its output."""

import json
import os
import time
import uuid

from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType())])


def write_batch(spark, rows, schema, folder, number):
    """One JSON file: a micro-batch of a stream that reads a file a trigger."""
    os.makedirs(folder, exist_ok=True)
    lines = [r for r in spark.createDataFrame(rows, schema).toJSON().collect()]
    tmp = f"{folder}/_{number}"
    with open(tmp, "w") as f:
        f.write("\n".join(lines))
    os.rename(tmp, f"{folder}/{number:03d}.json")
    os.utime(f"{folder}/{number:03d}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def stream_of(spark, batches, schema, folder):
    for i, rows in enumerate(batches):
        write_batch(spark, rows, schema, folder, i)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collect(stream, tmp_path, mode="append", manual=False, batches=0):
    """All rows that the stream gives; manual: stopped by hand after `batches` batches."""
    name = "t" + uuid.uuid4().hex
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    if manual:
        q = writer.start()
        began = time.time()
        while len([p for p in q.recentProgress if p["numInputRows"]]) < batches and time.time() - began < 90:
            time.sleep(0.3)
            if q.exception():
                raise q.exception()
        time.sleep(1)
        q.stop()
    else:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def outputs(rows, tag=None):
    return [(r.key, r.tag, json.loads(r.payload)) for r in rows if tag is None or r.tag == tag]
