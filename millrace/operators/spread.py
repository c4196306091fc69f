"""Row order for hot keys: numbers, frames and count windows that spread one key over many tasks.

The plain forms in `windows` and `patterns` sort all rows of a key in one task, which is best while keys are small.
These range-partition by key and order instead, so that a key with a third of all rows is cut into many ranges; only
one row count a range is shared. `order` must tell a key's rows apart.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; where it names none, a local session gets a temporary one and a cluster an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed there."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str = "row_no", partitions: int | None = None) -> DataFrame:
    """`df` with each row's number in its key, from 1.

    A range holds a run of whole keys and at most a part of its first and of its last one, so only its first key can
    have rows before it: the offsets are at most one row a range, and are broadcast.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_rows")
    offsets = counts.withColumn("_before", before).where("_before > 0").select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(number))


def framed(df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, Column], preceding: int = 0, following: int = 0,
           block_rows: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Aggregates over `preceding` rows before to `following` rows after each row, in blocks of a key's rows.

    A block also gets the rows of its neighbours that its frames reach; they are dropped once the frames are computed.
    Frames may not be longer than a block.
    """
    if max(preceding, following) > block_rows:
        raise ValueError("a frame reaches beyond the neighbouring block")
    rows = numbered(df, keys, order, "_n", partitions)
    home = F.floor((F.col("_n") - 1) / block_rows)
    place = F.pmod(F.col("_n") - 1, F.lit(block_rows))
    blocks = F.array_compact(F.array(home, F.when(place >= block_rows - preceding, home + 1), F.when((place < following) & (home > 0), home - 1)))
    spread = rows.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-preceding, following)
    return spread.withColumns({name: agg.over(frame) for name, agg in aggs.items()}).where("_block = _home").select(*df.columns, *aggs)


def count_windows(df: DataFrame, keys: list[str], order: list[str], size: int, partitions: int | None = None) -> DataFrame:
    """`windows.count_windows` for hot keys: (window_no, position) of the rows of full windows."""
    rows = numbered(df, keys, order, "_n", partitions)
    totals = df.groupBy(*keys).agg(F.count("*").alias("_total")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_total")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    full = rows.join(totals, same).where(F.col("_n") <= F.col("_total") - F.col("_total") % size)
    return full.select(*df.columns, F.floor((F.col("_n") - 1) / size).cast("bigint").alias("window_no"), (F.pmod(F.col("_n") - 1, F.lit(size)) + 1).alias("position"))
