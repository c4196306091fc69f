"""What the corpus operators share: tables, checkpoints, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once, whatever Spark's batch size is.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is stored in fewer splits than there are cores is dealt to all of them. Larger ones are read as they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a local session gets a temporary one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """`df` materialised in the shared folder, so that no later loss recomputes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` less the columns that an operator is about to add; names differing by case are the same name."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes in column `at`, or of one row."""
    column = batch.column(at)
    if column.nbytes <= most:
        yield batch
        return
    lengths = pa.compute.list_value_length(column) if pa.types.is_list(column.type) else pa.compute.binary_length(column)
    each = 8 if pa.types.is_list(column.type) else 1
    sizes = [n * each for n in lengths.fill_null(0).to_pylist()]
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def add_from_text(df: DataFrame, text: str, fields: list[T.StructField], start: Callable[[], Callable], keep_text: bool = True) -> DataFrame:
    """`df` with `fields` computed from column `text` in Arrow batches.

    `start()` runs once in each task and returns a function from an Arrow string (or list) array to the
    arrays of the new fields. Columns of `df` with a new field's name are replaced. Without `keep_text` the text
    itself is left out, and so never sent back by the Python workers.
    """
    kept = without(df, [f.name for f in fields])
    if text.lower() not in {c.lower() for c in kept.columns}:
        raise ValueError(f"a new field has the name of the text column: {text}")
    at = [c.lower() for c in kept.columns].index(text.lower())
    passed = [i for i in range(len(kept.columns)) if keep_text or i != at]
    schema = T.StructType([*[kept.schema.fields[i] for i in passed], *fields])

    def run(batches):
        import pyarrow.compute  # noqa: F401  (slices() needs it loaded)

        work = start()
        for batch in batches:
            for piece in slices(batch, at):
                if piece.num_rows:
                    yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in passed], *work(piece.column(at))], names=schema.names)

    return kept.mapInArrow(run, schema)


def text_or_empty(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
