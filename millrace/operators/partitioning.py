"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows of a key together."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def shuffled(df: DataFrame, partitions: int, seed: int = 0) -> DataFrame:
    """Rows dealt at random."""
    return df.repartition(partitions, F.rand(seed))


def in_one(df: DataFrame) -> DataFrame:
    """All rows in one task: for small results only."""
    return df.coalesce(1)


def rebalanced(df: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt in turn."""
    return df.repartition(partitions)
