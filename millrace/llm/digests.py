"""Digest columns that the registered queries derive from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_spans(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined in the array's order; only the given kinds, or all."""
    array = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)
