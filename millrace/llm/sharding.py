"""Sharding by histogram sort: shards of near-equal bytes, equal texts together.

Rows are ordered by (text hash, doc_id, row number). Splitters between shards are found by counting, not by
sampling: each round sums the exact bytes below candidate boundaries inside the blocks of the key space that still
hold an unsettled splitter, keeps the sub-block that holds the target and probes it anew, until the bytes below a
boundary are within tolerance of its target. A block that is down to one text is cut inside (by doc_id, then by row)
only if keeping the text whole would miss the target by more than `group_tolerance` of a shard. The driver sees
block sums only: at most PROBES sums a splitter and round.

Then the narrow rows (key, size, checksum; no text) are exchanged once, straight to the partition of their range;
shards of many rows have several ranges, so that no task orders a whole shard. Slots are positions in that order,
counted where the rows arrive.

Size is the UTF-8 bytes of the text (null: none) plus 8. Null doc_ids sort first. Repeated rows have places of
their own. Other columns, whatever their names, are not read. An empty table gives no rows. Law: "bytes"; rows are neither dropped nor sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

SHARDS = 24
#: Of a shard's bytes: how far a splitter may be from its target, and how far for the sake of a whole text group.
TOLERANCE, GROUP_TOLERANCE = 0.005, 0.025
#: Bits of key that a round resolves.
PROBE_BITS = 10
#: Rows in a range, and ranges in a shard at most (beyond, ranges grow and sort with spilling).
RANGE_ROWS, SHARD_RANGES = 250_000, 64
ROW_OVERHEAD = 8

_KEY = ("h", "id", "row")
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Block:
    """Keys whose first len(prefix) columns equal `prefix` and whose next column shifted right by `bits` is `index`."""

    prefix: tuple[int, ...]
    bits: int
    index: int

    def condition(self):
        out = F.lit(True)
        for name, value in zip(_KEY, self.prefix, strict=False):
            out = out & (F.col(name) == F.lit(value))
        return out if self.bits == 64 else out & (F.shiftright(_KEY[len(self.prefix)], self.bits) == F.lit(self.index))

    def edge(self, above: bool) -> tuple[int, int, int]:
        """The least key of the block, or the least beyond it."""
        key = [*self.prefix, (self.index + above) << self.bits]
        while key[-1] >= 1 << 63:  # beyond the largest value of this column: the next value of the one before
            key.pop()
            if not key:
                return ((1 << 63) - 1,) * 3
            key[-1] += 1
        return tuple([*key, *[LEAST] * (3 - len(key))])


@dataclass
class Target:
    at: float
    slack: float
    group_slack: float
    block: Block
    below: int
    edge: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class Cell:
    """What a sub-block holds: exact bytes and rows, and the least and largest value of the column it divides."""

    bytes: int
    rows: int
    low: int
    high: int


def _round(keys: DataFrame, blocks: list[Block]) -> dict[int, list[Cell]]:
    """The sub-blocks with rows of each block, by its number, in ascending order."""
    number, cell, value = F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for i, block in enumerate(blocks):
        inside, column = block.condition(), _KEY[len(block.prefix)]
        number = F.when(inside, F.lit(i)).otherwise(number)
        cell = F.when(inside, F.shiftright(column, max(0, block.bits - PROBE_BITS))).otherwise(cell)
        value = F.when(inside, F.col(column)).otherwise(value)
    dealt = keys.select(number.alias("block"), cell.alias("cell"), value.alias("value"), "size").where("block IS NOT NULL")
    sums = dealt.groupBy("block", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    out: dict[int, list[Cell]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.block, r.cell)):
        out.setdefault(r.block, []).append(Cell(r.bytes, r.rows, r.low, r.high))
    return out


def splitters(keys: DataFrame, total: int, shards: int, per_shard: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int, int]]:
    """Ascending keys between `shards` * `per_shard` ranges; those between shards are the exact ones, the others have a tenth of a range to spare."""
    ranges, whole = shards * per_shard, Block((), 64, 0)
    targets = []
    for j in range(1, ranges):
        loose = 0.1 * total / ranges if j % per_shard else 0.0
        targets.append(Target(total * j / ranges, max(loose, tolerance * total / shards), max(loose, group_tolerance * total / shards), whole, 0))
    while open_ := [t for t in targets if t.edge is None]:
        blocks = list(dict.fromkeys(t.block for t in open_))
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            cells = _round(keys, some)
            for t in open_:
                if t.block in some:
                    _refine(t, cells.get(some.index(t.block), []))
    return [t.edge for t in targets]


def _refine(t: Target, cells: list[Cell]) -> None:
    """Settle the splitter at an edge of the sub-block that holds the target, or go into that sub-block."""
    prefix, below = t.block.prefix, t.below
    for k, cell in enumerate(cells):
        if below + cell.bytes < t.at and k + 1 < len(cells):
            below += cell.bytes
            continue
        bits = 64 if (cell.low < 0) != (cell.high < 0) else (cell.low ^ cell.high).bit_length()
        inner = Block(prefix, bits, cell.low >> bits)  # no wider than its values are apart
        low, high = t.at - below, below + cell.bytes - t.at
        final = cell.rows == 1 or not bits and len(prefix) == 2
        slack = t.group_slack if not bits and not prefix else t.slack
        if final or min(low, high) <= slack:
            t.edge = inner.edge(high < low)
        elif bits:
            t.block, t.below = inner, below
        else:
            t.block, t.below = Block((*prefix, cell.low), 64, 0), below
        return
    t.edge = t.block.edge(False)


def ranks(keys: list[np.ndarray], splits: np.ndarray) -> np.ndarray:
    """For each key, the splitters that are not above it, comparing column by column."""
    if len(keys) == 1:
        return np.searchsorted(splits[:, 0], keys[0], "right")
    out = np.searchsorted(splits[:, 0], keys[0], "left")
    lo, hi = out, np.searchsorted(splits[:, 0], keys[0], "right")
    for v in np.unique(splits[lo[hi > lo], 0]) if (hi > lo).any() else ():
        rows = np.flatnonzero(keys[0] == v)
        out[rows] += ranks([k[rows] for k in keys[1:]], splits[splits[:, 0] == v][:, 1:])
    return out


def shard(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE,
          group_tolerance: float = GROUP_TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    keys = cut(df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(data) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("h"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LEAST)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_shard = max(1, min(SHARD_RANGES, -(-rows // (shards * range_rows))))
    found = splitters(keys, total, shards, per_shard, tolerance, group_tolerance) if rows else []
    splits = np.array(found, np.int64).reshape(-1, 3)

    def place(batches):
        for batch in batches:
            at = ranks([batch.column(i).to_numpy() for i in (3, 4, 5)], splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "range"])

    ranged = keys.mapInArrow(place, "doc_id bigint, size bigint, text_crc32 bigint, h bigint, id bigint, row bigint, range int")
    sent = ranged.repartitionById(shards * per_shard, "range").sortWithinPartitions("range", "h", "id", "row")
    # a partition holds one range in order, so the low bits of these ids are places in it
    ordered = cut(sent.withColumn("order", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dict(ordered.groupBy("range").count().collect())
    before, offsets = 0, []
    for i in range(shards * per_shard):
        before = 0 if i % per_shard == 0 else before
        offsets.append((i, before))
        before += counts.get(i, 0)
    offset = df.sparkSession.createDataFrame(offsets, "range int, before bigint")
    placed = ordered.join(F.broadcast(offset), "range")
    return placed.select(
        "doc_id", "size", "text_crc32", (F.col("range") / per_shard).cast("int").alias("shard"), (F.col("order") + F.col("before")).cast("bigint").alias("slot")
    )
