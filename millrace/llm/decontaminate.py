"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of consecutive benchmark words. Patterns of one length m share a table: the shift of a
two-word block says how far the window may move on before a pattern could end with that block (m - 1 words if
none holds it); where the shift is zero, the suffix block selects a bucket, the prefix block narrows it, and the
words themselves are compared. Items shorter than a window form patterns of their own length in tables of
their own, so that they do not shorten the shifts of the others.

Words are maximal runs of ASCII letters, digits and any character beyond ASCII, after lower-casing A-Z. Nulls
and texts without words have no words, no hits and are not contaminated. A window that several items hold
counts for each of them. Items with a null id hit words but are not listed; repeated ids are listed once.

The benchmark goes to the executors in blocks of at most BLOCK_CHARS characters (or one item). Its size is summed in
the cluster first: a benchmark of one block is broadcast in one pass over the documents; a larger one takes a pass a
block, each held and dropped before the next is fetched, and the hits, kept as checkpoints, are kept once and joined
per distinct (id, text). Repeated documents are judged alike; columns named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_from_text, cut, without

WINDOW = 10
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8_000_000

Word = bytes
Pattern = tuple[Word, ...]

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[Word]:
    return text.encode().translate(_KEEP).split()


class WuManber:
    """Finds patterns of one length."""

    def __init__(self, patterns: Iterable[Pattern], length: int):
        self.length, self.block = length, min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[Pattern, int] = {}
        self.buckets: dict[Pattern, dict[Pattern, list[tuple[Pattern, int]]]] = {}
        for number, pattern in enumerate(patterns):
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            by_prefix = self.buckets.setdefault(pattern[-self.block :], {})
            by_prefix.setdefault(pattern[: self.block], []).append((pattern, number))

    def search(self, text: list[Word]) -> Iterator[tuple[int, int]]:
        """The start and the pattern number of every occurrence."""
        m, b, shift_of, furthest, n = self.length, self.block, self.shift.get, self.furthest, len(text)
        end = m
        while end <= n:
            block = (text[end - 2], text[end - 1]) if b == 2 else (text[end - 1],)
            if skip := shift_of(block, furthest):
                end += skip
                continue
            start = end - m
            for pattern, number in self.buckets[block].get(tuple(text[start : start + b]), ()):
                if tuple(text[start:end]) == pattern:
                    yield start, number
            end += 1


class Benchmark:
    """The tables of a block of benchmark items."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], window: int = WINDOW):
        found: dict[int, dict[Pattern, set]] = {}
        for item, text in items:
            w = words(text or "")
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).update(() if item is None else (item,))
        self.tables = [(WuManber(of, m), list(of.values())) for m, of in sorted(found.items())]

    def hits(self, text: list[Word]) -> tuple[list[tuple[int, int]], set]:
        """The merged ranges of words inside occurrences, and the ids of the items they come from."""
        ranges, items = [], set()
        for table, owners in self.tables:
            for start, number in table.search(text):
                ranges.append((start, start + table.length))
                items |= owners[number]
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; the driver holds a block and a partition at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").toLocalIterator():
        if held and size + len(row.text) > most:
            yield held
            held, size = [], 0
        held.append((row.item, row.text))
        size += len(row.text)
    if held:
        yield held


_RANGES = T.ArrayType(T.ArrayType(T.IntegerType()))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("contaminated", T.BooleanType()),
]


def _scan(df: DataFrame, text: str, items: list[tuple], window: int, ranges: bool, keep_text: bool = True) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    fields = [*FIELDS, T.StructField("hit_ranges", _RANGES)] if ranges else FIELDS

    def start():
        tables = _tables(shared, window)

        def work(column: pa.Array):
            out = []
            for value in column.to_pylist():
                w = words(value or "")
                spans, owners = tables.hits(w)
                out.append((len(w), sum(b - a for a, b in spans), sorted(owners), bool(spans), spans))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
            return [pa.array([row[i] for row in out], kinds[i]) for i in range(len(fields))]

        return work

    return add_from_text(df, text, fields, start, keep_text)


_BUILT: dict = {}


def _tables(shared, window: int) -> Benchmark:
    """Built once in a worker for each broadcast."""
    key = (id(shared.value), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (Benchmark(shared.value, window), shared.value)
    return _BUILT[key][0]


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep_text: bool = True) -> DataFrame:
    """`documents` with n_words, n_hit, item_ids (ascending) and contaminated."""
    total = benchmark.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    parts = blocks(benchmark, item_id, item_text, block_chars)
    if total <= block_chars:
        return _scan(documents, text, next(parts, []), window, ranges=False, keep_text=keep_text)
    own = documents.withColumn("_mr_key", F.xxhash64(text))
    hits = None
    for part in parts:
        found = cut(_scan(own.select(doc_id, "_mr_key", text), text, part, window, ranges=True, keep_text=False).where("contaminated").dropDuplicates([doc_id, "_mr_key"]))
        hits = found if hits is None else hits.unionByName(found)
    per = hits.groupBy(doc_id, "_mr_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_ranges")))).alias("_mr_ranges"),
    )
    covered = F.aggregate(
        "_mr_ranges",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, r: F.struct(
            F.greatest(acc["upto"], r[1]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), r[1] - F.greatest(acc["upto"], r[0]))).alias("n"),
        ),
    )["n"]
    per = per.select(F.col(doc_id).alias("_mr_id"), F.col("_mr_key").alias("_mr_k"), "item_ids", covered.alias("n_hit"))
    counted = _scan(without(own, [f.name for f in FIELDS]), text, [], window, ranges=False, keep_text=keep_text).drop("n_hit", "item_ids", "contaminated")
    joined = counted.join(per, F.col(doc_id).eqNullSafe(F.col("_mr_id")) & F.col("_mr_key").eqNullSafe(F.col("_mr_k")), "left")
    return joined.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)),
        "item_ids": F.coalesce("item_ids", F.array().cast("array<bigint>")),
        "contaminated": F.col("n_hit").isNotNull() & (F.coalesce("n_hit", F.lit(0)) > 0),
    }).drop("_mr_id", "_mr_key", "_mr_k")
