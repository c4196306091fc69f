"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by BK-trees.

Fingerprint: ASCII-lower-cased words, four-word shingles with repeats (fewer words: the whole sequence), XXH64
with seed 42; a bit is set if over half the hashes set it. No words: fingerprint zero, linked like any other.

Links: two fingerprints within the radius r agree on at least k of r + k equal slices of their bits, so each
distinct fingerprint goes to one shard per choice of k slices, keyed by their bits; k grows with the number of
fingerprints so that shards stay small. In each shard a BK-tree (children keyed by their integer Hamming distance
to the parent) is built and every fingerprint follows only edges within the radius. Subtrees that already lie in
the searcher's component are skipped, since only reachability counts; a shard thus returns at most one link a
fingerprint. Shards above SHARD_CODES fingerprints are split into parts; the tree of a part is searched for up to
RIGHT_PARTS later parts at a time, in a task of their own. The trees are built where their shard is, not broadcast from the driver: all fingerprints together grow with
the corpus. Components of the links are then taken over distinct fingerprints.

Null texts have no words. Repeated rows share a component. component_id is the smallest doc_id reachable; nulls
among the ids are passed over, and a component of nulls alone has a null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_from_text, cut
from millrace.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in one tree before its shard is split.
SHARD_CODES = 3000
#: Parts of a split shard that are searched for in one building of another part's tree.
RIGHT_PARTS = 8
#: Mean fingerprints that the slices leave in a shard.
SHARD_MEAN = 48

_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # both in ASCII: no other bytes are lower-cased or white
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        stops = ends[width - 1 + at : width - 1 + at + _HASHES_AT_ONCE].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _HASHES_AT_ONCE], stops, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str = "text", code: str = "code", shingle: int = SHINGLE, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """`df` with the fingerprint as a signed bigint."""

    def start():
        return lambda column: [pa.array(np.array([fingerprint(t, shingle, seed) for t in column.to_pylist()], np.uint64).view(np.int64))]

    return add_from_text(df, text, [T.StructField(code, T.LongType())], start, keep_text)


class BkTree:
    """A tree over distinct codes, with the union of those found within the radius."""

    def __init__(self, codes: list[int], radius: int):
        self.codes, self.radius = codes, radius
        n = len(codes)
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        self.parent = list(range(n))  # of the union
        self.order = [0] if n else []
        up = [0] * n
        for i in range(1, n):
            at, code = 0, codes[i]
            while True:
                d = (code ^ codes[at]).bit_count()
                if (child := self.children[at].get(d)) is None:
                    break
                at = child
            self.children[at][d] = i
            up[i] = at
            if d <= radius:
                self.unite(i, at)
            self.order.append(i)
        self.up = up
        self.same: list[int] = []
        self.settle()

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def settle(self) -> None:
        """same[i]: a node whose component holds i's whole subtree, or -1. Later unions keep this true."""
        same = [self.root(i) for i in range(len(self.codes))]
        for i in reversed(self.order[1:]):
            if same[i] < 0 or same[self.up[i]] != same[i]:
                same[self.up[i]] = -1
        self.same = same

    def reach(self, code: int, known: set[int]) -> list[int]:
        """One node within the radius from each component not in `known`; `known` gains them, and subtrees that lie in known components are skipped."""
        found, stack, radius, codes, children, same = [], [0] if self.codes else [], self.radius, self.codes, self.children, self.same
        while stack:
            at = stack.pop()
            if same[at] >= 0 and self.root(same[at]) in known:
                continue
            d = (code ^ codes[at]).bit_count()
            if d <= radius and (r := self.root(at)) not in known:
                known.add(r)
                found.append(at)
            kids = children[at]
            if len(kids) > 2 * radius:
                stack += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
            else:
                stack += [c for k, c in kids.items() if -radius <= k - d <= radius]
        return found

    def connect(self) -> list[tuple[int, int]]:
        """(code, its root's code) for all codes that have a link."""
        united = 0
        for i in range(len(self.codes)):
            for j in self.reach(self.codes[i], {self.root(i)}):
                united += self.unite(i, j)
            if united >= 64 and united * 8 >= len(self.codes):
                self.settle()
                united = 0
        return [(c, self.codes[r]) for i, c in enumerate(self.codes) if (r := self.root(i)) != i]


def tree_links(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within `left`, and from each code of `right` to every component of `left` that it reaches."""
    tree = BkTree(left, radius)
    inner = tree.connect()
    tree.settle()
    return inner + [(code, left[j]) for code in right for j in tree.reach(code, set())]


def slicing(n: int, radius: int, mean: int = SHARD_MEAN) -> tuple[int, int]:
    """(slices, slices that must agree) for n codes: the fewest keys that leave `mean` codes a shard."""
    for agree in range(2, 5):
        slices = radius + agree
        if n >> (64 * agree // slices) <= mean:
            break
    return slices, agree


def shard_keys(code: Column, n: int, radius: int) -> list[Column]:
    """The shards of a code: one key for each choice of slices."""
    slices, agree = slicing(n, radius)
    cuts = [64 * i // slices for i in range(slices + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(slices), agree)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), code.bitwiseAND(F.lit(signed)).alias("bits")))
    return keys


def _search(radius: int):
    """From rows (code, choice, bits, pair, left), sorted by the middle three, to links; a shard's pair is held whole, nothing else."""

    def links_of(codes: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        codes = codes.view(np.uint64)
        return tree_links(codes[left].tolist(), codes[~left].tolist(), radius)

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            code, *key, left = now
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            starts = np.concatenate(([0], changes))
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(starts) > 1).tolist():
                a, b = starts[i], starts[i + 1]
                out += links_of(code[a:b], left[a:b])
            held = [x[starts[-1] :] for x in now]
            if out:
                yield _as_links(out)
        if held is not None and len(held[0]) > 1 and (out := links_of(held[0], held[-1])):
            yield _as_links(out)

    return run


def links(codes: DataFrame, n: int, radius: int = RADIUS, shard_codes: int = SHARD_CODES) -> DataFrame:
    """(u, v): links among the n distinct values of column `code` with the same components as all pairs within the radius."""
    sharded = codes.select("code", F.explode(F.array(*shard_keys(F.col("code"), n, radius))).alias("s")).select("code", "s.choice", "s.bits")
    sizes = sharded.groupBy("choice", "bits").count().where(F.col("count") > shard_codes)
    large = cut(sizes.select("choice", "bits", F.ceil(F.col("count") / shard_codes).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = sharded.select("*", F.lit(0).cast("bigint").alias("pair"), F.lit(True).alias("left"))
    else:
        placed = sharded.join(large, ["choice", "bits"], "left").fillna(1, ["parts"])
        part, parts = F.pmod(F.xxhash64("code"), F.col("parts")), F.col("parts").cast("bigint")
        group = F.floor(F.col("part") / RIGHT_PARTS)
        own = F.transform(F.sequence(group, F.floor((parts - 1) / RIGHT_PARTS)), lambda g: F.struct(F.col("part").alias("tree"), g.alias("group"), F.lit(True).alias("left")))
        others = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("part") - 1), lambda t: F.struct(t.alias("tree"), group.alias("group"), F.lit(False).alias("left"))))
        roles = placed.withColumn("part", part).withColumn("role", F.explode(F.concat(own, F.coalesce(others, F.array().cast("array<struct<tree:bigint,group:bigint,left:boolean>>")))))
        dealt = roles.select("code", "choice", "bits", (F.col("role.tree") * F.lit(1 << 31) + F.col("role.group")).alias("pair"), "role.left")
    spread = dealt.repartition("choice", "bits", "pair").sortWithinPartitions("choice", "bits", "pair")
    return spread.mapInArrow(_search(radius), "u bigint, v bigint").distinct()


def _as_links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def _labelled(df: DataFrame, text: str, doc_id: str, radius: int, shingle: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, code, root, component_id) of every row; root is a code of the component."""
    own = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_mr_text"))
    docs = cut(with_fingerprint(own, "_mr_text", "code", shingle, seed, keep_text=False).select("doc_id", "text_hash", "code"))
    codes = cut(docs.groupBy("code").agg(F.min("doc_id").alias("first")))
    roots = components(links(codes, codes.count(), radius)).select(F.col("node").alias("code"), "root")
    linked = cut(codes.join(roots, "code"))
    # cut, so that the join by root reads two plain exchanges (or broadcasts the minima) and a large component is split over tasks
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    grouped = linked.join(least, "root").select("code", "root", "component_id")
    alone = F.col("root").isNull()
    named = codes.join(grouped, "code", "left").select("code", F.when(alone, F.col("code")).otherwise(F.col("root")).alias("root"), F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    labels = cut(named)
    return docs.join(labels, "code")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = _labelled(df, text, doc_id, radius, shingle, seed)
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of `df` less near-duplicates: one row of each component stays, that of the smallest id (then of the
    smallest text hash); rows without an id stay only if none of their component has one."""
    found = _labelled(df, text, doc_id, radius, SHINGLE, SEED)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = cut(found.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("_mr_id"), F.col("r.text_hash").alias("_mr_hash")))
    chosen = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_mr_id")) & F.xxhash64(text).eqNullSafe(F.col("_mr_hash"))
    kept = df.join(best, chosen, "left_semi")
    again = cut(found.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_mr_id"), F.col("text_hash").alias("_mr_hash")))
    if again.isEmpty():
        return kept
    return kept.join(again, chosen, "left_anti").unionByName(kept.join(again, chosen, "left_semi").dropDuplicates([doc_id, text]))
