import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import simhash
from millrace.llm.components import components
from tests.llm.samples import ODD, documents, noise


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, codes, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(str(i % 7919) for i in range(80_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_codes(seed, n, flips=3):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 20)] + [0, (1 << 64) - 1]
    out = set()
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.randrange(flips + 4)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return sorted(out, key=lambda _: rng.random())


def test_trees_and_shards_reach_what_all_pairs_reach(spark):
    for n, size in ((400, 3000), (400, 7), (300, 1)):
        codes = near_codes(n + size, n)
        signed = [c - (1 << 64) if c >> 63 else c for c in codes]
        df = spark.createDataFrame([(c,) for c in signed], "code bigint")
        found = simhash.links(df, n, shard_codes=size).collect()
        assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 64 for r in found)
        roots = {r.node: r.root for r in components(simhash.links(df, n, shard_codes=size)).collect()}
        least = {}
        for i, c in enumerate(signed):
            r = roots.get(c, c)
            least[r] = min(i, least.get(r, i))
        assert [least[roots.get(c, c)] for c in signed] == plain_components(list(range(n)), codes)


def test_slicing_finds_every_pair():
    rng = random.Random(9)
    for n in (10, 10**9, 10**11):
        slices, agree = simhash.slicing(n, 4)
        cuts = [64 * i // slices for i in range(slices + 1)]
        for _ in range(300):
            x = 0
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            clean = sum(not x & ((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(slices))
            assert clean >= agree


def table(spark):
    base = noise(7, 12, 60)
    rng = random.Random(8)
    texts = [*ODD, *base, *base]
    for t in base:
        w = t.split(" ")
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return documents(spark, texts)


def test_near_duplicates(spark):
    docs = table(spark)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    codes = [plain_fingerprint(r.text) for r in rows]
    want = list(zip([r.doc_id for r in rows], [f"{c:016x}" for c in codes], plain_components([r.doc_id for r in rows], codes), strict=True))
    assert [tuple(r) for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_repeated_rows_null_ids_clashing_columns_and_empty(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "lonely text of its own kind"), (None, "lonely text of its own kind")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, code int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "4", "None", "None"]
    kept = simhash.one_of_each(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


def test_a_large_component_is_joined_by_plain_exchanges(spark, monkeypatch):
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    simhash.near_duplicates(table(spark))
    for p in plans:
        assert not ("hashpartitioning(root" in p and "Join" in p and "HashAggregate" in p), p
