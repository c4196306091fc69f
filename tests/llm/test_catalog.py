"""The registered corpus queries at a small size: against their SQL, or for whole and stable results."""

import base64
import hashlib
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, catalog, main_text, pii, secret_scan, token_store
from tests.llm import test_host_rules, test_pii, test_secret_scan
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.oracle import duck, same

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    assert same(catalog.QUERIES[name](spark, SF), duck(SF), catalog.ORACLES[name]) == 1000


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_op1(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = catalog.QUERIES["op1_main_text"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    assert all((r.text, r.n_chars, r.url) == (main_text.main_text(pages[r.page_id].html), len(r.text), pages[r.page_id].url) for r in rows)


def test_op2(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.VOCABULARY), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in catalog.QUERIES["op2_byte_bpe"](spark, SMALL).collect():
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r.doc_id]))


def test_op4(spark, docs):
    ids = sorted(docs)
    codes = [plain_fingerprint(docs[i]) for i in ids]
    got = catalog.QUERIES["op4_simhash"](spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(zip(ids, [f"{c:016x}" for c in codes], plain_components(ids, codes), strict=True))


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize(("name", "brute", "kinds"), [("op5_secrets", test_secret_scan.brute, secret_scan.KINDS), ("op6_personal_data", test_pii.brute, pii.KINDS)])
def test_spans(spark, docs, name, brute, kinds):
    for r in catalog.QUERIES[name](spark, SMALL).collect():
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == sha(joined(want, kinds))
        assert {x for x in joined(want, kinds).split(",") if x} <= set(r.spans.split(","))
        assert [r[c] for c in r.__fields__ if c.startswith("n_")] == [sum(k == i for _, k, _ in want) for i in range(len([c for c in r.__fields__ if c.startswith("n_")]))]


def test_op7(spark, docs):
    rows = catalog.QUERIES["op7_shards"](spark, SMALL).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode())) for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_op9(spark, docs):
    theirs, start = Tokenizer.from_file(P.path(token_store.VOCABULARY)), 0
    rows = catalog.QUERIES["op9_token_store"](spark, SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = [*theirs.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_op10(spark, docs):
    rows = catalog.QUERIES["op10_quality"](spark, SMALL).collect()
    assert len(rows) == len(docs) and 0 < sum(r.kept for r in rows) < len(rows)


def test_op3_small(spark, docs):
    for r in catalog.QUERIES["op3_host_rules"](spark, SMALL).withColumn("one", F.lit(1)).collect():
        assert tuple(r)[1:7] == test_host_rules.plain(docs[r.doc_id])
