import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import byte_bpe
from tests.llm.samples import ODD, documents, noise

PATH = P.path(byte_bpe.VOCABULARY)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = byte_bpe.Encoder(byte_bpe.read_ranks(PATH), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_ids_equal_the_library(texts):
    assert OURS.encode(texts).to_pylist() == [THEIRS.encode_ordinary(t) for t in texts]


def test_dataframe_round_trip(spark):
    texts = [*ODD, *noise(1), "z" * 30_000, "ab " * 20_000, "\u4f60\u597d" * 500]
    rows = byte_bpe.decode(byte_bpe.encode(documents(spark, texts), PATH, P.PATTERN), PATH).collect()
    assert len(rows) == len(texts)
    both = {r.doc_id: r for r in byte_bpe.round_trip(documents(spark, texts), PATH, P.PATTERN).collect()}
    for r in rows:
        assert (both[r.doc_id].token_ids, both[r.doc_id].decoded) == (r.token_ids, r.decoded)
        assert r.token_ids == THEIRS.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table_clashing_columns_and_null_ids(spark):
    assert byte_bpe.encode(documents(spark, []), PATH, P.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "ab", "old", "old")], "doc_id int, text string, TOKEN_IDS string, decoded string")
    row = byte_bpe.decode(byte_bpe.encode(clash, PATH, P.PATTERN), PATH).collect()[0]
    assert bytes(row.decoded) == b"ab"
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [5])], "doc_id int, token_ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(nulls, PATH).orderBy("doc_id").collect()] == [None, b"", {v: k for k, v in RANKS.items()}[5]]


def test_unknown_id_is_an_error(spark):
    bad = spark.createDataFrame([(1, [10**6])], "doc_id int, token_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(bad, PATH).collect()
