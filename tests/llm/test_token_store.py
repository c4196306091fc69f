import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_store
from tests.llm.samples import ODD, documents, noise

PATH = P.path(token_store.VOCABULARY)
THEIRS = Tokenizer.from_file(PATH)


def ids_of(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.lists(st.sampled_from(["A", "a", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "\u00e9", "\u00aa", "'s", "'", ".", "I\u0307", "<\u0338", "e\u0301", "\u212a", "x", "7", " ", "S'", "\u1e9e"]), max_size=12).map("".join)), max_size=4))
def test_ids_equal_the_library(texts):
    import pyarrow as pa

    assert token_store._encoder(PATH).encode(pa.array(texts, pa.string())).to_pylist() == [ids_of(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=200))
def test_elias_fano_selects_every_boundary(counts):
    counts = np.array(counts, np.int64)
    ids = np.arange(counts.sum()) % 70_000
    segment = token_store.Segment(token_store.build(np.arange(len(counts)), np.zeros(len(counts), bool), counts, ids))
    ends = np.cumsum(counts).tolist()
    assert segment.ends().tolist() == ends == [segment.end(i) for i in range(len(counts))]
    assert segment.ids.tolist() == ids.tolist()


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*ids_of(text), 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [50, 4_000_000])
def test_files_give_back_the_ids(spark, segment_ids):
    texts = [*ODD, *noise(5), "<|endoftext|> a<|startoftext|>", "q" * 5000]
    docs = documents(spark, texts).repartition(5)
    got = token_store.read(spark, token_store.write(docs, PATH, segment_ids=segment_ids, partitions=3))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == expected(enumerate(texts))


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b"), (3, "c"), (3, "c"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = token_store.read(spark, token_store.write(docs, PATH)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([(None, "a b"), (1, None), (3, "c"), (3, "c")])
    assert token_store.read(spark, token_store.write(docs.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizer_files_encode_whole_texts(tmp_path, name):
    import json

    import pyarrow as pa

    parts = json.load(open(P.path(name)))
    if parts["normalizer"] is not None:
        parts["normalizer"]["normalizers"].pop()  # no lower case: not the known form
    (tmp_path / "own.json").write_text(json.dumps(parts))
    texts = [t or "" for t in [*ODD, *noise(4), "Foo  Bar <|endoftext|> BAR"]]
    encoder, theirs = token_store.encoder_of(str(tmp_path / "own.json")), Tokenizer.from_file(str(tmp_path / "own.json"))
    assert type(encoder) is token_store.TextEncoder
    assert encoder.encode(pa.array(texts)).to_pylist() == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_may_be_ordinary_text():
    import pyarrow as pa

    theirs = Tokenizer.from_file(PATH)
    theirs.encode_special_tokens = True
    text = "foo <|endoftext|> bar<|startoftext|>"
    assert token_store._encoder(PATH, True).encode(pa.array([text])).to_pylist() == [theirs.encode(text, add_special_tokens=False).ids]
    assert 49407 in ids_of(text)


def test_a_full_table_starts_anew():
    import pyarrow as pa

    encoder = token_store.encoder_of(PATH)
    encoder.table.most = 5
    for texts in (["a b c d e f g"], ["h a i", "b"], [""], ["j" * 40 + " k"]):
        assert encoder.encode(pa.array(texts)).to_pylist() == [ids_of(t) for t in texts]


def test_columns_of_other_names_are_left_alone(spark):
    rows = spark.createDataFrame([(2, "b", 7, "x", b"y"), (1, "a", 8, "x", b"y")], "doc_id bigint, text string, h int, WIDTH string, ids binary")
    got = token_store.read(spark, token_store.write(rows, PATH)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([(1, "a"), (2, "b")])


def test_other_images_are_refused():
    with pytest.raises(ValueError, match="not a token segment"):
        token_store.Segment(b"x" * 64)
