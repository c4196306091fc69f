import base64
import re

import public_tokenizers as P
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import byte_bpe, decontaminate
from tests.llm.test_secret_scan import plain_redaction
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_weak_labels import plain_scores

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    kept = [r for r, (_, _, ok) in zip(docs, plain_scores([r.text or "" for r in docs])) if ok]
    ids = [r.doc_id for r in kept]
    first = set(plain_components(ids, [plain_fingerprint(r.text) for r in kept]))
    kept = [r for r in kept if r.doc_id in first]
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words(item.text or "")
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)}
    sizes = {len(x) for x in windows}

    def clean(text):
        w = decontaminate.words(text or "")
        return not any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1))

    kept = [r for r in kept if clean(r.text)]
    texts = {r.doc_id: plain_redaction(r.text or "") for r in kept}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.VOCABULARY), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts) and len(got) > 50
    for i, text in texts.items():
        assert got[i].token_ids == theirs.encode_ordinary(text) and got[i].round_trip and got[i].n_chars == len(text)
        assert not re.search(r"token = \"[0-9a-f]{8,}", text)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("root", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = max(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.n_chars)
    row = docs.where(docs.doc_id == good.doc_id).first()
    odd = [(None, None, None, None, None), (None, row.text, None, None, None), (-1, None, "en", None, 3), (-2, "", None, "r", None), (-3, " \n", "en", "r", 0), (row.doc_id, row.text, None, None, None)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"component_id": F.lit(1), "quality_ok": F.lit("x"), "n_hit": F.lit(None).cast("int")})
    more.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None)], "item_id bigint, text string")).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got.count(row.doc_id) == 1 and None not in got and min(got) >= 0 and len(got) == len(set(got)) > 50
