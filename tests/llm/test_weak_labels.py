import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import weak_labels
from tests.llm.samples import ODD, documents, noise

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = weak_labels.score(docs.select("doc_id", "text")).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    got = {(r.quality, r.quality_ok): r.n for r in scored.groupBy("quality", "quality_ok").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.01 * got[1, True]
    assert got.get((0, True), 0) <= 0.1 * got[0, False]


def test_em_recovers_known_rates():
    rng = np.random.default_rng(5)
    n, rates = 40_000, np.array([[0.02, 0.1, 0.05, 0.3], [0.8, 0.6, 0.7, 0.4]])
    bad = rng.random(n) < 0.2
    fired = rng.random((n, 4)) < rates[bad.astype(int)]
    votes = np.where(rng.random((n, 4)) < 0.2, weak_labels.NONE, np.where(fired, weak_labels.BAD, weak_labels.GOOD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.VoteModel(patterns, counts.astype(float))
    assert model.share[1] == pytest.approx(0.2, abs=0.03)
    assert model.rates == pytest.approx(rates, abs=0.06)


def test_pattern_numbers_round_trip():
    for _ in range(50):
        votes = tuple(random.choice([0, 1, 2]) for _ in weak_labels.LABELLERS)
        assert weak_labels.pattern_votes(weak_labels.pattern_number(votes)) == votes


@pytest.mark.parametrize("prose_first", [True, False])
def test_function_words_are_counted_over_the_whole_text(prose_first):
    prose, table = ["The", "mill", "of", "it,"] * 1000, [f"cell{i}" for i in range(16_000)]
    read = weak_labels.Reading(" ".join(prose + table if prose_first else table + prose))
    assert read.values["function_words"] == pytest.approx(3000 / 20_000)
    few = weak_labels.Reading(" ".join(prose[:400] + table if prose_first else table + prose[:400]))
    assert few.values["function_words"] == pytest.approx(300 / 16_400)
    assert few.votes[weak_labels.LABELLERS.index("function_words")] == weak_labels.BAD


def test_defined_cases(spark):
    texts = [*ODD, *noise(40), "word " * 50_000]
    docs = documents(spark, texts).withColumn("quality_ok", F.lit("old"))
    rows = {r.doc_id: r for r in weak_labels.score(docs, sample=20).collect()}
    assert len(rows) == len(texts)
    assert [rows[i].quality_ok for i in range(4)] == [False] * 4
    assert weak_labels.score(documents(spark, [])).count() == 0


def test_sample_is_bounded_and_drawn_from_all(spark):
    docs = documents(spark, [f"text number {i}" for i in range(3000)])
    read = weak_labels.with_readings(docs.select("doc_id", "text"), keep_text=False)
    assert "text" not in read.columns
    drawn = weak_labels.drawn(read, 3000, 300, F.xxhash64("doc_id")).collect()
    assert 150 < len(drawn) <= 300


def plain_values(text):
    """The values by plain definitions, words as text."""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    n = len(w)
    pairs = {(a, b) for a, b in zip(w, w[1:])}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    mask = lambda x: re.sub("[^\x00-\x7f]", "a", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", x)))
    data = text.encode()
    return n, {
        "symbols": len(re.findall(rb"[#*$%&|<>{}\[\]^~=\\@]", data)) / max(1, len(data)),
        "capitals": sum("AA" in mask(x) and "a" not in mask(x) for x in w) / max(1, n), "shouts": text.count("!") / max(1, n), "bars": sum(x == "|" for x in w) / max(1, n),
        "repeats": 1 - len(pairs) / (n - 1) if n > 1 else 0.0, "variety": len(set(w)) / max(1, n), "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "function_words": sum(low(x.strip(".,;:!?\"'()")) in weak_labels.FUNCTION_WORDS for x in w) / max(1, n), "word_length": sum(len(x.encode()) for x in w) / max(1, n),
    }


def plain_votes(n, v, text):
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in text.split("\n"))
    say = lambda on, bad, good: 1 if not on else 2 if bad else 0 if good else 1
    return (
        say(n >= 10, v["symbols"] > 0.004, v["symbols"] < 0.002), say(n >= 20, v["capitals"] > 0.05, v["capitals"] < 0.02), say(n >= 10, v["shouts"] > 0.02, v["shouts"] < 0.01),
        say(n >= 4, v["bars"] > 0.01, v["bars"] < 0.005), say(n >= 20, v["repeats"] > 0.15, v["repeats"] < 0.06), say(n >= 20, v["variety"] < 0.6, v["variety"] > 0.68),
        say(lines > 2, v["lines"] > 0.3, v["lines"] < 0.2), say(n >= 20, v["function_words"] < 0.16, v["function_words"] > 0.2),
        say(n >= 20, v["word_length"] < 4.4 or v["word_length"] > 6.6, 4.6 <= v["word_length"] <= 6.3),
    )


def texts_of(sf):
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]


def test_values_and_votes_equal_plain_definitions():
    for text in [*(t or "" for t in ODD), *noise(30), *texts_of(SMALL), "x" * 500 + " " + "Yy" * 300]:
        read, (n, want) = weak_labels.Reading(text), plain_values(text)
        assert read.n == n and read.values == pytest.approx(want), text[:100]
        assert read.votes == plain_votes(n, read.values, text), text[:100]


def test_features_keep_whole_words_and_lengths():
    long, longer = weak_labels.Reading("A1" * 40).features(), weak_labels.Reading("1A" * 40).features()
    assert set(long) != set(longer)  # no bucket for all long words
    wide = [weak_labels.bucket(f"n:{weak_labels.Reading('a ' * n).n.bit_length()}") for n in (70_000, 140_000)]
    assert wide[0] != wide[1]
    read = weak_labels.Reading("Hello there, hello 12 THERE!")
    plain = {}
    for word in ("Hello", "there,", "hello", "12", "THERE!"):
        shape = re.sub(r"(.)\1+", r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word))
        plain[weak_labels.bucket("s:" + shape)] = plain.get(weak_labels.bucket("s:" + shape), 0) + 0.2
    assert {b: v for b, v in read.features().items() if v != 1.0} == pytest.approx(plain)


def plain_em(patterns, counts, rounds=300):
    """The same model, element by element."""
    post = [0.9 if 2 in p else 0.02 for p in patterns]
    for _ in range(rounds):
        weight = [[(1 - q) * c for q, c in zip(post, counts)], [q * c for q, c in zip(post, counts)]]
        share = [(sum(w) + 2) / (sum(counts) + 4) for w in weight]
        rates = [[(sum(w for w, p in zip(weight[k], patterns) if p[j] == 2) + 20 * (0.05, 0.4)[k]) / (sum(w for w, p in zip(weight[k], patterns) if p[j] != 1) + 20) for j in range(9)] for k in (0, 1)]
        new = []
        for p in patterns:
            like = [share[k] * math.prod(rates[k][j] if v == 2 else 1 - rates[k][j] for j, v in enumerate(p) if v != 1) for k in (0, 1)]
            new.append(like[1] / sum(like))
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-7:
            break
    return post


def plain_scores(texts):
    """(posterior of bad, score, accepted) of each text: the same scorer, feature by feature."""
    read = [weak_labels.Reading(t) for t in texts]
    patterns = sorted({r.votes for r in read})
    post = dict(zip(patterns, plain_em(patterns, [sum(r.votes == p for r in read) for p in patterns])))
    goal, w, seen = [1 - post[r.votes] for r in read], {}, {}
    found = [{**r.features(), "bias": 1.0} for r in read]
    logistic = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    for _ in range(300):
        slope = {}
        for f, g in zip(found, goal):
            error = logistic(sum(w.get(b, 0.0) * v for b, v in f.items())) - g
            for b, v in f.items():
                slope[b] = slope.get(b, 0.0) + error * v / len(found)
        for b in slope:
            s = slope[b] + 1e-5 * w.get(b, 0.0)
            seen[b] = seen.get(b, 1e-8) + s * s
            w[b] = w.get(b, 0.0) - 0.5 * s / math.sqrt(seen[b])
    scores = [logistic(sum(w[b] * v for b, v in f.items())) for f in found]
    return [(post[r.votes], s, bool(r.n) and s >= 0.5) for r, s in zip(read, scores)]


def test_score_equals_a_plain_model(spark):
    texts = texts_of(SMALL)
    rows = sorted(weak_labels.score(documents(spark, texts), keep_text=False).collect(), key=lambda r: r.doc_id)
    want = plain_scores(texts)
    assert [1 - r.quality_posterior for r in rows] == pytest.approx([p for p, _, _ in want], abs=1e-4)
    assert [r.quality_score for r in rows] == pytest.approx([s for _, s, _ in want], abs=1e-3)
    assert [r.quality_ok for r in rows] == [ok for _, _, ok in want]


def test_no_single_vote_decides(spark):
    """The model and the rule `any bad vote` part on many documents, and the model is nearer to the labels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    any_bad = {r.doc_id: weak_labels.BAD in weak_labels.Reading(r.text or "").votes for r in docs.collect()}
    kept = {r.doc_id: r.quality_ok for r in weak_labels.score(docs, keep_text=False).collect()}
    assert sum(any_bad[i] == kept[i] for i in kept) > 10
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    wrong = lambda says: sum(says(i) != bool(q) for i, q in gold.items())
    assert wrong(lambda i: kept[i]) < wrong(lambda i: not any_bad[i])


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the same text of the mill and the river " * 4, "old", 3)] * 3 + [(None, None, None, None)]
    out = weak_labels.score(spark.createDataFrame(rows, "doc_id bigint, text string, QUALITY_OK string, _mr_words int")).collect()
    assert len(out) == 4 and len({(r.quality_score, r.quality_ok) for r in out if r.doc_id}) == 1
    assert [r.quality_ok for r in out if r.doc_id is None] == [False]
