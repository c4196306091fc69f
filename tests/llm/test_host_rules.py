import random
import re
from collections import Counter

import pytest

from millrace.llm import host_rules
from tests.llm.samples import ODD, documents, noise


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def texts():
    rng = random.Random(21)
    loops = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)]
    return [*ODD, *noise(20), *loops, "same " * 4, "same " * 5, "same " * 6, "a\na\n\na\n b\n b\n", "x " * 30_000, " ".join(map(str, range(9000)))]


def test_counts(spark):
    for r in host_rules.with_counts(documents(spark, texts())).collect():
        assert (*(r[c] for c in host_rules.COUNTS), r.base_failed) == plain(r.text), r.text


def plain_rates(hosts):
    n, x, k = sum(a for a, _ in hosts), sum(b for _, b in hosts), len(hosts)
    mean = x / n
    noise_ = mean * (1 - mean)
    q = sum(a * (b / a) ** 2 for a, b in hosts)
    den = n - sum(a * a for a, _ in hosts) / n - (k - 1)
    between = (q - n * mean * mean - (k - 1) * noise_) / den if den else None
    strength = max(2.0, min(200.0, noise_ / between - 1)) if between and between > 0 else 200.0
    return [(b + mean * strength) / (a + strength) for a, b in hosts]


@pytest.mark.parametrize("hosts", [[(100, 95), (400, 10), (3, 3), (200, 8)], [(50, 50)], [(10, 0), (10, 0)], [(1, 1), (1, 0)]])
def test_host_verdicts(spark, hosts):
    rows = [(f"h{i}", j < x) for i, (n, x) in enumerate(hosts) for j in range(n)]
    got = host_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).orderBy("host").collect()
    assert [(r.n_docs, r.n_failed) for r in got] == hosts
    assert [r.host_rate for r in got] == pytest.approx(plain_rates(hosts))
    assert [r.rejected for r in got] == [x >= host_rules.HOST_LIMIT for x in plain_rates(hosts)]


def test_bad_hosts_take_their_documents_along(spark):
    good = "these ten words are all different and say one thing here"
    rows = [(i, "bad", "x") for i in range(300)] + [(1000, "bad", good)] + [(2000 + i, "fine", good + f" {i}") for i in range(300)] + [(5000, None, good), (5001, "fine", None)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, source string, text string, kept boolean")
    out = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert len(out) == len(rows) and out[1000].host_rejected and not out[1000].kept and not out[1000].base_failed
    assert out[2000].kept and out[5000].kept and not out[5001].kept
    assert host_rules.judge(docs.limit(0)).count() == 0


def verdicts(spark, hosts):
    rows = [(f"h{i:03}", j < x) for i, (n, x) in enumerate(hosts) for j in range(n)]
    got = host_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).orderBy("host").collect()
    return [r.rejected for r in got]


def test_the_prior_sets_the_limit_and_shrinkage_changes_verdicts(spark):
    """Forty hosts of 100 documents at 4 to 6 failures; one of 400 at a third, one of 3 documents at a third."""
    usual = [(100, 4 + i % 3) for i in range(40)]
    hosts = [*usual, (400, 133), (3, 1)]
    got = verdicts(spark, hosts)
    assert got == [False] * 40 + [True, False]  # both are far below HOST_LIMIT; the small host's rate is noise
    n, x = sum(a for a, _ in hosts), sum(b for _, b in hosts)
    k, mean = len(hosts), x / n
    q, sizes = sum(b * b / a for a, b in hosts), sum(a * a for a, _ in hosts)
    _, strength = host_rules.beta_prior(n, x, k, q, sizes)
    limit = host_rules.host_limit(mean, strength)
    assert mean < limit < host_rules.HOST_LIMIT and 133 / 400 > limit and 1 / 3 > limit  # raw rates would reject both
    assert (1 + mean * strength) / (3 + strength) < limit


def test_the_limit_is_the_priors_deviation_or_the_bound():
    assert host_rules.host_limit(0.1, 8.0) == pytest.approx(0.1 + 3 * 0.1)
    assert host_rules.host_limit(0.5, 2.0) == host_rules.HOST_LIMIT
    assert host_rules.host_limit(0.0, 200.0) == 0.0


def test_sql_agrees_where_hosts_are_rejected(spark, tmp_path):
    from millrace.llm import oracles
    from tests.oracle import duck, same

    good = "word{} these ten words are all different and say something more here"
    rows = [(i, f"h{i % 30}", good.format(i)) for i in range(3000)] + [(9000 + i, "bad", good.format(i) if i % 3 else "too short") for i in range(300)]
    rows += [(9500, "tiny", "x"), (9501, "tiny", good.format(1)), (9600, None, None), (9601, "bad", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    con = duck("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet(?)".replace("?", f"'{tmp_path}/d/*.parquet'")) if docs.write.parquet(f"{tmp_path}/d") is None else None
    out = host_rules.judge(docs).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")
    assert same(out, con, oracles.OP3) == len(rows)
    assert out.where("NOT base_failed AND NOT kept").count() == 200


def test_repeated_rows_count_as_often_as_they_occur(spark):
    rows = [(1, "s", "a b c")] * 3 + [(2, "s", "all of these ten words are different from one another")]
    out = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    assert sorted((r.doc_id, r.n_words, r.base_failed) for r in out.collect()) == [(1, 3, True)] * 3 + [(2, 10, False)]
