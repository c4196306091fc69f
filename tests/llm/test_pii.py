import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import pii
from tests.llm.samples import ODD, documents, noise


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))


KNOWN = [
    "mail a.b+c@x-y.example.com, or @b.c d@e f@g..h i@j.k@l.m a@b.c.@d.e x@y.z%q@r.s", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.03.4 9.9.9. 1.2.3.4.5",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111 1111  1111 1111 5500000000000004", "call +1 (555) 010-9999 +1 ( +4420 7946 0958. +12 +123456789012345678",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not GB82WEST12345698765433", "SSN 123-45-6789 and 123-45-6789-1", "\U0001f600 é a@b.co \U0001f600 1.1.1.1",
]


def texts():
    rng = random.Random(31)
    alphabet = ["1", "23", "4111111111111111", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "255", "x_", "%"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*ODD, *KNOWN, *noise(30), *mixed, "a" * 15_000, "1" * 15_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000, "1." * 20_000, "a@b.c " * 3000]


def test_base_spans_equal_plain_search(spark):
    for r in pii.find(documents(spark, texts())).collect():
        got = [(s.start, s.rank, s.end) for s in r.pii_spans]
        assert got == sorted(got)
        assert [s for s in got if s[1] < pii.BASE] == brute(r.text or ""), (r.text or "")[:200]


def test_checksums_and_context(spark):
    rows = {r.doc_id: [(r.text[s.start : s.end], s.kind, round(s.score, 1)) for s in r.pii_spans] for r in pii.find(documents(spark, [KNOWN[4], KNOWN[5], "plain 123-45-6789", "ring +1 555 010 9999", "phone +1 555 010 9999"])).collect()}
    assert [x[:2] for x in rows[0]] == [("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")]
    assert rows[1] == [("123-45-6789", "ssn", 0.7)] and rows[2] == []
    assert rows[3][0][2] == 0.6 and rows[4][0][2] == 0.9


def test_ibans_end_where_their_country_says(spark):
    ibans = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874", "CZ65 0800 0000 1920 0014 5399", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    after = ["", " BIC KREDBEBB", " BANK", " 2024", " A", ".", " XY1"]
    texts = [f"IBAN {i}{a}" for i in ibans for a in after] + [f"IBAN {i.replace(' ', '')}{a}" for i in ibans for a in after]
    rows = pii.find(documents(spark, texts)).orderBy("doc_id").collect()
    want = [[i] for i in ibans for _ in after] + [[i.replace(" ", "")] for i in ibans for _ in after]
    assert [[r.text[s.start : s.end] for s in r.pii_spans if s.kind == "iban"] for r in rows] == want


def test_empty_table_and_clashing_column(spark):
    assert pii.find(documents(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "a@b.c", 3)], "doc_id int, text string, PII_spans int")
    assert pii.find(clash).collect()[0].pii_spans[0].kind == "email"


def test_context_decides_on_both_sides(spark):
    texts = ["my account 12345678 here", "12345678 is the account", "order 12345678 for your account", "plain 12345678", "born 1990-02-03", "published 1990-02-03", "on 3.2.1990 (date of birth)",
             "DE89370400440532013000", "an invalid iban: DE89370400440532013000", "not an example DE89370400440532013000", "order +1 555 010 9999", "ssn 123-45-6789 and 123-45-6780"]
    rows = pii.find(documents(spark, texts)).orderBy("doc_id").collect()
    got = [[(s.kind, round(s.score, 1)) for s in r.pii_spans] for r in rows]
    assert got == [[("account", 0.6)], [("account", 0.6)], [], [], [("born", 0.6)], [], [("born", 0.6)],
                   [("iban", 0.8)], [("iban", 0.8)], [], [("phone", 0.3)], [("ssn", 0.7)]]


def test_context_changes_documents(spark, monkeypatch):
    texts = [f"{w} 1234567{i}" for i, w in enumerate(["account", "order", "the", "passport", "born"])] + ["ssn 123-45-6789", "123-45-6789"]
    spans = lambda: [len(r.pii_spans) for r in pii.find(documents(spark, texts)).orderBy("doc_id").collect()]
    assert spans() == [1, 0, 0, 1, 0, 1, 0]
    monkeypatch.setattr(pii, "BONUS", 0.0)
    assert spans() == [0] * 7


def test_context_ends_at_the_next_match(spark):
    rows = pii.find(documents(spark, ["phone +1 555 010 9999, +1 555 010 9998"])).collect()
    assert [round(s.score, 1) for s in rows[0].pii_spans] == [0.9, 0.6]


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 400, 128 * 128 + 130, 40_000):
        got = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(max(1, n))), lambda i: (i % 7).cast("bigint")).alias("a")).select(F.slice("a", 1, n).alias("a") if n else F.array().cast("array<bigint>").alias("a"))
        out = got.select("a", F.expr(pii.running("a")).alias("s")).first()
        want, total = [], 0
        for x in out.a:
            want.append(total)
            total += x
        assert out.s == want, n


def test_a_megabyte_of_addresses_takes_seconds(spark):
    text = "10.20.30.40 " * 87_500  # 1.05 MB
    docs = documents(spark, [text])
    began = time.time()
    row = pii.find(docs).select(F.size("pii_spans").alias("n"), F.element_at("pii_spans", -1)["start"].alias("last")).first()
    assert (row.n, row["last"]) == (87_500, 12 * 87_499)
    assert time.time() - began < 30


def test_repeated_rows_and_ties(spark):
    rows = pii.find(documents(spark, ["a@b.co 1.2.3.4"] * 3)).collect()
    assert len({str(r.pii_spans) for r in rows}) == 1 and [s.kind for s in rows[0].pii_spans] == ["email", "ip"]
