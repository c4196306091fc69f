"""Personal data, in DataFrame functions only: patterns propose, checksums confirm, context words adjust.

Kinds in order: email, ip, card, phone (the base kinds), iban, ssn, account, born. Patterns propose the leftmost
non-overlapping spans of a kind; they are written so that no start is tried twice and no group recurses, whatever the text.
Then ip parts must be at most 255, cards hold 12 to 19 digits that pass Luhn, phones 9 to 15 digits, ibans (of the
length their country fixes) pass mod-97.

Each span has a score: its kind's prior, raised by BONUS where a word of the kind's context stands near it, lowered by
MALUS where a word does that speaks against it. Near is within CONTEXT code points before the span or after it, as far
as no other match of its kind stands between. Base spans stay whatever their score; the others need KEEP_SCORE: an iban
stays unless its context speaks against it, the others need a word in their favour.

Between n matches lie n + 1 gaps: the lengths of both give the starts by running sums (in chunks of chunks, so that the
work grows with the number of matches), the gaps themselves give the context. Spans are code points, end exclusive. Null
texts are empty; texts are searched whole. Repeated rows are searched alike; spans of several kinds at one place all count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import without

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "born")
BASE = 4
CONTEXT, BONUS, MALUS, KEEP_SCORE = 48, 0.3, 0.3, 0.6
#: Items of a chunk, and chunks of a chunk, in running sums.
CHUNK = 128

#: Characters of an account number by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Whole or in fours, as long as the country says; of other countries as long as it goes."""

    def body(length: int) -> str:
        fours, rest = divmod(length - 4, 4)
        return rf"(?:[A-Z0-9]{{{length - 4}}}|(?:\x20[A-Z0-9]{{4}}){{{fours}}}{rf'\x20[A-Z0-9]{{{rest}}}' if rest else ''})"

    known = {n: f"(?:{codes.replace(' ', '|')})" for n, codes in _IBAN_LENGTHS.items()}
    fixed = "|".join(f"{codes}[0-9]{{2}}{body(n)}" for n, codes in known.items())
    other = rf"(?!{'|'.join(known.values())})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}+|(?:\x20[A-Z0-9]{{4}}){{2,7}}+(?:\x20[A-Z0-9]{{1,3}})?+)"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{fixed}|{other})(?![A-Za-z0-9])"


_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9.+-])[0-9]{8,11}+(?![A-Za-z0-9-])",
    "born": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])",
}
#: A cheap condition without which the pattern can't match.
_HINTS = {"email": "@", "phone": "+", "ssn": "-"}
_PRIORS = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "account": 0.3, "born": 0.3}
_WORDS = {
    "email": "e-?mail|contact|write to|reach",
    "ip": "\\bip\\b|address|host|server|client|login",
    "card": "card|visa|master|amex|credit|debit|payment|cvv",
    "phone": "phone|call|\\btel|mobile|cell|fax|contact",
    "iban": "iban|account|bank|transfer|bic|swift",
    "ssn": "\\bssn\\b|social security|tax id|taxpayer",
    "account": "account|\\bacct|routing|sort code|passport|licen[cs]e n",
    "born": "\\bborn\\b|birth|\\bdob\\b",
}
_AGAINST = {
    "email": "example|noreply|no-reply", "ip": "version|release|section|chapter", "card": "order|invoice|tracking|isbn|serial", "phone": "order|invoice|isbn|serial",
    "iban": "example|sample|invalid|not an", "ssn": "order|invoice|part n|isbn|serial", "account": "order|invoice|tracking|isbn|serial", "born": "published|updated|version|release",
}


# The expressions are SQL text: the parser builds them in one call, where column functions would take thousands.


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]+', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    doubled = "cast(c AS int) * 2 - IF(cast(c AS int) > 4, 9, 0)"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF(i % 2 = 0, cast(c AS int), {doubled})), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"


def mod97(account: str) -> str:
    """Whether an account number, spaces aside, leaves 1 modulo 97 once its first four characters go last and letters count from A = 10."""
    plain = f"replace({account}, ' ', '')"
    step = "IF(c = '', a, (a * IF(c BETWEEN '0' AND '9', 10, 100) + IF(c BETWEEN '0' AND '9', ascii(c) - 48, ascii(c) - 55)) % 97)"
    return f"aggregate(split(concat(substring({plain}, 5, 64), substring({plain}, 1, 4)), ''), 0, (a, c) -> {step}) = 1"


def _holds(kind: str, match: str) -> str:
    if kind == "ip":
        part = "regexp_replace(p, '^0+(?=[0-9])', '')"
        return f"forall(split({match}, '[.]'), p -> length({part}) <= 3 AND cast(substring({part}, 1, 3) AS int) <= 255)"
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return f"length({_digits(match)}) BETWEEN 9 AND 15"
    if kind == "iban":
        return mod97(match)
    return "true"


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def running(items: str) -> str:
    """The sums of all items before each one, in chunks of chunks: an item is copied a few hundred times at most until there are CHUNK ** 3 of them."""

    def plain(x: str) -> str:
        zero = "named_struct('upto', 0L, 'before', cast(array() AS array<bigint>))"
        return f"aggregate({x}, {zero}, (a, y) -> named_struct('upto', a.upto + y, 'before', concat(a.before, array(a.upto))), a -> a.before)"

    def chunked(x: str, depth: int) -> str:
        """The sums before each chunk come from the chunks' own, by chunks again if there are many."""
        c, t, s, i = (f"{n}{depth}" for n in "ctsi")
        span = f"sequence({i} * {CHUNK}, least(({i} + 1) * {CHUNK}, size({x})) - 1)"
        chunks = f"transform(sequence(0, cast(floor((size({x}) - 1) / {CHUNK}) AS int)), {i} -> transform({span}, j -> get({x}, j)))"
        totals = f"transform({c}, y -> aggregate(y, 0L, (a, z) -> a + z))"
        before = plain(t) if depth else f"IF(size({t}) > {CHUNK}, {chunked(t, depth + 1)}, {plain(t)})"
        added = f"flatten(transform({c}, (y, k) -> transform({plain('y')}, z -> z + get({s}, k))))"
        return _let(c, chunks, _let(t, totals, _let(s, before, added)))

    return _let("v", items, f"CASE WHEN size(v) <= {CHUNK} THEN {plain('v')} ELSE {chunked('v', 0)} END")


def _found(text: str, kind: str) -> str:
    """The spans of a kind. Texts without a match meet the pattern once; only the others are split by it too."""
    pattern, rank = f"r'{_PATTERNS[kind]}'", KINDS.index(kind)
    none = f"cast(array() AS array<{_SPAN}>)"
    near = f"lower(concat(right(get(gaps, i), {CONTEXT}), '\n', left(get(gaps, i + 1), {CONTEXT})))"
    change = lambda words, by: f"IF({near} RLIKE r'{words}', {by}D, 0D)"
    score = f"{_PRIORS[kind]}D + {change(_WORDS[kind], BONUS)} - {change(_AGAINST[kind], MALUS)}"
    start = "cast(get(before, i) + char_length(get(gaps, i)) AS int)"
    span = f"named_struct('start', {start}, 'rank', {rank}, 'end', {start} + char_length(m), 'kind', '{kind}', 'score', IF({_holds(kind, 'm')}, {score}, NULL))"
    kept = "s.score IS NOT NULL" if rank < BASE else f"s.score >= {KEEP_SCORE - 1e-9}"
    lengths = "transform(found, (m, i) -> cast(char_length(get(gaps, i)) + char_length(m) AS bigint))"
    placed = _let("gaps", f"split({text}, {pattern}, -1)", _let("before", running(lengths), f"filter(transform(found, (m, i) -> {span}), s -> {kept})"))
    hint = f"instr({text}, '{_HINTS[kind]}') > 0" if kind in _HINTS else f"{text} RLIKE '[0-9]'"
    return f"IF({hint}, {_let('found', f'regexp_extract_all({text}, {pattern}, 0)', f'IF(size(found) = 0, {none}, {placed})')}, {none})"


def find(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """`df` with the array `spans` of (start, rank, end, kind, score), by start, then kind; a column of that name is replaced."""
    own = without(df, [spans]).withColumn("_mr_body", F.coalesce(F.col(text), F.lit("")))
    found = F.expr(f"array_sort(concat({', '.join(_found('_mr_body', k) for k in KINDS)}))")
    return own.withColumn(spans, found).drop("_mr_body")
