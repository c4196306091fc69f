"""Quality classifier from weak labels.

Heuristic labellers vote on each text: good, bad, or nothing. Their limits are loose on purpose, so that most of them
also fire on some good documents and several fire on one bad document: no single vote decides. Expectation-maximisation
over the counts of vote patterns of all documents (at most 3 ** labellers patterns, whatever the corpus; only their counts
reach the driver) estimates how often each labeller gives each vote to good and to bad documents, and so the posterior
of every pattern. The posteriors then train a linear scorer over hashed features, on a sample of at most `sample`
documents (SAMPLE, drawn by hash from the whole table). Documents that score under one half are rejected.

Every whole text is read once; its votes and its few features are kept as a checkpoint, from which the votes are
counted, the sample is drawn and the scores are computed.

The gold labels are not used to fit anything. Null texts are empty; texts without words are rejected. A table that
gives no sample scores by the pattern posteriors alone. Repeated rows score alike. Columns named as a result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_from_text, cut, without

#: Documents that train the scorer, at most; buckets of its features.
SAMPLE, BUCKETS = 12_000, 1 << 14
EPOCHS, RATE, DECAY = 300, 0.5, 1e-5
#: Pseudo-documents behind each labeller's rates of bad votes on good and on bad documents, and those rates: a labeller is better than chance.
PRIOR_WEIGHT, PRIOR_RATES = 20.0, (0.05, 0.4)
FEW_WORDS = 10
LIMIT = 0.5

GOOD, NONE, BAD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "shouts", "bars", "repeats", "variety", "lines", "function_words", "word_length")
#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it as was with be by on are this at from or an a not "
    "de la le les et des un une du en que qui dans pour pas sur est au par il elle "
    "el los las y se del con por una su al lo como "
    "der die das und den von zu mit sich im dem nicht ein eine auf ist es auch".split()
)

_SHAPE = bytes(
    (97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c) for c in range(256)
)
_SYMBOLS = b"#*$%&|<>{}[]^~=\\@"


def _vote(applies: bool, bad: bool, good: bool) -> int:
    return NONE if not applies else BAD if bad else GOOD if good else NONE


class Reading:
    """What one pass over a text counts."""

    def __init__(self, text: str):
        data = text.encode()
        words = data.split()
        n = self.n = len(words)
        self.shapes = Counter(data.translate(_SHAPE).split())
        counted = Counter(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        few = n < FEW_WORDS
        total, chars = max(1, n), max(1, len(data))
        symbols = (len(data) - len(data.translate(None, _SYMBOLS))) / chars
        capitals = sum(k for s, k in self.shapes.items() if b"AA" in s and b"a" not in s) / total
        shouts, bars = data.count(b"!") / total, counted[b"|"] / total
        repeats = 1 - len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 0.0
        variety = len(counted) / total
        same = 1 - len(set(lines)) / len(lines) if lines else 0.0
        known = sum(k for w, k in counted.items() if w.strip(b".,;:!?\"'()").lower() in _FUNCTION_BYTES) / total
        length = sum(map(len, words)) / total
        self.values = {"symbols": symbols, "capitals": capitals, "shouts": shouts, "bars": bars, "repeats": repeats, "variety": variety, "lines": same, "function_words": known, "word_length": length}
        self.votes = (
            _vote(not few, symbols > 0.004, symbols < 0.002),
            _vote(n >= 2 * FEW_WORDS, capitals > 0.05, capitals < 0.02),
            _vote(not few, shouts > 0.02, shouts < 0.01),
            _vote(n > 3, bars > 0.01, bars < 0.005),
            _vote(n >= 2 * FEW_WORDS, repeats > 0.15, repeats < 0.06),
            _vote(n >= 2 * FEW_WORDS, variety < 0.6, variety > 0.68),
            _vote(len(lines) > 2, same > 0.3, same < 0.2),
            _vote(n >= 2 * FEW_WORDS, known < 0.16, known > 0.2),
            _vote(n >= 2 * FEW_WORDS, not 4.4 <= length <= 6.6, 4.6 <= length <= 6.3),
        )

    def features(self) -> dict[int, float]:
        """Hashed: shares of word shapes, and the place of each value among its steps."""
        out: dict[int, float] = {}
        total = max(1, self.n)
        for shape, k in self.shapes.items():
            b = _shape_bucket(shape) if len(shape) <= 40 else _shape_bucket.__wrapped__(shape)
            out[b] = out.get(b, 0.0) + k / total
        for name, v in self.values.items():
            out[bucket(f"{name}:{_step(name, v)}")] = 1.0
        out[bucket(f"n:{self.n.bit_length()}")] = 1.0
        return out


_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)


def _step(name: str, value: float) -> int:
    """Whole lengths; shares by the square root, which tells small ones apart."""
    return int(value) if name == "word_length" else int(value**0.5 * 20)


@lru_cache(1 << 16)
def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@lru_cache(1 << 16)
def _shape_bucket(shape: bytes) -> int:
    """Runs of a class count as one character of it."""
    return bucket("s:" + "".join(chr(c) for i, c in enumerate(shape) if not i or c != shape[i - 1]))


def pattern_number(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


def pattern_votes(number: int, labellers: int = len(LABELLERS)) -> tuple[int, ...]:
    out = []
    for _ in range(labellers):
        number, v = divmod(number, 3)
        out.append(v)
    return tuple(reversed(out))


class VoteModel:
    """How often each labeller votes bad on good and on bad documents, where it votes at all; class 1 is bad."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 300):
        given, bad = votes != NONE, votes == BAD
        post = np.where(bad.any(1), 0.9, 0.02)
        for _ in range(rounds):
            weight = np.stack([(1 - post) * counts, post * counts])  # classes x patterns
            self.share = (weight.sum(1) + 2.0) / (counts.sum() + 4.0)
            prior = PRIOR_WEIGHT * np.array([[PRIOR_RATES[0]], [PRIOR_RATES[1]]])
            self.rates = (weight @ bad + prior) / (weight @ given + PRIOR_WEIGHT)
            new = self.posterior(votes)
            moved = float(np.abs(new - post).max()) if len(post) else 0.0
            post = new
            if moved < 1e-7:
                break

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of bad for each pattern; missing votes say nothing."""
        given, bad = votes != NONE, votes == BAD
        fires, clears = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        logit = np.log(self.share[1] / self.share[0]) + bad @ fires + (given & ~bad) @ clears
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """The share of each labeller's votes that fit the class, were it to vote on every document."""
        right = self.share[0] * (1 - self.rates[0]) + self.share[1] * self.rates[1]
        return dict(zip(LABELLERS, right.tolist(), strict=True))


def train(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of good, from (buckets, values, probability of good)."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    where = np.fromiter((b for r in rows for b in r[0]), np.int64, len(at))
    value = np.fromiter((v for r in rows for v in r[1]), np.float64, len(at))
    goal = np.array([r[2] for r in rows])
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        score = np.bincount(at, w[where] * value, len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - goal
        slope = np.append(np.bincount(where, error[at] * value, BUCKETS), error.sum()) / len(rows) + DECAY * w
        seen += slope * slope
        w -= RATE * slope / np.sqrt(seen)
    return w


_FIELDS = [
    T.StructField("_mr_pattern", T.IntegerType()), T.StructField("_mr_words", T.LongType()),
    T.StructField("_mr_buckets", T.ArrayType(T.IntegerType())), T.StructField("_mr_weights", T.ArrayType(T.DoubleType())),
]


def with_readings(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with each text's vote pattern, word count and hashed features."""

    def start():
        def work(column):
            read = [Reading(t or "") for t in column.to_pylist()]
            found = [r.features() for r in read]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            buckets = np.fromiter((b for f in found for b in f), np.int32, int(ends[-1]))
            weights = np.fromiter((v for f in found for v in f.values()), np.float64, int(ends[-1]))
            listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            return [pa.array([pattern_number(r.votes) for r in read], pa.int32()), pa.array([r.n for r in read], pa.int64()), listed(buckets), listed(weights)]

        return work

    return add_from_text(df, text, _FIELDS, start, keep_text)


def drawn(readings: DataFrame, total: int, most: int, key: Column) -> DataFrame:
    """At most `most` rows of features, drawn by the hash of `key` from all of them."""
    parts = 1 << 20
    share = min(parts, -(-most * parts * 9 // (10 * max(1, total)))) if total > most else parts
    return readings.where(F.pmod(key, F.lit(parts)) < share).select("_mr_pattern", "_mr_buckets", "_mr_weights").limit(most)


def fit(readings: DataFrame, key: Column, sample: int = SAMPLE) -> tuple[VoteModel, np.ndarray | None]:
    counted = dict(readings.groupBy("_mr_pattern").count().collect())
    numbers = sorted(counted)
    votes = np.array([pattern_votes(p) for p in numbers], int).reshape(-1, len(LABELLERS))
    model = VoteModel(votes, np.array([counted[p] for p in numbers], float))
    rows = [tuple(r) for r in drawn(readings, sum(counted.values()), sample, key).toLocalIterator()]
    if not rows:
        return model, None
    good = 1 - model.posterior(np.array([pattern_votes(p) for p, _, _ in rows]))
    return model, train([(b, v, g) for (_, b, v), g in zip(rows, good.tolist(), strict=True)])


def scores(buckets: pa.ListArray, weights: pa.ListArray, model: np.ndarray) -> np.ndarray:
    """The scorer's probability of good for lists of features."""
    counts = pa.compute.list_value_length(buckets).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(counts)), counts)
    sums = np.bincount(rows, model[buckets.flatten().to_numpy()] * weights.flatten().to_numpy(), len(counts)) + model[-1]
    return 1 / (1 + np.exp(-np.clip(sums, -50, 50)))


def score(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, limit: float = LIMIT, keep_text: bool = True) -> DataFrame:
    """`df` with quality_posterior (of the votes), quality_score (of the scorer; 1 is good) and quality_ok."""
    names = ["quality_posterior", "quality_score", "quality_ok"]
    own = without(df, [*names, *[f.name for f in _FIELDS], "_mr_draw"]).withColumn("_mr_draw", F.xxhash64(doc_id, text))
    readings = cut(with_readings(own, text, keep_text))
    model, weights = fit(readings, F.col("_mr_draw"), sample)
    shared = df.sparkSession.sparkContext.broadcast((model, weights))
    passed = [c for c in readings.columns if c not in {"_mr_draw", *[f.name for f in _FIELDS]}]
    used = ["_mr_pattern", "_mr_words", "_mr_buckets", "_mr_weights"]
    schema = T.StructType([*readings.select(*passed).schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        model, weights = shared.value
        for batch in batches:
            pattern, words, buckets, values = batch.columns[-4:]
            number, which = np.unique(pattern.to_numpy(), return_inverse=True)
            posterior = (1 - model.posterior(np.array([pattern_votes(p) for p in number.tolist()], int).reshape(-1, len(LABELLERS))))[which]
            found = posterior if weights is None else scores(buckets, values, weights)
            kept = (words.to_numpy() > 0) & (found >= limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(posterior), pa.array(found), pa.array(kept)], names=schema.names)

    return readings.select(*passed, *used).mapInArrow(run, schema)
