"""Quality rules with host verdicts, in DataFrame functions only.

Each text is counted in its own row; nothing of its words is shuffled. A text fails the base rules if it has fewer
than MIN_WORDS words or more than MAX_REPEAT_PERCENT percent of its words lie in five-word windows that the text
holds twice or more. Failures are then aggregated by host. Raw host rates of small hosts are noise, so they are
shrunk with a beta prior fitted to all hosts by moments (weighted by host size). The prior says how hosts of this
corpus vary, so it sets the limit too: a host whose posterior mean lies more than LIMIT_DEVIATIONS of its standard
deviations above its mean, or above HOST_LIMIT in any case, is rejected, and its documents with it. (By Cantelli's
inequality at most a tenth of a prior's hosts lie above three deviations, of a bell-shaped one about a thousandth.)

Words are runs of anything but ASCII white space. Null texts have no words (and fail). Documents without a host
(null) form a host of their own. Windows are compared by 64-bit hashes of their words' hashes. Repeated rows
count as often as they occur. With one host, or hosts that do not vary, the prior has the strength PRIOR_MAX.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, without

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Standard deviations of the fitted prior above its mean beyond which a host's shrunk rate is rejected; and the rate beyond which any is.
LIMIT_DEVIATIONS, HOST_LIMIT = 3.0, 0.6
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 200.0
#: Rejected hosts up to which their names are broadcast.
BROADCAST_HOSTS = 100_000

_SPACE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more."""

    def of_hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda p, x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
        marked = let(pairs, lambda p: F.transform(p, lambda x, k: F.when(twin(p, x, k), x["i"])))
        repeated = F.filter(marked, lambda x: x.isNotNull())
        ordered = F.sort_array(repeated)
        gaps = let(ordered, lambda at: F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda w: let(of_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))),
    )
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0).cast("bigint"))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with COUNTS and base_failed; columns of these names are replaced."""
    own = without(df, [*COUNTS, "base_failed"])
    body = F.coalesce(F.col(text), F.lit(""))
    split = own.withColumn("_mr_words", F.filter(F.split(body, _SPACE), lambda w: w != ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = split.withColumns({
        "n_words": F.size("_mr_words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_mr_words", "")).cast("bigint"),
        "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("_mr_words")),
    }).drop("_mr_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_limit(mean: float, strength: float, most: float = HOST_LIMIT, deviations: float = LIMIT_DEVIATIONS) -> float:
    """The shrunk rate above which a host is rejected, under a beta prior of this mean and strength."""
    return min(most, mean + deviations * (mean * (1 - mean) / (strength + 1)) ** 0.5)


def host_verdicts(counted: DataFrame, host: str = "source", most: float = HOST_LIMIT, deviations: float = LIMIT_DEVIATIONS) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, rejected): the shrunk rate of every host."""
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    hosts = cut(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("x"), F.count("*").alias("k"),
        F.sum(F.col("n_docs") * rate * rate).alias("q"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2"),
    ).first()
    mean, strength = beta_prior(sums.n or 0, sums.x or 0, sums.k, sums.q or 0.0, sums.n2 or 0.0)
    posterior = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", posterior.alias("host_rate"), (posterior > host_limit(mean, strength, most, deviations)).alias("rejected"))


def beta_prior(n: int, failed: int, hosts: int, squares: float, sizes: float) -> tuple[float, float]:
    """The prior's mean and strength by Kleinman's moments: the weighted variance of the rates between hosts, less what binomial noise gives.

    squares: the sum of n_i * rate_i ** 2; sizes: the sum of n_i ** 2.
    """
    if not n:
        return 0.0, PRIOR_MAX
    mean = failed / n
    noise, freedom = mean * (1 - mean), n - sizes / n - (hosts - 1)
    between = (squares - n * mean * mean - (hosts - 1) * noise) / freedom if freedom else 0.0
    return mean, max(PRIOR_MIN, min(PRIOR_MAX, noise / between - 1)) if between > 0 else PRIOR_MAX


def judge(df: DataFrame, text: str = "text", host: str = "source", most: float = HOST_LIMIT, deviations: float = LIMIT_DEVIATIONS) -> DataFrame:
    """`df` (less `text`) with COUNTS, base_failed, host_rejected and kept."""
    own = without(df, [*COUNTS, "base_failed", "host_rejected", "kept"])
    counted = cut(with_counts(own, text).drop(text))
    bad = cut(host_verdicts(counted, host, most, deviations).where("rejected").select(F.col("host").alias("_mr_host"), F.lit(True).alias("_mr_bad")))
    small = bad.count() <= BROADCAST_HOSTS
    joined = counted.join(F.broadcast(bad) if small else bad, F.col(host).eqNullSafe(F.col("_mr_host")), "left")
    rejected = F.coalesce("_mr_bad", F.lit(False))
    return joined.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_mr_host", "_mr_bad")
