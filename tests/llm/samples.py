"""Texts and tables for the corpus tests: nulls, empty and long texts, ties, repeats, odd characters."""

import random

ODD = [None, "", " ", "\n\n", "a", "\u00a0\u2003x", "caf\u00e9 \u017fecret = abcdefgh9", "\x1c\x1d a\x85b", "\u0130stanbul \u212aelvin", "\U0001f600 smile \U0001f600", "\x00nul\x00", "tab\tand\x0bvt\x0cff\rcr"]


def noise(seed: int, n: int = 60, words: int = 80) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["the", "and", "of", "thion", "Erst", "x1", "\u00e9t\u00e9", "don't", "###", "3.14", "a,b", "\n", "  ", "=", "|"]
    return [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(words))) for _ in range(n)]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
