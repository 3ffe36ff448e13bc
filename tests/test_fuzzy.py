"""Approximate substring search against all parts of a text."""

import random

import pytest
from pyspark.sql import functions as F

from lithograph.functions import fuzzy


def brute(text, pattern):
    """The last row of the edit matrix whose first row is zero."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text.lower():
        new = [0]
        for j, p in enumerate(pattern.lower(), 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != p)))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("pattern", ["a", "abc", "Red Widgit", "aaaa", "é日b", "abcabcabcabcabcabcabcabcabcabcab", "ab" * 31])
def test_edits_equal_the_matrix(spark, pattern):
    rng = random.Random(5)
    texts = ["", "a", "ABC", "xxred widgetxx", "aAaA", "É日B", "ab" * 60, "rd wdgt", "x" * 300] + ["".join(rng.choices("abcé日 ", k=rng.randrange(40))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", fuzzy.edits(F.col("t"), pattern).alias("n")).collect()}
    assert got.pop(None) is None
    assert got == {t: brute(t, pattern) for t in texts}


def test_thresholds(spark):
    df = spark.createDataFrame([("red widget",), ("red gadget",), ("blue",)], "t string")
    hits = lambda t: {r["t"] for r in df.where(fuzzy.matches(F.col("t"), "red widgit", t)).collect()}
    assert hits(0.0) == set() and hits(0.34) == {"red widget", "red gadget"} and hits(0.1) == {"red widget"}
    with pytest.raises(ValueError):
        fuzzy.edits(F.col("t"), "")
