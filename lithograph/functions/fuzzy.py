"""Approximate substring search as a column: the fewest edits that make a pattern a part of a text.

The columns of the edit matrix are kept as bit vectors (Myers 1999): one fold over a text's characters with
a few operations on longs each, whatever the number of edits allowed. It runs in the JVM; no row is compared
with more than its own text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern's characters are the bits of a long, its sign bit left free.
LONGEST = 62
# The shares of a pattern's characters that may be edits, by default and in the page tree.
THRESHOLD, LOOSE = 0.34, 0.38


def edits(text: Column, pattern: str) -> Column:
    """The smallest edit distance of the pattern to any part of the text, both lower-cased; null for a null text.

    The empty part counts, so it is at most the pattern's length.
    """
    pattern = pattern.lower()
    m = len(pattern)
    if not 0 < m <= LONGEST:
        raise ValueError(f"a pattern has 1 to {LONGEST} characters")
    ones, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    table = F.create_map(*[F.lit(x) for c, v in masks.items() for x in (c, F.lit(v).cast("long"))])
    long = lambda v: F.lit(v).cast("long")
    # each value below is used more than once, so it becomes a field of a struct before the next step
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        eq = F.coalesce(F.try_element_at(table, c), long(0))
        # the sum may carry beyond the pattern's bits, which the mask drops
        first = let(eq, lambda e: F.struct(e.alias("eq"), ((e.bitwiseAND(s["pv"]) + s["pv"]).bitwiseXOR(s["pv"])).bitwiseOR(e).bitwiseAND(long(ones)).alias("xh"), e.bitwiseOR(s["mv"]).alias("xv")))

        def moved(x: Column) -> Column:
            ph = s["mv"].bitwiseOR(F.bitwise_not(x["xh"].bitwiseOR(s["pv"]))).bitwiseAND(long(ones))
            mh = s["pv"].bitwiseAND(x["xh"])
            return F.struct(ph.alias("ph"), mh.alias("mh"), x["xv"].alias("xv"))

        def settled(y: Column) -> Column:
            up = F.when(y["ph"].bitwiseAND(long(top)) != 0, 1).when(y["mh"].bitwiseAND(long(top)) != 0, -1).otherwise(0)
            ph, mh = F.shiftleft(y["ph"], 1).bitwiseAND(long(ones)), F.shiftleft(y["mh"], 1).bitwiseAND(long(ones))
            pv = mh.bitwiseOR(F.bitwise_not(y["xv"].bitwiseOR(ph))).bitwiseAND(long(ones))
            now = s["now"] + up
            return F.struct(pv.alias("pv"), ph.bitwiseAND(y["xv"]).alias("mv"), now.alias("now"), F.least(s["best"], now).alias("best"))

        return let(let(first, moved), settled)

    start = F.struct(long(ones).alias("pv"), long(0).alias("mv"), F.lit(m).alias("now"), F.lit(m).alias("best"))
    return F.aggregate(F.split(F.lower(text), ""), start, step, lambda s: s["best"])


def matches(text: Column, pattern: str, threshold: float = THRESHOLD) -> Column:
    """Whether a part of the text is within ``threshold`` edits a character of the pattern."""
    return edits(text, pattern) <= int(threshold * len(pattern) + 1e-9)
