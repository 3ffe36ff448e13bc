"""Boolean text search against a plain scan of every text."""

import random
import re

import pytest

from lithograph.operators import phrases as P

WORDS = "a b c d or e_1 42".split()


def brute(texts, query):
    out = {}
    for i, text in texts:
        ws = re.findall("[a-z_][a-z0-9_]*|[0-9]+", (text or "").lower())
        at = lambda x: [(p, p + len(x.words) - 1) for p in range(len(ws)) if tuple(ws[p : p + len(x.words)]) == x.words]  # noqa: B023, E731
        rank, hit = 0.0, False
        for part in P.parsed(query):
            must = {x.words: at(x) for x in part if not x.negated}
            if any(at(x) for x in part if x.negated) or not all(must.values()):
                continue
            hit = True
            if must:
                spans = {(b, e) for e in range(len(ws)) for b in range(e + 1) if all(any(b <= s and t <= e for s, t in o) for o in must.values())}
                for b, e in spans:
                    if (b + 1, e) not in spans and (b, e - 1) not in spans:  # the shortest ones
                        rank += 0.1 / (1 + max(e - b + 1 - sum(map(len, must)), 0))
        if hit:
            out[i] = round(rank, 6)
    return out


def test_searches_are_parsed():
    lit = P.Literal
    assert P.parsed('one "two  Three" -four -"five six" OR seven or -x-y "open') == [
        [lit(("one",)), lit(("two", "three")), lit(("four",), True), lit(("five", "six"), True)], [lit(("seven",))], [lit(("x", "y"), True), lit(("open",))],
    ]
    assert P.parsed(' or "" !! - ') == [] and P.parsed('"a or b"') == [[lit(("a", "or", "b"))]]


@pytest.mark.parametrize("query", ['a', '"a b"', '"a b" c', 'a -b', '"a a" -"b c" or c d', 'a a', '"a b" "b c"', '-a', 'a "42 c" or -b -c', 'zzz', '"a b c" or "a b" d -zzz', ""])
def test_search_equals_a_scan(spark, tmp_path, query):
    rng = random.Random(7)
    data = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(14)))) for i in range(150)] + [(900, None), (901, ""), (902, "A, B. C"), (903, "a b " * 200)]
    texts = spark.createDataFrame(data, "id long, text string")
    P.write_index(texts, "id", "text", str(tmp_path / "index"))
    got = P.search(spark.read.parquet(str(tmp_path / "index")), query, texts)
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(brute(data, query))


def test_only_forbidding_needs_all_ids(spark):
    index = P.positions(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")
    with pytest.raises(ValueError, match="only forbids"):
        P.search(index, "-a")
