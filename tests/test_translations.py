"""Catalog merges and translation plans against a loop over slugs."""

import random

from lithograph.operators import translations as TR


def brute(old, source, translated):
    out = {}
    for slug in {*source, *translated}:
        s, t = source.get(slug), translated.get(slug)
        edited = bool(t and t[1])
        if s is None:
            kind = "orphan" if edited else "delete"
        elif t is None:
            kind = "translate"
        elif slug in old and old[slug] == s[1]:
            kind = "reuse"
        else:
            kind = "conflict" if edited else "retranslate"
        out[slug] = [kind, t[0] if t else s[2], False]
    for slug, (kind, *_) in list(out.items()):
        at, seen = source.get(slug, (None,))[0], set()
        while kind in ("translate", "retranslate", "conflict") and at is not None and at not in seen:
            seen.add(at)
            if at in out and out[at][0] == "reuse":
                out[at][2] = True
            at = source.get(at, (None,))[0]
    return sorted((slug, *v) for slug, v in out.items())


def test_merge_equals_a_loop(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        slugs = [f"p{i}" for i in range(60)]
        some = lambda share: [s for s in slugs if rng.random() < share]  # noqa: B023, E731
        old = {s: rng.choice([0, 1]) for s in some(0.9)}
        source = {s: (f"p{int(s[1:]) // 2}" if s != "p0" and rng.random() < 0.9 else None, rng.choice([0, 0, 1, None]), f"T{s}") for s in some(0.85)}
        source["loop1"], source["loop2"] = ("loop2", 1, "L"), ("loop1", 1, "L")  # a tree that is none
        translated = {s: (f"t{s}", rng.choice([True, False, None])) for s in some(0.8)}
        got = TR.merged(
            spark.createDataFrame(list(old.items()), "slug string, hash int"),
            spark.createDataFrame([(k, *v) for k, v in source.items()], "slug string, parent_slug string, hash int, title string"),
            spark.createDataFrame([(k, *v) for k, v in translated.items()], "slug string, title string, edited boolean"),
        )
        assert sorted(map(tuple, got.collect())) == brute(old, source, translated)
        assert len({r["class"] for r in got.collect()}) == 6


def test_plan_cases(spark):
    source = spark.createDataFrame([(s,) for s in "abcdab"], "slug string")
    target = spark.createDataFrame([("a", "generated"), ("b", "draft"), ("c", "generated"), ("x", "draft"), ("y", None)], "slug string, status string")
    got = TR.plan(source, target, spark.createDataFrame([("c",), ("c",), ("zz",)], "slug string"))
    assert sorted(map(tuple, got.collect())) == [("a", "reuse", False), ("b", "translate", True), ("c", "translate", False), ("d", "translate", False), ("x", "delete", False), ("y", "delete", False)]
    assert TR.plan(source.limit(0), target.limit(0), source.limit(0)).count() == 0
