"""Range joins against brute force, and with many rows of few ranges."""

import random
import time

from lithograph.operators import ranges


def test_meeting_equals_brute_force(spark):
    rng = random.Random(3)
    one = lambda: (rng.choice(["f", "g"]), (a := rng.randrange(-5, 300)), a + rng.choice([0, 1, 7, 8, 64, 200, -3]))  # noqa: E731 - some are backwards
    own, others = sorted({one() for _ in range(150)}), sorted({one() for _ in range(150)})
    a = spark.createDataFrame([*own, ("f", None, 3)], "k string, s int, e int")
    b = spark.createDataFrame([*others, ("f", 1, None)], "k string, start_line int, end_line int")
    got = sorted((r["k"], r["s"], r["e"], r["start_line"], r["end_line"]) for r in ranges.meeting(a, b, "k").collect())
    meet = lambda x, y: max(min(x[1:]), min(y[1:])) <= min(max(x[1:]), max(y[1:]))
    assert got == sorted((*x, *y[1:]) for x in own for y in others if x[0] == y[0] and meet(x, y)) and len(got) > 500
    holds = spark.createDataFrame(got, "k string, s int, e int, start_line int, end_line int").where(ranges.HOLDS).count()
    assert holds == sum(y[1] <= x[1] and x[2] <= y[2] for x in own for y in others if x[0] == y[0])


def test_innermost_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"i{rng.randrange(70)}", rng.choice(["f", "g", None]), (a := rng.randrange(60)), a + rng.choice([0, 5, 5, 20, 40])) for _ in range(120)]
    df = spark.createDataFrame(rows, "id string, file_path string, start_line int, end_line int")
    want = {}
    for i, f, s, e in rows:
        for j, g, lo, hi in rows:
            if f == g and f and i != j and lo <= s and e <= hi:
                want[i] = min(want.get(i, (hi - lo, j)), (hi - lo, j))
    assert {r["id"]: r["owner"] for r in ranges.innermost(df, df).collect()} == {i: j for i, (_, j) in want.items()} and want


def test_many_rows_of_few_ranges(spark):
    n = 60_000  # by pairs of rows: 10^9
    df = spark.range(n).selectExpr("concat('p', id) as id", "'f' as file_path", "cast(id % 30 as int) as start_line", "cast(id % 30 + 9 as int) as end_line")
    start = time.time()
    got = ranges.innermost(df, df)
    assert got.count() == n and got.where("owner = id").isEmpty() and time.time() - start < 40
