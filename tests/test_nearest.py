"""Nearest vectors against the plain products of all pairs, with copies, ties and odd rows."""

import random

from pyspark.sql import functions as F

from lithograph.operators.search import dot, nearest


def plain(vectors, queries, k):
    """All pairs by column functions."""
    q = {r["vec_id"]: r["embedding"] for r in queries.collect() if r["vec_id"] is not None}
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    pairs = vectors.crossJoin(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).where("vec_id <> query_id")
    score = F.round(F.greatest(F.lit(0.0), dot(F.col("embedding"), F.col("q")) / F.nullif(norm("embedding") * norm("q"), F.lit(0.0))), 6)
    rows = sorted((r["query_id"], -r["score"], r["vec_id"]) for r in pairs.select("query_id", "vec_id", score.alias("score")).where("score > 0").collect())
    return [(i, v, -s) for i in sorted(q) for _, s, v in [r for r in rows if r[0] == i][:k]]


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(1)
    some = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, rng.choice(some)) for i in range(700)] + [(i, [float(rng.randrange(2)) for _ in range(8)]) for i in range(700, 900)]
    rows += [(None, some[0]), (900, None), (901, [0.0] * 8), (902, [1.0] * 3), (903, []), (904, [None] + [1.0] * 7), (950, [2.0] * 3), (1000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id % 50 = 0")
    got = nearest(df, asked, 10)
    want = plain(df, asked, 10)
    assert sorted((r["query_id"], r["place"], r["vec_id"], r["score"]) for r in got.collect()) == sorted((i, p, v, s) for i in {w[0] for w in want} for p, (_, v, s) in enumerate([w for w in want if w[0] == i], 1))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and (950, 902, 1.0) in want
