"""The inverted-file index against exact search."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lithograph.operators import vector_index as V
from lithograph.operators.search import dot, nearest

SCHEMA = "vec_id long, embedding array<float>"


def _pairs(df):
    return {(r["query_id"], r["vec_id"]): r["score"] for r in df.collect()}


def test_recall_of_the_given_table(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 10 = 0")
    index = V.build(rows, str(tmp_path / "index"))
    assert index.rows.count() == rows.count()
    truth, found = _pairs(nearest(rows, queries, 10)), _pairs(V.search(index, queries, 10, V.probes(index, queries, 10)))
    assert len(truth.keys() & found.keys()) / len(truth) >= 0.9
    assert all(found[p] == truth[p] for p in truth.keys() & found.keys())
    # the share of cells measured on some queries holds for others
    others, cells = rows.where("vec_id % 10 = 5"), V.probes(index, queries, 10)
    truth, found = _pairs(nearest(rows, others, 10)), _pairs(V.search(index, others, 10, cells))
    assert len(truth.keys() & found.keys()) / len(truth) >= 0.9
    # all cells are the exact way, in one block and in several
    for most in (20_000, 200):
        assert _pairs(V.search(index, others, 10, len(index.centroids), most)) == truth


def test_clusters_need_few_cells_and_copies_stay(spark, tmp_path):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    data = [(i, (centers[i % 12] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(600)]
    data += [(i, centers[0].tolist()) for i in range(600, 900)]  # a third are copies
    rows = spark.createDataFrame(data, SCHEMA)
    index = V.build(rows, str(tmp_path / "index"))
    queries = rows.where("vec_id < 60")
    cells = V.probes(index, queries, 5)
    assert 0 < cells < len(index.centroids) / 2
    truth, found = _pairs(nearest(rows, queries, 5)), _pairs(V.search(index, queries, 5, cells))
    assert len(truth.keys() & found.keys()) / len(truth) >= 0.9


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, None]), (8, [1.0, 0.0])]
    rows = spark.createDataFrame(odd, SCHEMA).withColumn("cell", F.lit("clash"))
    index = V.build(rows, str(tmp_path / "odd"))
    assert {r["vec_id"] for r in index.rows.where("cell = -1").collect()} == {3, 4, 5, 6, 7}
    found = V.search(index, rows, 3, len(index.centroids))
    assert {q for q, _ in _pairs(found)} == {1, 2, 8}
    none = V.build(rows.limit(0), str(tmp_path / "none"))
    assert V.probes(none, rows, 3) == 0 and V.search(none, rows, 3, 0).count() == 0


def plain(index, queries, k, cells):
    """The rows of the probed cells, joined to the queries and scored one by one by column functions."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    q = V._ranked(queries, index.centroids, cells).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode("cells").alias("cell")).where("cell >= 0")
    score = F.round(F.greatest(F.lit(0.0), dot(F.col("embedding"), F.col("q")) / (norm("embedding") * norm("q"))), 6)
    rows = index.rows.join(q, "cell").where("vec_id <> query_id").select("query_id", "vec_id", score.alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def test_probed_cells_are_scored_by_blocks_in_one_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    some = rng.standard_normal((900, 8)).astype(np.float32).tolist()
    data = [(i, some[i % 900]) for i in range(2600)]  # copies, so that scores tie
    data += [(i, some[7]) for i in range(2600, 3400)]  # and one cell has a fourth of the rows
    data += [(None, some[0]), (40, some[41]), (5000, [0.0] * 8), (5001, None), (5002, [1.0] * 3), (5003, [float("nan")] * 8)]
    rows = spark.createDataFrame(data, SCHEMA).repartition(7)
    index = V.build(rows, str(tmp_path / "index"))
    queries = rows.where("vec_id % 8 = 0 or vec_id > 5000 or vec_id is null")
    asked, cells = queries.count(), len(index.centroids) - 3
    assert asked * cells > 20_000  # two blocks of joined rows before
    found = V.search(index, queries, 10, cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Union" not in plan
    kept = lambda df: sorted((r["query_id"], r["place"], r["vec_id"], r["score"]) for r in df.collect())
    for few in (cells, 4):
        want = kept(plain(index, queries, 10, few))
        assert len(want) > 3000 and kept(V.search(index, queries, 10, few)) == want
    assert kept(V.search(index, queries, 10, 4, 500)) == want  # in blocks
    assert V.search(index, queries, 10, 0).count() == 0 and V.search(index, queries.limit(0), 10, 4).count() == 0


def test_sample_is_the_smallest_hashes(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(4).tolist()) for i in range(1000)]
    same = [(11, v) for _, v in data[:990]] + data[990:]
    for rows in (data, same):
        df = spark.createDataFrame(rows, SCHEMA)
        few = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(20)
        # as many cells as the sample has rows, and not moved: the sample itself
        rounds, V.ROUNDS = V.ROUNDS, 0
        try:
            got = V.fit(df.repartition(9), 20, 20)
        finally:
            V.ROUNDS = rounds
        unit = V._unit(np.array([r["embedding"] for r in few.collect()], np.float32))
        assert len(got) == 20 and (rows is same or np.array_equal(got, unit))
