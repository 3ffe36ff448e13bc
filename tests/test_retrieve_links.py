"""Retrieval over links: edges are made where the selection has them, of all others only the ends are counted."""

import random

from pyspark.sql import functions as F

from lithograph.operators import graph as G
from lithograph.operators import retrieve as V
from lithograph.plans.registry import last_links


def graph(spark, seed=7):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"n{i:02d}", "function", pick("load_user", "save", "other"), pick("a/x.py", "a/y.py", "tests/z.py")) for i in range(40)]
    nodes = spark.createDataFrame([(*r, 1, 9) for r in rows], "id string, type string, name string, file_path string, start_line int, end_line int").withColumn("language", F.lit("python"))
    ends = [r[0] for r in rows] + [None, "nowhere"]
    links = [(pick(*ends), pick(*ends), pick("calls", "references", None), rng.random(), pick(1.0, 2.0), k // 2) for k in range(700)]
    links = spark.createDataFrame(links, "source_id string, target_id string, type string, confidence double, weight double, seq long").withColumn("is_inferred", F.lit(False))
    chunks = nodes.select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("node_id"), "file_path", "start_line", "end_line", F.col("name").alias("content"), F.lit(5).alias("token_count"), F.lit(0.0).alias("stamp"))
    return nodes, links, chunks


def test_links_give_the_trace_of_their_edges(spark):
    nodes, links, chunks = graph(spark)
    want = V.rows(V.retrieve(nodes, G.cut(last_links(links)), chunks, "load_user")).collect()
    written, cut = [], G.cut

    def watched(df):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    G.cut = watched
    try:
        got = V.rows(V.retrieve(nodes, links, chunks, "load_user", last=last_links)).collect()
    finally:
        G.cut = cut
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r["kind"] for r in got} >= {"seed", "expanded", "edge", "chunk"}
    assert any(c == ["id", "degree"] for c, _ in written)  # of the edges of all nodes only the counts are kept


def test_ends_within_equal_the_ends_of_edges_within(spark):
    nodes, links, _ = graph(spark, 8)
    kept = nodes.where("file_path not like 'tests/%'")
    want = G.within(last_links(links), kept).where("type is not null").select("source_id", "target_id")
    got = G.ends_within(links, kept.unionAll(kept), last_links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert G.ends_within(links.where("type is not null"), kept).count() == G.within(links.where("type is not null"), kept).count() > got.count()
    some = kept.limit(3)
    near = G.around(links, some, nodes, ~F.col("file_path").startswith("tests/"), last_links)
    ids = {r["id"] for r in some.collect()}
    whole = {r["id"] for r in G.within(last_links(links), kept).collect() if r["source_id"] in ids or r["target_id"] in ids}
    assert {r["id"] for r in near.collect()} == whole and near.count() == len(whole)
