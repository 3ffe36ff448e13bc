"""Communities of planted groups, and stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from lithograph.operators import community as C
from lithograph.operators import tables as T


def test_louvain_finds_planted_groups(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    edges = spark.createDataFrame([(s, t, 1.0, 1.0) for s, t in pairs], "source_id string, target_id string, weight double, confidence double")
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "abc" for i in range(6)] + [("alone",)], "id string")
    home = C.louvain(nodes, edges)
    groups = {frozenset(r["ids"]) for r in home.groupBy("community").agg(F.collect_list("id").alias("ids")).collect()}
    assert groups == {frozenset(f"{g}{i}" for i in range(6)) for g in "abc"} | {frozenset(["alone"])}
    assert C.modularity(home, edges) > 0.55
    assert C.louvain(nodes, edges.limit(0)).where("id <> community").count() == 0


def planted(spark, groups, size):
    names = [f"g{g:02d}n{i:03d}" for g in range(groups) for i in range(size)]
    nodes = spark.createDataFrame([(n, "function", f"{n[:3]}/f{int(n[4:]) % 40}.py") for n in names], "id string, type string, file_path string")
    links = [(f"g{g:02d}n{i:03d}", f"g{g:02d}n{(i * 7 + k) % size:03d}", "calls") for g in range(groups) for i in range(size) for k in (1, 2, 3)]
    links += [(f"g{g:02d}n000", f"g{g + 1:02d}n001", "references") for g in range(groups - 1)]
    edges = spark.createDataFrame([(a, b, t, 1.0) for a, b, t in links if a != b], "source_id string, target_id string, type string, confidence double")
    return nodes, edges


def test_hierarchy(spark):
    nodes, edges = planted(spark, 5, 40)
    other = spark.createDataFrame([("iface", "interface", "x.ts")], "id string, type string, file_path string")
    communities, members = C.hierarchy(nodes.unionByName(other), edges)
    rows = {(r["key"], r["level"]): r for r in communities.collect()}
    inside = {}
    for r in members.collect():
        inside.setdefault((r["key"], r["level"]), set()).add(r["id"])
    assert set(inside) == set(rows) and all(len(inside[k]) == rows[k]["size"] and min(inside[k]) <= k[0] for k in rows)
    tops = [k for k in rows if k[1] == 0]
    assert set().union(*(inside[k] for k in tops)) == {r["id"] for r in nodes.collect()} and len(rows) <= C.MOST_IN_ALL
    for key, level in rows:
        if level:  # each lies within its parent, and a parent has 12 children or 8 details at most
            above = (rows[key, level]["parent_key"], level - 1)
            assert inside[key, level] <= inside[above]
            assert len([1 for k in rows if k[1] == level and rows[k]["parent_key"] == above[0]]) <= (12 if level == 1 else 8)
    assert all(rows[k]["size"] >= C.LEAST_CHILD for k in rows if k[1] == 1)
    alone, _ = C.hierarchy(nodes.limit(1), edges.limit(0))
    assert [(r["level"], r["size"]) for r in alone.collect()] == [(0, 1)]


def in_turn(nodes, links, resolution):
    """Louvain node by node on dicts: every node looks in every pass, until no community joins another."""
    home, near = {n: n for n in nodes}, {n: {} for n in nodes}
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0.0) + w
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + w
    while True:
        degree = {n: sum(ws.values()) for n, ws in near.items()}
        total, at, size, moved = sum(degree.values()), {n: n for n in near}, dict(degree), True
        while moved:
            moved = False
            for n in sorted(near):
                to = {at[n]: 0.0}
                for x, w in near[n].items():
                    if x != n:
                        to[at[x]] = to.get(at[x], 0.0) + w
                size[at[n]] -= degree[n]
                gain = {c: round(w - resolution * degree[n] * size[c] / total, 9) for c, w in to.items()}
                best = min(gain, key=lambda c: (-gain[c], c != at[n], c))  # noqa: B023
                size[best] += degree[n]
                moved, at[n] = moved or best != at[n], best
        if len(set(at.values())) == len(near):
            return home
        home, merged = {n: at[c] for n, c in home.items()}, {c: {} for c in set(at.values())}
        for a, ws in near.items():
            for b, w in ws.items():
                merged[at[a]][at[b]] = merged[at[a]].get(at[b], 0.0) + w
        near = merged


def quality(home, links, resolution):
    total = sum(w for *_, w in links)
    ends = {}
    for a, b, w in links:
        for x in (a, b):
            ends[home[x]] = ends.get(home[x], 0.0) + w
    return sum(w for a, b, w in links if home[a] == home[b]) / total - resolution * sum((d / (2 * total)) ** 2 for d in ends.values())


@pytest.mark.parametrize("block, least", [(C.BLOCK, 0.999), (700, 0.9), (150, 0.8)])
def test_blocks_come_near_a_sequential_run(spark, block, least):
    """One block, several, and several with hubs that no block holds."""
    rng = random.Random(2)
    names = [f"n{i:03d}" for i in range(160)]
    pairs = {tuple(sorted(rng.sample([n for n in names if int(n[1:]) % 8 == g], 2))) for g in range(8) for _ in range(60)} | {tuple(sorted(rng.sample(names, 2))) for _ in range(40)} | {("n000", n) for n in names[1:120]}
    links = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in sorted(pairs)]
    edges = spark.createDataFrame([(*x, 1.0) for x in links], "source_id string, target_id string, weight double, confidence double")
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    got = {r["id"]: r["community"] for r in C.louvain(nodes, edges, 1.0, block).collect()}
    want = in_turn(names, links, 1.0)
    assert quality(got, links, 1.0) >= least * quality(want, links, 1.0) > 0.1
    assert all(min(n for n in got if got[n] == c) == c for c in set(got.values())) and set(got) == set(names)


def test_scopes_are_graphs_of_their_own(spark):
    nodes, edges = planted(spark, 3, 12)
    scoped = nodes.select("id", F.substring("id", 1, 3).alias("scope"))
    home = C.louvain(scoped, edges.withColumn("weight", F.lit(1.0)), 2.0)
    assert home.where(F.substring("id", 1, 3) != F.substring("community", 1, 3)).isEmpty() and home.count() == 36


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *x: spark.createDataFrame([(i, n) for i, n in x], "id string, n int")
    T.replaced(rows(("a", 1), ("b", 1)), path, "one")
    T.replaced(rows(("z", 9)), path, "two")
    schema = rows(("a", 1)).schema
    stored = lambda repo: {(r["id"], r["n"]) for r in T.stored(spark, path, repo, schema).collect()}
    assert T.synced(spark, rows(("b", 2), ("c", 2)), path, "one", "id") == {"kept": 1, "new": 1, "changed": 0, "stale": 1}
    assert stored("one") == {("b", 1), ("c", 2)}
    assert T.synced(spark, rows(("b", 2), ("c", 2)), path, "one", "id", ["n"])["changed"] == 1 and stored("one") == {("b", 2), ("c", 2)}
    assert T.synced(spark, rows(("a", 1)).limit(0), path, "one", "id")["stale"] == 2 and stored("one") == set()
    T.replaced(rows(("a", 1)), path, "one")
    T.dropped(spark, [path], "one")
    assert stored("one") == set() and stored("two") == {("z", 9)}
    assert T.evolved(rows(("a", 1)), {"n": "0", "status": "'draft'"}).first()["status"] == "draft"


def test_a_replacement_that_dies_leaves_a_whole_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "nodes")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    schema = rows("a").schema
    stored = lambda: {r["id"] for r in T.stored(spark, path, "r/1", schema).collect()}
    assert stored() == set()
    T.replaced(rows("a", "b"), path, "r/1")
    committed = T._committed

    def dies(*_):
        raise RuntimeError

    monkeypatch.setattr(T, "_committed", dies)  # after the rows are written, before they count
    with pytest.raises(RuntimeError):
        T.replaced(rows("c"), path, "r/1")
    assert stored() == {"a", "b"}
    bad = rows("x").select(F.raise_error(F.lit("boom")).cast("string").alias("id"))  # while the rows are written
    with pytest.raises(Exception, match="boom"):
        T.replaced(bad, path, "r/1")
    assert stored() == {"a", "b"}
    monkeypatch.setattr(T, "_committed", committed)
    reader = T.stored(spark, path, "r/1", schema)
    T.replaced(T.stored(spark, path, "r/1", schema).where("id = 'a'").unionByName(rows("d")), path, "r/1")
    assert stored() == {"a", "d"} and {r["id"] for r in reader.collect()} == {"a", "b"}
    T.replaced(rows("e").limit(0), path, "r/1")
    assert stored() == set() and len(list((tmp_path / "nodes").glob("*/*/"))) == 2


def test_greedy_picks_are_exact_over_all_rows(spark):
    from lithograph.operators import wiki as W

    def brute(rows, nodes, edges):
        seen, out = set(), []
        for r in sorted(rows):
            ends = {r[1], r[2]}
            if len(out) < edges and (not out or len(seen | ends) <= nodes):
                out.append(r)
                seen |= ends
        return out

    rng = random.Random(1)
    cases = [
        ([(i, f"a{i}", f"b{i}", "x") for i in range(5)] + [(5, "a0", "k", "x")] + [(10 + i, f"u{i}", f"v{i}", "x") for i in range(600)] + [(9999, "k", "a1", "x")], 12, 18),
        ([(i, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice("xy")) for i in range(900)], 9, 14),
        ([(0, "a", "b", "x"), (0, "a", "b", "x"), (0, "a", "b", "y"), (1, "a", "a", "x")] * 3, 2, 7),
        ([(0, "a", "b", "x")], 1, 5),
    ]
    for rows, nodes, edges in cases:
        df = spark.createDataFrame(rows, "rank int, s string, t string, kind string").repartition(3)
        for page in (1, 7, 500):
            got = W.picked(df, ["rank", "s", "t", "kind"], "s", "t", nodes, edges, page).orderBy("place").collect()
            assert [tuple(r)[1:] for r in got] == brute(rows, nodes, edges)
