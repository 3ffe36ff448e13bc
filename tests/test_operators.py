"""Exact small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from lithograph.functions import files as P
from lithograph.functions import scalars as S
from lithograph.operators import graph as G
from lithograph.operators import ingest as I
from lithograph.operators import ordered as O
from lithograph.operators import search as R


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("Hello, World!", "hello-world"), ("***", "page"), ("A  b", "a-b")],
)
def test_slug(spark, text, want):
    assert one(spark, S.slug(F.col("t")), t=text) == want


def test_scalars(spark):
    assert one(spark, S.web_base(F.col("t")), t="git@github.com:owner/repo.git") == "https://github.com/owner/repo"
    assert one(spark, S.quoted_path(F.col("t")), t="a dir/has space.py") == "a%20dir/has%20space.py"
    assert one(spark, S.citations(F.col("t")), t="x [[S2]] y [[S1]] [[S2]]") == ["S2", "S1"]
    assert "sk-" not in one(spark, S.redacted(F.col("t")), t="key sk-abcdefgh12345678 failed")
    assert one(spark, S.joined_route(F.lit("/api/"), F.lit("/users"))) == "/api/users"
    assert one(spark, S.humanized(F.col("t")), t="test_userService_API") == "User Service API"
    assert one(spark, S.without_doubled_words(F.col("t")), t="Api api Package") == "Api Package"
    assert one(spark, S.line_label(F.lit(4), F.lit(6))) == "L4-L6"
    assert one(spark, S.token_estimate(F.lit(""))) == 1


def test_paths(spark):
    assert one(spark, P.language(F.col("t")), t="a/Dockerfile") == "dockerfile"
    assert one(spark, P.language(F.col("t")), t="a/b.test.tsx") == "tsx"
    assert one(spark, P.language(F.col("t")), t=".env.local") in ("dotenv", "unknown")
    for path, noise in (("main.py", False), ("tests/a.py", True), ("dist/x.js", True), ("node_modules/y.js", True), ("src/a_test.go", True), ("src/latest.py", False)):
        assert one(spark, P.is_noise(F.col("t")), t=path) is noise
    assert one(spark, P.module_of(F.col("t")), t="backend/app/services/graph/query.py") == "backend/app/services/graph"
    assert one(spark, P.module_of(F.col("t")), t="a/b/c/d/e.py") == "a/b/c"


def graph(spark, edges):
    nodes = sorted({x for e in edges for x in e[:2]})
    n = spark.createDataFrame([(x, "function", x, f"{x}.py", 1, 2, "python") for x in nodes], "id string, type string, name string, file_path string, start_line int, end_line int, language string")
    e = spark.createDataFrame([(f"{a}{t}{b}", a, b, t, c, 1.0, False) for a, b, t, c in edges], "id string, source_id string, target_id string, type string, confidence double, weight double, is_inferred boolean")
    return n, e


def test_traversals(spark):
    n, e = graph(spark, [("a", "b", "calls", 0.9), ("b", "c", "calls", 0.9), ("a", "d", "references", 1.0), ("d", "c", "calls", 0.5), ("x", "y", "calls", 1.0)])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    path = [r["id"] for r in G.shortest_flow(n, e, ids("a"), ids("c")).orderBy("step").collect()]
    assert path == ["a", "b", "c"]  # calls come before references
    assert G.shortest_flow(n, e, ids("a"), ids("x")).count() == 0
    assert {r["id"]: r["depth"] for r in G.impact(n, e, ids("c"), 2).collect()} == {"c": 0, "b": 1, "d": 1, "a": 2}
    comp = {r["id"]: r["component"] for r in G.components(n, e).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    got = {r["id"]: round(r["score"], 6) for r in G.expand(spark.createDataFrame([("a", 1.0)], "id string, score double"), e, 1).collect()}
    assert got == {"a": 1.0, "b": round(0.9 * 0.78, 6), "d": round(0.7 * 0.78, 6)}


def test_hybrid_rank_case(spark):
    chunks = spark.createDataFrame([("old", "n_old", "old.py", 1, 0.0), ("fresh", "n_fresh", "fresh.py", 1, 10.0)], "id string, node_id string, file_path string, start_line int, stamp double")
    n, e = graph(spark, [("n_old", "n_fresh", "calls", 1.0), ("n_fresh", "n_helper", "calls", 1.0)])
    hops = spark.createDataFrame([("n_old", 0), ("n_fresh", 1)], "id string, hop int")
    keyword = spark.createDataFrame([("old", 0.8)], "id string, score double")
    semantic = spark.createDataFrame([("fresh", 0.6)], "id string, score double")
    got = [(r["id"], round(r["score"], 4)) for r in R.hybrid_rank(chunks, n, e, hops, keyword, semantic).collect()]
    assert got == [("fresh", 0.51), ("old", 0.45)]


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([("s.helper", "helper", "service.py"), ("s.run", "run", "service.py")], "id string, name string, path string")
    calls = spark.createDataFrame([("service.py", "helper"), ("api.py", "helper"), ("loose.py", "helper"), ("api.py", "gone")], "path string, name string")
    scopes = spark.createDataFrame([("api.py", "service.py")], "path string, imported string")
    got = {r["path"]: (r["tier"], r["confidence"], r["is_inferred"]) for r in I.resolved_calls(calls, symbols, scopes).collect()}
    assert got == {"service.py": ("same_file", 0.95, False), "api.py": ("import_scoped", 0.9, False), "loose.py": ("global", 0.5, True)}


@pytest.mark.parametrize(
    "name, path, first",
    [("./util", "src/a.ts", "src/util"), ("../x", "src/lib/a.ts", "src/x"), (".mod", "pkg/a.py", "pkg/mod"), ("..mod.sub", "pkg/in/a.py", "pkg/mod/sub"), ("os.path", "a.py", "os/path")],
)
def test_import_candidates(spark, name, path, first):
    got = one(spark, I.import_candidates(F.col("n"), F.col("p")), n=name, p=path)
    assert got[0] == first and got[5] == first + ".py"


def test_config_ladder(spark):
    for path, lang, want in (("package.json", "json", ("package_manifest", 1.0)), (".env.local", "dotenv", ("environment", 1.0)), ("vite.config.ts", "typescript", ("runtime", 1.0)), ("my.config.ts", "typescript", ("tooling", 0.95)), ("settings.py", "python", ("runtime", 0.9)), ("config/a.yaml", "yaml", ("runtime", 0.85)), ("my-config.json", "json", ("runtime", 0.8)), ("main.py", "python", None), ("a/Dockerfile", "dockerfile", ("build", 1.0)), ("go.mod", "go-mod", ("package_manifest", 1.0)), ("x.config.cts", "typescript", ("tooling", 0.95))):
        got = one(spark, I.config_class(F.col("p"), F.col("l")), p=path, l=lang)
        assert (got and (got["kind"], got["confidence"])) == want


def test_islands_and_budget(spark):
    df = spark.createDataFrame([("f", 1, 5, "a"), ("f", 18, 20, "b"), ("f", 60, 70, "c")], "file string, start_line int, end_line int, label string")
    got = [(r["start_line"], r["end_line"], r["labels"]) for r in O.islands(df, "file").orderBy("island").collect()]
    assert got == [(1, 23, "a,b"), (57, 73, "c")]
    rows = spark.createDataFrame([("a", 5, 1), ("b", 9, 2), ("c", 4, 3), ("d", 1, 4)], "id string, tokens int, rank int")
    assert [r["id"] for r in R.packed(rows, "id", [F.col("rank")], "tokens", 10, 3).orderBy("rank").collect()] == ["a", "c", "d"]


def test_budget_chunks_keep_fences(spark):
    text = "intro\n\n```\na\n\nb\n```\n\ntail"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = [r["content"] for r in O.budget_chunks(df, "id", "text", 12).orderBy("chunk").collect()]
    assert got == ["intro", "```\na\n\nb\n```", "tail"]


def test_deep_trees_and_order(spark):
    rows = [("n0", None, 0, True)] + [(f"n{i}", f"n{i - 1}", 0, i != 20) for i in range(1, 25)] + [("side", "n0", 1, True)]
    tree = spark.createDataFrame(rows, "id string, parent_id string, ord int, open boolean")
    got = [(r["id"], r["depth"]) for r in O.preorder(tree).orderBy("path").collect()]
    assert got == [(f"n{i}", i) for i in range(25)] + [("side", 1)]
    assert [r["id"] for r in O.preorder(tree, F.col("open")).orderBy("path").collect()] == [f"n{i}" for i in range(21)] + ["side"]
    assert [r["id"] for r in O.within_budget(tree, 3).orderBy("path").collect()] == ["n0", "n1", "n2"]
    chain = tree.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    assert G.reachable(chain, spark.createDataFrame([("n24",)], "id string")).count() == 25
    numbers = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["v"] + 1 == r["place"] for r in O.numbered(numbers.repartition(5), ["v"], "place").collect())


def test_large_blocks_are_split(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\n\nd\n\n" + "e" * 25)], "id long, text string")
    got = [r["content"] for r in O.budget_chunks(df, "id", "text", 10).orderBy("chunk").collect()]
    assert got == ["aaaa\nbbbb", "cccc\n\nd", "e" * 10, "e" * 10, "e" * 5]


def test_bm25_clamps_frequent_terms(spark):
    df = spark.createDataFrame([("a", "the cat"), ("b", "the dog dog"), ("c", "the"), ("d", ""), ("e", None)], "id string, text string")
    got = {r["id"]: r["bm25"] for r in R.bm25(df.fillna(""), "id", "text", ["the", "dog"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] > 0.5 and 0 < got["a"] < 1e-5
    assert R.bm25(df.fillna(""), "id", "text", []).count() == 0


def test_expansion_in_order_of_discovery(spark):
    _, e = graph(spark, [("a", "b", "calls", 0.9), ("c", "a", "contains", 1.0), ("a", "d", "calls", 1.0), ("b", "x", "calls", 1.0), ("c", "y", "calls", 1.0)])
    got = [r["id"] for r in G.expand_undirected(e, spark.createDataFrame([("a", 1)], "id string, place int"), 2, 6).orderBy("hop", "place").collect()]
    assert got == ["a", "c", "d", "b", "y", "x"]
    assert G.expand_undirected(e, spark.createDataFrame([("a", 1)], "id string, place int"), 2, 3).count() == 3


def test_retrieval(spark):
    from lithograph.operators import retrieve as V

    n, e = graph(spark, [("load_user", "open_db", "calls", 0.95), ("open_db", "close_db", "calls", 0.9), ("test_it", "load_user", "calls", 1.0)])
    n = n.withColumn("file_path", F.when(F.col("id") == "test_it", "tests/test_it.py").otherwise(F.col("file_path")))
    chunks = n.select(F.concat(F.lit("k-"), "id").alias("id"), F.col("id").alias("node_id"), "file_path", "start_line", "end_line", F.concat(F.lit("def "), "name").alias("content"), F.when(F.col("id") == "close_db", 9000).otherwise(5).alias("token_count"), F.lit(None).cast("double").alias("stamp"))
    trace = V.retrieve(n, e, chunks, "load_user")
    nodes = {r["id"]: r["hop"] for r in trace.nodes.collect()}
    assert nodes["load_user"] == 0 and nodes["open_db"] <= 1 and "test_it" not in nodes
    picked = [r["id"] for r in trace.chunks.orderBy("rank").collect()]
    assert picked[0] == "k-load_user" and "k-close_db" not in picked and "k-test_it" not in picked  # too long; a test
    assert "def load_user" in V.context_pack(trace).first()["text"] and V.trace_id("m", trace).first()["id"].startswith("m:trace:")
    assert [r["relation"] for r in V.node_context(n, e, n.where("id = 'open_db'").select("id")).collect()] == ["node", "caller", "callee"]


def test_greedy_picks(spark):
    from lithograph.operators import wiki as W

    rows = spark.createDataFrame([("a", "b", 9.0), ("c", "d", 8.0), ("a", "c", 7.0), ("b", "a", 6.0)], "s string, t string, score double")
    got = [(r["s"], r["t"]) for r in W.picked(rows, [F.desc("score")], "s", "t", 3, 3).orderBy("place").collect()]
    assert got == [("a", "b"), ("a", "c"), ("b", "a")]
    assert [(r["s"], r["t"]) for r in W.picked(rows, [F.desc("score")], "s", "t", 3, 3, page=2).orderBy("place").collect()][0] == ("a", "b")


def test_community_dependencies(spark):
    c = spark.createDataFrame([("p", "P", 0, None), ("A", "A", 1, "p"), ("B", "B", 1, "p")], "id string, name string, level int, parent_id string")
    m = spark.createDataFrame([("p", "a"), ("p", "b"), ("A", "a"), ("B", "b")], "community_id string, node_id string")
    e = spark.createDataFrame([("edge-1", "a", "b", "calls", 0.8, 2.0), ("edge-2", "a", "b", "imports", 1.0, 1.0), ("edge-3", "a", "b", "contains", 1.0, 1.0)], "id string, source_id string, target_id string, type string, confidence double, weight double")
    got = {(r["kind"], r["weight"], r["confidence"], r["evidence"]) for r in G.community_dependencies(c, m, e).collect()}
    assert got == {("calls_into", 2.0, 0.8, "edge-1"), ("imports_from", 1.0, 1.0, "edge-2")}
