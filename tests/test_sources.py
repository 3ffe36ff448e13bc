"""Scanning, parsing, building and watching small repositories."""

import hashlib
import pytest
from pyspark.sql import functions as F

from lithograph.functions.files import language
from lithograph.operators import build as B
from lithograph.sources.files import Ignore, scan
from lithograph.sources.symbols import parse_declarations, parse_ecma, parse_python, parsed
from lithograph.streaming import watch as W


@pytest.fixture
def repo(tmp_path):
    files = {
        "service.py": "import os\n\n\ndef helper():\n    return 1\n\n\ndef run():\n    return helper()\n",
        "api.py": "from service import helper\n\n\ndef handler():\n    return helper()\n",
        "loose.py": "def lonely():\n    return run()\n",
        "pkg/__init__.py": "",
        "pkg/models.py": "class Base:\n    pass\n\n\nclass Child(Base):\n    def go(self):\n        return 2\n\n\nclass Odd(External):\n    pass\n",
        "bad.py": "def broken(:\n",
        "config.json": "{}",
        "node_modules/x.js": "x()",
        "keep.log": "a",
        "drop.log": "b",
        "sub/.gitignore": "!special.log\nlocal.txt\n",
        "sub/special.log": "c",
        "sub/local.txt": "d",
        "binary.dat": "a\0b",
        ".gitignore": "*.log\n!keep.log\n",
    }
    for path, text in files.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    return str(tmp_path)


def test_scan(spark, repo):
    got = {r["path"]: r for r in scan(spark, repo).collect()}
    assert set(got) == {".gitignore", "api.py", "bad.py", "config.json", "keep.log", "loose.py", "pkg/__init__.py", "pkg/models.py", "service.py", "sub/.gitignore", "sub/special.log"}
    assert len(got["api.py"]["sha256"]) == 64 and got["api.py"]["size"] == len(got["api.py"]["content"])
    assert all(r["content"] is None for r in scan(spark, repo, content=False).collect())


def test_ignore_rules():
    rules = Ignore([("", "*.log"), ("", "!keep.log"), ("", "/top"), ("", "a/**/b"), ("", "out/")])
    assert rules("x/y.log", False) and not rules("x/keep.log", False)
    assert rules("top", False) and not rules("x/top", False)
    assert rules("a/b", False) and rules("a/x/y/b", False)
    assert rules("x/out", True) and not rules("x/out", False)


def built(spark, repo):
    files = scan(spark, repo).withColumn("language", language(F.col("path")))
    symbols = parsed(files).cache()
    return files, symbols, B.nodes("main", files, symbols), B.edges("main", files, symbols)


def test_build(spark, repo):
    files, symbols, nodes, edges = built(spark, repo)
    assert [r["file_path"] for r in symbols.where("type = 'error'").collect()] == ["bad.py"]
    short = lambda x: x.split("::")[-1].split(":")[-1]
    got = {(short(r["source_id"]), r["type"], short(r["target_id"])): (r["confidence"], r["reason"]) for r in edges.collect()}
    assert got["run", "calls", "helper"] == (0.95, "local-call")
    assert got["handler", "calls", "helper"] == (0.9, "import-resolved")
    assert got["lonely", "calls", "run"] == (0.5, "global")
    assert got["Child", "inherits", "Base"][0] == 0.95
    assert ("Odd", "inherits", "External") not in got
    assert got["Child", "contains", "Child.go"][0] == 1.0
    assert {k for k in got if k[1] == "imports"} == {("api.py", "imports", "service.py")}
    assert not [r for r in nodes.collect() if r["type"] == "module"]
    assert {r["id"] for r in nodes.where("type = 'config'").collect()} == {"main:file:config.json", "main:file:.gitignore", "main:file:sub/.gitignore"}
    assert nodes.count() == nodes.select("id").distinct().count()
    chunks = B.chunks("main", files, nodes).collect()
    helper = [c for c in chunks if c["node_id"].endswith("::helper")]
    assert len(helper) == 1 and helper[0]["content"] == "def helper():\n    return 1\n"


def test_chunk_of_a_long_symbol(spark):
    text = "import os\n\n\ndef long():\n" + "".join(f"    part_{i}()\n" for i in range(300))
    files = spark.createDataFrame([("long.py", "python", text)], "path string, language string, content string")
    got = {r["start_line"]: r for r in B.chunks("main", files, B.nodes("main", files, parsed(files))).collect()}
    want = text[text.index("def") :]
    assert (got[4]["end_line"], got[4]["content"], got[4]["token_count"]) == (304, want, 302)
    assert got[4]["content_hash"] == hashlib.sha256(want.encode()).hexdigest() and set(got) == {4}  # a file has no chunk of its own


def test_python_parser():
    text = 'import os\nfrom pathlib import Path\n\n\nclass A(B):\n    """Doc."""\n\n    def go(self):\n        return os.getcwd()\n\n\n@app.get("/x")\ndef top():\n    return A()\n'
    rows = {r["id"]: r for r in parse_python("app.py", text)}
    assert rows["app.py"]["imports"] == ["os", "pathlib.Path"]
    assert rows["app.py::A.go"]["type"] == "method" and rows["app.py::A"]["docstring"] == "Doc."
    assert rows["app.py::endpoint:GET:/x:top"]["calls"] == ["top"]


def test_ecma_parser():
    text = 'import { x } from "./x";\nexport class App extends Base {\n  run() { return x(); }\n}\nexport interface User { id: string }\nexport const load = async () => { return fetchAll(); };\nrouter.get("/users/:id", load);\n'
    rows = {r["id"]: r for r in parse_ecma("typescript")("app.ts", text)}
    assert rows["app.ts"]["imports"] == ["./x"] and rows["app.ts"]["exports"] == ["App", "User", "load"]
    assert rows["app.ts::App"]["bases"] == ["Base"] and rows["app.ts::User"]["type"] == "schema"
    assert rows["app.ts::load"]["calls"] == ["fetchAll"] and rows["app.ts::User"]["fields"] == ["id"]
    assert rows["app.ts::App.run"]["type"] == "method" and rows["app.ts::App.run"]["calls"] == ["x"]
    assert rows["app.ts::endpoint:GET:/users/:id:7"]["calls"] == ["load"]


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("go", "package a\ntype S struct {\n}\nfunc (s S) Go() {\n  run()\n}\n", {"S": "class", "Go": "method"}),
        ("java", "public class A {\n  public int go(int x) {\n    return run(x);\n  }\n}\n", {"A": "class", "go": "method"}),
        ("rust", "pub struct P {}\npub fn go() { run(); }\n", {"P": "class", "go": "function"}),
        ("c", "int go(int x) {\n  return run(x);\n}\n", {"go": "function"}),
        ("cpp", "class A {\n int go() { return 1; }\n};\n", {"A": "class", "go": "method"}),
        ("csharp", "public class A {\n  public int Go() {\n  }\n}\n", {"A": "class", "Go": "method"}),
    ],
)
def test_declaration_parsers(lang, text, want):
    assert {r["name"]: r["type"] for r in parse_declarations(lang)("f", text) if r["type"] != "file"} == want


def test_go_and_java_details():
    go = 'package a\nimport (\n "fmt"\n)\ntype I interface {\n  Do(x int) error\n}\nfunc (s *S) Go() {\n  fmt.Print("}")\n  run()\n}\nfunc free() {}\nfunc wire() { g.GET("/x", h.Serve) }\n'
    rows = {r["id"]: r for r in parse_declarations("go")("a.go", go)}
    assert rows["a.go"]["imports"] == ["fmt"] and rows["a.go"]["exports"] == ["I"]
    assert rows["a.go::S.Go"]["parent_id"] == "a.go::S" and rows["a.go::S.Go"]["end_line"] == 11  # the quoted brace doesn't count
    assert rows["a.go::I.Do"]["type"] == "method" and rows["a.go::endpoint:GET:/x:13"]["calls"] == ["Serve"]
    java = '@RequestMapping("/api")\n@RestController\npublic class A extends B implements I, J<T> {\n  @GetMapping("/x")\n  public int go(int x) {\n    return run(x);\n  }\n  @RequestMapping(value="/y", method=RequestMethod.POST)\n  public void put() {\n  }\n}\n'
    rows = {r["id"]: r for r in parse_declarations("java")("A.java", java)}
    assert (rows["A.java::A"]["bases"], rows["A.java::A"]["implements"], rows["A.java::A"]["decorators"]) == (["B"], ["I", "J"], ["RequestMapping", "RestController"])
    assert rows["A.java::endpoint:GET:/api/x:A.go"]["calls"] == ["go"] and "A.java::endpoint:POST:/api/y:A.put" in rows


def test_calls_belong_to_the_innermost_function():
    rows = {r["id"]: r for r in parse_python("a.py", "def out():\n    def inn():\n        deep()\n    near()\n")}
    assert rows["a.py::out"]["calls"] == ["near"] and rows["a.py::out.inn"]["calls"] == ["deep"]


def test_config_edges(spark):
    data = [("app/main.py", "python", "import settings\n\n\ndef run():\n    return load_settings(env)\n"), ("app/settings.py", "python", "X = 1\n"), ("deploy/.env", "dotenv", "A=1"), ("x.py", "python", "def plain():\n    return 1\n")]
    files = spark.createDataFrame(data, "path string, language string, content string")
    got = {(r["source_id"], r["target_id"]): (r["confidence"], r["reason"]) for r in B.edges("m", files, parsed(files)).where("type = 'uses_config'").collect()}
    assert got["m:file:app/main.py", "m:file:app/settings.py"] == (0.78, "config-import")
    assert got["m:symbol:app/main.py::run", "m:file:deploy/.env"] == (0.58, "config-reference")
    assert not any("plain" in s for s, _ in got)


def test_update_equals_a_full_build(spark):
    from lithograph.operators import incremental as U

    def files(**texts):
        return spark.createDataFrame([(f"{k}.py", "python", v) for k, v in texts.items()], "path string, language string, content string")

    old = files(a="def one():\n    return two()\n", b="def two():\n    return 2\n", c="def gone():\n    return one()\n")
    new = files(a="def one():\n    return two()\n", b="def two():\n    return three()\n", d="def three():\n    return 3\n")
    state, plan, stale = U.update("m", U.full("m", old), new)
    want = U.full("m", new)
    assert {r["path"]: r["change"] for r in plan.collect()} == {"a.py": "unchanged", "b.py": "changed", "c.py": "deleted", "d.py": "new"}
    for name in ("nodes", "edges", "chunks", "symbols"):
        got, full = (sorted(map(repr, getattr(x, name).select(sorted(getattr(x, name).columns)).collect())) for x in (state, want))
        assert got == full, name
    refs = {r["ref"] for r in stale.collect()}
    assert {"m:symbol:b.py::two", "m:file:c.py"} <= refs and "m:symbol:a.py::one" not in refs
    parsed_again = U.cached_symbols(U.with_sha(new), U.full("m", old).symbols)[1]
    assert {r["path"] for r in parsed_again.collect()} == {"b.py", "d.py"}


def test_watch_plans_each_snapshot(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "a", "1"), (1, "b", "1"), (2, "a", "2"), (3, "a", "1"), (3, "b", "1")]
    spark.createDataFrame(rows, "snapshot int, path string, sha string").coalesce(1).write.parquet(str(source))

    def plans(settle, state):
        out = []
        stream = spark.readStream.schema("snapshot int, path string, sha string").parquet(str(source))
        W.watch(stream, str(tmp_path / state), str(tmp_path / f"{state}-mark"), lambda p, n: out.append({r["path"]: r["change"] for r in p.collect()}), settle=settle).awaitTermination(60)
        return out

    assert plans(False, "each") == [{"a": "new", "b": "new"}, {"a": "changed", "b": "deleted"}, {"a": "changed", "b": "new"}]
    assert plans(True, "last") == [{"a": "new", "b": "new"}]


def test_watch(spark, tmp_path):
    source, plans = tmp_path / "in", []

    def snapshot(rows):
        spark.createDataFrame(rows, "path string, sha string").coalesce(1).write.mode("append").parquet(str(source))

    def once():
        stream = spark.readStream.schema("path string, sha string").parquet(str(source))
        q = W.watch(stream, str(tmp_path / "state"), str(tmp_path / "mark"), lambda p, n: plans.append({r["path"]: r["change"] for r in p.collect()}))
        q.awaitTermination(60)

    snapshot([("a", "1"), ("b", "1"), ("c", "1")])
    once()
    snapshot([("a", "1"), ("b", "2"), ("d", "1")])
    once()
    assert plans == [{"a": "new", "b": "new", "c": "new"}, {"b": "changed", "c": "deleted", "d": "new"}]


def test_event_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(f"out_{mode}")

    n = batch.count()
    assert run(W.windowed(stream, "1 day"), "complete").agg(F.sum("n")).first()[0] == n
    assert run(W.deduplicated(stream.unionAll(stream)), "append").count() == n
    assert W.sessions(stream).isStreaming
