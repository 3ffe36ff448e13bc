"""Page exports: read back as written, whole or not at all."""

import pytest
from pyspark.sql import functions as F

from lithograph.sources import export


def saved(pages, path):
    pages.write.format("lithograph_pages").mode("append").save(path)


def test_an_export_is_read_back(spark, tmp_path):
    export.registered(spark)
    path = str(tmp_path / "vault")
    read = lambda: sorted(map(tuple, spark.read.format("lithograph_pages").load(path).collect()), key=repr)
    assert read() == []
    rows = [(f"page/{i} ü?", f"Title <{i}>", None if i % 3 else "page/0 ü?", i, f"# {i}\n\ntext {i}\n" * 50) for i in range(40)] + [("..", None, None, None, None), ("empty", "", "", 0, "")]
    saved(spark.createDataFrame(rows, export.SCHEMA).repartition(5), path)
    assert read() == sorted(rows, key=repr)
    links = "".join(p.read_text() for p in (tmp_path / "vault").glob("*/part-*.html"))
    assert links.count("<li>") == 42 and "Title &lt;7&gt;" in links and (next((tmp_path / "vault").glob("*/index.html"))).read_text().count("<p>") >= 5


def test_a_failing_task_leaves_the_earlier_export(spark, tmp_path):
    export.registered(spark)
    path = str(tmp_path / "vault")
    read = lambda: {r["slug"] for r in spark.read.format("lithograph_pages").load(path).collect()}
    pages = lambda *slugs: spark.createDataFrame([(s, s, None, 1, "x") for s in slugs], export.SCHEMA)
    saved(pages("a", "b"), path)
    with pytest.raises(Exception, match="no slug|ABORT|abort"):
        saved(pages("c", "d", "e", "f").repartition(4).withColumn("slug", F.when(F.col("slug") != "e", F.col("slug"))), path)
    assert read() == {"a", "b"} and len([p for p in (tmp_path / "vault").iterdir() if p.is_dir()]) == 1
    saved(pages("z"), path)
    assert read() == {"z"} and len([p for p in (tmp_path / "vault").iterdir() if p.is_dir()]) == 2
    saved(pages("y").limit(0), path)
    assert read() == set() and len([p for p in (tmp_path / "vault").iterdir() if p.is_dir()]) == 2
