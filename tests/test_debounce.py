"""Debounced plans over several micro-batches, with restarts from the checkpoint."""

import datetime

import pytest

from lithograph.streaming import debounce as D

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def plans(spark, tmp_path):
    """feed(rows): writes a file, starts the stream on one checkpoint until it has read it, gives all plans so far."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "repo string, path string, change string, ts timestamp"

    def feed(*batches):
        for n, rows in enumerate(batches):
            data = [(r, p, c, None if t is None else T0 + datetime.timedelta(seconds=t)) for r, p, c, t in rows]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = D.debounced(source, 10_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        out = {}
        for r in spark.read.parquet(str(tmp_path / "out")).collect():
            out.setdefault((r["repo"], round((r["until"] - T0).total_seconds())), []).append((r["path"], r["change"]))
        return {k: sorted(v) for k, v in out.items()}

    yield feed
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_plan_waits_for_quiet_across_batches_and_restarts(plans):
    # a goes on changing in later batches, so its first changes wait; b's event moves the time on
    got = plans([("a", "x", "new", 0), ("a", "y", "new", 4)], [("a", "x", "changed", 9), (None, "p", "new", 9), ("a", None, "new", 9), ("a", "q", "new", None)])
    assert got == {}
    got = plans([("a", "z", "deleted", 15), ("b", "x", "new", 16)])  # a restart: what was pending is still there
    assert got == {}
    got = plans([("c", "k", "new", 100)], [("c", "k", "changed", 100)])
    assert got == {("a", 15): [("x", "changed"), ("y", "new"), ("z", "deleted")], ("b", 16): [("x", "new")]}
    got = plans([("a", "x", "changed", 101)], [("a", "x", "back", 300)])  # each plan once, none lost
    assert got == {
        ("a", 15): [("x", "changed"), ("y", "new"), ("z", "deleted")], ("b", 16): [("x", "new")],
        ("c", 100): [("k", "new")], ("a", 101): [("x", "changed")],
    }


def test_plans_do_not_depend_on_micro_batches(plans):
    """Rows in one file, with gaps inside it: the same plans as if they had come one by one."""
    rows = [("a", "x", "new", 50), ("a", "y", "new", 0), ("a", "x", "new", 8), ("a", "x", "changed", 10), ("a", "x", "a tie", 10), ("b", "z", "new", 61), ("a", "w", "new", 200)]
    assert plans(rows, [("c", "k", "new", 500)]) == {("a", 10): [("x", "changed"), ("y", "new")], ("a", 50): [("x", "new")], ("b", 61): [("z", "new")], ("a", 200): [("w", "new")]}
