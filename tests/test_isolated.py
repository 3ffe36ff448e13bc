"""Rows that fail are kept with their reason and taken up again, each once."""

import pytest

from lithograph.operators import isolated as I


def work(broken):
    """Fails for poison rows; rows of ``broken`` go well from some try on (a folder counts the tries of each)."""

    def run(row):
        if row["text"] is None:
            raise ValueError("no text")
        if row["text"] == "poison":
            return str(1 // 0)
        path = broken / f"{row['id']}"
        n = len(path.read_text()) if path.exists() else 0
        path.write_text("x" * (n + 1))
        if row["text"] == "later" and n == 0:
            raise KeyError("not yet")
        return row["text"].upper()

    return run


def test_failures_are_isolated_and_taken_up_again(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a", "p"), (2, "later", "q"), (3, "poison", "r"), (4, None, "s"), (5, "b", "t"), (5, "b", "t")], "id int, text string, reason_code string").repartition(3)
    with pytest.raises(ValueError):
        I.finished(spark, path)
    assert I.attempt(rows, work(seen), path)
    assert {(r["id"], r["tries"]) for r in I.dead(spark, path).collect()} == {(2, 1), (3, 1), (4, 1)}
    reasons = {r["id"]: r["reason"] for r in I.dead(spark, path).collect()}
    assert reasons[3].startswith("ZeroDivisionError") and reasons[4] == "ValueError: no text"
    (tmp_path / "out" / "attempt=2").mkdir()  # of a driver that died: no outcomes, so the attempt is made again
    assert I.attempt(rows, work(seen), path)
    assert sorted((r["id"], r["result"], r["tries"]) for r in I.finished(spark, path).collect()) == [(1, "A", 1), (2, "LATER", 2), (5, "B", 1), (5, "B", 1)]
    assert I.attempt(rows, work(seen), path) and not I.attempt(rows, work(seen), path)
    assert {(r["id"], r["tries"]) for r in I.dead(spark, path).collect()} == {(3, 3), (4, 3)}
    assert len((seen / "1").read_text()) == 1 and len((seen / "2").read_text()) == 2  # what went well is not done again
    assert I.finished(spark, path).count() + I.dead(spark, path).count() == 6


def test_nothing_to_do(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, text string")
    assert I.attempt(rows, lambda r: "x", str(tmp_path / "out")) and not I.attempt(rows, lambda r: "x", str(tmp_path / "out"))
    assert I.finished(spark, str(tmp_path / "out")).count() == 0 == I.dead(spark, str(tmp_path / "out")).count()
