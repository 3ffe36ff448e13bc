"""Joins of line ranges of the same key: which ranges meet, which hold others.

Callers give each distinct range once, so that the pairs are bounded by the lines that keys have and not
by the rows. Ranges meet by cells: a range lies at the level whose cells (a power of two of lines) are as
long as it is, so it touches two of them at most, and it meets longer ones at their level. So what is
compared lies close together, whatever the length of a key's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.graph import cut


def _levelled(rows: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
    """The rows with their lines in order (a range may be given backwards) and the level of their length."""
    a, b = F.col(lo).cast("long"), F.col(hi).cast("long")
    out = rows.where(a.isNotNull() & b.isNotNull()).withColumns({f"_{side}lo": F.least(a, b), f"_{side}hi": F.greatest(a, b)})
    length = F.col(f"_{side}hi") - F.col(f"_{side}lo")
    return cut(out.withColumn(f"_{side}level", F.when(length < 1, 0).otherwise(F.length(F.bin(length)))))


def _celled(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """A row for each cell that a range touches at each of some levels: _level, _cell."""
    cell = lambda c, x: F.call_function("shiftright", F.col(f"_{side}{c}"), x)
    cells = F.transform(levels, lambda x: F.transform(F.sequence(cell("lo", x), cell("hi", x)), lambda c: F.struct(x.alias("_level"), c.alias("_cell"))))
    return rows.withColumn("_at", F.explode(F.flatten(cells))).select("*", "_at._level", "_at._cell").drop("_at")


def meeting(own: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Pairs of ranges that share a line, each pair once: own(key, s, e, ..) and others(key, start_line, end_line, ..)."""
    a, b = _levelled(own, "s", "e", "a"), _levelled(others, "start_line", "end_line", "b")
    seen = lambda df, side: F.broadcast(df.agg(F.collect_set(f"_{side}level").alias("_levels")))  # noqa: E731 - one short array
    longer = lambda x, side, strict: F.filter("_levels", lambda n: n > F.col(f"_{side}level") if strict else n >= F.col(f"_{side}level"))
    only = lambda side: F.array(f"_{side}level")
    up = _celled(a.crossJoin(seen(b, "b")), "a", longer(a, "a", False)).drop("_levels").join(_celled(b, "b", only("b")), [key, "_level", "_cell"])
    down = _celled(b.crossJoin(seen(a, "a")), "b", longer(b, "b", True)).drop("_levels").join(_celled(a, "a", only("a")), [key, "_level", "_cell"])
    first = F.call_function("shiftright", F.greatest("_alo", "_blo"), F.col("_level"))  # of two cells that both touch, the first
    pairs = up.unionByName(down).where((F.col("_cell") == first) & (F.col("_alo") <= F.col("_bhi")) & (F.col("_blo") <= F.col("_ahi")))
    return pairs.drop("_level", "_cell", *[f"_{x}{c}" for x in "ab" for c in ("lo", "hi", "level")])


HOLDS = "start_line <= s and e <= end_line"


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Smallest span of the same file that contains each point's lines: id, owner.

    Of equal spans the two smallest ids are kept, as a point may not own itself; of the spans that hold a
    range likewise the two best of different ids.
    """
    at = ["file_path", "start_line", "end_line"]
    place = F.dense_rank().over(Window.partitionBy(*at).orderBy("id"))
    held = spans.select(*at, "id").withColumn("_n", place).where("_n <= 2").groupBy(*at).agg(F.min("id").alias("a"), F.max("id").alias("b"))
    asked = points.select("file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    pairs = meeting(asked.distinct(), held, "file_path").where(HOLDS)
    options = pairs.select("file_path", "s", "e", (F.col("end_line") - F.col("start_line")).alias("size"), F.explode(F.array("a", "b")).alias("owner")).groupBy("file_path", "s", "e", "owner").agg(F.min("size").alias("size"))
    rank = F.row_number().over(Window.partitionBy("file_path", "s", "e").orderBy("size", "owner"))
    best = options.withColumn("_n", rank).where("_n <= 2").groupBy("file_path", "s", "e").agg(F.array_sort(F.collect_list(F.struct("size", "owner"))).alias("best"))
    own = points.select("id", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e")).join(best, ["file_path", "s", "e"])
    found = own.select("id", F.get(F.filter("best", lambda x: x["owner"] != F.col("id")), F.lit(0)).alias("x")).where("x is not null")
    return found.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.owner")
