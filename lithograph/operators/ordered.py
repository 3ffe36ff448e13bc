"""Operators that depend on an order: islands, caps, suffixes, trees, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.graph import cut


def islands(ranges: DataFrame, key: str, gap: int = 15, pad: int = 3, most: int = 4) -> DataFrame:
    """Line ranges (start_line, end_line, label) of a key merged where they lie within ``gap`` lines; first ``most``."""
    order = Window.partitionBy(key).orderBy("start_line", "end_line", "label")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_line") > reach + gap), 1).otherwise(0)
    numbered = ranges.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = numbered.where(F.col("island") <= most).groupBy(key, "island").agg(F.min("start_line").alias("lo"), F.max("end_line").alias("hi"), F.array_sort(F.collect_set("label")).alias("labels"))
    return rows.select(key, "island", F.greatest(F.lit(1), F.col("lo") - pad).alias("start_line"), (F.col("hi") + pad).alias("end_line"), F.array_join("labels", ",").alias("labels"))


def capped(rows: DataFrame, group: str, order: list[Column], each: int, total: int | None = None) -> DataFrame:
    """At most ``each`` rows of a group, then ``total`` in all, by order. Spark's group limit prunes map-side."""
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= each).drop("_n")
    return out.orderBy(*order).limit(total) if total else out


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place (from 1) in the order of some columns, which tell rows apart.

    Rows are dealt by ranges and numbered within each; a range begins after the rows of those before
    it. So no task holds more than its range, and what is summed over is one row a range.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    before = sizes.select("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), F.col("_part") == F.col("_at")).withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def suffixed(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """The rows with ``unique_slug``: repeats get -2, -3, .. in order.

    All rows are numbered by ranges, and a repeat's number is its distance from its slug's first row, so
    a slug that a third of the rows share is not sorted by one task.
    """
    placed = numbered(rows, [slug, order], "_place")
    first = placed.groupBy(slug).agg(F.min("_place").alias("_first"))
    n = F.col("_place") - F.col("_first") + 1
    out = placed.join(first, slug, "left").withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))
    return out.select(*rows.columns, "unique_slug")


def preorder(tree: DataFrame, only: Column | None = None) -> DataFrame:
    """tree(id, parent_id, ord) flattened: id, depth and path, a sort key in pre-order. One join a level, to the last level.

    ``only``: a column of the tree; what is below a row for which it does not hold is left out (closed folders).
    """
    own = F.format_string("%010d", F.col("ord").cast("long"))
    opened = F.lit(True) if only is None else only
    rows = tree.select("id", "parent_id", own.alias("own"), F.coalesce(opened, F.lit(False)).alias("open"))
    level = cut(rows.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("own").alias("path"), "open"))
    kids = rows.where("parent_id is not null")
    out, depth = level, 0
    while True:
        depth += 1
        above = level.where("open").select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = cut(kids.join(above, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat_ws("/", "above", "own").alias("path"), "open"))
        if level.isEmpty():
            return out.select("id", "depth", "path")
        out = out.unionByName(level)
        if depth % 16 == 0:
            out = cut(out)


def within_budget(tree: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` rows of a tree in pre-order (a top-k by path): id, depth, path."""
    return preorder(tree).orderBy("path").limit(budget)


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def sections(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """Lines grouped by the headings (a pattern) above them: key, section (0 before the first), lines, chars.

    A fold within each row, so nothing is shuffled; a null text has no lines.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.rlike(heading).alias("head"), F.length(x).alias("n")))
    pair = "array<struct<section:long,lines:long,chars:long>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct((last["section"] + F.when(x["head"], 1).otherwise(0)).alias("section"), F.lit(1).cast("long").alias("lines"), x["n"].cast("long").alias("chars"))
        more = F.struct(last["section"].alias("section"), (last["lines"] + 1).alias("lines"), (last["chars"] + x["n"]).alias("chars"))
        return F.when(x["head"], F.array_append(acc, new)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more)))

    start = F.array(F.struct(F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("chars"))).cast(pair)
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.aggregate(lines, start, add)).alias("x")).select(key, "x.*").where("lines > 0")


def line_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Chunks of ``size`` lines: key, chunk, start_line, end_line, n_chars (with the lines' ends). No shuffle."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("lines"))
    chunk = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(size)), lambda i: F.struct(i.alias("start_line"), F.slice("lines", i, size).alias("own"))))
    rows = rows.select(key, chunk.alias("chunk", "x"))
    chars = F.aggregate(F.transform("x.own", lambda c: F.length(c) + 1), F.lit(0), lambda a, c: a + c)
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.col("x.start_line").alias("start_line"), (F.col("x.start_line") + F.size("x.own") - 1).alias("end_line"), chars.cast("long").alias("n_chars"))


def budget_chunks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Blocks of a markdown text (split at blank lines, fences kept whole) packed into chunks of ``budget`` characters.

    A block above the budget is split between its lines, and a line above it every ``budget`` characters.
    A stateful fold over a row's own text: Arrow batches, no shuffle.
    """

    def split(block: str) -> Iterator[str]:
        part = ""
        for line in block.split("\n"):
            if part and len(part) + 1 + len(line) > budget:
                yield part
                part = ""
            part = f"{part}\n{line}" if part else line
            while len(part) > budget:
                yield part[:budget]
                part = part[budget:]
        if part:
            yield part

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                blocks, block, fenced = [], [], False
                for line in (t or "").split("\n"):
                    fenced ^= line.lstrip().startswith("```")
                    if not line.strip() and not fenced:
                        if block:
                            blocks.append("\n".join(block))
                        block = []
                    else:
                        block.append(line)
                if block:
                    blocks.append("\n".join(block))
                chunk = ""
                n = 0
                for b in (x for block in blocks for x in ([block] if len(block) <= budget else split(block))):
                    if chunk and len(chunk) + 2 + len(b) > budget:
                        out.append((k, n, chunk))
                        n, chunk = n + 1, b
                    else:
                        chunk = f"{chunk}\n\n{b}" if chunk else b
                if chunk:
                    out.append((k, n, chunk))
            yield pd.DataFrame(out, columns=[key, "chunk", "content"])

    return docs.select(key, text).mapInPandas(fold, f"{key} {dict(docs.dtypes)[key]}, chunk long, content string")


def adaptive_groups(files: DataFrame, path: str, share: float = 0.7) -> DataFrame:
    """group, files: by the shallowest of three directory depths with two groups or more and none above ``share``; else the deepest."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    at = lambda n: F.array_join(F.slice(dirs, 1, n), "/")
    rows = files.select(F.explode(F.array(*[F.struct(F.lit(n).alias("depth"), at(n).alias("group")) for n in (1, 2, 3)])).alias("x")).groupBy("x.depth", "x.group").agg(F.count("*").alias("files"))
    fit = rows.groupBy("depth").agg(F.count("*").alias("n"), (F.max("files") / F.sum("files")).alias("top")).select(F.coalesce(F.min(F.when((F.col("n") >= 2) & (F.col("top") <= share), F.col("depth"))), F.lit(3)).alias("depth"))
    return rows.join(F.broadcast(fit), "depth").select("depth", "group", "files")
