"""Reassembles a transaction log whose sources interleave, without following any source through one task (operator 12).

Records in order of doc_id are changes of keys, savepoints, rollbacks, commits and aborts of their
source's current transaction. As a rollback keeps its savepoint, a change is undone by the next control
record of its source if that is a rollback; otherwise its transaction's end decides.

1. The log is cut into chunks of at most ``CHUNK`` records by ranges of its order, whatever the sources.
2. A chunk's summary holds, for each source in it, the first control record (a rollback is unmatched
   here: it undoes changes of earlier chunks; a savepoint is open to them) and the first end, and its
   number of commits. Summaries are associative.
3. They are combined by a parallel prefix scan: windows of at most ``FAN`` neighbours, then of blocks of
   ``FAN``, and so on up, and the carries down again (`carried`, `running`). No window grows with the log.
4. Every chunk resolves its own records with what the scan carries into it.
5. Commits are numbered by the same scan, ``EPOCH`` of them end an epoch. Of each (key, epoch) the last
   change counts; what it replaces comes from the scan over a key's epochs, and states are the running
   sums of the differences.

A source with a third of all rows is spread over all chunks. Texts go into a crc32 in the first step and
are never shuffled; nothing is collected but two numbers (rows, chunks).

Defined cases: rows with equal doc_id are taken in order of source and value (nulls first), equal rows in
any order; a row without doc_id has no place in a log and is left out; a null source is a source; a null
text deletes its key; repeated or null labels: toxic if any says so; an empty table or a log without
commits has no states; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.llm.common import id_crc, shared_dir, written

#: Records that a chunk holds at most, neighbours that a step of the scan combines, commits of an epoch, keys of the store.
CHUNK, FAN, EPOCH, KEYS = 500_000, 256, 16, 3000
#: Small logs have up to PARALLEL chunks of SMALLEST records at least.
PARALLEL, SMALLEST = 64, 1000
#: The log's order.
ORDER = ["doc_id", "source", "value", "serial"]
COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = "commit", "abort", "savepoint", "rollback", "change"


def records(docs: DataFrame, labels: DataFrame, keys: int = KEYS) -> DataFrame:
    """doc_id, source, kind, key, value of every log record; a change's value is the crc32 of ``key:text``, null if it deletes."""
    toxic = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).distinct().hint("merge")
    turn = F.pmod(F.col("h"), F.lit(41))
    kind = F.when(turn <= 1, COMMIT).when(turn == 2, ABORT).when(turn <= 4, SAVEPOINT).when(turn <= 6, ROLLBACK).otherwise(CHANGE)
    key = F.when(F.col("kind") == CHANGE, F.pmod(F.expr("h div 100"), F.lit(keys)))
    value = F.when(F.col("kind") == CHANGE, F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")).cast("binary")))
    rows = docs.where("doc_id is not null").select("doc_id", F.col("source").cast("string").alias("source"), id_crc().alias("h"), "text")
    rows = rows.withColumn("kind", kind).withColumn("key", key).select("doc_id", "source", "kind", "key", value.alias("value"))
    rows = rows.join(toxic, "doc_id", "left")
    return rows.select("doc_id", "source", "kind", "key", F.when(F.col("toxic").isNull(), F.col("value")).alias("value"))


def _scan(rows: DataFrame, group: list[str], at: str, folder: str, fan: int, total: Callable, run: Callable, join: Callable) -> DataFrame:
    """rows(*group, at, v) with ``before``, the combination of v over all smaller positions of the group; one row a position.

    ``total(v, position)`` combines a block, ``run(v, window)`` the rows before one in its block, and
    ``join`` that with what comes into the block. Up: a row for each block of ``fan`` positions, level by
    level until one block is left. Down again: each level takes what comes in from the level above.
    """
    last = rows.agg(F.max(at)).first()[0] or 0  # one number
    block = F.expr(f"{at} div {fan}").cast("long")
    levels = [rows]
    while last >= fan:
        last //= fan
        up = levels[-1].groupBy(*group, block.alias(at)).agg(total(F.col("v"), F.col(at)).alias("v"))
        levels.append(written(up, f"{folder}/up{len(levels)}"))
    window = Window.partitionBy(*group, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].withColumn("block", block).withColumn("before", run(F.col("v"), window))
        if out is not None:
            above = out.select(*[F.col(c).alias(f"_{c}") for c in group], F.col(at).alias("_block"), F.col("before").alias("into"))
            same = F.col("block") == F.col("_block")
            for c in group:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            here = here.join(above.hint("merge"), same, "left").withColumn("before", join(F.col("before"), F.col("into")))
        out = here.select(*group, at, "v", "before")
        out = written(out, f"{folder}/down{k}") if k else out
    return out


def carried(rows: DataFrame, group: list[str], at: str, folder: str, fan: int = FAN) -> DataFrame:
    """rows(*group, at, v), v a struct, with ``before``: each field's last value that is not null at a smaller position."""
    fields = rows.schema["v"].dataType.names
    each = lambda f: F.struct(*[f(x).alias(x) for x in fields])
    return _scan(
        rows, group, at, folder, fan,
        lambda v, place: each(lambda x: F.max_by(v[x], F.when(v[x].isNotNull(), place))),
        lambda v, window: each(lambda x: F.last(v[x], True).over(window)),
        lambda here, into: each(lambda x: F.coalesce(here[x], into[x])),
    )


def running(rows: DataFrame, at: str, folder: str, fan: int = FAN) -> DataFrame:
    """rows(at, v), v a struct of numbers, with ``before``: each field's sum over all smaller positions."""
    fields = rows.schema["v"].dataType.names
    each = lambda f: F.struct(*[f(x).alias(x) for x in fields])
    return _scan(
        rows, [], at, folder, fan,
        lambda v, _: each(lambda x: F.sum(v[x])),
        lambda v, window: each(lambda x: F.coalesce(F.sum(v[x]).over(window), F.lit(0))),
        lambda here, into: each(lambda x: here[x] + F.coalesce(into[x], F.lit(0))),
    )


def _chunks(log: DataFrame, largest: int) -> DataFrame:
    """The records with their chunk: ranges of the log's order, numbered from 0."""
    n = log.count()
    parts = max(-(-n // largest), min(-(-n // SMALLEST), PARALLEL), 1)
    return log.repartitionByRange(parts, *ORDER).withColumn("chunk", F.spark_partition_id().cast("long"))


def resolved(log: DataFrame, folder: str, largest: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Every change with its fate, and every commit with its number from 1; both are stored tables.

    fates(doc_id, key, value, serial, fate, by, number): fate is commit (number says which), rollback or
    abort; by is the record that undoes it, null for the end of the log.
    """
    chunks = written(_chunks(log, largest), f"{folder}/chunks")
    commit = (F.col("kind") == COMMIT).cast("long")
    per_chunk = chunks.groupBy("chunk").agg(F.struct(F.sum(commit).alias("n")).alias("v"))
    offsets = running(per_chunk, "chunk", f"{folder}/commits", fan).select("chunk", F.col("before.n").alias("offset"))

    # within a chunk: commits are numbered, then each record sees the next control record and the next end of its source
    along = Window.partitionBy("chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("chunk", "source").orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct("kind", "doc_id", "number")
    rows = chunks.join(offsets.hint("merge"), "chunk").withColumn("number", F.when(F.col("kind") == COMMIT, F.col("offset") + F.sum(commit).over(along)))
    rows = rows.withColumns({"control": F.when(F.col("kind") != CHANGE, mark), "end": F.when(F.col("kind").isin(COMMIT, ABORT), mark)})
    rows = rows.withColumns({"control": F.last("control", True).over(back), "end": F.last("end", True).over(back)}).drop("offset")
    rows = written(rows, f"{folder}/local")

    # what lies before a chunk's end looks for it in later chunks: the scan runs from the last chunk to the first
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*ORDER))).alias(c)
    last_chunk = rows.agg(F.max("chunk")).first()[0] or 0
    summaries = rows.groupBy("source", (last_chunk - F.col("chunk")).alias("back")).agg(F.struct(first("control"), first("end")).alias("v"))
    later = carried(summaries, ["source"], "back", f"{folder}/controls", fan)
    later = later.select(F.col("source").alias("_source"), (last_chunk - F.col("back")).alias("_chunk"), F.col("before.control").alias("next_control"), F.col("before.end").alias("next_end"))
    changes = rows.where(F.col("kind") == CHANGE).join(later.hint("merge"), (F.col("chunk") == F.col("_chunk")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    changes = changes.withColumns({"control": F.coalesce("control", "next_control"), "end": F.coalesce("end", "next_end")})
    fate = F.when(F.col("control.kind") == ROLLBACK, ROLLBACK).when(F.col("end.kind") == COMMIT, COMMIT).otherwise(ABORT)
    by = F.when(F.col("fate") == ROLLBACK, F.col("control.doc_id")).when(F.col("fate") == ABORT, F.col("end.doc_id"))
    fates = changes.withColumn("fate", fate).select("doc_id", "key", "value", "serial", "fate", by.alias("by"), F.when(F.col("fate") == COMMIT, F.col("end.number")).alias("number"))
    return written(fates, f"{folder}/fates"), rows.where("number is not null").select("number")


def states(applied: DataFrame, commits: DataFrame, folder: str, every: int = EPOCH, fan: int = FAN) -> DataFrame:
    """epoch, n, value: stored keys and the sum of their values after each epoch of ``every`` commits.

    applied(number, key, value, doc_id, serial): committed changes; commits(number): all commits.
    """
    epoch = F.expr(f"(number - 1) div {every}").cast("long")
    last = F.max_by(F.struct("value"), F.struct("number", "doc_id", "value", "serial")).alias("last")
    latest = written(applied.groupBy("key", epoch.alias("epoch")).agg(F.struct(last).alias("v")), f"{folder}/latest")
    steps = carried(latest, ["key"], "epoch", f"{folder}/keys", fan).select("epoch", F.col("v.last.value").alias("now"), F.col("before.last.value").alias("was"))
    stored = lambda c: F.col(c).isNotNull().cast("long")
    worth = lambda c: F.coalesce(F.col(c), F.lit(0))
    steps = steps.select("epoch", (stored("now") - stored("was")).alias("n"), (worth("now") - worth("was")).alias("value"))
    none = commits.select(epoch.alias("epoch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("value"))
    by_epoch = steps.unionByName(none).groupBy("epoch").agg(F.struct(F.sum("n").alias("n"), F.sum("value").alias("value")).alias("v"))
    by_epoch = running(written(by_epoch, f"{folder}/epochs"), "epoch", f"{folder}/sums", fan)
    return by_epoch.select((F.col("epoch") + 1).alias("epoch"), (F.col("v.n") + F.col("before.n")).alias("n"), (F.col("v.value") + F.col("before.value")).alias("value"))


def replay(docs: DataFrame, labels: DataFrame, every: int = EPOCH, keys: int = KEYS, largest: int = CHUNK, fan: int = FAN) -> DataFrame:
    """kind, id, n, value: a ``state`` row of each epoch and a row of each change that an abort or a rollback undid."""
    folder = shared_dir(docs.sparkSession)
    # the number of a record parts equal ones; it is stored, so it stays when tasks run again
    log = written(records(docs, labels, keys).withColumn("serial", F.monotonically_increasing_id()), f"{folder}/log")
    fates, commits = resolved(log, folder, largest, fan)
    after = states(fates.where(F.col("fate") == COMMIT), commits, folder, every, fan)
    undone = fates.where(F.col("fate") != COMMIT).select(F.col("fate").alias("kind"), F.col("doc_id").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return undone.unionByName(after.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value"))


#: The log in SQL, one window over each source; crc32 by its table of 256 remainders.
ORACLE = """
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT doc_id, source, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc WHERE doc_id IS NOT NULL),
log AS (SELECT row_number() OVER (ORDER BY doc_id, source NULLS FIRST) AS pos, doc_id, source, CASE WHEN h % 41 <= 1 THEN 'commit' WHEN h % 41 = 2 THEN 'abort' WHEN h % 41 <= 4 THEN 'savepoint' WHEN h % 41 <= 6 THEN 'rollback' ELSE 'change' END AS kind,
  h // 100 % 3000 AS key, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN text END AS text FROM ids),
near AS (SELECT *, min(CASE WHEN kind <> 'change' THEN pos END) OVER later AS control, min(CASE WHEN kind IN ('commit', 'abort') THEN pos END) OVER later AS ending FROM log WINDOW later AS (PARTITION BY source ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
commits AS (SELECT pos, row_number() OVER (ORDER BY pos) AS number FROM log WHERE kind = 'commit'),
fates AS (SELECT n.pos, n.doc_id, n.key, n.text, CASE WHEN c.kind = 'rollback' THEN 'rollback' WHEN e.kind = 'commit' THEN 'commit' ELSE 'abort' END AS fate, CASE WHEN c.kind = 'rollback' THEN c.doc_id ELSE e.doc_id END AS by_id, number
  FROM near n LEFT JOIN log c ON c.pos = n.control LEFT JOIN log e ON e.pos = n.ending LEFT JOIN commits k ON k.pos = n.ending WHERE n.kind = 'change'),
latest AS (SELECT key, (number - 1) // 16 AS epoch, max_by({'text': text}, (number, pos)).text AS text FROM fates WHERE fate = 'commit' GROUP BY ALL),
worth AS (SELECT key, epoch, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(key || ':' || text), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS crc FROM latest, crc),
steps AS (SELECT epoch, CAST(crc IS NOT NULL AS BIGINT) AS n, coalesce(crc, 0) AS value FROM worth UNION ALL
  SELECT epoch, -CAST(was IS NOT NULL AS BIGINT), -coalesce(was, 0) FROM (SELECT epoch, lag(crc) OVER (PARTITION BY key ORDER BY epoch) AS was FROM worth) x UNION ALL
  SELECT (number - 1) // 16, 0, 0 FROM commits)
SELECT fate AS kind, doc_id AS id, by_id AS n, CAST(key AS BIGINT) AS value FROM fates WHERE fate <> 'commit' UNION ALL
SELECT 'state', epoch + 1, CAST(sum(sum(n)) OVER running AS BIGINT), CAST(sum(sum(value)) OVER running AS BIGINT) FROM steps GROUP BY epoch WINDOW running AS (ORDER BY epoch)
"""
