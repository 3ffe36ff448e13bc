"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

Fingerprint: A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are
``SHINGLE`` successive words joined by a space (fewer words: the whole sequence; none: fingerprint
zero). A bit of the fingerprint is set if it is set in over half of the shingles' XXH64 values.

Search: fingerprints within ``RADIUS`` bits. Each bit position gets a non-zero code word of
RADIUS + 1 bits; table v, one for each non-zero vector v, masks out the positions whose code word is
orthogonal to v. RADIUS differing positions span at most RADIUS dimensions, so some v is orthogonal to
all of them and that table does not see the difference: every pair within the radius shares a bucket
in some table, with certainty. The 31 tables see about half of the bits each.

Work: equal fingerprints are one row from the start. Buckets are sorted runs within hash partitions;
a worker compares the members of a bucket in tiles and returns links that span each class (fewer than
members, never all pairs). A bucket of over ``WIDE`` members is not compared there: its members go
through a second set of tables, keyed by the bucket and by one of RADIUS + 1 blocks of the bits that
the bucket leaves open; a pair within the radius agrees on at least one block, so nothing is lost.
Classes of linked fingerprints come from alternating star contractions, each written to the shared
checkpoint folder; nothing but a row count and a checksum reaches the driver.

Defined cases: null and empty texts have fingerprint zero and are linked like all others; repeated
rows of a doc_id each get a row; an empty table gives an empty table; a null doc_id has its
fingerprint, and is the class's id only if the class has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import by_bytes, filled, removed, shared_dir, small_batches, text_bytes, written

SHINGLE, SEED, RADIUS, WIDE = 4, 42, 4, 8192

#: Byte -> eight byte-wide counters, one for each bit.
SPREAD = np.array([int.from_bytes(bytes(b >> k & 1 for k in range(8)), "little") for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of one text, repeats included."""
    words = text.lower().split()  # of bytes: ASCII only, as the contract says
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    return [h(joined[i:j], seed) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints(rows: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    hashes = [shingle_hashes(r) for r in rows]
    counts = np.fromiter(map(len, hashes), np.int64, len(rows))
    out = np.zeros(len(rows), np.uint64)
    if not counts.sum():
        return out
    flat = np.concatenate([np.array(x, np.uint64) for x in hashes if x])
    ends = np.cumsum(counts)
    # counters of a byte hold 255 at most, so sums run over pieces of that many rows
    firsts, owners = [], []
    for d, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        pieces = range(e - c, e, 255)
        firsts.extend(pieces)
        owners.extend([d] * len(pieces))
    spread = SPREAD[flat.view(np.uint8).reshape(-1, 8)]
    ones = np.add.reduceat(spread, np.array(firsts), axis=0).view(np.uint8).reshape(len(firsts), 64)
    owners = np.array(owners)
    heads = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    totals = np.add.reduceat(ones.astype(np.int64), heads, axis=0)
    with_words = owners[heads]
    over = 2 * totals > counts[with_words][:, None]
    out[with_words] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table sees."""
    top = (1 << radius + 1) - 1
    words = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, w in enumerate(words) if (w & v).bit_count() & 1) for v in range(1, top + 1)]


def blocks(open_bits: int, parts: int = RADIUS + 1) -> list[int]:
    """The open bits of a table in ``parts`` blocks."""
    places = [i for i in range(64) if open_bits >> i & 1]
    return [sum(1 << p for p in places[k::parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_within(fps: np.ndarray, radius: int, cells: int = 1 << 20) -> list[tuple[int, int]]:
    """Links that span the classes of one bucket: breadth-first over tiles, n - classes links in all."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if np.bitwise_count(fps[0] ^ fps[1]) <= radius else []
    todo = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            tile = max(1, cells // len(todo))
            part, front = front[:tile], front[tile:]
            near = np.bitwise_count(fps[part][:, None] ^ fps[todo][None, :]) <= radius
            hit = near.any(0)
            if hit.any():
                by = part[near[:, hit].argmax(0)]
                found = todo[hit]
                out += zip(by.tolist(), found.tolist(), strict=True)
                front = np.concatenate([front, found])
                todo = todo[~hit]
    return out


def _compare(rows: DataFrame, keys: list[str], radius: int, wide: int | None) -> DataFrame:
    """Links within buckets: rows (keys.., fp) are hashed by key and sorted, then read as runs.

    A bucket of over ``wide`` members is handed on: its rows come back with b null and its keys.
    """
    kept = [f"{k} long" for k in keys]

    def run(batches):
        rest = None

        def buckets():
            nonlocal rest
            for batch in filled(batches):
                now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if rest is not None:
                    now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
                n = len(now[0])
                new = np.zeros(n, bool)
                new[:1] = True
                for c in now[:-1]:
                    new[1:] |= c[1:] != c[:-1]
                at = np.flatnonzero(new)
                rest = [c[at[-1] :] for c in now]
                yield now, at
            if rest is not None:
                yield rest, np.array([0, len(rest[0])])

        for cols, at in buckets():
            sizes = np.diff(at)
            many = np.flatnonzero(sizes > 1)
            # pairs, the commonest bucket, all at once
            two = at[:-1][many[sizes[many] == 2]]
            fps = cols[-1].astype(np.int64).view(np.uint64)
            close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b, key = [cols[-1][close]], [cols[-1][close + 1]], [[c[close] for c in cols[:-1]]]
            handed = []
            for i in many[sizes[many] > 2].tolist():
                lo, hi = int(at[i]), int(at[i + 1])
                if wide and hi - lo > wide:
                    handed.append((lo, hi))
                    continue
                if links := _links_within(fps[lo:hi], radius):
                    x, y = np.array(links).T + lo
                    a.append(cols[-1][x])
                    b.append(cols[-1][y])
                    key.append([c[x] for c in cols[:-1]])
            for lo, hi in handed:
                a.append(cols[-1][lo:hi])
                key.append([c[lo:hi] for c in cols[:-1]])
            a_all = np.concatenate(a)
            b_all = np.concatenate([*b, np.zeros(len(a_all) - sum(map(len, b)), np.int64)])
            none = np.arange(len(a_all)) >= sum(map(len, b))
            if len(a_all):
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c), pa.int64()) for c in zip(*key, strict=True)], pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64(), mask=none)], [*keys, "a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "fp").mapInArrow(run, ", ".join([*kept, "a long", "b long"]))


def links(fps: DataFrame, folder: str, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct) that span all near-duplicate classes."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    seen = masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(seen)]))
    first = written(_compare(fps.select(tables.alias("x"), "fp").select("x.t", "x.key", "fp"), ["t", "key"], radius, wide), f"{folder}/first")
    out = first.where("b is not null").select("a", "b")
    handed = first.where("b is null").select("t", "key", F.col("a").alias("fp"))
    if handed.isEmpty():
        return out.distinct()
    split = None
    for v, m in enumerate(seen):
        open_bits = ~m & (1 << 64) - 1
        x = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(b))).alias("block")) for j, b in enumerate(blocks(open_bits, radius + 1))])
        split = F.when(F.col("t") == v, x) if split is None else split.when(F.col("t") == v, x)
    again = handed.select("t", "key", F.explode(split).alias("x"), "fp").select("t", "key", "x.j", "x.block", "fp")
    second = written(_compare(again, ["t", "key", "j", "block"], radius, None), f"{folder}/second")
    return out.unionByName(second.select("a", "b")).distinct()


def classes(pairs: DataFrame, folder: str) -> DataFrame:
    """node, root: the smallest node that each node of the links (a, b) reaches, by star contractions.

    Large star: every neighbour above a node is linked to the node's smallest neighbour; small star:
    every neighbour below. Both keep reachability; the links end as stars. Each round is written, and
    rounds stop when count and checksum stay.
    """
    spark = pairs.sparkSession

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.where("v > u") if large else both
        out = near.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        if not large:
            out = out.union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    step, mark = 0, None
    now = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/cc0")
    while True:
        step += 1
        new = written(star(star(now, True), False), f"{folder}/cc{step}")
        sums = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        removed(spark, f"{folder}/cc{step - 1}")
        if sums == mark:
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now, mark = new, sums


def with_fingerprint(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp: the fingerprint of each document as a signed long; columns ``more`` come along."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in filled(batches):
            rows, out = text_bytes(batch), []
            for lo, hi in by_bytes(rows):
                out.append(fingerprints(rows[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64), pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *more])

    chosen = docs.select("doc_id", "text", *more)
    return chosen.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} {chosen.schema[c].dataType.simpleString()}" for c in more]]))


def _rooted(distinct: DataFrame, folder: str) -> DataFrame:
    """The rows of ``distinct`` (fp, distinct, and other columns) with root, the class of the fingerprint."""
    roots = classes(links(distinct, folder), folder)
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every document."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    prints = written(with_fingerprint(docs), f"{folder}/prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = written(distinct, f"{folder}/distinct")
    # a class's id: the smallest doc_id of its fingerprints
    named = _rooted(distinct, folder)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _place(docs: DataFrame) -> Column:
    """Where a row stands in its class: by doc_id (nulls last), the text's digest, then a hash of the other columns.

    No field is null, so places compare and join by value; rows of one place are equal in all columns.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(*[x for c in [F.col("text").isNull(), *others] for x in (c, c.isNull())])
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), digest.alias("digest"), rest.alias("rest"))


def one_of_each(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row of each class of near duplicates, all columns: the one with the smallest ``_place``.

    Only rows of one class replace each other: rows without a doc_id, and rows that share one, stay
    for each class of their own. The smallest place of a class is an aggregation that combines before
    the shuffle, so a class of many copies is not one task's; texts are shuffled once, by place.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    placed = docs.withColumn("_near_place", _place(docs))
    distinct = with_fingerprint(placed, "_near_place").groupBy("fp").agg(F.min("_near_place").alias("first"))
    named = _rooted(written(distinct, f"{folder}/distinct"), folder)
    kept = named.groupBy("root").agg(F.min("first").alias("_near_place")).select("_near_place")
    return placed.join(kept, "_near_place", "left_semi").dropDuplicates(["_near_place"]).select(*[f"`{c}`" for c in docs.columns])
