"""Content-addressed store of token-id streams (operator 3).

A document's ids are cut into chunks where a rolling hash of the last ``WINDOW`` ids has its low bits
zero, so equal passages give equal chunks wherever they stand. A chunk is named by its digest and
stored once. A document is a recipe, the list of its chunks' digests, with a Merkle root over them;
each recipe file has a manifest row with a Merkle root over its documents.

Layout below one folder (Parquet, so any store that Spark reads will do):

* ``objects/kind=chunk``: name (sha256 of the ids), n, body (the ids, packed, see ``pack``);
* ``recipes``: in ascending doc_id order, doc_id, n_tokens, root, chunks (digests), part;
* ``manifest``: part, first and last doc_id, documents, n_tokens, root.

One job encodes and shuffles each chunk once by its name; texts and whole streams never move.
Verification reads every stored chunk once, recomputes its digest and its crc32, and folds the crc32
of documents from those of their chunks (crc32 of a concatenation is a function of the parts' crc32
and lengths), so reading back moves digests only. ``read_documents`` gives whole streams.

Defined cases: a null or empty text is a stream that has the end id alone; equal texts share all
chunks; rows that repeat a doc_id stay separate rows, ordered by their roots; an empty table gives
empty tables.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm import bpe
from lithograph.llm.common import filled, lengths, small_batches, texts

WINDOW = 16
#: Ids in a chunk: a cut falls on one position in MEAN, never before LEAST or after MOST ids.
LEAST, MEAN, MOST = 64, 512, 4096
GEAR = (np.arange(1, 1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
GEAR = np.concatenate([GEAR, GEAR[:1]])


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind the ids where a chunk may end: the rolling hash of the last WINDOW ids has its low bits zero.

    Streams that lie behind one another may be marked at once: a chunk has LEAST ids, more than WINDOW,
    so no cut depends on ids of the stream before.
    """
    h = GEAR[ids & 0xFFFF]
    step = 1
    while step < WINDOW:  # h[i] becomes the sum of GEAR[ids[i-j]] << j over the window
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return np.flatnonzero(h >> np.uint32(7) & np.uint32(MEAN - 1) == 0) + 1


def _cut(places: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from ``start`` to ``end``; ``places``: its marks."""
    out = []
    for m in [*places, end]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == end:
            if m > start:
                out.append(m)
            start = m
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream; they depend on the ids around a cut only."""
    return _cut(marks(ids).tolist(), 0, len(ids))


def planes(ids: np.ndarray) -> np.ndarray:
    """The four bytes of each id, as four rows: the lowest first."""
    return np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)


def pack(rows: np.ndarray, wide: bool) -> bytes:
    """A chunk's body from its planes: one byte, the bytes of an id (2 or 4), then that many planes through zstd."""
    width = 4 if wide else 2
    return bytes([width]) + _packer().compress(rows[:width].tobytes())


def unpack(body: bytes) -> bytes:
    """The chunk's ids as little-endian unsigned 32-bit integers."""
    width = body[0]
    raw = np.frombuffer(_unpacker().decompress(body[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{width}").astype("<u4").tobytes()


@functools.cache
def _packer():
    return zstandard.ZstdCompressor(level=3, write_checksum=False)


@functools.cache
def _unpacker():
    return zstandard.ZstdDecompressor()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed level by level, an odd one moves up; no leaves: sha256 of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the crc32 polynomial, both bit-reflected."""
    out, m = 0, 1 << 31
    while a:
        if a & m:
            out ^= b
            a ^= m
        m >>= 1
        b = b >> 1 ^ POLY if b & 1 else b >> 1
    return out


@functools.lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x to the power 8 * n modulo the polynomial."""
    out, base, k = 1 << 31, 1 << 30, 8 * n
    while k:
        if k & 1:
            out = _times(base, out)
        base = _times(base, base)
        k >>= 1
    return out


def crc_of_concatenation(parts: list[tuple[int, int]]) -> int:
    """crc32 of the concatenation of parts given as (crc32, bytes)."""
    out = parts[0][0] if parts else 0
    for crc, n in parts[1:]:
        out = _times(_shift(n), out) ^ crc
    return out


_ENCODERS: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    """Encodes with the tokenizers library: its model gives the ids of each piece; pieces are remembered."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path).model
        symbols = dict(enumerate(bpe.byte_symbols()))  # the model reads bytes as these characters

        def merge(words: list[bytes]) -> list[bytes]:
            tokens = [model.tokenize(w.decode("latin-1").translate(symbols)) for w in words]
            ids = np.array([t.id for ts in tokens for t in ts], "<u4").tobytes()
            return bpe.cut_up(ids, 4 * np.cumsum(lengths(tokens)))

        _ENCODERS[path] = bpe.Encoder(bpe.loaded(path), merge)
    return _ENCODERS[path]


ROW = "kind string, name binary, doc_id long, n long, body binary, chunks array<binary>"
SCHEMA = pa.schema([("kind", pa.string()), ("name", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("chunks", pa.list_(pa.binary()))])


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store below ``path``."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        enc = library_encoder(vocabulary)
        sent: set[bytes] = set()
        task, row = TaskContext.get().partitionId(), 0
        for batch in filled(batches):
            doc_ids, at = batch.column(0).to_pylist(), 0
            for part in bpe.runs(texts(batch)):
                ids, ends = enc.arrays(part)
                ids = np.insert(ids, ends, end_id)
                ends = (ends + np.arange(1, len(part) + 1)).tolist()
                places = marks(ids)
                of_doc = np.searchsorted(places, ends, side="right").tolist()
                places, raw, rows = places.tolist(), memoryview(ids.astype("<u4", copy=False).tobytes()), planes(ids)
                wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
                name, n, body, recipe, lists = [], [], [], [], []
                for start, end, i, j in zip([0, *ends], ends, [0, *of_doc], of_doc, strict=False):
                    names, a = [], start
                    for b in _cut(places[i:j], start, end):
                        names.append(digest := hashlib.sha256(raw[4 * a : 4 * b]).digest())
                        if digest not in sent:  # most copies end here; the shuffle finds the others
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(digest)
                            name.append(digest)
                            n.append(b - a)
                            body.append(pack(rows[:, a:b], wide and int(ids[a:b].max()) >= 1 << 16))
                        a = b
                    row += 1
                    # a recipe's name differs from all others whatever repeats in the table, and is the same when a task runs again
                    recipe.append(merkle(names) + task.to_bytes(4, "big") + row.to_bytes(8, "big"))
                    lists.append(names)
                k, c = len(name), len(recipe)
                kinds = pa.array(["chunk"] * k + ["recipe"] * c)
                own = pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(doc_ids[at : at + c], pa.int64())])
                at += c
                yield pa.RecordBatch.from_arrays([kinds, pa.array(name + recipe, pa.binary()), own, pa.array(n + np.diff(ends, prepend=0).tolist(), pa.int64()), pa.array(body + [None] * c, pa.binary()), pa.array([None] * k + lists, pa.list_(pa.binary()))], schema=SCHEMA)

    rows = docs.select("doc_id", "text").mapInArrow(run, ROW).dropDuplicates(["kind", "name"])
    rows.write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = _objects(spark, path, "recipe").select("doc_id", F.col("n").alias("n_tokens"), F.substring("name", 1, 32).alias("root"), "chunks")
    recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")
    parts = _manifest(_recipes(spark, path))
    parts.write.mode("overwrite").parquet(f"{path}/manifest")


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema("name binary, doc_id long, n long, body binary, chunks array<binary>, kind string").parquet(f"{path}/objects").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, chunks array<binary>, part int").parquet(f"{path}/recipes")


def leaf(doc_id: int | None, root: bytes) -> bytes:
    """A document's leaf in its part's tree."""
    return hashlib.sha256(b"\0" + (b"" if doc_id is None else doc_id.to_bytes(8, "big", signed=True)) + root).digest()


class Tree:
    """``merkle`` of leaves that come one by one: holds one root for each bit of their number."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, node: bytes) -> None:
        height = 0
        while self.stack and self.stack[-1][0] == height:
            node, height = hashlib.sha256(b"\1" + self.stack.pop()[1] + node).digest(), height + 1
        self.stack.append((height, node))

    def root(self) -> bytes:
        if not self.stack:
            return merkle([])
        out = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            out = hashlib.sha256(b"\1" + left + out).digest()
        return out


MANIFEST = pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("documents", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row for each part: its documents in order of doc_id and root, as counts and a Merkle root over their leaves."""
    small_batches(recipes.sparkSession)

    def run(batches):
        part, tree, row = None, Tree(), []
        for batch in filled(batches):
            done = []
            for p, doc_id, root, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    if row:
                        done.append((*row, tree.root()))
                    part, tree, row = p, Tree(), [p, None, None, 0, 0]
                tree.add(leaf(doc_id, root))
                row = [p, doc_id if row[1] is None else row[1], row[2] if doc_id is None else doc_id, row[3] + 1, row[4] + n]
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, r, strict=True)) for r in done], MANIFEST)
        if row:
            yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, (*row, tree.root()), strict=True))], MANIFEST)

    ordered = recipes.select("part", "doc_id", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "doc_id", "root")
    return ordered.mapInArrow(run, "part int, first_doc long, last_doc long, documents long, n_tokens long, root binary")


def _links(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document; ``key`` tells rows of one doc_id apart."""
    return recipes.select("doc_id", "root", "n_tokens", F.posexplode("chunks").alias("pos", "name"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the whole stream of every document (little-endian unsigned 32-bit integers)."""
    small_batches(spark)
    recipes = _recipes(spark, path).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("root")))
    chunks = _objects(spark, path, "chunk").select("name", "body")
    links = recipes.select("doc_id", "row", F.posexplode("chunks").alias("pos", "name"))
    whole = links.join(chunks, "name").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))

    def run(batches):
        for batch in filled(batches):
            ids = [b"".join(unpack(p["body"]) for p in parts) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(run, "doc_id long, ids binary")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Reads the store back: doc_id, start, n_tokens, ids_crc32, whole (digests, lengths and root agree).

    The manifest is made again from the recipes; where it differs, a recipe is lost, repeated or changed,
    so starts can't be trusted and no row is whole.

    ``start`` is the number of ids of all documents before this one in the order of the recipes.
    """
    small_batches(spark)

    def sums(batches):
        for batch in filled(batches):
            name, body = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = [unpack(b) for b in body]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).digest() == n for r, n in zip(raw, name, strict=True)], pa.bool_())], ["name", "n", "crc", "sound"])

    chunks = _objects(spark, path, "chunk").select("name", "body").mapInArrow(sums, "name binary, n long, crc long, sound boolean")
    recipes = _recipes(spark, path)
    found_parts = sorted(map(tuple, _manifest(recipes).collect()))  # a row for each file
    stated = sorted(map(tuple, spark.read.schema("part int, first_doc long, last_doc long, documents long, n_tokens long, root binary").parquet(f"{path}/manifest").collect()))
    intact = found_parts == stated
    totals = [(p[0], p[4]) for p in found_parts]
    offsets, run = [], 0
    for part, n in totals:
        offsets.append((part, run))
        run += n
    before = spark.createDataFrame(offsets, "part int, before long")
    order = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    numbered = recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("inside"))
    links = numbered.select("start", F.posexplode("chunks").alias("pos", "name"))
    found = links.join(chunks, "name").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "sound", "name"))).alias("parts"))

    def fold(batches):
        for batch in filled(batches):
            lists = batch.column(1)
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            names, ns, crcs = flat.field("name").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False).tolist(), flat.field("crc").to_numpy(zero_copy_only=False).tolist()
            sounds = flat.field("sound").to_numpy(zero_copy_only=False)
            crc, n, root, sound = [], [], [], []
            for i, j in zip(at, at[1:], strict=False):
                crc.append(crc_of_concatenation([(c, 4 * k) for c, k in zip(crcs[i:j], ns[i:j], strict=True)]))
                n.append(sum(ns[i:j]))
                root.append(merkle(names[i:j]))
                sound.append(bool(sounds[i:j].all()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.binary()), pa.array(sound, pa.bool_())], ["start", "ids_crc32", "n_read", "root_read", "sound"])

    # every stream has its end id, so start tells documents apart
    read = found.mapInArrow(fold, "start long, ids_crc32 long, n_read long, root_read binary, sound boolean")
    both = numbered.select("doc_id", "start", "n_tokens", "root").join(read, "start", "left")
    whole = F.coalesce(F.col("sound") & (F.col("n_read") == F.col("n_tokens")) & (F.col("root_read") == F.col("root")), F.lit(False)) & F.lit(intact)
    return both.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32", whole.alias("whole"))
