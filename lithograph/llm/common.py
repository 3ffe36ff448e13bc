"""What the operators of this subpackage share: tables, shared folders, splits and Arrow plumbing.

Conventions that hold for every operator here:

* a null text counts as the empty text, and every input row gives exactly one output row;
* operators pick their columns by name first, so extra columns with any name cannot clash;
* Python stages run through ``mapInArrow`` over small record batches (``ARROW_ROWS`` rows), so a
  worker holds one batch and bounded caches whatever the table's size, and a lost executor only
  repeats its own tasks;
* tables that cut lineage are written below ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a training sample, which is held on the driver, takes at most: bytes of one text, and of all. All texts are scored.
SAMPLE_TEXT, SAMPLE_BYTES = 200_000, 48_000_000
#: Rows of a record batch that a Python worker gets at once.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches; the settings are read when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local master, which has one machine, may leave it unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lithograph-checkpoint-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lithograph-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again with the same schema: cuts lineage, survives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this subpackage through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_crc(column: str = "doc_id"):
    """crc32 of an id as text, as a long column; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Each text as a string; a null is the empty text, malformed bytes become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in text_bytes(batch, name)]


def by_bytes(rows: list[bytes], limit: int = 4_000_000, costs: Iterable[int] | None = None) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of about ``limit`` bytes (or ``costs``), so that scratch arrays stay small."""
    start = total = 0
    for i, cost in enumerate(map(len, rows) if costs is None else costs):
        total += cost
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


def seg_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each segment; empty segments give 0."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return run[ends] - run[starts]


def lengths(rows: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((len(x) for x in rows), np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> list:
    """At most ``rows`` labelled training rows as a list of (text, label), the same at every run.

    ``keep`` is a column that holds the training rows. Documents are taken in the order of a hash of
    doc_id, so the sample does not follow the order of the files, while they fit in SAMPLE_BYTES; texts
    of more than SAMPLE_TEXT bytes are left out. A doc_id counts once: labels by the largest, texts by
    the smallest hash. The bounds are documented parameters of each classifier.
    """
    marks = labels.where(keep & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT).withColumn("hash", F.xxhash64("text"))
    # sizes first: what is collected below has a known bound, however often a doc_id repeats
    sizes = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("hash", F.octet_length("text").alias("size"))).alias("x"))
    taken, left = [], SAMPLE_BYTES
    for r in sizes.select("doc_id", "label", "x.hash", "x.size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # ``rows`` at most
        if r["size"] <= left:
            taken.append((r["doc_id"], r["hash"], int(r["label"])))
            left -= r["size"]
    if not taken:
        return []
    kind = dict(docs.dtypes)["doc_id"]
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, hash long, label int")
    found = own.join(F.broadcast(wanted), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: (r["doc_id"], r["text"]))]


def word_ids(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of many rows as numbers: the number and the row of each word, and the words by number."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.fromiter((number[w] for ws in rows for w in ws), np.int64, int(counts.sum()))
    return ids, np.repeat(np.arange(len(rows)), counts), list(number)
