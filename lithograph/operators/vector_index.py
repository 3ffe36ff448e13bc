"""An inverted-file index over vectors: cells around centroids, of which a search probes the nearest few.

The centroids are fitted on the driver by spherical k-means on a bounded sample (``SAMPLE`` vectors, those
with the smallest hashes of their id); every row of the table is then assigned to its nearest centroid and
stored by cell. A search scores the rows of a cell against the queries that probe it, by products of blocks, so
what it scores is a share of the table and not all of it; ``search.nearest`` is the exact way. How many cells are probed is measured: of a
bounded set of queries the exact neighbours are found, and so many cells are taken that the asked share of
these neighbours lies in them.

Defined cases: a vector that is null, empty, zero or of another length than most of the sample is kept in
cell -1 and never found, as its cosine is not defined; an empty table gives an index without cells and no
results; repeated ids are rows of their own. Ids are whole numbers, as in ``search.nearest``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.operators.graph import cut
from lithograph.operators.search import QUERY_NUMBERS, Gathered, _dots, _vectors, nearest, placed

#: Vectors the centroids are fitted on, and cells at most; both bound what the driver holds and broadcasts.
SAMPLE, MOST_CELLS, ROUNDS, SEED = 20_000, 4_000, 10, 11
#: Queries whose exact neighbours fix the number of probed cells, and the share of neighbours asked for.
MEASURED, RECALL = 100, 0.97
#: Probes (a bit each) that a search broadcasts at once.
PROBES = 100_000_000


@dataclass
class Index:
    """``rows``: vec_id, embedding, stored by cell; ``centroids``: one unit vector a cell."""

    rows: DataFrame
    centroids: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows (float32) of the vectors of ``width`` finite numbers that are not all zero."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), width)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[fine], x[fine]


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + 2000] @ centroids.T).argmax(1) for lo in range(0, len(x), 2000)] or [np.zeros(0, np.int64)])


def fit(vectors: DataFrame, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> np.ndarray:
    """Centroids (cells, dimensions): the square root of the row count many, ``most_cells`` at most."""
    usable, key = vectors.where(F.size("embedding") > 0), F.xxhash64("vec_id")
    n = usable.count()
    first = lambda rows: rows.orderBy(key, "vec_id").select("embedding").limit(sample).toArrow().column(0).combine_chunks()
    # about one and a half times the sample lies below the bound, so that the task that sorts it gets no sample of every task
    taken = first(usable.where(key < int(2**64 * (1.5 * sample / n)) - 2**63) if n > 2 * sample else usable)
    if len(taken) < min(n, sample):  # repeated ids have one hash
        taken = first(usable)
    if not len(taken):
        return np.zeros((0, 0), np.float32)
    widths = Counter(pc.list_value_length(taken).to_pylist())
    x = _unit(_matrix(taken, max(widths, key=lambda w: (widths[w], -w)))[1])
    cells = min(round(n ** 0.5), most_cells, len(x))
    rng = np.random.default_rng(SEED)
    centroids = x[np.sort(rng.choice(len(x), cells, replace=False))]
    for _ in range(ROUNDS):
        own = _closest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = (sums != 0).any(1)
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def _order(x: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest cells of each row, the nearest first, of equal ones the first."""
    near = x @ centroids.T
    if most == 1 and not np.isnan(near).any():
        return near.argmax(1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :most]


def _ranked(vectors: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """The vectors (vec_id, embedding) with ``cells``: their ``most`` nearest cells, the nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.select("vec_id", "embedding").schema

    def run(batches):
        centroids = shared.value
        for batch in batches:
            cells: list[list[int]] = [[-1]] * batch.num_rows
            at, x = _matrix(batch.column(1), centroids.shape[1]) if len(centroids) else ([], None)
            for lo in range(0, len(at), 1000):
                near = _order(x[lo : lo + 1000], centroids, most)
                for i, found in zip(at[lo : lo + 1000].tolist(), near.tolist(), strict=True):
                    cells[i] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "embedding", "cells"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"{names}, cells array<int>")


def _probing(queries: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """The usable queries (vec_id, embedding) with ``bits``: one a cell, set in their ``most`` nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    rows = queries.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null")

    def run(batches):
        centroids = shared.value
        for batch in batches:
            at, x = _matrix(batch.column(1), centroids.shape[1])
            for lo in range(0, len(at), 1000):
                own = batch.take(pa.array(at[lo : lo + 1000]))
                bits = np.zeros((own.num_rows, len(centroids)), bool)
                np.put_along_axis(bits, _order(x[lo : lo + 1000], centroids, most), True, axis=1)
                packed = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), packed], ["vec_id", "embedding", "bits"])

    return rows.mapInArrow(run, f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, bits binary")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in tasks of neighbouring cells, as many rows in each: a cell of many copies is no single task."""
    return rows.repartitionByRange("cell", F.xxhash64("vec_id"))


def build(vectors: DataFrame, folder: str, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> Index:
    """Fits the cells, assigns every row and writes the rows below ``folder``, one directory a cell."""
    centroids = fit(vectors, sample, most_cells)
    rows = _ranked(vectors, centroids, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell"))
    _dealt(rows).write.mode("overwrite").partitionBy("cell").parquet(folder)
    return Index(vectors.sparkSession.read.schema(rows.schema).parquet(folder), centroids)


def probes(index: Index, queries: DataFrame, k: int, recall: float = RECALL, measured: int = MEASURED) -> int:
    """How many cells hold ``recall`` of the exact ``k`` neighbours of at most ``measured`` of the queries."""
    if not len(index.centroids):
        return 0
    some = queries.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(measured)
    truth = cut(nearest(index.rows, some, k))
    order = _ranked(some, index.centroids, len(index.centroids)).select(F.col("vec_id").alias("query_id"), "cells")
    cell_of = index.rows.join(F.broadcast(truth.select("vec_id").distinct()), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("cell").alias("cell"))
    both = cell_of.join(F.broadcast(truth), "vec_id").join(F.broadcast(order), "query_id")
    at = sorted(r["at"] for r in both.select(F.array_position("cells", F.col("cell")).alias("at")).collect())  # measured * k at most
    return max(1, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)])) if at else 1


def search(index: Index, queries: DataFrame, k: int, cells: int, most: int = PROBES) -> DataFrame:
    """query_id, vec_id, score, place: the k nearest rows by cosine in the ``cells`` nearest cells of each query.

    The queries are broadcast with a bit for each cell they probe, at most ``most`` probes (and QUERY_NUMBERS numbers)
    at a time, in blocks by a hash of their id; only the probed cells' directories are read. A task has the rows of some
    cells and scores each cell against the queries that probe it. Scores, ties and places are those of ``search.nearest``.
    """
    n, width = queries.count(), index.centroids.shape[1]
    blocks = max(1, -(-n * max(cells, 1) // most), -(-n * width // QUERY_NUMBERS))

    def asked(part: DataFrame) -> DataFrame:
        table = _probing(part, index.centroids, cells).toArrow()
        ids, x = _vectors(table.column(0).combine_chunks(), table.column(1)).get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
        bits = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(ids), -(-len(index.centroids) // 8))
        shared = queries.sparkSession.sparkContext.broadcast((ids, x, np.sqrt(_dots(x, x)), bits))

        def run(batches):
            *of, bits = shared.value
            best = Gathered(*of, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, (ids, x) = batch.column(2).to_numpy(), _vectors(batch.column(0), batch.column(1))[width]
                for cell in np.unique(own).tolist():
                    at = own == cell
                    best.see(ids[at], x[at], np.flatnonzero(bits[:, cell >> 3] >> (7 - (cell & 7)) & 1))
            yield from best.batches()

        probed = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))).tolist()
        rows = index.rows.where(F.col("cell").isin(probed) & F.col("vec_id").isNotNull())
        near = _dealt(rows.select(F.col("vec_id").cast("long"), "embedding", "cell")).sortWithinPartitions("cell")
        return placed(near.mapInArrow(run, "query_id long, vec_id long, cos double"), k)

    if not width:  # an index without cells finds nothing
        return placed(queries.sparkSession.createDataFrame([], "query_id long, vec_id long, cos double"), k)
    if blocks == 1:
        return asked(queries)
    out = None
    for b in range(blocks):
        found = cut(asked(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)))
        out = found if out is None else out.unionByName(found)
    return out
