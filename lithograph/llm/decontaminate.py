"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1).

A test item is short and a document may be a thousand times longer, so the Jaccard similarity of the
two says nothing; what counts is the containment of the item's shingles in the document. Items are
partitioned by their number of shingles (classes double). Each class has its own number of MinHash
permutations and its own limit: an item's sketch is, for each permutation, the shingle with the
smallest value; the share of permutations whose shingle occurs in a document estimates containment,
since the smallest of the item's shingles is a uniform draw from them. A class asks for as many hits
as a containment of ``CONTAINMENT`` misses with probability ``MISS`` at most, and skips documents too
small to contain its items. Documents are hashed once, whole; a bit table of the sketches turns away
nearly all shingles in one lookup. Candidates are verified by exact containment on shingle strings.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Shingles are ``SHINGLE``
words; an item with fewer words has one shingle, all its words, and is looked up by that length.

Scale: a map over documents without shuffle. The items are read in blocks of at most ``BLOCK_BYTES`` of
text. An index holds its items' texts and, for each, at most ``PERMUTATIONS`` hashes in flat arrays, so
what is broadcast has a fixed bound, some two to three times a block. Of several blocks only one is
broadcast at a time: each pass is written to the shared folder before the next block is read.

Defined cases: null or wordless documents and items match nothing; repeated rows each give their
pairs; items that repeat under one item_id are one item each; an item without item_id is none, as nothing
could name it; empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import filled, shared_dir, small_batches, texts, written

SHINGLE, CONTAINMENT, MISS, PERMUTATIONS, SEED = 5, 0.8, 1e-9, 48, 42
BLOCK_BYTES = 16 << 20
TABLE_BITS, RECENT = 22, 200

#: ASCII letters and digits stay, other ASCII bytes separate words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def shingles(ws: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, joined by a space."""
    if len(ws) < size:
        return []
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(ws) - size + 1].tolist()
    return [joined[i:j] for i, j in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def hits_needed(permutations: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """The most hits that a document of this containment reaches but with probability ``miss``."""
    total = 0.0
    for m in range(permutations + 1):
        total += math.comb(permutations, m) * containment**m * (1 - containment) ** (permutations - m)
        if total > miss:
            return max(1, m)
    return permutations


@dataclass
class Index:
    """Sketches of a block of items, by the words of a shingle."""

    items: list[tuple[int, int, str]] = field(default_factory=list)  # item_id, words in a shingle, text
    needed: list[int] = field(default_factory=list)
    least: list[float] = field(default_factory=list)  # shingles that a document must have
    #: By the words of a shingle: hashes in order, and the item and the number of permutations of each.
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    table: dict[int, np.ndarray] = field(default_factory=dict)
    recent: dict[int, frozenset] = field(default_factory=dict)  # shingles of the items that were verified last

    def shingles(self, n: int) -> frozenset:
        """The shingles of an item; those of ``RECENT`` items are kept."""
        own = self.recent.pop(n, None)
        if own is None:
            _, size, text = self.items[n]
            own = frozenset(shingles(words(text), size))
            if len(self.recent) >= RECENT:
                self.recent.pop(next(iter(self.recent)))
        self.recent[n] = own
        return own


def build(rows: list[tuple[int, str]]) -> Index:
    """Index of (item_id, text) rows."""
    index = Index()
    rng = np.random.default_rng(SEED)
    factor = rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    found: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
    for item_id, text in sorted(rows):
        ws = words(text)
        if not ws:
            continue
        size = min(SHINGLE, len(ws))
        hashes = np.array(sorted(xxhash.xxh64_intdigest(s, SEED) for s in set(shingles(ws, size))), np.uint64)
        size_class = len(hashes).bit_length()  # shingles in [2^(c-1), 2^c)
        k = min(PERMUTATIONS, 16 * size_class)
        step = max(1, (1 << 20) // k)  # of a long item a part at a time
        best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        lowest = np.zeros(k, np.uint64)
        for at in range(0, len(hashes), step):
            some = hashes[at : at + step]
            values = some[None, :] * factor[:k, None] + offset[:k, None]
            place = values.argmin(1)
            value = values[np.arange(k), place]
            lowest, best = np.where((value < best) | (at == 0), some[place], lowest), np.minimum(best, value)
        n = len(index.items)
        index.items.append((item_id, size, text))
        index.needed.append(hits_needed(k))
        index.least.append(CONTAINMENT * (1 << size_class - 1))
        own, times = np.unique(lowest, return_counts=True)
        found[size].append((own, n, times))
    for size, parts in found.items():
        h = np.concatenate([x for x, _, _ in parts])
        n = np.concatenate([np.full(len(x), i, np.int32) for x, i, _ in parts])
        times = np.concatenate([t for _, _, t in parts]).astype(np.uint8)
        order = np.argsort(h, kind="stable")
        index.postings[size] = (h[order], n[order], times[order])
        table = np.zeros(1 << TABLE_BITS, bool)
        table[h >> np.uint64(64 - TABLE_BITS)] = True
        index.table[size] = table
    return index


def matches(index: Index, text: str) -> list[tuple[int, float]]:
    """(item_id, containment) of the items that a text contains."""
    ws = words(text)
    out: list[tuple[int, float]] = []
    h = xxhash.xxh64_intdigest
    for size, posting in index.postings.items():
        own = shingles(ws, size)
        if not own:
            continue
        hashes = np.array([h(s, SEED) for s in own], np.uint64)
        some = hashes[index.table[size][hashes >> np.uint64(64 - TABLE_BITS)]]
        if not len(some):
            continue
        known, item, times = posting
        some = np.unique(some)
        lo, hi = np.searchsorted(known, some, "left"), np.searchsorted(known, some, "right")
        counts: dict[int, int] = defaultdict(int)
        for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
            for n, c in zip(item[i:j].tolist(), times[i:j].tolist(), strict=True):
                counts[n] += c
        candidates = [n for n, c in counts.items() if c >= index.needed[n] and len(own) >= index.least[n]]
        if candidates:
            there = set(own)
            for n in candidates:
                shingled = index.shingles(n)
                found = len(shingled & there) / len(shingled)
                if found >= CONTAINMENT:
                    out.append((index.items[n][0], found))
    return out


def blocks(items: DataFrame, limit: int = BLOCK_BYTES):
    """The items as lists of (item_id, text) of at most ``limit`` bytes (or one item), one at a time on the driver."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def _passes(items: DataFrame, limit: int, one):
    """one(index, whether another block follows) for each block; its broadcast goes before the next block's."""
    spark = items.sparkSession
    rest = blocks(items, limit)
    block, out = next(rest), None
    while block is not None:
        after = next(rest, None)
        model = spark.sparkContext.broadcast(build(block))
        out = one(out, model, after is not None)
        if after is not None:
            model.destroy()
        block = after
    return out


def contaminated(docs: DataFrame, items: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, containment: every test item that a document contains to CONTAINMENT or more."""
    spark = docs.sparkSession
    small_batches(spark)

    def one(out: DataFrame | None, model, more: bool) -> DataFrame:
        def run(batches):
            index = model.value
            for batch in filled(batches):
                found = [(d, i, c) for d, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for i, c in matches(index, t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, containment double")
        part = written(part, shared_dir(spark)) if more else part
        return part if out is None else out.unionByName(part)

    return _passes(items, limit, one)


def clean(docs: DataFrame, items: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no test item; all columns as they came."""
    spark = docs.sparkSession
    small_batches(spark)

    def one(out: DataFrame | None, model, more: bool) -> DataFrame:
        def run(batches):
            index = model.value
            for batch in filled(batches):
                keep = [not matches(index, t) for t in texts(batch)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], schema=batch.schema)

        part = (docs if out is None else out).mapInArrow(run, docs.schema)
        return written(part, shared_dir(spark)) if more else part

    return _passes(items, limit, one)


#: DuckDB: exact containment of every item in every document.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS ws FROM documents),
i AS (SELECT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS ws FROM benchmark),
k AS (SELECT *, least(5, len(ws)) AS size FROM i WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, text, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda p: array_to_string(ws[p:p + size - 1], ' '))) AS s FROM k),
n AS (SELECT item_id, text, size, count(*) AS n FROM q GROUP BY ALL),
z AS (SELECT DISTINCT size FROM k),
x AS (SELECT DISTINCT doc_id, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda p: array_to_string(ws[p:p + size - 1], ' '))) AS s FROM w, z WHERE len(ws) >= size)
SELECT x.doc_id, q.item_id, count(*) / n.n AS containment
FROM x JOIN q ON x.s = q.s AND x.size = q.size JOIN n ON n.item_id = q.item_id AND n.text = q.text
GROUP BY x.doc_id, q.item_id, q.text, n.n HAVING count(*) / n.n >= 0.8
"""
