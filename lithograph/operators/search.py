"""Text and vector retrieval: inverted index, BM25, ladders of scores, k nearest neighbours, hybrid ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.scalars import TERM, query_terms, terms
from lithograph.operators.graph import cut, degree_centrality, lookup

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# What a node's type adds to its search score and to its score as a seed, the types of seeds,
# and the weights of the hybrid ranking.
TYPE_BOOST = {"endpoint": 0.35, "function": 0.3, "method": 0.3, "class": 0.28, "interface": 0.25, "schema": 0.22, "file": 0.1, "module": -0.15}
SEED_BOOST = {"endpoint": 0.12, "function": 0.1, "method": 0.1, "class": 0.08, "schema": 0.08, "file": 0.04, "module": -0.1}
SEED_TYPES = ["file", "config", "class", "function", "method", "schema", "endpoint", "module"]
HYBRID = {"semantic": 0.35, "keyword": 0.25, "proximity": 0.20, "importance": 0.10, "freshness": 0.10}


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf: the inverted index; partial counts are made before anything is shuffled."""
    rows = chunks.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"))


def index_size(index: DataFrame) -> DataFrame:
    """id, doc_len of the chunks of an index."""
    return index.groupBy("id").agg(F.sum("tf").alias("doc_len"))


def _idf(docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)); a term that more than half of the texts have counts next to nothing."""
    value = F.log((docs - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def _bm25_part(idf: Column, tf: Column, doc_len: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean))


def bm25(chunks: DataFrame, id_col: str, text_col: str, query: list[str]) -> DataFrame:
    """id, bm25: the score of every chunk that has one of the query's terms.

    One pass over the texts keeps the length of each and how often it has the asked terms, a few numbers
    a row, which are written once; statistics and scores are taken from these.
    """
    asked = list(dict.fromkeys(query))
    equal = lambda q: lambda x: x == q
    # the array of terms is made once a row: what stands inside the transform is not copied to where it is used
    kept = lambda t: F.struct(F.size(t).alias("doc_len"), F.filter(t, lambda x: x.isin(asked)).alias("t"))
    rows = chunks.select(F.col(id_col).alias("id"), F.get(F.transform(F.array(terms(F.col(text_col))), kept), F.lit(0)).alias("x"))
    rows = cut(rows.select("id", "x.doc_len", *[F.size(F.filter("x.t", equal(q))).alias(f"tf{i}") for i, q in enumerate(asked)]))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("doc_len").alias("mean_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    hits = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(asked))) or "false").crossJoin(F.broadcast(stats))
    parts = [F.when(F.col(f"tf{i}") > 0, _bm25_part(_idf(F.col("docs"), F.col(f"df{i}")), F.col(f"tf{i}"), F.col("doc_len"), F.col("mean_len"))).otherwise(0.0) for i in range(len(asked))]
    return hits.select("id", sum(parts, F.lit(0.0)).alias("bm25"))


def like_hits(chunks: DataFrame, text: str, limit: int) -> DataFrame:
    """Chunks whose path or content has a text: id, score (0.8 for the path, else 0.5), the first by score, path and line."""
    in_path, inside = literal_like(F.col("file_path"), text), literal_like(F.col("content"), text)
    found = chunks.where(in_path | inside).withColumn("score", F.when(in_path, 0.8).otherwise(0.5))
    return found.orderBy(F.desc("score"), "file_path", "start_line", "id").limit(limit)


def all_terms(rows: DataFrame, text_col: str, query: list[str]) -> DataFrame:
    """The rows whose text has every term of the query (what a query without operators asks of a text index)."""
    asked = F.array(*map(F.lit, dict.fromkeys(query)))
    return rows.where(F.size(F.array_except(asked, terms(F.col(text_col)))) == 0)


def by_position(hits: DataFrame, order: list[Column], limit: int, step: float, least: float = 0.1) -> DataFrame:
    """The first ``limit`` hits with a score that falls by ``step`` a place: top-k before the window, so it sees k rows."""
    top = hits.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("position", place).withColumn("score", F.round(F.greatest(F.lit(least), 1 - step * (F.col("position") - 1)), 4))


def first_of(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of frames with one row a key: that of the first frame which has it (a key counts once a frame)."""
    out = None
    for i, df in enumerate(frames):
        part = df.select(key, F.struct(F.lit(i).alias("_at"), *[c for c in df.columns if c != key]).alias("_row"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("_row").alias("_row")).select(key, "_row.*").drop("_at")


def literal_like(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def node_ladder(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """LIKE search: exact name, name's beginning, name, path, id ladder of ranks."""
    q = query.lower()
    name, path = F.lower("name"), F.lower("file_path")
    rank = F.when(name == q, 1.0).when(F.startswith(name, F.lit(q)), 0.85).when(F.contains(name, F.lit(q)), 0.72).when(F.contains(path, F.lit(q)), 0.62).when(F.contains(F.lower("id"), F.lit(q)), 0.55)
    found = nodes.withColumn("rank", rank).where("rank is not null")
    return found.orderBy(F.desc("rank"), F.length("name"), "file_path", "id").limit(limit)


def rescored(nodes: DataFrame, query: str, base: Column) -> DataFrame:
    """The rows with ``score``: a hit's base, what its name and path add, and its type's boost."""
    import re

    q = query.lower()
    words = re.findall(TERM.replace("A-Z", ""), q)
    name = F.lower("name")
    add = F.when((name == q.replace(" ", "")) | (name == q), 2.0).when(name.isin(words) if words else F.lit(False), 1.4).when(F.startswith(name, F.lit(q)), 0.9).when(F.contains(name, F.lit(q)), 0.6).otherwise(0.0)
    in_path = F.lit(False)
    for w in words:
        in_path = in_path | F.contains(F.lower("file_path"), F.lit(w))
    return nodes.withColumn("score", F.round(base + add + F.when(in_path, 0.25).otherwise(0.0) + lookup(TYPE_BOOST, F.col("type"), 0.0), 4))


def symbol_seeds(nodes: DataFrame, query: str) -> DataFrame:
    """id, score of the nodes that a query's words point to."""
    q = query.lower()
    name = F.lower("name")
    asked = query_terms(F.lit(q), 1 << 20)
    hay = F.lower(F.concat_ws(" ", "name", "type", "file_path", "language", "id"))
    direct = F.when(name == q, 1.15).when(F.array_contains(asked, name), 1.05).when(F.contains(hay, F.lit(q)), 0.88).when((name != "") & F.contains(F.lit(q), name), 0.82).otherwise(0.0)
    shared = F.size(F.array_intersect(asked, F.array_distinct(terms(F.col("name")))))
    score = F.greatest(direct, F.when(shared > 0, 0.55 + 0.12 * shared).otherwise(0.0))
    score = F.when(score > 0, score).when(F.exists(asked, lambda t: F.contains(hay, t)), 0.42).otherwise(0.0)
    out = nodes.withColumn("raw", score).where("raw > 0")
    return out.select("id", F.round(F.least(F.col("raw") + lookup(SEED_BOOST, F.col("type"), 0.0), F.lit(1.25)), 4).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Numbers of query vectors that are broadcast at once, scores held at once, and what rounding to 6 digits can hide.
QUERY_NUMBERS, SCORES, MARGIN = 4_000_000, 2_000_000, 2e-6


def _vectors(ids, column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of the vectors by their length; without an id, null, empty or with a null in it they are nowhere near."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    keep = pc.and_(ids.is_valid(), column.is_valid()).to_numpy(zero_copy_only=False)
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(length[keep & (length > 0)]).tolist():
        at = pa.array(np.flatnonzero(keep & (length == n)))
        flat = column.take(at).flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(1)
        out[n] = ids.take(at).to_numpy(zero_copy_only=False)[whole].astype(np.int64), x[whole]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the left as ``dot`` does."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _best(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of rows(q, twin, id, cos) may be among a query's k best, with queries and their k-th cosines.

    Of the same vector only the k smallest ids count; what lies within MARGIN of the k-th may be a tie.
    """
    cos = np.where(np.isnan(rows["cos"]), np.inf, rows["cos"])
    place = lambda *keys: np.arange(len(rows)) - np.maximum.accumulate(np.where(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)], np.arange(len(rows)), 0))
    order = np.lexsort((rows["id"], rows["twin"], rows["q"]))
    rows, cos = rows[order], cos[order]
    kept = place(rows["q"], rows["twin"]) < k
    rows, cos = rows[kept], cos[kept]
    order = np.lexsort((-cos, rows["q"]))
    rows, cos = rows[order], cos[order]
    last = place(rows["q"]) == k - 1
    bound = np.full(int(rows["q"].max()) + 1 if len(rows) else 0, -np.inf)
    bound[rows["q"][last]] = cos[last]
    return rows[~(cos < bound[rows["q"]] - MARGIN)], rows["q"][last], cos[last]


#: What a task holds of a pair: place of the query, hash of the vector, its id, cosine.
PAIR = [("q", "<i8"), ("twin", "<i8"), ("id", "<i8"), ("cos", "<f8")]


class Gathered:
    """What may be among the ``k`` best of each query, of the rows seen so far; all vectors have one length.

    Rows are scored by products of blocks, SCORES at once. The few that a query's bound lets through get cosines made
    in the order of ``dot``; they are sorted in when they have become as many as those held.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, size: np.ndarray, k: int):
        self.ids, self.x, self.size, self.k = ids, x, size, k
        self.held, self.new, self.waiting = np.zeros(0, PAIR), [], 0
        self.bounds = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> None:
        """Takes rows in, for the queries at these places (all without them)."""
        at = np.arange(len(self.ids)) if at is None else at
        if not len(at):
            return
        own, y, size = (self.ids, self.x, self.size) if len(at) == len(self.ids) else (self.ids[at], self.x[at], self.size[at])
        norm = np.sqrt(_dots(x, x))
        twins = np.array([hash(r.tobytes()) for r in x], np.int64)
        step = max(1, SCORES // len(own))
        for lo in range(0, len(x), step):
            part_x, part_ids, part_norm = x[lo : lo + step], ids[lo : lo + step], norm[lo : lo + step]
            with np.errstate(all="ignore"):
                near = (y @ part_x.T) / (size[:, None] * part_norm[None, :])
            near[size == 0] = -1.0
            near[:, part_norm == 0] = -1.0
            for j in np.flatnonzero(np.isin(part_ids, own)).tolist():
                near[own == part_ids[j], j] = -1.0
            least = np.maximum(self.bounds[at] - MARGIN, 4e-7)
            fine = ~(near < least[:, None])
            many = np.flatnonzero(fine.sum(1) > self.k)
            if len(many):  # what these rows alone reach
                reached = np.partition(near[many], -self.k, axis=1)[:, -self.k]
                least = np.maximum(least[many], np.where(np.isnan(reached), np.inf, reached) - MARGIN)
                fine[many] = ~(near[many] < least[:, None])
            at_q, at_x = np.nonzero(fine)
            if not len(at_q):
                continue
            new = np.zeros(len(at_q), PAIR)
            new["q"], new["twin"], new["id"] = at[at_q], twins[lo : lo + step][at_x], part_ids[at_x]
            for i in range(0, len(at_q), 20_000):
                a, b = at_q[i : i + 20_000], at_x[i : i + 20_000]
                with np.errstate(all="ignore"):
                    new["cos"][i : i + 20_000] = _dots(part_x[b], y[a]) / (part_norm[b] * size[a])
            self.new.append(new)
            self.waiting += len(new)
            if self.waiting >= max(1000, len(self.held)):
                self._sort_in()

    def _sort_in(self) -> None:
        if self.new:
            self.held, found, value = _best(np.concatenate([self.held, *self.new]), self.k)
            self.bounds[found] = value
            self.new, self.waiting = [], 0

    def batches(self):
        """query_id, vec_id, cos of all that is held."""
        self._sort_in()
        for lo in range(0, len(self.held), 100_000):
            some = self.held[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[some["q"]]), pa.array(some["id"]), pa.array(some["cos"])], ["query_id", "vec_id", "cos"])


def placed(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, place: the k best of the pairs (query_id, vec_id, cos) of each query."""
    scored = pairs.select("query_id", "vec_id", F.round(F.greatest(F.lit(0.0), "cos"), 6).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """query_id, vec_id, score, place: the k nearest vectors by cosine of every query (a stated set of queries).

    All pairs are scored, by products of blocks in Arrow maps; queries are broadcast at most ``most`` (and
    QUERY_NUMBERS numbers) at a time, more are asked in blocks by a hash of their id, one after the other,
    each block's best written to the checkpoint folder. A task keeps what may be among a query's best k (``Gathered``);
    places are given after the shuffle.
    """
    n, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = -(-n // max(1, min(most, QUERY_NUMBERS // max(width or 1, 1))))

    def asked(part: DataFrame) -> DataFrame:
        table = part.select("vec_id", "embedding").toArrow()
        q = {w: (i, x, np.sqrt(_dots(x, x))) for w, (i, x) in _vectors(table.column(0).combine_chunks(), table.column(1)).items()}
        shared = vectors.sparkSession.sparkContext.broadcast(q)

        def run(batches):
            found = {w: Gathered(*of, k) for w, of in shared.value.items()}
            for batch in batches:
                for w, (ids, x) in _vectors(batch.column(0), batch.column(1)).items():
                    if w in found:
                        found[w].see(ids, x)
            for best in found.values():
                yield from best.batches()

        return placed(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, cos double"), k)

    if blocks <= 1:
        return asked(queries)
    out = None
    for b in range(blocks):
        found = cut(asked(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)))
        out = found if out is None else out.unionByName(found)
    return out


def proximity(hops: Column) -> Column:
    return F.when(hops.isNull(), 0.0).otherwise(1 / (hops + 1))


def freshness(rows: DataFrame, stamp: str) -> DataFrame:
    """The rows with ``freshness``: min-max of a time; all equal gives 1, none 0."""
    ends = rows.agg(F.min(stamp).alias("_lo"), F.max(stamp).alias("_hi"))
    value = F.when(F.col(stamp).isNull(), 0.0).when(F.col("_lo") == F.col("_hi"), 1.0).otherwise((F.col(stamp) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.crossJoin(F.broadcast(ends)).withColumn("freshness", value).drop("_lo", "_hi")


def hybrid_rank(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, hops: DataFrame, keyword: DataFrame, semantic: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Chunks (id, node_id, file_path, start_line, stamp) with the five components and their weighted sum. ``ends``: the edges' `end_counts`, if they are known."""
    best = lambda df, n: df.groupBy("id").agg(F.max(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias(n))
    rows = chunks.join(best(semantic, "semantic"), "id", "left").join(best(keyword, "keyword"), "id", "left")
    central = degree_centrality(nodes, edges, ends).select(F.col("id").alias("node_id"), F.col("centrality").alias("importance"))
    rows = rows.join(central, "node_id", "left").join(hops.select(F.col("id").alias("node_id"), "hop"), "node_id", "left")
    rows = freshness(rows.withColumn("proximity", proximity(F.col("hop"))).fillna(0.0, ["semantic", "keyword", "importance"]), "stamp")
    total = sum((F.lit(w) * F.col(c) for c, w in HYBRID.items()), F.lit(0.0))
    return rows.withColumn("score", total).orderBy(F.desc("score"), "file_path", "start_line")


def packed(rows: DataFrame, key: str, order: list[Column], tokens: str, budget: int, most: int, page: int = 200) -> DataFrame:
    """rank, key: greedy packing in rank order; rows that overflow the budget are skipped, ``most`` are taken.

    Exact over all rows: a row that was skipped once can never fit later, so each round asks for the
    first ``page`` rows that still fit (a top-k), packs them, and goes on until nothing fits.
    """
    taken: list = []
    left = budget
    while len(taken) < most and left > 0:
        fits = rows.where(F.col(tokens) <= left)
        if taken:
            fits = fits.where(~F.col(key).isin(taken))
        top = fits.orderBy(*order).limit(page).select(F.col(key).alias("k"), F.col(tokens).alias("n")).collect()
        if not top:
            break
        for r in top:
            if len(taken) < most and r["n"] <= left:
                taken.append(r["k"])
                left -= r["n"]
    kind = dict(rows.dtypes)[key]
    return rows.sparkSession.createDataFrame(list(enumerate(taken, 1)), f"rank int, {key} {kind}")
