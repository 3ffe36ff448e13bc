"""Retrieval as users call it: search, seeds, expansion, ranking and packing composed, and what is written from it.

Selections have fixed bounds (seeds, nodes, edges, chunks), so what is broadcast or numbered in one
task is a few hundred rows at any size of the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.files import LOCK_FILES, is_noise, is_test
from lithograph.functions.scalars import TERM, base_name, digest_id, token_estimate
from lithograph.operators import graph as G
from lithograph.operators import search as R
from lithograph.operators.ordered import islands, numbered

# Bounds of a trace and of what is written from it.
SEEDS, NODES, EDGES, CHUNKS, TOKENS, SEARCHED = 12, 60, 140, 20, 8000, 32
SECTION_FILES, EXTRA_FILES, RELATIONS, FACTS = 12, 24, 80, 40


def search_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The nodes that a query finds: id, type, name, file_path, start_line, score; the best first, ties by path, line, name, id.

    A name or path that has the query, or a word of it, is a hit; the score is its place on the ladder
    of names, re-scored by what else of the query the node has.
    """
    import re

    words = list(dict.fromkeys(re.findall(TERM.replace("A-Z", ""), query.lower())))[:16]
    some = F.lit(False)
    for w in words:
        some = some | F.contains(F.lower("name"), F.lit(w)) | F.contains(F.lower("file_path"), F.lit(w))
    found = R.rescored(nodes.where(some), query, F.lit(0.5))
    return found.orderBy(F.desc("score"), "file_path", "start_line", "name", "id").limit(limit).select("id", "type", "name", "file_path", "start_line", "score")


def seeds(nodes: DataFrame, query: str, chunk_hits: DataFrame, limit: int = SEEDS) -> DataFrame:
    """id, score of the best seeds: symbols, searched nodes, and the nodes of chunk hits, the largest score of each.

    chunk_hits(node_id, file_path, score, position): a hit's node, or the file's node where it has none;
    a hit further down the list counts 0.01 less for each place, 0.25 at least. Without any seed the
    repository and the first files stand in.
    """
    kept = nodes.where(~is_noise(F.col("file_path")))
    named = R.symbol_seeds(kept.where(F.col("type").isin(R.SEED_TYPES)), query)
    found = search_nodes(kept.where(F.col("type").isin(R.SEED_TYPES)), query, SEARCHED).select("id", F.least(F.lit(1.3), F.greatest(F.lit(0.35), "score")).alias("score"))
    merged = named.unionByName(found).unionByName(seed_hits(kept, chunk_hits)).groupBy("id").agg(F.max("score").alias("score"))
    best = G.cut(merged.orderBy(F.desc("score"), "id").limit(limit))
    return overview(kept) if best.isEmpty() else best


def seed_hits(nodes: DataFrame, chunk_hits: DataFrame) -> DataFrame:
    """id, score of the nodes that chunk hits stand for, each hit once."""
    files = nodes.where("type = 'file'").groupBy("file_path").agg(F.min("id").alias("file_id"))
    rows = chunk_hits.where(~is_noise(F.col("file_path"))).join(files, "file_path", "left").withColumn("id", F.coalesce("node_id", "file_id"))
    penal = F.greatest(F.lit(0.25), F.col("score") - 0.01 * (F.col("position") - 1))
    return rows.withColumn("penal", penal).join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.max("penal").alias("score"))


def overview(nodes: DataFrame, limit: int = 6) -> DataFrame:
    """id, score: the repository (0.4) and the first files by path (0.35), ``limit`` in all."""
    root = nodes.where("type = 'repository'").orderBy("id").limit(1).select("id", F.lit(0.4).alias("score"))
    files = nodes.where("type = 'file'").orderBy("file_path", "id").limit(limit - 1).select("id", F.lit(0.35).alias("score"))
    return root.unionByName(files)


@dataclass
class Trace:
    """What a retrieval selects: nodes(id, hop, score), edges, chunks in rank order, communities."""

    query: str
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    communities: DataFrame | None = None


def chunk_hits(chunks: DataFrame, query: str, limit: int = CHUNKS) -> DataFrame:
    """The best chunks of a query by BM25 with score and position; by LIKE where no chunk has one of its terms."""
    import re

    words = list(dict.fromkeys(re.findall(TERM.replace("A-Z", ""), query.lower())))[:16]
    hits = R.by_position(R.bm25(chunks.withColumn("_text", F.concat_ws(" ", "file_path", "content")), "id", "_text", words), [F.desc("bm25"), F.col("id")], limit, 0.04)
    hits = G.cut(hits.select("id", "score", "position"))
    if hits.isEmpty():
        like = R.like_hits(chunks, query.strip().strip('"'), limit)
        hits = like.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "file_path", "start_line", "id")).alias("position"))
    return chunks.join(F.broadcast(hits), "id")


def retrieve(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, query: str, hops: int = 2, semantic: DataFrame | None = None, members: DataFrame | None = None, most: int = CHUNKS, budget: int = TOKENS, last=None) -> Trace:
    """The trace of a query.

    chunks(id, node_id, file_path, start_line, end_line, content, token_count, stamp); semantic(id,
    score): chunks by vector, if any; members(community_id, node_id). Test, generated and vendored files
    are left out. Expansion takes at most four hops. ``edges`` may be links of which ``last`` makes edges; of all of them only the
    ends are counted, edges are made where the selection has them.
    """
    query = query.strip() or "repository overview"
    kept = nodes.where(~is_noise(F.col("file_path")))
    placed, clean = nodes.select("id", "file_path"), ~is_noise(F.col("file_path"))
    hits = chunk_hits(chunks, query)
    listed = hits.select("node_id", "file_path", "score", "position")
    if semantic is not None:
        found = chunks.join(F.broadcast(semantic.orderBy(F.desc("score"), "id").limit(most)), "id")
        listed = listed.unionByName(found.select("node_id", "file_path", "score", (F.lit(CHUNKS) + F.row_number().over(Window.orderBy(F.desc("score"), "id"))).alias("position")))
    start = seeds(nodes, query, listed)
    chosen = G.expand(start, None, max(0, min(hops, 4)), NODES, lambda front: G.around(edges, front, placed, clean, last))
    related = G.related_edges(G.around(edges, chosen, placed, clean, last, True), chosen.select("id"), EDGES)

    keyword = hits.select("id", "score")
    vectors = keyword.limit(0) if semantic is None else semantic
    near = F.broadcast(chosen.select(F.col("id").alias("node_id"), "hop"))
    ids = keyword.select("id").union(vectors.select("id")).union(chunks.join(near, "node_id", "left_semi").select("id")).distinct()
    lock = F.array(*map(F.lit, LOCK_FILES))
    candidates = G.cut(chunks.join(ids, "id").where(~is_noise(F.col("file_path")) & ~F.array_contains(lock, base_name(F.col("file_path")))))
    ends = G.cut(G.end_counts(G.ends_within(edges, kept, last)))
    ranked = G.cut(R.hybrid_rank(candidates, kept, edges, chosen.select("id", "hop"), keyword, vectors, ends))
    order = [F.desc("score"), F.col("file_path"), F.col("start_line"), F.col("id")]
    packed = R.packed(ranked, "id", order, "token_count", budget, most)
    picked = ranked.join(F.broadcast(packed), "id").select("rank", *[c for c in ranked.columns])
    communities = None
    if members is not None:
        own = members.join(F.broadcast(chosen.select(F.col("id").alias("node_id"))), "node_id", "left_semi")
        communities = own.groupBy("community_id").agg(F.count("*").alias("matched")).orderBy(F.desc("matched"), "community_id").limit(12)
    return Trace(query, chosen, related, picked, communities)


def rows(trace: Trace) -> DataFrame:
    """The trace as one table: kind, id, hop, score (4 digits), place."""
    node = trace.nodes.select(F.when(F.col("hop") == 0, "seed").otherwise("expanded").alias("kind"), "id", "hop", F.bround("score", 4).alias("score"), F.lit(None).cast("int").alias("place"))
    none = F.lit(None)
    out = node.unionByName(trace.edges.select(F.lit("edge").alias("kind"), "id", none.cast("int").alias("hop"), none.cast("double").alias("score"), none.cast("int").alias("place")))
    out = out.unionByName(trace.chunks.select(F.lit("chunk").alias("kind"), "id", none.cast("int").alias("hop"), F.bround("score", 4).alias("score"), F.col("rank").alias("place")))
    if trace.communities is not None:
        out = out.unionByName(trace.communities.select(F.lit("community").alias("kind"), F.col("community_id").alias("id"), none.cast("int").alias("hop"), F.col("matched").cast("double").alias("score"), none.cast("int").alias("place")))
    return out


def _joined(df: DataFrame, order: list[str], line: Column, limit: int) -> DataFrame:
    """One row: the first ``limit`` lines in order, joined."""
    top = df.orderBy(*order).limit(limit).select(F.struct(*order).alias("k"), line.alias("line"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def context_pack(trace: Trace) -> DataFrame:
    """text, token_count, node_count, edge_count, chunk_count of a trace: chunks in rank order, then facts of the graph."""
    place = F.concat(F.lit("["), "id", F.lit("] "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), F.rtrim("content"), F.lit("\n"))
    chunks = _joined(trace.chunks, ["rank"], place, CHUNKS)
    weight = (-G.lookup(G.EDGE_WEIGHTS, F.col("type"), G.OTHER_WEIGHT)).alias("w")
    facts = trace.edges.select("*", weight)
    fact = F.concat(F.lit("- "), "source_id", F.lit(" -["), "type", F.lit("]-> "), "target_id", F.lit(" (confidence="), F.col("confidence").cast("string"), F.lit(")"))
    edges = _joined(facts, ["w", "is_inferred", "type", "source_id", "target_id"], fact, FACTS)
    text = F.trim(F.concat(F.lit(f"Query: {trace.query}\n\nSource Chunks:\n"), F.col("c.text"), F.lit("\nGraph Facts:\n"), F.col("e.text")))
    counts = trace.nodes.agg(F.count("*").alias("node_count")).crossJoin(trace.edges.agg(F.count("*").alias("edge_count"))).crossJoin(trace.chunks.agg(F.count("*").alias("chunk_count")))
    return chunks.alias("c").crossJoin(edges.alias("e")).crossJoin(counts).select(text.alias("text"), "node_count", "edge_count", "chunk_count").withColumn("token_count", token_estimate(F.col("text")))


def file_groups(nodes: DataFrame, edges: DataFrame, selected: DataFrame, entries: DataFrame) -> DataFrame:
    """file_path, score, nodes, place of the files of a selection: entries count 8, symbols 2, files 1, each edge 1; tests last."""
    own = nodes.join(selected.select("id"), "id", "left_semi").where("file_path <> '' and type not in ('repository', 'directory', 'module')")
    marked = own.join(entries.select("id", F.lit(True).alias("entry")), "id", "left")
    value = F.when(F.col("entry"), 8).when(F.col("type") != "file", 2).otherwise(1)
    groups = marked.groupBy("file_path").agg(F.sum(value).alias("score"), F.count("*").alias("nodes"))
    out = G.within(edges.where("type <> 'contains'"), selected).join(own.select(F.col("id").alias("source_id"), "file_path"), "source_id").groupBy("file_path").agg(F.count("*").alias("more"))
    scored = groups.join(out, "file_path", "left").select("file_path", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"), "nodes", is_test(F.col("file_path")).alias("test"))
    placed = numbered(scored.withColumn("minus", -F.col("score")), ["test", "minus", "file_path"], "place")
    return placed.drop("test", "minus").withColumn("place", F.col("place").cast("int"))


def explore(nodes: DataFrame, edges: DataFrame, query: str, max_files: int = SECTION_FILES, max_nodes: int = 160) -> dict[str, DataFrame]:
    """entries, selected, relationships, files, sections and additional of a query: search, three hops both ways, line ranges by file."""
    entries = G.cut(search_nodes(nodes, query, 12))
    roots = entries.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "file_path", "start_line", "name", "id")).alias("place"))
    selected = G.expand_undirected(edges, roots, 3, max_nodes)
    chosen = F.broadcast(selected.select("id"))
    relations = G.within(edges.where("type <> 'contains'"), selected.select("id")).orderBy("id").limit(RELATIONS)
    files = G.cut(file_groups(nodes, edges, selected, entries))
    shown = files.where(F.col("place") <= max(1, min(max_files, 20)))
    spans = nodes.join(chosen, "id", "left_semi").where("start_line is not null").join(F.broadcast(shown.select("file_path")), "file_path").select("file_path", "start_line", "end_line", F.col("name").alias("label"))
    extra = files.where((F.col("place") > max(1, min(max_files, 20))) & (F.col("place") <= max(1, min(max_files, 20)) + EXTRA_FILES))
    return {"entries": entries, "selected": selected, "relationships": relations, "files": files, "sections": islands(spans, "file_path"), "additional": extra}


def node_context(nodes: DataFrame, edges: DataFrame, node: DataFrame, limit: int = 20) -> DataFrame:
    """relation, id, name, file_path, start_line, end_line of a node(id): itself with its lines, its callers and its callees."""
    own = nodes.join(F.broadcast(node.select("id")), "id", "left_semi").select(F.lit("node").alias("relation"), "id", "name", "file_path", F.greatest(F.lit(1), F.col("start_line") - 3).alias("start_line"), (F.col("end_line") + 3).alias("end_line"))
    out = own
    for relation, outgoing in (("caller", False), ("callee", True)):
        near = G.neighbours(nodes, edges, node, outgoing, G.FLOW_TYPES)
        there = "target_id" if outgoing else "source_id"
        top = near.select(F.lit(relation).alias("relation"), F.col(there).alias("id"), F.col("other_name").alias("name"), F.col("other_path").alias("file_path"), "type").orderBy("id", "type").limit(limit)
        out = out.unionByName(top.drop("type").withColumn("start_line", F.lit(None).cast("int")).withColumn("end_line", F.lit(None).cast("int")))
    return out


def trace_id(repo: str, trace: Trace) -> DataFrame:
    """id of a trace: the digest of its query, its seeds in order and its chunks by rank."""
    seeds_in = trace.nodes.where("hop = 0").agg(F.array_sort(F.collect_list("id")).alias("s"))
    chunks_in = trace.chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("c"))
    return seeds_in.crossJoin(chunks_in).select(digest_id(repo, "trace", [F.lit(trace.query), F.array_join("s", "|"), F.array_join("c", "|")], 24).alias("id"))
