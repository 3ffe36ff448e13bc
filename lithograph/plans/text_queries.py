"""Queries on text: search, ranking, vectors, chunks, scalar functions, ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions import files as P
from lithograph.functions import scalars as S
from lithograph.operators import graph as G
from lithograph.operators import ingest as I
from lithograph.operators import ordered as O
from lithograph.operators import phrases
from lithograph.operators import ranges as RG
from lithograph.operators import search as R
from lithograph.operators import tables as T
from lithograph.plans.registry import query, shared_folder

TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*|[0-9]+')"
QUERY = ["the", "and", "token"]


def chunks(m):
    return m.documents.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"))


INDEX = f", p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL)"
#: By the definition of the text index that is matched: inverse document frequency ln((N - n + 0.5) / (n + 0.5)), at least a millionth.
BM25 = f", d AS (SELECT doc_id, {TERMS} AS t FROM documents), s0 AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d), h AS (SELECT doc_id, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (VALUES ('the'), ('and'), ('token')) q(term)), f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM h GROUP BY term), s AS (SELECT h.doc_id, sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25 FROM h JOIN f USING (term), s0 WHERE tf > 0 GROUP BY h.doc_id)"


@query("flt_07_chunk_bm25", "WITH x AS (SELECT 1)" + BM25 + " SELECT CAST(doc_id AS STRING) AS id, round(bm25, 6) AS bm25 FROM s")
def _(m):
    return R.bm25(chunks(m), "id", "content", QUERY).select("id", F.round("bm25", 6).alias("bm25"))


@query("win_01_rank_position_scores", "WITH x AS (SELECT 1)" + BM25 + " SELECT id, position, CAST(round(greatest(0.1, 1 - 0.04 * (position - 1)), 4) AS DOUBLE) AS score FROM (SELECT CAST(doc_id AS STRING) AS id, row_number() OVER (ORDER BY round(bm25, 9) DESC, CAST(doc_id AS STRING)) AS position FROM s) WHERE position <= 20")
def _(m):
    hits = R.bm25(chunks(m), "id", "content", QUERY).withColumn("bm25", F.round("bm25", 9))
    return R.by_position(hits, [F.desc("bm25"), F.col("id")], 20, 0.04).select("id", "position", F.col("score"))


@query("idx_postings_statistics", "WITH x AS (SELECT 1)" + INDEX + " SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(n) AS BIGINT) AS occurrences, max(df) AS most FROM (SELECT term, count(*) AS df, sum(tf) AS n FROM p GROUP BY term)")
def _(m):
    by_term = R.postings(chunks(m), "id", "content").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    return by_term.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("n").alias("occurrences"), F.max("df").alias("most"))


@query("flt_02_prefix_search", f"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) WHERE term LIKE 'th%' OR term LIKE 'ch%' GROUP BY doc_id")
def _(m):
    index = R.postings(chunks(m), "id", "content").where("term like 'th%' or term like 'ch%'")
    return index.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.sum("tf").alias("hits"))


@query(
    "flt_03_like_ladder",
    ", r AS (SELECT *, CASE WHEN lower(name) = 'order_12' THEN 1.0 WHEN starts_with(lower(name), 'order_12') THEN 0.85 WHEN contains(lower(name), 'order_12') THEN 0.72 WHEN contains(lower(file_path), 'order_12') THEN 0.62 WHEN contains(lower(id), 'order_12') THEN 0.55 END AS rank FROM g_nodes) SELECT id, name, CAST(rank AS DOUBLE) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank DESC, length(name), file_path, id LIMIT 50",
    "g_nodes",
)
def _(m):
    return R.node_ladder(m.nodes, "order_12", 50).select("id", "name", "rank")


@query(
    "flt_06_rescore",
    ", r AS (SELECT id, 0.5 + CASE WHEN lower(name) = 'customer7 app' OR lower(name) = 'customer7app' THEN 2.0 WHEN lower(name) IN ('customer7', 'app') THEN 1.4 WHEN starts_with(lower(name), 'customer7 app') THEN 0.9 WHEN contains(lower(name), 'customer7 app') THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(file_path), 'customer7') OR contains(lower(file_path), 'app') THEN 0.25 ELSE 0 END + CASE type WHEN 'endpoint' THEN 0.35 WHEN 'function' THEN 0.3 WHEN 'method' THEN 0.3 WHEN 'class' THEN 0.28 WHEN 'interface' THEN 0.25 WHEN 'schema' THEN 0.22 WHEN 'file' THEN 0.1 WHEN 'module' THEN -0.15 ELSE 0 END AS score FROM g_nodes) SELECT id, round(CAST(score AS DOUBLE), 4) AS score FROM r",
    "g_nodes",
)
def _(m):
    return R.rescored(m.nodes, "Customer7 app", F.lit(0.5)).select("id", "score")


@query(
    "flt_01_node_search",
    ", r AS (SELECT id, type, file_path, start_line, name, 0.5 + CASE WHEN lower(name) = 'customer7' THEN 2.0 WHEN starts_with(lower(name), 'customer7') THEN 0.9 WHEN contains(lower(name), 'customer7') THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(file_path), 'customer7') THEN 0.25 ELSE 0 END + CASE type WHEN 'class' THEN 0.28 WHEN 'interface' THEN 0.25 ELSE 0 END AS score FROM g_nodes WHERE type IN ('class', 'interface') AND language = 'typescript' AND (contains(lower(file_path), 'src/n1') OR contains(lower(file_path), 'customer_2'))) SELECT id, name, round(CAST(score AS DOUBLE), 4) AS score FROM r ORDER BY r.score DESC, file_path, start_line, name, id LIMIT 30",
    "g_nodes",
)
def _(m):
    wanted = F.exists(F.array(F.lit("src/n1"), F.lit("customer_2")), lambda p: F.contains(F.lower("file_path"), p))
    found = m.nodes.where(F.col("type").isin("class", "interface") & (F.col("language") == "typescript") & wanted)
    return R.rescored(found, "customer7", F.lit(0.5)).orderBy(F.desc("score"), "file_path", "start_line", "name", "id").limit(30).select("id", "name", "score")


@query("flt_05_filter_scan", "SELECT id, type, name, CAST(0.5 AS DOUBLE) AS score FROM g_nodes WHERE type = 'schema' ORDER BY type, file_path, start_line, name, id LIMIT 40", "g_nodes")
def _(m):
    return m.nodes.where("type = 'schema'").orderBy("type", "file_path", "start_line", "name", "id").limit(40).select("id", "type", "name", F.lit(0.5).alias("score"))


@query(
    "flt_10_query_terms",
    f"SELECT conv_id, turn, array_to_string(list_distinct_first, ' ') AS terms FROM (SELECT conv_id, turn, list_transform(list_filter(list_transform(range(1, len(t) + 1), lambda i: {{'i': i, 't': t[i]}}), lambda x: list_position(t, x.t) = x.i), lambda x: x.t)[1:16] AS list_distinct_first FROM (SELECT conv_id, turn, {TERMS} AS t FROM conversations)) q",
)
def _(m):
    return m.conversations.select("conv_id", "turn", F.array_join(S.query_terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


@query(
    "flt_11_symbol_seeds",
    """, r AS (SELECT id, type, lower(name) AS n, lower(concat_ws(' ', name, type, file_path, language, id)) AS hay, len(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z_][a-z0-9_]*|[0-9]+'), lambda w: w IN ('order_77', 'brand', 'customer7')))) AS shared FROM g_nodes),
s AS (SELECT id, type, hay, greatest(CASE WHEN n = 'order_77 brand customer7' THEN 1.15 WHEN n IN ('order_77', 'brand', 'customer7') THEN 1.05 WHEN contains(hay, 'order_77 brand customer7') THEN 0.88 WHEN n <> '' AND contains('order_77 brand customer7', n) THEN 0.82 ELSE 0 END, CASE WHEN shared > 0 THEN 0.55 + 0.12 * shared ELSE 0 END) AS score FROM r),
u AS (SELECT id, type, CASE WHEN score > 0 THEN score WHEN contains(hay, 'order_77') OR contains(hay, 'brand') OR contains(hay, 'customer7') THEN 0.42 ELSE 0 END AS score FROM s)
SELECT id, round(CAST(least(score + CASE type WHEN 'endpoint' THEN 0.12 WHEN 'function' THEN 0.1 WHEN 'method' THEN 0.1 WHEN 'class' THEN 0.08 WHEN 'schema' THEN 0.08 WHEN 'file' THEN 0.04 WHEN 'module' THEN -0.1 ELSE 0 END, 1.25) AS DOUBLE), 4) AS score FROM u WHERE score > 0""",
    "g_nodes",
)
def _(m):
    return R.symbol_seeds(m.nodes, "order_77 brand customer7")


@query(
    "vec_01_nearest",
    "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE score > 0 QUALIFY place <= 10",
)
def _(m):
    return R.nearest(m.embeddings, m.embeddings.where("vec_id % 50 = 0"), 10)


@query("vec_02_cell_index")
def _(m):
    from lithograph.operators import vector_index
    from lithograph.plans.registry import shared_folder

    index, asked = vector_index.build(m.embeddings, shared_folder(m.spark)), m.embeddings.where("vec_id % 50 = 0")
    return vector_index.search(index, asked, 10, vector_index.probes(index, asked, 10))


@query("vec_06_dimensions", "SELECT len(embedding) AS dimensions, count(*) AS n, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS norm FROM embeddings GROUP BY 1")
def _(m):
    return m.embeddings.groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(R.dot(F.col("embedding"), F.col("embedding")))), 6).alias("norm"))


@query("vec_03_distinct_contents", "SELECT content_hash, count(*) AS chunks, min(doc_id) AS keeper FROM (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents) GROUP BY 1")
def _(m):
    return m.documents.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash")).agg(F.count("*").alias("chunks"), F.min("doc_id").alias("keeper"))


@query("vec_04_missing_embeddings", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def _(m):
    return m.documents.join(m.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


HYBRID = (
    ", c AS (SELECT o_orderkey AS k, 'o:' || CAST(o_orderkey AS STRING) AS node_id, 'app/' || lower(o_orderstatus) AS file_path, o_orderkey % 700 + 1 AS start_line, epoch(o_orderdate) AS stamp, o_orderkey % 17 AS kw, o_orderkey % 13 AS sem FROM orders),"
    " d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM g_edges UNION ALL SELECT target_id FROM g_edges) GROUP BY id), n AS (SELECT g_nodes.id, coalesce(degree, 0) AS degree FROM g_nodes LEFT JOIN d ON d.id = g_nodes.id), z AS (SELECT id, degree / max(degree) OVER () AS cent FROM n)"
    " SELECT k, round(0.35 * CASE WHEN sem < 5 THEN sem / 5 ELSE 0 END + 0.25 * CASE WHEN kw < 4 THEN kw / 4 ELSE 0 END + 0.2 * CASE WHEN k % 3 = 0 THEN 1 / (k % 4 + 1) ELSE 0 END + 0.1 * cent + 0.1 * (stamp - min(stamp) OVER ()) / (max(stamp) OVER () - min(stamp) OVER ()), 5) AS score FROM c JOIN z ON z.id = c.node_id"
)


@query("qry_02_hybrid_rank", HYBRID, "g_nodes", "g_edges")
def _(m):
    o = m.orders
    key = F.col("o_orderkey")
    base = o.select(key.alias("id"), F.concat(F.lit("o:"), key.cast("string")).alias("node_id"), F.concat(F.lit("app/"), F.lower("o_orderstatus")).alias("file_path"), (key % 700 + 1).alias("start_line"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("stamp"))
    keyword = o.where(key % 17 < 4).select(key.alias("id"), (key % 17 / 4).alias("score"))
    semantic = o.where(key % 13 < 5).select(key.alias("id"), (key % 13 / 5).alias("score"))
    hops = o.where(key % 3 == 0).select(F.concat(F.lit("o:"), key.cast("string")).alias("id"), (key % 4).alias("hop"))
    return R.hybrid_rank(base, m.nodes, m.edges, hops, keyword, semantic).select(F.col("id").alias("k"), F.round("score", 5).alias("score"))


@query("agg_03_freshness", "SELECT o_orderkey, round((epoch(o_orderdate) - min(epoch(o_orderdate)) OVER ()) / (max(epoch(o_orderdate)) OVER () - min(epoch(o_orderdate)) OVER ()), 6) AS freshness FROM orders")
def _(m):
    rows = m.orders.select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("stamp"))
    return R.freshness(rows, "stamp").select("o_orderkey", F.round("freshness", 6).alias("freshness"))


@query(
    "agg_14_token_budget",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r\\x0b]+'))) AS tokens, row_number() OVER (ORDER BY length(text) DESC NULLS LAST, doc_id) AS rn FROM documents),
p AS (SELECT CAST(0 AS BIGINT) AS rn, 0 AS taken, CAST(8000 AS BIGINT) AS room, CAST(NULL AS BIGINT) AS doc_id, false AS got UNION ALL SELECT r.rn, taken + CASE WHEN taken < 20 AND tokens <= room THEN 1 ELSE 0 END, room - CASE WHEN taken < 20 AND tokens <= room THEN tokens ELSE 0 END, r.doc_id, taken < 20 AND tokens <= room FROM p JOIN r ON r.rn = p.rn + 1)
SELECT taken AS rank, doc_id FROM p WHERE got""",
)
def _(m):
    rows = m.documents.select("doc_id", S.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"), F.length("text").alias("n"))
    return R.packed(rows, "doc_id", [F.desc("n"), F.col("doc_id")], "tokens", 8000, 20)


@query(
    "win_02_islands",
    """, x AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g_nodes WHERE type = 'function'),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 15 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line, name ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT file_path, CAST(island AS BIGINT) AS island, greatest(1, min(start_line) - 3) AS start_line, max(end_line) + 3 AS end_line, array_to_string(list_sort(list(DISTINCT name)), ',') AS labels FROM y WHERE island <= 4 GROUP BY file_path, island""",
    "g_nodes",
)
def _(m):
    return O.islands(m.nodes.where("type = 'function'").withColumnRenamed("name", "label"), "file_path")


@query("win_03_per_file_caps", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM x WHERE k <= 3) WHERE p <= 10")
def _(m):
    return O.capped(m.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3, 10).select("doc_id", "source")


@query("win_05_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(m):
    return G.last_of_each(m.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("win_11_unique_suffixes", "SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || CAST(rn AS STRING) END AS unique_slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY replace(p_name, ' ', '-') ORDER BY p_partkey) AS rn FROM part)")
def _(m):
    return O.suffixed(m.part.select("p_partkey", S.slug(F.col("p_name")).alias("slug")), "slug", "p_partkey").select("p_partkey", "unique_slug")


def community_tree(m):
    return m.communities.withColumn("ord", F.regexp_extract("id", "(\\d+)", 1).cast("int"))


PREORDER = ", t AS (SELECT id, parent_id, lpad(regexp_extract(id, '(\\d+)', 1), 10, '0') AS own FROM g_communities), r AS (SELECT id, 0 AS depth, own AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, depth + 1, path || '/' || own FROM t JOIN r ON r.id = t.parent_id)"


@query("win_13_preorder", PREORDER + " SELECT id, depth, path FROM r", "g_communities")
def _(m):
    return O.preorder(community_tree(m))


@query("win_14_within_budget", PREORDER + " SELECT id, depth FROM r ORDER BY path LIMIT 13", "g_communities")
def _(m):
    return O.within_budget(community_tree(m), 13).select("id", "depth")


@query("win_16_visible_rows", PREORDER + " SELECT id, depth FROM r WHERE depth = 0 OR NOT starts_with(path, '0000000001/')", "g_communities")
def _(m):
    return O.preorder(community_tree(m), F.col("id") != "k:r1").select("id", "depth")


@query("win_12_budget_chunks")
def _(m):
    return O.budget_chunks(m.documents, "doc_id", "text", 800).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


@query("scl_13_sections", "WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), y AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^Licensed') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM x) SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM y GROUP BY doc_id, section")
def _(m):
    return O.sections(m.documents, "doc_id", "text", "^Licensed")


@query("chk_line_chunks", "WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, CAST((i - 1) // 5 AS BIGINT) AS chunk, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line, CAST(sum(length(line) + 1) AS BIGINT) AS n_chars FROM x GROUP BY doc_id, (i - 1) // 5")
def _(m):
    out = O.line_chunks(m.documents, "doc_id", "text", 5)
    return out.select("doc_id", "chunk", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "n_chars")


@query("src_15_line_range", "SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS i FROM documents) WHERE i BETWEEN 2 AND 4")
def _(m):
    return O.line_table(m.documents, "doc_id", "text").where("line_no between 2 and 4")


@query("src_06_languages", "SELECT regexp_extract(path, '\\.[^./]*$') AS ext, count(*) AS n, CASE regexp_extract(path, '\\.[^./]*$') WHEN '.md' THEN 'markdown' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.json' THEN 'json' ELSE 'unknown' END AS lang, regexp_extract(path, '\\.[^./]*$') IN ('.py', '.js') AS source FROM g_files GROUP BY ALL", "g_files")
def _(m):
    lang = P.language(F.col("path"))
    return m.files.groupBy(S.extension(F.col("path")).alias("ext"), lang.alias("lang"), P.is_source(lang).alias("source")).agg(F.count("*").alias("n"))


@query("src_05_binary", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL OR doc_id % 7 = 1 AND length(text) < 4096")
def _(m):
    # a NUL in front is found; one at the end only in texts that end within the first 4096 characters
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\0"), "text")).when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    return m.documents.where(P.is_binary(text)).select("doc_id")


@query(
    "gra_02_directories",
    ", d AS (SELECT unnest([array_to_string(string_split(path, '/')[1:1], '/'), array_to_string(string_split(path, '/')[1:2], '/'), array_to_string(string_split(path, '/')[1:3], '/')]) AS dir FROM g_files) SELECT DISTINCT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END AS parent, len(string_split(dir, '/')) AS depth FROM d",
    "g_files",
)
def _(m):
    return I.directories(m.files).withColumn("depth", F.col("depth").cast("long"))


#: A path for each rung of the ladder, and what it is.
CONFIG_CASES = [
    ("svc/Dockerfile", "build", "known_filename", 1.0), ("go.mod", "package_manifest", "known_filename", 1.0), ("a/.env.test", "environment", "env_filename", 1.0), ("web/x.config.mts", "tooling", "config_suffix", 0.95),
    ("app/settings.py", "runtime", "config_stem", 0.9), ("config/pytest-a.yaml", "tooling", "config_directory", 0.85), ("deploy/my-config.json", "runtime", "name_heuristic", 0.8), ("main.py", None, None, None), ("compose.yml", "build", "known_filename", 1.0), ("sub/.gitignore", "runtime", "known_filename", 1.0),
]
CONFIG_VALUES = ", ".join(f"({i}, '{c[0]}', " + (f"'{c[1]}', '{c[2]}', CAST({c[3]} AS DOUBLE))" if c[1] else "NULL, NULL, NULL)") for i, c in enumerate(CONFIG_CASES))


@query("gra_03_config_files", f"SELECT doc_id, path, kind, reason, confidence FROM documents JOIN (VALUES {CONFIG_VALUES}) c(i, path, kind, reason, confidence) ON i = doc_id % 10 WHERE kind IS NOT NULL")
def _(m):
    paths = F.element_at(F.array(*[F.lit(c[0]) for c in CONFIG_CASES]), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = m.documents.select("doc_id", paths.alias("path"))
    return rows.withColumn("c", I.config_class(F.col("path"), P.language(F.col("path")))).where("c is not null").select("doc_id", "path", "c.kind", "c.reason", "c.confidence")


@query(
    "jn_06_snapshot_diff",
    "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha <> n.sha THEN 'changed' ELSE 'unchanged' END AS change FROM g_old o FULL JOIN g_new n ON o.path = n.path",
    "g_files", "g_old", "g_new",
)
def _(m):
    return I.snapshot_diff(m.old, m.new)


@query(
    "str_02_plan_counts",
    ", d AS (SELECT CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha <> n.sha THEN 'changed' ELSE 'unchanged' END AS change FROM g_old o FULL JOIN g_new n ON o.path = n.path) SELECT change, count(*) AS files FROM d GROUP BY change",
    "g_files", "g_old", "g_new",
)
def _(m):
    return I.snapshot_diff(m.old, m.new).groupBy("change").agg(F.count("*").alias("files"))


@query("snk_06_upsert", "SELECT path, sha FROM g_new UNION ALL SELECT path, sha FROM g_old WHERE path NOT IN (SELECT path FROM g_new)", "g_files", "g_old", "g_new")
def _(m):
    return I.upserted(m.old, m.new, ["path"])


def stored_path(m):
    return f"{shared_folder(m.spark)}/rows"


@query("snk_02_synced_table", "SELECT path, sha FROM g_new", "g_files", "g_old", "g_new")
def _(m):
    path = stored_path(m)
    T.replaced(m.old, path, "main")
    T.synced(m.spark, m.new, path, "main", "path", ["sha"])
    return T.stored(m.spark, path, "main", m.new.schema)


@query("snk_01_emptied_table", "SELECT path, sha FROM g_old WHERE false", "g_files", "g_old")
def _(m):
    path = stored_path(m)
    T.replaced(m.old, path, "main")
    T.synced(m.spark, m.old.limit(0), path, "main", "path")
    return T.stored(m.spark, path, "main", m.old.schema)


@query("snk_05_classified_rows", "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'stale' WHEN o.sha = n.sha THEN 'kept' ELSE 'changed' END AS change FROM g_old o FULL JOIN g_new n ON o.path = n.path", "g_files", "g_old", "g_new")
def _(m):
    return T.classified(m.old, m.new, "path", ["sha"])


@query("snk_03_replaced_for_files", "SELECT path AS file_path, sha FROM g_old WHERE path NOT IN (SELECT path FROM g_files WHERE doc_id % 13 = 0) UNION ALL SELECT path, 'new' FROM g_files WHERE doc_id % 13 = 0", "g_files", "g_old")
def _(m):
    files = m.files.where("doc_id % 13 = 0").select(F.col("path").alias("file_path"))
    return T.replaced_for_files(m.old.withColumnRenamed("path", "file_path"), files.withColumn("sha", F.lit("new")), files)


@query("snk_09_pages_not_in", "SELECT page_id AS slug FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(m):
    return T.without_others(m.pages.select(F.col("page_id").alias("slug")), m.documents.where("lang = 'en'").select(F.col("doc_id").alias("slug")))


@query(
    "prs_04_innermost_owner",
    "SELECT id, owner FROM (SELECT p.id, s.id AS owner, row_number() OVER (PARTITION BY p.id ORDER BY s.end_line - s.start_line, s.id) AS rn FROM g_nodes p JOIN g_nodes s ON s.file_path = p.file_path AND s.start_line <= p.start_line AND p.end_line <= s.end_line AND s.id <> p.id WHERE p.type = 'function' AND s.type = 'function') WHERE rn = 1",
    "g_nodes",
)
def _(m):
    spans = m.nodes.where("type = 'function'").select("id", "file_path", "start_line", "end_line")
    return RG.innermost(spans, spans)


@query(
    "gra_11_tiered_calls",
    """, y AS (SELECT id, name, file_path AS path FROM g_nodes WHERE type IN ('function', 'class')), a AS (SELECT DISTINCT path, name FROM (SELECT path, name FROM y UNION ALL SELECT 'lib/brand_1/part_1.py', name FROM y)),
s AS (SELECT 'lib/brand_1/part_1.py' AS path, 'lib/brand_' || CAST(i AS STRING) || '/part_2.py' AS imported FROM range(1, 26) t(i)),
l AS (SELECT path, name, min(id) AS t FROM y GROUP BY path, name HAVING count(DISTINCT id) = 1), w AS (SELECT name, min(id) AS t FROM y GROUP BY name HAVING count(DISTINCT id) = 1),
c AS (SELECT a.path, a.name, min(y.id) AS t FROM a JOIN s ON s.path = a.path JOIN y ON y.path = s.imported AND y.name = a.name GROUP BY a.path, a.name HAVING count(DISTINCT y.id) = 1)
SELECT a.path, a.name, coalesce(l.t, c.t, w.t) AS target, CASE WHEN l.t IS NOT NULL THEN 'same_file' WHEN c.t IS NOT NULL THEN 'import_scoped' ELSE 'global' END AS tier, CAST(CASE WHEN l.t IS NOT NULL THEN 0.95 WHEN c.t IS NOT NULL THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, l.t IS NULL AND c.t IS NULL AS is_inferred FROM a LEFT JOIN l ON l.path = a.path AND l.name = a.name LEFT JOIN c ON c.path = a.path AND c.name = a.name LEFT JOIN w ON w.name = a.name WHERE coalesce(l.t, c.t, w.t) IS NOT NULL""",
    "g_nodes",
)
def _(m):
    symbols = m.nodes.where("type in ('function', 'class')").select("id", "name", F.col("file_path").alias("path"))
    here = F.lit("lib/brand_1/part_1.py")
    calls = symbols.select("path", "name").unionAll(symbols.select(here.alias("path"), "name"))
    scopes = m.spark.range(1, 26).select(here.alias("path"), F.concat(F.lit("lib/brand_"), F.col("id").cast("string"), F.lit("/part_2.py")).alias("imported"))
    return I.resolved_calls(calls, symbols, scopes)


@query("gra_07_resolved_imports", "SELECT path, './' || CAST(doc_id AS STRING) AS name, path AS target FROM g_files WHERE doc_id % 5 IN (1, 4)", "g_files")
def _(m):
    names = m.files.select("path", F.concat(F.lit("./"), F.col("doc_id").cast("string")).alias("name"))
    return I.resolved_imports(names, m.files.select("path"))


@query(
    "agg_23_adaptive_groups",
    ", g AS (SELECT depth, array_to_string(string_split(path, '/')[1:depth], '/') AS grp, count(*) AS files FROM g_files, (VALUES (1), (2), (3)) v(depth) GROUP BY ALL), f AS (SELECT depth FROM g GROUP BY depth HAVING count(*) >= 2 AND max(files) / sum(files) <= 0.7) SELECT depth, grp AS \"group\", files FROM g WHERE depth = (SELECT coalesce(min(depth), 3) FROM f)",
    "g_files",
)
def _(m):
    return O.adaptive_groups(m.files.select("path"), "path")


@query("agg_11_cache_stats", "SELECT task, count(*) AS runs, count(*) FILTER (cached) AS hits, CAST(sum(CASE WHEN cached THEN tokens_in ELSE 0 END) AS BIGINT) AS saved, round(count(*) FILTER (cached) / count(*), 6) AS ratio FROM g_runs WHERE status = 'success' GROUP BY task", "g_runs")
def _(m):
    return m.runs.where("status = 'success'").groupBy("task").agg(F.count("*").alias("runs"), F.count_if("cached").alias("hits"), F.sum(F.when(F.col("cached"), F.col("tokens_in")).otherwise(0)).alias("saved"), F.round(F.try_divide(F.count_if("cached"), F.count("*")), 6).alias("ratio"))


@query("agg_12_usage_json", "SELECT task, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(DISTINCT model) AS models FROM g_runs GROUP BY task", "g_runs")
def _(m):
    return m.runs.groupBy("task").agg(F.sum(F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.usage.k")).try_cast("long")).alias("k"), F.countDistinct("model").alias("models"))


@query("str_10_cache_lookup", "SELECT r.event_id, h.event_id AS hit FROM g_runs r JOIN (SELECT task, model, max_by(event_id, created_at) AS event_id FROM g_runs WHERE status = 'success' AND NOT cached GROUP BY task, model) h ON h.task = r.task AND h.model = r.model WHERE r.cached", "g_runs")
def _(m):
    best = m.runs.where("status = 'success' and not cached").groupBy("task", "model").agg(F.max_by("event_id", "created_at").alias("hit"))
    return m.runs.where("cached").join(best, ["task", "model"]).select("event_id", "hit")


@query("src_19_ordered_reads", "SELECT event_id, task, created_at FROM g_runs WHERE task = 'error' ORDER BY created_at DESC, event_id LIMIT 100", "g_runs")
def _(m):
    return m.runs.where("task = 'error'").orderBy(F.desc("created_at"), "event_id").limit(100).select("event_id", "task", "created_at")


@query("agg_28_table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages")
def _(m):
    one = lambda n: getattr(m, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return one("documents").unionByName(one("orders")).unionByName(one("pages"))


@query("agg_31_types_joined", "SELECT array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM documents")
def _(m):
    return m.documents.agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


@query("agg_26_first_by_order", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def _(m):
    rows = m.lineitem.select("l_partkey", "l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("x"))
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.min("x").alias("x")).select("l_partkey", "l_suppkey", "x.l_orderkey", "x.l_linenumber")


@query("set_01_first_wins", "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT page_id, 'page' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents)")
def _(m):
    one = lambda df, c, n: df.select(F.col(c).alias("doc_id"), F.lit(n).alias("origin"))
    return R.first_of([one(m.labels, "doc_id", "label"), one(m.documents, "doc_id", "document"), one(m.pages, "page_id", "page")], "doc_id")


@query("set_ops", "(SELECT doc_id, 'both' AS kind FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'unlabelled' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))")
def _(m):
    docs, marks = m.documents.select("doc_id"), m.labels.select("doc_id")
    return docs.intersect(marks).select("doc_id", F.lit("both").alias("kind")).unionAll(docs.subtract(marks).select("doc_id", F.lit("unlabelled")))


@query("scl_01_terms", f"SELECT doc_id, len({TERMS}) AS n, array_to_string({TERMS}[1:5], ' ') AS head FROM documents")
def _(m):
    t = S.terms(F.coalesce("text", F.lit("")))
    return m.documents.select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query("scl_02_token_estimate", "SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r\\x0b]+'))) AS tokens FROM documents")
def _(m):
    return m.documents.select("doc_id", S.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@query("scl_03_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _(m):
    return m.part.select("p_partkey", S.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query("scl_06_paths", "SELECT path, split_part(path, '/', -1) AS base, regexp_replace(path, '/[^/]*$', '') AS dir FROM g_files", "g_files")
def _(m):
    return m.files.select("path", S.base_name(F.col("path")).alias("base"), S.parent_dir(F.col("path")).alias("dir"))


@query("scl_10_urls", "SELECT page_id, regexp_replace(url, '(\\.git)?/?$', '') AS base FROM pages")
def _(m):
    return m.pages.select("page_id", S.web_base(F.col("url")).alias("base"))


@query("scl_11_citations", "SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'S1' ELSE 'S' || CAST(doc_id % 9 AS STRING) || ',S1' END AS ids FROM documents")
def _(m):
    text = F.concat(F.lit("see [[S"), (F.col("doc_id") % 9).cast("string"), F.lit("]] and [[S1]] or [[X]] [S5] [[S1]]"))
    return m.documents.select("doc_id", F.array_join(S.citations(text), ",").alias("ids"))


@query("scl_24_rounding", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round_even(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def _(m):
    return m.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.bround(F.avg("l_quantity"), 4).alias("mean"))


@query("ids_content_digests", "SELECT doc_id, 'main:chunk:' || substr(sha1(source || '|' || CAST(doc_id AS STRING) || '|' || lang), 1, 24) AS id, sha256(coalesce(text, '') || chr(10)) AS content_hash FROM documents")
def _(m):
    return m.documents.select("doc_id", S.digest_id("main", "chunk", [F.col("source"), F.col("doc_id").cast("string"), F.col("lang")], 24).alias("id"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary"), 256).alias("content_hash"))


@query("evt_tumbling_windows", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(m):
    return m.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("evt_sessions", "WITH x AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def _(m):
    return m.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("flt_08_like_hits", "SELECT id, CASE WHEN contains(lower(file_path), 'brand_12') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM g_chunks WHERE contains(lower(file_path), 'brand_12') OR contains(lower(content), 'brand_12') ORDER BY score DESC, file_path, start_line, id LIMIT 25", "g_chunks")
def _(m):
    return R.like_hits(m.chunks, "brand_12", 25).select("id", "score")


@query("flt_09_all_terms", f"SELECT doc_id FROM documents WHERE list_has_all({TERMS}, ['the', 'and'])")
def _(m):
    return R.all_terms(m.documents.where("text is not null"), "text", ["the", "and"]).select("doc_id")


#: The search '"in the" that -with or "to the" "and of"' by unnest and position arithmetic.
BOOLEAN_SEARCH = f"""WITH t AS (SELECT doc_id AS id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {TERMS} AS w FROM documents)),
lits AS (SELECT * FROM (VALUES (0, 0, 'in', 2), (0, 1, 'the', 2), (1, 0, 'that', 1), (2, 0, 'with', 1), (3, 0, 'to', 2), (3, 1, 'the', 2), (4, 0, 'and', 2), (4, 1, 'of', 2)) v(lit, j, term, k)),
occ AS (SELECT lit, id, pos - j AS b, pos - j + k - 1 AS e FROM t JOIN lits USING (term) GROUP BY lit, id, pos - j, k HAVING count(*) = k),
one AS (SELECT 0 AS part, id, e, max(CASE WHEN lit = 0 THEN b END) OVER (PARTITION BY id ORDER BY e) AS x, max(CASE WHEN lit = 1 THEN b END) OVER (PARTITION BY id ORDER BY e) AS y, 3 AS words FROM occ WHERE lit IN (0, 1)),
two AS (SELECT 1 AS part, id, e, max(CASE WHEN lit = 3 THEN b END) OVER (PARTITION BY id ORDER BY e) AS x, max(CASE WHEN lit = 4 THEN b END) OVER (PARTITION BY id ORDER BY e) AS y, 4 AS words FROM occ WHERE lit IN (3, 4)),
covers AS (SELECT part, id, least(x, y) AS b, min(e) AS e, words FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT id, round(sum(CAST(0.1 AS DOUBLE) / (1 + greatest(e - b + 1 - words, 0))), 6) AS rank FROM covers WHERE part = 1 OR id NOT IN (SELECT id FROM occ WHERE lit = 2) GROUP BY id"""


@query("flt_04_boolean_search", BOOLEAN_SEARCH)
def _(m):
    path = shared_folder(m.spark)
    phrases.write_index(m.documents, "doc_id", "text", path)
    return phrases.stored_search(m.spark, path, '"in the" that -with or "to the" "and of"')


@query("flt_12_vec_05_embedding_text", "SELECT id, file_path || ':' || CAST(start_line AS STRING) || '-' || CAST(end_line AS STRING) || chr(10) || content AS text FROM g_chunks", "g_chunks")
def _(m):
    from lithograph.operators.build import embedding_text

    return embedding_text(m.chunks.withColumn("content_hash", F.lit(""))).select("id", "text")


@query("src_13_chunks_by_nodes", "SELECT id, file_path, start_line FROM g_chunks WHERE node_id IN (SELECT id FROM g_nodes WHERE type = 'function' AND start_line < 40)", "g_nodes", "g_chunks")
def _(m):
    ids = m.nodes.where("type = 'function' and start_line < 40").select(F.col("id").alias("node_id"))
    return m.chunks.join(ids, "node_id", "left_semi").select("id", "file_path", "start_line")


@query("src_20_first_running", "SELECT event_id, task FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS rn FROM g_runs WHERE status = 'failed') WHERE rn = 1", "g_runs")
def _(m):
    return m.runs.where("status = 'failed'").groupBy("user_id").agg(F.min_by(F.struct("event_id", "task"), F.struct("created_at", "event_id")).alias("x")).select("x.*")


@query("scl_12_markdown_faults", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no first heading,no section' WHEN 2 THEN 'another title' ELSE 'no section' END AS faults FROM documents")
def _(m):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "# Page\n\n## Part\ntext").when(k == 1, "text\n### Deep").when(k == 2, "# Other\n\n## Part").otherwise("# Page\ntext")
    return m.documents.select("doc_id", F.array_join(S.markdown_faults(text, F.lit("Page")), ",").alias("faults"))


@query("scl_14_source_lines", "SELECT doc_id, 'a' || chr(10) || '```' || chr(10) || 'Sources: kept' || chr(10) || '```' || chr(10) || chr(10) || CAST(doc_id AS STRING) AS text FROM documents")
def _(m):
    text = F.concat(F.lit("a\nSources: [[S1]]\n```\nSources: kept\n```\n\n\n\n"), F.col("doc_id").cast("string"), F.lit("\n**Sources:** x\n"))
    return m.documents.select("doc_id", S.without_source_lines(text).alias("text"))


@query("scl_18_canonical_json", "SELECT p_partkey, sha256('{\"a\": ' || CAST(p_partkey AS STRING) || ', \"b\": \"' || p_name || '\"}') AS digest FROM part")
def _(m):
    return m.part.select("p_partkey", F.sha2(S.canonical_json({"b": F.col("p_name"), "a": F.col("p_partkey")}).cast("binary"), 256).alias("digest"))


@query("scl_20_generic_names", "SELECT doc_id, doc_id % 3 <> 2 AS generic FROM documents")
def _(m):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"Community '), F.col("doc_id").cast("string"), F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.lit(" module  ")).otherwise(F.lit("Module of retrieval"))
    return m.documents.select("doc_id", S.is_generic_name(name).alias("generic"))


@query("scl_21_test_globs", "SELECT path, path LIKE 'doc/en/%.py' AS hit FROM g_files", "g_files")
def _(m):
    return m.files.select("path", P.is_test_by(F.col("path"), "doc/en/**/*.py").alias("hit"))
