"""Queries on retrieval as users call it: seeds, file groups, node context, context pack, trace; pages and their catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.operators import graph as G
from lithograph.operators import retrieve as V
from lithograph.operators import translations as TR
from lithograph.operators import wiki as W
from lithograph.plans.registry import last_links, query


@query("qry_01_retrieve")
def _(m):
    return V.rows(V.retrieve(m.nodes, m.links, m.chunks, "red steel part", members=m.members, last=last_links))


@query(
    "win_06_seed_hits",
    ", c AS (SELECT node_id, file_path, 1 - (start_line - 1) / 1000 AS score, start_line AS position FROM g_chunks WHERE start_line < 60) SELECT node_id AS id, round(max(greatest(0.25, score - 0.01 * (position - 1))), 9) AS score FROM c JOIN g_nodes n ON n.id = c.node_id GROUP BY node_id",
    "g_nodes", "g_chunks",
)
def _(m):
    hits = m.chunks.where("start_line < 60").select("node_id", "file_path", (1 - (F.col("start_line") - 1) / 1000).alias("score"), F.col("start_line").alias("position"))
    return V.seed_hits(m.nodes, hits).select("id", F.round("score", 9).alias("score"))


@query(
    "qry_03_file_groups",
    """, s AS (SELECT id, type, file_path FROM g_nodes WHERE id LIKE 'p:4%' OR id LIKE 's:1%' OR id LIKE 'o:1%'), g AS (SELECT file_path, sum(CASE WHEN id IN ('p:42', 's:1') THEN 8 WHEN type <> 'file' THEN 2 ELSE 1 END) AS score, count(*) AS nodes FROM s GROUP BY 1),
x AS (SELECT a.file_path, count(*) AS more FROM g_edges e JOIN s a ON a.id = e.source_id JOIN s b ON b.id = e.target_id WHERE e.type <> 'contains' GROUP BY 1)
SELECT g.file_path, CAST(score + coalesce(more, 0) AS BIGINT) AS score, nodes, row_number() OVER (ORDER BY regexp_matches(g.file_path, '(^|/)tests(/|$)'), score + coalesce(more, 0) DESC, g.file_path) AS place FROM g LEFT JOIN x ON x.file_path = g.file_path""",
    "g_nodes", "g_edges",
)
def _(m):
    chosen = m.nodes.where("id like 'p:4%' or id like 's:1%' or id like 'o:1%'").select("id")
    return V.file_groups(m.nodes, m.edges, chosen, m.spark.createDataFrame([("p:42",), ("s:1",)], "id string"))


@query("qry_03_explore")
def _(m):
    got = V.explore(m.nodes, G.cut(m.edges), "customer7")
    return got["sections"].unionByName(got["additional"].select("file_path", F.lit(None).cast("long").alias("island"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit("").alias("labels")))


@query(
    "qry_04_node_context",
    """, x AS (SELECT DISTINCT source_id AS id, type FROM g_edges WHERE target_id = 'p:42' AND type IN ('calls', 'references', 'routes_to') ORDER BY id, type LIMIT 20), y AS (SELECT DISTINCT target_id AS id, type FROM g_edges WHERE source_id = 'p:42' AND type IN ('calls', 'references', 'routes_to') ORDER BY id, type LIMIT 20)
SELECT 'node' AS relation, id, name, file_path, greatest(1, start_line - 3) AS start_line, end_line + 3 AS end_line FROM g_nodes WHERE id = 'p:42' UNION ALL SELECT 'caller', n.id, n.name, n.file_path, NULL, NULL FROM x JOIN g_nodes n ON n.id = x.id UNION ALL SELECT 'callee', n.id, n.name, n.file_path, NULL, NULL FROM y JOIN g_nodes n ON n.id = y.id""",
    "g_nodes", "g_edges",
)
def _(m):
    return V.node_context(m.nodes, m.edges, m.spark.createDataFrame([("p:42",)], "id string"))


@query(
    "qry_07_context_pack",
    """, c AS (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM g_chunks WHERE node_id IN ('p:1', 'p:2', 'p:3')), n AS (SELECT id FROM g_nodes WHERE id IN ('c:5', 'p:1', 'p:2', 'p:3', 's:1', 's:2', 's:3', 's:4', 's:5')),
e AS (SELECT * FROM (SELECT *, CASE type WHEN 'calls' THEN 1.0 WHEN 'routes_to' THEN 1.0 WHEN 'references' THEN 0.7 WHEN 'contains' THEN 0.58 ELSE 0.35 END AS w FROM g_edges WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)))
SELECT trim('Query: parts' || chr(10) || chr(10) || 'Source Chunks:' || chr(10) || (SELECT string_agg('[' || id || '] ' || file_path || ':' || CAST(start_line AS STRING) || '-' || CAST(end_line AS STRING) || chr(10) || rtrim(content) || chr(10), chr(10) ORDER BY rank) FROM c) || chr(10) || 'Graph Facts:' || chr(10) || coalesce((SELECT string_agg('- ' || source_id || ' -[' || type || ']-> ' || target_id || ' (confidence=' || CAST(confidence AS STRING) || ')', chr(10) ORDER BY w DESC, is_inferred, type, source_id, target_id) FROM (SELECT * FROM e ORDER BY w DESC, is_inferred, type, source_id, target_id LIMIT 40)), '')) AS text, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM c) AS chunk_count""",
    "g_nodes", "g_edges", "g_chunks",
)
def _(m):
    from pyspark.sql import Window

    ids = m.nodes.where(F.col("id").isin("c:5", "p:1", "p:2", "p:3", "s:1", "s:2", "s:3", "s:4", "s:5")).select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    few = m.chunks.where(F.col("node_id").isin("p:1", "p:2", "p:3")).withColumn("rank", F.row_number().over(Window.orderBy("id")))
    return V.context_pack(V.Trace("parts", ids, G.related_edges(m.edges, ids.select("id")), few)).drop("token_count")


@query("agg_16_component_pick")
def _(m):
    home = m.nodes.where("file_path <> ''").select("id", F.substring_index("file_path", "/", 2).alias("grp"))
    return W.component_edges(m.edges, home)


@query("agg_13_evidence_inventory", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, array_to_string(list(file_path ORDER BY first)[1:12], ',') AS first_files FROM (SELECT file_path, count(*) AS n, min(CAST(substr(id, 3) AS BIGINT)) AS first FROM g_chunks GROUP BY file_path)", "g_chunks")
def _(m):
    return W.inventory(m.chunks.withColumn("rank", F.substring("id", 3, 20).cast("long")))


PAGES = "WITH p AS (SELECT page_id, 'page-' || CAST(page_id AS STRING) AS slug, CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'page-' || CAST(page_id - page_id % 6 AS STRING) END AS parent_slug, CAST(page_id % 6 AS INT) AS ord, 'Page ' || CAST(page_id * 7 % 101 AS STRING) AS title, CASE WHEN page_id % 5 = 0 THEN 'section' ELSE 'page' END AS kind FROM pages)"


def catalog(m):
    return m.spark.sql(PAGES.replace("FROM pages", "FROM {pages}") + " SELECT slug, parent_slug, ord, title, kind, CASE WHEN parent_slug IS NULL THEN 0 ELSE 1 END AS depth FROM p", pages=m.pages)


@query("qry_10_related_pages", PAGES + " SELECT slug, row_number() OVER (ORDER BY CASE WHEN parent_slug = 'page-12' THEN 0 ELSE 1 END, CASE WHEN parent_slug IS NULL THEN 0 ELSE 1 END, ord, title, slug) AS place FROM p WHERE kind = 'page' AND slug <> 'page-13' QUALIFY place <= 12")
def _(m):
    return W.related_pages(catalog(m), "page-13", "page-12").select("slug", "place")


@query("qry_22_catalog_context", PAGES + " SELECT (SELECT title FROM p WHERE slug = 'page-13') AS current, (SELECT title FROM p WHERE slug = 'page-12') AS parent, count(*) FILTER (kind = 'page') AS page_count FROM p")
def _(m):
    return W.catalog_context(catalog(m), "page-13")


@query("qry_18_missing_pages", PAGES + " SELECT slug FROM p WHERE kind = 'page' AND page_id NOT IN (SELECT doc_id FROM labels)")
def _(m):
    pages = m.labels.select(F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("slug"))
    return W.missing_pages(catalog(m), pages)


@query("jn_18_catalog_pages", PAGES + " SELECT p.slug, p.title, coalesce('done', 'x') AS kind, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'written' END AS state FROM p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = p.page_id")
def _(m):
    pages = m.labels.select(F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("slug"), F.lit("written").alias("state")).distinct()
    return W.with_state(catalog(m), pages).select("slug", "title", F.lit("done").alias("kind"), "state")


@query("jn_17_cited_refs", "SELECT doc_id, 'S' || CAST(doc_id % 9 AS STRING) AS citation_id, 'file_' || CAST(doc_id % 9 AS STRING) AS file_path FROM documents WHERE doc_id % 9 BETWEEN 1 AND 6")
def _(m):
    markdown = F.concat(F.lit("see [[S"), (F.col("doc_id") % 9).cast("string"), F.lit("]] and [[S77]]"))
    refs = m.spark.createDataFrame([(f"S{i}", f"file_{i}") for i in range(1, 7)], "citation_id string, file_path string")
    return W.cited(m.documents.select("doc_id", markdown.alias("markdown")), "doc_id", refs)


@query("src_11_repo_selector", "SELECT * FROM (VALUES ('alpha-1', 'r:1'), ('Beta', 'r:2'), ('gam', 'r:3'), ('/src/d', 'r:4'), ('same', CAST(NULL AS STRING)), ('nothing', NULL)) v(selector, id)")
def _(m):
    repos = m.spark.createDataFrame([("r:1", "alpha-1", "/src/a", None), ("r:2", "Beta", "/src/b", None), ("gamma", "C", "/src/c", None), ("r:4", "same", "/src/d", None), ("r:5", "same", "/src/e", None)], "id string, name string, path string, git_url string")
    asked = m.spark.createDataFrame([("alpha-1",), ("Beta",), ("gam",), ("/src/d",), ("same",), ("nothing",)], "selector string")
    return W.resolve_repos(repos, asked).select("selector", F.when(F.col("id") == "gamma", "r:3").otherwise(F.col("id")).alias("id"))


#: Turns of conversations as versions of pages: the first as it was translated, the second as it is now, the third its translation.
VERSIONS = """o AS (SELECT 'c' || CAST(conv_id AS STRING) AS slug, length(text) % 3 AS hash FROM conversations WHERE turn = 0 AND conv_id % 9 <> 4),
s AS (SELECT 'c' || CAST(conv_id AS STRING) AS slug, CASE WHEN conv_id > 0 THEN 'c' || CAST(CAST((conv_id - conv_id % 2) / 2 AS BIGINT) AS STRING) END AS parent_slug, length(text) % 3 AS hash, 'T' || CAST(length(text) AS STRING) AS title FROM conversations WHERE turn = 1 AND length(text) % 7 <> 0),
t AS (SELECT 'c' || CAST(conv_id AS STRING) AS slug, role || CAST(length(text) AS STRING) AS title, length(text) % 2 = 0 AS edited, CASE WHEN length(text) % 5 = 0 THEN 'draft' ELSE 'generated' END AS status FROM conversations WHERE turn = 2 AND length(text) % 4 <> 1)"""


def versions(m):
    sql = "WITH " + VERSIONS.replace("FROM conversations", "FROM {conversations}")
    return {n: m.spark.sql(f"{sql} SELECT * FROM {n}", conversations=m.conversations) for n in ("o", "s", "t")}


@query(
    "qry_12_catalog_merge",
    "WITH RECURSIVE " + VERSIONS + """, k AS (SELECT slug, CASE WHEN s.slug IS NULL THEN CASE WHEN t.edited THEN 'orphan' ELSE 'delete' END WHEN t.slug IS NULL THEN 'translate' WHEN o.hash = s.hash THEN 'reuse' WHEN t.edited THEN 'conflict' ELSE 'retranslate' END AS class, coalesce(t.title, s.title) AS title, parent_slug
  FROM s FULL JOIN t USING (slug) LEFT JOIN o USING (slug)),
up AS (SELECT parent_slug AS slug FROM k WHERE class IN ('translate', 'retranslate', 'conflict') AND parent_slug IS NOT NULL UNION SELECT k.parent_slug FROM up JOIN k ON k.slug = up.slug WHERE k.parent_slug IS NOT NULL)
SELECT slug, class, title, class = 'reuse' AND slug IN (SELECT slug FROM up) AS above FROM k""",
)
def _(m):
    v = versions(m)
    return TR.merged(v["o"], v["s"], v["t"])


@query(
    "qry_23_translation_plan",
    "WITH " + VERSIONS + """, g AS (SELECT slug FROM o WHERE hash = 0)
SELECT slug, CASE WHEN s.slug IS NULL THEN 'delete' WHEN t.slug IS NULL OR status <> 'generated' OR slug IN (SELECT slug FROM g) THEN 'translate' ELSE 'reuse' END AS action, coalesce(s.slug IS NOT NULL AND status <> 'generated', false) AS stale FROM s FULL JOIN t USING (slug)""",
)
def _(m):
    v = versions(m)
    return TR.plan(v["s"], v["t"], v["o"].where("hash = 0"))
