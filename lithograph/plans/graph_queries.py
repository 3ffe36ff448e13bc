"""Queries on the graph: lookups, joins, traversals, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.files import is_noise, is_test, module_of
from lithograph.functions.scalars import digest_id
from lithograph.operators import graph as G
from lithograph.operators import ordered as O
from lithograph.plans.registry import last_links, link_id, query

WEIGHT = "CASE type WHEN 'calls' THEN 1.0 WHEN 'routes_to' THEN 1.0 WHEN 'references' THEN 0.7 WHEN 'contains' THEN 0.58 ELSE 0.35 END"


@query("gra_01_edges_last_writer", "SELECT id, source_id, target_id, type, confidence, weight, is_inferred FROM g_edges", "g_edges")
def _(m):
    return m.edges.select("id", "source_id", "target_id", "type", "confidence", "weight", "is_inferred")


@query(
    "gra_17_confidence_levels",
    "SELECT type, CASE WHEN confidence >= 0.99 AND NOT is_inferred THEN 'extracted' WHEN confidence >= 0.8 THEN 'resolved' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'ambiguous' END AS level, count(*) AS n FROM g_edges GROUP BY ALL",
    "g_edges",
)
def _(m):
    from lithograph.operators.ingest import confidence_level

    return m.edges.groupBy("type", confidence_level(F.col("confidence"), F.col("is_inferred")).alias("level")).agg(F.count("*").alias("n"))


@query("src_12_graph_read", "SELECT id, type, name, file_path FROM g_nodes WHERE type IN ('function', 'endpoint') AND file_path LIKE 'app/f/%'", "g_nodes")
def _(m):
    return m.nodes.where(F.col("type").isin("function", "endpoint") & F.startswith("file_path", F.lit("app/f/"))).select("id", "type", "name", "file_path")


@query("src_22_indexed_files", "SELECT file_path, language, max(end_line) AS lines FROM g_nodes WHERE type = 'file' GROUP BY ALL", "g_nodes")
def _(m):
    return m.nodes.where("type = 'file'").groupBy("file_path", "language").agg(F.max("end_line").alias("lines"))


@query(
    "itr_01_callers",
    "SELECT e.source_id, e.target_id, e.type, n.name AS other_name, n.file_path AS other_path FROM g_edges e JOIN g_nodes n ON n.id = e.source_id WHERE e.type IN ('calls', 'references', 'routes_to') AND e.target_id IN ('p:7', 'p:42', 'o:5')",
    "g_nodes", "g_edges",
)
def _(m):
    picked = m.nodes.where(F.col("id").isin("p:7", "p:42", "o:5")).select("id")
    return G.neighbours(m.nodes, m.edges, picked, False, G.FLOW_TYPES).select("source_id", "target_id", "type", "other_name", "other_path")


@query(
    "itr_01_callees",
    "SELECT e.source_id, e.target_id, e.type, n.name AS other_name, n.file_path AS other_path FROM g_edges e JOIN g_nodes n ON n.id = e.target_id WHERE e.type IN ('calls', 'references', 'routes_to') AND e.source_id IN ('c:5', 's:3')",
    "g_nodes", "g_edges",
)
def _(m):
    picked = m.nodes.where(F.col("id").isin("c:5", "s:3")).select("id")
    return G.neighbours(m.nodes, m.edges, picked, True, G.FLOW_TYPES).select("source_id", "target_id", "type", "other_name", "other_path")


@query(
    "agg_02_degree_centrality",
    ", d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM g_edges UNION ALL SELECT target_id FROM g_edges) GROUP BY id), n AS (SELECT g_nodes.id, coalesce(degree, 0) AS degree FROM g_nodes LEFT JOIN d ON d.id = g_nodes.id) SELECT id, degree, round(degree / (max(degree) OVER ()), 6) AS centrality FROM n",
    "g_nodes", "g_edges",
)
def _(m):
    return G.degree_centrality(m.nodes, m.edges).select("id", "degree", F.round("centrality", 6).alias("centrality"))


@query(
    "jn_04_related_edges",
    f", s AS (SELECT id FROM g_nodes WHERE id IN ('s:3', 's:4') OR (id LIKE 'p:1%' AND type = 'function') OR id LIKE 'o:1%') SELECT id, type, source_id, target_id FROM (SELECT *, row_number() OVER (ORDER BY {WEIGHT} DESC, is_inferred, type, source_id, target_id) AS rn FROM g_edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)) WHERE rn <= 140",
    "g_nodes", "g_edges",
)
def _(m):
    ids = m.nodes.where("id in ('s:3', 's:4') or id like 'p:1%' or id like 'o:1%'").select("id")
    return G.related_edges(m.edges, ids).select("id", "type", "source_id", "target_id")


@query(
    "jn_16_boundary_edges",
    ", s AS (SELECT id FROM g_nodes WHERE file_path LIKE 'lib/brand_1%') SELECT type, count(*) AS n, round(sum(weight), 4) AS weight FROM g_edges WHERE (source_id IN (SELECT id FROM s)) <> (target_id IN (SELECT id FROM s)) GROUP BY type",
    "g_nodes", "g_edges",
)
def _(m):
    ids = m.nodes.where("file_path like 'lib/brand_1%'").select("id")
    return G.boundary(m.edges, ids).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "itr_03_impact",
    """, up AS (SELECT target_id AS src, source_id AS dst FROM g_edges WHERE type IN ('calls', 'references', 'routes_to', 'contains')),
down AS (SELECT source_id AS src, target_id AS dst FROM g_edges JOIN g_nodes n ON n.id = source_id WHERE g_edges.type = 'contains' AND n.type IN ('repository', 'directory', 'file', 'config', 'class', 'interface', 'schema')),
d0 AS (SELECT 'p:7' AS id), d1 AS (SELECT DISTINCT dst AS id FROM up WHERE src IN (SELECT id FROM d0) AND dst NOT IN (SELECT id FROM d0)),
d1m AS (SELECT id FROM d1 UNION SELECT dst FROM down WHERE src IN (SELECT id FROM d1)), s1 AS (SELECT id FROM d0 UNION SELECT id FROM d1m),
d2 AS (SELECT DISTINCT dst AS id FROM up WHERE src IN (SELECT id FROM d1m) AND dst NOT IN (SELECT id FROM s1)),
d2m AS (SELECT id FROM d2 UNION SELECT dst FROM down WHERE src IN (SELECT id FROM d2) AND dst NOT IN (SELECT id FROM s1))
SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1m UNION ALL SELECT id, 2 FROM d2m) GROUP BY id""",
    "g_nodes", "g_edges",
)
def _(m):
    return G.impact(m.nodes, G.cut(m.edges), m.nodes.where("id = 'p:7'").select("id"), 2)


@query(
    "itr_02_shortest_flow",
    ", a AS (SELECT e.id AS e1, e.target_id AS mid FROM g_edges e WHERE e.source_id = 'c:5' AND e.type = 'routes_to'), b AS (SELECT a.e1, a.mid, e.id AS e2, e.target_id AS last FROM a JOIN g_edges e ON e.source_id = a.mid AND e.type = 'calls' ORDER BY a.e1, e.confidence DESC, e.id LIMIT 1) SELECT 0 AS step, 'c:5' AS id, NULL AS edge_id FROM b UNION ALL SELECT 1, mid, e1 FROM b UNION ALL SELECT 2, last, e2 FROM b",
    "g_edges",
)
def _(m):
    return G.shortest_flow(m.nodes, m.links, m.nodes.where("id = 'c:5'").select("id"), m.nodes.where("type = 'function'").select("id"), last=last_links)


@query(
    "itr_05_decayed_expansion",
    f""", b AS (SELECT source_id AS src, target_id AS dst, {WEIGHT} * confidence AS w FROM g_edges UNION ALL SELECT target_id, source_id, {WEIGHT} * confidence FROM g_edges),
h0 AS (SELECT 's:3' AS id, 0 AS hop, CAST(1.0 AS DOUBLE) AS score UNION ALL SELECT 'p:42', 0, CAST(0.9 AS DOUBLE)),
c1 AS (SELECT dst AS id, max(score * w * power(0.78, 1)) AS score FROM b JOIN h0 ON h0.id = src WHERE dst NOT IN (SELECT id FROM h0) GROUP BY dst),
h1 AS (SELECT id, 1 AS hop, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM c1) WHERE rn <= 58),
c2 AS (SELECT dst AS id, max(score * w * power(0.78, 2)) AS score FROM b JOIN h1 ON h1.id = src WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1) GROUP BY dst),
h2 AS (SELECT id, 2 AS hop, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM c2) WHERE rn <= 58 - (SELECT count(*) FROM h1))
SELECT id, hop, round(score, 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)""",
    "g_edges",
)
def _(m):
    seeds = m.spark.createDataFrame([("s:3", 1.0), ("p:42", 0.9)], "id string, score double")
    return G.expand(seeds, G.cut(m.edges), 2).select("id", "hop", F.round("score", 6).alias("score"))


DEPENDS = """, f AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM g_edges e JOIN g_nodes a ON a.id = e.source_id JOIN g_nodes b ON b.id = e.target_id WHERE e.type IN ('calls', 'references') AND a.file_path <> b.file_path AND a.file_path <> '' AND b.file_path <> '')"""


@query("agg_06_file_dependents", DEPENDS + " SELECT src, dst FROM f", "g_nodes", "g_edges")
def _(m):
    return G.file_dependents(m.nodes, m.links)


@query(
    "itr_06_transitive_dependents",
    DEPENDS + ", t AS (SELECT 'lib/brand_7/part_3.py' AS id, 0 AS depth UNION SELECT f.src, t.depth + 1 FROM t JOIN f ON f.dst = t.id WHERE t.depth < 3) SELECT id, min(depth) AS depth FROM t GROUP BY id",
    "g_nodes", "g_edges",
)
def _(m):
    links = G.cut(G.file_dependents(m.nodes, m.links).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = m.spark.createDataFrame([("lib/brand_7/part_3.py",)], "id string")
    return G.reachable(links, roots, 3)


@query(
    "qry_05_affected_tests",
    DEPENDS + ", t AS (SELECT 'lib/brand_7/part_3.py' AS id, 0 AS depth UNION SELECT f.src, t.depth + 1 FROM t JOIN f ON f.dst = t.id WHERE t.depth < 5) SELECT id, min(depth) AS depth, regexp_matches(id, '(^|/)(__tests__|e2e|spec|specs|test|tests)(/|$)') OR regexp_matches(id, '(^|/)test_[^/]*$|_test\\.(py|go)$') AS is_test FROM t GROUP BY id",
    "g_nodes", "g_edges",
)
def _(m):
    links = G.cut(G.file_dependents(m.nodes, m.links).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = m.spark.createDataFrame([("lib/brand_7/part_3.py",)], "id string")
    return G.reachable(links, roots, 5).withColumn("is_test", is_test(F.col("id")))


@query(
    "itr_09_components",
    ", e AS (SELECT source_id AS a, target_id AS b FROM g_edges WHERE type = 'contains'), t AS (SELECT id, id AS root FROM g_nodes WHERE id NOT IN (SELECT b FROM e) UNION ALL SELECT e.b, t.root FROM t JOIN e ON e.a = t.id) SELECT id, min(id) OVER (PARTITION BY root) AS component FROM t",
    "g_nodes", "g_edges",
)
def _(m):
    return G.components(m.nodes, m.edges.where("type = 'contains'"))


@query(
    "agg_04_community_dependencies",
    """, h AS (SELECT node_id, min(community_id) AS c FROM g_members WHERE community_id NOT IN (SELECT parent_id FROM g_communities WHERE parent_id IS NOT NULL) GROUP BY node_id),
x AS (SELECT a.c AS s, b.c AS t, CASE e.type WHEN 'calls' THEN 'calls_into' WHEN 'imports' THEN 'imports_from' WHEN 'exports' THEN 'imports_from' WHEN 'routes_to' THEN 'routes_to' ELSE 'depends_on' END AS kind, e.* FROM g_edges e JOIN h a ON a.node_id = e.source_id JOIN h b ON b.node_id = e.target_id WHERE e.type NOT IN ('contains', 'defines') AND a.c <> b.c)
SELECT s AS source_community_id, t AS target_community_id, kind, round(sum(greatest(0.01, weight)), 9) AS weight, round(avg(confidence), 9) AS confidence, count(*) AS edge_count, array_to_string(list_sort(list(id))[1:24], ',') AS evidence FROM x GROUP BY ALL""",
    "g_communities", "g_members", "g_edges",
)
def _(m):
    # suppliers and orders sit in communities; link them through shared parts
    return G.community_dependencies(m.communities, m.members, m.links, digits=9, last=["seq", "weight", "confidence"], made=link_id())


@query(
    "agg_05_community_contains",
    "SELECT 'main:community-edge:' || substr(sha1(p.id || '|' || c.id || '|contains'), 1, 20) AS id, p.id AS source_community_id, c.id AS target_community_id FROM g_communities c JOIN g_communities p ON p.id = c.parent_id",
    "g_communities",
)
def _(m):
    kids, parents = m.communities.alias("c"), m.communities.alias("p")
    rows = kids.join(parents, F.col("p.id") == F.col("c.parent_id")).select(F.col("p.id").alias("source_community_id"), F.col("c.id").alias("target_community_id"))
    return rows.select(digest_id("main", "community-edge", [F.col("source_community_id"), F.col("target_community_id"), F.lit("contains")], 20).alias("id"), "source_community_id", "target_community_id")


@query(
    "agg_01_status_grouping_sets",
    "SELECT type, language, count(*) AS n, CAST(grouping(type) AS INTEGER) AS g_type, CAST(grouping(language) AS INTEGER) AS g_language FROM g_nodes GROUP BY GROUPING SETS ((type), (language), ())",
    "g_nodes",
)
def _(m):
    return m.spark.sql("select type, language, count(*) as n, cast(grouping(type) as int) as g_type, cast(grouping(language) as int) as g_language from {nodes} group by grouping sets ((type), (language), ())", nodes=m.nodes)


@query(
    "agg_07_module_candidates",
    """, x AS (SELECT *, CASE WHEN len(string_split(file_path, '/')) <= 1 THEN '.' ELSE array_to_string(string_split(file_path, '/')[1:least(3, len(string_split(file_path, '/')) - 1)], '/') END AS module FROM g_nodes WHERE file_path <> '')
SELECT module, files, nodes FROM (SELECT module, count(DISTINCT file_path) AS files, count(*) AS nodes, row_number() OVER (ORDER BY count(DISTINCT file_path) DESC, module) AS rn FROM x GROUP BY module) WHERE rn <= 36""",
    "g_nodes",
)
def _(m):
    rows = m.nodes.where("file_path <> ''").groupBy(module_of(F.col("file_path")).alias("module")).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("nodes"))
    return rows.orderBy(F.desc("files"), "module").limit(36)


@query(
    "agg_07_module_top_types",
    """, x AS (SELECT type, CASE WHEN len(string_split(file_path, '/')) <= 1 THEN '.' ELSE array_to_string(string_split(file_path, '/')[1:least(3, len(string_split(file_path, '/')) - 1)], '/') END AS module FROM g_nodes WHERE file_path <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, type) AS rn FROM (SELECT module, type, count(*) AS n FROM x GROUP BY module, type)) SELECT module, type, n, rn AS place FROM c WHERE rn <= 2""",
    "g_nodes",
)
def _(m):
    from pyspark.sql import Window

    rows = m.nodes.where("file_path <> ''").groupBy(module_of(F.col("file_path")).alias("module"), "type").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "type"))).where("place <= 2")


@query("agg_08_directory_catalog", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files FROM g_files GROUP BY 1", "g_files")
def _(m):
    from lithograph.functions.scalars import parent_dir

    return m.files.groupBy(parent_dir(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))


@query(
    "agg_19_node_flow_stats",
    ", x AS (SELECT source_id AS id, 'out' AS way, type FROM g_edges UNION ALL SELECT target_id, 'in', type FROM g_edges), t AS (SELECT id, count(*) FILTER (way = 'in') AS incoming, count(*) FILTER (way = 'out') AS outgoing, count(*) FILTER (type = 'calls') AS calls, count(*) FILTER (type = 'references') AS refs FROM x GROUP BY id) SELECT n.id, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(calls, 0) AS calls, coalesce(refs, 0) AS refs FROM g_nodes n LEFT JOIN t ON t.id = n.id",
    "g_nodes", "g_edges",
)
def _(m):
    return G.flow_stats(m.nodes, m.edges)


@query(
    "agg_18_edge_buckets",
    "SELECT a.type AS source_type, b.type AS target_type, e.type, count(*) AS n, bool_or(e.is_inferred) AS inferred FROM g_edges e JOIN g_nodes a ON a.id = e.source_id JOIN g_nodes b ON b.id = e.target_id GROUP BY ALL",
    "g_nodes", "g_edges",
)
def _(m):
    kind = lambda side: m.nodes.select(F.col("id").alias(f"{side}_id"), F.col("type").alias(f"{side}_type"))
    return m.edges.join(kind("source"), "source_id").join(kind("target"), "target_id").groupBy("source_type", "target_type", "type").agg(F.count("*").alias("n"), F.bool_or("is_inferred").alias("inferred"))


@query(
    "agg_22_visible_and_other",
    ", c AS (SELECT community_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, community_id) AS rn FROM g_members GROUP BY community_id) SELECT CASE WHEN rn <= 10 THEN community_id ELSE 'other' END AS community, CAST(sum(n) AS BIGINT) AS members, count(*) AS merged FROM c GROUP BY 1",
    "g_members",
)
def _(m):
    sizes = m.members.groupBy("community_id").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "community_id").limit(10).select("community_id", F.lit(True).alias("shown"))
    name = F.when(F.col("shown"), F.col("community_id")).otherwise("other")
    return sizes.join(F.broadcast(top), "community_id", "left").groupBy(name.alias("community")).agg(F.sum("n").alias("members"), F.count("*").alias("merged"))


@query(
    "agg_10_communities_by_level", "SELECT level, count(*) AS n FROM g_communities GROUP BY level", "g_communities"
)
def _(m):
    return m.communities.groupBy("level").agg(F.count("*").alias("n"))


@query(
    "flt_13_noise_filter",
    """, k AS (SELECT id FROM g_nodes WHERE NOT regexp_matches(lower(file_path), '(^|/)(__tests__|e2e|spec|specs|test|tests|vendor|vendors|dist|build|node_modules)(/|$)'))
SELECT type, count(*) AS n FROM g_edges WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k) GROUP BY type""",
    "g_nodes", "g_edges",
)
def _(m):
    kept = m.nodes.where(~is_noise(F.col("file_path"))).select("id")
    return G.within(m.edges, kept).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "flt_16_ui_filter",
    ", k AS (SELECT id FROM g_nodes WHERE type IN ('method', 'function', 'endpoint')) SELECT count(*) AS n, round(avg(confidence), 6) AS confidence FROM g_edges WHERE type IN ('calls', 'routes_to') AND NOT (type = 'calls' AND is_inferred) AND source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)",
    "g_nodes", "g_edges",
)
def _(m):
    kept = m.nodes.where(F.col("type").isin("method", "function", "endpoint")).select("id")
    shown = m.edges.where("type in ('calls', 'routes_to') and not (type = 'calls' and is_inferred)")
    return G.within(shown, kept).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("flt_17_type_lists", "SELECT DISTINCT 'node' AS of, type FROM g_nodes UNION ALL SELECT DISTINCT 'edge', type FROM g_links", "g_nodes", "g_links")
def _(m):
    return m.nodes.select(F.lit("node").alias("of"), "type").distinct().unionAll(m.links.select(F.lit("edge"), "type").distinct())


@query(
    "jn_13_community_overlap",
    ", s AS (SELECT id FROM g_nodes WHERE id LIKE 'c:1%') SELECT community_id, count(*) AS matched, row_number() OVER (ORDER BY count(*) DESC, community_id) AS place FROM g_members WHERE node_id IN (SELECT id FROM s) GROUP BY community_id QUALIFY place <= 12",
    "g_nodes", "g_members",
)
def _(m):
    from pyspark.sql import Window

    hits = m.members.join(m.nodes.where("id like 'c:1%'").select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy("community_id").agg(F.count("*").alias("matched"))
    top = hits.orderBy(F.desc("matched"), "community_id").limit(12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("matched"), "community_id")))


@query(
    "jn_14_ancestors",
    ", t AS (SELECT id, parent_id AS above, 1 AS steps FROM g_communities WHERE parent_id IS NOT NULL UNION ALL SELECT t.id, c.parent_id, t.steps + 1 FROM t JOIN g_communities c ON c.id = t.above WHERE c.parent_id IS NOT NULL) SELECT * FROM t",
    "g_communities",
)
def _(m):
    return m.spark.sql("with recursive t(id, above, steps) as (select id, parent_id, 1 from {tree} where parent_id is not null union all select t.id, c.parent_id, t.steps + 1 from t join {tree} c on c.id = t.above where c.parent_id is not null) select * from t", tree=m.communities)


@query(
    "win_04_capped_communities",
    ", s AS (SELECT community_id, count(*) AS n FROM g_members WHERE node_id LIKE 'c:%' GROUP BY 1), l AS (SELECT c.id, c.parent_id, n, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, name) AS k, name FROM g_communities c JOIN s ON s.community_id = c.id) SELECT id, parent_id, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS p FROM l WHERE k <= 4) WHERE p <= 8",
    "g_communities", "g_members",
)
def _(m):
    sizes = m.members.where("node_id like 'c:%'").groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("n"))
    return O.capped(m.communities.join(sizes, "id"), "parent_id", [F.desc("n"), F.col("name")], 4, 8).select("id", "parent_id", "n")


@query(
    "win_08_ranked_partitions",
    "SELECT community_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(node_id)) AS rank FROM g_members GROUP BY community_id",
    "g_members",
)
def _(m):
    sizes = m.members.groupBy("community_id").agg(F.count("*").alias("size"), F.min("node_id").alias("label"))
    return O.numbered(sizes.withColumn("less", -F.col("size")), ["less", "label"], "rank").select("community_id", "size", "rank")


@query(
    "win_07_strongest_neighbour",
    ", x AS (SELECT source_id AS id, target_id AS nbr, weight FROM g_edges WHERE type = 'calls' UNION ALL SELECT target_id, source_id, weight FROM g_edges WHERE type = 'calls') SELECT id, nbr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, nbr DESC) AS rn FROM x) WHERE rn = 1",
    "g_edges",
)
def _(m):
    calls = m.edges.where("type = 'calls'")
    both = calls.select(F.col("source_id").alias("id"), F.col("target_id").alias("nbr"), "weight").unionAll(calls.select("target_id", "source_id", "weight"))
    return both.groupBy("id").agg(F.max_by("nbr", F.struct("weight", "nbr")).alias("nbr"))


@query(
    "itr_10_containment",
    ", up AS (SELECT target_id AS id, min(source_id) AS parent FROM g_edges WHERE type = 'contains' GROUP BY 1), t AS (SELECT id, id AS top, 0 AS depth FROM g_nodes UNION ALL SELECT t.id, up.parent, t.depth + 1 FROM t JOIN up ON up.id = t.top) SELECT id, top AS root, depth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS rn FROM t) WHERE rn = 1",
    "g_nodes", "g_edges",
)
def _(m):
    return G.containment(m.nodes, m.edges)


@query(
    "itr_13_overview_buckets",
    ", h AS (SELECT node_id, min(community_id) AS c FROM g_members GROUP BY node_id) SELECT coalesce(a.c, 'none') AS source, coalesce(b.c, 'none') AS target, e.type, count(*) AS n FROM g_edges e LEFT JOIN h a ON a.node_id = e.source_id LEFT JOIN h b ON b.node_id = e.target_id GROUP BY ALL ORDER BY n DESC, source, target, type LIMIT 80",
    "g_members", "g_edges",
)
def _(m):
    home = m.members.groupBy("node_id").agg(F.min("community_id").alias("c"))
    rows = m.edges.join(home.select(F.col("node_id").alias("source_id"), F.col("c").alias("a")), "source_id", "left").join(home.select(F.col("node_id").alias("target_id"), F.col("c").alias("b")), "target_id", "left")
    tally = rows.groupBy(F.coalesce("a", F.lit("none")).alias("source"), F.coalesce("b", F.lit("none")).alias("target"), "type").agg(F.count("*").alias("n"))
    return tally.orderBy(F.desc("n"), "source", "target", "type").limit(80)


@query(
    "itr_11_focus",
    ", a AS (SELECT source_id AS id FROM g_edges WHERE target_id = 'p:42' UNION SELECT target_id FROM g_edges WHERE source_id = 'p:42' UNION SELECT 'p:42') SELECT n.id, n.type, n.name FROM g_nodes n WHERE n.id IN (SELECT id FROM a)",
    "g_nodes", "g_edges",
)
def _(m):
    near = m.edges.where("target_id = 'p:42'").select(F.col("source_id").alias("id")).union(m.edges.where("source_id = 'p:42'").select("target_id")).union(m.nodes.where("id = 'p:42'").select("id")).distinct()
    return m.nodes.join(near, "id", "left_semi").select("id", "type", "name")


@query(
    "itr_04_undirected_expansion",
    """, o AS (SELECT *, CASE type WHEN 'contains' THEN 0 WHEN 'routes_to' THEN 2 WHEN 'calls' THEN 3 WHEN 'references' THEN 4 END AS o FROM g_edges), b AS (SELECT source_id AS src, target_id AS dst, o, -confidence AS c, id AS e FROM o UNION ALL SELECT target_id, source_id, o, -confidence, id FROM o),
h0 AS (SELECT 's:3' AS id, 0 AS hop, 1 AS place UNION ALL SELECT 'p:42', 0, 2),
k1 AS (SELECT dst AS id, place, o, c, e, row_number() OVER (PARTITION BY dst ORDER BY place, o, c, e) AS rn FROM b JOIN h0 ON h0.id = src WHERE dst NOT IN (SELECT id FROM h0)),
h1 AS (SELECT id, 1 AS hop, n AS place FROM (SELECT id, row_number() OVER (ORDER BY place, o, c, e) AS n FROM k1 WHERE rn = 1) WHERE n <= 118),
k2 AS (SELECT dst AS id, place, o, c, e, row_number() OVER (PARTITION BY dst ORDER BY place, o, c, e) AS rn FROM b JOIN h1 ON h1.id = src WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1)),
h2 AS (SELECT id, 2 AS hop, n AS place FROM (SELECT id, row_number() OVER (ORDER BY place, o, c, e) AS n FROM k2 WHERE rn = 1) WHERE n <= 118 - (SELECT count(*) FROM h1))
SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
    "g_edges",
)
def _(m):
    roots = m.spark.createDataFrame([("s:3", 1), ("p:42", 2)], "id string, place int")
    return G.expand_undirected(G.cut(m.edges), roots, 2, 120)


@query("itr_07_affected_refs", ", n AS (SELECT id FROM g_nodes WHERE file_path LIKE 'lib/%/part_3.py' OR file_path LIKE 'src/n1/%') SELECT id AS ref FROM n UNION SELECT id FROM g_edges WHERE source_id IN (SELECT id FROM n) OR target_id IN (SELECT id FROM n)", "g_nodes", "g_edges")
def _(m):
    files = m.nodes.where("file_path like 'lib/%/part_3.py' or file_path like 'src/n1/%'").select("file_path")
    return G.affected_refs(m.nodes, m.edges, files)


@query("agg_20_set_stats", ", s AS (SELECT id FROM g_nodes WHERE id LIKE 'c:1%' OR id LIKE 'o:1%'), x AS (SELECT source_id IN (SELECT id FROM s) AS s, target_id IN (SELECT id FROM s) AS t FROM g_edges) SELECT count(*) FILTER (s AND t) AS inside, count(*) FILTER (NOT s AND t) AS incoming, count(*) FILTER (s AND NOT t) AS outgoing FROM x", "g_nodes", "g_edges")
def _(m):
    return G.set_stats(m.edges, m.nodes.where("id like 'c:1%' or id like 'o:1%'").select("id"))


@query(
    "itr_12_drilldown",
    """, h AS (SELECT node_id AS id, min(community_id) AS c FROM g_members GROUP BY node_id), w AS (SELECT n.id, n.type, n.file_path FROM g_nodes n JOIN h ON h.id = n.id WHERE c = 'k:n3'), f AS (SELECT file_path, min(id) AS file_id FROM w WHERE type IN ('file', 'config') GROUP BY 1),
v AS (SELECT w.id, CASE WHEN type IN ('class', 'function', 'method') THEN w.id ELSE coalesce(file_id, w.id) END AS shown FROM w LEFT JOIN f ON f.file_path = w.file_path)
SELECT a.shown AS source, b.shown AS target, e.type, count(*) AS n, bool_or(e.is_inferred) AS inferred FROM g_edges e JOIN v a ON a.id = e.source_id JOIN v b ON b.id = e.target_id WHERE e.type <> 'contains' AND a.shown <> b.shown GROUP BY ALL ORDER BY n DESC, source, target, type LIMIT 140""",
    "g_nodes", "g_members", "g_edges",
)
def _(m):
    parents = m.members.groupBy(F.col("node_id").alias("id")).agg(F.min("community_id").alias("parent"))
    top = m.communities.select("id", F.lit("directory").alias("type"), F.lit("").alias("file_path"))
    return G.drilldown(m.nodes.select("id", "type", "file_path").unionByName(top), m.edges, parents, "k:n3")


@query("itr_14_pruned", ", e AS (SELECT source_id AS a, target_id AS b FROM g_links WHERE type = 'contains'), t AS (SELECT id FROM (VALUES ('n:3'), ('r:1'), ('s:7')) v(id) UNION SELECT b FROM e JOIN t ON t.id = e.a) SELECT id FROM g_nodes WHERE id NOT IN (SELECT id FROM t)", "g_nodes", "g_links")
def _(m):
    up = m.links.where("type = 'contains'").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent"))
    parents = m.nodes.select("id").join(up, "id", "left")
    return G.pruned(parents, m.spark.createDataFrame([("n:3",), ("r:1",), ("s:7",)], "id string"))


@query("itr_14_highlights", ", x AS (SELECT 'p:42' AS id, 0 AS rank UNION ALL SELECT 's:3', 0 UNION ALL SELECT source_id, 1 FROM g_edges WHERE target_id IN ('p:42', 's:3') UNION ALL SELECT target_id, 1 FROM g_edges WHERE source_id IN ('p:42', 's:3')), y AS (SELECT id, min(rank) AS rank FROM x GROUP BY id) SELECT n.id, CASE rank WHEN 0 THEN 'selected' WHEN 1 THEN 'neighbour' ELSE 'faded' END AS state FROM g_nodes n LEFT JOIN y ON y.id = n.id", "g_nodes", "g_edges")
def _(m):
    return G.highlighted(m.nodes, m.edges, m.spark.createDataFrame([("p:42",), ("s:3",)], "id string"))


@query("src_14_ordered_communities", "SELECT id, level, row_number() OVER (ORDER BY level, parent_id NULLS FIRST, name) AS place FROM g_communities", "g_communities")
def _(m):
    rows = m.communities.withColumn("above", F.coalesce("parent_id", F.lit("")))
    return O.numbered(rows, ["level", "above", "name"], "place").select("id", "level", "place")
