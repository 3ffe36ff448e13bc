"""Further queries: range joins, ladders, rollups, catalog trees, documents built from graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithograph.functions import fuzzy as FU
from lithograph.functions import scalars as S
from lithograph.operators import community as C
from lithograph.operators import graph as G
from lithograph.operators import ranges as RG
from lithograph.plans.registry import query


@query("itr_08_communities")
def _(m):
    """The hierarchy of the whole graph, all edge types with their weights: every community of it."""
    communities, _members = C.hierarchy(m.nodes, m.edges)
    return communities


BEST_SYMBOL_FOR_RANGE = """, r AS (SELECT p_partkey AS ref, 'lib/' || lower(replace(p_brand, '#', '_')) || '/part_' || CAST(p_partkey % 20 AS STRING) || '.py' AS file_path, CAST(p_partkey % 890 + 2 AS INT) AS s, CAST(p_partkey % 890 + 8 AS INT) AS e FROM part),
x AS (SELECT ref, n.id, end_line - start_line AS span, start_line <= s AND e <= end_line AS holds, least(e, end_line) - greatest(s, start_line) + 1 AS shared, e - s + 1 AS own, end_line - start_line + 1 AS size FROM r JOIN g_nodes n ON n.file_path = r.file_path AND n.type = 'function' AND start_line <= e AND s <= end_line)
SELECT ref, id, holds FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY holds DESC, CASE WHEN holds THEN span ELSE -shared END, id) AS rn FROM x WHERE holds OR (size <= 80 AND shared >= 3 AND (shared * 2 >= own OR shared * 4 >= size * 3))) WHERE rn = 1"""


def best_symbol_for_range(m, rows):
    path = F.concat(F.lit("lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/part_"), (F.col("p_partkey") % 20).cast("string"), F.lit(".py"))
    refs = rows.select(F.col("p_partkey").alias("ref"), path.alias("file_path"), (F.col("p_partkey") % 890 + 2).cast("int").alias("s"), (F.col("p_partkey") % 890 + 8).cast("int").alias("e"))
    spans = m.nodes.where("type = 'function'").groupBy("file_path", "start_line", "end_line").agg(F.min("id").alias("id"))
    near = RG.meeting(refs.select("file_path", "s", "e").distinct(), spans, "file_path").where("start_line <= e and s <= end_line")
    near = near.withColumns({"holds": F.expr(RG.HOLDS), "shared": F.expr("least(e, end_line) - greatest(s, start_line) + 1"), "own": F.expr("e - s + 1"), "size": F.expr("end_line - start_line + 1")})
    near = near.where("holds or (size <= 80 and shared >= 3 and (shared * 2 >= own or shared * 4 >= size * 3))")
    rank = F.struct((~F.col("holds")).alias("h"), F.when(F.col("holds"), F.col("size") - 1).otherwise(-F.col("shared")).alias("d"), F.col("id").alias("i"))
    best = near.groupBy("file_path", "s", "e").agg(F.min(rank).alias("x"))  # of a range; refs of the same range share it
    found = refs.join(best, ["file_path", "s", "e"]).groupBy("ref").agg(F.min("x").alias("x"))
    return found.select("ref", F.col("x.i").alias("id"), (~F.col("x.h")).alias("holds"))


@query("jn_11_best_symbol_for_range", BEST_SYMBOL_FOR_RANGE, "g_nodes")
def _(m):
    return best_symbol_for_range(m, m.part)


CITED_RANGES = ", c AS (SELECT id, file_path, start_line, end_line FROM g_nodes WHERE type = 'method'), q AS (SELECT o_orderkey AS cite, 'app/' || lower(o_orderstatus) || '/orders_' || CAST(o_orderkey % 60 AS STRING) || '.go' AS file_path, CAST(o_orderkey % 700 + 3 AS INT) AS s, CAST(o_orderkey % 700 + 9 AS INT) AS e FROM orders) SELECT cite, count(*) AS chunks, min(c.id) AS first FROM q JOIN c ON c.file_path = q.file_path AND c.start_line <= q.s AND q.e <= c.end_line GROUP BY cite"


def cited_ranges(m, rows):
    k = F.col("o_orderkey")
    cites = rows.select(k.alias("cite"), F.concat(F.lit("app/"), F.lower("o_orderstatus"), F.lit("/orders_"), (k % 60).cast("string"), F.lit(".go")).alias("file_path"), (k % 700 + 3).cast("int").alias("s"), (k % 700 + 9).cast("int").alias("e"))
    spans = m.nodes.where("type = 'method'").groupBy("file_path", "start_line", "end_line").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    inside = RG.meeting(cites.select("file_path", "s", "e").distinct(), spans, "file_path").where(RG.HOLDS)
    held = inside.groupBy("file_path", "s", "e").agg(F.sum("n").alias("chunks"), F.min("id").alias("first"))
    return cites.join(held, ["file_path", "s", "e"]).groupBy("cite").agg(F.sum("chunks").alias("chunks"), F.min("first").alias("first"))


@query("jn_12_cited_ranges", CITED_RANGES, "g_nodes")
def _(m):
    return cited_ranges(m, m.orders)


NODE_OR_FILE = ", f AS (SELECT file_path, min(id) AS file_id FROM g_nodes WHERE type = 'file' GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(n.id, f.file_id) AS node_id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) l LEFT JOIN g_nodes n ON n.id = 'x:' || CAST(l_orderkey AS STRING) LEFT JOIN g_nodes s ON s.id = 's:' || CAST(l_suppkey AS STRING) LEFT JOIN f ON f.file_path = s.file_path"


def node_or_file(m, rows):
    rows = rows.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    rows = rows.select("l_orderkey", "l_linenumber", F.concat(F.lit("x:"), F.col("l_orderkey").cast("string")).alias("own"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("sid"))
    files = m.nodes.where("type = 'file'").groupBy("file_path").agg(F.min("id").alias("file_id"))
    paths = m.nodes.select(F.col("id").alias("sid"), "file_path")
    out = rows.join(m.nodes.select(F.col("id").alias("own"), F.col("id").alias("hit")), "own", "left").join(paths, "sid", "left").join(files, "file_path", "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("hit", "file_id").alias("node_id"))


@query("jn_15_node_or_file", NODE_OR_FILE, "g_nodes")
def _(m):
    return node_or_file(m, m.lineitem)


SUBSTRING_MATCH = "SELECT b.item_id AS term_id, count(*) AS nodes FROM (SELECT item_id, 'brand_' || CAST(item_id % 25 + 1 AS STRING) AS term FROM benchmark) b JOIN g_nodes n ON contains(n.file_path, b.term) GROUP BY b.item_id"


def substring_match(m, items):
    """Distinct paths against blocks of distinct terms: a pair is a row only where it matches."""
    named = items.select(F.col("item_id").alias("term_id"), F.concat(F.lit("brand_"), (F.col("item_id") % 25 + 1).cast("string")).alias("term"))
    blocks = named.select("term").distinct().groupBy(F.pmod(F.xxhash64("term"), F.lit(64)).alias("block")).agg(F.collect_list("term").alias("terms"))
    paths = m.nodes.groupBy("file_path").agg(F.count("*").alias("n"))
    hits = paths.crossJoin(blocks).select("n", F.explode(F.filter("terms", lambda t: F.contains("file_path", t))).alias("term"))
    return named.join(hits.groupBy("term").agg(F.sum("n").alias("nodes")), "term").groupBy("term_id").agg(F.sum("nodes").alias("nodes"))


@query("jn_09_substring_match", SUBSTRING_MATCH, "g_nodes")
def _(m):
    return substring_match(m, m.benchmark)


@query(
    "agg_09_scale_profile",
    ", c AS (SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_links) AS edges, (SELECT count(*) FROM documents) AS chunks) SELECT CASE greatest(CASE WHEN nodes < 100 THEN 0 WHEN nodes < 1000 THEN 1 WHEN nodes < 10000 THEN 2 ELSE 3 END, CASE WHEN edges < 300 THEN 0 WHEN edges < 3000 THEN 1 WHEN edges < 30000 THEN 2 ELSE 3 END, CASE WHEN chunks < 100 THEN 0 WHEN chunks < 800 THEN 1 WHEN chunks < 5000 THEN 2 ELSE 3 END) WHEN 0 THEN 'tiny' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END AS profile FROM c",
    "g_nodes", "g_links",
)
def _(m):
    def bucket(n, limits):
        out = F.when(n < limits[0], 0)
        for i, x in enumerate(limits[1:], 1):
            out = out.when(n < x, i)
        return out.otherwise(len(limits))

    counts = m.nodes.agg(F.count("*").alias("nodes")).crossJoin(m.links.agg(F.count("*").alias("edges"))).crossJoin(m.documents.agg(F.count("*").alias("chunks")))
    top = F.greatest(bucket(F.col("nodes"), [100, 1000, 10000]), bucket(F.col("edges"), [300, 3000, 30000]), bucket(F.col("chunks"), [100, 800, 5000]))
    return counts.select(G.lookup({0: "tiny", 1: "small", 2: "medium"}, top, "large").alias("profile"))


@query(
    "agg_15_component_edges",
    ", n AS (SELECT id, split_part(file_path, '/', 1) AS grp FROM g_nodes WHERE file_path <> '') SELECT a.grp AS source, b.grp AS target, count(*) FILTER (e.type = 'calls') AS calls, count(*) FILTER (e.type = 'references') AS refs, count(*) FILTER (e.type = 'routes_to') AS routes, count(*) AS n FROM g_edges e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE a.grp <> b.grp GROUP BY ALL",
    "g_nodes", "g_edges",
)
def _(m):
    home = m.nodes.where("file_path <> ''").select("id", F.substring_index("file_path", "/", 1).alias("grp"))
    rows = m.edges.join(home.select(F.col("id").alias("source_id"), F.col("grp").alias("source")), "source_id").join(home.select(F.col("id").alias("target_id"), F.col("grp").alias("target")), "target_id").where("source <> target")
    return rows.groupBy("source", "target").agg(F.count_if(F.col("type") == "calls").alias("calls"), F.count_if(F.col("type") == "references").alias("refs"), F.count_if(F.col("type") == "routes_to").alias("routes"), F.count("*").alias("n"))


@query(
    "agg_21_community_ranking",
    ", h AS (SELECT node_id, min(community_id) AS c FROM g_members GROUP BY node_id), e AS (SELECT a.c AS s, b.c AS t FROM g_edges x JOIN h a ON a.node_id = x.source_id JOIN h b ON b.node_id = x.target_id), p AS (SELECT s AS c, CASE WHEN s = t THEN 0.15 ELSE 1 END AS w FROM e UNION ALL SELECT t, 1 FROM e WHERE s <> t) SELECT c AS community, round(CAST(sum(w) AS DOUBLE), 4) AS score, count(*) AS ends FROM p GROUP BY c",
    "g_members", "g_edges",
)
def _(m):
    home = m.members.groupBy("node_id").agg(F.min("community_id").alias("c"))
    e = m.edges.join(home.select(F.col("node_id").alias("source_id"), F.col("c").alias("s")), "source_id").join(home.select(F.col("node_id").alias("target_id"), F.col("c").alias("t")), "target_id").select("s", "t")
    inner = F.expr("cast(case when s = t then 0.15 else 1 end as decimal(10, 2))")
    ends = e.select(F.col("s").alias("community"), inner.alias("w")).unionAll(e.where("s <> t").select("t", F.expr("cast(1 as decimal(10, 2))")))
    return ends.groupBy("community").agg(F.round(F.sum("w").cast("double"), 4).alias("score"), F.count("*").alias("ends"))


@query(
    "agg_24_file_portals",
    ", x AS (SELECT CASE WHEN a.file_path = 'lib/brand_7/part_3.py' THEN 'out' ELSE 'in' END AS way, CASE WHEN a.file_path = 'lib/brand_7/part_3.py' THEN b.file_path ELSE a.file_path END AS other, e.type FROM g_edges e JOIN g_nodes a ON a.id = e.source_id JOIN g_nodes b ON b.id = e.target_id WHERE (a.file_path = 'lib/brand_7/part_3.py') <> (b.file_path = 'lib/brand_7/part_3.py')), c AS (SELECT way, other, type, count(*) AS n FROM x GROUP BY ALL) SELECT way, other, type, n FROM (SELECT *, row_number() OVER (PARTITION BY way ORDER BY n DESC, other, type) AS rn FROM c) WHERE rn <= 14",
    "g_nodes", "g_edges",
)
def _(m):
    from lithograph.operators.ordered import capped

    here = F.lit("lib/brand_7/part_3.py")
    path = lambda side, n: m.nodes.select(F.col("id").alias(f"{side}_id"), F.col("file_path").alias(n))
    rows = m.edges.join(path("source", "a"), "source_id").join(path("target", "b"), "target_id").where((F.col("a") == here) != (F.col("b") == here))
    tally = rows.groupBy(F.when(F.col("a") == here, "out").otherwise("in").alias("way"), F.when(F.col("a") == here, F.col("b")).otherwise(F.col("a")).alias("other"), "type").agg(F.count("*").alias("n"))
    return capped(tally, "way", [F.desc("n"), F.col("other"), F.col("type")], 14).select("way", "other", "type", "n")


@query("agg_25_unresolved", "SELECT source_id, target_id FROM g_edges WHERE type = 'references' AND target_id NOT IN (SELECT id FROM g_nodes WHERE file_path LIKE 'lib/brand_1%')", "g_nodes", "g_edges")
def _(m):
    known = m.nodes.where("file_path like 'lib/brand_1%'").select(F.col("id").alias("target_id"))
    return m.edges.where("type = 'references'").join(known, "target_id", "left_anti").select("source_id", "target_id")


@query("agg_27_grouped_refs", "SELECT source, doc_id AS ref, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def _(m):
    # dealt by ranges, so that a source of many refs is many tasks': a place is that in its range plus the refs before
    dealt = m.documents.select("source", F.col("doc_id").alias("ref")).repartitionByRange("source", "ref")
    rows = G.cut(dealt.withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy(F.col("source").alias("own"), F.col("part").alias("at")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("inside", F.row_number().over(Window.partitionBy("source", "part").orderBy("ref")))
    return placed.join(before, F.col("source").eqNullSafe(F.col("own")) & (F.col("part") == F.col("at"))).select("source", "ref", (F.col("before") + F.col("inside")).alias("place"))


@query("agg_29_graph_refs", ", x AS (SELECT id FROM g_edges WHERE type = 'contains' UNION SELECT source_id FROM g_edges WHERE type = 'contains' UNION SELECT target_id FROM g_edges WHERE type = 'contains') SELECT count(*) AS refs FROM x", "g_edges")
def _(m):
    e = m.edges.where("type = 'contains'")
    return e.select(F.explode(F.array("id", "source_id", "target_id")).alias("ref")).distinct().agg(F.count("*").alias("refs"))


@query("win_09_stratified_quota", ", s AS (SELECT c.id, c.level, coalesce(count(node_id), 0) AS size FROM g_communities c LEFT JOIN g_members m ON m.community_id = c.id GROUP BY c.id, c.level), t AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY size DESC, id) AS turn FROM s) SELECT id, level, turn FROM t ORDER BY turn, level, id LIMIT 12", "g_communities", "g_members")
def _(m):
    sizes = m.members.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size"))
    return C.naming_targets(m.communities.join(sizes, "id", "left").fillna(0, ["size"]), 12).select("id", "level", "turn")


@query("win_10_ordered_unique", "SELECT source, row_number() OVER (ORDER BY first) AS place FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)")
def _(m):
    from lithograph.operators.ordered import numbered

    return numbered(m.documents.groupBy("source").agg(F.min("doc_id").alias("first")), ["first"], "place").select("source", "place")


@query("win_15_reassembled", "SELECT conv_id, sha1(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(m):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return m.conversations.groupBy("conv_id").agg(F.sha1(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n")).alias("digest"), F.count("*").alias("turns"))


@query("itr_15_dirty_ancestors", ", d AS (SELECT 'k:n' || CAST(c_nationkey AS STRING) AS id FROM customer WHERE c_custkey % 97 = 0), t AS (SELECT id FROM d UNION SELECT c.parent_id FROM t JOIN g_communities c ON c.id = t.id WHERE c.parent_id IS NOT NULL) SELECT DISTINCT id FROM t", "g_communities")
def _(m):
    dirty = m.customer.where("c_custkey % 97 = 0").select(F.concat(F.lit("k:n"), F.col("c_nationkey").cast("string")).alias("id")).distinct()
    up = m.communities.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return G.reachable(up, dirty).select("id")


@query("str_05_stale_pages", "SELECT page_id AS slug, CASE WHEN page_id % 40 IN (SELECT doc_id FROM documents WHERE doc_id % 13 = 0) OR page_id % 17 = 3 THEN 'draft' ELSE 'published' END AS status FROM pages")
def _(m):
    from lithograph.operators.incremental import stale_pages

    path = lambda c: F.concat(F.lit("f/"), c.cast("string"))
    pages = m.pages.select(F.col("page_id").alias("slug"), F.lit("published").alias("status"), F.array(path(F.col("page_id") % 40), F.lit("f/x")).alias("source_files"), F.array(F.concat(F.lit("ref"), (F.col("page_id") % 17).cast("string"))).alias("graph_refs"))
    files = m.documents.where("doc_id % 13 = 0").select(path(F.col("doc_id")).alias("path"))
    return stale_pages(pages, files, m.spark.createDataFrame([("ref3",), ("ref99",)], "ref string")).select("slug", "status")


@query("flt_14_symbol_match", ", x AS (SELECT id, CASE WHEN id = 'customer7' THEN 0 WHEN lower(name) = 'customer7' THEN 1 WHEN ends_with(lower(name), 'customer7') THEN 2 WHEN contains(lower(name), 'customer7') THEN 3 END AS p FROM g_nodes) SELECT id FROM x WHERE p = (SELECT min(p) FROM x)", "g_nodes")
def _(m):
    name = F.lower("name")
    rank = F.when(F.col("id") == "customer7", 0).when(name == "customer7", 1).when(F.endswith(name, F.lit("customer7")), 2).when(F.contains(name, F.lit("customer7")), 3)
    hits = m.nodes.select("id", rank.alias("p")).where("p is not null")
    best = hits.agg(F.min("p").alias("p"))
    return hits.join(F.broadcast(best), "p").select("id")


@query("flt_15_source_hints", "SELECT h.hint, count(*) AS files FROM (VALUES ('doc/en'), ('doc/fr/src1'), ('doc/de')) h(hint) JOIN g_files f ON f.path = h.hint OR starts_with(f.path, h.hint || '/') GROUP BY h.hint", "g_files")
def _(m):
    hints = m.spark.createDataFrame([("doc/en",), ("doc/fr/src1",), ("doc/de",)], "hint string")
    return m.files.join(F.broadcast(hints), (F.col("path") == F.col("hint")) | F.startswith("path", F.concat("hint", F.lit("/")))).groupBy("hint").agg(F.count("*").alias("files"))


@query("flt_18_fuzzy", "SELECT p_partkey, levenshtein(lower(p_name), 'red widgit') AS distance FROM part WHERE levenshtein(lower(p_name), 'red widgit') / greatest(length(p_name), 10) <= 0.34")
def _(m):
    d = F.levenshtein(F.lower("p_name"), F.lit("red widgit"))
    return m.part.select("p_partkey", "p_name", d.alias("distance")).where(F.col("distance") / F.greatest(F.length("p_name"), F.lit(10)) <= 0.34).select("p_partkey", "distance")


#: Every part of a text against the pattern, by its start and length.
PARTS = "WITH{views} t AS ({rows}), p AS (SELECT id, text, unnest(range(1, length(text) + 1)) AS b FROM t), q AS (SELECT id, substr(text, CAST(b AS INTEGER), CAST(n AS INTEGER)) AS part FROM (SELECT *, unnest(range(1, {most})) AS n FROM p)) SELECT id, CAST(min(levenshtein(lower(part), '{pattern}')) AS INTEGER) AS edits FROM q GROUP BY id HAVING min(levenshtein(lower(part), '{pattern}')) <= {allowed}"


@query("flt_18_fuzzy_names", PARTS.format(views="", rows="SELECT p_partkey AS id, p_name AS text FROM part", most=14, pattern="red widgit", allowed=3))
def _(m):
    return m.part.where(FU.matches(F.col("p_name"), "red widgit")).select(F.col("p_partkey").alias("id"), FU.edits(F.col("p_name"), "red widgit").alias("edits"))


@query("flt_18_fuzzy_paths", ", " + PARTS.format(views="", rows="SELECT DISTINCT file_path AS id, file_path AS text FROM g_nodes WHERE file_path <> ''", most=18, pattern="suplier_12.py", allowed=4).removeprefix("WITH "), "g_nodes")
def _(m):
    paths = m.nodes.where("file_path <> ''").select(F.col("file_path").alias("id")).distinct()
    return paths.where(FU.matches(F.col("id"), "suplier_12.py", FU.LOOSE)).select("id", FU.edits(F.col("id"), "suplier_12.py").alias("edits"))


@query("qry_16_file_tree", ", d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path FROM g_files) SELECT dir, count(*) AS files, min(split_part(path, '/', -1)) AS first FROM d GROUP BY dir", "g_files")
def _(m):
    return m.files.groupBy(S.parent_dir(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.min(S.base_name(F.col("path"))).alias("first"))


@query("qry_21_nested_communities", "SELECT p.id, p.name, array_to_string(list_sort(list(c.name)), ',') AS children FROM g_communities p JOIN g_communities c ON c.parent_id = p.id GROUP BY p.id, p.name", "g_communities")
def _(m):
    kids = m.communities.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("children"))
    return m.communities.select("id", "name").join(kids, "id")


@query("qry_14_community_names", ", x AS (SELECT community_id, max(size) AS n FROM (SELECT community_id, split_part(node_id, ':', 1) AS kind, count(*) AS size FROM g_members GROUP BY ALL) GROUP BY community_id) SELECT c.id, c.name || ' (' || CAST(x.n AS STRING) || ' nodes)' AS summary FROM g_communities c JOIN x ON x.community_id = c.id", "g_communities", "g_members")
def _(m):
    top = m.members.groupBy("community_id", F.substring_index("node_id", ":", 1).alias("kind")).count().groupBy(F.col("community_id").alias("id")).agg(F.max("count").alias("n"))
    return m.communities.join(top, "id").select("id", F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(" nodes)")).alias("summary"))


@query("scl_08_times", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def _(m):
    return m.events.select("event_id", S.epoch(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("seconds"))


@query("scl_09_integers", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def _(m):
    return m.events.select("event_id", S.integer_or(F.get_json_object("props", "$.k"), -1).alias("k"))


@query("scl_16_diagram_labels", "SELECT p_partkey, substr(replace(replace(p_name || ' \"x\" | y', '\"', ''''), '|', '/'), 1, 80) AS label FROM part")
def _(m):
    return m.part.select("p_partkey", S.diagram_label(F.concat("p_name", F.lit(' "x" | y'))).alias("label"))


@query("scl_17_redaction", "SELECT doc_id, 'key [redacted] Authorization: Bearer [redacted] api_key=[redacted], n' || CAST(doc_id AS STRING) AS text FROM documents")
def _(m):
    text = F.concat(F.lit("key sk-abcdefgh12345678 Authorization: Bearer abc.def-1 api_key=s3cr3t, n"), F.col("doc_id").cast("string"))
    return m.documents.select("doc_id", S.redacted(text).alias("text"))


@query("scl_19_json_in_text", "SELECT event_id, regexp_extract('noise ' || props || ' tail', '(?s)\\{.*\\}') AS found FROM events")
def _(m):
    return m.events.select("event_id", S.json_object(F.concat(F.lit("noise "), "props", F.lit(" tail"))).alias("found"))


@query("scl_22_line_labels", "SELECT id, CASE WHEN start_line IS NULL THEN '' WHEN end_line IS NULL OR end_line = start_line THEN 'L' || CAST(start_line AS STRING) ELSE 'L' || CAST(start_line AS STRING) || '-L' || CAST(end_line AS STRING) END AS label FROM g_nodes", "g_nodes")
def _(m):
    return m.nodes.select("id", S.line_label(F.col("start_line"), F.col("end_line")).alias("label"))


@query("scl_23_routes", "SELECT p_partkey, '/api/' || replace(p_name, ' ', '-') AS route FROM part")
def _(m):
    return m.part.select("p_partkey", S.joined_route(F.lit("/api/"), F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"))).alias("route"))


#: What stands in code, and the configuration files of a repository.
CONFIG_NAMED = ["app.settings", "env", "config/dev", "process.env", "plain", "getenv"]
CONFIG_PATHS = [("config/dev.yaml", "runtime"), ("deploy/.env", "environment"), ("app/settings.py", "runtime"), ("package.json", "package_manifest")]
CONFIG_SQL = f"""WITH v AS (SELECT doc_id AS "user", ([{', '.join(f"'{x}'" for x in CONFIG_NAMED)}])[doc_id % 6 + 1] AS v FROM documents), c(path, kind) AS (VALUES {', '.join(f"('{p}', '{k}')" for p, k in CONFIG_PATHS)})
SELECT DISTINCT "user", path FROM v, c WHERE regexp_matches(v, 'config|dotenv|env|process|settings|load') AND (contains(path, v) OR len(list_filter(string_split(v, '/'), lambda x: x <> '' AND contains(path, x))) > 0 OR (contains(v, 'env') AND (ends_with(path, '.env') OR kind = 'environment')) OR (regexp_matches(v, 'config|settings') AND regexp_matches(path, 'config|settings')))"""


@query("gra_16_config_uses", CONFIG_SQL)
def _(m):
    from lithograph.operators.ingest import config_uses

    value = F.element_at(F.array(*map(F.lit, CONFIG_NAMED)), (F.col("doc_id") % 6 + 1).cast("int"))
    configs = m.spark.createDataFrame(CONFIG_PATHS, "path string, kind string")
    return config_uses(m.documents.select(F.col("doc_id").alias("user"), value.alias("value")), configs)


@query("src_07_hash_reuse", "SELECT n.path, CASE WHEN o.path IS NOT NULL AND n.doc_id % 4 <> 0 AND n.doc_id % 6 <> 0 THEN 'known' ELSE sha1(n.content) END AS sha FROM g_files n LEFT JOIN g_old o ON o.path = n.path", "g_files", "g_old")
def _(m):
    from lithograph.operators.ingest import hashed

    k = F.col("doc_id")
    known = m.old.select("path", F.lit("known").alias("sha")).join(m.files.select("path", F.length("content").alias("size"), F.when(k % 4 == 0, 1).otherwise(2).alias("mtime")), "path")
    now = m.files.select("path", "content", F.length("content").alias("size"), F.lit(2).alias("mtime"))
    return hashed(now, known, m.files.where("doc_id % 6 = 0").select("path"), F.sha1("content"))


@query("evt_last_per_user", "SELECT user_id, max(ts) AS last FROM events GROUP BY user_id")
def _(m):
    return m.events.groupBy("user_id").agg(F.max("ts").alias("last"))
