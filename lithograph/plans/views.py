"""The property-graph model over the driver's star schema: nodes, edges, files, chunks, vectors, runs.

The view texts use SQL that Spark and DuckDB share, so queries and their oracles read the same model.
Every view is lazy: Catalyst sees through it, prunes columns and pushes filters to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "g_nodes": """
SELECT 'r:' || CAST(r_regionkey AS STRING) AS id, 'repository' AS type, r_name AS name, '' AS file_path, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, CAST(NULL AS STRING) AS language, CAST(NULL AS TIMESTAMP) AS committed_at FROM region
UNION ALL SELECT 'n:' || CAST(n_nationkey AS STRING), 'directory', n_name, 'src/n' || CAST(n_nationkey AS STRING), NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'file', 'supplier_' || CAST(s_suppkey AS STRING) || '.py', 'src/n' || CAST(s_nationkey AS STRING) || CASE s_suppkey % 9 WHEN 0 THEN '/tests' WHEN 1 THEN '/vendor' WHEN 2 THEN '/dist' ELSE '' END || '/supplier_' || CAST(s_suppkey AS STRING) || '.py', 1, 200, 'python', NULL FROM supplier
UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), CASE c_custkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'schema' END, 'Customer' || CAST(c_custkey % 400 AS STRING), 'src/n' || CAST(c_nationkey AS STRING) || '/customer_' || CAST(c_custkey % 5 AS STRING) || '.ts', CAST(c_custkey % 300 + 1 AS INT), CAST(c_custkey % 300 + 6 + c_custkey % 40 AS INT), 'typescript', NULL FROM customer
UNION ALL SELECT 'p:' || CAST(p_partkey AS STRING), 'function', replace(lower(p_type), ' ', '_') || '_' || CAST(p_partkey % 700 AS STRING), 'lib/' || lower(replace(p_brand, '#', '_')) || '/part_' || CAST(p_partkey % 20 AS STRING) || '.py', CAST(p_partkey % 900 + 1 AS INT), CAST(p_partkey % 900 + 1 + p_size AS INT), 'python', NULL FROM part
UNION ALL SELECT 'o:' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN 'endpoint' ELSE 'method' END, 'order_' || CAST(o_orderkey AS STRING), 'app/' || lower(o_orderstatus) || '/orders_' || CAST(o_orderkey % 60 AS STRING) || '.go', CAST(o_orderkey % 700 + 1 AS INT), CAST(o_orderkey % 700 + 12 AS INT), 'go', CAST(o_orderdate AS TIMESTAMP) FROM orders""",
    # links as producers emit them: an id may come more than once, the last one counts
    "g_links": """
SELECT sha1(source_id || '|' || type || '|' || target_id) AS id, * FROM (
SELECT 'r:' || CAST(n_regionkey AS STRING) AS source_id, 'n:' || CAST(n_nationkey AS STRING) AS target_id, 'contains' AS type, 1.0E0 AS confidence, 1.0E0 AS weight, false AS is_inferred, CAST(0 AS BIGINT) AS seq FROM nation
UNION ALL SELECT 'n:' || CAST(s_nationkey AS STRING), 's:' || CAST(s_suppkey AS STRING), 'contains', 1.0E0, 1.0E0, false, CAST(0 AS BIGINT) FROM supplier
UNION ALL SELECT 'n:' || CAST(c_nationkey AS STRING), 'c:' || CAST(c_custkey AS STRING), 'contains', 1.0E0, 1.0E0, false, CAST(0 AS BIGINT) FROM customer
UNION ALL SELECT 'c:' || CAST(o_custkey AS STRING), 'o:' || CAST(o_orderkey AS STRING), 'routes_to', 0.95E0, 1.0E0, false, CAST(0 AS BIGINT) FROM orders
UNION ALL SELECT 'o:' || CAST(l_orderkey AS STRING), 'p:' || CAST(l_partkey AS STRING), 'calls', CASE WHEN l_returnflag = 'R' THEN 0.5E0 WHEN l_linestatus = 'O' THEN 0.9E0 ELSE 0.95E0 END, CAST(l_quantity AS DOUBLE), l_returnflag = 'R', l_orderkey * 10 + l_linenumber FROM lineitem
UNION ALL SELECT 's:' || CAST(l_suppkey AS STRING), 'p:' || CAST(l_partkey AS STRING), 'references', CASE WHEN l_returnflag = 'N' THEN 0.9E0 ELSE 0.5E0 END, 1.0E0, l_returnflag <> 'N', l_orderkey * 10 + l_linenumber FROM lineitem) x""",
    "g_files": "SELECT 'doc/' || lang || '/' || source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.test.js' WHEN 3 THEN '.json' ELSE '' END AS path, doc_id, lang AS language, text AS content FROM documents",
    "g_chunks": "SELECT 'k:' || CAST(p_partkey AS STRING) AS id, 'p:' || CAST(p_partkey AS STRING) AS node_id, 'lib/' || lower(replace(p_brand, '#', '_')) || '/part_' || CAST(p_partkey % 20 AS STRING) || '.py' AS file_path, CAST(p_partkey % 900 + 1 AS INT) AS start_line, CAST(p_partkey % 900 + 1 + p_size AS INT) AS end_line, p_name || ' ' || p_type AS content, CAST(3 + p_partkey % 40 AS INT) AS token_count, CAST(p_size AS DOUBLE) AS stamp FROM part",
    "g_communities": """
SELECT 'k:r' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 0 AS level, CAST(NULL AS STRING) AS parent_id FROM region
UNION ALL SELECT 'k:n' || CAST(n_nationkey AS STRING), n_name, 1, 'k:r' || CAST(n_regionkey AS STRING) FROM nation""",
    "g_members": """
SELECT 'k:n' || CAST(c_nationkey AS STRING) AS community_id, 'c:' || CAST(c_custkey AS STRING) AS node_id FROM customer
UNION ALL SELECT 'k:n' || CAST(s_nationkey AS STRING), 's:' || CAST(s_suppkey AS STRING) FROM supplier
UNION ALL SELECT 'k:n' || CAST(c_nationkey AS STRING), 'o:' || CAST(o_orderkey AS STRING) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'k:n' || CAST(p_partkey % 25 AS STRING), 'p:' || CAST(p_partkey AS STRING) FROM part""",
    "g_runs": "SELECT event_id, event_type AS task, 'm' || CAST(user_id % 4 AS STRING) AS model, user_id, ts AS created_at, event_id % 3 = 0 AS cached, CAST(event_id % 900 AS BIGINT) AS tokens_in, CAST(event_id % 70 AS BIGINT) AS tokens_out, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, props FROM events",
    "g_old": "SELECT path, sha1(content) AS sha FROM g_files WHERE doc_id % 7 <> 0",
    "g_new": "SELECT path, sha1(CASE WHEN doc_id % 13 = 0 THEN content || 'x' ELSE content END) AS sha FROM g_files WHERE doc_id % 11 <> 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a lazy DataFrame; tables and views it names are bound by reference."""
    sql = VIEWS[name]
    used = {}
    for other in [*TABLES, *VIEWS]:
        for key in ("FROM", "JOIN"):
            if f"{key} {other} " in f"{sql} ".replace("\n", " ") or f"{key} {other})" in sql:
                used[other] = table(spark, sf_dir, other) if other in TABLES else view(spark, sf_dir, other)
                sql = sql.replace(f"{key} {other}", f"{key} {{{other}}}")
    return spark.sql(sql, **used)


def with_views(sql: str, *names: str) -> str:
    """An oracle's SQL with the texts of the views it reads in front."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
