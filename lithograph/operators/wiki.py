"""Pages, their catalog and what diagrams are drawn from: joins on slugs and citations, greedy picks of bounded lists."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.scalars import citations
from lithograph.operators.graph import lookup

# Weights of edge types between components and in symbol flows; how much a diagram shows.
COMPONENT_WEIGHTS = {"routes_to": 6.0, "calls": 4.5, "imports": 3.5, "uses_config": 3.0, "inherits": 2.8, "implements": 2.6, "exports": 1.8, "references": 1.4}
FLOW_WEIGHTS = {"routes_to": 7.0, "calls": 6.0, "uses_config": 4.0, "imports": 3.5, "inherits": 3.2, "implements": 3.0, "references": 2.0}
COMPONENTS, COMPONENT_EDGES, FLOW_NODES, FLOW_EDGES = 12, 18, 14, 14


def picked(rows: DataFrame, order: list, source: str, target: str, nodes: int, edges: int, page: int = 500) -> DataFrame:
    """The edges that a greedy pick in order takes, with their place: at most ``edges`` that touch at most ``nodes`` ends.

    An edge that would bring too many ends is skipped, and once it is it can never fit later. So each
    round asks for the first ``page`` rows that still fit, which takes one of them at least: exact over
    all rows in at most ``edges`` rounds. Equal rows are edges of their own; rows without an end are left out.
    """
    rows = rows.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    seen: list = []
    taken: list = []
    while len(taken) < edges:
        fits = rows
        if taken:
            new = lambda c: (~F.col(c).isin(seen)).cast("int")  # noqa: B023, E731
            fits = rows.where(new(source) + F.when(F.col(source) == F.col(target), 0).otherwise(new(target)) <= nodes - len(seen))
        had, before = Counter(map(tuple, taken)), len(taken)
        found = fits.orderBy(*order).limit(page + before).collect()  # bounded by page and edges
        for r in found:
            if had[tuple(r)] > 0:
                had[tuple(r)] -= 1
                continue
            ends = [x for x in dict.fromkeys((r[source], r[target])) if x not in seen]
            if len(taken) < edges and (not taken or len(seen) + len(ends) <= nodes):
                taken.append(r)
                seen += ends
        if len(taken) == before or len(found) < page + before:
            break
    data = [(i, *r) for i, r in enumerate(taken, 1)]
    return rows.sparkSession.createDataFrame(data, "place int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def component_edges(edges: DataFrame, home: DataFrame) -> DataFrame:
    """The edges between groups that a component diagram shows: source, target, n, confidence, score, place; home(id, grp).

    A pair's score is the sum of its types' weights times their counts (4 at most), and the mean confidence.
    """
    kinds = edges.where(F.col("type").isin(list(COMPONENT_WEIGHTS)))
    for side in ("source", "target"):
        kinds = kinds.join(home.select(F.col("id").alias(f"{side}_id"), F.col("grp").alias(side)), f"{side}_id")
    by_type = kinds.where("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    value = lookup(COMPONENT_WEIGHTS, F.col("type"), 0.0) * F.least(F.col("n"), F.lit(4))
    pairs = by_type.groupBy("source", "target").agg(F.sum("n").alias("n"), F.bround(F.sum("c") / F.sum("n"), 4).alias("confidence"), F.bround(F.sum(value) + F.sum("c") / F.sum("n"), 4).alias("score"))
    return picked(pairs, [F.desc("score"), "source", "target"], "source", "target", COMPONENTS, COMPONENT_EDGES)


def symbol_flow(edges: DataFrame) -> DataFrame:
    """The edges that a symbol-flow diagram shows, by type's weight and confidence."""
    score = lookup(FLOW_WEIGHTS, F.col("type"), 1.0) + F.col("confidence")
    rows = edges.where(F.col("type").isin(list(FLOW_WEIGHTS))).select("id", "source_id", "target_id", "type", score.alias("score"))
    return picked(rows, [F.desc("score"), "source_id", "target_id", "id"], "source_id", "target_id", FLOW_NODES, FLOW_EDGES)


def inventory(chunks: DataFrame, most: int = 12) -> DataFrame:
    """files, chunks, first_files of chunks(file_path, rank): counts and the first files in order of rank."""
    by_file = chunks.groupBy("file_path").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    first = by_file.orderBy("first", "file_path").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "file_path"))), lambda x: x["file_path"]), ",").alias("first_files"))
    return by_file.agg(F.count("*").alias("files"), F.sum("n").alias("chunks")).crossJoin(first)


def related_pages(catalog: DataFrame, slug: str, parent: str | None, most: int = 12) -> DataFrame:
    """The pages next to one: those of its parent first, then by depth, order and title; with their place."""
    near = F.when(F.col("parent_slug").eqNullSafe(F.lit(parent)), 0).otherwise(1)
    rows = catalog.where((F.col("kind") == "page") & (F.col("slug") != slug)).withColumn("near", near)
    order = ["near", "depth", "ord", "title", "slug"]
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("near")


def catalog_context(catalog: DataFrame, slug: str) -> DataFrame:
    """current, parent (titles), page_count: where a page stands in its catalog."""
    own = catalog.where(F.col("slug") == slug).orderBy("title").limit(1).select(F.col("title").alias("current"), "parent_slug")
    above = catalog.select(F.col("slug").alias("parent_slug"), F.col("title").alias("parent"))
    return own.join(above, "parent_slug", "left").select("current", "parent").crossJoin(catalog.agg(F.count_if(F.col("kind") == "page").alias("page_count")))


def missing_pages(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """slug of the catalog's pages that are not written."""
    return catalog.where("kind = 'page'").join(pages.select("slug").distinct(), "slug", "left_anti").select("slug")


def with_state(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """The catalog's rows with the state of their page, missing where there is none; pages(slug, state)."""
    return catalog.join(pages, "slug", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def cited(pages: DataFrame, key: str, refs: DataFrame) -> DataFrame:
    """key, citation_id and the columns of refs(citation_id, ..) that a page's markdown cites; unknown citations have no row."""
    return pages.select(key, F.explode(citations(F.col("markdown"))).alias("citation_id")).join(refs, "citation_id")


def resolve_repos(repos: DataFrame, asked: DataFrame) -> DataFrame:
    """selector, id: by id, exact name, beginning of an id, path or URL, the first of these that has a repository.

    A rule that finds several repositories resolves to none (null), as does a selector that none knows.
    """
    rank = (
        F.when(F.col("r.id") == F.col("selector"), 0)
        .when(F.col("r.name") == F.col("selector"), 1)
        .when(F.startswith("r.id", F.col("selector")), 2)
        .when(F.col("r.path") == F.col("selector"), 3)
        .when(F.col("r.git_url") == F.col("selector"), 4)
    )
    hits = F.broadcast(asked).join(repos.alias("r"), rank.isNotNull()).select("selector", F.col("r.id").alias("id"), rank.alias("rank"))
    best = hits.groupBy("selector", "rank").agg(F.count("*").alias("n"), F.min("id").alias("id")).groupBy("selector").agg(F.min_by(F.when(F.col("n") == 1, F.col("id")), "rank").alias("id"))
    return asked.join(best, "selector", "left")
