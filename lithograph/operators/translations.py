"""Translated catalogs: what to translate again, and a three-way merge of old, source and translated rows.

Both are full outer joins by slug; what a change means for the pages above it is a traversal of the tree
that joins one level a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.operators import graph as G


def plan(source: DataFrame, target: DataFrame, generated: DataFrame) -> DataFrame:
    """slug, action, stale of every page of source(slug) or target(slug, status).

    translate: it has no translation, one that is not ``generated``, or its source is in
    generated(slug), made anew; reuse: else; delete: its source is gone. stale: a translation of a page that
    is still there is not ``generated``. A slug counts once; of repeated translations the least status counts.
    """
    own = source.select("slug", F.lit(True).alias("here")).distinct()
    there = target.groupBy("slug").agg(F.min(F.coalesce("status", F.lit(""))).alias("status"))
    rows = own.join(there, "slug", "full_outer").join(generated.select("slug", F.lit(True).alias("anew")).distinct(), "slug", "left")
    action = F.when(F.col("here").isNull(), "delete").when(F.col("status").isNull() | (F.col("status") != "generated") | F.col("anew"), "translate").otherwise("reuse")
    return rows.select("slug", action.alias("action"), F.coalesce(F.col("here") & (F.col("status") != "generated"), F.lit(False)).alias("stale"))


def merged(old: DataFrame, source: DataFrame, translated: DataFrame) -> DataFrame:
    """slug, class, title, above: the three-way merge of a catalog's rows.

    old(slug, hash): the source as it was translated; source(slug, parent_slug, hash, title); translated(slug,
    title, edited). Slugs tell rows of each apart. The class of a slug that source or translated has:

    * reuse: the source is as it was; translate: there is no translation; retranslate: the source changed or
      was not known, and nobody edited the translation; conflict: both changed;
    * delete: the source is gone; orphan: it is gone, but the translation was edited.

    title: the translation's where there is one. above: the page itself is reused, but one below it is not.
    """
    mark = lambda df, n, *c: df.select("slug", F.struct(F.lit(True).alias("has"), *c).alias(n))
    rows = mark(source, "s", "hash", "title", "parent_slug").join(mark(translated, "t", "title", "edited"), "slug", "full_outer").join(mark(old, "o", "hash"), "slug", "left")
    edited, same = F.coalesce("t.edited", F.lit(False)), F.col("o.hash").eqNullSafe(F.col("s.hash")) & F.col("o").isNotNull()
    kind = (
        F.when(F.col("s").isNull(), F.when(edited, "orphan").otherwise("delete"))
        .when(F.col("t").isNull(), "translate")
        .when(same, "reuse")
        .otherwise(F.when(edited, "conflict").otherwise("retranslate"))
    )
    rows = G.cut(rows.select("slug", kind.alias("class"), F.coalesce("t.title", "s.title").alias("title"), F.col("s.parent_slug").alias("parent_slug")))
    # up the tree of old and new rows: a page that is gone no longer says where it stood, so only source rows carry on
    links = rows.where("parent_slug is not null").select(F.col("slug").alias("src"), F.col("parent_slug").alias("dst"))
    changed = rows.where("class not in ('reuse', 'delete', 'orphan')").select(F.col("slug").alias("id"))
    over = G.reachable(links, changed).where("depth > 0").select(F.col("id").alias("slug")).union(links.join(changed.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("slug"))).distinct()
    out = rows.join(over.withColumn("over", F.lit(True)), "slug", "left")
    return out.select("slug", "class", "title", (F.coalesce("over", F.lit(False)) & (F.col("class") == "reuse")).alias("above"))
