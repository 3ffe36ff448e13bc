"""Operators on property graphs: nodes(id, type, name, ..), edges(id, source_id, target_id, type, ..).

Traversals are loops over frontiers: each step joins the frontier (small next to the edges) with the
edges and is written to the shared checkpoint folder by ``checkpoint()``, so plans stay short and a
lost executor costs one step. Edges are never collected.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Edge types of flows, of impact and of file dependence, and node types that contain others.
FLOW_TYPES = ["calls", "references", "routes_to"]
IMPACT_TYPES = ["calls", "references", "routes_to", "imports", "inherits", "implements", "uses_config"]
CONTAINER_TYPES = ["repository", "directory", "file", "config", "class", "interface", "schema"]
# Weights of edge types in decayed expansion, and the order of types in breadth-first search.
EDGE_WEIGHTS = {"calls": 1.0, "routes_to": 1.0, "inherits": 0.9, "implements": 0.86, "imports": 0.82, "exports": 0.78, "references": 0.7, "uses_config": 0.66, "defines": 0.72, "contains": 0.58}
EDGE_ORDER = {"contains": 0, "defines": 1, "routes_to": 2, "calls": 3, "references": 4, "imports": 5, "inherits": 6, "implements": 6}
OTHER_WEIGHT, OTHER_ORDER, DECAY = 0.35, 9, 0.78
# The kinds of community edges.
COMMUNITY_TYPES = {"calls": "calls_into", "imports": "imports_from", "exports": "imports_from", "routes_to": "routes_to"}


def lookup(values: dict, key: Column, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local master, which has one machine, may leave it unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lithograph-")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def last_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: max_by aggregates map-side, so a hot key never meets in one sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def neighbours(nodes: DataFrame, edges: DataFrame, picked: DataFrame, outgoing: bool, types: list[str]) -> DataFrame:
    """Callers or callees of the picked ids: one row for each source, target and type."""
    here, there = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    near = edges.where(F.col("type").isin(types)).join(picked.select(F.col("id").alias(here)), here, "left_semi")
    near = near.dropDuplicates(["source_id", "target_id", "type"])
    return near.join(nodes.select(F.col("id").alias(there), F.col("name").alias("other_name"), F.col("file_path").alias("other_path")), there)


def end_counts(edges: DataFrame) -> DataFrame:
    """id, degree of what edges have at their ends; both ends count."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))  # one read of the edges


def degree_centrality(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """id, degree, centrality: both ends count, divided by the largest degree. ``ends``: the counts of the edges, if they are known."""
    ends = end_counts(edges) if ends is None else ends
    degrees = nodes.select("id").join(ends, "id", "left").fillna(0, ["degree"])
    most = degrees.agg(F.max("degree").alias("most"))
    return degrees.crossJoin(F.broadcast(most)).select("id", "degree", F.when(F.col("most") > 0, F.col("degree") / F.col("most")).otherwise(0.0).alias("centrality"))


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids(id)."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*edges.columns)


def ends_within(edges: DataFrame, ids: DataFrame, last=None) -> DataFrame:
    """source_id, target_id of the edges with both ends in ids(id); of links, if ``last`` makes edges of them, those of the same ends and type are one edge.

    Links meet their sources and are made one in the same partitions, then meet their targets; nothing else of them is shuffled.
    """
    known = ids.select("id").distinct()
    rows = edges.select("source_id", "type", "target_id").join(known.withColumnRenamed("id", "source_id"), "source_id")
    rows = rows.where("type is not null and target_id is not null").distinct() if last else rows
    return rows.join(known.withColumnRenamed("id", "target_id"), "target_id").select("source_id", "target_id")


def around(edges: DataFrame, picked: DataFrame, nodes: DataFrame, only: Column, last=None, inside: bool = False) -> DataFrame:
    """The edges of a few picked(id), some hundreds at most, between nodes for which ``only`` holds; ``inside``: both ends are picked. ``last`` makes edges of links.

    What else there is of the edges or links is passed over as it is read, and neither shuffled nor kept; ``only`` is asked of the ends.
    """
    few = [r["id"] for r in picked.select("id").distinct().collect()]
    source, target = F.col("source_id").isin(few), F.col("target_id").isin(few)
    out = edges.where(source & target if inside else source | target)
    out = cut(last(out) if last else out)
    ends = out.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    known = cut(nodes.join(_few(ends), "id", "left_semi"))
    return within(out, _few(known.where(only).select("id")))


def related_edges(edges: DataFrame, ids: DataFrame, limit: int = 140) -> DataFrame:
    """The most telling edges within a selection: heavier types first, then certain before inferred."""
    return within(edges, ids).orderBy(lookup(EDGE_WEIGHTS, F.col("type"), OTHER_WEIGHT).desc(), "is_inferred", "type", "source_id", "target_id").limit(limit)


def boundary(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with exactly one end in ids(id)."""
    mark = lambda c, n: ids.select(F.col("id").alias(c), F.lit(True).alias(n))
    both = edges.join(mark("source_id", "s_in"), "source_id", "left").join(mark("target_id", "t_in"), "target_id", "left")
    return both.where(F.coalesce("s_in", F.lit(False)) != F.coalesce("t_in", F.lit(False))).select(*edges.columns)


def reachable(links: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """id, depth: the nodes that links(src, dst) reach from roots(id), in at most ``depth`` steps if that is given."""
    seen = cut(roots.select("id", F.lit(0).alias("depth")).distinct())
    front, step = seen, 0
    while depth is None or step < depth:
        step += 1
        near = links.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(near.join(seen, "id", "left_anti").select("id", F.lit(step).alias("depth")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """id, depth: what a change of roots(id) may reach, against the edges; containers hand on to their members for free."""
    containers = nodes.where(F.col("type").isin(CONTAINER_TYPES)).select(F.col("id").alias("source_id"))
    down = edges.where("type = 'contains'").join(containers, "source_id", "left_semi").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    up = edges.where(F.col("type").isin([*IMPACT_TYPES, "contains"])).select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    seen = cut(roots.select("id", F.lit(0).alias("depth")).distinct())
    front = seen
    for step in range(depth + 1):
        while True:  # members at the same depth, level by level
            members = down.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
            members = cut(members.select("id", F.lit(step).alias("depth")))
            if members.isEmpty():
                break
            seen, front = cut(seen.unionByName(members)), members.unionByName(front)
        if step == depth:
            break
        now = seen.where(F.col("depth") == step)
        front = cut(up.join(now.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(step + 1).alias("depth")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


#: Ids that are broadcast at most, where a step's frontier meets a whole table.
MOST_BROADCAST = 100_000


def _few(ids: DataFrame) -> DataFrame:
    """The ids, broadcast where they are few."""
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids


def shortest_flow(nodes: DataFrame, edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 8, last=None) -> DataFrame:
    """step, id, edge_id: one shortest path along flow edges from starts(id) to targets(id); no rows if there is none.

    The frontier keeps a parent for each node: the parent that was found first, then the edge of the
    smallest order (type, confidence downwards, id). ``edges`` may be links of which ``last`` makes edges: each step
    does so for those that leave its frontier, so that no step shuffles or keeps the others.
    """
    flow = edges.where(F.col("type").isin(FLOW_TYPES))
    rank = F.struct(lookup(EDGE_ORDER, F.col("type"), OTHER_ORDER).alias("o"), (-F.col("confidence")).alias("c"), F.col("id").alias("e")).alias("rank")
    path = F.array().cast("array<struct<id:string,edge_id:string>>")
    order = F.array(F.struct(F.lit(0).alias("o"), F.lit(0.0).alias("c"), F.col("id").alias("e")))
    front = cut(starts.select("id").distinct().select("id", F.array(F.struct("id", F.lit(None).cast("string").alias("edge_id"))).alias("path"), order.alias("order")))
    seen = front.select("id")
    for step in range(depth + 1):
        own = _few(front.select("id"))
        hit = targets.select("id").join(own, "id", "left_semi").distinct()
        found = front.join(hit, "id", "left_semi").orderBy("order").limit(1)
        if not found.isEmpty():
            return found.select(F.posexplode("path").alias("step", "x")).select("step", "x.id", "x.edge_id")
        if step == depth:
            break
        out = flow.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        out = cut((last(out) if last else out).select("source_id", "target_id", F.col("id").alias("edge_id"), rank))
        known = nodes.select("id").join(_few(out.select(F.col("target_id").alias("id")).distinct()), "id", "left_semi").distinct()
        near = out.join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(front.select(F.col("id").alias("source_id"), "path", "order"), "source_id").join(seen.select(F.col("id").alias("target_id")), "target_id", "left_anti")
        near = near.select(F.col("target_id").alias("id"), F.concat("path", F.array(F.struct(F.col("target_id").alias("id"), "edge_id"))).alias("path"), F.concat("order", F.array("rank")).alias("order"))
        front = cut(near.groupBy("id").agg(F.min_by("path", "order").alias("path"), F.min("order").alias("order")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("id")))
    return front.limit(0).select(F.lit(0).alias("step"), "id", F.lit(None).cast("string").alias("edge_id"))


def expand(seeds: DataFrame, edges: DataFrame | None, hops: int, most: int = 60, at=None) -> DataFrame:
    """id, hop, score: decayed expansion; a neighbour's score is parent * type weight * confidence * 0.78^hop.

    Each hop takes the best neighbours until ``most`` nodes are selected (ties: by id). ``at`` gives the edges of a frontier, in place of ``edges``.
    """
    ways = lambda edges: edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type", "confidence").unionAll(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "type", "confidence"))
    chosen = cut(seeds.select("id", F.lit(0).alias("hop"), F.col("score").cast("double").alias("score")))
    front = chosen
    for hop in range(1, hops + 1):
        room = most - chosen.count()
        if room <= 0:
            break
        gain = lookup(EDGE_WEIGHTS, F.col("type"), OTHER_WEIGHT) * F.col("confidence")
        # the frontier has at most ``most`` rows, so it is the side to broadcast
        both = ways(at(front) if at else edges)
        near = both.join(F.broadcast(front.select(F.col("id").alias("src"), "score")), "src").where("src <> dst").join(F.broadcast(chosen.select(F.col("id").alias("dst"))), "dst", "left_anti")
        best = near.groupBy(F.col("dst").alias("id")).agg(F.max(F.col("score") * gain * F.lit(DECAY**hop)).alias("score"))
        front = cut(best.orderBy(F.desc("score"), "id").limit(room).select("id", F.lit(hop).alias("hop"), "score"))
        if front.isEmpty():
            break
        chosen = cut(chosen.unionByName(front))
    return chosen


def expand_undirected(edges: DataFrame, roots: DataFrame, depth: int = 3, most: int = 160) -> DataFrame:
    """id, hop, place: breadth-first expansion along edges in both directions until ``most`` nodes are selected.

    roots(id, place). A node is found by the earliest place of the hop before and, from there, by the
    first edge in order of type, confidence (downwards) and id; nodes of a hop are numbered in that order.
    """
    order = [lookup(EDGE_ORDER, F.col("type"), OTHER_ORDER).alias("o"), (-F.col("confidence")).alias("c"), F.col("id").alias("e")]
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))))
    both = edges.where("source_id <> target_id").select(ends.alias("x"), *order).select("x.*", "o", "c", "e")
    chosen = cut(roots.groupBy("id").agg(F.min("place").alias("place")).select("id", F.lit(0).alias("hop"), F.col("place").cast("long")))
    front = chosen
    for hop in range(1, depth + 1):
        room = most - chosen.count()
        if room <= 0:
            break
        near = both.join(F.broadcast(front.select(F.col("id").alias("src"), "place")), "src").join(F.broadcast(chosen.select(F.col("id").alias("dst"))), "dst", "left_anti")
        found = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("place", "o", "c", "e")).alias("key"))
        first = found.orderBy("key").limit(room)  # ``most`` rows at the most, so the window below is small
        front = cut(first.select("id", F.lit(hop).alias("hop"), F.row_number().over(Window.orderBy("key")).cast("long").alias("place")))
        if front.isEmpty():
            break
        chosen = cut(chosen.unionByName(front))
    return chosen


def affected_refs(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """ref: ids of the nodes of files(file_path) and of the edges at them."""
    own = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    ends = edges.select(F.col("id").alias("ref"), F.explode(F.array("source_id", "target_id")).alias("id"))
    return own.select(F.col("id").alias("ref")).union(ends.join(own, "id", "left_semi").select("ref")).distinct()


def set_stats(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """inside, incoming, outgoing: edges within ids(id), into them and out of them, in one row."""
    mark = lambda c, n: ids.select(F.col("id").alias(c), F.lit(True).alias(n))
    both = edges.join(mark("source_id", "s"), "source_id", "left").join(mark("target_id", "t"), "target_id", "left")
    s, t = F.coalesce("s", F.lit(False)), F.coalesce("t", F.lit(False))
    return both.agg(F.count_if(s & t).alias("inside"), F.count_if(~s & t).alias("incoming"), F.count_if(s & ~t).alias("outgoing"))


def drilldown(nodes: DataFrame, edges: DataFrame, parents: DataFrame, container: str, most: int = 140) -> DataFrame:
    """source, target, type, n, inferred: edges below a container, bucketed by what is visible there.

    parents(id, parent) is the containment. Members are all descendants; classes, functions and methods
    are visible themselves, all others stand for their file. Edges within one visible node are left out.
    """
    down = parents.select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    root = nodes.where(F.col("id") == container).select("id")
    members = reachable(down, root).select("id")
    own = nodes.join(members, "id", "left_semi").select("id", "type", "file_path")
    files = own.where("type in ('file', 'config')").groupBy("file_path").agg(F.min("id").alias("file_id"))
    shown = own.join(files, "file_path", "left").select("id", F.when(F.col("type").isin("class", "function", "method"), F.col("id")).otherwise(F.coalesce("file_id", "id")).alias("shown"))
    rows = edges.where("type <> 'contains'")
    for side in ("source", "target"):
        rows = rows.join(shown.select(F.col("id").alias(f"{side}_id"), F.col("shown").alias(side)), f"{side}_id")
    return rows.where("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("n"), F.bool_or("is_inferred").alias("inferred")).orderBy(F.desc("n"), "source", "target", "type").limit(most)


def pruned(parents: DataFrame, hidden: DataFrame) -> DataFrame:
    """id: the nodes that are neither hidden(id) nor below a hidden one along parents(id, parent), to the fixpoint."""
    gone = reachable(parents.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), hidden)
    return parents.select("id").join(gone.select("id"), "id", "left_anti")


def highlighted(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """id, state of every node of nodes(id): selected, neighbour (by any edge) or faded."""
    mark = selected.select(F.col("id"), F.lit(0).alias("rank")).distinct()
    near = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionAll(edges.select(F.col("target_id"), F.col("source_id"))).join(selected.select("id"), "id", "left_semi")
    states = mark.unionByName(near.select(F.col("other").alias("id"), F.lit(1).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    return nodes.select("id").join(states, "id", "left").select("id", lookup({0: "selected", 1: "neighbour"}, F.col("rank"), "faded").alias("state"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each node reaches, by spreading minima and jumping pointers."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionAll(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).distinct()
    both = cut(both)  # read in each round
    now = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(now.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("least"))
        spread = now.join(near, "id", "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jumped = spread.alias("a").join(spread.select(F.col("id").alias("component"), F.col("component").alias("top")), "component").select("id", F.least("component", "top").alias("component"))
        new = cut(jumped)
        if new.join(now.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty():
            return new
        now = new


def community_dependencies(communities: DataFrame, members: DataFrame, edges: DataFrame, evidence: int = 24, digits: int = 4, last: list[str] | None = None, made: Column | None = None) -> DataFrame:
    """Edges between leaf communities by mapped type: weight, mean confidence, count, first edge ids.

    ``edges`` may be links, of which the last of the same ends and type, by the columns ``last``, is an edge; its id is then
    ``made`` of these. So links are shuffled once for their sources and their last, edges once for their targets, and no id is.
    """
    parents = communities.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    leaves = communities.join(parents, "id", "left_anti").select(F.col("id").alias("community_id"))
    home = members.join(leaves, "community_id", "left_semi").groupBy("node_id").agg(F.min("community_id").alias("community"))
    ends = edges.where(~F.col("type").isin("contains", "defines"))
    at = lambda side: home.select(F.col("node_id").alias(f"{side}_id"), F.col("community").alias(f"{side}_community_id"))
    ends = ends.join(at("source"), "source_id")
    if last:
        order = F.struct(*last, *[c for c in ("weight", "confidence") if c not in last])
        ends = ends.groupBy("source_id", "type", "target_id", "source_community_id").agg(F.max(order).alias("x")).select("source_id", "type", "target_id", "source_community_id", "x.weight", "x.confidence")
    ends = ends.join(at("target"), "target_id")
    kind = lookup(COMMUNITY_TYPES, F.col("type"), "depends_on")
    keys = ["source_community_id", "target_community_id", "kind"]
    rows = ends.where("source_community_id <> target_community_id").withColumn("kind", kind)
    rows = rows if made is None else rows.withColumn("id", made)
    # both sides read the same columns, ids counted here and weights as ties there, so that what is joined is shuffled once for both
    sums = rows.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.01), "weight")).alias("weight"), F.avg("confidence").alias("confidence"), F.count("*").alias("edge_count"), F.count("id").alias("ids")).where("ids >= 0")
    # a group may hold any number of edges; only its first ids are ever gathered
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "weight", "confidence"))
    first = rows.select(*keys, "id", "weight", "confidence").withColumn("place", place).where(F.col("place") <= evidence).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("evidence"))
    return sums.join(first, keys).select(*keys, F.bround("weight", digits).alias("weight"), F.bround("confidence", digits).alias("confidence"), "edge_count", "evidence")


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: files whose nodes depend on another file's nodes (src depends on dst), each pair once."""
    types = [t for t in IMPACT_TYPES if t != "routes_to"]
    path = lambda side, name: nodes.where("file_path <> ''").select(F.col("id").alias(f"{side}_id"), F.col("file_path").alias(name))
    both = edges.where(F.col("type").isin(types)).join(path("source", "src"), "source_id").join(path("target", "dst"), "target_id")
    return both.where("src <> dst").select("src", "dst").distinct()


def flow_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and its numbers of incoming and outgoing edges, calls and references."""
    one = lambda c, way: edges.select(F.col(c).alias("id"), F.lit(way).alias("way"), "type")
    ends = one("source_id", "out").unionAll(one("target_id", "in"))
    tally = ends.groupBy("id").agg(F.count_if(F.col("way") == "in").alias("incoming"), F.count_if(F.col("way") == "out").alias("outgoing"), F.count_if(F.col("type") == "calls").alias("calls"), F.count_if(F.col("type") == "references").alias("refs"))
    return nodes.select("id").join(tally, "id", "left").fillna(0)


def containment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root, depth along contains edges, by pointer jumping: the logarithm of the depth in rounds."""
    up = edges.where("type = 'contains'").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent"))
    now = cut(nodes.select("id").join(up, "id", "left").select("id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    while True:
        step = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more")), "root").select("id", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("above") != F.col("root")).alias("moved"))
        new = cut(step)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
