"""Recursive operators over edge tables: closures, merge bases, levels and tree walks.

Spark's recursive SQL has no distinct union, so closures are frontier loops:
each round joins the frontier with the edges, drops what has been visited and
cuts the lineage. The frontier shrinks as the visited set grows; no round
touches more than its own frontier and one anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def closure(edges: DataFrame, seeds: DataFrame, most: int = 100_000, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth) reachable over edges (child, parent) from seeds (seed, node), themselves at depth 0.

    depth is the length of a shortest path; stop (node) lists nodes whose
    parents are not followed. Cycles end where a node repeats.
    """
    frontier = seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0))
    visited = cut(frontier)
    frontier = visited
    for depth in range(1, most + 1):
        here = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        step = here.join(edges.select(F.col("child").alias("node"), "parent"), "node").select("seed", F.col("parent").alias("node")).distinct()
        frontier = cut(step.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:
            visited = cut(visited)
    raise RuntimeError(f"no end after {most} rounds")


def advance(edges: DataFrame, state: DataFrame, rounds: int = 1) -> tuple[DataFrame, bool]:
    """(state, done) after at most `rounds` more rounds of a closure.

    state (seed, node, depth) starts as the seeds at depth 0 and is all there
    is to keep between calls: its frontier are the rows of the greatest depth.
    """
    depth = state.agg(F.max("depth")).first()[0]
    if depth is None:
        return state, True
    for d in range(depth, depth + rounds):
        step = state.where(F.col("depth") == d).join(edges.select(F.col("child").alias("node"), "parent"), "node").select("seed", F.col("parent").alias("node")).distinct()
        fresh = cut(step.join(state.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d + 1)))
        if fresh.isEmpty():
            return state, True
        state = cut(state.unionByName(fresh))
    return state, False


def follow_links(starts: DataFrame, links: DataFrame, most: int = 40) -> DataFrame:
    """(start, target, hops, looped) after following links (src, dst) from each start until one has none. Where `most` times are not enough, as in a loop, target is null and looped is true."""
    state = starts.select("start", F.col("start").alias("target"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("open"))
    for i in range(most):
        met = state.join(links, (F.col("target") == F.col("src")) & F.col("open"), "left")
        state = cut(met.select("start", F.coalesce("dst", "target").alias("target"), (F.col("hops") + F.col("dst").isNotNull().cast("long")).alias("hops"), F.col("dst").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
    more = state.join(links.select("src").distinct(), F.col("target") == F.col("src"), "left")
    looped = F.col("src").isNotNull()
    return more.select("start", F.when(~looped, F.col("target")).alias("target"), "hops", looped.alias("looped"))


def merge_bases(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Best common ancestors of two nodes: common ones that are no strict ancestor of another common one."""
    spark = edges.sparkSession
    reach = closure(edges, spark.createDataFrame([(1, a), (2, b)], "seed int, node long"))
    common = cut(reach.groupBy("node").agg(F.bit_or("seed").alias("m")).where("m = 3").select("node"))
    # a strict ancestor of a common node is a parent of one, as the common set is closed under ancestry
    covered = common.join(edges.select(F.col("child").alias("node"), "parent"), "node").select(F.col("parent").alias("node")).distinct()
    return common.join(covered, "node", "left_anti")


def ahead_behind(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (pair, a, b): nodes only a reaches (ahead), only b reaches (behind) and both reach, with a verdict."""
    seeds = pairs.select(F.struct("pair", F.lit(1).alias("side")).alias("seed"), F.col("a").alias("node")).unionByName(pairs.select(F.struct("pair", F.lit(2).alias("side")).alias("seed"), F.col("b").alias("node")))
    reach = closure(edges, seeds).select(F.col("seed.pair").alias("pair"), F.col("seed.side").alias("side"), "node")
    masks = reach.groupBy("pair", "node").agg(F.bit_or("side").alias("m"))
    n = masks.groupBy("pair").agg(*(F.count_if(F.col("m") == k).alias(name) for k, name in ((1, "ahead"), (2, "behind"), (3, "both"))))
    verdict = F.when(F.col("both") == 0, "unrelated").when((F.col("ahead") == 0) & (F.col("behind") == 0), "identical").when(F.col("behind") == 0, "ahead").when(F.col("ahead") == 0, "behind").otherwise("diverged")
    return n.withColumn("verdict", verdict)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the length of the longest path to a node without parents; a topological order. A cycle is an error: no path in an acyclic graph is as long as the graph has nodes."""
    most = nodes.count()
    level = cut(nodes.select("node", F.lit(0).alias("level")))
    frontier = level
    step = 0
    while True:
        step += 1
        nxt = frontier.join(edges.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node")).distinct().withColumn("level", F.lit(step))
        frontier = cut(nxt)
        if frontier.isEmpty():
            return level
        if step >= most:
            raise ValueError("the graph has a cycle")
        level = cut(level.unionByName(frontier).groupBy("node").agg(F.max("level").alias("level")))


def nth_ancestor(edges: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(start, node): the n-th first parent of each start that has one."""
    first = edges.where("pos = 0").select(F.col("child").alias("node"), "parent")
    out = starts.select(F.col("node").alias("start"), "node")
    for _ in range(n):
        out = out.join(first, "node").select("start", F.col("parent").alias("node"))
    return out


def walk_tree(entries: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """Files below root trees: root, path, mode, oid. entries: tree, name, mode (40000 is a tree), oid. A tree inside itself is an error."""
    open_ = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("path"), F.array("root").alias("above"))
    found = None
    for _ in range(most):
        step = open_.join(entries, "tree").select("root", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name")).alias("path"), "mode", "oid", "above")
        step = cut(step)
        leaves = step.where("mode <> '40000'").select("root", "path", "mode", "oid")
        found = leaves if found is None else found.unionByName(leaves)
        inner = step.where("mode = '40000'")
        if inner.where(F.array_contains("above", F.col("oid"))).limit(1).count():
            raise ValueError("a tree contains itself")
        if inner.isEmpty():
            return found
        open_ = inner.select("root", F.col("oid").alias("tree"), "path", F.array_append("above", F.col("oid")).alias("above"))
    raise RuntimeError(f"deeper than {most} levels")


def diff_trees(entries: DataFrame, before: str, after: str, most: int = 64) -> DataFrame:
    """Changed files between two trees: path, before_mode, before_oid, after_mode, after_oid. Equal subtrees are never opened."""
    spark = entries.sparkSession
    pairs = spark.createDataFrame([("", before, after)], "path string, b string, a string")
    out = None
    side = entries.select("tree", "name", "mode", "oid")
    for _ in range(most):
        left = pairs.where("b is not null").join(side, F.col("b") == F.col("tree")).select("path", "name", F.col("mode").alias("bm"), F.col("oid").alias("bo"))
        right = pairs.where("a is not null").join(side, F.col("a") == F.col("tree")).select("path", "name", F.col("mode").alias("am"), F.col("oid").alias("ao"))
        met = left.join(right, ["path", "name"], "full_outer").where(~(F.col("bm").eqNullSafe(F.col("am")) & F.col("bo").eqNullSafe(F.col("ao"))))
        met = cut(met.withColumn("path", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))))

        def leaf(mode, oid):
            return F.when(F.col(mode) != "40000", F.col(oid))

        files = met.select("path", F.when(F.col("bm") != "40000", F.col("bm")).alias("before_mode"), leaf("bm", "bo").alias("before_oid"), F.when(F.col("am") != "40000", F.col("am")).alias("after_mode"), leaf("am", "ao").alias("after_oid")).where("before_oid is not null or after_oid is not null")
        out = files if out is None else out.unionByName(files)
        pairs = met.where("bm = '40000' or am = '40000'").select("path", F.when(F.col("bm") == "40000", F.col("bo")).alias("b"), F.when(F.col("am") == "40000", F.col("ao")).alias("a"))
        if pairs.isEmpty():
            return out
    raise RuntimeError(f"deeper than {most} levels")


def chain(rows: DataFrame, key: str, by: str) -> DataFrame:
    """First-parent edges (child, parent, pos 0) that link the rows of each group in key order."""
    return rows.select(F.col(key).alias("child"), F.lag(key).over(Window.partitionBy(by).orderBy(key)).alias("parent"), F.lit(0).alias("pos")).where("parent is not null")
