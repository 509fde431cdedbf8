"""Joins, path ranges, roll-ups and write-side set operations on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import glob_pattern, glob_prefix


def prefixes(path: Column, whole: bool = True) -> Column:
    """Every ancestor of a path, and with whole the path itself."""
    parts = F.split(path, "/")
    last = F.size(parts) if whole else F.size(parts) - 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def below(path: Column, root: str) -> Column:
    """Strictly inside a directory, as the half-open range that an ordered scan and Parquet statistics can use."""
    return (path >= root + "/") & (path < root + "0")


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """Rows after a key in key order; one more than asked tells whether the page is the last."""
    if after is not None:
        later = F.lit(False)
        for i, (k, v) in enumerate(zip(keys, after, strict=True)):
            same = F.lit(True)
            for k0, v0 in zip(keys[:i], after[:i], strict=True):
                same = same & (F.col(k0) == v0)
            later = later | (same & (F.col(k) > v))
        df = df.where((F.col(keys[0]) >= after[0]) & later)  # the first bound alone prunes row groups
    return df.orderBy(*keys).limit(limit)


def glob(df: DataFrame, pattern: str, path: str = "path", cross: bool = True) -> DataFrame:
    """Rows whose path matches; the literal start of the pattern is a filter of its own that reaches the scan."""
    start = glob_prefix(pattern)
    if start:
        df = df.where(F.col(path).startswith(start))
    return df.where(F.col(path).rlike(glob_pattern(pattern, cross)))


def outside(df: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Rows that no root contains: ancestors are exploded and met by key, so no range join is needed."""
    keyed = df.withColumn("_up", prefixes(F.col(path)))
    hit = keyed.select(path, F.explode("_up").alias("_p")).join(roots.select(F.col(roots.columns[0]).alias("_p")), "_p", "left_semi").select(path).distinct()
    return df.join(hit, path, "left_anti")


def longest_prefix(df: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The nearest enclosing root of each path (null if none)."""
    met = df.select(path, F.explode(prefixes(F.col(path))).alias(root)).join(roots, root)
    best = met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return df.join(best, path, "left")


def pair_sorted(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Full outer merge of two sorted inputs: the n-th of a key meets the n-th of the key, not every one."""
    w = Window.partitionBy(key).orderBy(*order)
    a = left.withColumn("_n", F.row_number().over(w)).select(key, "_n", *(F.col(c).alias(f"l_{c}") for c in left.columns if c != key))
    b = right.withColumn("_n", F.row_number().over(w)).select(key, "_n", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    return a.join(b, [key, "_n"], "full_outer").drop("_n")


def three_way(base: DataFrame, current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row for each key of three snapshots with base_, current_ and incoming_ columns.

    The snapshots are tagged and aggregated once: one shuffle instead of two
    full outer joins. A key must be unique within a snapshot.
    """
    sides = {"base": base, "current": current, "incoming": incoming}
    cols = [c for c in base.columns if c != key]
    tagged = reduce(DataFrame.unionByName, (df.select(key, F.lit(s).alias("_s"), F.struct(*cols).alias("_v")) for s, df in sides.items()))
    met = tagged.groupBy(key).agg(*(F.max(F.when(F.col("_s") == s, F.col("_v"))).alias(s) for s in sides))
    return met.select(key, *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sides for c in cols))


def comm(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Multiset comparison of two inputs: key, side (1 left only, 2 right only, 3 both) and n, from one aggregation."""
    n = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))).groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    both = F.least("_l", "_r")
    parts = F.array(F.struct(F.lit(1).alias("side"), (F.col("_l") - both).alias("n")), F.struct(F.lit(2).alias("side"), (F.col("_r") - both).alias("n")), F.struct(F.lit(3).alias("side"), both.alias("n")))
    return n.select(key, F.inline(F.filter(parts, lambda x: x["n"] > 0)))


def disk_usage(files: DataFrame, path: str = "path", size: str = "size", identity: str | None = None) -> DataFrame:
    """Bytes and files below every directory; with identity, a file with several names counts once."""
    if identity:
        files = files.groupBy(identity).agg(F.min(path).alias(path), F.first(size).alias(size))
    return files.select(F.explode(prefixes(F.col(path), whole=False)).alias("dir"), F.col(size)).groupBy("dir").agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows with a changed key are replaced, new ones added."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def compact_log(log: DataFrame, keys: list[str], order: str, kind: str, put: str = "put") -> DataFrame:
    """What a log of puts and removals leaves: the last entry of each key, if it is a put."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.col(order)).alias("_v"))
    return last.where(F.col(f"_v.{kind}") == put).select(*keys, "_v.*")


def batches(df: DataFrame, key: str, size: int, partition: str) -> DataFrame:
    """Rows of a partition in groups of `size` in key order, as xargs -n makes them."""
    n = F.row_number().over(Window.partitionBy(partition).orderBy(key)) - 1
    return df.withColumn("batch", F.floor(n / size).cast("long")).groupBy(partition, "batch").agg(F.array_sort(F.collect_list(key)).alias("args"))


def tree_lines(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every file and directory (path, depth) with its line of a drawn tree.

    Whether a branch goes on after an entry is asked once of each directory:
    its last name joins the ancestors of every entry, so no directory is
    numbered or gathered in one task.
    """
    nodes = paths.where(F.col(path).isNotNull()).select(F.explode(prefixes(F.col(path))).alias("node")).distinct()
    up = F.split("node", "/")
    named = nodes.select("node", F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"))
    last = named.groupBy("dir").agg(F.max("name").alias("last"))
    steps = nodes.select("node", F.posexplode(up).alias("k", "part"), up.alias("up")).select("node", "k", "part", F.array_join(F.slice("up", F.lit(1), F.col("k")), "/").alias("dir"))
    met = steps.join(last, "dir").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("part") == F.col("last")).alias("ends")))).alias("s"))
    stems = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: F.when(x["ends"], "    ").otherwise("│   "))
    line = F.concat(F.array_join(stems, ""), F.when(F.element_at("s", -1)["ends"], "└── ").otherwise("├── "), F.element_at(F.split("node", "/"), -1))
    return met.select(F.col("node").alias(path), F.size("s").cast("long").alias("depth"), line.alias("line"))
