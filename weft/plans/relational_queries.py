"""Scans, writes, joins, aggregates, windows and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.patterns import glob_pattern
from ..sources.tables import document_paths, load, mounted, sequence_rows
from .registry import query

FILES = "(SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, source || '/' || lang AS parent, n_chars AS size, doc_id AS rev, text AS content FROM documents)"


def _files(spark, sf):
    return document_paths(load(spark, sf, "documents"))


@query("src_01_keyset_scan", f"SELECT path, size FROM {FILES} WHERE path > 'src1/en' AND path >= 'src1/' AND path < 'src10' ORDER BY path LIMIT 20")
def _(spark, sf):
    f = _files(spark, sf).where(R.below(F.col("path"), "src1"))
    return R.keyset_page(f.where("path < 'src10'").select("path", "size"), ["path"], ("src1/en",), 20)


@query("src_02_subtree_skip", f"SELECT path FROM {FILES} WHERE path >= 'src3/de0' AND path >= 'src3/' AND path < 'src30'")
def _(spark, sf):
    return _files(spark, sf).where(R.below(F.col("path"), "src3") & (F.col("path") >= "src3/de0")).select("path")


@query("src_03_pruned_scan", f"SELECT path FROM {FILES} WHERE NOT (starts_with(path, 'src2/en/') OR starts_with(path, 'src7/'))")
def _(spark, sf):
    roots = spark.createDataFrame([("src2/en",), ("src7",)], "root string")
    return R.outside(_files(spark, sf).select("path"), roots)


@query("src_04_glob", f"SELECT path, size FROM {FILES} WHERE path GLOB 'src1*/f*[02468].txt'")
def _(spark, sf):
    return R.glob(_files(spark, sf).select("path", "size"), "src1*/f*[02468].txt")


@query("src_05_glob_page", f"SELECT path, count(*) OVER () > 10 AS more FROM (SELECT path FROM {FILES} WHERE path GLOB 'src5/*' ORDER BY path LIMIT 11) ORDER BY path LIMIT 10")
def _(spark, sf):
    page = R.keyset_page(R.glob(_files(spark, sf).select("path"), "src5/*"), ["path"], None, 11)
    return page.withColumn("more", F.count("*").over(Window.partitionBy(F.lit(1))) > 10).orderBy("path").limit(10)


@query("src_06_directory_groups", f"SELECT d.dir AS directory, f.path FROM (SELECT DISTINCT parent AS dir FROM {FILES} UNION SELECT 'empty/dir') d LEFT JOIN {FILES} f ON f.parent = d.dir AND f.size > 500")
def _(spark, sf):
    f = _files(spark, sf)
    dirs = f.select(F.col("parent").alias("directory")).union(spark.sql("SELECT 'empty/dir'")).distinct()
    return dirs.join(f.where("size > 500").select(F.col("parent").alias("directory"), "path"), "directory", "left")


@query("src_07_discovery_integrity", f"SELECT parent, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS least, max(size) AS most, CAST(sum(CASE WHEN length(content) = size THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM {FILES} WHERE path GLOB '*.txt' AND NOT starts_with(path, 'src4/') GROUP BY parent")
def _(spark, sf):
    f = R.outside(R.glob(_files(spark, sf), "*.txt"), spark.createDataFrame([("src4",)], "root string"))
    return f.groupBy("parent").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum(F.when(F.char_length("content") == F.col("size"), 0).otherwise(1)).alias("broken"))


@query("src_08_content_search", f"SELECT path FROM {FILES} WHERE contains(content, 'stupid') AND NOT contains(content, chr(0))")
def _(spark, sf):
    return _files(spark, sf).where(F.col("content").contains("stupid") & ~F.col("content").contains("\x00")).select("path")


@query("src_09_bulk_lookup", "SELECT o.n, d.doc_id, d.n_chars FROM documents d JOIN (SELECT unnest([5, 17, 3, 99, 100000]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS n) o USING (doc_id)")
def _(spark, sf):
    wanted = spark.createDataFrame(list(enumerate([5, 17, 3, 99, 100000])), "n int, doc_id long")
    return load(spark, sf, "documents").join(F.broadcast(wanted), "doc_id").select("n", "doc_id", "n_chars")


@query("src_10_read_range", "SELECT doc_id, text[101:150] AS part FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.substring("text", 101, 50).alias("part"))


@query("src_11_revalidated_read", "SELECT w.doc_id, d.doc_id IS NOT NULL AND d.n_chars = w.size AS ok, min(CASE WHEN d.doc_id IS NOT NULL AND d.n_chars = w.size THEN 1 ELSE 0 END) OVER () AS all_ok FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents) w LEFT JOIN documents d USING (doc_id)")
def _(spark, sf):
    d = load(spark, sf, "documents")
    wanted = d.select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"))
    met = wanted.join(d.select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", (F.col("n_chars").isNotNull() & (F.col("n_chars") == F.col("size"))).alias("ok"))
    verdict = met.agg(F.min(F.col("ok").cast("int")).alias("all_ok"))
    return met.crossJoin(F.broadcast(verdict))  # one row


@query("src_12_stat_readdir", f"SELECT path, size, rev FROM {FILES} WHERE parent = 'src6/en'")
def _(spark, sf):
    return _files(spark, sf).where("parent = 'src6/en'").select("path", "size", "rev")


@query("src_13_symlink_resolution", "WITH RECURSIVE t AS (SELECT p_partkey AS start, p_partkey AS place, 0 AS hops FROM part UNION ALL SELECT start, place // 3, hops + 1 FROM t WHERE place % 3 = 0 AND place > 0 AND hops < 40) SELECT start, CASE WHEN NOT bool_or(hops = 40 AND place % 3 = 0 AND place > 0) THEN max_by(place, hops) END AS target, CAST(max(hops) AS BIGINT) AS hops, bool_or(hops = 40 AND place % 3 = 0 AND place > 0) AS looped FROM t GROUP BY start")
def _(spark, sf):
    from ..operators.graph import follow_links

    parts = load(spark, sf, "part").select("p_partkey")
    links = parts.where("p_partkey % 3 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).cast("long").alias("dst"))
    return follow_links(parts.select(F.col("p_partkey").alias("start")), links)


@query("src_14_subtree_revision", f"SELECT greatest((SELECT max(rev) FROM {FILES} WHERE path >= 'src1/' AND path < 'src10'), (SELECT max(rev) FROM {FILES} WHERE parent = 'src1/en'), 0) AS rev")
def _(spark, sf):
    f = _files(spark, sf)
    return f.agg(F.greatest(F.max(F.when(R.below(F.col("path"), "src1"), F.col("rev"))), F.max(F.when(F.col("parent") == "src1/en", F.col("rev"))), F.lit(0)).alias("rev"))


@query("src_15_mounted_view", f"SELECT 'docs/' || path AS path, size FROM {FILES} UNION ALL SELECT 'web/' || regexp_replace(url, '^https?://', '') AS path, CAST(length(html) AS BIGINT) FROM pages")
def _(spark, sf):
    web = load(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.char_length("html").cast("long").alias("size"))
    return mounted({"docs": _files(spark, sf).select("path", "size"), "web": web})


@query("src_16_import", f"SELECT path, min(path) OVER (PARTITION BY content) AS inode, count(*) OVER (PARTITION BY content) AS nlink FROM {FILES}")
def _(spark, sf):
    # one node a content, named by its first path: no order over all contents; contents are known by size and digest
    f = _files(spark, sf).select("path", F.octet_length("content").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    inodes = f.groupBy("digest", "size").agg(F.count("*").alias("nlink"), F.min("path").alias("inode"))
    return f.join(inodes, ["digest", "size"]).select("path", "inode", "nlink")


@query("src_19_sequence", "SELECT n, printf('%.2f', CAST(1.5 + 0.25 * n AS DOUBLE)) AS value FROM range(0, 395) t(n)")
def _(spark, sf):
    return sequence_rows(spark, "1.5", "0.25", "100", 2).withColumnRenamed("id", "n")


@query("src_20_json_input", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src_22_index_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey >= 10 AND l_orderkey < 60 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50")
def _(spark, sf):
    return load(spark, sf, "lineitem").where("l_orderkey >= 10 and l_orderkey < 60").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(50)


@query("src_23_object_assembly", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS chunks FROM conversations GROUP BY conv_id")
def _(spark, sf):
    chunks = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return chunks.select("conv_id", F.array_join(F.col("c.text"), "").alias("content"), F.size("c").cast("long").alias("chunks"))


@query("src_24_prefix_lookup", "SELECT min(id) AS id, count(*) AS n FROM (SELECT sha1(CAST(doc_id AS VARCHAR)) AS id FROM documents) WHERE starts_with(id, 'ab') HAVING count(*) >= 0")
def _(spark, sf):
    ids = load(spark, sf, "documents").select(F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("id"))
    return ids.where(F.col("id").startswith("ab")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("src_25_reflog_scan", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE r <= 5")
def _(spark, sf):
    e = load(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-10 00:00:00'")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 5").select("event_id", "user_id")


@query("snk_01_bulk_upsert", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, upper(p_name), p_size + 1 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey + 1000000, p_name, 0 FROM part WHERE p_partkey % 50 = 0")
def _(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    changes = p.where("p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    new = p.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), "p_name", F.lit(0).alias("p_size"))
    return R.upsert(p, changes.unionByName(new), ["p_partkey"])


@query("snk_03_set_copy", f"SELECT replace(path, 'src1/', 'copy/') AS path, size FROM {FILES} WHERE starts_with(path, 'src1/') UNION ALL SELECT path, size FROM {FILES}")
def _(spark, sf):
    f = _files(spark, sf).select("path", "size")
    return f.where(R.below(F.col("path"), "src1")).withColumn("path", F.replace("path", F.lit("src1/"), F.lit("copy/"))).unionByName(f)


@query("snk_04_range_delete_orphans", f"SELECT blob, count(*) AS links FROM (SELECT sha1(content) AS blob, starts_with(path, 'src2/') AS gone FROM {FILES}) GROUP BY blob HAVING bool_and(gone)")
def _(spark, sf):
    f = _files(spark, sf).select(F.sha1(F.col("content").cast("binary")).alias("blob"), R.below(F.col("path"), "src2").alias("gone"))
    return f.groupBy("blob").agg(F.count("*").alias("links"), F.bool_and("gone").alias("gone")).where("gone").drop("gone")


@query("snk_05_touch_rename_truncate", f"SELECT CASE WHEN parent = 'src3/en' THEN 'moved/' || regexp_extract(path, '[^/]*$') ELSE path END AS path, least(size, 1000) AS size, rev + 1 AS rev FROM {FILES}")
def _(spark, sf):
    f = _files(spark, sf)
    return f.select(F.when(F.col("parent") == "src3/en", F.concat(F.lit("moved/"), F.substring_index("path", "/", -1))).otherwise(F.col("path")).alias("path"), F.least("size", F.lit(1000)).alias("size"), (F.col("rev") + 1).alias("rev"))


@query("snk_08_log_compaction", "SELECT l_partkey, l_orderkey AS seq FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 AND l_returnflag <> 'R'")
def _(spark, sf):
    log = load(spark, sf, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("put").alias("op"))
    return R.compact_log(log, ["l_partkey"], "seq", "op").select("l_partkey", F.col("seq.l_orderkey").alias("seq"))


#: The id of a tree whose entries are given as hexadecimal digits.
TREE = "sha1(unhex(hex(encode('tree ' || CAST(length({0}) // 2 AS VARCHAR))) || '00' || {0}))"
ENTRY = "hex(encode('{0} ' || {1})) || '00' || upper({2})"


@query(
    "snk_09_tree_build",
    f"""WITH b AS (SELECT parent, regexp_extract(path, '[^/]*$') AS name, sha1('blob ' || strlen(content) || chr(0) || content) AS oid FROM {FILES}),
    l AS (SELECT parent, {TREE.format('e')} AS tree FROM (SELECT parent, string_agg({ENTRY.format('100644', 'name', 'oid')}, '' ORDER BY name) AS e FROM b GROUP BY parent)),
    t AS (SELECT dir, {TREE.format('e')} AS tree FROM (SELECT split_part(parent, '/', 1) AS dir, string_agg({ENTRY.format('40000', "split_part(parent, '/', 2)", 'tree')}, '' ORDER BY split_part(parent, '/', 2) || '/') AS e FROM l GROUP BY 1)),
    r AS (SELECT string_agg({ENTRY.format('40000', 'dir', 'tree')}, '' ORDER BY dir || '/') AS e FROM t)
    SELECT dir, tree FROM t UNION ALL SELECT parent, tree FROM l UNION ALL SELECT '', {TREE.format('e')} FROM r""",
)
def _(spark, sf):
    from ..operators.version import build_trees

    return build_trees(_files(spark, sf))


@query("jon_01_sorted_pairing", "SELECT l_orderkey AS k, l_partkey AS l, o_custkey AS r FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS n FROM lineitem) a FULL JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS n FROM orders) b ON l_orderkey = o_orderkey AND a.n = b.n" .replace("SELECT l_orderkey AS k", "SELECT coalesce(l_orderkey, o_orderkey) AS k"))
def _(spark, sf):
    a = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), F.col("l_linenumber").alias("t"))
    b = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(0).alias("t"))
    return R.pair_sorted(a, b, "k", ["v", "t"]).select("k", F.col("l_v").alias("l"), F.col("r_v").alias("r"))


@query("jon_02_three_way_merge", "SELECT coalesce(b.k, c.k, i.k) AS k, b.v AS b, c.v AS c, i.v AS i FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 4 <> 0) b FULL JOIN (SELECT p_partkey AS k, p_size + CAST(p_partkey % 2 AS INT) AS v FROM part WHERE p_partkey % 5 <> 0) c ON b.k = c.k FULL JOIN (SELECT p_partkey AS k, p_size + CAST(p_partkey % 3 AS INT) AS v FROM part WHERE p_partkey % 7 <> 0) i ON coalesce(b.k, c.k) = i.k")
def _(spark, sf):
    p = load(spark, sf, "part")

    def side(drop, add):
        return p.where(f"p_partkey % {drop} <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + add).cast("int").alias("v"))

    met = R.three_way(side(4, F.lit(0)), side(5, F.col("p_partkey") % 2), side(7, F.col("p_partkey") % 3), "k")
    return met.select("k", F.col("base_v").alias("b"), F.col("current_v").alias("c"), F.col("incoming_v").alias("i"))


@query("jon_03_comm", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b ON a.k = b.k) SELECT k, 1 AS side, a - least(a, b) AS n FROM j WHERE a > b UNION ALL SELECT k, 2, b - least(a, b) FROM j WHERE b > a UNION ALL SELECT k, 3, least(a, b) FROM j WHERE least(a, b) > 0")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    return R.comm(li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k")


@query("agg_07_comm_total", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), j AS (SELECT coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b ON a.k = b.k) SELECT CAST(sum(a - least(a, b)) AS BIGINT) AS only_left, CAST(sum(b - least(a, b)) AS BIGINT) AS only_right, CAST(sum(least(a, b)) AS BIGINT) AS both FROM j")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    c = R.comm(li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k")
    return c.agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).cast("long").alias(n) for s, n in ((1, "only_left"), (2, "only_right"), (3, "both"))))


@query("jon_04_directory_compare", "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only left' WHEN a.name IS NULL THEN 'only right' WHEN a.h = b.h THEN 'same' ELSE 'differ' END AS verdict FROM (SELECT doc_id % 100 AS name, min(sha256(text)) AS h FROM documents WHERE doc_id % 3 < 2 GROUP BY 1) a FULL JOIN (SELECT doc_id % 100 AS name, max(sha256(text)) AS h FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) b ON a.name = b.name")
def _(spark, sf):
    d = load(spark, sf, "documents").select((F.col("doc_id") % 100).alias("name"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    a = d.where("doc_id % 3 < 2").groupBy("name").agg(F.min("h").alias("a"))
    b = d.where("doc_id % 2 = 0").groupBy("name").agg(F.max("h").alias("b"))
    verdict = F.when(F.col("b").isNull(), "only left").when(F.col("a").isNull(), "only right").when(F.col("a") == F.col("b"), "same").otherwise("differ")
    return a.join(b, "name", "full_outer").select("name", verdict.alias("verdict"))


@query("jon_05_inner_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("jon_06_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def _(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'P'")
    c = load(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("jon_07_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, sf):
    li = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(li, "o_orderkey", "left_semi").select("o_orderkey")


@query("jon_08_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("jon_09_range_join", f"SELECT r.root, count(*) AS n FROM (VALUES ('src1'), ('src2/en'), ('src3')) r(root) JOIN {FILES} f ON f.path >= r.root || '/' AND f.path < r.root || '0' GROUP BY r.root")
def _(spark, sf):
    roots = spark.createDataFrame([("src1",), ("src2/en",), ("src3",)], "root string")
    return _files(spark, sf).select(F.explode(R.prefixes(F.col("path"), whole=False)).alias("root")).join(F.broadcast(roots), "root").groupBy("root").agg(F.count("*").alias("n"))


@query("jon_10_longest_prefix_join", f"SELECT path, (SELECT max_by(root, length(root)) FROM (VALUES ('src1'), ('src1/en'), ('src2')) r(root) WHERE starts_with(f.path, r.root || '/')) AS root FROM {FILES} f")
def _(spark, sf):
    roots = spark.createDataFrame([("src1",), ("src1/en",), ("src2",)], "root string")
    return R.longest_prefix(_files(spark, sf).select("path"), roots)


@query("jon_11_lowest_key_lookup", "SELECT p_partkey, s AS first_order, n AS first_line FROM (SELECT p_partkey, l_orderkey AS s, l_linenumber AS n, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM part JOIN lineitem ON l_partkey = p_partkey) WHERE r = 1")
def _(spark, sf):
    low = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return load(spark, sf, "part").join(low, "p_partkey").select("p_partkey", F.col("m.l_orderkey").alias("first_order"), F.col("m.l_linenumber").alias("first_line"))


@query("jon_12_hash_join", "SELECT a.doc_id, min(b.doc_id) AS original FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) GROUP BY a.doc_id")
def _(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("original"))  # one row a content: copies are not paired
    return d.join(first, "h").select("doc_id", "original")


@query("jon_14_hard_link_names", "SELECT a.doc_id, b.names FROM documents a JOIN (SELECT text, count(*) AS names FROM documents GROUP BY text) b ON a.text = b.text WHERE b.names > 1")
def _(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.count("*").alias("names")).where("names > 1"), "h").select("doc_id", "names")


@query("jon_15_prefix_facts", f"SELECT w.wanted, max(CASE WHEN f.path = w.wanted THEN 1 ELSE 0 END) AS exact, max(CASE WHEN starts_with(f.path, w.wanted || '/') THEN 1 ELSE 0 END) AS inside FROM (VALUES ('src1'), ('src1/en'), ('src1/xx'), ('src0/fr/0.txt')) w(wanted) LEFT JOIN {FILES} f ON f.path = w.wanted OR starts_with(f.path, w.wanted || '/') GROUP BY w.wanted")
def _(spark, sf):
    wanted = spark.createDataFrame([("src1",), ("src1/en",), ("src1/xx",), ("src0/fr/0.txt",)], "wanted string")
    met = _files(spark, sf).select("path", F.explode(R.prefixes(F.col("path"))).alias("wanted")).join(F.broadcast(wanted), "wanted").groupBy("wanted").agg(F.max((F.col("path") == F.col("wanted")).cast("int")).alias("exact"), F.max((F.col("path") != F.col("wanted")).cast("int")).alias("inside"))
    return wanted.join(met, "wanted", "left").fillna(0)


@query("jon_17_awk_lookup", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def _(spark, sf):
    keys = load(spark, sf, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, sf, "lineitem").join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("agg_05_du", f"SELECT dir, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT parent AS dir, size FROM {FILES} UNION ALL SELECT split_part(parent, '/', 1), size FROM {FILES}) GROUP BY dir")
def _(spark, sf):
    return R.disk_usage(_files(spark, sf))


@query("agg_05_du_hard_links", f"WITH u AS (SELECT min(path) AS path, any_value(size) AS size FROM {FILES} GROUP BY content) SELECT dir, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, size FROM u UNION ALL SELECT split_part(path, '/', 1), size FROM u) GROUP BY dir")
def _(spark, sf):
    return R.disk_usage(_files(spark, sf).withColumn("blob", F.sha2(F.col("content").cast("binary"), 256)), identity="blob")


@query("agg_06_tree_report", f"SELECT (SELECT count(*) FROM (SELECT parent FROM {FILES} UNION SELECT split_part(parent, '/', 1) FROM {FILES})) AS directories, (SELECT count(*) FROM {FILES}) AS files")
def _(spark, sf):
    return R.disk_usage(_files(spark, sf)).agg(F.count("*").alias("directories"), F.sum(F.when(F.instr("dir", "/") > 0, F.col("files")).otherwise(0)).alias("files"))


@query("agg_08_having", "SELECT l_partkey, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_partkey HAVING count(*) > 30")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high")).where("n > 30")


@query("agg_09_conditional_sum", "SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS BIGINT) AS finished, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", 1)), F.lit(0)).alias("finished"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("agg_10_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("agg_13_awk_group_sum", "SELECT l_returnflag AS k, CAST(round(sum(l_quantity)) AS BIGINT) AS total, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.sum("l_quantity")).cast("long").alias("total"), F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))


@query("agg_14_awk_multi_key", "SELECT l_returnflag AS i, l_linestatus AS j, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.count("*").alias("n"))


@query("agg_20_checksums", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, sf):
    t = F.col("text").cast("binary")
    return load(spark, sf, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@query("agg_20_checksum_verify", "SELECT a.doc_id, CASE WHEN sha256(a.text) = b.h THEN 'OK' ELSE 'FAILED' END AS verdict FROM documents a JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents) b USING (doc_id)")
def _(spark, sf):
    d = load(spark, sf, "documents")
    listed = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("h"))
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("own")).join(listed, "doc_id").select("doc_id", F.when(F.col("own") == F.col("h"), "OK").otherwise("FAILED").alias("verdict"))


@query("agg_21_object_hash", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents")
def _(spark, sf):
    from ..operators.version import blob_id

    return load(spark, sf, "documents").select("doc_id", blob_id(F.col("text")).alias("oid"))


@query("agg_22_bit_flags", "SELECT user_id, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 8 END) AS BIGINT) AS flags FROM events GROUP BY user_id")
def _(spark, sf):
    bit = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(8)
    return load(spark, sf, "events").groupBy("user_id").agg(F.bit_or(bit).cast("long").alias("flags"))


@query("agg_23_bounded_verdict", "SELECT CASE WHEN count(*) > 1000 THEN 'too many' WHEN sum(n_chars) > 100000000 THEN 'too large' ELSE 'ok' END AS verdict, count(*) AS n FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").agg(F.when(F.count("*") > 1000, "too many").when(F.sum("n_chars") > 100000000, "too large").otherwise("ok").alias("verdict"), F.count("*").alias("n"))


@query("agg_24_cube_rollup", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("win_01_surrogate_keys", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS id FROM nation")
def _(spark, sf):
    return load(spark, sf, "nation").select("n_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_name")).cast("long").alias("id"))


@query("win_02_chunk_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations")
def _(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("idx"))


@query("win_03_latest_surviving", "SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id) AS last_remove FROM events) WHERE event_id > coalesce(last_remove, -1)")
def _(spark, sf):
    e = load(spark, sf, "events")
    gone = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id"))
    return e.withColumn("gone", gone).where(F.col("event_id") > F.coalesce("gone", F.lit(-1))).select("user_id", "event_id")


@query("win_04_running_total", "SELECT l_shipdate::DATE AS day, CAST(sum(n) OVER (ORDER BY l_shipdate::DATE DESC) AS BIGINT) AS total FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)" .replace("SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1", "SELECT l_shipdate::DATE AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1"))
def _(spark, sf):
    per = load(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return per.select("day", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("day"))).alias("total"))


@query("win_11_nth_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS n FROM events) WHERE n = 2")
def _(spark, sf):
    e = load(spark, sf, "events")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))) - 1).where("n = 2").select("user_id", "event_id")


@query("win_12_retention", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(spark, sf):
    e = load(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 10")
    return ranked.crossJoin(F.broadcast(newest)).where("ts >= newest - interval 7 day").select("user_id", "event_id")


@query("win_13_stage_pivot", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS base, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS current, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS incoming FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    p = load(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_partkey"))
    return p.select("l_orderkey", F.col("1").alias("base"), F.col("2").alias("current"), F.col("3").alias("incoming"))


@query("win_14_rank_functions", "SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nt, lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey)")
def _(spark, sf):
    w, k = Window.partitionBy("o_orderpriority").orderBy("o_custkey"), Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(k).cast("long").alias("nt"), F.lag("o_orderkey").over(k).alias("before"))


@query("srt_15_keyset_pagination", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 25")
def _(spark, sf):
    return R.keyset_page(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], (100, 2), 25)


@query("set_01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(spark, sf):
    return load(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(load(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("set_02_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_03_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey").subtract(load(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_partkey"))


@query("set_04_intersect_bitmask", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, sf):
    side = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.bit_or(side).alias("m")).where("m = 3").select("l_partkey")


@query("set_05_multiset_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey").exceptAll(li.where("l_returnflag = 'N'").select("l_partkey"))


@query("set_09_missing_probe", "SELECT id FROM (SELECT unnest([1, 2, 3, 500000, 600000]) AS id) WHERE id NOT IN (SELECT p_partkey FROM part)")
def _(spark, sf):
    wanted = spark.createDataFrame([(x,) for x in (1, 2, 3, 500000, 600000)], "id int")
    return wanted.join(load(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", "left_anti")


@query("flt_08_include_exclude", "SELECT url FROM pages WHERE (regexp_extract(url, '[^/]*$') GLOB '*.html' OR url GLOB '*/en/*') AND NOT url GLOB '*#*'")
def _(spark, sf):
    u = F.col("url")
    return load(spark, sf, "pages").where((F.substring_index("url", "/", -1).rlike(glob_pattern("*.html")) | u.rlike(glob_pattern("*/en/*"))) & ~u.contains("#")).select("url")


@query("flt_11_find_tests", f"SELECT path FROM {FILES} WHERE path GLOB 'src*' AND size > 2000 AND lower(regexp_extract(path, '[^/]*$')) GLOB '1*.txt' AND rev > (SELECT rev FROM {FILES} WHERE doc_id = 20)")
def _(spark, sf):
    f = _files(spark, sf)
    newer = f.where("doc_id = 20").agg(F.max("rev").alias("r"))
    return R.glob(f, "src*").where("size > 2000").where(F.lower(F.substring_index("path", "/", -1)).rlike(glob_pattern("1*.txt"))).crossJoin(F.broadcast(newer)).where("rev > r").select("path")


@query("flt_12_find_algebra", f"SELECT path FROM {FILES} WHERE NOT (size < 1000 OR parent GLOB '*/en') AND (parent GLOB '*/fr' OR size > 5000)")
def _(spark, sf):
    p = F.col("parent")
    return _files(spark, sf).where(~((F.col("size") < 1000) | p.rlike(glob_pattern("*/en"))) & (p.rlike(glob_pattern("*/fr")) | (F.col("size") > 5000))).select("path")


@query("flt_13_find_prune", f"SELECT path FROM {FILES} WHERE NOT starts_with(path, 'src0/') AND NOT contains(path, '/de/')")
def _(spark, sf):
    f = _files(spark, sf).select("path", "parent")
    roots = f.where(F.col("parent").endswith("/de")).select(F.col("parent").alias("root")).union(spark.sql("SELECT 'src0'")).distinct()
    return R.outside(f.select("path"), roots)


@query("flt_14_size_age_rounding", "SELECT doc_id, CAST(ceil(n_chars / 512.0) AS BIGINT) AS blocks, CAST(ceil(n_chars / 1024.0) AS BIGINT) = 3 AS three_k FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.ceil(F.col("n_chars") / 512).alias("blocks"), (F.ceil(F.col("n_chars") / 1024) == 3).alias("three_k"))


@query("flt_15_test", "SELECT p_partkey, p_name <> '' AND p_size >= 10 AND p_brand = 'Brand#1' AS ok FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", ((F.col("p_name") != "") & (F.col("p_size") >= 10) & (F.col("p_brand") == "Brand#1")).alias("ok"))


@query("flt_18_awk_comparison", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^[0-9]+$') THEN CAST(p_size AS VARCHAR) > p_type ELSE CAST(p_size AS VARCHAR) < p_type END AS less FROM part")
def _(spark, sf):
    from ..functions.awk import compare

    t = F.col("p_type")
    return load(spark, sf, "part").select("p_partkey", F.when(t.rlike("^[0-9]+$"), F.col("p_size").cast("string") > t).otherwise(compare(F.col("p_size").cast("string"), t, left_is_text=True) < 0).alias("less"))


@query("flt_20_pathspec", f"SELECT path FROM {FILES} WHERE path = 'src1' OR starts_with(path, 'src1/') OR path GLOB 'src2/*7.txt'")
def _(spark, sf):
    return _files(spark, sf).where(R.below(F.col("path"), "src1") | F.col("path").rlike(glob_pattern("src2/**7.txt"))).select("path")


@query("flt_21_ignore_rules", f"SELECT path FROM {FILES} WHERE NOT CASE WHEN path GLOB '*/en/*5.txt' THEN FALSE WHEN path GLOB '*/en/*' THEN TRUE WHEN path GLOB 'src1/*' THEN TRUE ELSE FALSE END")
def _(spark, sf):
    from ..operators.version import ignored

    return _files(spark, sf).where(~ignored(F.col("path"), ["/src1/", "en/", "!**/en/*5.txt"])).select("path")


@query("flt_22_ls_files", "SELECT coalesce(i.k, w.k) AS k, CASE WHEN w.k IS NULL THEN 'deleted' WHEN i.k IS NULL THEN 'other' ELSE 'cached' END AS state FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0) i FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 <> 0) w ON i.k = w.k")
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    i, w = p.where("k % 3 <> 0").withColumn("i", F.lit(True)), p.where("k % 4 <> 0").withColumn("w", F.lit(True))
    return i.join(w, "k", "full_outer").select("k", F.when(F.col("w").isNull(), "deleted").when(F.col("i").isNull(), "other").otherwise("cached").alias("state"))


@query("grf_18_ancestors", f"SELECT path, a AS ancestor FROM (SELECT path, unnest([split_part(path, '/', 1), parent, path]) AS a FROM {FILES})")
def _(spark, sf):
    return _files(spark, sf).select("path", F.explode(R.prefixes(F.col("path"))).alias("ancestor"))


@query("grf_20_integer_sequence", "SELECT doc_id, i AS chunk, least(512, n_chars - 512 * i) AS size FROM documents, unnest(range(0, CAST(ceil(n_chars / 512.0) AS BIGINT))) t(i)")
def _(spark, sf):
    d = load(spark, sf, "documents").where("n_chars > 0")
    return d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_chars") / 512) - 1)).alias("chunk")).select("doc_id", "chunk", F.least(F.lit(512), F.col("n_chars") - 512 * F.col("chunk")).alias("size"))


@query("msc_01_base64", "SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def _(spark, sf):
    from ..functions.jq import encode_base64

    return load(spark, sf, "documents").select("doc_id", encode_base64(F.col("text")).alias("b64"))


@query("msc_02_xargs_batches", "SELECT l_suppkey AS s, batch, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS args FROM (SELECT l_suppkey, k, (row_number() OVER (PARTITION BY l_suppkey ORDER BY k) - 1) // 7 AS batch FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k FROM lineitem)) GROUP BY 1, 2")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return R.batches(li, "k", 7, "s").select("s", "batch", F.array_join(F.col("args").cast("array<string>"), ",").alias("args"))
