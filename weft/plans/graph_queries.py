"""Graph and version queries: a commit graph from orders, trees from documents, snapshots from parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import version as V
from ..operators.relational import prefixes
from ..sources.tables import document_paths, load
from .registry import query

#: Commits are orders: the first parent is the customer's order before, and every seventh order also merges the order 10 below its number.
EDGES = """(SELECT child, parent, pos FROM (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent, 0 AS pos FROM orders) WHERE parent IS NOT NULL
UNION ALL SELECT a.o_orderkey, b.o_orderkey, 1 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 10 WHERE a.o_orderkey % 7 = 0)"""


def _edges(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    merges = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") - 10).alias("parent"), F.lit(1).alias("pos"))
    real = merges.join(o.select(F.col("o_orderkey").alias("parent")), "parent", "left_semi").select("child", "parent", "pos")
    return G.cut(G.chain(o, "o_orderkey", "o_custkey").unionByName(real))


def _seeds(spark, *nodes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "seed int, node long")


def _reach(node: str) -> str:
    return f"(WITH RECURSIVE r AS (SELECT {node} AS node UNION SELECT e.parent FROM r JOIN {EDGES} e ON e.child = r.node) SELECT node FROM r)"


@query("grf_03_reachability", f"SELECT node FROM {_reach('1400')}")
def _(spark, sf):
    return G.closure(_edges(spark, sf), _seeds(spark, 1400)).select("node")


@query("grf_03_shallow_boundary", f"WITH RECURSIVE r AS (SELECT 1400 AS node UNION SELECT e.parent FROM r JOIN {EDGES} e ON e.child = r.node WHERE r.node % 5 <> 0 OR r.node = 1400) SELECT node FROM r")
def _(spark, sf):
    o = load(spark, sf, "orders").where("o_orderkey % 5 = 0 and o_orderkey <> 1400").select(F.col("o_orderkey").alias("node"))
    return G.closure(_edges(spark, sf), _seeds(spark, 1400), stop=o).select("node")


@query("grf_04_ancestry_stream", f"WITH RECURSIVE r AS (SELECT s AS seed, s AS node FROM (VALUES (900), (1001), (1400)) v(s) UNION SELECT r.seed, e.parent FROM r JOIN {EDGES} e ON e.child = r.node) SELECT seed, node FROM r")
def _(spark, sf):
    seeds = spark.createDataFrame([(n, n) for n in (900, 1001, 1400)], "seed long, node long")
    return G.closure(_edges(spark, sf), seeds).select("seed", "node")


@query("grf_05_commit_trees", f"SELECT node, o_custkey AS tree FROM {_reach('1300')} JOIN orders ON o_orderkey = node")
def _(spark, sf):
    trees = load(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("tree"))
    return G.closure(_edges(spark, sf), _seeds(spark, 1300)).select("node").join(trees, "node")


@query("grf_06_merge_bases", f"WITH c AS (SELECT node FROM {_reach('1239')} INTERSECT SELECT node FROM {_reach('1432')}) SELECT node FROM c WHERE node NOT IN (SELECT e.parent FROM c JOIN {EDGES} e ON e.child = c.node)")
def _(spark, sf):
    return G.merge_bases(_edges(spark, sf), 1239, 1432)


@query("grf_07_divergence", "SELECT pair, count(*) FILTER (m = 1) AS ahead, count(*) FILTER (m = 2) AS behind, count(*) FILTER (m = 3) AS \"both\", CASE WHEN count(*) FILTER (m = 3) = 0 THEN 'unrelated' WHEN count(*) FILTER (m = 1) = 0 AND count(*) FILTER (m = 2) = 0 THEN 'identical' WHEN count(*) FILTER (m = 2) = 0 THEN 'ahead' WHEN count(*) FILTER (m = 1) = 0 THEN 'behind' ELSE 'diverged' END AS verdict FROM (SELECT pair, node, bit_or(side) AS m FROM (" + f"WITH RECURSIVE r AS (SELECT * FROM (VALUES (1, 1, 1400), (1, 2, 1390), (2, 1, 1390), (2, 2, 1400), (3, 1, 1407), (3, 2, 1407), (4, 1, 1400), (4, 2, 1407), (5, 1, 3), (5, 2, 4)) v(pair, side, node) UNION SELECT r.pair, r.side, e.parent FROM r JOIN {EDGES} e ON e.child = r.node) SELECT * FROM r) GROUP BY pair, node) GROUP BY pair")
def _(spark, sf):
    pairs = spark.createDataFrame([(1, 1400, 1390), (2, 1390, 1400), (3, 1407, 1407), (4, 1400, 1407), (5, 3, 4)], "pair int, a long, b long")
    return G.ahead_behind(_edges(spark, sf), pairs)


@query("agg_11_ahead_behind", f"SELECT (SELECT count(*) FROM (SELECT node FROM {_reach('1400')} EXCEPT SELECT node FROM {_reach('1407')})) AS ahead, (SELECT count(*) FROM (SELECT node FROM {_reach('1407')} EXCEPT SELECT node FROM {_reach('1400')})) AS behind")
def _(spark, sf):
    return G.ahead_behind(_edges(spark, sf), spark.createDataFrame([(1, 1400, 1407)], "pair int, a long, b long")).select("ahead", "behind")


@query("grf_08_merge_classification", f"SELECT CASE WHEN 1390 IN (SELECT node FROM {_reach('1400')}) THEN 'already merged' WHEN 1400 IN (SELECT node FROM {_reach('1390')}) THEN 'fast forward' ELSE 'divergent' END AS verdict")
def _(spark, sf):
    d = G.ahead_behind(_edges(spark, sf), spark.createDataFrame([(1, 1400, 1390)], "pair int, a long, b long"))
    return d.select(F.when(F.col("verdict").isin("ahead", "identical"), "already merged").when(F.col("verdict") == "behind", "fast forward").otherwise("divergent").alias("verdict"))


@query("grf_09_log_first_parent", f"WITH RECURSIVE r AS (SELECT 1400 AS node, 0 AS depth UNION ALL SELECT e.parent, r.depth + 1 FROM r JOIN {EDGES} e ON e.child = r.node AND e.pos = 0) SELECT node, depth FROM r")
def _(spark, sf):
    return G.closure(_edges(spark, sf).where("pos = 0"), _seeds(spark, 1400)).select("node", "depth")


@query("grf_10_path_limited_log", f"SELECT node FROM {_reach('1400')} JOIN orders o ON o.o_orderkey = node WHERE NOT EXISTS (SELECT 1 FROM {EDGES} e JOIN orders p ON p.o_orderkey = e.parent WHERE e.child = node AND e.pos = 0 AND p.o_orderstatus = o.o_orderstatus)")
def _(spark, sf):
    edges = _edges(spark, sf)
    state = load(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("state"))
    same = edges.where("pos = 0").join(state.select(F.col("node").alias("child"), F.col("state").alias("a")), "child").join(state.select(F.col("node").alias("parent"), F.col("state").alias("b")), "parent").where("a = b").select(F.col("child").alias("node"))
    return G.closure(edges, _seeds(spark, 1400)).select("node").join(same, "node", "left_anti")


@query("grf_11_linear_range", f"SELECT node FROM {_reach('1400')} WHERE node NOT IN (SELECT node FROM {_reach('1100')})")
def _(spark, sf):
    reach = G.closure(_edges(spark, sf), _seeds(spark, 1400, 1100))
    return reach.groupBy("node").agg(F.min("seed").alias("a"), F.max("seed").alias("b")).where("a = 0 and b = 0").select("node")


@query("grf_12_range_count", f"SELECT count(*) AS n FROM (SELECT node FROM {_reach('1400')} EXCEPT SELECT node FROM {_reach('1200')})")
def _(spark, sf):
    reach = G.closure(_edges(spark, sf), _seeds(spark, 1400, 1200))
    return reach.groupBy("node").agg(F.max("seed").alias("m")).where("m = 0").agg(F.count("*").alias("n"))


@query("grf_13_nth_ancestor", "SELECT o_orderkey AS start, node FROM (SELECT o_orderkey, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node FROM orders) WHERE node IS NOT NULL")
def _(spark, sf):
    return G.nth_ancestor(_edges(spark, sf), load(spark, sf, "orders").select(F.col("o_orderkey").alias("node")), 3)


@query("grf_14_delta_chain", f"WITH RECURSIVE r AS (SELECT DISTINCT o_orderkey AS base, 0 AS depth FROM orders WHERE o_orderkey % 100 = 0 UNION SELECT e.parent, r.depth + 1 FROM r JOIN {EDGES} e ON e.child = r.base AND e.pos = 0) SELECT base AS node, count(*) AS chains FROM r GROUP BY base")
def _(spark, sf):
    starts = load(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("seed"), F.col("o_orderkey").alias("node"))
    reach = G.closure(_edges(spark, sf).where("pos = 0"), starts)
    return reach.select("node", "depth").distinct().groupBy("node").agg(F.count("*").alias("chains"))


@query("grf_16_gc_mark", f"WITH RECURSIVE r AS (SELECT DISTINCT max(o_orderkey) AS node FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority UNION SELECT e.parent FROM r JOIN {EDGES} e ON e.child = r.node) SELECT node FROM r")
def _(spark, sf):
    roots = load(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("node")).select(F.lit(0).alias("seed"), "node")
    return G.closure(_edges(spark, sf), roots).select("node")


@query("grf_17_gc_sweep", f"SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN {_reach('1400')}")
def _(spark, sf):
    marked = G.closure(_edges(spark, sf), _seeds(spark, 1400)).select("node")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("node")).join(marked, "node", "left_anti")


@query("grf_21_replay_list", f"SELECT node, row_number() OVER (ORDER BY node) AS step FROM (SELECT node FROM {_reach('1400')} EXCEPT SELECT node FROM {_reach('1407')})")
def _(spark, sf):
    reach = G.closure(_edges(spark, sf), _seeds(spark, 1400, 1407))
    own = reach.groupBy("node").agg(F.max("seed").alias("m")).where("m = 0")
    return own.select("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")).cast("long").alias("step"))


@query("grf_22_wanted_minus_common", f"SELECT node FROM {_reach('1400')} WHERE node NOT IN (SELECT node FROM {_reach('1300')}) UNION SELECT node FROM {_reach('1450')} WHERE node NOT IN (SELECT node FROM {_reach('1300')})")
def _(spark, sf):
    reach = G.closure(_edges(spark, sf), spark.createDataFrame([(0, 1400), (0, 1450), (1, 1300)], "seed int, node long"))
    return reach.groupBy("node").agg(F.max("seed").alias("m")).where("m = 0").select("node")


@query("srt_14_topological_levels", f"WITH RECURSIVE r AS (SELECT o_orderkey AS node, 0 AS level FROM orders UNION SELECT e.child, r.level + 1 FROM r JOIN {EDGES} e ON e.parent = r.node) SELECT node, CAST(max(level) AS INT) AS level FROM r GROUP BY node")
def _(spark, sf):
    nodes = load(spark, sf, "orders").select(F.col("o_orderkey").alias("node"))
    return G.levels(_edges(spark, sf), nodes)


PATHS = "(SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, sha1('blob ' || strlen(text) || chr(0) || text) AS oid, doc_id FROM documents)"


def _entries(spark, sf, keep):
    """Tree entries of the documents that a condition keeps; a tree is named by what it holds."""
    files = document_paths(load(spark, sf, "documents").where(keep))
    trees = G.cut(V.build_trees(files))
    blobs = files.select(F.col("parent").alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.lit("100644").alias("mode"), V.blob_id(F.col("content")).alias("oid"))
    inner = trees.where("dir <> ''").select(F.when(F.instr("dir", "/") > 0, F.regexp_replace("dir", "/[^/]*$", "")).otherwise("").alias("dir"), F.substring_index("dir", "/", -1).alias("name"), F.lit("40000").alias("mode"), F.col("tree").alias("oid"))
    entries = blobs.unionByName(inner).join(trees, "dir").select("tree", "name", "mode", "oid").distinct()
    return G.cut(entries), trees.where("dir = ''").first()["tree"]


@query("grf_01_tree_walk", f"SELECT path, oid FROM {PATHS}")
def _(spark, sf):
    entries, root = _entries(spark, sf, "true")
    return G.walk_tree(entries, spark.createDataFrame([(root,)], "root string")).select("path", "oid")


@query("grf_02_tree_diff", f"WITH b AS (SELECT * FROM {PATHS} WHERE doc_id % 10 <> 3), a AS (SELECT * FROM {PATHS} WHERE doc_id % 10 <> 4) SELECT coalesce(b.path, a.path) AS path, b.oid AS before_oid, a.oid AS after_oid FROM b FULL JOIN a ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def _(spark, sf):
    one, before = _entries(spark, sf, "doc_id % 10 <> 3")
    two, after = _entries(spark, sf, "doc_id % 10 <> 4")
    return G.diff_trees(one.unionByName(two).distinct(), before, after).select("path", "before_oid", "after_oid")


@query("grf_19_level_resolution", f"SELECT path, oid FROM {PATHS} WHERE path IN ('src0/fr/0.txt', 'src1/en/1.txt', 'src2/en/2.txt', 'no/such/file')")
def _(spark, sf):
    entries, root = _entries(spark, sf, "true")
    wanted = spark.createDataFrame([("src0/fr/0.txt",), ("src1/en/1.txt",), ("src2/en/2.txt",), ("no/such/file",)], "path string")
    at = wanted.select("path", F.split("path", "/").alias("seg"), F.lit(root).alias("tree"))
    for depth in range(3):
        at = at.withColumn("name", F.col("seg")[depth]).join(entries, ["tree", "name"]).select("path", "seg", F.col("oid").alias("tree"))
    return at.select("path", F.col("tree").alias("oid"))


BASE = "(SELECT p_partkey AS path, p_size AS oid FROM part WHERE p_partkey % 9 <> 0)"
OURS = "(SELECT p_partkey AS path, p_size + CASE WHEN p_partkey % 4 = 0 THEN 100 ELSE 0 END AS oid FROM part WHERE p_partkey % 7 <> 0)"
THEIRS = "(SELECT p_partkey AS path, p_size + CASE WHEN p_partkey % 6 = 0 THEN 200 ELSE 0 END AS oid FROM part WHERE p_partkey % 5 <> 0)"


def _side(spark, sf, drop, change=None, by=0):
    p = load(spark, sf, "part").where(f"p_partkey % {drop} <> 0")
    return p.select(F.col("p_partkey").alias("path"), (F.col("p_size") + (F.when(F.col("p_partkey") % change == 0, by).otherwise(0) if change else 0)).cast("int").alias("oid"))


def _sides(spark, sf):
    return _side(spark, sf, 9), _side(spark, sf, 7, 4, 100), _side(spark, sf, 5, 6, 200)


@query("dif_01_change_set", f"SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END AS status FROM {BASE} b FULL JOIN {OURS} a ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def _(spark, sf):
    b, o, _ = _sides(spark, sf)
    return V.change_set(b, o)


@query("dif_05_rename_pairs", "WITH d AS (SELECT p_size AS oid, p_name AS base, p_partkey AS id, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n, p_brand FROM part WHERE p_partkey % 10 = 1), a AS (SELECT p_size AS oid, p_partkey AS id, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n, p_brand FROM part WHERE p_partkey % 10 = 2), s AS (SELECT d.id AS src, a.id AS dst FROM d JOIN a ON d.oid = a.oid AND d.p_brand = a.p_brand AND d.n = a.n), rd AS (SELECT oid, id, row_number() OVER (PARTITION BY oid ORDER BY p_brand, id) AS n FROM d WHERE id NOT IN (SELECT src FROM s)), ra AS (SELECT oid, id, row_number() OVER (PARTITION BY oid ORDER BY p_brand, id) AS n FROM a WHERE id NOT IN (SELECT dst FROM s)) SELECT src, dst FROM s UNION ALL SELECT rd.id, ra.id FROM rd JOIN ra ON rd.oid = ra.oid AND rd.n = ra.n")
def _(spark, sf):
    p = load(spark, sf, "part")
    # directories sort as the brand, then the id at a fixed width
    side = lambda r: p.where(f"p_partkey % 10 = {r}").select(F.concat_ws("/", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), "p_brand").alias("path"), F.col("p_size").alias("oid"))
    num = lambda c: F.split(c, "/")[1].cast("long")
    return V.pair_renames(side(1), side(2)).select(num("source").alias("src"), num("destination").alias("dst"))


@query("dif_06_exact_similarity", "SELECT a.doc_id, 100 AS similarity FROM documents a JOIN (SELECT sha256(text) AS h, min(doc_id) AS low FROM documents GROUP BY 1) b ON sha256(a.text) = b.h WHERE a.doc_id <> b.low")
def _(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("low")), "h").where("doc_id <> low").select("doc_id", F.lit(100).alias("similarity"))


@query("dif_07_status_codes", f"SELECT path, code FROM (SELECT coalesce(h.path, i.path, w.path) AS path, CASE WHEN h.path IS NULL AND i.path IS NULL THEN '??' ELSE (CASE WHEN h.path IS NULL AND i.path IS NOT NULL THEN 'A' WHEN h.path IS NOT NULL AND i.path IS NULL THEN 'D' WHEN h.oid <> i.oid THEN 'M' ELSE ' ' END) || (CASE WHEN i.path IS NOT NULL AND w.path IS NULL THEN 'D' WHEN i.oid <> w.oid THEN 'M' ELSE ' ' END) END AS code FROM {BASE} h FULL JOIN {OURS} i ON h.path = i.path FULL JOIN {THEIRS} w ON coalesce(h.path, i.path) = w.path) WHERE code <> '  '")
def _(spark, sf):
    return V.status_codes(*_sides(spark, sf))


THREE = f"(SELECT coalesce(b.path, o.path, t.path) AS path, b.oid AS b, o.oid AS o, t.oid AS t FROM {BASE} b FULL JOIN {OURS} o ON b.path = o.path FULL JOIN {THEIRS} t ON coalesce(b.path, o.path) = t.path)"


def _three(spark, sf):
    from ..operators.relational import three_way

    met = three_way(*_sides(spark, sf), "path")
    return met.select("path", F.col("base_oid").alias("b"), F.col("current_oid").alias("o"), F.col("incoming_oid").alias("t"))


@query("dif_08_unmerged_codes", f"SELECT path, CASE WHEN b IS NOT NULL AND o IS NULL AND t IS NULL THEN 'DD' WHEN b IS NULL AND o IS NOT NULL AND t IS NULL THEN 'AU' WHEN b IS NOT NULL AND o IS NOT NULL AND t IS NULL THEN 'UD' WHEN b IS NULL AND o IS NULL THEN 'UA' WHEN b IS NOT NULL AND o IS NULL THEN 'DU' WHEN b IS NULL THEN 'AA' ELSE 'UU' END AS code FROM {THREE}")
def _(spark, sf):
    return _three(spark, sf).select("path", V.unmerged_code(F.col("b"), F.col("o"), F.col("t")).alias("code"))


@query("dif_09_untracked_collapse", "WITH f AS (SELECT source || '/' || lang AS dir, CAST(doc_id AS VARCHAR) AS name, doc_id % 7 = 0 AND source <> 'src3' AS tracked FROM documents), d AS (SELECT dir, bool_or(tracked) AS any_ FROM f GROUP BY dir), s AS (SELECT split_part(dir, '/', 1) AS top, bool_or(any_) AS any_ FROM d GROUP BY 1) SELECT DISTINCT CASE WHEN NOT s.any_ THEN s.top || '/' WHEN NOT d.any_ THEN f.dir || '/' ELSE f.dir || '/' || f.name END AS shown FROM f JOIN d USING (dir) JOIN s ON s.top = split_part(f.dir, '/', 1) WHERE NOT f.tracked")
def _(spark, sf):
    d = load(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), ((F.col("doc_id") % 7 == 0) & (F.col("source") != "src3")).alias("tracked"))
    dirs = d.select(F.explode(prefixes(F.col("path"), whole=False)).alias("dir"), "tracked").groupBy("dir").agg(F.bool_or("tracked").alias("holds")).where("not holds").select("dir")
    free = d.where("not tracked").select("path", F.explode(prefixes(F.col("path"), whole=False)).alias("dir")).join(dirs, "dir").groupBy("path").agg(F.min_by("dir", F.length("dir")).alias("top"))
    return d.where("not tracked").join(free, "path", "left").select(F.coalesce(F.concat("top", F.lit("/")), "path").alias("shown")).distinct()


@query("dif_10_three_way_classify", f"SELECT path, CASE WHEN o IS NOT DISTINCT FROM t OR b IS NOT DISTINCT FROM o OR b IS NOT DISTINCT FROM t THEN 'clean' WHEN b IS NULL THEN 'add/add' WHEN o IS NULL OR t IS NULL THEN 'modify/delete' ELSE 'content' END AS kind FROM {THREE}")
def _(spark, sf):
    return _three(spark, sf).select("path", V.classify(F.col("b"), F.col("o"), F.col("t")).alias("kind"))


@query("dif_11_resolve_dimension", f"SELECT path, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t WHEN b IS NOT DISTINCT FROM t THEN o END AS oid FROM {THREE}")
def _(spark, sf):
    return _three(spark, sf).select("path", V.resolve(F.col("b"), F.col("o"), F.col("t"))[0].alias("oid"))


@query("dif_14_collision_relocation", f"SELECT CASE WHEN EXISTS (SELECT 1 FROM {PATHS} x WHERE starts_with(x.path, f.name || '/')) THEN f.name || '~ours' ELSE f.name END AS path FROM (VALUES ('src1'), ('src2/en'), ('other')) f(name)")
def _(spark, sf):
    names = spark.createDataFrame([("src1",), ("src2/en",), ("other",)], "name string")
    dirs = document_paths(load(spark, sf, "documents")).select(F.explode(prefixes(F.col("path"), whole=False)).alias("name")).distinct().withColumn("dir", F.lit(True))
    return names.join(dirs, "name", "left").select(F.when(F.col("dir"), F.concat("name", F.lit("~ours"))).otherwise(F.col("name")).alias("path"))


@query("dif_17_binary_detection", "SELECT doc_id, contains(text, chr(0)) AS bin FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.contains("text", F.lit("\x00")).alias("bin"))


@query("dif_18_sparse_status", f"SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END AS status FROM {BASE} b FULL JOIN {OURS} a ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid AND coalesce(b.path, a.path) % 8 = 0")
def _(spark, sf):
    b, o, _ = _sides(spark, sf)
    dirty = load(spark, sf, "part").where("p_partkey % 8 = 0").select(F.col("p_partkey").alias("path"))
    return V.change_set(b.join(dirty, "path", "left_semi"), o.join(dirty, "path", "left_semi"))


@query("dif_19_replay", f"SELECT path, CASE WHEN t IS NOT DISTINCT FROM o THEN t WHEN b IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t END AS oid FROM {THREE} WHERE b IS DISTINCT FROM t")
def _(spark, sf):
    return _three(spark, sf).where(~F.col("b").eqNullSafe(F.col("t"))).select("path", V.resolve(F.col("b"), F.col("t"), F.col("o"))[0].alias("oid"))


@query("dif_20_status_format", f"SELECT CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END || '  \"' || coalesce(b.path, a.path) || '\"' AS line FROM {BASE} b FULL JOIN {OURS} a ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def _(spark, sf):
    b, o, _ = _sides(spark, sf)
    return V.change_set(b, o).select(F.format_string('%s  "%s"', "status", F.col("path").cast("string")).alias("line"))


def _texts(spark, sf):
    """A text and an edited copy: every fifth line dropped, every seventh changed, one appended."""
    from ..sources.tables import split_lines

    d = load(spark, sf, "documents").select("doc_id", "text", split_lines(F.col("text")).alias("l"))
    edited = F.concat(F.filter(F.transform("l", lambda x, i: F.when((i + 1) % 7 == 0, F.concat(x, F.lit(" edited"))).otherwise(x)), lambda x, i: (i + 1) % 5 != 0), F.array(F.lit("the end")))
    return d.select("doc_id", "text", F.array_join(edited, "\n").alias("other"), "l")


@query("dif_02_line_diff")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", V.diff_texts("text", "other").alias("d")).select("doc_id", "d.inserted", "d.deleted")


@query("dif_03_unified_hunks")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", V.diff_texts("text", "other")["hunks"].alias("hunks"))


@query("agg_12_diff_summary")
def _(spark, sf):
    d = _texts(spark, sf).join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("source", V.diff_texts("text", "other").alias("d"))
    return d.groupBy("source").agg(F.count("*").alias("files"), F.sum("d.inserted").alias("insertions"), F.sum("d.deleted").alias("deletions"))


@query("dif_12_text_merge")
def _(spark, sf):
    t = _texts(spark, sf).withColumn("theirs", F.concat(F.lit("preface\n"), "text"))
    return t.select("doc_id", V.merge_three("text", "other", "theirs").alias("m")).select("doc_id", "m.conflicts", F.sha1(F.col("m.text").cast("binary")).alias("sha1"))


EDITED = "string_agg(CASE WHEN ln % 7 = 0 THEN line || ' edited' ELSE line END, chr(10) ORDER BY ln) FILTER (WHERE ln % 5 <> 0) || chr(10) || 'the end'"


@query("dif_16_patch", f"SELECT doc_id, 0 AS rejected, sha1({EDITED}) AS sha1 FROM (SELECT doc_id, ln, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, ln)) GROUP BY doc_id")
def _(spark, sf):
    t = _texts(spark, sf).withColumn("h", V.diff_texts("text", "other")["hunks"])
    return t.select("doc_id", V.patch_text("text", "h").alias("p")).select("doc_id", F.col("p.rejected").cast("int").alias("rejected"), F.sha1(F.col("p.text").cast("binary")).alias("sha1"))
