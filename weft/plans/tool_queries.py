"""Programs, drawings, formats, listings, resumable closures and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..operators import version as V
from ..operators.lineage import cut
from ..sources.tables import document_paths, lines, load
from ..streaming import incremental as S
from . import jq, shell
from .awk import awk
from .graph_queries import _edges, _reach, _seeds
from .registry import query
from .relational_queries import FILES
from .text_queries import FIELDS, LINES


def _part_lines(spark, sf):
    """The parts of each brand as one text of lines: size, name."""
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(" ", F.col("p_size"), F.col("p_type")).alias("line"))))
    return load(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


@query("udf_05_awk_function", "SELECT p_brand, CAST(sum(p_size * p_size + 1) AS VARCHAR) || ' ' || count(*) || chr(10) AS out FROM part GROUP BY p_brand")
def _(spark, sf):
    return awk(_part_lines(spark, sf), "function square(x) { return x * x } { total += square($1) + 1 } END { print total, NR }", "text", ("p_brand",)).select("p_brand", "out")


@query("awk_group_in_order", f"SELECT doc_id, string_agg(k || ' ' || n, chr(10) ORDER BY first) || chr(10) AS out FROM (SELECT doc_id, coalesce(f[1], '') AS k, count(*) AS n, min(ln) AS first FROM {FIELDS} GROUP BY doc_id, coalesce(f[1], '')) GROUP BY doc_id")
def _(spark, sf):
    return awk(load(spark, sf, "documents"), "{ n[$1]++ } END { for (k in n) print k, n[k] }").select("doc_id", "out")


@query("awk_range", f"SELECT doc_id, ln, line FROM (SELECT doc_id, ln - 1 AS ln, ln || ': ' || line AS line FROM {LINES} WHERE ln BETWEEN 2 AND 4)")
def _(spark, sf):
    return shell.run(lines(load(spark, sf, "documents"), "doc_id"), "awk 'NR == 2, NR == 4 { print NR \": \" $0 }'")


@query("awk_substitute", "SELECT p_brand, string_agg(regexp_replace(p_size || ' ' || p_type, '[AEIOU]+', '<' || chr(92) || '0>', 'g') || ' ' || length(regexp_replace(p_size || ' ' || p_type, '[^AEIOU]+', ' ', 'g')), chr(10) ORDER BY p_partkey) || chr(10) AS out FROM part GROUP BY p_brand")
def _(spark, sf):
    return awk(_part_lines(spark, sf), '{ s = $0; gsub(/[^AEIOU]+/, " ", s); gsub(/[AEIOU]+/, "<&>"); print $0 " " length(s) }', "text", ("p_brand",)).select("p_brand", "out")


NODES = f"(SELECT DISTINCT unnest([[split_part(path, '/', 1)], [split_part(path, '/', 1), split_part(path, '/', 2)], string_split(path, '/')]) AS p FROM {FILES})"


@query("prj_17_tree", f"WITH n AS (SELECT p, array_to_string(p, '/') AS path, array_to_string(p[:-2], '/') AS dir, p[-1] AS name FROM {NODES}), e AS (SELECT *, name = max(name) OVER (PARTITION BY dir) AS ends FROM n) SELECT e.path, len(e.p) AS depth, CASE WHEN len(e.p) > 1 THEN CASE WHEN a.ends THEN '    ' ELSE '│   ' END ELSE '' END || CASE WHEN len(e.p) > 2 THEN CASE WHEN b.ends THEN '    ' ELSE '│   ' END ELSE '' END || CASE WHEN e.ends THEN '└── ' ELSE '├── ' END || e.name AS line FROM e JOIN e a ON a.path = e.p[1] LEFT JOIN e b ON len(e.p) > 2 AND b.path = array_to_string(e.p[1:2], '/')")
def _(spark, sf):
    return R.tree_lines(document_paths(load(spark, sf, "documents")))


@query("prj_18_log_format", "SELECT o_orderkey, substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 7) || ' ' || sha1(CAST(o_orderkey AS VARCHAR)) || ' 100%' || chr(10) || '  ' || o_orderpriority || ' <' || o_custkey || '>' AS line FROM orders")
def _(spark, sf):
    columns = {"H": F.sha1(F.col("o_orderkey").cast("string").cast("binary")), "B": F.concat_ws("\n", F.col("o_orderpriority"), F.lit("details")), "ae": F.col("o_custkey")}
    return load(spark, sf, "orders").select("o_orderkey", V.log_line("%h %H 100%%%n  %s <%ae>", columns).alias("line"))


@query("jon_13_one_row_parameters", "SELECT o_orderkey FROM orders, (SELECT 100.0 AS low, 50000.0 AS high) WHERE o_totalprice BETWEEN low AND high")
def _(spark, sf):
    # one row of parameters is a pair of literals: they reach the scan, no join is planned
    low, high = 100.0, 50000.0
    return load(spark, sf, "orders").where(F.col("o_totalprice").between(low, high)).select("o_orderkey")


@query("jon_18_full_join", "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def _(spark, sf):
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full_outer")


@query("win_05_consecutive_runs", "SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS first_id, count(*) AS n FROM (SELECT user_id, event_id, event_type, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS opens FROM events)) GROUP BY user_id, run")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    opens = load(spark, sf, "events").select("user_id", "event_id", "event_type", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("long").alias("opens"))
    runs = opens.withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("win_07_context_frame", f"SELECT doc_id, ln, line FROM (SELECT *, max(CASE WHEN contains(line, 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM {LINES}) WHERE near = 1")
def _(spark, sf):
    return shell.run(lines(load(spark, sf, "documents"), "doc_id"), "grep --no-group-separator -B 1 -A 2 the")


@query("srt_13_spilling_sort", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def _(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("srt_16_check_order", f"SELECT doc_id, min(ln) AS disorder FROM (SELECT doc_id, ln, line < lag(line) OVER (PARTITION BY doc_id ORDER BY ln) AS bad FROM {LINES}) WHERE bad GROUP BY doc_id")
def _(spark, sf):
    text = F.split("text", "\n")
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size("l"), F.lit(2))), lambda i: F.coalesce(F.get("l", i - 1) < F.get("l", i - 2), F.lit(False)))
    return load(spark, sf, "documents").select("doc_id", text.alias("l")).select("doc_id", F.get(at, F.lit(0)).cast("long").alias("disorder")).where("disorder is not null")


@query("set_10_except_intersect", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 100 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier))")
def _(spark, sf):
    c, s = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).unionByName(c.intersect(s).select((F.col("k") + 100).alias("k")))


#: Commits are orders; a commit's tree is its customer's, and a tree holds the parts with its number modulo 20.
OBJECTS = "(SELECT 'commit ' || child AS child, 'commit ' || parent AS parent FROM {edges} UNION ALL SELECT 'commit ' || o_orderkey, 'tree ' || o_custkey % 20 FROM orders UNION ALL SELECT 'tree ' || p_partkey % 20, 'blob ' || p_partkey FROM part)"


def _objects(spark, sf):
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), c.cast("string"))
    commits = _edges(spark, sf).select(name("commit", F.col("child")).alias("child"), name("commit", F.col("parent")).alias("parent"))
    trees = load(spark, sf, "orders").select(name("commit", F.col("o_orderkey")).alias("child"), name("tree", F.col("o_custkey") % 20).alias("parent"))
    blobs = load(spark, sf, "part").select(name("tree", F.col("p_partkey") % 20).alias("child"), name("blob", F.col("p_partkey")).alias("parent"))
    return cut(commits.unionByName(trees).unionByName(blobs))


def _objects_sql():
    from .graph_queries import EDGES

    return f"WITH RECURSIVE r AS (SELECT 'commit 140' AS node UNION SELECT e.parent FROM r JOIN {OBJECTS.format(edges=EDGES)} e ON e.child = r.node) SELECT split_part(node, ' ', 1) AS kind, count(*) AS n FROM r GROUP BY 1"


@query("grf_15_object_closure", _objects_sql())
def _(spark, sf):
    seeds = spark.createDataFrame([(0, "commit 140")], "seed int, node string")
    return G.closure(_objects(spark, sf), seeds).groupBy(F.substring_index("node", " ", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("stm_04_resumable_closure", f"SELECT node FROM {_reach('1400')}")
def _(spark, sf):
    edges = _edges(spark, sf)
    state, done = cut(_seeds(spark, 1400).withColumn("depth", F.lit(0))), False
    while not done:
        state, done = G.advance(edges, state, 4)
    return state.select("node")


@query("stm_05_epoch_invalidation", "SELECT user_id, max(event_id) AS epoch, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    e = load(spark, sf, "events")
    total = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("epoch"), F.count("*").alias("n"))
    epochs = e.groupBy("user_id").agg(F.max("event_id").alias("epoch"))
    return S.revalidated(total(e.where("event_id < 990")), epochs, ["user_id"], "epoch", lambda keys: total(e.join(keys, "user_id", "left_semi")))


@query("msc_03_find_delete", f"SELECT path, size FROM {FILES} WHERE NOT (size > 2000 AND lang_of = 'de')".replace(FILES, FILES.replace("SELECT doc_id,", "SELECT doc_id, lang AS lang_of,", 1)))
def _(spark, sf):
    files = document_paths(load(spark, sf, "documents")).select("path", "size")
    gone = files.where((F.col("size") > 2000) & F.col("path").rlike("^[^/]*/de/")).select("path")
    return files.join(gone, "path", "left_anti")


@query("msc_05_move_tree", f"SELECT CASE WHEN starts_with(path, 'src2/') THEN 'old/' || path ELSE path END AS path, parent = 'src2/en' AS moved_en FROM {FILES}")
def _(spark, sf):
    files = document_paths(load(spark, sf, "documents"))
    return files.select(F.when(R.below(F.col("path"), "src2"), F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), (F.col("parent") == "src2/en").alias("moved_en"))


@query("str_19_jaro", "SELECT p_partkey, round(jaro_similarity(p_type, p_name), 6) AS likeness FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.round(V.jaro_similarity("p_type", "p_name"), 6).alias("likeness"))


@query("dat_08_interval", "SELECT event_id, ts + INTERVAL 90 MINUTE AS later, date_diff('second', TIMESTAMP '2024-01-01', ts) AS age FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return load(spark, sf, "events").select("event_id", (ts + F.expr("interval 90 minutes")).alias("later"), F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.date_trunc("second", ts)).alias("age"))


@query("jsn_13_def_arguments", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 10 + 3 AS out FROM events")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), "def scale(f; $by): f * $by; def plus(n): . + n; scale(.k; 10) | plus(3)", "props", ("event_id",)).select("event_id", F.col("out").cast("long").alias("out"))


@query("jsn_15_output_forms", "SELECT event_id, '{' || chr(10) || '  \"a\": \"\\u00e9\",' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS out FROM events")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), '{k, a: "é"}', "props", ("event_id",), form={"sort_keys": True, "indent": 2, "ascii": True}).select("event_id", "out")


def _versions(spark, sf):
    """Three versions of each document: itself, its first line doubled, and its last line replaced."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    first = F.substring_index("text", "\n", 1)
    return d.select("doc_id", "text", F.concat(first, F.lit("\n"), "text").alias("ours"), F.concat("text", F.lit("\nnew end")).alias("theirs"))


@query("dif_04_listing", "SELECT doc_id, '1a2' || chr(10) || '> ' || split_part(text, chr(10), 1) AS out FROM documents WHERE len(string_split(text, chr(10))) > 1 AND split_part(text, chr(10), 1) <> split_part(text, chr(10), 2)")
def _(spark, sf):
    parts = F.split("text", "\n")
    two = _versions(spark, sf).where((F.size(parts) > 1) & (F.get(parts, F.lit(0)) != F.get(parts, F.lit(1))))
    return two.select("doc_id", V.diff_listing("text", "ours").alias("out"))


@query("dif_13_virtual_base", "SELECT doc_id, 0 AS conflicts, text || chr(10) || 'new end' AS merged FROM documents")
def _(spark, sf):
    v = _versions(spark, sf)
    m = v.select("doc_id", V.merge_over_bases("text", F.array("text", "theirs"), "theirs", "theirs").alias("m"))
    return m.select("doc_id", "m.conflicts", F.col("m.text").alias("merged"))


@query("dif_15_combined_diff", "SELECT doc_id, '@@@ -1,1 -1,2 +1,2 @@@' || chr(10) || '  head' || chr(10) || '- ' || doc_id || chr(10) || ' -' || lang || chr(10) || '++merged' AS out FROM documents".replace("-1,1 -1,2", "-1,2 -1,2"))
def _(spark, sf):
    d = load(spark, sf, "documents")
    a, b = (F.concat(F.lit("head\n"), F.col(c).cast("string")) for c in ("doc_id", "lang"))
    return d.select("doc_id", V.diff_combined(F.array(a, b), F.lit("head\nmerged")).alias("out"))


@functools.cache
def _folder(spark) -> str:
    """A folder of the shared one for what sink queries write."""
    import uuid

    cut(spark.range(0))  # sets the folder where none is set
    return f"{spark.sparkContext.getCheckpointDir()}/weft-sinks-{uuid.uuid4().hex}"


@query("snk_02_append", "SELECT p_partkey, p_name FROM part")
def _(spark, sf):
    import uuid

    p = load(spark, sf, "part").select("p_partkey", "p_name")
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    for half in (0, 1):
        p.where(F.col("p_partkey") % 2 == half).write.mode("append").parquet(path)
    return spark.read.schema(p.schema).parquet(path)


@query("snk_06_tee", "SELECT 'a' AS which, p_partkey FROM part WHERE p_size > 25 UNION ALL SELECT 'b', p_partkey FROM part WHERE p_size > 25")
def _(spark, sf):
    import uuid

    from ..sources.sinks import tee

    paths = [f"{_folder(spark)}/{uuid.uuid4().hex}" for _ in "ab"]
    tee(load(spark, sf, "part").where("p_size > 25").select("p_partkey"), *paths)
    a, b = (spark.read.parquet(path).select(F.lit(name).alias("which"), "p_partkey") for name, path in zip("ab", paths, strict=True))
    return a.unionByName(b)


@query("snk_07_edit_in_place", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def _(spark, sf):
    import uuid

    from ..sources.sinks import edit_in_place, publish

    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    publish(load(spark, sf, "part").select("p_partkey", "p_name"), path)
    edit_in_place(spark, path, lambda t: t.withColumn("p_name", F.upper("p_name")).orderBy("p_name"))
    return spark.read.parquet(path)
