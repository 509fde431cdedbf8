"""Text-pipeline queries over documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as T
from ..sources.tables import lines, load, records, with_lines
from .registry import query

LINES = "(SELECT doc_id, ln, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, ln))"


def _docs(spark, sf):
    return load(spark, sf, "documents")


def _part_lines(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("line"))


PART = "(SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS line FROM part)"


@query("flt_01_grep", f"SELECT doc_id, ln, line FROM {LINES} WHERE contains(line, 'the')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), "the", fixed=True)


@query("flt_01_grep_regex", f"SELECT doc_id, ln FROM {LINES} WHERE regexp_matches(line, '(th|an)e? [a-z]+nt')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), r"(th|an)e? [a-z]+nt", basic=False).select("doc_id", "ln")


@query("flt_01_grep_ignore_case_invert", f"SELECT doc_id, ln FROM {LINES} WHERE NOT regexp_matches(line, '(?i)THE')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), "THE", ignore_case=True, invert=True).select("doc_id", "ln")


@query("flt_01_grep_word", rf"SELECT doc_id, ln FROM {LINES} WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])(of|to)($|[^A-Za-z0-9_])')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), "of", "to", word=True).select("doc_id", "ln")


@query("flt_01_grep_whole_line", f"SELECT doc_id, ln FROM {LINES} WHERE regexp_matches(line, '^(?:[A-Z][a-z]+\\.)$')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), r"[A-Z][a-z]+\.", whole=True, basic=False).select("doc_id", "ln")


@query("flt_02_recursive_search", f"SELECT d.source || '/' || d.lang AS dir, l.doc_id, l.ln FROM {LINES} l JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND regexp_matches(l.line, '(?i)license')")
def _(spark, sf):
    docs = _docs(spark, sf).where("lang = 'en'").withColumn("dir", F.concat_ws("/", "source", "lang"))
    return T.grep(docs, "license", keys=("dir", "doc_id"), ignore_case=True, basic=False).select("dir", "doc_id", "ln")


@query("flt_03_only_matching", f"SELECT doc_id, ln, k, match FROM (SELECT doc_id, ln, regexp_extract_all(line, '[a-z]*tion') AS m FROM {LINES}), unnest(m) WITH ORDINALITY AS t(match, k) WHERE match <> ''")
def _(spark, sf):
    return T.only_matching(_docs(spark, sf), "[a-z]*tion", basic=False)


@query("flt_04_files_with_match", "SELECT doc_id FROM documents WHERE contains(text, 'idiot')")
def _(spark, sf):
    return T.files_with(_docs(spark, sf), "idiot")


@query("flt_04_files_without_match", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {LINES} WHERE regexp_matches(line, 'tion[a-z]'))")
def _(spark, sf):
    return T.files_with(_docs(spark, sf), "tion[a-z]", without=True, basic=False)


@query("flt_05_context", f"""
WITH l AS (SELECT *, contains(line, 'icense') AS hit FROM {LINES}),
n AS (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM l),
s AS (SELECT *, CASE WHEN near AND NOT coalesce(lag(near) OVER (PARTITION BY doc_id ORDER BY ln), FALSE) THEN 1 ELSE 0 END AS opens FROM n)
SELECT doc_id, ln, line, hit, CAST(grp AS BIGINT) AS grp FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ln) AS grp FROM s) WHERE near""")
def _(spark, sf):
    return T.context(_docs(spark, sf), "icense", before=1, after=2)


@query("flt_06_multiline_search", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]+\\.\\n[A-Z][a-z]+')) AS BIGINT) AS n FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[a-z]+\.\n[A-Z][a-z]+"), F.lit(0))).cast("long").alias("n"))


@query("flt_07_submatch_offsets", f"""
SELECT doc_id, ln, k, CAST(strlen(array_to_string(parts[1:k], '')) + 3 * (k - 1) AS BIGINT) AS start, CAST(strlen(array_to_string(parts[1:k], '')) + 3 * k AS BIGINT) AS "end"
FROM (SELECT doc_id, ln, string_split(line, 'tio') AS parts FROM {LINES} WHERE contains(line, 'tio')), unnest(range(1, len(parts))) AS t(k)""")
def _(spark, sf):
    parts = lines(_docs(spark, sf), "doc_id").where(F.col("line").contains("tio")).withColumn("parts", F.split("line", "tio"))
    rows = parts.select("doc_id", "ln", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    before = F.octet_length(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""))
    return rows.select("doc_id", "ln", F.col("k").cast("long").alias("k"), (before + 3 * (F.col("k") - 1)).cast("long").alias("start"), (before + 3 * F.col("k")).cast("long").alias("end"))


@query("flt_09_literal_pushdown", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND contains(text, 'avec')")
def _(spark, sf):
    return _docs(spark, sf).where((F.col("lang") == "fr") & T.matches(F.col("text"), "avec")).select("doc_id", "n_chars")


@query("flt_10_basic_regex", f"SELECT doc_id, ln FROM {LINES} WHERE regexp_matches(line, 'th(an|er)+ [[:alpha:]]{{3}}')")
def _(spark, sf):
    return T.grep(_docs(spark, sf), r"th\(an\|er\)\+ [[:alpha:]]\{3\}").select("doc_id", "ln")


@query("flt_16_sed_addresses", f"SELECT doc_id, ln, line FROM {LINES} WHERE ln BETWEEN 2 AND 4 OR ln % 7 = 3")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").where("ln between 2 and 4 or ln % 7 = 3")


@query("flt_17_awk_pattern", f"SELECT doc_id, ln, line FROM {LINES} WHERE regexp_matches(line, '^An') AND length(line) > 40 UNION ALL SELECT -1, 0, 'begin' UNION ALL SELECT -1, 1, 'end'")
def _(spark, sf):
    body = lines(_docs(spark, sf), "doc_id").where(F.col("line").rlike("^An") & (F.length("line") > 40))
    return body.unionByName(spark.sql("SELECT -1L AS doc_id, 0L AS ln, 'begin' AS line UNION ALL SELECT -1L, 1L, 'end'"))


@query("flt_19_uniq_repeated", f"""
WITH l AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY ln) THEN 0 ELSE 1 END AS opens FROM {LINES}),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM l)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(line) AS line, count(*) AS n FROM r GROUP BY doc_id, run HAVING count(*) > 1""")
def _(spark, sf):
    return T.run_lengths(_docs(spark, sf)).where("n > 1")


@query("agg_01_wc", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS words,
CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def _(spark, sf):
    return T.wc(_docs(spark, sf))


@query("agg_01_wc_total", """
SELECT coalesce(source, 'total') AS source, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS newlines, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes
FROM documents GROUP BY ROLLUP (source)""")
def _(spark, sf):
    return T.wc(_docs(spark, sf), keys=("source",)).rollup("source").agg(*(F.sum(c).alias(c) for c in ("newlines", "words", "bytes"))).withColumn("source", F.coalesce("source", F.lit("total")))


@query("agg_02_uniq_count", f"""
WITH l AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY ln) THEN 0 ELSE 1 END AS opens FROM {LINES}),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM l)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(line) AS line, count(*) AS n FROM r GROUP BY doc_id, run""")
def _(spark, sf):
    return T.run_lengths(_docs(spark, sf))


@query("agg_02_sort_uniq_count", f"SELECT line, count(*) AS n FROM {LINES} GROUP BY line HAVING count(*) > 1")
def _(spark, sf):
    return lines(_docs(spark, sf)).groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_03_grep_count", f"SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {LINES} WHERE contains(line, 'the') GROUP BY doc_id) USING (doc_id)")
def _(spark, sf):
    return T.grep_count(_docs(spark, sf), "the", fixed=True)


@query("agg_03_search_count_matching_only", f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE contains(line, 'the') GROUP BY doc_id")
def _(spark, sf):
    return T.grep_count(_docs(spark, sf), "the", fixed=True, zeros=False)


@query("agg_04_search_stats", f"""
SELECT count(DISTINCT doc_id) AS searches, CAST(sum(len(regexp_extract_all(line, 'tion'))) AS BIGINT) AS matches, CAST(sum(CASE WHEN contains(line, 'tion') THEN 1 ELSE 0 END) AS BIGINT) AS matched_lines,
count(DISTINCT CASE WHEN contains(line, 'tion') THEN doc_id END) AS searches_with_match FROM {LINES}""")
def _(spark, sf):
    per = with_lines(_docs(spark, sf)).select(F.size(F.regexp_extract_all("text", F.lit("tion"), F.lit(0))).alias("m"), F.size(F.filter("lines", lambda x: x.contains("tion"))).alias("l"))
    return per.agg(F.count("*").alias("searches"), F.sum("m").cast("long").alias("matches"), F.sum("l").cast("long").alias("matched_lines"), F.count_if(F.col("l") > 0).alias("searches_with_match"))


@query("prj_01_cut_fields", f"SELECT p_partkey, split_part(line, '|', 1) || '|' || split_part(line, '|', 3) || '|' || split_part(line, '|', 4) AS cut FROM {PART}")
def _(spark, sf):
    return _part_lines(spark, sf).select("p_partkey", T.cut_fields(F.col("line"), "3-,1", "|").alias("cut"))


@query("prj_01_cut_complement", f"SELECT p_partkey, split_part(line, '|', 1) || ':' || split_part(line, '|', 4) AS cut FROM {PART}")
def _(spark, sf):
    return _part_lines(spark, sf).select("p_partkey", T.cut_fields(F.col("line"), "2-3", "|", out=":", complement=True).alias("cut"))


@query("prj_02_cut_bytes", f"SELECT p_partkey, line[2:4] || line[7:9] AS cut FROM {PART}")
def _(spark, sf):
    return _part_lines(spark, sf).select("p_partkey", T.cut_bytes(F.col("line"), "7-9,2-4").cast("string").alias("cut"))


@query("prj_03_cut_blank", f"SELECT doc_id, ln, CASE WHEN regexp_matches(line, '[ \\t]') THEN array_to_string(string_split(regexp_replace(line, '[ \\t]+', chr(9), 'g'), chr(9))[2:3], chr(9)) ELSE line END AS cut FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", T.cut_blank(F.col("line"), "2-3").alias("cut"))


FIELDS = f"(SELECT doc_id, ln, line, CASE WHEN trim(line) = '' THEN [] ELSE string_split(trim(regexp_replace(line, '[ \\t]+', ' ', 'g')), ' ') END AS f FROM {LINES})"


@query("prj_04_awk_fields", f"SELECT doc_id, ln, coalesce(f[1], '') AS first, coalesce(f[len(f)], '') AS last, CAST(len(f) AS BIGINT) AS nf FROM {FIELDS}")
def _(spark, sf):
    f = lines(_docs(spark, sf), "doc_id").withColumn("f", T.fields(F.col("line")))
    return f.select("doc_id", "ln", F.coalesce(F.get("f", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("f", F.size("f") - 1), F.lit("")).alias("last"), F.size("f").cast("long").alias("nf"))


@query("prj_04_awk_rebuild", f"SELECT doc_id, ln, array_to_string(f, '-') AS rebuilt FROM {FIELDS}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", F.array_join(T.fields(F.col("line")), "-").alias("rebuilt"))


@query("prj_05_awk_split_char", f"SELECT p_partkey, CAST(len(string_split(line, '|')) AS BIGINT) AS nf, split_part(line, '|', 2) AS second FROM {PART}")
def _(spark, sf):
    f = _part_lines(spark, sf).withColumn("f", T.fields(F.col("line"), "|"))
    return f.select("p_partkey", F.size("f").cast("long").alias("nf"), F.get("f", F.lit(1)).alias("second"))


@query("prj_06_tr", "SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS out FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.tr(F.col("p_name"), "a-z", "A-Z").alias("out"))


@query("prj_06_tr_padded", "SELECT p_partkey, translate(p_name, 'abcde', 'xyyyy') AS out FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.tr(F.col("p_name"), "a-e", "xy").alias("out"))


@query("prj_07_tr_delete", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS out FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.tr(F.col("p_name"), "aeiou", delete=True).alias("out"))


@query("prj_08_tr_squeeze", f"SELECT doc_id, ln, regexp_replace(regexp_replace(line, 'e+', 'e', 'g'), 's+', 's', 'g') AS out FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", T.tr(F.col("line"), "es", squeeze=True).alias("out"))


@query("prj_09_rev", f"SELECT p_partkey, reverse(line) AS out FROM {PART}")
def _(spark, sf):
    return _part_lines(spark, sf).select("p_partkey", F.reverse("line").alias("out"))


@query("prj_10_nl", f"SELECT doc_id, ln, CASE WHEN line <> '' THEN CAST(10 + 5 * (sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) - 1) AS BIGINT) END AS number, line FROM {LINES}")
def _(spark, sf):
    return T.number_lines(_docs(spark, sf), first=10, step=5)


@query("prj_11_cat_squeeze_blank", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS ln, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM {LINES}) WHERE line <> '' OR before IS NULL OR before <> ''")
def _(spark, sf):
    return T.squeeze_blank(_docs(spark, sf))


@query("prj_11_cat_show_ends", f"SELECT doc_id, ln, replace(line, chr(9), '^I') || '$' AS out FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", F.concat(F.replace("line", F.lit("\t"), F.lit("^I")), F.lit("$")).alias("out"))


@query("prj_12_sed_substitute", f"SELECT doc_id, ln, regexp_replace(line, '([a-z]+)tion', '<\\1>') AS out FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", T.substitute(F.col("line"), r"\([a-z]\+\)tion", r"<\1>").alias("out"))


@query("prj_12_sed_substitute_all", f"SELECT doc_id, ln, regexp_replace(line, '(?i)THE', '[\\0]', 'g') AS out FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", T.substitute(F.col("line"), "THE", "[&]", everywhere=True, ignore_case=True).alias("out"))


@query("prj_12_sed_substitute_nth", f"SELECT doc_id, ln, CASE WHEN len(string_split(line, 'an')) > 2 THEN array_to_string(string_split(line, 'an')[1:2], 'an') || '_' || array_to_string(string_split(line, 'an')[3:], 'an') ELSE line END AS out FROM {LINES}")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").select("doc_id", "ln", T.substitute(F.col("line"), "an", "_", nth=2).alias("out"))


@query("prj_13_sed_insert_append", f"SELECT doc_id, ln, 0 AS sub, 'top' AS line FROM {LINES} WHERE ln = 1 UNION ALL SELECT doc_id, ln, 1, line FROM {LINES} WHERE ln <> 2 UNION ALL SELECT doc_id, ln, 2, line FROM {LINES} WHERE ln = 3")
def _(spark, sf):
    rows = lines(_docs(spark, sf), "doc_id")
    sub = F.when(F.col("ln") == 1, F.array(F.struct(F.lit(0).alias("sub"), F.lit("top").alias("line")), F.struct(F.lit(1).alias("sub"), F.col("line"))))
    sub = sub.when(F.col("ln") == 2, F.array().cast("array<struct<sub:int,line:string>>")).when(F.col("ln") == 3, F.array(F.struct(F.lit(1).alias("sub"), F.col("line")), F.struct(F.lit(2).alias("sub"), F.col("line"))))
    return rows.select("doc_id", "ln", F.explode(sub.otherwise(F.array(F.struct(F.lit(1).alias("sub"), F.col("line"))))).alias("r")).select("doc_id", "ln", "r.sub", "r.line")


@query("prj_14_basename_dirname", "SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages")
def _(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.basename(F.col("url")).alias("base"), T.dirname(F.col("url")).alias("dir"))


@query("prj_15_printf", "SELECT o_orderkey, printf('%05d %-10s|%s', o_orderkey, o_orderstatus, o_orderpriority) AS out FROM orders")
def _(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.format_string("%05d %-10s|%s", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("out"))


@query("prj_16_ls_long", "SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, printf('%8d', n_chars) || ' ' || lang AS row FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.concat(F.format_string("%8d", "n_chars"), F.lit(" "), F.col("lang")).alias("row"))


@query("srt_01_sort_bytes", f"SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, ln) AS rank FROM {LINES}")
def _(spark, sf):
    return T.sort_rank(lines(_docs(spark, sf), "doc_id"), ("doc_id",), [F.col("line"), F.col("ln")]).drop("ln")


@query("srt_02_sort_keys", f"SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (PARTITION BY split_part(line, '|', 2) ORDER BY split_part(line, '|', 3) DESC, CAST(split_part(line, '|', 4) AS INT), line, p_partkey) AS rank FROM {PART})")
def _(spark, sf):
    f = _part_lines(spark, sf).withColumn("f", F.split("line", r"\|"))
    keyed = f.select("p_partkey", "line", F.col("f")[1].alias("k1"), F.col("f")[2].alias("k2"), T.leading_number(F.col("f")[3]).alias("k3"))
    return T.sort_rank(keyed, ("k1",), [F.desc("k2"), F.col("k3"), F.col("line"), F.col("p_partkey")]).select("p_partkey", "rank")


@query("srt_03_sort_numeric", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(printf('%.2f', o_totalprice) AS DECIMAL(38,10)), o_orderkey) AS rank FROM orders")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.format_string("%.2f usd", "o_totalprice").alias("t"))
    return T.sort_rank(o, ("o_orderstatus",), [T.leading_number(F.col("t")), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("srt_04_sort_human", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_size, p_partkey) AS rank FROM part")
def _(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("M")), F.col("p_size") % 3 + 1)).alias("h"))
    unit, number = T.human_number(F.col("h"))
    return T.sort_rank(p, ("p_brand",), [unit, number, F.col("p_partkey")]).select("p_partkey", "rank")


@query("srt_05_sort_version", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 12, p_partkey) AS rank FROM part")
def _(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", F.format_string("file-%d.%d.tar", "p_size", F.col("p_partkey") % 12).alias("v"))
    return T.sort_rank(p, ("p_brand",), [T.version_key(F.col("v")), F.col("p_partkey")]).select("p_partkey", "rank")


@query("srt_06_sort_fold_reverse", "SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY upper(regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g')) DESC, line DESC, ln) AS rank FROM " + LINES)
def _(spark, sf):
    key = F.upper(F.regexp_replace("line", "[^A-Za-z0-9 ]", ""))
    return T.sort_rank(lines(_docs(spark, sf), "doc_id"), ("doc_id",), [key.desc(), F.desc("line"), F.col("ln")]).drop("line")


@query("srt_07_sort_unique", f"SELECT doc_id, line, min(ln) AS ln FROM {LINES} GROUP BY doc_id, line")
def _(spark, sf):
    return lines(_docs(spark, sf), "doc_id").groupBy("doc_id", "line").agg(F.min("ln").alias("ln"))


@query("srt_08_head", f"SELECT doc_id, ln, line FROM {LINES} WHERE ln <= 3")
def _(spark, sf):
    return T.head(_docs(spark, sf), 3)


@query("srt_08_head_bytes", "SELECT doc_id, text[1:20] AS head FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.substring("text", 1, 20).alias("head"))


@query("srt_09_tail", f"SELECT doc_id, ln, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln DESC) AS r FROM {LINES}) WHERE r <= 2")
def _(spark, sf):
    return T.tail(_docs(spark, sf), 2)


@query("srt_10_tail_from", f"SELECT doc_id, ln, line FROM {LINES} WHERE ln >= 4")
def _(spark, sf):
    return T.tail(_docs(spark, sf), 4, from_line=True)


@query("win_06_first_disorder", f"SELECT doc_id, min(ln) AS at FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM {LINES}) WHERE line < before GROUP BY doc_id")
def _(spark, sf):
    return T.first_disorder(_docs(spark, sf), "at")


@query("win_08_range_pattern", f"""
WITH m AS (SELECT *, regexp_matches(line, '^The') AS opens, regexp_matches(line, 'tion\\.$') AS closes FROM {LINES}),
s AS (SELECT *, sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM m)
SELECT doc_id, ln, line FROM (SELECT *, max(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, coalesce(seg, 0) ORDER BY ln) AS inside FROM s) WHERE inside = 1""")
def _(spark, sf):
    from pyspark.sql import Window

    rows = lines(_docs(spark, sf), "doc_id").withColumn("opens", F.col("line").rlike("^The")).withColumn("closes", F.col("line").rlike(r"tion\.$"))
    w = Window.partitionBy("doc_id").orderBy("ln")
    seg = rows.withColumn("seg", F.coalesce(F.sum(F.col("closes").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.max(F.col("opens").cast("int")).over(Window.partitionBy("doc_id", "seg").orderBy("ln"))
    return seg.withColumn("inside", inside).where("inside = 1").select("doc_id", "ln", "line")


@query("win_09_nr_fnr", f"SELECT source, doc_id, ln AS fnr, row_number() OVER (PARTITION BY source ORDER BY doc_id, ln) AS nr FROM {LINES} JOIN documents USING (doc_id)")
def _(spark, sf):
    from pyspark.sql import Window

    # lines of earlier documents of the source, from one count each; no line is sorted
    docs = with_lines(_docs(spark, sf)).select("source", "doc_id", F.size("lines").alias("n"), "lines")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id")) - F.col("n")
    return docs.withColumn("before", before).select("source", "doc_id", "before", F.explode(F.expr("if(n > 0, sequence(1, n), array())")).alias("fnr")).select("source", "doc_id", F.col("fnr").cast("long").alias("fnr"), (F.col("before") + F.col("fnr")).cast("long").alias("nr"))


@query("src_21_paragraph_records", f"SELECT conv_id, turn, nr, record FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations WHERE NOT contains(text, chr(10) || chr(10))), unnest(p) WITH ORDINALITY AS t(record, nr)")
def _(spark, sf):
    conv = load(spark, sf, "conversations").where("not contains(text, '\\n\\n')")
    return records(conv, "conv_id", "turn", separator="\n")
