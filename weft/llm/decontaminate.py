"""Benchmark decontamination on DataFrame operations alone.

Benchmark items become windows of 13 normalised words (a shorter item is one
window). Each window is filed under its longest word, the anchor, which is
rare in running text. One scan explodes the words of the documents and probes
a broadcast hash table of anchors; at a hit the full window is compared word
for word, so results are exact. Only verified hits and one marker row for each
document leave the scan.

The broadcast is bounded: a benchmark whose windows exceed ``block_bytes`` is
dealt into blocks by anchor and the documents are scanned once for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, row_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased, and in the text as it stands.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_AS_IS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A separator, so never a word: the marker that keeps a row for each document.
MARK = "\n"


def words(text: Column) -> Column:
    """Normalised words; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """anchor, at (its place in the window), width, gram (the window's words joined) and items (the ids that have the window, as strings)."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("item is not null and size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {size} + 1, 1))")
    cut = item.select("item", F.explode(starts).alias("i"), "w").select("item", F.expr(f"slice(w, i, {size})").alias("g"))
    best = F.expr("array_max(transform(g, (x, k) -> struct(length(x) as n, x as word, k as at)))")
    return cut.select("item", F.size("g").alias("width"), F.array_join("g", " ").alias("gram"), best.alias("b")).groupBy(F.col("b.word").alias("anchor"), F.col("b.at").alias("at"), "width", "gram").agg(F.collect_set("item").alias("items"))


def _hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The keys, doc_id, n_words and, for each verified occurrence, its span and items; the marker row has none."""
    anchored = docs.select("key", "check", "doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit(MARK)))).alias("pos", "word"))
    met = anchored.join(F.broadcast(grams), F.col("word") == F.col("anchor"))
    start = F.col("pos") - F.col("at")
    same = F.expr("pos >= at and pos - at + width <= size(w) and array_join(slice(w, pos - at + 1, width), ' ') = gram")
    return met.where((F.col("width") == 0) | same).select("key", "check", "doc_id", F.when(F.col("width") == 0, F.size("w")).alias("n"), F.when(F.col("width") > 0, F.struct(start.alias("s"), (start + F.col("width")).alias("e"))).alias("span"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_bytes: int = 64 << 20, with_key: bool = False) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    docs needs doc_id and text, benchmark item_id and text; other columns are
    ignored. Returns a row for each input row: doc_id, n_words, n_hit, n_items,
    items (sorted as strings), spans (merged word ranges), items_sha256 and
    contaminated (n_hit > 0 and share * n_hit >= n_words). Null texts have no
    words; items without words or with a null id have no windows; an item id
    that occurs twice counts once; an empty benchmark hits nothing. Texts of any
    length are read whole, repeated rows get a row each, and a null doc_id is a
    document like any other. with_key adds key and check, two hashes of doc_id and
    text to join rows by.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    grams = windows(benchmark, size)
    held = grams.agg(F.sum(F.octet_length("gram") + F.octet_length("anchor") + 64 + F.expr("aggregate(items, 0L, (a, x) -> a + octet_length(x) + 16)"))).first()[0] or 0
    marker = spark.range(1).selectExpr(f"'{MARK}' as anchor", "0 as at", "0 as width", "'' as gram", "cast(array() as array<string>) as items")
    blocks = max(1, -(-int(held) // block_bytes))
    # rows are known by what they hold, which a recomputed partition cannot change; repeated rows are counted
    key, check = row_keys(F.col("doc_id"), F.col("text"))
    hashed = docs.select(key.alias("key"), check.alias("check"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    hits = _hits(hashed, (grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == 0)).unionByName(marker))
    for b in range(1, blocks):
        hits = hits.unionByName(_hits(hashed, grams.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b)))
    found = hits.groupBy("key", "check", "doc_id").agg(F.max("n").cast("long").alias("n_words"), F.count("n").alias("copies"), F.array_sort(F.collect_set("span")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # sorted spans: open a new one where a gap begins, else stretch the last
    merged = F.expr(
        "aggregate(raw, cast(array() as array<struct<s:int,e:int>>), (a, x) -> if(size(a) > 0 and x.s <= a[size(a) - 1].e, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', a[size(a) - 1].s, 'e', greatest(a[size(a) - 1].e, x.e)))), concat(a, array(named_struct('s', x.s, 'e', x.e)))))"
    )
    covered = F.expr("aggregate(raw, struct(0L as n, 0 as reach), (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.reach)) as n, greatest(a.reach, x.e) as reach), a -> a.n)")
    out = found.withColumn("n_hit", covered).withColumn("spans", merged)
    out = out.select(F.expr("explode(sequence(1L, copies))").alias("copy"), "*")
    return out.select(*(["key", "check"] if with_key else []), "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _beside(docs: DataFrame, found: DataFrame, how: str) -> tuple[DataFrame, list[str]]:
    """docs joined with found (key and check first) by what a row holds; and the names of the other columns of found, none of which docs has."""
    taken = list(docs.columns)
    names = []
    for c in found.columns:
        names.append(fresh(f"weft_{c}", taken))
        taken.append(names[-1])
    key, check = row_keys(docs["doc_id"], docs["text"])
    found = found.toDF(*names)
    return docs.join(found, (key == found[names[0]]) & (check == found[names[1]]), how), names[2:]


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated rows; all columns stay as they are, whatever their names."""
    bad = find_contamination(docs, benchmark, size, share, with_key=True).where("contaminated").select("key", "check").distinct()
    return _beside(docs, bad, "left_anti")[0]


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs with hit words taken out of text (the words that stay, in their own case, joined by a space); untouched texts keep their form."""
    hit = find_contamination(docs, benchmark, size, with_key=True).where("n_hit > 0").select("key", "check", "spans").dropDuplicates(["key", "check"])
    joined, (spans,) = _beside(docs, hit, "left")
    own = F.array_remove(F.split(F.col("text"), SEPARATORS_AS_IS), "")
    kept = F.array_join(F.filter(own, lambda w, i: ~F.exists(F.col(spans), lambda s: (s["s"] <= i) & (i < s["e"]))), " ")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l),
h AS (SELECT p.doc_id, p.i, p.l, g.item FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram FROM p) p JOIN g ON g.l = p.l AND g.gram = p.gram),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
