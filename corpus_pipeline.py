"""A corpus pipeline over the table documents: five stages of weft.llm in a row.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns them with the columns of documents; the last returns packed
pieces. run() writes every stage's result as Parquet to the shared folder and
reads it again as the next one's docs; a table goes when it is not read any more.

docs needs doc_id and text; all other columns, whatever their names, go along
with their row. Null and empty texts are kept by the first and the two last
filters and are near duplicates of each other; texts of any length are read
whole; an empty table gives an empty one. A doc_id may be null or occur twice:
rows are told apart by doc_id and text, never by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import discard, fresh, held_out, materialize, prepare, row_keys, scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity score reaches 0.3; labels are learned from as in the toxicity query. A null or empty text stays unless a text without a match would go; repeated rows go or stay together."""
    from weft.llm.toxicity import remove_toxic

    labels = table(spark, sf_dir, "labels")
    return remove_toxic(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), threshold=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the one with the smallest doc_id (null after all others), of several with that doc_id the one of smallest hash, and of rows that repeat doc_id and text any one."""
    from weft.llm.simhash import near_duplicates

    k = fresh("weft_key", docs.columns)
    c = fresh("weft_check", docs.columns)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key", "row_check")
    first = near_duplicates(docs, with_key=True).groupBy("root").agg(F.min(place).alias("first"))
    keep = first.select(F.col("first.row_key").alias(k), F.col("first.row_check").alias(c))
    key, check = row_keys(docs["doc_id"], docs["text"])
    kept = docs.withColumns({k: key, c: check}).join(keep, [k, c], "left_semi")
    return kept.dropDuplicates([k, c]).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 100-byte string that also starts earlier out of the texts (whole characters only); n_chars follows. Rows with equal doc_id count as one document, a null doc_id comes after all others, and a null text stays null."""
    from weft.llm.suffix_dedup import dedup_suffixes

    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("null"), *(docs[c].alias(f"c{i}") for i, c in enumerate(others)))
    found = dedup_suffixes(docs, rest=rest)
    cut = F.col("n_removed") > 0
    at = {"text": F.when(~F.col("rest.null"), F.col("kept_text"))}
    for i, c in enumerate(others):
        own = F.col(f"rest.c{i}")
        at[c] = F.when(cut, F.char_length("kept_text").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own
    return found.select(*(at[c].alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are contaminated by the 13-word rule; the others stay as they are, texts without words among them."""
    from weft.llm.decontaminate import remove_documents

    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; a null or empty text is its end alone, and repeated rows are packed as often as they occur."""
    from weft.llm.packing import pack_documents

    return pack_documents(docs, capacity=4096)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express fingerprint components, tokenisation or bin packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(f"stage-{name}"):  # what a stage writes on its way goes with it
            done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
