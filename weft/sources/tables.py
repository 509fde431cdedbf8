"""Readers: driver tables, line records, path tables and generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_lines(text: Column) -> Column:
    """Records of a text: a final newline ends the last line instead of opening another; empty text has none."""
    body = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def with_lines(df: DataFrame, text: str = "text", out: str = "lines") -> DataFrame:
    """One array of lines for each row: operators that need neighbours work inside it, without a shuffle."""
    return df.withColumn(out, split_lines(F.col(text)))


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, ln (from 1) and line, a row for each line."""
    return df.select(*keys, F.posexplode(split_lines(F.col(text))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("ln"), "line")


def records(df: DataFrame, *keys: str, text: str = "text", separator: str = "\n\n+") -> DataFrame:
    """Records by a separator pattern (paragraph mode by default); leading and trailing separators are dropped."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"^\n+", ""), r"\n+$", "")
    return df.select(*keys, F.posexplode(F.split(body, separator)).alias("pos", "record")).select(*keys, (F.col("pos") + 1).cast("long").alias("nr"), "record")


def document_paths(documents: DataFrame) -> DataFrame:
    """The documents as files: path source/lang/doc_id.txt, parent, size, rev, content."""
    parent = F.concat_ws("/", "source", "lang")
    return documents.select("doc_id", F.concat(parent, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), parent.alias("parent"), F.col("n_chars").alias("size"), F.col("doc_id").alias("rev"), F.col("text").alias("content"))


def sequence_rows(spark: SparkSession, first: str, step: str, last: str, scale: int) -> DataFrame:
    """seq FIRST STEP LAST on exact decimals: value as text with a fixed number of places."""
    from decimal import Decimal

    a, s, z = Decimal(first), Decimal(step), Decimal(last)
    count = max(0, int((z - a) / s) + 1)
    value = F.lit(a).cast("decimal(38,10)") + F.col("id").cast("decimal(18,0)") * F.lit(s).cast("decimal(18,10)")
    return spark.range(count).select(F.col("id").alias("n"), value.cast(f"decimal(38,{scale})").cast("string").alias("value"))


def read_binary_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files under a directory: path, modification time, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def read_text_tree(spark: SparkSession, *paths: str, separator: str | None = None) -> DataFrame:
    """Lines of text files with the file they come from."""
    reader = spark.read.option("recursiveFileLookup", True)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def mounted(mounts: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """Several path tables as one, each below its mount point."""
    out = None
    for point, df in mounts.items():
        part = df.withColumn(path, F.concat(F.lit(point.rstrip("/") + "/"), F.col(path)))
        out = part if out is None else out.unionByName(part)
    return out
