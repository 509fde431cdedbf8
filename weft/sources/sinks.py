"""Sinks: appends, several outputs of one plan, and files that are replaced at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def append_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """>>: the lines join those that are already there; their order is that of the files."""
    df.select(F.col(line).alias("value")).write.mode("append").text(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Chunks of a stream appended as Parquet, each batch once, until nothing is left to read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def tee(df: DataFrame, *paths: str) -> DataFrame:
    """Write df to every path and go on with it. The plan runs once: later writes, and what follows, read the first."""
    first, *rest = paths
    publish(df, first)
    written = df.sparkSession.read.schema(df.schema).parquet(first)
    for path in rest:
        publish(written, path)
    return written


def publish(df: DataFrame, path: str) -> None:
    """> and -o: the result appears at the path as a whole after it is complete, so the path may be an input of df.

    It is written next to the path and moved there; readers see the old table
    or the new one, or for a moment none. The old table waits at path.old; should
    the program end in that moment, recover() or the next publish() puts it back.
    """
    recover(df.sparkSession, path)
    spark = df.sparkSession
    beside = path.rstrip("/")
    fresh = f"{beside}.{uuid.uuid4().hex}.new"
    df.write.parquet(fresh)
    target, fs = _files(spark, path)
    new, old = _files(spark, fresh)[0], _files(spark, f"{beside}.old")[0]
    if fs.exists(target):
        fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(new, target):
        raise OSError(f"{path} could not be written")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put the old table back if a publish() ended between its two moves; whether it did."""
    target, fs = _files(spark, path)
    old = _files(spark, f"{path.rstrip('/')}.old")[0]
    return not fs.exists(target) and fs.exists(old) and fs.rename(old, target)


def edit_in_place(spark: SparkSession, path: str, change) -> None:
    """sed -i and sort -o: the table at the path replaced by change(table)."""
    publish(change(spark.read.parquet(path)), path)
