"""Incremental state on Structured Streaming: change capture, upserts, de-duplication, windows and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_changes(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of new files of a Parquet directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dirty_flags(changes: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Flags OR-ed together for each key: what has to be looked at again."""
    return changes.groupBy(*keys).agg(F.bit_or(flag).alias("flags"))


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins: the newest row of each key (a stale generation never replaces a newer one). Of equally new rows the one of greatest hash wins, whatever the order they come in."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_v")).select(*keys, "_v.*")


def apply_batch(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after a batch of changes, idempotent: applying it again changes nothing."""
    return latest(table.unionByName(batch), keys, order)


def revalidated(cached: DataFrame, epochs: DataFrame, keys: list[str], epoch: str, recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows whose epoch still holds, and fresh ones (by `recompute` of the keys) for epochs that drifted or are new.

    cached and what recompute returns have the keys and the epoch; epochs has one row for each key.
    """
    now = epochs.select(*keys, epoch)
    valid = cached.join(now, [*keys, epoch], "left_semi")
    stale = now.join(cached.select(*keys, epoch), [*keys, epoch], "left_anti")
    return valid.unionByName(recompute(stale.select(*keys)).select(*cached.columns))


def upsert_stream(changes: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table of the newest row of each key from a stream.

    Each batch writes a version next to the one that readers see, then a pointer
    of its own (an empty file in done/, made at once); current() reads the
    greatest version that has one. A batch that is run again after a crash writes
    its version anew. Of the versions before, the last one stays for readers that
    have opened it, and the others are deleted.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, target) if v < number]
        table = spark.read.parquet(f"{target}/v={before[-1]}") if before else batch.limit(0)
        apply_batch(table, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path(f"{target}/done"))
        fs.create(path(f"{target}/done/{number}"), True).close()
        for v in before[:-1]:
            fs.delete(path(f"{target}/done/{v}"), False)
            fs.delete(path(f"{target}/v={v}"), True)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a table that upsert_stream() keeps, oldest first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(done)) if fs.exists(done) else []


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last complete batch."""
    versions = _versions(spark, target)
    if not versions:
        raise ValueError(f"no complete version in {target}")
    return spark.read.parquet(f"{target}/v={versions[-1]}")


def deduplicated(events: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """First event of each key within a watermark; state older than it is dropped."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, size: str, lateness: str, *keys: str) -> DataFrame:
    """Counts and sums of tumbling windows (an extension: the model has no event time of its own)."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def retained(events: DataFrame, ts: str, keep: str, now) -> DataFrame:
    """Rows younger than a retention period."""
    return events.where(F.col(ts) >= now - F.expr(f"interval {keep}"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, processed and read back from a memory table (tests and small results)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


#: Injected commands: a name for a DataFrame transform that pipelines can use.
COMMANDS: dict[str, Callable[..., DataFrame]] = {}


def command(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        COMMANDS[name] = f
        return f

    return add
