"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where none is set, a local one if the session runs in one process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_MADE: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A written table survives lost executors, is computed once, and frees the
    shuffles that made it. It goes with discard(), at the end of a scratch() or
    when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def _delete(path: str) -> None:
    spark = _MADE.pop(path, None)
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize()."""
    path = getattr(df, "_weft_path", None)
    if path:
        _delete(path)


@contextlib.contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Delete the tables that materialize() writes inside, but for those whose label is in keep."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in set(_MADE) - before:
            if path.rpartition("/")[2].removeprefix("weft-").rpartition("-")[0] not in keep:
                _delete(path)


@atexit.register
def _sweep() -> None:
    for path in list(_MADE):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, in upper or lower case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a row, 128 bits together."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), text, doc_id)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a column; one scan with a partial sum."""
    return df.agg(F.sum(F.octet_length(F.col(col)).cast("long"))).first()[0] or 0


def group_count(total_bytes: int, least: int = 24) -> int:
    """Number of document groups for one pass of the group/bucket exchange.

    A group is the unit that one Python call sees: 4 MB of text up to a
    gigabyte of input, growing with its square root to 32 MB.
    """
    size = min(32e6, max(4e6, 4e6 * math.sqrt(total_bytes / 1e9)))
    return max(least, math.ceil(total_bytes / size))


def bucket_count(message_bytes: float, least: int = 64, size: float = 12e6) -> int:
    """Number of buckets so that one holds about `size` bytes of messages."""
    return max(least, math.ceil(message_bytes / size))


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of doc_id as text leaves `part` modulo `parts`; a null doc_id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
