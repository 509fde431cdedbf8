"""Cutting the lineage of iterative queries at the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint; the folder is spark.checkpoint.dir. Where none is set, a session that runs in one process uses a temporary one; others must set it, as executors do not share their disks."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return df.checkpoint(eager=True)
