"""Group/bucket exchange: exact global questions about hashed keys without a row per key.

Documents are dealt into groups of a few megabytes by a hash of the row. Each
group sends one message per bucket, a packed array of its own distinct keys
(so a key that a third of all documents share costs a group one entry, and a
bucket at most one entry for each group). A bucket answers each group; the
answers meet the group's documents again in a co-grouped call. The documents
are shuffled once: the exchange by group is the same in every phase and Spark
reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytesops import tidy

U64 = np.uint64
MESSAGE = "bucket int, grp int, kind int, payload binary"
ANSWER = "grp int, kind int, payload binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_ANSWER_ARROW = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def grouped(docs: DataFrame, groups: int, **more: Column) -> DataFrame:
    """doc_id, text, row_key (hash of both), grp and the columns of `more` of each row; other columns stay out. row_key only deals rows out: two rows may share one."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("row_key"), *(c.alias(n) for n, c in more.items())).withColumn("grp", F.pmod(F.col("row_key"), F.lit(groups)).cast("int"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """An even bucket from the high bits of hashed keys."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def deal(grp: int, bucket: np.ndarray, buckets: int, pack: Callable[[np.ndarray], bytes], kind: int = 0) -> list[tuple[int, int, int, bytes]]:
    """One message for each bucket that gets anything; pack() is given the rows that go there."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, grp, kind, pack(order[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def messages(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    tidy()
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MESSAGE_ARROW)], schema=_MESSAGE_ARROW)


def answers(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    tidy()
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ANSWER_ARROW)], schema=_ANSWER_ARROW)


def ask(docs: DataFrame, send: Callable[[pa.Table], Iterable[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Messages of each group from its documents alone."""
    return docs.groupBy("grp").applyInArrow(lambda t: messages(send(t)), MESSAGE)


def ask_again(docs: DataFrame, known: DataFrame, send: Callable[[pa.Table, pa.Table], Iterable[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Messages of each group from its documents and the answers it got."""
    return docs.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(lambda d, a: messages(send(d, a)), MESSAGE)


def reply(asked: DataFrame, answer: Callable[[pa.Table], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """Answers of each bucket to the groups that wrote to it."""
    return asked.groupBy("bucket").applyInArrow(lambda t: answers(answer(t)), ANSWER)


def pass_on(asked: DataFrame, answer: Callable[[pa.Table], Iterable[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Further messages of each bucket, from those it got."""
    return asked.groupBy("bucket").applyInArrow(lambda t: messages(answer(t)), MESSAGE)


def finish(docs: DataFrame, known: DataFrame, result: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    return docs.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(result, schema)


def payloads(table: pa.Table, kind: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(grp, payload) of each row, of one kind if given."""
    for g, k, p in zip(table["grp"].to_pylist(), table["kind"].to_pylist(), table["payload"], strict=True):
        if kind is None or k == kind:
            yield g, p.as_buffer()


def repeated_elsewhere(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """Answer to arrays of keys (distinct within a group): those that another group has too."""
    parts = [(g, np.frombuffer(p, U64)) for g, p in payloads(table)]
    every = np.concatenate([v for _, v in parts]) if parts else np.empty(0, U64)
    order = np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(every), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = 0
    for g, v in parts:
        mine = v[hit[at : at + len(v)]]
        at += len(v)
        if len(mine):
            yield g, 0, mine.tobytes()
