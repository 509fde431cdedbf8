"""Substring de-duplication with difference-cover anchors.

A window of 50 words is a repeat if the same words also start in a document
with a smaller doc_id. A cover D modulo p holds, for any two alignments, a
shift that brings both onto D; so two equal runs of w + p - 1 words share a
w-word window that starts at a cover position in either document. With p = 31
and its six-element perfect difference set, w = 20 serves windows of 50 words
while hashing 6 of 31 positions.

1. Each group of documents sends its distinct anchor hashes; buckets answer
   which ones another group has too.
2. Around shared anchors the match is extended: every 50-word window that holds
   one is hashed whole and sent with the smallest doc_id the group saw it in;
   buckets answer with a smaller doc_id if another group has one.
3. Each document marks the words of the windows that start in a smaller one.

Bounded memory: a task sees one group (4 to 32 MB of text) or one bucket. Words
are equal if their bytes are within a group and if the 128 bits of XXH3 of their
bytes are between groups; a window's key has 128 bits from two independent
hashes of its words, and both are compared wherever windows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import bytesops as B
from . import exchange as X
from .common import bucket_count, group_count, prepare, text_bytes

U64 = np.uint64
#: Perfect difference sets: each residue modulo the period is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string"


class Cover:
    """Picks the period for a window length: the longest whose anchors keep at least two fifths of it."""

    def __init__(self, window: int):
        self.window = window
        self.period = max((p for p in COVERS if p - 1 <= 0.6 * window), default=1)
        self.width = window - self.period + 1
        self.at = np.zeros(self.period, bool)
        self.at[list(COVERS.get(self.period, (0,)))] = True


class _Group:
    """Word hashes of a group's documents and what follows from them."""

    def __init__(self, table: pa.Table, cover: Cover):
        self.cover = cover
        self.data, self.starts = B.text_buffer(table["text"])
        self.docs = B.doc_ids(table["doc_id"])
        self.words, self.second, self.bounds = B.word_lanes(self.data, self.starts)
        self.owner = np.repeat(np.arange(len(self.docs)), np.diff(self.bounds))
        self.place = np.arange(len(self.words)) - self.bounds[:-1][self.owner] if len(self.words) else np.empty(0, np.int64)
        self.left = self.bounds[1:][self.owner] - np.arange(len(self.words)) if len(self.words) else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchor windows."""
        c = self.cover
        at = np.flatnonzero(c.at[self.place % c.period] & (self.left >= c.width)) if len(self.words) else np.empty(0, np.int64)
        return at, B.runs_of(self.words, c.width)[at]

    def grp(self, table: pa.Table) -> int:
        return table["grp"][0].as_py()


def _send_anchors(buckets: int, cover: Cover):
    def send(table: pa.Table) -> Iterator:
        g = _Group(table, cover)
        keys = np.unique(g.anchors()[1])
        yield from X.deal(g.grp(table), X.bucket_of(keys, buckets), buckets, lambda i: keys[i].tobytes())

    return send


def _pairs(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> bytes:
    """Both halves of window keys with a doc_id each; runs of one document pack well."""
    return len(keys).to_bytes(8, "little") + keys.tobytes() + checks.tobytes() + zstandard.compress(docs.tobytes(), 1)


def _unpair(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(payload)
    n = int.from_bytes(view[:8], "little")
    return np.frombuffer(payload, U64, n, 8), np.frombuffer(payload, U64, n, 8 + 8 * n), np.frombuffer(zstandard.decompress(view[8 + 16 * n :]), np.int64)


def _heads(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where a new window key begins, for sorted keys."""
    return np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.empty(0, bool)


def _send_windows(buckets: int, cover: Cover):
    def send(table: pa.Table, known: pa.Table) -> Iterator:
        if not table.num_rows:
            return
        g = _Group(table, cover)
        at, keys = g.anchors()
        if not len(at):
            return
        shared = np.sort(np.concatenate([np.frombuffer(p, U64) for _, p in X.payloads(known)] or [np.empty(0, U64)]))
        abroad, _ = B.member(keys, shared)
        # anchors that two documents of this group share
        order = np.lexsort((g.owner[at], keys))
        k, o = keys[order], g.owner[at][order]
        pair = (k[1:] == k[:-1]) & (o[1:] != o[:-1])
        both = np.unique(k[1:][pair])
        home = B.member(keys, both)[0]
        reach = cover.window - cover.width + 1

        def near(flag: np.ndarray) -> np.ndarray:
            total = np.zeros(len(g.words) + reach + 1, np.int32)
            total[at[flag] + 1] = 1
            np.cumsum(total, out=total)
            n = len(g.words)
            return (total[reach : reach + n] > total[:n]) & (g.left >= cover.window)

        far, close = near(abroad), near(abroad | home)
        starts = np.flatnonzero(close)
        if not len(starts):
            return
        full, check = B.runs_of(g.words, cover.window)[starts], B.runs_of(g.second, cover.window)[starts]
        docs = g.docs[g.owner[starts]]
        order = np.lexsort((docs, check, full))
        full, check, docs, starts = full[order], check[order], docs[order], starts[order]
        head = _heads(full, check)
        cls = np.cumsum(head) - 1
        firsts = np.flatnonzero(head)
        several = np.zeros(len(firsts), bool)
        several[cls[docs != docs[firsts][cls]]] = True
        abroad_cls = np.zeros(len(firsts), bool)
        abroad_cls[cls[far[starts]]] = True
        grp = g.grp(table)
        mine = firsts[several]
        if len(mine):  # decided here; a bucket only hands it on
            yield grp % buckets, grp, 1, _pairs(full[mine], check[mine], docs[mine])
        out = firsts[abroad_cls]
        out = out[np.argsort(starts[out])]  # in page order the doc_ids come in runs
        if len(out):
            keys, checks, low = full[out], check[out], docs[out]
            yield from X.deal(grp, X.bucket_of(keys, buckets), buckets, lambda i: _pairs(keys[i], checks[i], low[i]))

    return send


def _smaller_elsewhere(table: pa.Table) -> Iterator:
    for g, p in X.payloads(table, 1):
        yield g, 1, bytes(p)
    parts = [(g, *_unpair(p)) for g, p in X.payloads(table, 0)]
    if not parts:
        return
    keys, checks, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = np.lexsort((docs, checks, keys))
    head = _heads(keys[order], checks[order])
    least = np.empty_like(docs)
    least[order] = docs[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    at = 0
    for g, k, c, d in parts:
        low = least[at : at + len(k)]
        at += len(k)
        less = low < d
        if less.any():
            yield g, 0, _pairs(k[less], c[less], low[less])


def _finish(cover: Cover):
    def result(table: pa.Table, known: pa.Table) -> pa.Table:
        g = _Group(table, cover)
        parts = [_unpair(p) for _, p in X.payloads(known)]
        keys, checks = (np.concatenate([p[i] for p in parts] or [np.empty(0, U64)]) for i in (0, 1))
        least = np.concatenate([p[2] for p in parts] or [np.empty(0, np.int64)])
        order = np.lexsort((least, checks, keys))
        keys, checks, least = keys[order], checks[order], least[order]
        head = _heads(keys, checks)
        keys, checks, least = keys[head], checks[head], least[head]
        gone = np.zeros(len(g.words), bool)
        if len(keys) and len(g.words) >= cover.window:
            full, second = B.runs_of(g.words, cover.window), B.runs_of(g.second, cover.window)
            fits = g.left[: len(full)] >= cover.window
            hit, place = B.member(full, keys)
            at = np.flatnonzero(hit)
            while len(at):  # nearly always one turn: keys of equal first half follow each other
                same = checks[place] == second[at]
                yes = at[same][g.docs[g.owner[at[same]]] > least[place[same]]]
                gone[yes] = True
                more = ~same & (place + 1 < len(keys))
                at, place = at[more], place[more] + 1
                more = keys[place] == full[at]
                at, place = at[more], place[more]
            gone[: len(full)] &= fits
            at = np.flatnonzero(gone)
            gone = B.spans_to_cover(at, at + cover.window, len(g.words))
        texts = table["text"].to_pylist()
        rows = []
        for i, text in enumerate(texts):
            mask = gone[g.bounds[i] : g.bounds[i + 1]]
            words = (text or "").encode().split()
            removed = int(mask.sum())
            kept = b" ".join(compress(words, (~mask).tolist()) if removed else words)
            rows.append((len(words), removed, len(B.runs(mask)[0]) if removed else 0, kept.decode(), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table(
            {"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_text": pa.array(cols[3], pa.string()), "kept_sha256": pa.array(cols[4], pa.string())}
        )

    return result


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove every word covered by a `window`-word run that also starts in a document with a smaller doc_id.

    docs needs doc_id and text; other columns, whatever their names, are
    ignored. Returns a row for each input row: doc_id, n_words, n_removed,
    n_spans (runs of removed words), kept_text (kept words joined by a space)
    and kept_sha256. Null text has no words. A null doc_id counts as larger
    than any other, and rows with equal doc_id never remove each other's words.
    """
    prepare(docs.sparkSession)
    cover = Cover(window)
    total = text_bytes(docs)
    rows = X.grouped(docs, group_count(total))
    anchors = bucket_count(total * 0.3)
    repeats = bucket_count(total * 0.9)
    shared = X.reply(X.ask(rows, _send_anchors(anchors, cover)), X.repeated_elsewhere)
    least = X.reply(X.ask_again(rows, shared, _send_windows(repeats, cover)), _smaller_elsewhere)
    return X.finish(rows, least, _finish(cover), SCHEMA)
