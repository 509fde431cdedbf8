"""Hashed maximum-entropy language model with a class-factored softmax.

A word is reached over a path of nested classes, sixteen ways at each level: the
first two levels stand for its ending, the others for the word itself, and their
number grows with the vocabulary. P(word | history) is the product of one softmax
for each level and of the word's share of its last class. Every softmax adds up
hashed features of the history, each joined with the class reached so far: the
previous word, the two previous words, the word before the previous one (skip),
and the endings of both with whether a third word stands before them (their number of slots grows with the vocabulary too).

Counts are exact over all training tokens: groups of documents send their
different words to buckets that tell words apart by their bytes. The weights are
trained by distributed gradient updates in the form of iterative scaling: in
every round each task adds up, over every position of its texts, how often each
feature occurred with each class and how often the model expected it; the sums
of all tasks, which are whole numbers and so do not depend on how rows are dealt,
give one step for each weight. A hash of doc_id and text deals every training row to
one of the rounds, so that each position is learned from once; the steps get
shorter, down to what iterative scaling allows for that many features. Texts are scored in sparse numpy batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import exchange as X
from .common import bucket_count, group_count, materialize, prepare, text_bytes

U64 = np.uint64
BRANCH = 16
#: Levels of a full path; a model uses as many of them as its vocabulary asks for.
DEEPEST = 4
LEAST = 3
#: Words to a last class, about, from which a model takes another level.
CROWD = 2048
#: The first class of the end of a text; words have the others.
END_CLASS = BRANCH - 1
TEMPLATES = 4
#: Steps of the rounds: the share of log(observed / expected) that a weight moves by.
RATES = (0.9, 0.6, 0.3)
#: Added to both sides of that quotient.
PRIOR = 8.0
#: Expected counts are summed in units of 1 / UNIT.
UNIT = 32768
BATCH = 1 << 16
CHUNK = 1 << 11
#: No weight goes beyond this; four of them stay far from what a 32-bit exponential can hold.
MOST = 15.0
SLICES = 16
END = b""
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_FIRST = np.array([(BRANCH**level - 1) // (BRANCH - 1) for level in range(DEEPEST + 1)])


class Words:
    """Different words: hashed (128 bits of each, in two columns), a key of the ending, and the full path (DEEPEST digits to the base 16). The empty word is the end of a text."""

    def __init__(self, words: pa.Array):
        self.bytes = words.to_pylist()
        self.hashed = B.digests(self.bytes)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = words.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
        length = np.diff(at)
        tail = np.zeros(len(words), U64)
        for k in range(3):
            tail |= np.where(length > k, data[np.maximum(at[1:] - 1 - k, 0)], 0).astype(U64) << U64(8 * k)
        size = np.minimum(length, 4).astype(U64)
        self.ending = B.mix(tail | size << U64(24))
        shape = B.mix(tail & U64(0xFFFF) | (size <= U64(3)).astype(U64) << U64(16)) % U64(BRANCH * (BRANCH - 1))
        rest = 4 * (DEEPEST - 2)
        self.path = (shape << U64(rest) | self.hashed[:, 0] >> U64(64 - rest)).astype(np.int64)
        self.path[length == 0] = END_CLASS << 4 * (DEEPEST - 1)

    def buckets(self, buckets: int) -> np.ndarray:
        return X.bucket_of(self.hashed[:, 1], buckets)


class Tokens:
    """The words of some texts by number, each text's words and then its end."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        data, starts = B.text_buffer(column)
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data | 32, data).astype(np.uint8)
        words, index, bounds = B.word_table(data, starts)
        rows = len(starts) - 1
        self.bounds = bounds + np.arange(rows + 1)  # where each text's tokens start, ends counted in
        n = len(index) + rows
        self.words = Words(pa.concat_arrays([words, pa.array([END], pa.binary())]))
        self.index = np.full(n, len(words), np.int32)
        word = np.ones(n, bool)
        word[self.bounds[1:] - 1] = False
        self.index[word] = index
        #: how many tokens of its text stand before a token, up to three
        self.before = np.full(n, 3, np.int8)
        for k in (2, 1, 0):
            at = self.bounds[:-1] + k
            self.before[at[at < self.bounds[1:]]] = k

    def __len__(self) -> int:
        return len(self.index)

    def contexts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """A key of each template for the tokens lo to hi, from the tokens before them in their text; and their full paths."""
        blank = len(self.words.bytes)  # stands before a text
        back = []
        for k in (1, 2):
            at = np.full(hi - lo, blank, np.int64)
            skip = max(0, k - lo)
            at[skip:] = self.index[lo + skip - k : hi - k]
            at[self.before[lo:hi] < k] = blank
            back.append(at)
        one, two = back
        hashed, ending = (np.append(x, U64(0x1B873593)) for x in (self.words.hashed[:, 0], self.words.ending))
        pair, endings = (B.mix(x[one] * U64(0x9FB21C651E98DF25) + x[two]) for x in (hashed, ending))
        endings = B.mix(endings + (self.before[lo:hi] > 2).astype(U64))
        return np.stack([endings, hashed[one], hashed[two], pair]), self.words.path[self.index[lo:hi]]


class Model:
    """levels of the paths, slots of a template, bias (a row of class weights for each node), table (one for each slot of each template) and the statistics of the last classes."""

    def __init__(self, leaves: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        """From the different full paths, and how many training tokens and different words each has."""
        end = leaves >> 4 * (DEEPEST - 1) == END_CLASS
        self.tokens, self.types = int(tokens.sum()), int(types.sum())
        words = max(1, self.types - int(end.any()))
        self.levels = max(LEAST, min(DEEPEST, math.ceil(math.log(max(1, words / CROWD), BRANCH))))
        self.bits = max(10, min(15, math.ceil(math.log2(words)) + 1))
        last = leaves >> 4 * (DEEPEST - self.levels)
        size = BRANCH**self.levels
        n, v = (np.bincount(last, weights=x, minlength=size) for x in (tokens, types))
        self.denominator = np.log(n + v + 1)
        self.bias = np.zeros((_FIRST[self.levels], BRANCH), np.float32)
        for level in range(self.levels):
            below = n.reshape(BRANCH ** (level + 1), -1).sum(axis=1).reshape(-1, BRANCH)
            share = (below + 0.5) / (below.sum(axis=1, keepdims=True) + 0.5 * BRANCH)
            self.bias[_FIRST[level] : _FIRST[level + 1]] = np.log(share)
        self.key = B.mix(np.arange(1, len(self.bias) + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
        self.table = np.zeros((TEMPLATES, 1 << self.bits, BRANCH), np.float32)

    def steps(self, contexts: np.ndarray, path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the tokens that have it, their node, the class they take and a slot of each template."""
        end = path >> 4 * (DEEPEST - 1) == END_CLASS
        for level in range(self.levels):
            at = np.flatnonzero(~end) if level else np.arange(len(path))
            digits = path[at] >> 4 * (DEEPEST - 1 - level)
            node = _FIRST[level] + (digits >> 4)
            slots = ((contexts[:, at] ^ self.key[node]) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)
            yield at, node, digits & (BRANCH - 1), slots

    def scores(self, node: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Weights of the classes; they are too small for exp() to overflow."""
        z = np.empty((len(node), BRANCH), np.float32)
        more = np.empty((CHUNK, BRANCH), np.float32)
        for lo in range(0, len(node), CHUNK):  # stays in the cache
            part = z[lo : lo + CHUNK]
            one = more[: len(part)]
            np.take(self.bias, node[lo : lo + CHUNK], axis=0, out=part, mode="clip")
            for t in range(TEMPLATES):
                np.take(self.table[t], slots[t, lo : lo + CHUNK], axis=0, out=one, mode="clip")
                part += one
        return z

    def log_prob(self, contexts: np.ndarray, path: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(token | history), for tokens with these counts in the training texts."""
        last = path >> 4 * (DEEPEST - self.levels)
        out = np.log(counts + 1.0) - self.denominator[last]
        out[path >> 4 * (DEEPEST - 1) == END_CLASS] = 0.0  # the only one of its class
        for at, node, own, slots in self.steps(contexts, path):
            z = self.scores(node, slots)
            out[at] += z[np.arange(len(at)), own].astype(np.float64) - np.log(np.exp(z).sum(axis=1, dtype=np.float64))
        return out

    def tally(self, contexts: np.ndarray, path: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Add what these tokens show of each feature and class, and what the model expects."""
        for _, node, own, slots in self.steps(contexts, path):
            z = self.scores(node, slots)
            np.exp(z, out=z)
            z *= np.float32(UNIT) / z.sum(axis=1, keepdims=True)
            np.rint(z, out=z)
            for t in range(TEMPLATES):
                np.add.at(observed[t].reshape(-1), slots[t] * BRANCH + own, 1)
            for k in range(BRANCH):  # whole numbers below 2**53: exact in any order
                share = z[:, k].astype(np.float64)
                for t in range(TEMPLATES):
                    expected[t, k] += np.bincount(slots[t], weights=share, minlength=1 << self.bits)


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes."""
    size = B.text_buffer(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _group_counts(table: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """A group's tokens, the order of its words by their hashes, and how often each word occurs in its training texts."""
    tokens = Tokens(table["text"])
    train = np.repeat(~table["held"].to_numpy(), np.diff(tokens.bounds))
    counts = np.bincount(tokens.index[train], minlength=len(tokens.words.bytes))
    return tokens, np.lexsort(tokens.words.hashed.T), counts


def _send_counts(buckets: int):
    def send(table: pa.Table) -> Iterator:
        if not table.num_rows:
            return
        tokens, order, counts = _group_counts(table)
        words = tokens.words.bytes

        def pack(i: np.ndarray) -> bytes:
            mine = [words[j] for j in order[i].tolist()]
            size = np.array(list(map(len, mine)), np.uint32)
            return len(mine).to_bytes(8, "little") + zstandard.compress(size.tobytes() + counts[order[i]].astype(np.int64).tobytes() + b"".join(mine), 1)

        yield from X.deal(table["grp"][0].as_py(), tokens.words.buckets(buckets)[order], buckets, pack)

    return send


def _totals(table: pa.Table) -> Iterator:
    """Answer each group with the corpus counts of its words, in its order; and say what the bucket's words add to the statistics of the paths."""
    parts: list[tuple[int, int]] = []
    words, counts = [], []
    for g, p in X.payloads(table):
        n = int.from_bytes(memoryview(p)[:8], "little")
        raw = zstandard.decompress(memoryview(p)[8:])
        at = np.zeros(n + 1, np.int32)
        np.cumsum(np.frombuffer(raw, np.uint32, n), out=at[1:])
        words.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(raw[12 * n :])]))
        counts.append(np.frombuffer(raw, np.int64, n, 4 * n))
        parts.append((g, n))
    every = pa.concat_arrays(words).dictionary_encode()
    index, known = every.indices.to_numpy(), every.dictionary
    total = np.bincount(index, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    at = 0
    for g, n in parts:
        yield g, bucket, zstandard.compress(total[index[at : at + n]].tobytes(), 1)
        at += n
    seen = np.flatnonzero(total > 0)
    path = Words(known.take(pa.array(seen))).path
    yield from _statistics(path, total[seen], np.ones(len(seen), np.int64))


def _statistics(path: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Sums for each path, in one row for each first class (kind -1 - class)."""
    paths, inverse = np.unique(path, return_inverse=True)
    n, v = (np.bincount(inverse, weights=x, minlength=len(paths)).astype(np.int64) for x in (tokens, types))
    first = paths >> 4 * (DEEPEST - 1)
    for k in np.unique(first).tolist():
        i = first == k
        yield -1, -1 - k, zstandard.compress(np.stack([paths[i], n[i], v[i]]).tobytes(), 1)


def _unpack(payload) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), np.int64).reshape(3, -1)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, so that the empty high bytes of small ones cost nothing."""
    return zstandard.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplane(payload) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def _train(rows: DataFrame, model: Model, rate: float) -> None:
    """One round over every position of the rows: a step for each weight."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)  # bounded by the deepest path and the most slots
    cells = TEMPLATES * BRANCH << model.bits
    step = cells // SLICES
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def work(batches):
        from pyspark import TaskContext

        m = held.value
        observed, expected = np.zeros((TEMPLATES, 1 << m.bits, BRANCH), np.int64), np.zeros((TEMPLATES, BRANCH, 1 << m.bits))
        some = False
        for batch in batches:
            column = batch.column(0)
            for lo, hi in _slices(column, 4 << 20):
                tokens = Tokens(column.slice(lo, hi - lo))
                for at in range(0, len(tokens), BATCH):
                    m.tally(*tokens.contexts(at, min(at + BATCH, len(tokens))), observed, expected)
                    some = True
        if some:
            salt = TaskContext.get().partitionId() % salts
            flat = expected.transpose(0, 2, 1).astype(np.int64).reshape(-1)
            seen = observed.reshape(-1)
            B.tidy()
            for i in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([_planes(seen[i * step : (i + 1) * step])], pa.binary()), pa.array([_planes(flat[i * step : (i + 1) * step])], pa.binary())], names=["slice", "salt", "seen", "due"])

    def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        seen, due = np.zeros(step, np.int64), np.zeros(step, np.int64)
        for s, d in zip(table["seen"], table["due"], strict=True):
            seen += _unplane(s.as_buffer())
            due += _unplane(d.as_buffer())
        return seen, due

    def join(table: pa.Table) -> pa.Table:
        seen, due = added(table)
        return pa.table({"slice": table["slice"][:1], "salt": table["salt"][:1], "seen": pa.array([_planes(seen)], pa.binary()), "due": pa.array([_planes(due)], pa.binary())})

    def move(table: pa.Table) -> pa.Table:
        seen, due = added(table)
        delta = rate * np.log((seen + PRIOR) / (due / UNIT + PRIOR))
        return pa.table({"slice": table["slice"][:1], "delta": pa.array([zstandard.compress(delta.astype(np.float16).tobytes(), 1)], pa.binary())})

    ddl = "slice int, salt int, seen binary, due binary"
    parts = rows.mapInArrow(work, ddl).groupBy("slice", "salt").applyInArrow(join, ddl).groupBy("slice").applyInArrow(move, "slice int, delta binary").collect()  # one row a slice
    weights = model.table.reshape(-1)
    for r in parts:
        weights[r["slice"] * step : (r["slice"] + 1) * step] += np.frombuffer(zstandard.decompress(r["delta"]), np.float16).astype(np.float32)
    np.clip(weights, -MOST, MOST, out=weights)
    held.unpersist()


def _finish(buckets: int, held):
    def result(table: pa.Table, known: pa.Table) -> pa.Table:
        model = held.value
        tokens, order, _ = _group_counts(table)
        count = np.zeros(len(order), np.int64)
        bucket = tokens.words.buckets(buckets)[order]
        by_bucket = order[np.argsort(bucket, kind="stable")]
        cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
        for b, p in zip(known["kind"].to_pylist(), known["payload"], strict=True):
            count[by_bucket[cuts[b] : cuts[b + 1]]] = np.frombuffer(zstandard.decompress(p.as_buffer()), np.int64)
        heads = tokens.bounds[:-1]
        rows = table.num_rows
        n_tokens = np.diff(tokens.bounds)
        c = count[tokens.index]
        n_known = np.add.reduceat((c > 0).astype(np.int64), heads) if rows else n_tokens
        base = np.add.reduceat((np.log10(count + 1.0) - np.log10(model.tokens + model.types + 1))[tokens.index], heads) if rows else np.zeros(0)
        score = base
        if model.tokens and rows:
            each = [model.log_prob(*tokens.contexts(at, min(at + BATCH, len(tokens))), c[at : at + BATCH]) for at in range(0, len(tokens), BATCH)]
            score = np.add.reduceat(np.concatenate(each), heads) / np.log(10)
        B.tidy()
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "held_out": table["held"], "n_tokens": n_tokens, "n_known": n_known, "train_tokens": pa.array(np.full(rows, model.tokens), pa.int64()), "base_score": base, "score": score})

    return result


def score_corpus(docs: DataFrame, held_out: Column, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Score every text, learning from the rows where held_out is false.

    docs needs doc_id and text; other columns are ignored. Tokens are words
    (A-Z lower-cased) and one end for each text; null text is empty, and texts
    of any length are read whole. Returns a row for each input row, repeated
    rows included: doc_id, held_out (a null held_out is false), n_tokens, n_known
    (tokens that occur in training texts), train_tokens, base_score (add-one
    unigram, log10) and score (the model's log10 probability of the text; the
    base score if there is nothing to learn from). Equal texts get equal scores;
    words of equal counts are not ranked, so ties cannot change a score.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    total = text_bytes(docs)
    rows = X.grouped(docs, group_count(2 * total), held=F.coalesce(held_out, F.lit(False)))
    buckets = bucket_count(total * 0.25)
    known = materialize(X.reply(X.ask(rows, _send_counts(buckets)), _totals), "counts")

    def add(table: pa.Table) -> pa.Table:
        return X.answers(_statistics(*np.concatenate([_unpack(p) for _, p in X.payloads(table)], axis=1)))

    joined = known.where("kind < 0").groupBy("kind").applyInArrow(add, X.ANSWER).collect()  # one row for each first class, 16**4 paths at most
    model = Model(*(np.concatenate([_unpack(r["payload"]) for r in joined], axis=1) if joined else np.zeros((3, 0), np.int64)))
    learn = docs.where(~F.coalesce(held_out, F.lit(False))).select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit("turn")).alias("place"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / len(rates) / 64e6)) if rates else 1
    for turn, rate in enumerate(rates if model.tokens else ()):
        part = learn.where(F.pmod("place", F.lit(len(rates))) == turn).select("text")
        _train(part.coalesce(tasks), model, rate)  # fewer and larger sums; no shuffle
    held = spark.sparkContext.broadcast(model)
    return X.finish(rows, known.where("kind >= 0"), _finish(buckets, held), SCHEMA)
