"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one linear classifier for each bit
predicts it from character n-grams of the whole text; a text's language is the
codeword nearest to the real-valued predictions under a logistic loss weighted
by how well each bit separates. Texts whose two best codewords are nearly
equally near are flagged as ambiguous.

Features are hashed relative frequencies of 1- to 4-grams, so a text's score is
the mean of the weights of its n-grams: one pass with array operations,
block by block, whatever its length. The classifiers are fitted on a bounded
sample: ``per_lang`` different texts of each language, fewer if that would make
more than TEXTS in all, but at least LEAST. Every lang value is learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

PER_LANG = 600
BITS = 15
ORDERS = (1, 2, 3, 4)
TEXTS = 6000
LEAST = 8
PART = 1 << 25
UNKNOWN = "und"
BLOCK = 1 << 15
U32 = np.uint32


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each class: all splits up to 5 classes, else the random code with the largest least distance of 64 tried."""
    if classes <= 5:
        bits = max(1, 2 ** (classes - 1) - 1)
        return np.array([[1 if c == 0 or (b + 1) >> (c - 1) & 1 == 0 else -1 for b in range(bits)] for c in range(classes)], np.int8)
    length = int(np.ceil(10 * np.log2(classes)))
    best, most = None, -1
    rng = np.random.default_rng(seed)
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, length))
        gap = (length - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        least = int(np.min(gap + length * np.eye(classes, dtype=np.int64)))
        if least > most and (np.abs(code.sum(axis=0, dtype=np.int64)) < classes).all():
            best, most = code, least
    return best


class _Kept(dict):
    """For str.translate: letters and marks stay, all else becomes a space; found out once for each character."""

    def __missing__(self, c: int) -> int:
        self[c] = c if unicodedata.category(chr(c))[0] in "LM" else 32
        return self[c]


_KEPT = _Kept()


def clean(text: str | None) -> str:
    """Lower case; each run of other than letters and marks is one space; a space at either end. Empty without a letter."""
    words = (text or "").lower().translate(_KEPT).split()
    if not any(c.isalpha() for w in words for c in w):
        return ""
    return f" {' '.join(words)} "


def gram_slots(text: str, skip: int = 0) -> np.ndarray:
    """Hashed slots of the n-grams of a cleaned text that end at place `skip` or later, all orders one after the other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), U32)
    out, h = [], np.zeros(len(codes), U32)
    for n in ORDERS:
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * U32(0x9E3779B1)
        h ^= h >> U32(15)
        out.append((h[max(0, skip - n + 1) :] * U32(0x85EBCA6B)) >> U32(32 - BITS))
    return np.concatenate(out)


def blocks(text: str) -> Iterator[np.ndarray]:
    """The slots of all n-grams of a cleaned text in blocks, so that memory does not follow its length."""
    over = max(ORDERS) - 1
    for lo in range(0, len(text), BLOCK):
        before = min(lo, over)
        yield gram_slots(text[lo - before : lo + BLOCK], before)


def slot_counts(text: str | None) -> np.ndarray:
    """How often each slot occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for slots in blocks(clean(text)):
        total += np.bincount(slots, minlength=1 << BITS)
    return total


class Model:
    """Weights (slots by bits), bias, codewords, bit weights and labels."""

    def __init__(self, labels: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, scale: float):
        self.labels, self.code, self.weights, self.bias, self.trust, self.scale = labels, code, weights, bias, trust, scale

    def margins(self, text: str) -> np.ndarray | None:
        """Real-valued bit predictions for a cleaned text."""
        if not text:
            return None
        total, n = np.zeros(self.weights.shape[1], np.float64), 0
        for slots in blocks(text):
            total += self.weights[slots].sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / n * self.scale + self.bias

    def decode(self, margins: np.ndarray | None) -> tuple[str, float, bool]:
        """Nearest codeword by weighted logistic loss: label, probability-like score, ambiguity."""
        if margins is None or not self.labels:
            return UNKNOWN, 0.0, True
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)
        near = np.exp(loss.min() - loss)
        p = near / near.sum()
        best = int(np.argmin(loss))
        order = np.sort(p)
        return self.labels[best], float(p[best]), bool(len(order) > 1 and order[-1] - order[-2] < 0.2)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 60) -> Model:
    """Bit classifiers by full-batch gradient steps (Adam) on sparse relative frequencies. samples: (label, slots, counts)."""
    labels = sorted({s[0] for s in samples})
    if not labels:
        return Model([], np.empty((0, 1), np.int8), np.zeros((1 << BITS, 1), np.float32), np.zeros(1), np.ones(1), 1.0)
    code = codewords(len(labels))
    scale = 100.0
    number = {label: i for i, label in enumerate(labels)}
    y = code[[number[s[0]] for s in samples]].astype(np.float32)
    # a few samples at a time: what one step holds does not grow with the number of languages
    parts, lo, most = [], 0, max(1, PART // code.shape[1])
    reach = np.cumsum([len(s[1]) for s in samples])
    while lo < len(samples):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + most, side="right")))
        some = samples[lo:hi]
        col = np.concatenate([s[1] for s in some])
        value = np.concatenate([s[2] / s[2].sum() for s in some]).astype(np.float32) * np.float32(scale)
        sizes = np.array([len(s[1]) for s in some])
        by_col = np.argsort(col, kind="stable")
        ids, first = np.unique(col[by_col], return_index=True)
        parts.append((slice(lo, hi), col, value[:, None], np.cumsum(sizes) - sizes, np.repeat(np.arange(hi - lo), sizes), by_col, ids, first))
        lo = hi
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    balance = 1 / np.maximum(1, np.stack([(y == k).sum(axis=0) for k in (-1, 1)]))
    weight = np.where(y > 0, balance[1], balance[0]).astype(np.float32) / 2
    for t in range(1, rounds + 1):
        grad, shift = 1e-6 * weights, np.zeros_like(bias)
        for at, col, value, heads, row, by_col, ids, first in parts:
            f = np.add.reduceat(weights[col] * value, heads) + bias
            g = -y[at] * weight[at] / (1 + np.exp(np.clip(y[at] * f, -30, 30)))
            grad[ids] += np.add.reduceat((g[row] * value)[by_col], first)
            shift += g.sum(axis=0)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        weights -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.5 * shift
    right = np.zeros(code.shape[1])
    for at, col, value, heads, *_ in parts:
        right += ((y[at] * (np.add.reduceat(weights[col] * value, heads) + bias) > 0) * weight[at]).sum(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    return Model(labels, code, weights, bias.astype(np.float64), trust / trust.mean(), scale)


def learn(docs: DataFrame, per_lang: int = PER_LANG, texts: int = TEXTS) -> Model:
    """Fit on up to per_lang different texts of each lang value (chosen by a hash of the text), fewer where all of them would be more than `texts`, but at least LEAST each."""
    prepare(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    # copies are one text from here on
    keys = materialize(known.groupBy("lang", "key").agg(F.count("*").alias("n")), "languages")
    counts = keys.groupBy("lang").agg(F.count("*").alias("texts")).collect()  # a row a language
    per_lang = max(LEAST, min(per_lang, texts // max(1, len(counts))))
    # a hash threshold for each language leaves about four times what is kept, so that ranking sees few rows
    limit = {r["lang"]: min(1.0, 4 * per_lang / r["texts"]) for r in counts}
    if not limit:
        return fit([])
    h = F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    few = F.broadcast(docs.sparkSession.createDataFrame(list(limit.items()), "lang string, share double"))
    near = keys.join(few, "lang").where(h < F.col("share"))
    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(h, "key"))).where(F.col("rank") <= per_lang).select("lang", "key")
    chosen = known.join(F.broadcast(picked), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))  # TEXTS keys, or LEAST for each language

    def count(batches):
        for batch in batches:
            made = [slot_counts(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([c[a].astype(np.int32) for c, a in zip(made, at, strict=True)], pa.list_(pa.int32()))], names=["lang", "key", "slots", "counts"])

    held = chosen.select("lang", "key", "text").mapInArrow(count, "lang string, key long, slots array<int>, counts array<int>")
    rows = held.where(F.size("slots") > 0).toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    samples = [(a.as_py(), np.asarray(b.values), np.asarray(c.values)) for a, b, c in zip(rows["lang"], rows["slots"], rows["counts"], strict=True)]
    return fit(samples)


def identify(docs: DataFrame, train: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous of each row of docs.

    train gives text and lang to learn from; docs needs doc_id and text, and
    its other columns are ignored. lang_pred is a learned value, `und` (score 0)
    if the text is null or has no letter or nothing was learned. Equal texts get
    equal predictions, repeated rows a row each, and texts of any length are read
    whole. Of equally near codewords the first label in order wins, and the row is
    ambiguous. Copies in train count as one text.
    """
    prepare(docs.sparkSession)
    model = learn(train, per_lang)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS slots by the bits of the code

    def work(batches):
        m = held.value
        for batch in batches:
            rows = [m.decode(m.margins(clean(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double, ambiguous boolean")
