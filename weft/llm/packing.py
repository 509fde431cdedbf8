"""Best-fit packing of tokenised documents by minimum bin slack.

A bin is filled by the fullest feasible combination of the lengths that are
left: the largest length opens it and a subset-sum dynamic program over bitsets
(bit s is set if some combination fills s places) finds what fills the rest.
The combination is removed and used again as often as the counts allow.

Only the histogram of lengths, at most one count for each length up to the
capacity, decides the bins, so the driver's share has a fixed bound. Pieces are
then numbered within their length, in parallel over salted parts, and looked up
in the table of places.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import materialize, prepare

END_ID = 1
#: Words (in each of two generations) and chunks that a worker remembers.
WORDS = 350_000
CACHE = 150_000
PIECES_PER_PART = 20000
_TOKENIZERS: dict[str, _Tokenizer] = {}
#: One run of letters (ASCII, or a Latin letter of two bytes) and then ASCII marks: each run is one word of the vocabulary's pattern.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Tokenizer:
    """A tokenizer file, and the ids of what it has encoded so far. by_chunk: white space parts the texts, lower-cased, into chunks whose ids are those of the text in a row; each word of the pattern ends in a token of `last`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_chunk = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split["pattern"].get("Regex", "") and bool(suffix) and not spec.get("truncation")
        self.special = [x["content"].encode().lower() for x in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, encoded as it is."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, "<u4").tobytes() for x in encode(texts, add_special_tokens=False)]

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, remembered up to a fixed number of chunks."""
        out = list(map(self.chunks.get, chunks))
        new = [c for c, ids in zip(chunks, out, strict=True) if ids is None]
        if new:
            made = self.encoded(new)
            if len(self.chunks) + len(new) > CACHE:
                self.chunks.clear()
            if len(new) <= CACHE:
                self.chunks.update(zip(new, made, strict=True))
            rest = iter(made)
            out = [next(rest) if ids is None else ids for ids in out]
        return out

    def encoded(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of new chunks. Single words are encoded many at a time, parted at their last tokens and remembered in two generations: when one is full, words that nobody asked for since the one before are forgotten."""
        match = PLAIN.fullmatch
        parts = [m.groups() if (m := match(c)) else None for c in chunks]
        words = {x for p in parts if p for x in p}
        if len(self.words) > WORDS:
            self.older, self.words = self.words, {}
        known = self.words
        older = self.older
        known.update({w: older[w] for w in words - known.keys() if w in older})
        words -= known.keys()
        words.discard(b"")
        todo = list(words)
        for lo in range(0, len(todo), 2048):
            some = todo[lo : lo + 2048]
            (raw,) = self.plain([b" ".join(some).decode()])
            cuts = [0, *((np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()]
            known.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        known[b""] = b""
        other = iter(self.plain([c.decode() for c, p in zip(chunks, parts, strict=True) if not p]))
        return [known[p[0]] + known[p[1]] if p else next(other) for p in parts]


def _loaded(path: str) -> _Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Tokenizer(path)
    return _TOKENIZERS[path]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, END_ID appended: what encode(text, add_special_tokens=False) gives.

    The default vocabulary lower-cases and drops white space before it splits
    into words, so the ids of a text are those of its space-separated chunks in
    a row; equal chunks of these texts are encoded once. Texts that hold the string of an added token, and all texts of a
    tokenizer that is built otherwise, are encoded whole.
    """
    own = _loaded(path)
    end = END_ID.to_bytes(4, "little")
    lower = [(t or "").encode().lower() for t in texts]
    whole = [i for i, x in enumerate(lower) if not own.by_chunk or any(s in x for s in own.special)]
    for i in whole:
        lower[i] = b""
    data = np.frombuffer(b"".join(lower), np.uint8)
    chunks, index, bounds = B.distinct_words(data, np.cumsum([0, *map(len, lower)]))
    ids = own.chunk_ids(chunks).__getitem__
    cuts = bounds.tolist()
    out = [b"".join(map(ids, index[a:b].tolist())) + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, raw in zip(whole, own.plain([texts[i] or "" for i in whole]), strict=True):
        out[i] = raw + end
    return out


def _slices(texts: list[str | None], most: int = 4 << 20) -> Iterable[tuple[int, int]]:
    """Row ranges of about `most` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def tokenized_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 and, with with_ids, ids of each piece of up to `capacity` tokens."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    step = 4 * capacity

    def work(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in _slices(texts):
                made = token_bytes(texts[lo:hi], path)
                count = [-(-len(b) // step) for b in made]
                row = np.repeat(np.arange(lo, hi), count)
                cut = [b[i : i + step] for b in made for i in range(0, len(b), step)]
                piece = np.concatenate([np.arange(n) for n in count])
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) // 4 for c in cut)]), pa.int32()), pa.array(np.frombuffer(b"".join(cut), "<u4").astype(np.int32))) if with_ids else pa.nulls(len(cut), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), ids],
                    names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id"), text).alias("row_key"), text.alias("text")).mapInArrow(work, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths, largest first where there is a choice, whose sum is the largest that fits the room."""
    mask = (1 << room + 1) - 1
    reach, layers = 1, []
    for length in order:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
        if reach >> room:
            break
    left, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> left & 1:
            out.append(length)
            left -= length
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until nothing is left."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        bin_ = [seed, *fullest(counts, order, capacity - seed)]
        counts[seed] += 1
        used = {length: bin_.count(length) for length in set(bin_)}
        times = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * times
        order = [length for length in order if counts[length]]
        out.append((bin_, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted look-up: key (length << 44 | first rank), first sequence and offset of each run of pieces of one length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length << 44 | rank, sequence - rank, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    key, base, offset = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return key, base, offset


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (any columns, with row_key, piece and length up to capacity) and their sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    key, base, offset = places(plan_bins(histogram, capacity))
    parts = max(32, sum(histogram.values()) // PIECES_PER_PART)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("row_key", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row_key", "piece"))
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    held = spark.sparkContext.broadcast((key, base, offset))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        k, b, o = held.value
        at = np.searchsorted(k, (length.to_numpy() << 44) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": b[at] + rank.to_numpy(), "offset": o[at]})

    placed = ranked.withColumn("_place", place(F.col("length"), F.col("_rank")))
    return placed.select(*pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as few sequences of at most `capacity` tokens.

    docs needs doc_id and text; other columns are ignored. A document is its
    token ids and END_ID; null text is empty. Longer documents are cut into
    pieces of `capacity` tokens. Returns a row for each piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset and, with with_ids, ids.
    Repeated rows are packed as often as they occur.
    """
    pieces = materialize(tokenized_pieces(docs, capacity, tokenizer, with_ids), "pieces")
    out = pack(pieces, capacity).drop("row_key")
    return out if with_ids else out.drop("ids")
