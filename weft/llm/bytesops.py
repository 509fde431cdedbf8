"""Vectorised hashing of bytes and words with numpy.

Words are told apart by their bytes (a dictionary for each group of texts) and
known elsewhere by the 128 bits of XXH3; runs of words by two independent
hashes that join halves with a mixing function. The polynomial hashes modulo
2**64 of bytes below only place work (which windows pick which place); they
never decide that two texts are equal.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
NO_DOC = np.iinfo(np.int64).max  # stands for a null doc_id: later than any other

#: ASCII white space: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BLOCK = 1 << 17


def tidy() -> None:
    """Give memory that is free back to the system: a Python worker outlives its groups."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * BLOCK)
        base = _BASES[seed]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[seed] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums S with S[0] = 0 of values times powers of the base."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(len(values), seed)[0], out=out[1:])
    return out


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more entry than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def doc_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else column.fill_null(NO_DOC).to_numpy().astype(np.int64)


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a maximal run without ASCII white space, within a row."""
    n = len(data)
    space = _SPACE[data]
    first, last = ~space, ~space
    begins = starts[1:-1]
    begins = begins[(begins > 0) & (begins < n)]
    if n > 1:
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        first[begins] = ~space[begins]
        last[begins - 1] = ~space[begins - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_table(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some rows, the number of each word in their order, and where each row's words start (one more entry than rows). Words are told apart by their bytes."""
    at, to = word_spans(data, starts)
    bounds = np.searchsorted(at, starts)
    if not len(at):
        return pa.array([], pa.binary()), np.empty(0, np.int64), bounds
    size = to - at
    if size.sum() >= 1 << 31:
        raise ValueError("a group holds more than two gigabytes of words")
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    packed = data[~_SPACE[data]]
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), bounds


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """word_table() with the words as a list."""
    words, index, bounds = word_table(data, starts)
    return words.to_pylist(), index.astype(np.int64), bounds


def digests(items: list[bytes], seed: int = 0) -> np.ndarray:
    """The 128 bits of XXH3 of each item as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in items]), U64).reshape(-1, 2)


def word_lanes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes for each word, the halves of the 128 bits of XXH3 of its bytes, and where each row's words start."""
    words, index, bounds = distinct_words(data, starts)
    both = digests(words)
    return both[:, 0][index], both[:, 1][index], bounds


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * U64(0x9FB21C651E98DF25)
    x += right
    return mix(x)


def runs_of(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of values[i:i+length] for each i where that fits: halves are joined by a mixing function, so that no sum or power can cancel."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, size, now = None, 0, 1, values
    while True:
        if length & size:
            part = now[done:]
            out = part if out is None else _join(out[: len(part)], part)
            done += size
        if size * 2 > length:
            return out[:n] if done > 1 else mix(out[:n] + U64(1))
        now = _join(now[:-size], now[size:])
        size *= 2


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and the place of each that is. A bitmap over the top bits spares most searches."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool), np.empty(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[table >> U64(44)] = True
    maybe = np.flatnonzero(seen[values >> U64(44)])
    place = np.searchsorted(table, values[maybe])
    place[place == len(table)] = 0
    ok = table[place] == values[maybe]
    out = np.zeros(len(values), bool)
    out[maybe[ok]] = True
    return out, place[ok]


def spans_to_cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A mask of `size` places covered by any of the half-open spans."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
