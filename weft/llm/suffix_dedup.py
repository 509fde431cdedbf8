"""Exact byte-substring de-duplication by threshold-bounded interval expansion.

A 100-byte string is a repeat if it also starts earlier: in a document with a
smaller doc_id, or before it in the same document. Repeats are found on
Burrows-Wheeler transforms of the text that can repeat at all:

1. Every 100-byte window picks its smallest 32-byte hash, leftmost on ties;
   equal windows pick alike. Groups of documents send their distinct picks and
   learn which ones another group has too.
2. Consecutive windows with one pick form a fragment. Fragments whose pick
   recurs go, one copy of each text from each group, to the bucket of the pick,
   so all windows that could be equal meet there.
3. A bucket joins the fragments of recurring picks, each different text once and
   a text that occurs again a second time, sorts suffixes to the threshold, forms
   the transform and expands intervals breadth-first by backward extension:
   common prefixes come out by increasing length, and the expansion stops at
   100. Suffixes that no boundary parts share 100 bytes; all but the earliest
   window of such a class are repeats. Copies of a text inside a group of
   documents are found the same way there.
4. Each document drops the bytes that repeats cover.

Texts are told apart by their bytes. A pick with more than HOT texts (the edge
of a passage that very many documents share) is split over several buckets by
group. What is earliest in such a part may start earlier in another one: its
windows, by the 128 bits of XXH3 of their bytes, meet in an even second exchange.
So no bucket grows with the number of documents that share a pick.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from . import bytesops as B
from . import exchange as X
from .common import bucket_count, group_count, prepare, text_bytes

U64 = np.uint64
GRAM = 32
BATCH = 1 << 18
HOT = 4096
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols (prefix doubling; a symbol is below 512)."""
    n = len(symbols)
    key = np.zeros(n, U64)
    for i in range(7):
        key <<= U64(9)
        key[: n - i] |= symbols[i:].astype(U64)
    have = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.empty(n, bool)
        step[0] = False
        np.not_equal(ranked[1:], ranked[:-1], out=step[1:])
        level = np.cumsum(step)
        if have >= depth or level[-1] == n - 1:
            return order
        rank = np.empty(n, U64)
        rank[order] = level.astype(U64)
        key = rank << U64(32)
        key[: n - have] |= rank[have:] + U64(1)
        have *= 2


def prefix_boundaries(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Places in the suffix order whose common prefix with the place before is shorter than `least`.

    Symbol 0 ends a fragment; strings that hold it other than at their end are
    not expanded. Entry n is always set.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    inverse = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[inverse] = np.arange(n)
    same = bwt[inverse][1:] == bwt[inverse][:-1]
    following, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[inverse[:-1][same]] = inverse[1:][same]
    before[inverse[1:][same]] = inverse[:-1][same]
    text = bwt != 0
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        top, base = np.repeat(high, size), np.repeat(low, size)
        if length:
            inside = text[at]
            at, top, base = at[inside], top[inside], base[inside]
        lows = np.sort(lf[at[before[at] < base]])
        highs = np.sort(lf[at[following[at] >= top]]) + 1
        fresh = ~found[highs]
        low, high = lows[fresh], highs[fresh]
        found[high] = True
        if not len(low):
            break
    return found


def _ordered(table: pa.Table) -> pa.Table:
    """A group's rows in an order that depends on what they hold alone: a row's place in it stands for the row in messages (only rows that are equal in doc_id and text could change places)."""
    return table.sort_by([("row_key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])


class _Fragments:
    """Maximal runs of windows with one pick, over the documents of a group."""

    def __init__(self, table: pa.Table, window: int):
        table = _ordered(table)
        self.data, self.starts = B.text_buffer(table["text"])
        self.docs = B.doc_ids(table["doc_id"])
        self.grp = table["grp"][0].as_py() if table.num_rows else -1
        data, starts, n = self.data, self.starts, len(self.data)
        parts: list[tuple[np.ndarray, ...]] = []
        span = window - GRAM + 1
        for s0 in range(0, max(0, n - window + 1), B.BLOCK):
            s1 = min(s0 + B.BLOCK, n - window + 1)
            values = B._BYTE[data[s0 : s1 + window - 1]]
            total = B.prefix(values)
            inv = B.powers(len(values) + 1)[1]
            m = len(values) - GRAM + 1
            grams = B.mix((total[GRAM:] - total[:m]) * inv[:m])
            picked = sliding_min(grams >> U64(24) << U64(24) | np.arange(m, dtype=U64), span) & U64(0xFFFFFF)
            fits = np.ones(s1 - s0, bool)
            ends = starts[1:]
            for e in ends[(ends > s0) & (ends < s1 + window - 1)].tolist():
                fits[max(0, e - window + 1 - s0) : max(0, e - s0)] = False
            new = fits.copy()
            new[1:] &= ~fits[:-1] | (picked[1:] != picked[:-1])
            last = fits.copy()
            last[:-1] &= ~fits[1:] | (picked[1:] != picked[:-1])
            a, b = np.flatnonzero(new), np.flatnonzero(last) + window
            parts.append((a + s0, b + s0, grams[picked[a].astype(np.int64)]))
        self.a, self.b, self.pick = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64))

    def rows(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.a, side="right") - 1


def _counted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return len(keys).to_bytes(8, "little") + keys.tobytes() + zstandard.compress(counts.astype(np.uint32).tobytes(), 1)


def _uncounted(payload) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(payload)
    n = int.from_bytes(view[:8], "little")
    return np.frombuffer(payload, U64, n, 8), np.frombuffer(zstandard.decompress(view[8 + 8 * n :]), np.uint32).astype(np.int64)


def _send_picks(buckets: int, window: int):
    def send(table: pa.Table) -> Iterator:
        f = _Fragments(table, window)
        keys, counts = np.unique(f.pick, return_counts=True)
        yield from X.deal(f.grp, X.bucket_of(keys, buckets), buckets, lambda i: _counted(keys[i], counts[i]))

    return send


def _shared_picks(table: pa.Table) -> Iterator:
    """The picks that another group has too, each with the number of fragments that all groups have of it."""
    parts = [(g, *_uncounted(p)) for g, p in X.payloads(table)]
    if not parts:
        return
    keys, inverse, groups = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True, return_counts=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, _, c in parts]), minlength=len(keys)).astype(np.int64)
    at = 0
    for g, k, _ in parts:
        mine = inverse[at : at + len(k)]
        at += len(k)
        mine = mine[groups[mine] > 1]
        if len(mine):
            yield g, 0, _counted(keys[mine], np.minimum(total[mine], (1 << 32) - 1))


def _ranges(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return len(key).to_bytes(8, "little") + key.astype(np.int64).tobytes() + start.astype(np.uint32).tobytes() + end.astype(np.uint32).tobytes()


def _unrange(payload) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(memoryview(payload)[:8], "little")
    return np.frombuffer(payload, np.int64, n, 8), np.frombuffer(payload, np.uint32, n, 8 + 8 * n).astype(np.int64), np.frombuffer(payload, np.uint32, n, 8 + 12 * n).astype(np.int64)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by keys[0]: the class of each row, and each class's first row."""
    head = np.concatenate(([True], keys[0][1:] != keys[0][:-1])) if len(keys[0]) else np.empty(0, bool)
    return np.cumsum(head) - 1, np.flatnonzero(head)


def _same(raw: bytes | memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span; equal numbers are equal bytes."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(bytes(raw[a:b]), len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)


def _parts(total: np.ndarray, hot: int) -> np.ndarray:
    """Over how many buckets a pick with so many fragments is split."""
    return np.maximum(1, -(-total // hot))


def _send_fragments(buckets: int, window: int, hot: int):
    def send(table: pa.Table, known: pa.Table) -> Iterator:
        if not table.num_rows:
            return
        f = _Fragments(table, window)
        if not len(f.a):
            return
        found = [_uncounted(p) for _, p in X.payloads(known)]
        shared, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, U64), np.empty(0, np.int64))
        order = np.argsort(shared)
        shared, total = shared[order], total[order]
        ranked = np.sort(f.pick)
        home = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        abroad, place = B.member(f.pick, shared)
        parts = np.ones(len(f.pick), np.int64)
        parts[abroad] = _parts(total[place], hot)
        take = np.flatnonzero(abroad | B.member(f.pick, home)[0])
        if not len(take):
            return
        row = f.rows()[take]
        a, b, pick, abroad, parts = f.a[take], f.b[take], f.pick[take], abroad[take], parts[take]
        doc, key, at = f.docs[row], row.astype(np.int64), f.a[take] - f.starts[row]
        text = _same(f.data.tobytes(), a, b)
        order = np.lexsort((at, doc, text))
        a, b, pick, abroad, parts, doc, key, at, text = (x[order] for x in (a, b, pick, abroad, parts, doc, key, at, text))
        cls, first = _firsts(text)
        lead = (doc == doc[first][cls]) & (at == at[first][cls])
        late = np.flatnonzero(~lead)
        if len(late):  # the same text starts earlier in this group
            again = late[np.concatenate(([True], cls[late][1:] != cls[late][:-1]))]  # the earliest further copy of a text stands for all
            spans = _expand(f.data, np.concatenate((first[cls[again]], again)), a, b - a, doc, at, np.concatenate((cls[again], cls[again])), window)
            stands = np.zeros(len(first), np.int64)
            stands[cls[again]] = again
            i, s, e = spans.of(stands[cls[late]])
            if len(i):
                yield -1 - f.grp, f.grp, 1, _ranges(key[late[i]], at[late[i]] + s, at[late[i]] + e)
        # one copy of each text, if its pick is known elsewhere or has another text here
        by_pick = np.sort(pick[first])
        varied = np.unique(by_pick[1:][by_pick[1:] == by_pick[:-1]])
        out = np.flatnonzero(lead & (abroad | B.member(pick, varied)[0]))
        a, b, pick, parts, doc, key, at = (x[out] for x in (a, b, pick, parts, doc, key, at))

        def pack(i: np.ndarray) -> bytes:
            raw = b"".join([f.data[s:e].tobytes() for s, e in zip(a[i].tolist(), b[i].tolist(), strict=True)])
            head = pick[i].tobytes() + doc[i].astype(np.int64).tobytes() + key[i].tobytes() + at[i].astype(np.uint32).tobytes() + (b - a)[i].astype(np.uint32).tobytes() + (parts[i] > 1).tobytes()
            return len(i).to_bytes(8, "little") + zstandard.compress(head + raw, 1)

        salt = (f.grp % parts).astype(U64) * U64(0x9E3779B97F4A7C15)
        yield from X.deal(f.grp, X.bucket_of(B.mix(pick + salt), buckets), buckets, pack)

    return send


def _repeats(buckets: int, window: int):
    """Answers of a bucket, in the form of messages: those to a group go to the bucket -1 - group, windows of split picks to an even bucket."""

    def answer(table: pa.Table) -> Iterator:
        for b, g, p in zip(table["bucket"].to_pylist(), table["grp"].to_pylist(), table["payload"], strict=True):
            if b < 0:
                yield b, g, 0, p.as_py()
        heads: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        for g, p in X.payloads(table, 0):
            n = int.from_bytes(memoryview(p)[:8], "little")
            raw = zstandard.decompress(memoryview(p)[8:])
            heads.append((np.full(n, g), np.frombuffer(raw, U64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int64, n, 16 * n), np.frombuffer(raw, np.uint32, n, 24 * n).astype(np.int64), np.frombuffer(raw, np.uint32, n, 28 * n).astype(np.int64), np.frombuffer(raw, bool, n, 32 * n)))
            texts.append(raw[33 * n :])
        if not heads:
            return
        found, open_ = _bucket(heads, b"".join(texts), window)
        for g, payload in _by_group(found):
            yield -1 - g, g, 0, payload
        if len(open_[0]):
            hashed, doc, at, grp, key = open_

            def pack(i: np.ndarray) -> bytes:
                head = doc[i].tobytes() + key[i].tobytes() + grp[i].astype(np.int32).tobytes() + at[i].astype(np.uint32).tobytes()
                return len(i).to_bytes(8, "little") + hashed[i].tobytes() + zstandard.compress(head, 1)

            yield from X.deal(0, X.bucket_of(hashed[:, 0], buckets), buckets, pack, kind=2)

    return answer


def _by_group(found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
    """The ranges of each group, from (group, row, start, end) arrays."""
    if not found:
        return
    grp, key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(grp, kind="stable")
    cuts = np.flatnonzero(np.diff(grp[order], prepend=-1, append=-1) != 0)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = order[lo:hi]
        yield int(grp[i[0]]), _ranges(key[i], start[i], end[i])


def _across(table: pa.Table) -> Iterator:
    """Answers to a group pass through; of equal windows from the parts of a split pick, all but the earliest are repeats."""
    for b, g, p in zip(table["bucket"].to_pylist(), table["grp"].to_pylist(), table["payload"], strict=True):
        if b < 0:
            yield g, 0, p.as_py()
    parts = []
    for _, p in X.payloads(table, 2):
        n = int.from_bytes(memoryview(p)[:8], "little")
        raw = zstandard.decompress(memoryview(p)[8 + 16 * n :])
        parts.append((np.frombuffer(p, U64, 2 * n, 8).reshape(-1, 2), np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n).astype(np.int64), np.frombuffer(raw, np.uint32, n, 20 * n).astype(np.int64)))
    if not parts:
        return
    hashed, doc, key, grp, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc, hashed[:, 1], hashed[:, 0]))
    hashed, doc, key, grp, at = (x[order] for x in (hashed, doc, key, grp, at))
    head = np.concatenate(([True], (hashed[1:] != hashed[:-1]).any(axis=1)))
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (doc != doc[first]) | (at != at[first])
    for g, payload in _by_group([(grp[late], key[late], at[late], at[late] + 1)] if late.any() else []):
        yield g, 0, payload


class _Spans:
    """Runs of repeated windows of some rows (fragments): row, first window and end of each, sorted by row."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.row, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        order = np.argsort(self.row, kind="stable")
        self.row, self.start, self.end = self.row[order], self.start[order], self.end[order]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the rows its runs: place in `rows`, first window and end of each."""
        lo = np.searchsorted(self.row, rows)
        n = np.searchsorted(self.row, rows, side="right") - lo
        at = np.repeat(np.arange(len(rows)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return at, self.start[place], self.end[place]


def _expand(data: np.ndarray, rows: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray, together: np.ndarray, window: int) -> _Spans:
    """The runs of windows of the rows (fragments) that start earlier in another of the rows. Rows of one number in `together` stay in one batch."""
    order = np.argsort(together, kind="stable")
    rows, together = rows[order], together[order]
    ends = np.append(np.flatnonzero(np.diff(together)) + 1, len(rows))
    reach = np.cumsum(size[rows] + 1)
    out = []
    lo = 0
    while lo < len(rows):
        done = reach[lo - 1] if lo else 0
        hi = int(ends[max(np.searchsorted(reach[ends - 1], done + BATCH, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        batch = rows[lo:hi]
        lo = hi
        of, starts, stops = _classes(data, begin[batch], size[batch], doc[batch], at[batch], window)
        out.append((batch[of], starts, stops))
    return _Spans(out)


def _bucket(heads: list[tuple[np.ndarray, ...]], raw: bytes, window: int) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """(group, row, start, end) of repeated windows, and the windows of split picks that are the earliest here."""
    grp, pick, doc, key, at, size, hot = (np.concatenate(x) for x in zip(*heads, strict=True))
    begin = np.cumsum(size) - size
    data = np.frombuffer(raw, np.uint8)
    text = _same(raw, begin, begin + size)
    order = np.lexsort((at, doc, text))
    grp, pick, doc, key, at, size, hot, begin, text = (x[order] for x in (grp, pick, doc, key, at, size, hot, begin, text))
    cls, first = _firsts(text)
    lead = (doc == doc[first][cls]) & (at == at[first][cls])
    late = np.flatnonzero(~lead)
    again = late[np.concatenate(([True], cls[late][1:] != cls[late][:-1]))] if len(late) else late
    # the texts of picks that have several, and the earliest further copy of each text
    ranked = np.sort(pick[first])
    several = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    again_cls = np.zeros(len(first), bool)
    again_cls[cls[again]] = True
    once = first[B.member(pick[first], several)[0] | again_cls]
    rows = np.concatenate((once, again))
    _, numbers = np.unique(pick[rows], return_inverse=True)
    spans = _expand(data, rows, begin, size, doc, at, numbers, window)
    stands = np.where(lead, first[cls], 0)  # the row whose windows speak for this one
    if len(again):
        of = np.zeros(len(first), np.int64)
        of[cls[again]] = again
        stands[late] = of[cls[late]]
    i, s, e = spans.of(stands)
    found = [(grp[i], key[i], at[i] + s, at[i] + e)]
    # of split picks, the windows that are the earliest here
    split = np.flatnonzero(lead & hot)
    open_: list[tuple[np.ndarray, ...]] = []
    i, s, e = spans.of(stands[split])
    cuts = np.searchsorted(i, np.arange(len(split) + 1))
    for k, r in enumerate(split.tolist()):
        n = int(size[r]) - window + 1
        w = np.flatnonzero(~B.spans_to_cover(s[cuts[k] : cuts[k + 1]], e[cuts[k] : cuts[k + 1]], n))
        lo = int(begin[r])
        open_.append((np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[lo + x : lo + x + window]) for x in w.tolist()]), U64).reshape(-1, 2), np.full(len(w), doc[r]), at[r] + w, np.full(len(w), grp[r]), np.full(len(w), key[r])))
    empty = np.empty(0, np.int64)
    return found, tuple(np.concatenate(x) for x in zip(*open_, strict=True)) if open_ else (np.empty((0, 2), U64), empty, empty, empty, empty)


def _classes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that start earlier in another fragment: fragment, first window and end of each, in order."""
    place = np.cumsum(size + 1) - (size + 1)
    symbols = np.zeros(int(size.sum() + len(size)), np.int16)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    symbols[place[owner] + inner] = data[begin[owner] + inner].astype(np.int16) + 1
    order = suffix_order(symbols, window)
    cls = np.empty(len(symbols), np.int64)
    cls[order] = np.cumsum(prefix_boundaries(symbols, order, window)[:-1])
    fits = inner <= size[owner] - window
    owner, inner = owner[fits], inner[fits]
    cls = cls[place[owner] + inner]
    start, of = at[owner] + inner, doc[owner]
    ranked = np.lexsort((start, of, cls))
    k, first = _firsts(cls[ranked])
    lead = ranked[first][k]
    later = np.zeros(len(cls), bool)
    later[ranked] = (of[ranked] != of[lead]) | (start[ranked] != start[lead])
    hit = np.flatnonzero(later)
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)))
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(hit)) - 1
    return owner[hit[firsts]], inner[hit[firsts]], inner[hit[lasts]] + 1


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; spans that touch become one."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    firsts = np.flatnonzero(new)
    return start[firsts], reach[np.append(firsts[1:], len(start)) - 1]


def _without(text: bytes, starts: list[int], ends: list[int], whole: bool) -> bytes:
    """The bytes outside the spans; whole: spans shrink to whole UTF-8 characters."""
    out, done = [], 0
    for s, e in zip(starts, ends, strict=True):
        if whole:
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
        out.append(text[done:s])
        done = e
    out.append(text[done:])
    return b"".join(out)


def _finish(window: int, with_text: bool, with_rest: bool):
    def result(table: pa.Table, known: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, starts = B.text_buffer(table["text"])
        raw = data.tobytes()
        parts = [_unrange(p) for _, p in X.payloads(known)]
        key, s, e = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        order = np.argsort(key, kind="stable")
        key, s, e = key[order], s[order], e[order] - 1 + window
        cuts = np.searchsorted(key, np.arange(table.num_rows + 1)).tolist()
        at = starts.tolist()
        size, removed, spans, digest, kept_text = [], [], [], [], []
        for i in range(table.num_rows):
            text = raw[at[i] : at[i + 1]]
            a, b = _merge(s[cuts[i] : cuts[i + 1]], e[cuts[i] : cuts[i + 1]]) if cuts[i + 1] > cuts[i] else (s[:0], s[:0])
            a, b = a.tolist(), b.tolist()
            size.append(len(text))
            removed.append(sum(b) - sum(a))
            spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            digest.append(hashlib.sha256(_without(text, a, b, False) if a else text).hexdigest())
            kept_text.append((_without(text, a, b, True) if a else text).decode() if with_text else None)
        B.tidy()
        out = {"doc_id": table["doc_id"].cast(pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "spans": pa.array(spans, _SPANS), "kept_sha256": pa.array(digest, pa.string()), "kept_text": pa.array(kept_text, pa.string())}
        return pa.table(out | ({"rest": table["rest"]} if with_rest else {}))

    return result


def dedup_suffixes(docs: DataFrame, window: int = 100, with_text: bool = True, rest: Column | None = None, hot: int = HOT) -> DataFrame:
    """Drop every byte covered by a `window`-byte string that also starts earlier.

    docs needs doc_id and text; other columns, whatever their names, are
    ignored. Returns a row for each input row: doc_id, n_bytes, n_removed,
    n_spans, spans (maximal removed runs, byte offsets), kept_sha256 (of the
    remaining bytes) and, with with_text, kept_text (spans shrunk to whole
    characters, else null); and, with rest, a column of docs that goes along with
    its row. Null text is empty; a null doc_id counts as larger
    than any other; rows with equal doc_id count as one document, ordered by
    start, so that exact repeats of a row keep their text. Texts of any length are
    read whole; hot is the number of fragments beyond which a pick is split, and
    does not change the result.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    prepare(docs.sparkSession)
    total = text_bytes(docs)
    rows = X.grouped(docs, group_count(total), **({} if rest is None else {"rest": rest}))
    picks = bucket_count(total * 0.25)
    fragments = bucket_count(total * 1.0, least=256, size=3e6)
    shared = X.reply(X.ask(rows, _send_picks(picks, window)), _shared_picks)
    asked = X.pass_on(X.ask_again(rows, shared, _send_fragments(fragments, window, hot)), _repeats(fragments, window))
    found = X.reply(asked, _across)
    schema = StructType.fromDDL(SCHEMA)
    if rest is not None:
        schema = schema.add("rest", rows.schema["rest"].dataType)
    return X.finish(rows, found, _finish(window, with_text, rest is not None), schema)
