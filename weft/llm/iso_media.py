"""ISO base media files as columns: write, walk and describe without decoding payloads.

``pack_samples`` stores bytes losslessly as 8-bit samples of one track;
``describe`` walks the nested boxes, decodes the sample tables (sizes, chunks,
durations, sync samples; movie fragments too) and gives codec, duration and
the byte ranges of samples and keyframes. Payload bytes are only located.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

BLOCK = 64
#: Box types that hold boxes, with the bytes before the first one.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0, b"meta": 4}
SAMPLES_PER_CHUNK = 256
UNITS_PER_SYNC = 16
TIMESCALE = 8000


def box(kind: bytes, *body: bytes) -> bytes:
    """One box; a body past 4 GB gets the 64-bit size form."""
    size = 8 + sum(map(len, body))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *body))


def full(kind: bytes, version: int, flags: int, *body: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def pack_samples(payload: bytes) -> bytes:
    """A file with one track of 8-bit mono samples in access units of 64 bytes, every sixteenth one a sync sample."""
    units = len(payload) // BLOCK
    chunks = -(-units // SAMPLES_PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    ticks = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    sync = np.arange(1, units + 1, UNITS_PER_SYNC, dtype=">u4")
    stsc = [(1, min(units, SAMPLES_PER_CHUNK), 1)]
    if chunks > 1 and units % SAMPLES_PER_CHUNK:
        stsc.append((chunks, units % SAMPLES_PER_CHUNK, 1))

    def moov(data_at: int) -> bytes:
        at = data_at + np.arange(chunks, dtype=np.int64) * (SAMPLES_PER_CHUNK * BLOCK)
        offsets = full(b"co64", 0, 0, struct.pack(">I", chunks), at.astype(">u8").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, units, BLOCK)),
            full(b"stss", 0, 0, struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsz", 0, 0, struct.pack(">II", BLOCK, units)),
            full(b"stsc", 0, 0, struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", 0, 0, bytes(4)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), full(b"hdlr", 0, 0, struct.pack(">I4s", 0, b"soun"), bytes(13)), minf)
        tkhd = full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = full(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + head), box(b"mdat", payload)))


def boxes(data) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first. A box that claims more than its parent ends with it; fewer than 8 bytes end a level. Paths keep their last four names, as boxes may nest to any depth."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if end - start < 8:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and end - start >= 16:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else min(end, start + size)
        if stop < body:
            continue
        here = (*path[-3:], kind)
        yield here, body, stop
        todo.append((stop, end, path))
        if kind in CONTAINERS:
            todo.append((body + CONTAINERS[kind], stop, here))


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ticks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def keyframes(self) -> np.ndarray:
        """(offset, size) of the sync samples."""
        return np.stack([self.offsets[self.sync], self.sizes[self.sync]], axis=1) if len(self.sizes) else np.empty((0, 2), np.int64)

    def ranges(self) -> np.ndarray:
        """(start, end) of the samples in decoding order, joined where they touch."""
        if not len(self.sizes):
            return np.empty((0, 2), np.int64)
        ends = self.offsets + self.sizes
        new = np.concatenate(([True], self.offsets[1:] != ends[:-1]))
        firsts = np.flatnonzero(new)
        return np.stack([self.offsets[firsts], ends[np.append(firsts[1:], len(ends)) - 1]], axis=1)


def _u32(data, at: int, n: int, end: int) -> np.ndarray:
    """n numbers of a table that ends at `end`; a table that claims more is broken."""
    if n < 0 or at + 4 * n > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, ">u4", n, at).astype(np.int64)


def _counted(data, tables: dict[bytes, tuple[int, int]], kind: bytes, per: int = 1) -> np.ndarray:
    """The entries of a full box that holds their number and then `per` numbers for each."""
    at, end = tables[kind]
    return _u32(data, at + 8, per * struct.unpack_from(">I", data, at + 4)[0], end).reshape(-1, per)


def _repeat(values: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """np.repeat up to `most` entries, however often the table says."""
    reach = np.minimum(np.cumsum(np.minimum(times, most)), most)
    return np.repeat(values, np.diff(reach, prepend=0))


def _expand(track: Track, tables: dict[bytes, tuple[int, int]], data) -> None:
    """Per-sample sizes, offsets, durations and sync flags from the sample tables. Samples of one size need no table, so the size of the file bounds their number."""
    if b"stsz" in tables:
        at, end = tables[b"stsz"]
        one, n = struct.unpack_from(">II", data, at + 4)
        if one * n > len(data):
            raise ValueError("samples of one size reach beyond the file")
        track.sizes = np.full(n, one, np.int64) if one else _u32(data, at + 12, n, end)
    elif b"stz2" in tables:
        at, end = tables[b"stz2"]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        raw = np.frombuffer(data, np.uint8, max(0, end - at - 12), at + 12)
        track.sizes = (np.stack([raw >> 4, raw & 15], 1).ravel() if bits == 4 else raw if bits == 8 else raw[: len(raw) // 2 * 2].view(">u2"))[:n].astype(np.int64)
    n = len(track.sizes)
    if b"co64" in tables:
        pairs = _counted(data, tables, b"co64", 2)
        chunks = pairs[:, 0] << 32 | pairs[:, 1]
    elif b"stco" in tables:
        chunks = _counted(data, tables, b"stco")[:, 0]
    else:
        chunks = np.empty(0, np.int64)
    if b"stsc" in tables and len(chunks) and n:
        runs = _counted(data, tables, b"stsc", 3)
        heads = np.append(runs[:, 0], len(chunks) + 1)
        if (np.diff(heads) < 0).any():
            raise ValueError("chunk runs go backwards")
        per = _repeat(runs[:, 1], np.diff(heads), len(chunks))
        chunk = _repeat(np.arange(len(per)), per, n)
        before = np.cumsum(track.sizes[: len(chunk)]) - track.sizes[: len(chunk)]
        head = np.minimum(np.searchsorted(chunk, np.arange(len(per))), max(0, len(chunk) - 1))
        track.sizes = track.sizes[: len(chunk)]
        track.offsets = chunks[chunk] + before - before[head][chunk] if len(chunk) else np.empty(0, np.int64)
        n = len(chunk)
    else:
        track.sizes, n = track.sizes[:0], 0
    if b"stts" in tables and n:
        runs = _counted(data, tables, b"stts", 2)
        track.ticks = _repeat(runs[:, 1], runs[:, 0], n)
    track.sync = np.ones(n, bool)
    if b"stss" in tables and n:
        marks = _counted(data, tables, b"stss")[:, 0]
        track.sync = np.zeros(n, bool)
        track.sync[marks[(marks >= 1) & (marks <= n)] - 1] = True


def _fragment(track: Track, data, moof: int, tfhd: tuple[int, int], runs: list[tuple[int, int]]) -> None:
    """Append the samples of a movie fragment's track runs."""
    at, _ = tfhd
    flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
    at += 8
    base, ticks, size, sample_flags = moof, 0, 0, 0
    if flags & 1:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 if flags & 2 else 0
    if flags & 8:
        (ticks,) = struct.unpack_from(">I", data, at)
        at += 4
    if flags & 16:
        (size,) = struct.unpack_from(">I", data, at)
        at += 4
    if flags & 32:
        (sample_flags,) = struct.unpack_from(">I", data, at)
    place = base
    for at, end in runs:
        flags, n = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        at += 8
        if flags & 1:
            place = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & 4:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        cols = [bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800)]
        if not any(cols) and n * max(1, size) > len(data):
            raise ValueError("samples of one size reach beyond the file")
        rows = _u32(data, at, n * sum(cols), end).reshape(n, -1)
        own = dict(zip([i for i, c in enumerate(cols) if c], rows.T, strict=True))
        sizes = own.get(1, np.full(n, size, np.int64))
        marks = own.get(2, np.full(n, sample_flags, np.int64)).copy()
        if first is not None and n:
            marks[0] = first
        offsets = place + np.cumsum(sizes) - sizes
        place = int(offsets[-1] + sizes[-1]) if n else place
        track.sizes, track.offsets = np.append(track.sizes, sizes), np.append(track.offsets, offsets)
        track.ticks, track.sync = np.append(track.ticks, own.get(0, np.full(n, ticks, np.int64))), np.append(track.sync, marks & 0x10000 == 0)


def describe(data: bytes) -> list[Track]:
    """The tracks of a file, from its headers alone."""
    tracks: dict[int, Track] = {}
    track, tables, number, moof, tfhd = Track(), {}, 0, 0, None
    pending: list[tuple[Track, dict[bytes, tuple[int, int]]]] = []
    fragments: list[tuple[int, int, tuple[int, int], list[tuple[int, int]]]] = []
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            track, tables = Track(), {}
            pending.append((track, tables))
        elif kind == b"tkhd" and end - at >= 24:
            (number,) = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
            tracks[number] = track
        elif kind == b"mdhd" and end - at >= 24:
            track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr" and path[-2:-1] == (b"mdia",) and end - at >= 12:
            track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif path[-2:-1] == (b"stbl",):
            tables[kind] = (at, end)
        elif kind == b"moof":
            moof = at - 8
        elif kind == b"tfhd":
            tfhd = (at, end)
            fragments.append((struct.unpack_from(">I", data, at + 4)[0], moof, tfhd, []))
        elif kind == b"trun" and fragments:
            fragments[-1][3].append((at, end))
    for t, found in pending:
        _expand(t, found, data)
    for n, where, header, runs in fragments:
        _fragment(tracks.setdefault(n, Track()), data, where, header, runs)
    return list(tracks.values())


def read_samples(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, in decoding order."""
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in track.ranges().tolist())


def _row(text: str | None, with_media: bool) -> tuple:
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % BLOCK or (BLOCK if not raw else 0))
    media = pack_samples(payload)
    (track,) = describe(media)
    back = read_samples(media, track)
    keys = track.keyframes()
    feature = f"{track.codec.strip()}/{track.handler} timescale={track.timescale} duration={track.duration} samples={len(track.sizes)} chunks={-(-len(track.sizes) // SAMPLES_PER_CHUNK)} keyframes={len(keys)} ranges={hashlib.sha256(keys.astype('<i8').tobytes()).hexdigest()[:16]}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, media if with_media else None, track.codec.strip(), track.duration / track.timescale, [{"offset": o, "size": s} for o, s in keys.tolist()] if with_media else None


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_ARROW = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "codec": pa.string(), "seconds": pa.float64(), "keyframes": _RANGES}
_DDL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, codec string, seconds double, keyframes array<struct<offset:long,size:long>>"


def _row_slices(texts: list[str | None], most: int = 8 << 20, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `rows` rows and about `most` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 - lo >= rows:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def store_texts(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each text stored as a media file, read back and described.

    docs needs doc_id and text; other columns are ignored. Text is UTF-8 padded
    with zero bytes to a positive multiple of 64 (null: empty, so 64 zeros).
    Returns a row for each input row: doc_id; n_bytes, payload and media sizes
    and digests; feature; codec, seconds, and with with_media the file and its
    keyframe byte ranges (else null). Equal texts give equal values, repeated rows
    a row each. The files of a slice of about 8 million characters are in memory
    together, and only with with_media.
    """
    prepare(docs.sparkSession)
    names = list(_ARROW)
    skip = () if with_media else ("media", "keyframes")

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _row_slices(texts):
                part = batch.slice(lo, hi - lo)
                cols = list(zip(*(_row(t, with_media) for t in texts[lo:hi]), strict=True))
                arrays = [pa.array([None] * part.num_rows if n in skip else c, _ARROW[n]) for n, c in zip(names, cols, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id long, {_DDL}")


def describe_media(files: DataFrame, media: str = "media") -> DataFrame:
    """codec, handler, seconds, sample count and keyframe byte ranges of the first track of each file.

    Adds columns weft_codec, weft_handler, weft_seconds, weft_samples and
    weft_keyframes to files. Null, truncated or foreign bytes, and files whose
    tables are longer than their boxes or point outside, give nulls and no
    keyframes; boxes may nest to any depth, and no count in a file makes a task
    hold more than a few numbers for each of its bytes.
    """
    prepare(files.sparkSession)

    @F.pandas_udf("codec string, handler string, seconds double, samples long, keyframes array<struct<offset:long,size:long>>")
    def look(data):
        import pandas as pd

        rows = []
        for raw in data:
            try:
                t = describe(bytes(raw))[0]
                rows.append((t.codec, t.handler, t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"offset": o, "size": s} for o, s in t.keyframes().tolist()]))
            except (TypeError, IndexError, ValueError, OverflowError, struct.error):
                rows.append((None, None, None, None, []))
        return pd.DataFrame(rows, columns=["codec", "handler", "seconds", "samples", "keyframes"])

    return files.withColumn("weft_media", look(F.col(media))).select(*files.columns, *(F.col(f"weft_media.{c}").alias(f"weft_{c}") for c in ("codec", "handler", "seconds", "samples", "keyframes")))
