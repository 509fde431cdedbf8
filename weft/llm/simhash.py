"""SimHash near-duplicates over vantage-point trees.

1. Each text gets a 64-bit fingerprint of its word shingles.
2. Distinct fingerprints are dealt to shards by vantage-point trees grown on the
   driver from a sample in proportion to the shards: a node splits by Hamming
   distance to its vantage point at a radius. By the triangle inequality two
   fingerprints within k bits differ by at most k in that distance, so one that
   lies inside within k of the radius also visits the outer shard.
   One tree does for a few shards. The share of points in such boundaries grows
   with the depth, so for many shards there are k + 1 trees, each with the
   Hamming distance over its own part of the bits: k differing bits leave one
   part untouched, there both points have equal distances to every vantage point
   and no boundary parts them. A point then goes to k + 1 shards, however many
   there are. Any sample gives exact results; it only balances the shards, and a
   shard that is too large all the same is searched in pairs of salted blocks.
3. A shard goes on splitting by the distance over all bits down to small leaves,
   boundaries included, compares what is left and keeps a spanning forest of the
   links it finds.
4. Components of the links are found by star rounds on DataFrames.

Fingerprints are unique before the search, so a group of copies is one point
however large, and no task or driver holds all links or fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import tidy
from .common import materialize, prepare, row_keys
from .components import components

U64 = np.uint64
SEED = 42
#: Points of the sample: so many at least, and so many for each shard.
SAMPLE = 65536
SAMPLE_SHARD = 32
SHARD = 1 << 16
#: Up to so many shards one tree with boundary visits deals out fewer copies than several trees.
FEW = 16
LEAF = 192
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the shingles of `width` words, A-Z lower-cased: a bit is set if it is in over half of the XXH64 hashes. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], U64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 8192):
        count += np.unpackbits(hashed[i : i + 8192].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, row_key and row_check (two hashes of doc_id and text) and fingerprint (the 64 bits as a signed long) of each row."""
    prepare(docs.sparkSession)

    def work(batches):
        for batch in batches:
            bits = np.array([fingerprint(t, width) for lo in range(0, batch.num_rows, 256) for t in batch.column(1).slice(lo, 256).to_pylist()], U64)
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(bits.view(np.int64))], names=["doc_id", "row_key", "row_check", "fingerprint"])

    key, check = row_keys(F.col("doc_id"), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("row_key"), check.alias("row_check")).mapInArrow(work, "doc_id long, row_key long, row_check long, fingerprint long")


def _distance(points: np.ndarray, centre: np.uint64, mask: np.uint64 = ALL) -> np.ndarray:
    return np.bitwise_count((points ^ centre) & mask).astype(np.int16)


def _vantage(points: np.ndarray, mask: np.uint64 = ALL, reach: int = 2) -> tuple[np.uint64, int, float] | None:
    """A vantage point and radius that split the points, of a few candidates the one with an even split and a thin boundary; and the share inside."""
    best = None
    for c in points[:: max(1, len(points) // 8)][:8]:
        d = np.sort(_distance(points, c, mask))
        for r in {int(d[len(d) * q // 10]) for q in (4, 5, 6)}:
            if r >= d[-1]:
                continue
            inside = int(np.searchsorted(d, r + 1))
            near = inside - int(np.searchsorted(d, r - reach + 1))
            price = near + abs(inside - len(d) / 2)
            if best is None or price < best[0]:
                best = (price, c, r, inside / len(d))
    return None if best is None else best[1:]


def masks(trees: int) -> list[np.uint64]:
    """The bits that each of the trees looks at: every one in one tree."""
    return [U64(sum(1 << b for b in range(64) if b % trees == t)) for t in range(trees)]


def grow(sample: np.ndarray, shards: int, mask: np.uint64 = ALL, reach: int = 2) -> list:
    """A tree with up to `shards` leaves as [vantage, radius, inner, outer] nodes and leaf numbers."""
    leaves = itertools.count()

    def split(points: np.ndarray, parts: int, depth: int = 0):
        found = _vantage(points, mask, reach) if parts > 1 and len(points) > 1 and depth < 200 else None
        if found is None:
            return next(leaves)
        inner = _distance(points, found[0], mask) <= found[1]
        own = max(1, min(parts - 1, round(parts * found[2])))
        return [int(found[0]), found[1], split(points[inner], own, depth + 1), split(points[~inner], parts - own, depth + 1)]

    return split(sample, shards)


def route(tree, points: np.ndarray, reach: int, mask: np.uint64 = ALL) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf, home, indices): the leaf each point lives in, and those it has to visit to meet all points whose masked distance is `reach` or less."""
    todo = [(tree, True, np.arange(len(points)))]
    while todo:
        node, home, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, home, at
            continue
        d = _distance(points[at], U64(node[0]), mask)
        r = node[1]
        if home:
            todo += [(node[2], True, at[d <= r]), (node[3], True, at[d > r]), (node[3], False, at[(d <= r) & (d > r - reach)])]
        else:
            todo += [(node[2], False, at[d <= r + reach]), (node[3], False, at[d > r - reach])]


def links(home: np.ndarray, visit: np.ndarray, bits: int) -> np.ndarray:
    """Links (pairs of fingerprints at `bits` or fewer differing bits) among home points and between visitors and home points, thinned to a spanning forest."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def meet(xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))

    todo = [(home, visit)]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        found = _vantage(own) if len(own) > LEAF else None
        if found is None:
            every = np.concatenate((own, guests))
            for lo in range(0, len(own), 512):
                part = own[lo : lo + 512]
                i, j = np.nonzero(np.bitwise_count(part[:, None] ^ every[None, lo:]) <= bits)
                later = j > i
                meet(part[i[later]], every[lo:][j[later]])
            continue
        d, g = _distance(own, found[0]), _distance(guests, found[0])
        r = found[1]
        edge = own[(d <= r) & (d > r - bits)]
        todo += [(own[d <= r], guests[g <= r + bits]), (own[d > r], np.concatenate((guests[g > r - bits], edge)))]
    return np.array(out, U64).reshape(-1, 2)


def link_forest(points: DataFrame, bits: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fingerprint), enough of them to connect all that are connected; shard is the number of points that a task is meant to get."""
    total = points.count()
    shards = max(1, -(-total // shard))
    trees = 1 if shards <= FEW else bits + 1
    reach = bits // trees
    place = F.shiftrightunsigned(F.xxhash64(F.col("fingerprint"), F.lit(1)), 1)
    cut = min(2**63 - 1, 2**63 * max(SAMPLE, SAMPLE_SHARD * shards) // max(1, total))
    sample = points.where(place <= cut).select("fingerprint").toArrow()["fingerprint"].to_numpy().astype(np.int64).view(U64)  # about that many points, by hash
    grown = [(grow(np.sort(sample), shards, m, reach), m) for m in masks(trees)]

    def dealt(p: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        for t, (tree, m) in enumerate(grown):
            for leaf, home, at in route(tree, p, reach, m):
                yield t * shards + leaf, home, at

    def sizes(batches):
        for batch in batches:
            each = [(s, len(at)) for s, _, at in dealt(batch.column(0).to_numpy().view(U64))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in each], pa.int32()), pa.array([n for _, n in each], pa.int64())], names=["shard", "n"])

    # a shard that the sample did not tell is split into blocks, and every two of them meet
    large = points.select("fingerprint").mapInArrow(sizes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > 6 * shard).collect() if shards > 1 else []
    blocks = {r["shard"]: -(-r["n"] // (2 * shard)) for r in large}  # fewer than one for each 6 * shard points

    def deal(batches):
        for batch in batches:
            p = batch.column(0).to_numpy().view(U64)
            for s, home, at in dealt(p):
                n = blocks.get(s, 1)
                own = (p[at] * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(n)
                for block in range(n):
                    rows = at[own == block] if n > 1 else at
                    for other in range(n) if n > 1 else (0,):
                        if len(rows) and (n == 1 or other != block):
                            part = min(block, other) * n + max(block, other)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), pa.array(np.full(len(rows), part, np.int32)), pa.array(np.full(len(rows), home or n > 1)), pa.array(p[rows].view(np.int64))], names=["shard", "part", "home", "point"])

    def search(table: pa.Table) -> pa.Table:
        p = table["point"].to_numpy().view(U64)
        home = table["home"].to_numpy()
        pairs = links(np.unique(p[home]), np.unique(p[~home]), bits).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return points.select("fingerprint").mapInArrow(deal, "shard int, part int, home boolean, point long").groupBy("shard", "part").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, with_key: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    Texts whose fingerprints differ in `bits` or fewer bits are linked;
    component_id is the smallest doc_id that can be reached over links, itself
    included. docs needs doc_id and text; other columns are ignored. Null and
    wordless texts have fingerprint 0 and link like any other; a null doc_id
    takes part but never names a component (null if no other does). with_key
    adds row_key and row_check (two hashes of doc_id and text) and root, which every component has.
    Repeated rows get a row each; of equal smallest doc_ids there is only one
    value to give. Texts of any length are read whole.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    # copies are one point from here on
    points = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    roots = components(link_forest(points, bits))
    joined = points.join(roots, points["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(named, "root").select("fingerprint", "component_id", "root")
    return marked.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", *(["row_key", "row_check", "root"] if with_key else []))
