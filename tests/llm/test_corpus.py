"""The corpus operators against brute force on small tables, and on the awkward cases of each."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")
SF = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use inside.
EXTRA = "grp int, row_key string, bucket string, n_words string, score string, shard int"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def frame(spark, rows):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame([(d, t, "en", "s", 0, 1, "x", "y", "z", "w", 2) for d, t in rows], schema)


def words_of(n, seed=0, size=400):
    r = random.Random(seed)
    return [f"w{r.randint(0, size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty, white space only, very long, ties and repeated rows."""
    long = " ".join(words_of(6000, 1, 10**6))
    passage = " ".join(words_of(70, 2))
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (5, long), (6, f"start {passage} end"), (7, f"other {passage} tail é"), (None, passage), (8, "a " * 300), (9, "é" * 400), (10, "x"), (11, passage[1:]), (12, f"{passage} {passage}")]


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- 1 media


def test_media_round_trip(spark, awkward):
    from weft.llm.iso_media import describe, read_samples, store_texts

    rows = store_texts(frame(spark, awkward)).collect()
    assert len(rows) == len(awkward)
    want = sorted((hashlib.sha256(p).hexdigest(), len(p), len((t or "").encode())) for _, t in awkward for p in [(t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))])
    assert sorted((r.payload_sha256, r.payload_bytes, r.n_bytes) for r in rows) == want
    for r in rows:
        (track,) = describe(bytes(r.media))
        assert hashlib.sha256(read_samples(r.media, track)).hexdigest() == r.payload_sha256
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert r.tail_crc32 == zlib.crc32(read_samples(r.media, track)[-64:])
        assert all(k.size == 64 for k in r.keyframes) and len(r.keyframes) == -(-r.payload_bytes // 1024)


def test_media_boxes_of_other_writers(spark):
    import struct

    from weft.llm import iso_media as M

    init = M.box(b"ftyp", b"isom", bytes(4)) + M.box(b"moov", M.box(b"trak", M.full(b"tkhd", 0, 0, bytes(8), struct.pack(">I", 7), bytes(64)), M.box(b"mdia", M.full(b"mdhd", 0, 0, bytes(8), struct.pack(">II", 1000, 0), bytes(4)), M.full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12)))))
    trun = M.full(b"trun", 0, 0x1 | 0x4 | 0x200, struct.pack(">Ii", 3, 200), struct.pack(">I", 0), struct.pack(">III", 5, 6, 7))
    moof = M.box(b"moof", M.box(b"traf", M.full(b"tfhd", 0, 0x20, struct.pack(">II", 7, 0x10000)), trun))
    data = init + moof + struct.pack(">I4s", 0, b"mdat") + bytes(300)
    (track,) = M.describe(data)
    assert track.sizes.tolist() == [5, 6, 7] and track.sync.tolist() == [True, False, False]
    assert track.keyframes().tolist() == [[len(init) + 200, 5]] and track.handler == "vide"
    got = M.describe_media(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"\x00\x00\x00\x10moovjunk"))], "k int, media binary")).orderBy("k").collect()
    assert got[0].weft_samples == 3 and got[1].weft_codec is None and got[2].weft_codec is None


def test_media_hostile_files(spark):
    """Counts beyond the file, tables beyond their box, nesting without end: null, and no memory or recursion to speak of."""
    import struct

    from weft.llm import iso_media as M

    def track(stsz, stsc=(1, 2**32 - 1, 1), stts=(2**32 - 1, 1)):
        stbl = M.box(b"stbl", M.full(b"stsz", 0, 0, *stsz), M.full(b"stco", 0, 0, struct.pack(">II", 1, 8)), M.full(b"stsc", 0, 0, struct.pack(">IIII", 1, *stsc)), M.full(b"stts", 0, 0, struct.pack(">III", 1, *stts)))
        return M.box(b"moov", M.box(b"trak", M.full(b"tkhd", 0, 0, bytes(8), struct.pack(">I", 1), bytes(64)), M.box(b"mdia", M.box(b"minf", stbl))))

    nested = b""
    for _ in range(5000):
        nested = M.box(b"moov", nested)
    one = struct.pack(">II", 1, 2**32 - 1)
    files = [track([one]), track([struct.pack(">II", 0, 2**32 - 1)]), nested, track([struct.pack(">II", 0, 3), struct.pack(">III", 4, 5, 6)]), track([struct.pack(">II", 0, 3), struct.pack(">III", 4, 5, 6)], stsc=(1, 0, 1))]
    got = M.describe_media(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "k int, media binary")).orderBy("k").collect()
    assert [r.weft_samples for r in got] == [None, None, None, 3, 0]


def test_media_empty_table(empty):
    from weft.llm.iso_media import store_texts

    assert store_texts(empty).count() == 0


# --- 2 language


def test_codewords_differ():
    from weft.llm.langid import codewords

    for k in (1, 2, 3, 4, 5, 9, 40):
        code = codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
    assert min((a != b).sum() for i, a in enumerate(codewords(40)) for b in codewords(40)[:i]) >= 10


@needs_tables
def test_language_held_out_accuracy(spark):
    from weft.llm.common import held_out
    from weft.llm.langid import identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    rows = identify(docs, docs.where(~out)).join(docs.where(out).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark, awkward, empty):
    from weft.llm.langid import UNKNOWN, identify, slot_counts

    docs = frame(spark, awkward)
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    rows = identify(docs, train).collect()
    assert len(rows) == len(awkward) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {UNKNOWN}
    assert {r.lang_pred for r in identify(docs, train.limit(0)).collect()} == {UNKNOWN}
    assert identify(empty, train).count() == 0
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5)}) == 1
    from weft.llm import langid

    whole, langid.BLOCK = slot_counts("abc déf " * 500), 97
    try:
        assert (slot_counts("abc déf " * 500) == whole).all()
    finally:
        langid.BLOCK = 1 << 15


def test_every_language_is_learned(spark):
    """More languages than any fixed number, each with letters of its own."""
    from weft.llm.langid import identify, learn

    words = {f"l{k:03}": [chr(0x4E00 + 20 * k + j) + chr(0x4E00 + 20 * k + (3 * j + 1) % 20) for j in range(20)] for k in range(600)}
    r = random.Random(1)
    train = spark.createDataFrame([(" ".join(r.choices(w, k=30)), k) for k, w in words.items() for _ in range(3)], "text string, lang string")
    assert learn(train).labels == sorted(words)
    docs = frame(spark, [(i, " ".join(r.choices(w, k=30))) for i, w in enumerate(words.values())])
    got = {x.doc_id: x.lang_pred for x in identify(docs, train).collect()}
    assert np.mean([got[i] == k for i, k in enumerate(words)]) > 0.97


def test_language_marks_belong_to_words():
    from weft.llm.langid import clean

    assert clean("हिन्दी, भाषा!") == " हिन्दी भाषा " and clean("12 \u0301 !") == "" and clean("A1b") == " a b "


def test_language_decoding_by_hand():
    """Margins by a plain dictionary of n-grams, codewords by a plain sum of weighted losses."""
    from weft.llm import langid as L

    r = np.random.default_rng(5)
    labels = ["a", "b", "c", "d", "e", "f", "g"]
    code = L.codewords(7)
    bits = code.shape[1]
    model = L.Model(labels, code, r.normal(size=(1 << L.BITS, bits)).astype(np.float32), r.normal(size=bits), r.random(bits) + 0.1, 100.0)

    def slot(gram):
        h = 0
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
            h ^= h >> 15
        return h * 0x85EBCA6B % 2**32 >> 32 - L.BITS

    for text in ("Plain words, and more", "é", "a" * 70000, "ñandú " * 9000):
        t = L.clean(text)
        grams = collections.Counter(t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1))
        total = sum(n * model.weights[slot(g)].astype(float) for g, n in grams.items())
        margins = total / sum(grams.values()) * 100 + model.bias
        assert np.allclose(model.margins(t), margins, rtol=1e-6, atol=1e-6)
        loss = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(model.trust, row, margins, strict=True)) for row in code.tolist()]
        label, score, _ = model.decode(model.margins(t))
        assert label == labels[loss.index(min(loss))] and score == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), rel=1e-4)


def test_language_learned_beside_one_hot_text(spark):
    from weft.llm.langid import identify, learn

    def some(words, n, seed):
        r = random.Random(seed)
        return [" ".join(r.choice(words.split()) for _ in range(12)) for _ in range(n)]

    en, fr = "the cat and dog with house window water green morning", "le chat et chien avec maison fenêtre verte matin eau"
    texts = spark.createDataFrame([(t, "en") for t in some(en, 60, 1)] + [(t, "fr") for t in some(fr, 60, 2)], "text string, lang string")
    for hot in ("chat", "zéro", "quatorze"):  # one of them is likely to fall above a threshold that counts rows, whatever the hash
        train = texts.unionByName(spark.range(200000).select(F.lit(hot).alias("text"), F.lit("fr").alias("lang")))
        assert learn(train, 10).labels == ["en", "fr"]
        docs = frame(spark, list(enumerate(some(en, 30, 3) + some(fr, 30, 4))))
        assert [r.lang_pred for r in sorted(identify(docs, train, 10).collect(), key=lambda r: r.doc_id)] == ["en"] * 30 + ["fr"] * 30


# --- 3 substring


def brute_words(rows, size=50):
    first, out = {}, collections.Counter()
    split = [(math.inf if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted(split, key=lambda x: x[0]):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    for (d0, _), (d, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(d0, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_cover_meets_every_shift():
    from weft.llm.substring_dedup import COVERS, Cover

    for p, d in COVERS.items():
        assert {(a - b) % p for a in d for b in d} == set(range(p))
    c = Cover(50)
    assert c.width + c.period - 1 == 50 and Cover(5).width >= 1


def test_substring_awkward(spark, awkward, empty):
    from weft.llm.substring_dedup import dedup_substrings

    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(frame(spark, awkward)).collect())
    assert got == brute_words(awkward)
    assert dedup_substrings(empty).count() == 0


@needs_tables
def test_substring_tables(spark):
    from weft.llm.substring_dedup import dedup_substrings

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(docs).collect())
    assert got == brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_unequal_words_stay_apart(spark):
    """Two words that collide under every polynomial hash modulo 2**64."""
    from weft.llm.substring_dedup import dedup_substrings

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(words_of(49, 5))
    rows = [(1, f"{rest} {word}"), (2, f"{rest} {other}"), (3, f"{rest} {word}")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(frame(spark, rows)).collect())
    assert got == brute_words(rows) and {r[2] for r in got} == {0, 50}


# --- 4 decontamination


def test_decontamination_brute(spark, awkward, empty):
    import re

    from weft.llm.decontaminate import find_contamination, remove_documents, remove_spans

    bench = [(1, " ".join(words_of(70, 2)[5:30])), (2, "x"), (3, None), (4, "--"), (None, "a"), (5, "É é"), (6, " ".join(words_of(70, 2)[5:30]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {}
    for i, t in bench:
        w = norm(t)
        if i is not None and w:
            items.setdefault(str(i), set()).update(tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12)))
    want = collections.Counter()
    for d, t in awkward:
        w, hit, found = norm(t), set(), set()
        for i, grams in items.items():
            for g in grams:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit.update(range(k, k + len(g)))
                        found.add(i)
        want[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    docs = frame(spark, awkward)
    for block in (64 << 20, 500):
        got = find_contamination(docs, b, block_bytes=block)
        rows = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
        assert rows == want
    bad = sum(n for k, n in want.items() if k[-1])
    kept = remove_documents(docs, b)
    assert kept.count() == len(awkward) - bad and kept.columns == docs.columns
    assert find_contamination(docs, b.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(empty, b).count() == 0
    cleaned = remove_spans(docs, b)
    assert cleaned.columns == docs.columns and cleaned.count() == len(awkward)


def test_decontamination_runs_no_python(spark):
    from weft.llm.decontaminate import find_contamination

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = find_contamination(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# --- 5 SimHash


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_spark_hash(spark):
    from weft.llm.simhash import fingerprint

    text = "Über ONE two"
    spark_hash = spark.createDataFrame([("Über one two",)], "t string").select(F.xxhash64("t")).first()[0] & (2**64 - 1)
    assert fingerprint(text) == spark_hash
    for t in (None, "", "a", "a b", "a b c d e", " ".join(words_of(200))):
        assert fingerprint(t) == brute_fingerprint(t)


def _classes(points, bits=2):
    points = np.unique(points)
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points ^ p) <= bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(p): int(points[find(i)]) for i, p in enumerate(points)}


@pytest.mark.parametrize("shard", [150, 700, 10])
def test_vantage_point_shards_lose_no_link(spark, monkeypatch, shard):
    """Several trees, one tree with boundaries, and shards that the sample does not tell apart."""
    from weft.llm import simhash

    rng = np.random.default_rng(3)
    points = [rng.integers(0, 2**63, 1500, dtype=np.uint64)]
    for c in points[0][:200]:
        for _ in range(6):  # chains of two-bit steps
            for b in rng.choice(64, 2, replace=False):
                c = c ^ np.uint64(1 << int(b))
            points.append(np.array([c]))
    points = np.unique(np.concatenate(points))
    monkeypatch.setattr(simhash, "LEAF", 16)
    if shard == 10:
        monkeypatch.setattr(simhash, "SAMPLE", 3)
        monkeypatch.setattr(simhash, "SAMPLE_SHARD", 0)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fingerprint long")
    edges = np.array([[r.a, r.b] for r in simhash.link_forest(df, shard=shard).collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 2).all()
    want = _classes(points)
    roots = {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in simhash.components(simhash.link_forest(df, shard=shard)).collect()}
    groups = collections.defaultdict(set)
    for k, v in roots.items():
        groups[v].add(k)
    expected = collections.defaultdict(set)
    for k, v in want.items():
        expected[v].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values() if len(g) > 1}


def test_visits_do_not_grow_with_the_shards():
    """2**20 random points: three copies of each whatever the number of shards, and no linked pair without a common shard."""
    from weft.llm import simhash as S

    r = np.random.default_rng(1)
    points = np.unique(r.integers(0, 2**64, 1 << 20, dtype=np.uint64))
    pairs = points[:2000]
    near = pairs ^ (np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64))
    for shards in (64, 512, 4096):
        met, most = np.zeros(2000, bool), 0
        for m in S.masks(3):
            tree = S.grow(points[:: max(1, len(points) // (32 * shards))], shards, m, 0)
            of = [np.full(len(p), -1) for p in (points, pairs, near)]
            for p, out in zip((points, pairs, near), of, strict=True):
                for leaf, home, at in S.route(tree, p, 0, m):
                    if home:
                        assert (out[at] < 0).all()
                        out[at] = leaf
                    else:
                        assert not len(at)
            met |= of[1] == of[2]
            most = max(most, np.bincount(of[0]).max())
        assert met.all() and most < 4 * len(points) / shards


def test_components(spark):
    from weft.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


def test_simhash_awkward(spark, awkward, empty):
    from weft.llm.simhash import near_duplicates

    rows = near_duplicates(frame(spark, awkward)).collect()
    prints = [brute_fingerprint(t) for _, t in awkward]
    root = _classes(np.array(prints, np.uint64))
    least = {}
    for (d, _), p in zip(awkward, prints, strict=True):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = collections.Counter((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(awkward, prints, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    assert near_duplicates(empty).count() == 0


# --- 6 language model


def test_language_model(spark, awkward, empty):
    from weft.llm.common import held_out
    from weft.llm.maxent_lm import score_corpus

    rows = awkward + [(100 + i, "The cat sat on the mat . the dog ran") for i in range(40)]
    docs = frame(spark, rows)
    got = score_corpus(docs, held_out(F.col("doc_id"), 7, 2)).collect()
    assert len(got) == len(rows)
    is_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter()
    for d, t in rows:
        if not is_out(d):
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[(d, is_out(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert score_corpus(empty, F.lit(False)).count() == 0
    none = score_corpus(frame(spark, awkward[:4]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_language_model_learns_from_every_position(spark):
    from weft.llm.maxent_lm import score_corpus

    r = random.Random(3)
    few = ["red", "blue", "green", "black", "white", "brown", "pink", "grey"]
    docs = frame(spark, [(i, " ".join(r.choice(few) for _ in range(3))) for i in range(30000)]).coalesce(1)
    got = score_corpus(docs, F.col("doc_id") >= 27000).where("held_out").agg(F.avg("score")).first()[0]
    # three words out of eight and then the end, which is the fourth token of every text
    assert got > 3 * math.log10(1 / 8) - 0.3


def test_language_model_does_not_depend_on_partitions(spark):
    from weft.llm.maxent_lm import score_corpus

    rows = [(i, " ".join(words_of(40 + i % 9, i, 60))) for i in range(300)]
    one, many = (sorted((r.doc_id, r.score) for r in score_corpus(frame(spark, rows).repartition(n), F.col("doc_id") % 5 == 0).collect()) for n in (1, 7))
    assert one == many


def test_probabilities_of_all_words_sum_to_one():
    from weft.llm.maxent_lm import BRANCH, DEEPEST, END, END_CLASS, TEMPLATES, Model, Words

    rng = np.random.default_rng(0)
    words = [b"%d" % i for i in range(300)] + [END]
    path = Words(pa.array(words, pa.binary())).path
    paths, inverse = np.unique(path, return_inverse=True)
    counts = rng.integers(1, 50, len(words))
    m = Model(paths, np.bincount(inverse, weights=counts), np.bincount(inverse))
    m.table[:] = rng.normal(size=m.table.shape)
    shift = 4 * (DEEPEST - m.levels)
    last = path >> shift
    # one unknown word for each last class, and those of classes without a known word
    unknown = np.array([p for p in range(END_CLASS * BRANCH ** (m.levels - 1))], np.int64) << shift
    every, own = np.concatenate((path, unknown)), np.concatenate((counts, np.zeros(len(unknown))))
    contexts = np.repeat(rng.integers(0, 2**63, (TEMPLATES, 1)).astype(np.uint64), len(every), axis=1)
    assert np.exp(m.log_prob(contexts, every, own)).sum() == pytest.approx(1, abs=1e-4)
    assert len(set(last.tolist())) > 50


def test_unseen_words_stay_unknown(spark):
    """A held-out word that collides with a trained one under every polynomial hash modulo 2**64."""
    from weft.llm.maxent_lm import score_corpus

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word + " same"), (2, word.translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r for r in score_corpus(frame(spark, rows), F.col("doc_id") == 2).collect()}
    assert got[2].n_known == 1 and got[2].n_tokens == 2


@needs_tables
def test_language_model_beats_its_base(spark):
    from weft.llm.common import held_out
    from weft.llm.maxent_lm import score_corpus

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_corpus(docs, held_out(F.col("doc_id"), 7, 2)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 0.2  # log10 a token


# --- 7 HTML


def test_html_templates():
    from weft.llm import html_extract as H

    model = H.train()
    r = random.Random(1234)
    right = 0
    for _ in range(80):
        source = H.sample_page(r)
        page = H.Page(source, keep=True)
        right += next(H.extract([source], model)) == page.text(np.array([v == 1 for v in page.labels()]))
    assert right >= 74


def test_html_decoding_is_consistent():
    from weft.llm import html_extract as H

    r = np.random.default_rng(0)
    for _ in range(200):
        n = r.integers(2, 30)
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        state = H.decode(parent, r.normal(0, 3, n - 1))
        for i in range(1, n):
            assert (int(state[parent[i]]), int(state[i])) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)}


def test_html_awkward(spark):
    from weft.llm.html_extract import extract_pages

    body = "<p>One  two&nbsp;three &amp; &lt;four&gt;<br>five</p><p>Second <b>bold</b> text.</p><script>no()</script>"
    pages = [(1, None), (2, ""), (3, "just text"), (4, f"<html><body><nav><ul><li><a href=x>Home</a></li><li><a>About</a></li></ul></nav><article><h1>Title</h1>{body}</article><footer>&copy; me</footer></body></html>"), (5, "<article><p>unclosed <p>two"), (6, "<div" * 2000), (7, "<article>" + "<p>word</p>" * 3000 + "</article>"), (4, "<p"), (None, "<article><h1>T</h1><p>x y z</p></article>")]
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in pages], "page_id long, url string, html string, text int")
    got = extract_pages(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars > 0): r.text for r in got}
    assert by[(4, True)] == "Title\n\nOne two three & <four> five\n\nSecond bold text."
    assert (1, False) in by and (2, False) in by
    assert extract_pages(df.limit(0)).count() == 0


def test_html_hostile_pages():
    """Attributes that look like training labels, and elements that are never closed."""
    import time

    from weft.llm import html_extract as H

    model = H.train()
    prose = "".join(f"<p>Sentence number {i} of a text that goes on, as texts do.</p>" for i in range(6))
    for mark in ('y="50%"', "y=1", "y=0", 'y="x"'):
        (got,) = H.extract([f"<body><article {mark}>{prose}</article></body>"], model)
        assert got.count("Sentence") == 6
    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        H.Page("<article>" + "<b>x</p><i>" * n + "<div><span class=ad>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]  # eight times the length; quadratic would be sixty-four


def test_html_stray_quotes_keep_the_rest_of_the_page():
    from weft.llm.html_extract import Page

    text = lambda s: "".join(t for _, t, _ in Page(s).events if t).strip()
    assert text("<p title=it's>Hello</p><p>more</p>") == "Hellomore"
    assert text('<a href="x"">Link</a><p>text</p>') == "Linktext"
    assert text('<img alt="5" tall" src=x><p>rest</p>') == "rest"
    assert text("<p title=it's>It's</p><p>isn't</p>") == "It'sisn't"
    assert text('<p title="a > b" lang=\'d>e\'>in</p>') == "in"
    assert text('<p title="x>hello</p><p class="y') == "hello"
    assert text("a </3> b <é> c<p") == "a  b <é> c"
    for part in ('<a b=">" ', '<a b="x>', "<a b='", "<a ", "</ "):
        assert len(text(part * 100000)) <= len(part) * 100000


# --- 8 packing


def test_fullest_is_the_best_subset():
    from itertools import combinations

    from weft.llm.packing import fullest

    r = random.Random(2)
    for _ in range(100):
        items = [r.randint(1, 30) for _ in range(8)]
        room = r.randint(1, 80)
        counts = collections.Counter(items)
        got = fullest(dict(counts), sorted(counts, reverse=True), room)
        best = max(s for k in range(9) for c in combinations(items, k) if (s := sum(c)) <= room)
        assert sum(got) == best and not collections.Counter(got) - counts


def test_packing_awkward(spark, awkward, empty):
    tokenizers = pytest.importorskip("tokenizers")
    packing = pytest.importorskip("weft.llm.packing")
    path = packing.default_tokenizer()
    tok = tokenizers.Tokenizer.from_file(path)
    rows = awkward + [(20, "Don't, stop... I'LL 12.5 é. ΟΔΟΣ, “q”,,. 。x z\u0085y\u001cz"), (21, "a <|endoftext|> b"), (22, "a<|startoftext|>b <|ENDOFTEXT|> don't"), (23, "caf\u0065\u0301! ÀÖ× ÷ß. naïve's 'tis it's' x'l 'll")]
    want = collections.Counter()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 256):
            c = ids[p : p + 256]
            want[(d, p // 256, p, len(c), zlib.crc32(np.array(c, "<u4").tobytes()))] += 1
    got = packing.pack_documents(frame(spark, rows), capacity=256, with_ids=True).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        place = 0
        for offset, length in sorted(b):
            assert offset == place
            place += length
        assert place <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(empty).count() == 0


# --- 9 suffixes


def brute_bytes(rows, size=100):
    first, out = {}, collections.Counter()
    raw = [(math.inf if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(raw, key=lambda x: x[0]):
        for i in range(len(b) - size + 1):
            k = b[i : i + size]
            first[k] = min(first.get(k, (d, i)), (d, i))
    for (d0, _), (d, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (d, i):
                gone[i] += 1
                gone[i + size] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out[(d0, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_interval_expansion_finds_all_short_prefixes():
    from weft.llm.suffix_dedup import prefix_boundaries, suffix_order

    r = np.random.default_rng(4)
    for alphabet in (2, 4, 60):
        parts = [r.integers(1, alphabet + 1, r.integers(5, 60)) for _ in range(12)]
        parts += [parts[0], parts[1][3:], parts[2]]
        symbols = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int16)
        order = suffix_order(symbols, 10)
        found = prefix_boundaries(symbols, order, 10)
        text = symbols.tolist()
        for i in range(1, len(text)):
            a, b = text[order[i - 1] : order[i - 1] + 10], text[order[i] : order[i] + 10]
            if 0 not in a and 0 not in b and len(a) == len(b) == 10:
                assert found[i] == (a != b)


def test_suffixes_awkward(spark, awkward, empty):
    from weft.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(frame(spark, awkward)).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == brute_bytes(awkward)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in out)
    assert dedup_suffixes(empty).count() == 0


def test_suffixes_of_a_split_pick(spark):
    """A passage that many documents share between unlike ends, split over many buckets."""
    from weft.llm.suffix_dedup import dedup_suffixes

    r = random.Random(3)
    passage = " ".join(words_of(60, 9))
    rows = [(i, f"{' '.join(words_of(12, 100 + i % 70))}{r.choice(['. ', ' '])}{passage}{r.choice('!?')} {' '.join(words_of(r.choice([5, 20]), 300 + i % 50))}") for i in range(240)]
    rows += [(7, rows[7][1]), (None, rows[3][1])]
    got = [collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in dedup_suffixes(frame(spark, rows), hot=h).collect()) for h in (3, 50)]
    assert got[0] == got[1] == brute_bytes(rows)


@needs_tables
def test_suffixes_tables(spark):
    from weft.llm.suffix_dedup import dedup_suffixes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_suffixes(docs, with_text=False).collect())
    assert got == brute_bytes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


# --- 10 toxicity


def test_grammar_scores_clauses():
    from weft.llm.toxicity import Grammar

    g = Grammar(words={"idiot": 2.0}, beginnings={"lowei": 2.0})
    m = g.automaton()
    kinds = lambda t: [p for p, _ in g.clauses(t, m)]
    assert kinds("You are an idiot.") == ["directed"]
    assert kinds("What an idiot! Fine.") == ["plain"]
    assert kinds("not an idiot") == ["negated"]
    assert kinds("she said idiot") == ["reported"]
    assert kinds("i will kill you") == ["threat"]
    assert kinds("idiotic") == [] and kinds("a loweischaft") == ["plain"]
    score = lambda t: g.weigh(g.clauses(t, m))
    assert score("You idiot") > score("An idiot") > score("not an idiot") > score("hello")
    assert score("") == g.rest


def test_composed_machine_against_a_plain_reading():
    """The table of the composed transducers against the rules written out over the whole clause."""
    from weft.llm import toxicity as T

    weights = {"reported": -0.7, "negated": -0.9, "plain": 0.1, "directed": 0.5, "threat": 1.5}
    machine = T.Machine(weights)
    r = random.Random(8)

    def plain(kinds):
        best = 0
        for i, k in enumerate(kinds):
            near = lambda c: c in kinds[max(0, i - T.SCOPE) : i]
            hold = 1 if near(T.SAY) else 2 if near(T.NOT) else 0
            aimed = T.AIM in kinds[:i]
            if k == T.INSULT:
                best = max(best, hold or (4 if aimed else 3))
            elif k == T.HARM and aimed:
                best = max(best, hold or 5)
            elif k == T.AIM and best == 3:
                best = 4
            elif k == T.AIM and near(T.HARM) and not hold:
                best = max(best, 5)
        return T.PATTERNS[best]

    for _ in range(20000):
        kinds = [r.randrange(6) if r.random() < 0.6 else T.OTHER for _ in range(r.randint(0, 14))]
        pattern, weight = machine.read(kinds)
        assert pattern == plain(kinds) and weight == pytest.approx(weights.get(pattern, 0.0))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf):
    from weft.llm.common import held_out
    from weft.llm.toxicity import score_toxicity

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 4, 2)
    rows = score_toxicity(docs, labels.where(~out)).join(labels.where(out).select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) <= 0.01


def test_grammar_reads_long_clauses_whole():
    from weft.llm.toxicity import Grammar

    g = Grammar(words={"idiot": 2.0})
    m = g.automaton()
    kinds = lambda t: [p for p, _ in g.clauses(t, m)]
    far = "word " * 300
    assert kinds(f"you {far} kill") == ["threat"]
    assert kinds(f"you {far} idiot") == ["directed"]
    assert kinds(f"fine. you {far} idiot. an idiot") == ["directed", "plain"]
    assert kinds(f"idiot {far} idiot {far} you") == ["directed"]
    assert kinds(f"{far} idiot {far}! you {far}") == ["plain"]


def test_toxicity_awkward(spark, awkward, empty):
    from weft.llm.toxicity import score_toxicity

    rows = awkward + [(200 + i, f"{' '.join(words_of(12, i))} nasty{'xyzuvw'[i % 6]}ly {' '.join(words_of(9, 900 + i))}" if i % 3 == 0 else " ".join(words_of(25, 100 + i))) for i in range(150)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(200 + i, int(i % 3 == 0), 1) for i in range(120)] + [(None, 1, 0), (1, None, 0), (200, 1, 0)], "doc_id long, toxic int, text int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.predicted for r in sorted((r for r in got if (r.doc_id or 0) >= 320), key=lambda r: r.doc_id)] == [int(i % 3 == 0) for i in range(120, 150)]
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert score_toxicity(empty, labels).count() == 0


# --- pipeline


@needs_tables
def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as P
    from weft.llm.common import held_out, materialize
    from weft.llm.toxicity import score_toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    toxic = {r.doc_id for r in score_toxicity(docs, labels).collect() if r.predicted}
    kept = {d: t for d, t in texts.items() if d not in toxic}
    prints = {d: brute_fingerprint(t) for d, t in kept.items()}
    root = _classes(np.array(list(prints.values()), np.uint64))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    kept = {d: t for d, t in kept.items() if least[root[prints[d]]] == d}
    state, seen = docs, {}
    for name, stage in P.STAGES[:-1]:
        state = materialize(stage(spark, state, SF), f"test-{name}")
        seen[name] = {r.doc_id: r for r in state.collect()}
        assert state.columns == docs.columns
    assert set(seen["toxicity"]) == set(texts) - toxic
    assert set(seen["simhash_near_dedup"]) == set(kept)
    spans = brute_bytes(sorted(kept.items()))
    gone = {k[0]: k[2] for k in spans}
    for d, r in seen["suffix_array_dedup"].items():
        assert len(kept[d].encode()) - gone[d] <= len(r.text.encode()) <= len(kept[d].encode()) - gone[d] + 6 * 50 and r.n_chars == len(r.text)
    left = seen["benchmark_decontamination"]
    assert set(left) <= set(kept)
    pieces = P.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(left)


def test_pipeline_awkward(spark, awkward, tmp_path):
    import corpus_pipeline as P

    frame(spark, awkward).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prints = [brute_fingerprint(t) for _, t in awkward]
    root = _classes(np.array(sorted(set(prints)), np.uint64))
    first = {}
    for (d, t), p in zip(awkward, prints, strict=True):
        first[root[p]] = min(first.get(root[p], (2, 0)), (d is None, d or 0))
    want = sorted((None if nameless else d) for nameless, d in first.values() if not nameless) + [None for nameless, _ in first.values() if nameless]
    got = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    assert set(got) == set(want) and len(set(got)) == len(want)


def test_pipeline_tells_rows_apart_by_text(spark, tmp_path):
    """Different documents under one doc_id, without a doc_id, and columns named like the pipeline's own."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(words_of(30, 77)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [" ".join(words_of(80, 500 + i, 10**5)) for i in range(6)] + [" ".join(words_of(30, 77))]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (4, texts[4]), (4, texts[4]), (5, texts[5]), (5, texts[6]), (None, texts[6] + " "), (9, None)]
    docs = spark.createDataFrame([(d, t, len(t or ""), "a", "b", "c", "d") for d, t in rows], "doc_id long, text string, n_chars long, weft_key string, weft_check string, rest string, grp string")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "n_chars", "weft_key", "weft_check", "rest", "grp"], name
    got = docs.collect()
    assert sorted(((r.doc_id, r.text, r.weft_key, r.rest, r.grp) for r in got), key=repr) == sorted([(d, t, "a", "c", "d") for d, t in [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (4, texts[4]), (5, texts[5]), (9, None)]], key=repr)
    empty = P.suffix_array_dedup(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == docs.columns and empty.count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as P

    one, two, three = (" ".join(words_of(200, seed, 10**6)) for seed in (11, 12, 13))
    rows = [(None, one), (None, one + " "), (5, two), (None, two), (5, three), (5, three), (6, three), (7, one + "  "), (None, "some other text of its own"), (None, "some other text of its own ")]
    assert brute_fingerprint(one) == brute_fingerprint(one + " ")
    got = [(r.doc_id, r.text.rstrip()) for r in P.simhash_near_dedup(spark, frame(spark, rows), SF).collect()]
    assert sorted(got, key=repr) == sorted([(7, one), (5, two), (5, three), (None, "some other text of its own")], key=repr)


@needs_tables
def test_queries_return_the_contract_columns(spark):
    from weft.llm.queries import QUERIES

    want = {
        "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op2": "doc_id held_out lang_pred score",
        "op3": "doc_id n_words n_removed kept_sha256",
        "op4": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op5": "doc_id fingerprint component_id",
        "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op7": "page_id url text n_chars",
        "op8": "doc_id piece start length ids_crc32 sequence_id offset",
        "op9": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op10": "doc_id held_out score predicted",
    }
    assert {n.split("_")[0] for n in QUERIES} == set(want)
    for name, f in QUERIES.items():
        assert f(spark, SF).columns[: len(want[name.split("_")[0]].split())] == want[name.split("_")[0]].split()


def test_toxic_stems_need_two_words(spark):
    """A stem that clean texts hold once by chance speaks only where two of its words meet."""
    import random

    from weft.llm.toxicity import learn, score_toxicity

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    tails = [a + b for a in "bdgkm" for b in "aeiou"]
    rows, marks = [], []
    for i in range(800):
        words = [word() for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            for tail in rng.sample(tails, 3):
                words[rng.randrange(30)] = "zwurk" + tail
        elif i % 4 == 1:
            words[rng.randrange(30)] = "zwurk" + rng.choice(tails)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks[:600], "doc_id long, toxic int")
    assert [s[:5] for s in learn(docs, labels).stems] == ["zwurk"]
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    # two of the three places may coincide, which leaves some with fewer words
    want = {i: int(len({w for w in t.split() if w.startswith("zwurk")}) > 1) for i, t in rows}
    assert sum(got[i] != want[i] for i in range(600, 800)) == 0
