"""Toxicity by a weighted finite-state pattern grammar.

Small transducers over word classes are composed into one machine: three mark
the words in the reach of reported speech, of a negation and of a threat, one
those after a target, and the last reads these marks with the insults. It walks
a clause from left to right and ends with the pattern it found: a plain or a
directed insult, a threat against a target, or either one negated or reported.
Arcs carry weights, and a clause scores the weight of its path and of its
strongest lexicon entry; isolated words score nothing.

What counts as an insult is learned from a bounded sample of labelled texts:
first stems that two or more different words of a text carry on, then, from the
texts without such stems, words and beginnings of words that go on in many
ways. Each needs evidence that stands out among all that were tested. So are
the weights of clause patterns. The sample's bound is ``per_class``; everything
else covers all rows.
"""

from __future__ import annotations

import collections
import functools
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import tidy
from .common import discard, materialize, prepare

#: Labelled texts that are learned from: so many toxic ones and CLEAN times as many others.
PER_CLASS = 3000
CLEAN = 3
#: Evidence, in nats beyond the logarithm of the number of features tested, that a lexicon entry needs.
MARGIN = 3.0
BEGINNINGS = range(3, 9)
STEMS = range(4, 9)
#: Words of one text that carry a stem on, for the stem to count on the evidence of a few texts.
BURST = 4
#: A clause ends at a sentence mark or a line end.
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Word classes of the grammar's other transducers (fixed lists; insults are learned).
TARGET = frozenset("you your yours he she him her his they them their u ya du dich dir ihr euch sie er tu te toi vous ton ta il elle ils elles tú usted ustedes él ella ellos ellas eres".split())
NEGATION = frozenset("not no never nobody none neither nor isn aren wasn don doesn cannot nicht kein keine keinen nie niemals ne pas jamais ni nunca jamás".split())
REPORT = frozenset("said says say called calls wrote writes quoted quotes reported claims claimed according sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
THREAT = frozenset("kill hurt destroy murder stab shoot beat strangle burn töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
#: Reach of a negation or a report, in words.
SCOPE = 4

OTHER, INSULT, AIM, NOT, SAY, HARM = range(6)
#: Clause patterns in order of strength.
PATTERNS = ("none", "reported", "negated", "plain", "directed", "threat")


def word_class(word: str) -> int:
    return AIM if word in TARGET else NOT if word in NEGATION else SAY if word in REPORT else HARM if word in THREAT else OTHER


@dataclass
class Transducer:
    """A deterministic finite-state transducer: step(state, symbol) gives the next state, the symbol written and the weight of the arc; it starts in `start`."""

    start: object
    step: Callable[[object, object], tuple[object, object, float]]


def mark(first: Callable[[object, int], object], now: Callable[[object], bool], start: object = 0) -> Transducer:
    """Copies its input and appends whether `now` holds of the words before it; `first` moves the state by the word's class."""
    return Transducer(start, lambda state, symbol: (first(state, symbol[0]), (*symbol, now(state)), 0.0))


def within(kind: int) -> Transducer:
    """Marks the words that stand up to SCOPE words after one of a class."""
    return mark(lambda left, k: SCOPE if k == kind else max(0, left - 1), bool)


def ever(kind: int) -> Transducer:
    """Marks the words that stand anywhere after one of a class."""
    return mark(lambda seen, k: seen or k == kind, bool, False)


def scorer(weights: dict[str, float]) -> Transducer:
    """Reads (class, reported, negated, aimed, after harm); its state is the strongest pattern so far, and an arc to a stronger one weighs what that adds."""
    value = [0.0, *(weights[p] for p in PATTERNS[1:])]

    def step(best: int, symbol: tuple) -> tuple[int, tuple, float]:
        kind, said, denied, aimed, harm = symbol
        held_back = 1 if said else 2 if denied else 0
        found = 0
        if kind == INSULT:
            found = held_back or (4 if aimed else 3)
        elif kind == HARM and aimed:
            found = held_back or 5
        elif kind == AIM:
            found = 4 if best == 3 else 5 if harm and not held_back else 0
        after = max(best, found)
        return after, symbol, value[after] - value[best]

    return Transducer(0, step)


def compose(left: Transducer, right: Transducer) -> Transducer:
    """One transducer that gives what `left` writes to `right`; weights along a path add up."""

    def step(state: tuple, symbol: object) -> tuple[tuple, object, float]:
        one, between, w = left.step(state[0], symbol)
        two, written, v = right.step(state[1], between)
        return (one, two), written, w + v

    return Transducer((left.start, right.start), step)


class Machine:
    """The grammar's transducers composed into one, with its reachable arcs in tables."""

    def __init__(self, weights: dict[str, float]):
        whole = functools.reduce(compose, [within(SAY), within(NOT), ever(AIM), within(HARM), scorer(weights)])
        number = {whole.start: 0}
        self.arcs: list[list[tuple[int, float]]] = []
        self.best: list[int] = []
        for state in (todo := [whole.start]):  # grows while it is read
            row = []
            for kind in range(6):
                after, _, weight = whole.step(state, (kind,))
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append((number[after], weight))
            self.arcs.append(row)
            self.best.append(state[1])

    def read(self, kinds: Iterable[int]) -> tuple[str, float]:
        """The pattern that a clause ends with and the weight of its path."""
        state, total, arcs = 0, 0.0, self.arcs
        for k in kinds:
            state, weight = arcs[state][k]
            total += weight
        return PATTERNS[self.best[state]], total


_CLAUSES = pa.list_(pa.struct([("pattern", pa.string()), ("weight", pa.float64())]))


@dataclass
class Grammar:
    """words, beginnings and stems (insults where two different words of a text carry them on): weight of evidence (log odds) of each lexicon entry; patterns: what a clause pattern adds; rest: probability of a text without a match."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=lambda: {"reported": -0.7, "negated": -0.7, "plain": 0.0, "directed": 0.5, "threat": 1.5})
    rest: float = 0.02

    def automaton(self):
        """The lexicon as one automaton over characters, and the machine over word classes."""
        found = ahocorasick.Automaton()
        for entry in {*self.words, *self.beginnings, *self.stems, *THREAT}:
            found.add_word(entry, (entry, self.words.get(entry), self.beginnings.get(entry), self.stems.get(entry), entry in THREAT))
        found.make_automaton()
        return found, Machine(self.patterns)

    def clauses(self, text: str, machines) -> list[tuple[str, float]]:
        """(pattern, weight) of each clause that has one: the weight of its path and of its strongest lexicon entry. One walk over the hits and the clause ends."""
        automaton, machine = machines
        text = text.lower()
        hits: dict[int, float | None] = {}
        carried: dict[tuple[str, float], dict[str, list[int]]] = {}
        for end, (entry, word, beginning, stem, threat) in automaton.iter(text):
            at = end - len(entry) + 1
            if at and text[at - 1].isalpha():
                continue
            goes_on = end + 1 < len(text) and text[end + 1].isalpha()
            weights = [w for w in (beginning, None if goes_on else word) if w is not None]
            if weights:
                hits[at] = max(*weights, hits.get(at) or -99.0)
            elif threat and not goes_on:
                hits.setdefault(at, None)
            if stem is not None and goes_on:
                whole = WORD.match(text, at)
                carried.setdefault((entry, stem), {}).setdefault(whole.group() if whole else entry, []).append(at)
        for (_, weight), forms in carried.items():
            if len(forms) > 1:
                for at in (x for places in forms.values() for x in places):
                    hits[at] = max(weight, hits.get(at) or -99.0)
        out: list[tuple[str, float]] = []
        if not hits:
            return out
        places = sorted(hits)
        lo = i = 0  # where the clause starts, and the first hit that is not before it
        for stop, after in [*((m.start(), m.end()) for m in CLAUSE.finditer(text)), (len(text), len(text))]:
            first = i
            while i < len(places) and places[i] < stop:
                i += 1
            if i == first:
                lo = after
                continue
            weights = [w for h in places[first:i] if (w := hits[h]) is not None]
            kinds = [INSULT if hits.get(m.start()) is not None else word_class(m.group()) for m in WORD.finditer(text, lo, stop)]
            lo = after
            pattern, weight = machine.read(kinds)
            if pattern != "none":
                out.append((pattern, weight + max(weights, default=self.patterns["threat"])))
        return out

    def weigh(self, found: list[tuple[str, float]]) -> float:
        """Probability that a text with these clauses is toxic: the strongest one, raised a little by each further one."""
        if not found:
            return self.rest
        odds = sorted((w for _, w in found), reverse=True)
        total = odds[0] + 0.3 * math.log(len(odds))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _features(text: str) -> set[str]:
    """The distinct words of a text (marked by a final $), their beginnings, and the stems that two of them carry on (a final +) or BURST of them (a final *)."""
    out: set[str] = set()
    carried: collections.Counter[str] = collections.Counter()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        for k in BEGINNINGS:
            if k > len(w):
                break
            out.add(w[:k])
            if k in STEMS and k < len(w):
                carried[w[:k]] += 1
    for stem, n in carried.items():
        if n > 1:
            out.add(stem + "+")
        if n >= BURST:
            out.add(stem + "*")
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Up to per_class toxic texts and CLEAN times as many others, chosen by a hash of doc_id; equal texts count once. A doc_id with several labels is toxic if one says so."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.least(F.greatest(F.col("toxic").cast("int"), F.lit(0)), F.lit(1)).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    place = F.xxhash64("doc_id")
    picked = []
    for k, n in ((0, CLEAN * per_class), (1, per_class)):
        # a cut first, or every partition would send n rows to the sort
        cut = min(2**63 - 1, -(2**63) + 2**64 * 2 * n // max(1, counts.get(k, 0)))
        picked.append(known.where((F.col("toxic") == k) & (place <= cut)).orderBy(place, "doc_id").limit(n))
    ids = picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most (1 + CLEAN) * per_class ids
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64("text"))


def _origin(text: str) -> int:
    """Smallest hash of the text's three-word shingles: copies and most near copies share it."""
    words = text.encode().lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Grammar:
    """A grammar from labelled texts; without toxic ones, one that matches nothing but threats."""
    prepare(docs.sparkSession)

    def take_apart(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([_origin(t) for t in texts], pa.int64()), part.column(0), part.column(2), pa.array([sorted(_features(t)) for t in texts], pa.list_(pa.string()))], names=["origin", "key", "toxic", "features"])

    apart = materialize(sample_labelled(docs, labels, per_class).select("key", "text", "toxic").mapInArrow(take_apart, "origin long, key long, toxic int, features array<string>"), "toxicity")
    # of near copies one is learned from: the one of smallest hash
    one = apart.groupBy("origin", "toxic").agg(F.min("key").alias("key"))
    sample = materialize(apart.join(F.broadcast(one), ["origin", "toxic", "key"], "left_semi").dropDuplicates(["origin", "toxic"]).select("origin", "toxic", "features"), "toxicity")
    discard(apart)
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1):
        return Grammar()
    clean, toxic = size.get(0, 0), size[1]
    base = toxic / (clean + toxic) if clean else 0.5
    grammar = Grammar()
    found = _evidence(sample, base, ~F.col("feature").rlike("[+*]$"))
    stems = {f[:-1]: n for f, n in _evidence(sample, base, F.col("feature").endswith("+")).items()}
    for entry, n in _bursts(sample, toxic).items():
        stems.setdefault(entry, n)
    for entry in choose(stems):
        if not any(_as_good(found.get(b), stems[entry]) for b in [entry[:k] for k in BEGINNINGS] + [b for b in found if b.startswith(entry)]):
            grammar.stems[entry] = _weight(*stems[entry])
    if grammar.stems:
        # what speaks without the stems: words that only go along with them do not
        left = sample.where(~F.arrays_overlap("features", F.array(*[F.lit(x + "+") for x in grammar.stems])))
        found = _evidence(left, base, ~F.col("feature").rlike("[+*]$"))
    for entry in choose(found):
        (grammar.words if entry.endswith("$") else grammar.beginnings)[entry.rstrip("$")] = _weight(*found[entry])
    if grammar.words or grammar.beginnings or grammar.stems:
        entries = F.broadcast(docs.sparkSession.createDataFrame([(f"{w}$",) for w in grammar.words] + [(b,) for b in grammar.beginnings] + [(f"{x}+",) for x in grammar.stems], "feature string"))
        hit = sample.where("toxic = 1").select("origin", F.explode("features").alias("feature")).join(entries, "feature").agg(F.countDistinct("origin")).first()[0]
        grammar.rest = max(0.001, min(0.2, (toxic - hit + 0.5) / (clean + toxic - hit + 1)))
    else:
        grammar.rest = min(0.2, base)
    return grammar


def _weight(bad: int, n: int) -> float:
    return math.log((bad + 0.5) / (n - bad + 0.5))


def _as_good(plain: tuple[int, int] | None, stem: tuple[int, int]) -> bool:
    """Whether a plain beginning finds the toxic texts of a stem about as purely: then one word of it is enough."""
    return plain is not None and plain[0] >= 0.95 * stem[0] and plain[0] * stem[1] >= 0.95 * stem[0] * plain[1]


def _evidence(sample: DataFrame, base: float, family) -> dict[str, tuple[int, int]]:
    """(toxic texts, texts) of the features of a family whose evidence stands out among all of the family."""
    counted = materialize(sample.select("toxic", F.explode("features").alias("feature")).where(family).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where("n >= 3"), "toxicity")
    tested = counted.count()
    q = F.col("bad") / F.col("n")
    gain = F.col("bad") * F.log(q / base) + F.when(q < 1, (F.col("n") - F.col("bad")) * F.log((1 - q) / (1 - base))).otherwise(0.0)
    sure = counted.where((q >= 0.6) & (gain >= math.log(max(2, tested)) + MARGIN))
    out = {r["feature"]: (r["bad"], r["n"]) for r in sure.collect()}  # of the sample, which is bounded
    discard(counted)
    return out


def _bursts(sample: DataFrame, toxic: int) -> dict[str, tuple[int, int]]:
    """(toxic texts, texts) of the stems that BURST words of a text carry on in at least two and in one of a hundred toxic texts, and in no other text. Where only a few toxic texts are known, this is the evidence there is; clean texts hardly ever carry such a stem on."""
    exploded = sample.select("toxic", F.explode("features").alias("feature"))
    sure = exploded.where(F.col("feature").endswith("*")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(f"n = bad and n >= greatest(2, {toxic} / 100)")
    stems = sure.select(F.expr("rtrim('*', feature) || '+'").alias("feature"))
    counted = exploded.join(F.broadcast(stems), "feature").groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    return {r["feature"][:-1]: (r["bad"], r["n"]) for r in counted.collect()}


def choose(found: dict[str, tuple[int, int]]) -> list[str]:
    """Lexicon entries among words (with a final $) and beginnings that speak for toxicity.

    From the shortest beginning down: where one continuation makes up nearly
    all of its texts, or is clearly purer, the continuations are looked at
    instead; a pure beginning that goes on in many ways is an inflected stem
    and stays, and what it covers is dropped.
    """
    children: dict[str, list[str]] = {}
    roots = []
    for f in found:
        stem = f.rstrip("$") if f.endswith("$") else f[:-1]
        while stem and stem not in found:
            stem = stem[:-1]
        if stem:
            children.setdefault(stem, []).append(f)
        else:
            roots.append(f)
    out, todo = [], roots
    while todo:
        f = todo.pop()
        below = children.get(f, [])
        purity = found[f][0] / found[f][1]
        if below and (max(found[c][0] for c in below) >= 0.95 * found[f][0] or purity < 0.95 * max(found[c][0] / found[c][1] for c in below)):
            todo += below
        else:
            out.append(f)
    return out


def _tune(docs: DataFrame, labels: DataFrame, grammar: Grammar, per_class: int) -> Grammar:
    """Pattern weights from texts of the sample: how often a text whose strongest clause has the pattern is toxic, against what its lexicon weight says."""
    sample = sample_labelled(docs, labels, per_class)
    names = list(PATTERNS[1:])

    def look(batches):
        machines = grammar.automaton()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = {p for p, _ in grammar.clauses(text, machines)}
                if len(found) == 1:
                    rows.append((found.pop(), toxic))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["pattern", "toxic"])

    seen = {r["pattern"]: (r["bad"], r["n"]) for r in sample.select("key", "text", "toxic").mapInArrow(look, "pattern string, toxic int").groupBy("pattern").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()}
    plain = seen.get("plain", (0, 0))

    def odds(bad: float, n: float, prior: float) -> float:
        p = (bad + 2 * prior) / (n + 2)
        return math.log(p / (1 - p))

    base = odds(*plain, 0.8)
    for name in names:
        if name != "plain" and name in seen:
            prior = 1 / (1 + math.exp(-(base + grammar.patterns[name])))
            grammar.patterns[name] = odds(*seen[name], prior) - base
    return grammar


def fit_grammar(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Grammar:
    """The grammar that score_toxicity() uses: lexicon and pattern weights."""
    prepare(docs.sparkSession)
    grammar = learn(docs, labels, per_class)
    if grammar.words or grammar.beginnings or grammar.stems:
        grammar = _tune(docs, labels, grammar, per_class)
    return grammar


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and clauses (pattern and weight of each match) for each row.

    docs needs doc_id and text, labels doc_id and toxic: the caller passes the
    labels that may be learned from. Other columns are ignored and labels never
    enter a score. Null and empty texts have no clause and get the score of a
    text without a match; without usable labels only threats match. Texts and
    clauses of any length are read whole; repeated rows get a row each and equal
    texts equal scores. Labels that contradict each other count as toxic, and of
    lexicon entries that find the same texts the shortest is taken.
    """
    grammar = fit_grammar(docs, labels, per_class)

    def work(batches):
        machines = grammar.automaton()
        for batch in batches:
            found = [grammar.clauses(t or "", machines) for lo in range(0, batch.num_rows, 256) for t in batch.column(1).slice(lo, 256).to_pylist()]
            score = np.array([grammar.weigh(f) for f in found])
            clauses = pa.array([[{"pattern": p, "weight": w} for p, w in f] for f in found], _CLAUSES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), clauses], names=["doc_id", "score", "predicted", "clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double, predicted int, clauses array<struct<pattern:string,weight:double>>")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay as they are, whatever their names. One scan, no join."""
    grammar = fit_grammar(docs, labels, per_class)
    at = [c.lower() for c in docs.columns].index("text")

    def work(batches):
        machines = grammar.automaton()
        for batch in batches:
            stay: list[bool] = []
            for lo in range(0, batch.num_rows, 256):
                stay += [grammar.weigh(grammar.clauses(t or "", machines)) < threshold for t in batch.column(at).slice(lo, 256).cast(pa.string()).to_pylist()]
            yield batch if all(stay) else batch.filter(pa.array(stay, pa.bool_()))
            tidy()

    return docs.mapInArrow(work, docs.schema)
