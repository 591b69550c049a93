"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, weighed in context windows.

Learning (``learned``) reads labelled rows only, at most about ``most`` of them: words, and
word stems, that toxic texts hold far more often than clean ones.  Terms must add toxic texts
that stronger terms do not cover, or be common among them.  Near copies of one text are a family
and weigh as one text of their class in every count and in the fit, so that the vocabulary of a
text with many copies neither passes for abuse nor hides what other texts hold.  Forms near a
term that clean texts use are listed as exceptions.  A logistic curve over three sums of hits turns them into a score.

Scoring runs every word of every text through one automaton: the trie of all terms in product
with the Levenshtein automata of its words (one edit from five letters, two from nine; stems
match exactly), determinised lazily, so that a word costs one table step per letter and most
words die after a few.  Each hit is weighed by its edits and by a window of ``window`` words
around it: inside quotation marks or after a word that reports speech it counts for less,
near a second person or other hits for more.

Empty cases: null and empty texts have no hits and get the score of none.  Words may be of any
length.  Rows that share a doc_id are scored one by one; several labels of one id count as
toxic if one is.  Null labels are not read.  Without a toxic or a clean label every score is 0.
An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, written
from .words import WordHashes, shingles, slices

_WORD = re.compile(r"[^\W_][\w@$*!]*")
#: Fixed word lists of the context windows.
_REPORTS = frozenset("said says say called calls wrote writes quote quoted quotes word term phrase slur dit disait appelle mot citation sagte sagt nannte wort zitat dijo llamó palabra cita".split())
_SECOND = frozenset("you your yours youre u ya tu te toi vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split())
_OPEN, _CLOSE = "\"“”„«‘", "\"”“»’"
_STEMS = range(3, 8)


class LexiconAutomaton:
    """Words and stems in one trie; ``match`` gives (term, edits) of the best term that a word matches, or None."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.reach = [0]  # most edits that a word below may take
        for terms, at, stem in ((words, self.word_at, False), (stems, self.stem_at, True)):
            for term in terms:
                node, edits = 0, 0 if stem else self.allowed(term)
                self.reach[0] = max(self.reach[0], edits)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.reach.append(0)
                    node = self.children[node][c]
                    self.reach[node] = max(self.reach[node], edits)
                at[node] = term
        self.letters = {c for node in self.children for c in node}
        self._start()

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0

    def _start(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.stem: list[str | None] = []
        self.step: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # letters of a term that the word leaves out
            node, edits = todo.pop()
            if nodes[node] == edits:
                for child in self.children[node].values():
                    if edits + 1 <= self.reach[child] and nodes.get(child, 9) > edits + 1:
                        nodes[child] = edits + 1
                        todo.append((child, edits + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.step.append({})
            self.stem.append(next((self.stem_at[n] for n, e in nodes.items() if e == 0 and n in self.stem_at), None))
        return self.states[key]

    def _next(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] or edits == 0:
                nodes[node] = min(edits, nodes.get(node, 9))

        for node, edits in self.sets[state].items():
            for c, child in self.children[node].items():
                put(child, edits + (c != letter))
            put(node, edits + 1)
        nodes = {n: e for n, e in nodes.items() if e <= self.reach[n] or e == 0}
        to = self.step[state][letter] = self._state(nodes) if nodes else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > 50_000:
            self._start()
        state, stem = self.start, None
        for c in word:
            c = c if c in self.letters else "\0"
            state = self.step[state][c] if c in self.step[state] else self._next(state, c)
            if state < 0:
                break
            stem = self.stem[state] or stem
        if state >= 0:
            found = min(((e, self.word_at[n]) for n, e in self.sets[state].items() if n in self.word_at and e <= self.allowed(self.word_at[n])), default=None)
            if found and (found[0] == 0 or not stem):
                return found[1], found[0]
        return (stem, 0) if stem else None


@dataclass
class Model:
    """What learning yields; ``weights`` are the constant and the weights of the three sums."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model, window: int = 12, cache: int = 200_000):
        self.model, self.window, self.most = model, window, cache
        self.automaton = LexiconAutomaton(sorted(model.terms), sorted(model.stems))
        self.known: dict[str, tuple[float, int] | None] = {}

    def _hit(self, word: str) -> tuple[float, int] | None:
        if len(self.known) >= self.most:
            self.known.clear()
        found = self.automaton.match(word)
        hit = None
        if found and not (found[1] and word in self.model.exceptions):
            term, edits = found
            hit = (self.model.terms.get(term) or self.model.stems[term], edits)
        self.known[word] = hit
        return hit

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(place, word, weight in context) of each hit."""
        words = _WORD.findall(text.lower())
        get, miss = self.known.get, object()
        found = []
        for k, w in enumerate(words):
            hit = get(w, miss)
            if hit is miss:
                hit = self._hit(w)
            if hit:
                found.append((k, w, hit))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text.lower())]
        lowered, places = text.lower(), [k for k, _, _ in found]
        out = []
        for i, (k, w, (weight, edits)) in enumerate(found):
            crowded = i > 0 and k - places[i - 1] <= self.window or i + 1 < len(places) and places[i + 1] - k <= self.window
            near = words[max(0, k - self.window) : k + self.window + 1]
            begin, end = spans[max(0, k - self.window)][0], spans[min(len(spans) - 1, k + self.window)][1]
            before, after = lowered[begin : spans[k][0]], lowered[spans[k][1] : end]
            weight *= 0.8**edits
            if self._quoted(before, after) or _REPORTS & set(words[max(0, k - 3) : k]):
                weight *= 0.35
            else:
                weight *= 1.15 if _SECOND & set(near) else 1.0
                weight *= 1.1 if crowded else 1.0
            out.append((k, w, weight))
        return out

    @staticmethod
    def _quoted(before: str, after: str) -> bool:
        opened = sum(before.count(c) for c in _OPEN) - sum(before.count(c) for c in "”»’" if c not in _OPEN)
        return opened % 2 == 1 and any(c in after for c in _CLOSE)

    def sums(self, text: str | None) -> tuple[float, float, float]:
        hits = self.hits(text or "")
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for _, _, w in hits)
        return max(w for _, _, w in hits), math.log1p(total), math.log1p(100 * total / (1 + len(text or "") / 6))

    def score(self, text: str | None) -> float:
        z = self.model.weights[0] + sum(w * s for w, s in zip(self.model.weights[1:], self.sums(text), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _grams(word: str) -> Iterator[str]:
    for n in _STEMS:
        if len(word) > n:
            yield word[:n] + "*"


#: Odd factors of the permutations that find families, ``_BAND`` to a band: near copies share a band, other texts hardly ever do.
_BAND = 4
_FACTORS = np.random.default_rng(9).integers(1 << 62, 1 << 63, 12 * _BAND, dtype=np.uint64) | np.uint64(1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``bands``, hashes of the least permuted runs of three words, and ``key``, one hash of them all."""
    cache = WordHashes()
    for batch in batches:
        bands, keys = [], []
        for body in batch.column("body").to_pylist():
            runs = shingles(cache.of((body or b"").lower().split()), 3)
            least = np.array([(runs * f).min() if len(runs) else 0 for f in _FACTORS], np.uint64).tolist()
            bands.append([hash((k, *least[k : k + _BAND])) for k in range(0, len(least), _BAND)])
            keys.append(hash(tuple(least)))
        yield pa.RecordBatch.from_arrays([batch.column("body"), batch.column("y"), pa.array(bands, pa.list_(pa.int64())), pa.array(keys, pa.int64())], names=["body", "y", "bands", "key"])


def _families(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """(body, y, family, share) of a sample with bands, ``share`` one over the rows of the family and class, and the families of either class."""
    kinds = sample.groupBy("key", (F.col("y") > 0).alias("toxic")).agg(F.first("bands").alias("bands"), F.count("*").alias("n")).collect()  # at most ``most`` rows
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in kinds:
        for b in r.bands:
            parent[find(b)] = find(r.bands[0])
    place: dict[int, int] = {}
    family = [place.setdefault(find(r.bands[0]), len(place)) for r in kinds]
    sizes: Counter[tuple[int, bool]] = Counter()
    for r, f in zip(kinds, family, strict=True):
        sizes[f, r.toxic] += r.n
    shares = sample.sparkSession.createDataFrame([(r.key, r.toxic, f, 1 / sizes[f, r.toxic]) for r, f in zip(kinds, family, strict=True)], "key long, toxic boolean, family int, share double")
    rows = sample.withColumn("toxic", F.col("y") > 0).join(F.broadcast(shares), ["key", "toxic"]).select("body", "y", "family", "share")
    return rows, sum(toxic for _, toxic in sizes), sum(not toxic for _, toxic in sizes)


def learned(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 20_000, ratio: float = 20.0) -> Model:
    """A model from documents that ``labels`` names, about ``most`` of them, picked by a hash of their id.

    Terms and exceptions are those of these texts that pass the tests of counts; their number has no other bound.
    """
    small_batches(docs.sparkSession)
    kinds = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    count = kinds.count()
    if count > most:
        kinds = kinds.filter(F.pmod(F.xxhash64("doc_id"), F.lit(count)) < most)
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    labelled = bodies.join(F.broadcast(kinds), "doc_id").select("body", "y")  # at most ``most`` ids
    sample, n_bad, n_good = _families(written(labelled.mapInArrow(_bands, "body binary, y int, bands array<long>, key long"), "labelled"))
    if not n_bad or not n_good:
        return Model()

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for body, y, share in zip(*(batch.column(c).to_pylist() for c in ("body", "y", "share")), strict=True):
                own = set(_WORD.findall((body or b"").decode("utf-8", "replace").lower()))
                count = bad if y > 0 else good
                for t in own.union(*({g} for w in own for g in _grams(w))):
                    count[t] += share
        names = list(bad)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([bad[n] for n in names], pa.float64()), pa.array([good[n] for n in names], pa.float64())], names=["term", "bad", "good"])
        names = [n for n in good if n not in bad]
        for start in range(0, len(names), 1 << 16):
            some = names[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([0.0] * len(some), pa.float64()), pa.array([good[n] for n in some], pa.float64())], names=["term", "bad", "good"])

    least = max(5, math.ceil(0.002 * n_bad))
    counted = sample.mapInArrow(count_terms, "term string, bad double, good double").groupBy("term").agg(F.round(F.sum("bad"), 6).alias("bad"), F.round(F.sum("good"), 6).alias("good"))  # rounded: sums of shares come in any order
    rate = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
    strong = counted.filter((F.col("bad") >= least) & (rate >= ratio)).withColumn("rate", rate).collect()  # words of at least ``least`` families of the sample
    stats = {r.term: (r.bad, math.log(r.rate)) for r in strong}
    chosen = _cover(sample, stats, *_closed(stats), n_bad, least)
    model = Model({t: min(8.0, stats[t][1]) for t in chosen if not t.endswith("*")}, {t[:-1]: min(8.0, stats[t][1]) for t in chosen if t.endswith("*")})
    return _weighed(sample, model)


def _closed(stats: dict[str, tuple[float, float]]) -> tuple[list[str], list[str]]:
    """Words and stems to choose from: of stems of one another the longest that keeps the cover, of words a stem covers none."""
    stems = sorted((t for t in stats if t.endswith("*")), key=len, reverse=True)
    closed: set[str] = set()
    longer: dict[str, set[str]] = {}  # stems by what they start with
    for s in stems:
        above = longer.get(s[:-1], set()) & closed
        if not any(stats[t][0] >= 0.9 * stats[s][0] for t in above):
            closed = closed - above if above else closed
            closed.add(s)
            for n in range(_STEMS[0], len(s) - 1):
                longer.setdefault(s[:n], set()).add(s)
    best: dict[str, float] = {}  # the most toxic texts that one word with that beginning holds
    for t in stats:
        if not t.endswith("*"):
            for n in _STEMS:
                best[t[:n]] = max(stats[t][0], best.get(t[:n], 0))
    closed = {s for s in closed if stats[s][0] > 1.1 * best.get(s[:-1], 0)}
    return [t for t in stats if not t.endswith("*") and not any(t[:n] + "*" in closed for n in _STEMS)], list(closed)


def _cover(sample: DataFrame, stats: dict, words: list[str], stems: list[str], n_bad: int, least: int) -> list[str]:
    """Terms, strongest cover first, that add toxic texts to those before, or are common among them; a family counts once."""
    wanted = sorted([*words, *stems], key=lambda t: (-stats[t][0], t))
    place = {t: k for k, t in enumerate(wanted)}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column("body").to_pylist():
                own = set(_WORD.findall((body or b"").decode("utf-8", "replace").lower()))
                out.append(sorted({place[t] for w in own for t in (w, *_grams(w), w + "*") if t in place}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column("family")], names=["terms", "family"])

    rows = sample.filter("y > 0").mapInArrow(holds, "terms array<int>, family int").collect()  # at most ``most`` rows
    families = {r.family for r in rows if r.terms}
    holders: dict[int, set[int]] = {}
    for r in rows:
        for t in r.terms:
            holders.setdefault(t, set()).add(r.family)
    covered: set[int] = set()
    chosen = []
    for k in sorted(holders, key=lambda t: (-len(holders[t]), t)):
        if len(holders[k] - covered) >= min(least, 3) or len(holders[k]) >= 0.02 * len(families):
            chosen.append(wanted[k])
            covered |= holders[k]
    return chosen


def _weighed(sample: DataFrame, model: Model) -> Model:
    """The model with its exceptions and the weights of its sums."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found = Scorer(model), Counter()
        for batch in batches:
            for body in batch.column("body").to_pylist():
                for w in set(_WORD.findall((body or b"").decode("utf-8", "replace").lower())):
                    hit = scorer.automaton.match(w) if w not in scorer.known else scorer.known[w]
                    scorer.known[w] = hit
                    if hit and hit[1]:
                        found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])

    exceptions = frozenset(r.word for r in sample.filter("y = 0").mapInArrow(near, "word string").distinct().collect())
    model = Model(model.terms, model.stems, exceptions)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [(*scorer.sums((b or b"").decode("utf-8", "replace")), float(y > 0), w) for b, y, w in zip(*(batch.column(c).to_pylist() for c in ("body", "y", "share")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 5, names=["a", "b", "c", "y", "share"])

    rows = np.array(sorted(tuple(r) for r in sample.mapInArrow(sums, "a double, b double, c double, y double, share double").collect()))  # sorted: sums do not depend on the order of tasks
    x, y, n = np.hstack([np.ones((len(rows), 1)), rows[:, :3]]), rows[:, 3], rows[:, 4]
    penalty, beta = np.diag([0.01, 0.5, 0.5, 0.5]), np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.terms, model.stems, exceptions, tuple(beta.tolist()))


def scores(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", window: int = 12) -> DataFrame:
    """(doc_id, score) per document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of at most ``most`` labelled texts
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, window)
        for batch in batches:
            for part in slices(batch, "body"):
                found = [scorer.score((b or b"").decode("utf-8", "replace")) for b in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7, window: int = 12) -> DataFrame:
    """The documents, all their columns, that score below ``threshold``."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, window)
        for batch in batches:
            bodies = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.binary())], names=["body"])
            clean = [scorer.score((b or b"").decode("utf-8", "replace")) < threshold for part in slices(bodies, "body") for b in part.column("body").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Column: the document belongs to the third that learning never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
