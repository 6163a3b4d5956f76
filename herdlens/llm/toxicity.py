"""Toxicity: a learned lexicon, searched with Levenshtein automata, and scores of the hits' context.

The lexicon holds words, and stems that stand for all words that begin with them. It is learned from labelled documents:
a term is taken in if chance would hardly put it in so many toxic ones, near copies counted once, and if it is far more
frequent there. The terms form a trie. An automaton that accepts every word within a few edits of a term is the product
of the trie with the error counts of the Levenshtein automata of all terms; it is made deterministic as words ask for it,
so a word costs a step a character and most end after three. Short terms and stems allow no edit, longer terms one, long
ones two. A misspelling that clean documents use is an ordinary word, and a term with many such neighbours allows no edit.

Hits are told apart by their context: a window of the words around them, on their line. A hit between quotation marks, or
on a line that quotes, is a mention, not abuse; further hits in the window and exclamation marks make abuse likelier. A
logistic model over a few such numbers, fitted with a prior that states this, gives the score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .textarrays import text_buffers

#: Bounds of the training sample, on average: labelled documents of each class. The texts are whole.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Most terms that are learned: those in most documents.
TERMS = 2000
#: Code points of stems; a stem is shorter than the words that it stands for.
STEMS = (4, 5, 6, 7, 8)
#: How many times more frequent a term is in toxic documents, in how many of them it is at least, how many terms a round
#: may be expected to take in by chance, and the most rounds.
LEAST_RATIO, LEAST_DOCUMENTS, CHANCE, ROUNDS = 20.0, 3, 0.5, 4
#: How many times more frequent a term of full strength is.
FULL_RATIO = 1000.0
#: From how many code points on a term allows an edit, and two.
ONE_EDIT, TWO_EDITS = 5, 10
#: A term with a misspelling that is in so few clean documents, but in some, has others that the sample doesn't show (the
#: estimate of Good and Turing): it allows no edit.
SELDOM = 2
#: Words on either side of a hit that are its context, and bytes of its line that are looked at on either side.
WINDOW, REACH = 8, 2000
#: Words that a worker remembers, and states of the automaton; beyond that they are made anew.
KNOWN_WORDS, STATES = 400_000, 50_000
#: What the score is made of, with the weights that hold before anything is learned: the strongest hit that is plain,
#: quoted, misspelt; the number of hits (its logarithm); whether a window holds several; whether one has an exclamation.
FEATURES = ("bias", "plain", "quoted", "misspelt", "hits", "several", "exclaimed")
PRIOR = (-3.0, 6.0, 1.5, 4.5, 0.3, 0.3, 0.2)
#: How many documents' worth of evidence the prior is.
PRIOR_STRENGTH = 2.0

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: What is quoted: a mention in a clean document doesn't speak for the word.
_MENTION = re.compile(r"""(?m)"[^"\n]{1,2000}"|“[^”\n]{1,2000}”|«[^»\n]{1,2000}»|„[^“\n]{1,2000}“|‹[^›\n]{1,2000}›|^\s*>.*$""")
#: Pairs of quotation marks that differ; the straight one opens and closes.
_MARKS = tuple((a.encode(), b.encode()) for a, b in (("“", "”"), ("«", "»"), ("„", "“"), ("‹", "›")))


@dataclass
class Lexicon:
    """terms: word or stem, whether it is a stem, its strength from 0 to 1. ordinary: misspellings that are none.
    strict: terms that allow no edit."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    ordinary: frozenset[str] = frozenset()
    strict: frozenset[str] = frozenset()

    def edits(self, k: int) -> int:
        """How many edits away a word still counts as term k."""
        term, stem, _ = self.terms[k]
        return 0 if stem or len(term) < ONE_EDIT or term in self.strict else 1 if len(term) < TWO_EDITS else 2


class Automaton:
    """The words within reach of a lexicon's terms."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        # the trie: children of each node, the term that ends there, the stem, and the most edits of any term beyond
        self.children, self.word, self.stem, self.reach = [{}], [-1], [-1], [0]
        for k, (term, stem, _) in enumerate(lexicon.terms):
            at, allowed = 0, lexicon.edits(k)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], allowed)
            (self.stem if stem else self.word)[at] = k
        self.alphabet = {c for node in self.children for c in node}
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.sets, self.moves, self.ends, self.stems = {}, [], [], [], []
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state with these nodes (least edits of each) and what can be reached by leaving out letters."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.reach[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            fits = [(e, -self.lexicon.terms[self.word[n]][2], self.word[n]) for n, e in key if self.word[n] >= 0 and e <= self.lexicon.edits(self.word[n])]
            self.ends.append(min(fits) if fits else None)
            self.stems.append(max((self.stem[n] for n, e in key if e == 0 and self.stem[n] >= 0), default=-1))
        return number

    def _step(self, number: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.sets[number]:
            child = self.children[node].get(c)
            if child is not None and e < nodes.get(child, 99):
                nodes[child] = e
            if e < self.reach[node] and e + 1 < nodes.get(node, 99):
                nodes[node] = e + 1
            for other in self.children[node].values():
                if e < self.reach[other] and e + 1 < nodes.get(other, 99):
                    nodes[other] = e + 1
        return self._state(nodes)

    def __call__(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the strongest of equally near ones; a stem at once when it is met."""
        if len(self.sets) > STATES:
            self._begin()
        at = 0
        for c in word:
            c = c if c in self.alphabet else ""
            to = self.moves[at].get(c)
            if to is None:
                to = self.moves[at][c] = self._step(at, c)
            at = to
            if self.stems[at] >= 0:
                return self.stems[at], 0
            if not self.sets[at]:
                return None
        end = self.ends[at]
        if end is None or (end[0] and word in self.lexicon.ordinary):
            return None
        return end[2], end[0]


class Scanner:
    """Finds and describes the hits of a text, given as its bytes."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self.clean: set[bytes] = set()
        self.known: dict[bytes, tuple[int, int]] = {}

    def hits(self, raw: bytes) -> list[tuple[int, int, int, str, bool, bool]]:
        """(word number, term, edits, word, quoted, exclaimed) of each hit, in order."""
        low = raw.lower()  # of bytes: A-Z only
        bare = _bare(low)
        new = set(_WORD.findall(bare)) - self.clean
        if not new:
            return []
        found = {}
        for w in new:
            hit = self.known.get(w)
            if hit is None:
                hit = self.automaton(w.decode("utf-8", "replace"))
                if hit is None:
                    self.clean.add(w)
                    continue
                self.known[w] = hit
            found[w] = hit
        if len(self.clean) > KNOWN_WORDS:
            self.clean = set()
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        if not found:
            return []
        out = []
        for k, m in enumerate(_WORD.finditer(bare)):
            hit = found.get(m[0])
            if hit is not None:
                out.append((k, *hit, m[0].decode("utf-8", "replace"), *_context(low, m.start(), m.end())))
        return out

    def features(self, hits) -> list[float]:
        """In the order of FEATURES."""
        terms = self.lexicon.terms
        strongest = lambda some: max((terms[h[1]][2] for h in some), default=0.0)
        exact = [h for h in hits if not h[2]]
        near = any(b[0] - a[0] <= WINDOW and not (a[4] or b[4]) for a, b in zip(hits, hits[1:]))
        return [
            1.0,
            strongest(h for h in exact if not h[4]),
            strongest(h for h in exact if h[4]),
            strongest(h for h in hits if h[2]) * (0.3 if all(h[4] for h in hits if h[2]) else 1.0),
            float(np.log1p(sum(not h[4] for h in hits))),
            float(near),
            float(any(h[5] and not h[4] for h in hits)),
        ]


def _context(low: bytes, start: int, end: int) -> tuple[bool, bool]:
    """Whether the hit is quoted: between quotation marks on its line, or on a line that begins with >; and whether its
    window holds an exclamation mark."""
    a = max(low.rfind(b"\n", max(0, start - REACH), start) + 1, start - REACH, 0)
    b = low.find(b"\n", end, end + REACH)
    before, after = low[a:start], low[end : b if b >= 0 else end + REACH]
    window = b" ".join(before.split()[-WINDOW:]) + b" " + b" ".join(after.split()[:WINDOW])
    quoted = before.lstrip().startswith(b">") or (before.count(b'"') % 2 == 1 and b'"' in after)
    for opening, closing in _MARKS:
        quoted = quoted or (before.rfind(opening) > before.rfind(closing) and closing in after)
    return quoted, b"!" in window


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    weights: np.ndarray = field(default_factory=lambda: np.array(PRIOR))

    def score(self, features) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.asarray(features, float).reshape(-1, len(PRIOR)) @ self.weights)))


def fit(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a Gaussian prior round PRIOR."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-features @ w))
        gradient = features.T @ (weights * (p - labels)) + PRIOR_STRENGTH * (w - prior)
        curve = (features * (weights * p * (1 - p))[:, None]).T @ features + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def choose(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """The terms among (term, is a stem, toxic documents, clean documents) that are taken in.

    Of nested ones with about as many documents the longest, a word before a stem; what begins with a stem that is in is
    in already.
    """
    chosen: dict[tuple[str, bool], int] = {}
    out = []
    by_prefix: dict[str, int] = {}
    for term, stem, a, b in sorted(counts, key=lambda r: (-r[2], r[1], -len(r[0]), r[0])):
        if any((term[:k], True) in chosen for k in STEMS if k <= len(term)):
            continue
        if stem and by_prefix.get(term, 0) >= 0.9 * a:
            continue
        chosen[term, stem] = a
        for k in STEMS:
            if k < len(term) or (k == len(term) and not stem):
                by_prefix[term[:k]] = max(by_prefix.get(term[:k], 0), a)
        rate = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
        out.append((term, stem, float(np.clip(np.log(rate[0] / rate[1]) / np.log(FULL_RATIO), 0, 1))))
        if len(out) == TERMS:
            break
    return out


def _bare(low: bytes) -> bytes:
    """Blanks for quotation marks, so many that places stay."""
    for mark in {m for pair in _MARKS for m in pair}:
        if mark in low:
            low = low.replace(mark, b" " * len(mark))
    return low


def _words(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in _WORD.findall(_bare(text.encode("utf-8", "replace").lower()))]


def _with_sketch(batches):
    """sketch: the least hash of a text's runs of three words. Near copies mostly share it, other texts hardly ever do."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            w = _words(text)
            out.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["label", "text", "sketch"])


def _counted(batches):
    """How many of the texts of each class hold each word and stem, in clean ones outside quotations; a task sends sums, a
    row a term."""
    for batch in batches:
        found: dict[tuple[str, bool], list[int]] = {}
        for label, text in zip(batch.column("label").to_pylist(), chain.from_iterable(batch.column("text").slice(k, 256).to_pylist() for k in range(0, batch.num_rows, 256))):
            different = set(_words(text if label else _MENTION.sub(" ", text)))
            stems = {w[:k] for w in different for k in STEMS if len(w) > k}
            for term in chain(((w, False) for w in different), ((w, True) for w in stems)):
                found.setdefault(term, [0, 0])[label] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found]), pa.array([s for _, s in found]), pa.array([n[1] for n in found.values()], pa.int64()), pa.array([n[0] for n in found.values()], pa.int64())], ["term", "stem", "a", "b"])


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", label: str = "toxic") -> tuple[DataFrame, int, int]:
    """text, label (0 or 1) and weight of a bounded sample of the labelled rows, and how many of each class there are.

    Documents are drawn by a hash of their ids, at a rate for each class. A document with several labels has the highest.
    The drawn ids are few (the bounds above), so they are broadcast and no text is shuffled.
    """
    mine = labels.where(usable & F.col(label).isNotNull() & F.col(id_column).isNotNull())
    mine = mine.groupBy(F.col(id_column).alias("s_id")).agg((F.max(label) > 0).cast("int").alias("s_label"))
    sizes = {r["s_label"]: r["n"] for r in mine.groupBy("s_label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    rates = {1: min(1.0, TOXIC_ROWS / max(toxic, 1)), 0: min(1.0, CLEAN_ROWS / max(clean, 1))}
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "s_id"), 32) / F.lit(2.0**32)
    rate = F.when(F.col("s_label") == 1, rates[1]).otherwise(rates[0])
    drawn = mine.where(chance < rate).withColumn("s_weight", 1 / rate)
    rows = docs.select(F.col(id_column).alias("s_id"), F.col("text").alias("s_text")).join(F.broadcast(drawn), "s_id")
    return rows.select(F.col("s_text").alias("text"), F.col("s_label").alias("label"), F.col("s_weight").alias("weight")), toxic, clean


def learn_terms(rows: DataFrame) -> list[tuple[str, bool, float]]:
    """The lexicon's terms from a sample (text, label).

    Spark counts words and stems; the driver gets those that stand the tests. Terms that many documents share can hide
    the rarer ones, so the toxic documents in which none is found are looked at again, until that gives no more.
    """
    single = rows.where("text is not null").select("label", "text").mapInArrow(_with_sketch, "label int, text string, sketch long")
    single = stored(single.groupBy("sketch", "label").agg(F.min("text").alias("text")).select("label", "text"), "toxic-sample")
    terms: list[tuple[str, bool, float]] = []
    left = single
    for _ in range(ROUNDS):
        new = [t for t in _learn_round(left) if t[:2] not in {k[:2] for k in terms}][: TERMS - len(terms)]
        if not new:
            break
        terms += new
        shared = rows.sparkSession.sparkContext.broadcast(Model(Lexicon(terms)))
        left = single.select("label", "text").mapInArrow(_scan(shared, 2), f"label int, text string, score double, spans {_SPANS}, features array<double>")
        left = left.where("label = 0 or not exists(spans, s -> s.edits = 0)").select("label", "text")
    discard(single)
    return terms


def _learn_round(rows: DataFrame) -> list[tuple[str, bool, float]]:
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    counts = rows.mapInArrow(_counted, "term string, stem boolean, a long, b long").groupBy("term", "stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = stored(counts.where(F.col("a") >= LEAST_DOCUMENTS), "toxic-terms")
    candidates = max(1, counts.count())
    # the logarithm of how unlikely it is that a term falls into toxic documents so often by chance alone (a bound of
    # the binomial tail by relative entropy)
    n, base = F.col("a") + F.col("b"), toxic / (toxic + clean)
    part = F.col("a") / n
    entropy = part * F.log(part / base) + F.when(F.col("b") > 0, (1 - part) * F.log((1 - part) / (1 - base))).otherwise(0.0)
    fine = (n * entropy >= float(np.log(candidates / CHANCE))) & ((F.col("a") + 0.5) / (toxic + 1) >= LEAST_RATIO * (F.col("b") + 0.5) / (clean + 1))
    first = counts.where(fine).orderBy(F.desc("a"), "stem", F.desc(F.char_length("term")), "term").limit(4 * TERMS).collect()
    discard(counts)
    return choose([(r["term"], r["stem"], r["a"], r["b"]) for r in first], toxic, clean)


_SPANS = "array<struct<word: int, term: string, found: string, edits: int, quoted: boolean>>"


def _scan(shared, keep: int):
    """Scores and hits of the column text; the first `keep` columns go along."""

    def run(batches):
        model = shared.value
        scanner = Scanner(model.lexicon)
        kind = pa.list_(pa.struct([("word", pa.int32()), ("term", pa.string()), ("found", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            spans, features = [], []
            for a, b in zip(offsets, offsets[1:]):
                hits = scanner.hits(data[a:b].tobytes())
                features.append(scanner.features(hits))
                spans.append([{"word": h[0], "term": model.lexicon.terms[h[1]][0], "found": h[3], "edits": h[2], "quoted": h[4]} for h in hits])
            names = batch.schema.names[:keep]
            columns = [pa.array(model.score(features)), pa.array(spans, kind), pa.array(features, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *columns], [*names, "score", "spans", "features"])

    return run


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the labelled rows where `usable`, a condition on `labels`, holds.

    The lexicon is learned first; then a second look at the same sample tells which misspellings are ordinary words and
    which terms have too many of these, and the score is fitted. Without rows of either class there are no terms, and every text scores as a text without hits.
    """
    rows, toxic, clean = sample(docs, labels, usable, id_column, label)
    if not toxic or not clean:
        return Model()
    model = Model(Lexicon(learn_terms(rows)))
    context = docs.sparkSession.sparkContext

    def look(found: str):
        return rows.select("label", "weight", "text").mapInArrow(_scan(context.broadcast(model), 2), f"label int, weight double, score double, spans {_SPANS}, features array<double>").selectExpr("label", "weight", found)

    near = look("explode(array_distinct(transform(filter(spans, s -> s.edits > 0), s -> struct(s.term, s.found)))) as s")
    near = near.where("label = 0").groupBy("s.term", "s.found").count().collect()  # of the bounded sample
    model.lexicon.ordinary = frozenset(r["found"] for r in near)
    model.lexicon.strict = frozenset(r["term"] for r in near if r["count"] <= SELDOM)
    seen = look("features").toArrow()
    features = np.array(seen.column("features").to_pylist(), float).reshape(-1, len(PRIOR))
    weight = seen.column("weight").to_numpy()
    if len(features):
        model.weights = fit(features, seen.column("label").to_numpy().astype(float), weight / max(weight.mean(), 1e-9))
    return model


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """id, score, predicted (1 from a score of 0.5 on) and spans for each row of docs.

    spans: the hits, with the word's number from 0, the term, the word found, its edits, and whether it is quoted. Null,
    empty and blank texts have no hits; they score as every text without hits. Repeated rows get equal results, an empty
    table none; columns but the id and text play no part, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms and forms of a bounded sample
    rows = docs.select(F.col(id_column).alias("id"), F.col("text").alias("text"))
    out = rows.mapInArrow(_scan(shared, 1), f"id {dict(docs.dtypes)[id_column]}, score double, spans {_SPANS}, features array<double>")
    return out.select(F.col("id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves remainder 0 when divided by 5; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
