"""Toxicity: a lexicon learnt from labels, misspellings by Levenshtein automata over its trie, and context around each hit."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import materialize

MAX_TRAINING_ROWS = 20_000
MAX_TERMS = 3_000
THRESHOLD = 0.7
LEAST_TOXIC = 3
LEAST_WEIGHT = 1.5
LEAST_TERM_WEIGHT = 0.05
#: Lengths of the beginnings of words that may be terms.
STEMS = (4, 5, 6)
#: A term has to explain about so many toxic documents that no other term explains.
PENALTY = 0.5
WINDOW = 6
#: Share of a hit's weight that is left when its context quotes it.
QUOTED = 0.1
MOST_WEIGHT = 60.0
_SMOOTH = 0.5
_MEMO = 400_000

_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‹‘", "\"”“»›’"
# Words of reporting and of direct address, by hand.
_REPORTS = frozenset("said says quote quoted quotes called wrote cited reported term word sagte zitat zitiert wort schrieb dit cite citation mot écrit dijo cita palabra escribió".split())
_ADDRESS = frozenset("you your you're u du dich dein deine ihr euch tu toi te ton vous tú ti tu usted vosotros".split())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").casefold())


def edits_allowed(term: str) -> int:
    """Misspellings that still point at a term: none for short terms, one, or two for long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Levenshtein automata of all terms, run together over the trie of the lexicon.

    A state is a set of (trie node, edits used). Reading a letter follows the
    matching child, or spends an edit on another child (substitution), on the
    letter itself (insertion) or on a skipped child (deletion). Sets are made
    when first met and remembered, so that a word costs one look-up per letter
    and most words leave the automaton after a few. Words are read whole.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for letter in term:
                step = self.children[node].get(letter)
                if step is None:
                    step = len(self.children)
                    self.children[node][letter] = step
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = step
                self.most[node] = max(self.most[node], allowed)
            self.term[node] = term
        self._forget()

    def _forget(self) -> None:
        self.start = self._closed({0: 0})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple[str, int] | None] = {}

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With every node that skipped letters reach, each at its fewest edits."""
        queue = list(nodes.items())
        while queue:
            node, used = queue.pop()
            if nodes[node] < used:
                continue
            for child in self.children[node].values():
                if used + 1 <= self.most[child] and nodes.get(child, 99) > used + 1:
                    nodes[child] = used + 1
                    queue.append((child, used + 1))
        return frozenset(nodes.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        nodes: dict[int, int] = {}
        for node, used in state:
            if used + 1 <= self.most[node] and nodes.get(node, 99) > used + 1:
                nodes[node] = used + 1
            for other, child in self.children[node].items():
                cost = used + (other != letter)
                if cost <= self.most[child] and nodes.get(child, 99) > cost:
                    nodes[child] = cost
        return self._closed(nodes)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """Term with the fewest edits to ``word`` within its allowance, the first by code point of several."""
        state = self.start
        for letter in word:
            key = (state, letter)
            after = self.steps.get(key)
            if after is None:
                if len(self.steps) >= _MEMO:
                    self._forget()
                after = self.steps[key] = self._step(state, letter)
            state = after
            if not state:
                return None
        if state not in self.ends:
            fits = [(used, self.term[node]) for node, used in state if self.term[node] is not None and used <= edits_allowed(self.term[node])]
            self.ends[state] = min(fits)[::-1] if fits else None
        return self.ends[state]


def units_of(word: str) -> list[str]:
    """What may be a term: the word, and its beginnings, written with a star."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


@dataclass
class ToxicityModel:
    """Weights of terms (words and stems) and of the misspellings of words, and the logistic layer over their sums.

    ``stemmed`` are toxic words that count by a stem; their misspellings are read like those of words that are terms.
    """

    terms: dict[str, float]
    fuzzy: dict[str, float] = field(default_factory=dict)
    layer: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -4.0]))
    stemmed: frozenset[str] = frozenset()
    _lexicon: FuzzyLexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lexicon": None}

    @property
    def lexicon(self) -> FuzzyLexicon:
        if self._lexicon is None:
            self._lexicon = FuzzyLexicon(sorted(self.words))
        return self._lexicon

    @property
    def words(self) -> set[str]:
        """Words with misspellings."""
        return {t for t in self.terms if not t.endswith("*")} | self.stemmed

    def weight(self, word: str) -> float:
        """Weight of a word that is a term, or of its heaviest stem."""
        return self.terms.get(word) or max(self.terms.get(u, 0.0) for u in units_of(word))

    def hits(self, word: str) -> list[tuple[str, int, float]]:
        """(term, edits, weight) of each term that a word meets, or of the one it may be a misspelling of."""
        known = [(u, 0, self.terms[u]) for u in units_of(word) if u in self.terms]
        if known:
            return known
        near = self.misspelling(word)
        if near is None or self.fuzzy.get(near[0], 0.0) <= 0:
            return []
        share = self.fuzzy[near[0]] / self.weight(near[0]) / near[1]
        return [(u, near[1], share * self.terms[u]) for u in units_of(near[0]) if u in self.terms]

    def misspelling(self, word: str) -> tuple[str, int] | None:
        """Nearest term of a word that is neither a term nor begins with one."""
        return None if any(u in self.terms for u in units_of(word)) else self.lexicon.nearest(word)

    def measure(self, text: str | None) -> list[float]:
        """Weight of the terms met, plainly, misspelt or quoted, number of hits, share of words hit, and a constant."""
        body = (text or "").casefold()
        tokens = list(_WORD.finditer(body))
        names = [m.group() for m in tokens]
        found = {name: self.hits(name) for name in set(names)}
        best: dict[str, float] = {}
        hits = 0
        for i, name in enumerate(names):
            if not found[name]:
                continue
            hits += 1
            quoted = _is_quoted(body, tokens, names, i)
            for term, _, weight in found[name]:
                best[term] = max(best.get(term, 0.0), weight * (QUOTED if quoted else 1.0))
        return [min(sum(best.values()), MOST_WEIGHT), float(np.log1p(hits)), hits / max(len(names), 1), 1.0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        values = np.array([self.measure(t) for t in texts]).reshape(len(texts), 4)
        return 1.0 / (1.0 + np.exp(-np.clip(values @ self.layer, -40, 40)))


def _is_quoted(body: str, tokens: list[re.Match], names: list[str], i: int) -> bool:
    """Quotation marks close around the hit, or a reporting word near it with no direct address."""
    first, last = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
    left = body[tokens[first].start():tokens[i].start()]
    right = body[tokens[i].end():tokens[last - 1].end() + 1]
    opened = max((left.rfind(mark) for mark in _OPEN), default=-1)
    if opened >= 0 and left.count('"') % 2 == (left[opened] == '"') and any(mark in right for mark in _CLOSE):
        return True
    around = names[first:i] + names[i + 1:last]
    return any(w in _REPORTS for w in around) and not any(w in _ADDRESS for w in around)


def held_out(doc_id: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls on the fold that no label is learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sparse_weights(docs: np.ndarray, terms: np.ndarray, size: int, labels: np.ndarray, penalty: float = PENALTY, rounds: int = 2000) -> np.ndarray:
    """Weights of a logistic model with an L1 penalty and no negative weight, by accelerated proximal steps until they settle.

    ``docs`` and ``terms`` are the places of the ones of the matrix. Terms that
    only accompany others in toxic documents explain nothing more and get 0.
    """
    weight, ahead, bias, momentum = np.zeros(size), np.zeros(size), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))), 1.0
    most = np.bincount(docs, minlength=len(labels)).max(initial=1) + 1
    rate = 4.0 / (most * max(np.bincount(terms, minlength=size).max(initial=1) / 8, 1.0))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(docs, ahead[terms], len(labels)) + bias, -40, 40)))
        slope = labels - p
        after = np.maximum(ahead + rate * (np.bincount(terms, slope[docs], size) - penalty), 0.0)
        bias += float(slope.sum() / max((p * (1 - p)).sum(), 1.0)) * 0.5
        follow = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = after + (momentum - 1) / follow * (after - weight)
        settled = np.abs(after - weight).max(initial=0.0) < 1e-5
        weight, momentum = after, follow
        if settled:
            break
    return weight


def _fit_layer(values: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; weights of the hits do not go below zero."""
    layer = np.zeros(values.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(values @ layer, -40, 40)))
        slope = values.T @ (labels - p) - ridge * layer
        curve = (values * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ values + ridge * np.eye(values.shape[1])
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        layer = layer + step
        layer[:3] = np.maximum(layer[:3], 0.0)  # weight, hits, share
        if np.abs(step).max() < 1e-6:
            break
    return layer


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text",
          learn_from: Column | None = None, max_rows: int = MAX_TRAINING_ROWS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled rows, those with the smallest hash of the id.

    Candidate terms are the words and stems of toxic documents with the most
    telling log odds, at most ``max_terms``; a sparse logistic model keeps
    those that explain labels. Of a kept stem, all words of the sample that
    begin with it and are toxic by their log odds have misspellings too, with
    the stem's weight. The weight of a term's misspellings comes from
    the words of the sample that the automata map to it, so that a term with
    ordinary words for neighbours gives them nothing. Without toxic rows
    nothing is toxic. Null labels are no labels; the largest of several counts.
    Of several rows with one id the smallest text is learnt from.
    """
    chosen = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col("id").isNotNull())
    if learn_from is not None:
        chosen = chosen.filter(learn_from)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # max_rows ids and labels of 16 bytes each: the side that is broadcast has a fixed bound.
    labelled = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    sample = materialize(labelled.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "toxic_sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y > 0].update({unit for word in set(words_of(text)) for unit in units_of(word)})
            units = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch([pa.array(units, pa.string()), *[pa.array([counts[y][u] for u in units], pa.int64()) for y in (1, 0)]],
                                  names=["unit", "toxic", "other"])

    total = sample.agg(F.coalesce(F.sum(F.col("label")), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    totals = (int(total.toxic), int(total.n - total.toxic))
    if not totals[0]:
        return ToxicityModel({})
    units = materialize(sample.mapInArrow(cut, "unit string, toxic long, other long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxic_units")
    odds = F.log((F.col("toxic") + _SMOOTH) / (totals[0] + 2 * _SMOOTH)) - F.log((F.col("other") + _SMOOTH) / (totals[1] + 2 * _SMOOTH))
    candidates = units.filter(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).filter(
        F.col("odds") >= LEAST_WEIGHT).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "unit").limit(max_terms).collect()
    place = {r.unit: k for k, r in enumerate(candidates)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({place[u] for word in set(words_of(t)) for u in units_of(word) if u in place}) for t in texts])

    rows = sample.select("label", hits("text").alias("hits")).toPandas()
    spans = rows["hits"].map(len).to_numpy()
    weights = _sparse_weights(np.repeat(np.arange(len(rows)), spans), np.concatenate([*rows["hits"], []]).astype(int), len(candidates),
                              rows["label"].to_numpy(dtype=float))
    # The penalty shrinks what it keeps; a kept term counts with its own log odds.
    model = ToxicityModel({unit.unit: float(unit.odds) for unit, w in zip(candidates, weights) if w > LEAST_TERM_WEIGHT})
    stems = [t for t in model.terms if t.endswith("*")]
    if stems:
        begins = [F.concat(F.substring("unit", 1, n), F.lit("*")).isin([t for t in stems if len(t) == n + 1]) for n in STEMS]
        model.stemmed = frozenset(r.unit for r in units.filter(~F.col("unit").endswith("*")).filter(reduce(or_, begins)).withColumn(
            "odds", odds).filter(F.col("odds") >= LEAST_WEIGHT).select("unit").collect()) - model.terms.keys()

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(found[0], t, o) for word, t, o in zip(*[batch.column(c).to_pylist() for c in range(3)])
                    if not word.endswith("*") and (found := model.misspelling(word))]
            yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                  names=["term", "toxic", "other"])

    near = units.mapInArrow(misspelt, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    seen = {r.term: (r.toxic, r.other) for r in near.collect()}
    for term in sorted(model.words):
        weight = model.weight(term)
        toxic, other = seen.get(term, (0, 0))
        # Two made-up documents say that a misspelling has 0.6 of the term's weight; neighbours met in the sample outvote them.
        prior = 1.0 / (1.0 + np.exp(-0.6 * weight))
        mass = 2.0 / (totals[1] + 1)
        model.fuzzy[term] = min(weight, float(np.log(
            (toxic / (totals[0] + 1) + mass * prior) / (other / (totals[1] + 1) + mass * (1 - prior)))))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([model.measure(t) for t in texts])

    rows = sample.select("label", measured("text").alias("values")).toPandas()
    model.layer = _fit_layer(np.array(rows["values"].tolist(), dtype=float).reshape(len(rows), 4), rows["label"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic in column ``name``, replacing one of that name. Null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.withColumn(name, scored(F.col(text)))
