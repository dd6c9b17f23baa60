"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, feature by feature, then pair by pair; each
tree adds to the lookup table of its feature or pair, so that the model is a
set of tables over bins and a score is a sum of looked-up values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("log_chars", "log_words", "mean_word", "long_word", "upper", "upper_words", "digits", "marks", "symbols", "symbol_ends",
            "bangs", "pipes", "line_length", "distinct_words", "repeated_words", "top_word", "distinct_pairs", "repeated_lines")

_UPPER, _DIGIT, _BANG, _PIPE = range(65, 91), range(48, 58), b"!", b"|"
_MARKS, _SYMBOLS = b".,;:?'\"()-", b"#$%&*@^~_=+<>{}[]\\`"
_ENDS = frozenset(_SYMBOLS + b"!|")


def _class_matrix() -> np.ndarray:
    table = np.zeros((256, 7))
    for column, group in enumerate((_UPPER, _DIGIT, _MARKS, _SYMBOLS, _BANG, _PIPE, b"\n")):
        table[list(group), column] = 1.0
    return table


_CLASSES = _class_matrix()


def measure(text: str | None) -> list[float]:
    """Feature values of one whole text, in the order of FEATURES; all zero without any word."""
    body = (text or "").encode("utf-8", "replace")
    words = body.split()
    if not words:
        return [0.0] * len(FEATURES)
    upper, digits, marks, symbols, bangs, pipes, breaks = np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _CLASSES
    n, size = len(words), len(body)
    counts = Counter(words)
    lengths = list(map(len, words))
    lines = [line for line in body.split(b"\n") if line.strip()]
    return [
        np.log1p(size), np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)), upper / size, sum(map(bytes.isupper, words)) / n,
        digits / size, marks / n, symbols / n, sum(w[-1] in _ENDS for w in words) / n, bangs / n, pipes / n,
        np.log1p(size / (breaks + 1)), len(counts) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values()) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1), 1 - len(set(lines)) / len(lines)]


def measure_all(texts: Iterable[str | None]) -> np.ndarray:
    rows = [measure(t) for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins into two leaves."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    if not len(gain):
        return 0.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf value per bin of a tree over ordered bins with at most 2 ** depth leaves."""
    gain, cut = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of a tree over a grid: one cut of the first axis, then one of the second on either side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + ridge)))
    for cut in range(1, g.shape[0]):
        total, out = 0.0, np.empty(g.shape)
        for side in (slice(None, cut), slice(cut, None)):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            leaves = _tree(gs, hs, ridge, 1)
            total += float((leaves * gs).sum())
            out[side] = leaves
        if total > best[0]:
            best = (total, out)
    return best


@dataclass(frozen=True)
class PairwiseGam:
    """Intercept, bin edges per feature, one table per feature and one grid per chosen pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    grids: list[tuple[int, int, np.ndarray]]

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1: vectorised additions of looked-up bins."""
        total = np.full(len(values), self.intercept)
        bins = [np.searchsorted(e, values[:, j], side="right") for j, e in enumerate(self.edges)]
        for table, bin_of in zip(self.tables, bins):
            total += table[bin_of]
        for i, j, grid in self.grids:
            total += grid[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1.0 / (1.0 + np.exp(-total))


def fit_gam(values: np.ndarray, labels: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60,
            rate: float = 0.15, ridge: float = 2.0, cells: int = 8) -> PairwiseGam:
    """Cyclic boosting on the logistic loss; without rows or with one class the model is its intercept."""
    y = np.asarray(labels, dtype=float)
    intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    width = values.shape[1]
    inner = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(values[:, j], inner)) if len(y) else np.array([]) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(t)) * min(cells, len(t)) // len(t) for t in tables]
    if len(np.unique(y)) < 2:
        return PairwiseGam(intercept, edges, tables, coarse, [])
    placed = [np.searchsorted(e, values[:, j], side="right") for j, e in enumerate(edges)]
    margin = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _tree(np.bincount(placed[j], g, size), np.bincount(placed[j], h, size), ridge)
            tables[j] += step
            margin += step[placed[j]]

    cell = [c[p] for c, p in zip(coarse, placed)]
    shape = [int(c[-1]) + 1 for c in coarse]

    def grid_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        flat, size = cell[i] * shape[j] + cell[j], shape[i] * shape[j]
        return np.bincount(flat, g, size).reshape(shape[i], shape[j]), np.bincount(flat, h, size).reshape(shape[i], shape[j])

    ranked = sorted(((_pair_tree(*grid_sums(i, j), ridge)[0], i, j) for i in range(width) for j in range(i + 1, width)
                     if shape[i] > 1 and shape[j] > 1), reverse=True)[:pairs]
    grids = {(i, j): np.zeros((shape[i], shape[j])) for _, i, j in ranked}
    for _ in range(pair_rounds):
        for (i, j), grid in grids.items():
            step = rate * _pair_tree(*grid_sums(i, j), ridge)[1]
            grid += step
            margin += step[cell[i], cell[j]]
    return PairwiseGam(intercept, edges, tables, coarse, [(i, j, grid) for (i, j), grid in grids.items()])


def held_out(doc_id: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls on the fold that no label is learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _measured(texts: pd.Series) -> pd.Series:
    return pd.Series([measure(t) for t in texts])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text",
          learn_from: Column | None = None, max_rows: int = MAX_TRAINING_ROWS) -> PairwiseGam:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hash of the id.

    Only their features reach the driver: max_rows * len(FEATURES) doubles. Of
    several rows with one id the smallest text is learnt from.
    Rows without a label or text column value null are handled as no label and
    empty text; of several labels of one id the largest counts.
    """
    chosen = labels.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label")).filter(
        F.col("label").isNotNull() & F.col("id").isNotNull())
    if learn_from is not None:
        chosen = chosen.filter(learn_from)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # max_rows ids and labels of 16 bytes each: the side that is broadcast has a fixed bound.
    single = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    found = single.select(F.xxhash64("id").alias("order"), "label", _measured("text").alias("values"))
    sample = found.toPandas().sort_values("order", kind="stable")
    values = np.array(sample["values"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    return fit_gam(values, sample["label"].to_numpy())


def score(docs: DataFrame, model: PairwiseGam, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text in column ``name``."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(measure_all(texts)))

    return docs.withColumn(name, scored(F.col(text)))


def accepted(docs: DataFrame, model: PairwiseGam, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns alone."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return score(docs.select(kept, F.col(text).alias("text")), model).filter(F.col("score") >= threshold).select("row.*")
