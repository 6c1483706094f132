"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Each feature of a text falls into one of at most 256 bins. Training boosts shallow trees cyclically, one feature
after another on the current residuals; as a tree on one feature only adds to a step function, what it learns is
kept as a lookup table by bin, and by pair of coarse bins for the interactions that help most. A score is then a
sum of table entries, added for all rows of a batch at once.

Labels are joined to the documents by Spark. Training reads a bounded sample of the labelled rows
(``max_train_rows``, those with the smallest keyed hashes of their ids): a matrix of that many rows by some twenty
numbers. Everything else, features and scores, runs over every whole text in parallel.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.tables import bound_batches

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "exclaim", "symbol", "bar", "digit", "stops", "commas", "non_ascii",
    "distinct", "same_next", "top_word", "line_words", "same_lines", "odd_words", "title_words", "bigrams", "entropy",
)
UPPER, SYMBOLS, DIGITS = (bytes(x) for x in (range(65, 91), b"#$%&*+<=>@\\^_`{|}~", range(48, 58)))
ASCII = bytes(range(128))


def features_of(text: str | None) -> list[float]:
    """The features of one whole text; null counts as empty. All are shares or logs, so no length dominates."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = raw.split(b"\n")
    upper = size - len(raw.translate(None, UPPER)) if raw else 0
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    used = letters[letters > 0]
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 15).mean()),
        upper / size,
        raw.count(b"!") / n,
        (size - len(raw.translate(None, SYMBOLS))) / n,
        raw.count(b"|") / n,
        (size - len(raw.translate(None, DIGITS))) / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        (size - len(raw.translate(None, bytes(range(128, 256))))) / size,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        counts.most_common(1)[0][1] / n,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        float((lengths == 1).mean()),
        sum(map(bytes.istitle, words)) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        float(-(used * np.log(used)).sum()),
    ]


def features(text: Column) -> Column:
    """An array of doubles for each text, in the order of ``FEATURES``."""

    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(t) for t in texts])

    return found(text)


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``score`` adds table entries for whole arrays."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _stump_steps(grad: np.ndarray, hess: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """A shallow tree on one ordered feature, as a step for each bin; grad, hess: sums by bin."""
    step, parts = np.zeros(len(grad)), [(0, len(grad))]
    for _ in range(splits):
        best = (1e-9, None, 0)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
            left, right = g[:-1] ** 2 / (h[:-1] + ridge), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
            gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, lo + at + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    for lo, hi in parts:
        step[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + ridge)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.12, bins: int = 64, n_pairs: int = 6, splits: int = 3, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting of logistic loss: main effects first, then tables for the pairs that lower the loss most.

    Without rows, or with one label only, the model is a constant.
    """
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    edges, coarse = [_edges(x[:, j], bins) if n else np.zeros(0) for j in range(d)], [_edges(x[:, j], 8) if n else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not n or y.min() == y.max():
        return AdditiveModel(base, edges, tables, coarse, [])
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    total = np.full(n, base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            step = rate * _stump_steps(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), splits, ridge)
            tables[j] += step
            total += step[at[j]]
    cell = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = len(coarse[j]) + 1
        key, size = cell[i] * wide + cell[j], (len(coarse[i]) + 1) * wide
        return key, np.bincount(key, y - p, size), np.bincount(key, p * (1 - p), size)

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((float((g * g / (h + ridge)).sum()), i, j) for i, j in combinations(range(d), 2) for _, g, h in [sums(i, j, p)]), reverse=True)
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:n_pairs]]
    for _ in range(rounds // 4):
        for i, j, table in pairs:
            key, g, h = sums(i, j, 1 / (1 + np.exp(-total)))
            step = rate * g / (h + ridge)
            table += step.reshape(table.shape)
            total += step[key]
    return AdditiveModel(base, edges, tables, coarse, pairs)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 20_000, **options) -> AdditiveModel:
    """Fit on at most ``max_train_rows`` labelled rows that are not held out; null labels and ids are ignored.

    An id labelled twice must agree with itself: with different labels it is left out.
    """
    bound_batches(docs.sparkSession)
    once = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id"))
    once = once.agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__most")).where("__y = __most")
    once = once.orderBy(F.xxhash64("__id"), "__id").limit(max_train_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(once.select("__id", "__y"), "__id").select("__y", features(F.col("__text")).alias("__x"), F.xxhash64("__id").alias("__o"))
    sample = rows.orderBy("__o").limit(max_train_rows).toPandas().sort_values("__o", kind="stable")
    x = np.array(sample["__x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["__y"].to_numpy(dtype=np.float64), **options)


def score(text: Column, model: AdditiveModel) -> Column:
    """The model's probability that a text is of quality 1; empty and null texts get one too."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([features_of(t) for t in texts])))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (1 if score >= 0.5, else 0).

    Labels, language, source and id are no inputs of a score; other columns are not read. Texts of any length are read
    whole, in batches bounded by bytes. Repeated rows give a row each. Without usable labels every score is the same. An empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col), score(F.col(text_col), model).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more; all columns stay."""
    model = train(docs, labels, id_col, text_col, **options)
    return docs.where(score(F.col(text_col), model) >= least)
