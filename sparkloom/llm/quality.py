"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are grown here, on a bounded sample of labelled documents' statistics; each tree's
nodes are laid out in arrays, and documents go down all trees together, a level at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import labelled

#: Symbols whose share of the bytes is a statistic of its own.
MARKS = b"!?|.,;:#$%&*<>{}[]()=/\\_-+@\"'~^`"
NAMES = (
    "log_bytes", "log_words", "log_lines", "word_mean", "word_spread", "upper", "digits", "spaces", "other_bytes", "marks", "entropy", "distinct_words", "top_word", "distinct_pairs",
    "capital_words", "letter_words", "short_words", "long_words", "line_mean", "repeated_lines", *(f"mark_{chr(m)}" for m in MARKS),
)


def statistics(text: str) -> np.ndarray:
    """One number for each of NAMES; of an empty text zeros."""
    out = np.zeros(len(NAMES))
    data = text.encode()
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1)
    of = Counter(words)
    seen = share[share > 0]
    marks = share[list(MARKS)]
    out[:20] = (
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), share[65:91].sum(), share[48:58].sum(), share[[9, 10, 13, 32]].sum(), share[128:].sum(), marks.sum(),
        -(seen * np.log(seen)).sum(), len(of) / n, max(of.values(), default=0) / n, len(set(zip(words, words[1:]))) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, (lengths <= 2).mean(), (lengths > 12).mean(), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
    )
    out[20:] = marks
    return out


@dataclass
class Trees:
    """All trees' nodes in a row. A leaf is its own child, with a threshold that all pass."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of x."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, least: int = 20, ridge: float = 2.0) -> Trees:
    """Boosted trees on logistic loss. Without rows the score is 0.5; with one label, near that label's share."""
    n, features = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)]).astype(np.int64) if n else np.zeros((features, 0), np.int64)
    nodes: list[list[float]] = []  # feature, threshold, low, high, value
    roots, margin = [], np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level, where = [len(nodes) - 1], np.zeros(n, np.int64)  # each row's node, by its place in level; -1: in a leaf
        for d in range(depth + 1):
            inside = where >= 0
            k = len(level)
            sums = [np.bincount(where[inside], w[inside], k) for w in (g, h)]
            for i, node in enumerate(level):
                nodes[node][4] = rate * sums[0][i] / (sums[1][i] + ridge)
                nodes[node][2] = nodes[node][3] = node
            if d == depth:
                margin += np.where(inside, np.array([nodes[m][4] for m in level])[np.maximum(where, 0)], 0)
                break
            best = [(1e-6, 0, 0)] * k
            for f in range(features):
                if not len(edges[f]):
                    continue
                cell = where[inside] * bins + binned[f][inside]
                gs, hs, ns = (np.bincount(cell, w, k * bins).reshape(k, bins).cumsum(axis=1) for w in (g[inside], h[inside], np.ones(inside.sum())))
                G, H, N = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                gain[(ns < least) | (N - ns < least)] = -1
                cut = gain[:, : len(edges[f])].argmax(axis=1)
                for i in range(k):
                    if gain[i, cut[i]] > best[i][0]:
                        best[i] = (gain[i, cut[i]], f, int(cut[i]))
            below, moved, leaf = [], np.full(n, -1), np.zeros(k, bool)
            for i, node in enumerate(level):
                gain, f, cut = best[i]
                if gain <= 1e-6:
                    leaf[i] = True
                    continue
                nodes[node][:4] = [f, edges[f][cut], len(nodes), len(nodes) + 1]
                nodes += [[0, np.inf, len(nodes), len(nodes), 0.0], [0, np.inf, len(nodes) + 1, len(nodes) + 1, 0.0]]
                own = where == i
                moved[own] = len(below) + (binned[f][own] > cut)
                below += [len(nodes) - 2, len(nodes) - 1]
            done = inside & leaf[np.maximum(where, 0)]
            margin += np.where(done, np.array([nodes[m][4] for m in level])[np.maximum(where, 0)], 0)
            where, level = moved, below
            if not level:
                break
    table = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    links = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(np.array(roots or [0]), links[:, 0], table[:, 1], links[:, 1], links[:, 2], table[:, 4], base, depth)


def with_statistics(docs: DataFrame, text: str, label: str | None = None) -> DataFrame:
    """statistics (array<double>) and label of each row."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"statistics": [statistics(t) for t in batch["text"].array], "label": batch["label"]})

    return docs.select(F.col(text).alias("text"), F.col(label).alias("label")).mapInPandas(measured, "statistics array<double>, label int")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, rows: int = labelled.SAMPLE_ROWS) -> Trees:
    """Trees grown on at most ``rows`` labelled documents outside the held-out fold; only their statistics come to the driver."""
    known = with_statistics(labelled.sample(docs, labels, label, folds, held_out, rows), "text", "label").toPandas()
    x = np.array(known["statistics"].tolist(), dtype=float).reshape(-1, len(NAMES))
    y = known["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums don't depend on which task was first
    return grow(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score column: the probability of label 1 of its whole text; null and empty texts are scored by zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts.array])))

    return docs.withColumn(into, scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))
