"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins, and a few pairs of
features have tables over coarser bins.  The tables are learned by cyclic
boosting: features take turns, and each turn adds a small step of a shallow
tree over the bins of one feature.  Pairs are then boosted on what is left.  A
score is a sum of table entries through the logistic curve, added up for whole
batches at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .toxicity import training_sample

#: Labelled documents of each label from which the model is learned, at most.
SAMPLE = 4_000
#: Bins of a feature, bins of a feature in a pair, pairs, turns of each feature and pair, and the step.
BINS, COARSE, PAIRS, TURNS, RATE = 32, 6, 6, 150, 0.12
#: Documents on each side of a split, at least, and the penalty on leaf values.
LEAF, RIDGE = 5, 1.0

FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "letters", "wide", "pipes", "bangs", "commas", "stops", "line_words", "dup_lines", "distinct", "stutter", "pairs", "longest", "plain_words")

_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_WIDE = bytes(range(128, 256))
_SYMBOLS = b"#*$%&|<>@^~=+{}[]\\_"


def features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all are 0 for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    solid = len(raw) - sum(raw.count(bytes([c])) for c in _SPACES)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / solid
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    upper, lower, wide = share(_UPPER), share(_LOWER), share(_WIDE)
    return [
        math.log1p(n), min(solid / n, 60.0), share(_SYMBOLS), upper, share(_DIGITS), lower, wide,
        raw.count(b"|") / n, (raw.count(b"!") + raw.count(b"?")) / n, raw.count(b",") / n, raw.count(b".") / n,
        min(n / len(lines), 1000.0), 1 - len(set(lines)) / len(lines), len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1),  # noqa: B905
        min(max(map(len, words)), 200), sum(map(bytes.isalpha, words)) / n,
    ]


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over ordered bins, from sums of gradients, Hessians and rows by bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    right_g, right_h, right_n = g.sum() - left_g, h.sum() - left_h, n.sum() - left_n
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE)
    gain[(left_n < LEAF) | (right_n < LEAF)] = -1
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + RIDGE):
        return out
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _quad(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a pair's table into four."""
    G, H, N = (x.cumsum(0).cumsum(1) for x in (g, h, n))
    best, table = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            corners = []
            for X in (G, H, N):
                a, b, c, d = X[i - 1, j - 1], X[i - 1, -1], X[-1, j - 1], X[-1, -1]
                corners.append(np.array([[a, b - a], [c - a, d - b - c + a]]))
            cg, ch, cn = corners
            if (cn < LEAF).all():
                continue
            gain = float((cg**2 / (ch + RIDGE)).sum() - G[-1, -1] ** 2 / (H[-1, -1] + RIDGE))
            if gain > best + 1e-12:
                values = np.where(cn >= LEAF, cg / (ch + RIDGE), 0.0)
                best, table = gain, values[np.ix_((np.arange(g.shape[0]) >= i).astype(int), (np.arange(g.shape[1]) >= j).astype(int))]
    return best, table


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of labels y (0 or 1) on rows of features; the same rows give the same model."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m = AdditiveModel(base=math.log(rate / (1 - rate)))
    m.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    m.coarse = [_cuts(x[:, j], COARSE) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.cuts)]
    total = np.full(len(y), m.base)
    sums = lambda at, size, g, h: (np.bincount(at, w, size) for w in (g, h, np.ones(len(y))))
    for _ in range(TURNS):
        for j, table in enumerate(m.tables):
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            step = RATE * _tree(*sums(binned[j], len(table), y - p, p * (1 - p)))
            table += step
            total += step[binned[j]]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.coarse)]
    p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
            cell = rough[a] * shape[1] + rough[b]
            ranked.append((_quad(*(s.reshape(shape) for s in sums(cell, shape[0] * shape[1], y - p, p * (1 - p))))[0], -a, -b, shape, cell))
    ranked.sort(key=lambda r: r[:3], reverse=True)
    chosen = [(-a, -b, np.zeros(shape), cell) for _, a, b, shape, cell in ranked[:PAIRS]]
    for _ in range(TURNS // 5):
        for _, _, table, cell in chosen:
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            step = RATE * _quad(*(s.reshape(table.shape) for s in sums(cell, table.size, y - p, p * (1 - p))))[1]
            table += step
            total += step.ravel()[cell]
    m.pairs = [(a, b, table) for a, b, table, _ in chosen]
    return m


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2) -> AdditiveModel | None:
    """The model from at most SAMPLE labelled documents of each label, None unless both labels occur.

    Rows whose crc32(doc_id) has remainder `out` are held out; null and other
    labels are passed over.
    """
    sample = durable(training_sample(docs, labels, "quality", modulus, out, SAMPLE))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [features(t) for t in pdf["text"]]})

    rows = sample.mapInPandas(measured, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r[2] for r in rows], float), y)


def quality(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """`docs` with a column `quality_score` from 0 to 1 (one of that name is replaced).

    Null and empty texts have all features 0 and are scored like others;
    without a model every score is 0.5.  Repeated rows are scored alike; an
    empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([features(t) for t in texts], float)))

    return docs.withColumn("quality_score", scored(F.col("text").cast("string")))
