"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into at most ``BINS`` bins.  Shallow trees on one feature at a time are boosted in turn over all
features, each with a small step, so that no feature takes what another explains as well; the trees of a feature add up to one
lookup table over its bins.  Then the pairs of features with the largest gain on what is left get tables over pairs of bins in the
same way.  A score is the logistic function of the sum of the looked-up values.

The model is fitted on a bounded sample of labelled rows (see ``labelled.SAMPLE``); every text is scored as a whole.  Null texts
count as empty and get the score of an empty text.  With labels of one class only, every score is 0 or 1; without labels 0.5.
Labels, ids, language and source are no features; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.labelled import held_out, training_sample

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "other_ascii", "beyond_ascii", "space", "line_breaks", "entropy", "exclaim", "bars",
    "marks", "stops", "distinct_words", "repeats", "most_frequent", "long_words", "line_repeats", "ends_in_sign",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, STEP, RIDGE = 120, 40, 0.15, 1.0
THRESHOLD = 0.5

_classes = np.zeros((256, 10))
for _b in range(256):
    _c = chr(_b)
    _classes[_b] = [
        _b in range(65, 91), _b in range(48, 58), 33 <= _b <= 126 and not _c.isalnum(), _b >= 128, _b in (9, 10, 11, 12, 13, 32), _b == 10,
        _c == "!", _c == "|", _c in "#$%&*@^~<>{}[]\\=+_", _c in ".,;:?",
    ]


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    text = text if isinstance(text, str) else ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(raw, minlength=256)
    upper, digit, other, beyond, space, breaks, exclaim, bars, marks, stops = (counts @ _classes / n).tolist()
    share = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n), math.log1p(len(words)), n / m, upper, digit, other, beyond, space, breaks, float(-(share * np.log2(share)).sum()), exclaim, bars,
        marks, stops, len(tally) / m, sum(map(operator.eq, words, words[1:])) / m, max(tally.values(), default=0) / m,
        sum(len(w) > 20 for w in tally) / m, 1 - len(set(lines)) / max(1, len(lines)), sum(not w[-1].isalnum() and not w[0].isalpha() for w in tally) / m,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin of pairs
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]).astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for a, b, table in self.pairs:
            total += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values over the bins of a tree of that depth that fits gradient and curvature sums ``g`` and ``h`` best."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate((shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)))
    return np.full(len(g), -g.sum() / (h.sum() + RIDGE))


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either feature of a pair: its gain and values."""
    total = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sum_g, sum_h = total(g), total(h)
    best, at = -1.0, (1, 1)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            value = 0.0
            for r, s in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))):
                value += float(_gain(_box(sum_g, r, s), _box(sum_h, r, s)))
            if value > best:
                best, at = value, (a, b)
    out = np.zeros_like(g)
    a, b = at
    for r, s in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))):
        out[r, s] = -g[r, s].sum() / (h[r, s].sum() + RIDGE)
    return best, out


def _box(sums: np.ndarray, rows: slice, columns: slice) -> float:
    top, bottom = rows.start, rows.stop or sums.shape[0] - 1
    first, last = columns.start, columns.stop or sums.shape[1] - 1
    return sums[bottom, last] - sums[top, last] - sums[bottom, first] + sums[top, first]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Cyclic boosting of one-feature trees, then of pairs."""
    weight = weight * len(weight) / weight.sum()
    rate = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(rate / (1 - rate))))
    bins = model.bins(x)
    margin = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = (np.bincount(bins[:, k], weights=s, minlength=len(table)) for s in slopes())
            step = STEP * shallow_tree(g, h)
            table += step
            margin += step[bins[:, k]]
    model.coarse = [(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1)).astype(np.int64) for e in edges]
    coarse = [c[bins[:, k]] for k, c in enumerate(model.coarse)]

    def grid(a: int, b: int) -> list[np.ndarray]:
        place = coarse[a] * PAIR_BINS + coarse[b]
        return [np.bincount(place, weights=s, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for s in slopes()]

    usable = [k for k, e in enumerate(edges) if len(e) > 0]
    gains = sorted(((-quadrants(*grid(a, b))[0], a, b) for i, a in enumerate(usable) for b in usable[i + 1 :]))[:PAIRS]
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in gains]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = STEP * quadrants(*grid(a, b))[1]
            table += step
            margin += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or one score for all texts where the labels have fewer than two classes."""
    sample = training_sample(labels, "quality")
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("id")  # bounded sample
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": [features(t) for t in batch["text"]], "label": batch["label"], "weight": batch["weight"]})

    rows = learned.mapInPandas(measure, "id long, x array<double>, label int, weight double").collect()  # of the sample
    if len({r["label"] for r in rows}) < 2:
        return float(rows[0]["label"]) if rows else 0.5
    rows.sort(key=lambda r: (r["id"], r["x"]))  # the same sums on every run
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learned from ``labels`` (doc_id, quality) outside the held-out fold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if isinstance(model.value, float) or not len(batch):
                value = np.full(len(batch), model.value if isinstance(model.value, float) else 0.5)
            else:
                value = model.value.score(np.array([features(t) for t in batch["text"]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": value}).astype({"doc_id": "Int64"})

    scored = texts.mapInPandas(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
