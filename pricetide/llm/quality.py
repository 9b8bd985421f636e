"""Text quality by a generalised additive model with pairwise interactions: lookup tables learned by cyclic boosting."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import held_out, labelled_sample, stored

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digits", "stops", "bangs", "bars", "symbols", "spaces", "non_ascii",
    "distinct", "repeats", "line_words", "distinct_lines",
]
# Most labelled rows a model is fitted on.
FIT_ROWS = 20_000

_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "stops": b".,;:?'\"", "bangs": b"!", "bars": b"|", "symbols": b"#$%&*@^~<>=+_\\/{}[]`",
            "spaces": b" \t\n\r\x0b\x0c", "non_ascii": range(128, 256)}


def class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        table[list(members)] = i + 1
    return table


def features(text: str, table: np.ndarray) -> list[float]:
    """What the model sees of a whole text; an empty one is all zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(table[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 1)[1:] / len(data)
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    repeats = sum(map(str.__eq__, words, itertools.islice(words, 1, None)))
    return [
        np.log1p(len(text)), np.log1p(n), len(text) / n, *shares, len(set(words)) / n, repeats / n, n / len(lines), len(set(lines)) / len(lines),
    ]


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, one column per feature) of every row; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = class_table()
        for pdf in batches:
            made = pd.DataFrame([features(t, table) for t in pdf.text], columns=FEATURES, dtype=float, index=pdf.index)
            yield pd.concat([pdf[["doc_id"]], made], axis=1)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, " + ", ".join(f"{f} double" for f in FEATURES))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]  # what each bin adds
    pairs: list[tuple[int, int, np.ndarray]]  # features and what each pair of their coarse bins adds

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.bias)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h, ridge=1.0):
    return g * g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of consecutive bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, rate: float = 0.2) -> np.ndarray:
    """What a tree over the bins of one feature, of so many leaves at most, adds to each bin."""
    cells = [(0, len(g))]
    while len(cells) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(cells)]
        gain, at, k = max(cuts)
        if gain <= 1e-9:
            break
        a, b = cells[k]
        cells[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in cells:
        out[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, rate: float = 0.2) -> tuple[float, np.ndarray]:
    """Gain of, and what is added by, the best cut of two features' bins into four corners."""
    cum = lambda m: m.cumsum(0).cumsum(1)
    cg, ch = cum(g), cum(h)
    tg, th = cg[-1, -1], ch[-1, -1]
    a = [(cg[:-1, :-1], ch[:-1, :-1])]
    a.append((cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]))
    a.append((cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]))
    a.append((tg - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1], th - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]))
    out = np.zeros_like(g)
    if not a[0][0].size:
        return 0.0, out
    gains = sum(_gain(x, y) for x, y in a) - _gain(tg, th)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = [rate * x[i, j] / (y[i, j] + 1) for x, y in a]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, most_bins: int = 32, pairs: int = 4, pair_rounds: int = 15) -> Model:
    """A model from features and labels; from no rows one that gives 0.5 to everything."""
    p = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, most_bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    model = Model(bias, edges, [np.zeros(len(e) + 1) for e in edges], [])
    if not len(x):
        return model
    bins = model.bins(x)
    total = np.full(len(x), bias)

    def slopes():
        q = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for i, b in enumerate(bins):
            g, h = slopes()
            step = shallow_tree(np.bincount(b, g, len(edges[i]) + 1), np.bincount(b, h, len(edges[i]) + 1))
            model.tables[i] += step
            total += step[b]

    def grid(values, i, j):
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        return np.bincount(bins[i] * shape[1] + bins[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-pair_tree(grid(g, i, j), grid(h, i, j))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for _, i, j in ranked[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = pair_tree(grid(g, i, j), grid(h, i, j))[1]
            table += step
            total += step[bins[i], bins[j]]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    The model is fitted on at most `limit` labelled rows outside the held-out fold, chosen by a hash of the id: their
    features, not their texts, reach the driver. Without labels every score is 0.5. Null texts count as empty; null
    ids stay and are not held out; repeated rows are scored each.
    """
    made = stored(document_features(docs))
    sample = labelled_sample(made, labels, "quality", limit).select(*FEATURES, "label").toPandas()
    model = fit(sample[FEATURES].to_numpy(float), sample["label"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": model.score(pdf[FEATURES].to_numpy(float))})

    rows = made.withColumn("doc_id", F.col("doc_id").cast("string"))
    scored = rows.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
