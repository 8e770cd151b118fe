"""Quality: a generalised additive model with pairwise interactions.

A text becomes a few plain measures. Cyclic boosting visits one feature after
the other and adds a shallow tree on its bins to the feature's lookup table;
then the pairs of features that explain most of what is left get two-way tables
the same way. A score is a sum of table entries, one for each feature and pair,
through the logistic function.

The model is fitted on at most SAMPLE labelled rows, of which only the measures
reach the driver. Texts are measured once, in a pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship

SAMPLE = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_len", "word_len_dev", "upper", "digit", "mark", "space", "high",
    "distinct_words", "distinct_pairs", "top_word", "lines", "line_len", "marked_words", "repeat_next",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1


def measure(text: str | None) -> list[float]:
    """The FEATURES of one text; a null or empty one measures 0 throughout."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lower = raw.lower().split()
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in lower), np.int64, len(lower))
    pairs = len(np.unique(code[:-1] * (len(ids) + 1) + code[1:])) if len(code) > 1 else 1
    top = np.bincount(code).max() if len(code) else 0
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    marks = n - letters - count[48:58].sum() - count[9:14].sum() - count[32]
    last = sum(1 for w in words if not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122))
    lines = count[10] + 1
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()),
        count[65:91].sum() / n, count[48:58].sum() / n, marks / n, (count[9:14].sum() + count[32]) / n, count[128:].sum() / n,
        len(ids) / k, pairs / max(1, k - 1), top / k, float(np.log1p(lines)), n / lines, last / k,
        float((code[1:] == code[:-1]).mean()) if len(code) > 1 else 0.0,
    ]


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` without its text, with all other columns and ``x`` (an
    input's ``x`` is replaced). Repeated rows and ties measure the same."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t) for t in texts])

    ship(documents.sparkSession)
    return documents.withColumn("x", run("text")).drop("text")


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, reg: float = 5.0) -> np.ndarray:
    """A shallow tree on ordered bins: the step of each, from their summed
    gradients and curvatures."""
    out = np.full(len(g), g.sum() / (h.sum() + reg))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + reg) + (g.sum() - gl) ** 2 / (h.sum() - hl + reg)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + reg) + 1e-9:
            out[:cut], out[cut:] = _tree(g[:cut], h[:cut], depth - 1, reg), _tree(g[cut:], h[cut:], depth - 1, reg)
    return out


def _grid(g: np.ndarray, h: np.ndarray, reg: float = 5.0) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis of a two-way table, and its gain."""
    best, table = -np.inf, np.zeros(g.shape)
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quarters = []
            for s in (gs, hs):
                a, b, c, d = s[i, j], s[i, -1], s[-1, j], s[-1, -1]
                quarters.append(np.array([a, b - a, c - a, d - b - c + a]))
            gain = (quarters[0] ** 2 / (quarters[1] + reg)).sum()
            if gain > best:
                v = quarters[0] / (quarters[1] + reg)
                best = gain
                table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = v
    return table, best


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model's lookup tables, from measures and 0/1 labels."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    model: dict = {"base": base, "edges": [], "tables": [], "pairs": []}
    if len(y) < 2 or y.min() == y.max():
        return model
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, bins in enumerate(at):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins, g, len(tables[f])), np.bincount(bins, h, len(tables[f])), 2)
            tables[f] += step
            logit += step[bins]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    g, h = slopes()

    def summed(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_grid(summed(i, j, g), summed(i, j, h))[1], i, j) for i in range(len(cells)) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in chosen:
            g, h = slopes()
            step = RATE * _grid(summed(i, j, g), summed(i, j, h))[0]
            table += step
            logit += step[cells[i], cells[j]]
    return model | {"edges": edges, "tables": tables, "pairs": [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen]}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores: table entries added up by bin."""
    logit = np.full(len(x), model["base"])
    for f, (edges, table) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        logit += table[np.searchsorted(edges, x[:, f], side="right")]
    for i, j, a, b, table in model["pairs"]:
        logit += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from a table (doc_id, x, y): at most ``sample`` labelled rows,
    those with the least hashes. Rows without a label are left out; with one
    class alone or no rows every text gets the share of ones (none: 0.5)."""
    chosen = rows.filter("y is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("x", F.col("y").cast("double"))
    # Written first: collected at once, every task would send the driver a sample of its own.
    taken = save(chosen, "sample").toPandas()
    x = np.stack(taken["x"].to_numpy()) if len(taken) else np.zeros((0, len(FEATURES)))
    return fit(x, taken["y"].to_numpy(np.float64))


def score(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with all columns and ``score`` (an input's is replaced) from
    its measures ``x``."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    ship(rows.sparkSession)
    return rows.withColumn("score", run("x"))


def score_texts(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with all columns and ``score`` (an input's is replaced),
    measured and scored in one pass over the texts."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.array([measure(t) for t in texts])) if len(texts) else np.zeros(0))

    ship(documents.sparkSession)
    return documents.withColumn("score", run("text"))
