"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Words are compared by the gap-weighted subsequence kernel: two words share
every three-letter subsequence of up to SPAN letters, weighted by DECAY for
each letter spanned, so gapped letters, other endings and inserted characters
keep most of the value; accents are taken off first. Texts are sets of words:
one part of a text's features is its best word's value at each landmark, the
other the sum of all words' values by the text's size, which tells a stem that
keeps coming back from one that is there once. Powers of the kernel (BEST,
EACH), which are kernels too, sharpen both.

Landmarks are words and beginnings of words that mark toxic sample texts, chosen
one after the other by how many texts they mark that earlier ones don't, so
that rarer ways and languages of insult have theirs, and ordinary words. The
landmarks' own kernel matrices whiten the values (Nystroem), and a
squared-hinge SVM separates them; a sigmoid, fitted on margins of models that
haven't seen the text, turns its margin into a score.

The SVM is fitted on at most SAMPLE labelled texts of each class. Word counts for
the choice of landmarks are Spark aggregations; what reaches the driver is POOL
candidates, and a row of bits and one of kernel values for each sample text.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship

SAMPLE = 3_000
TOXIC_WORDS, PLAIN_WORDS, POOL = 96, 32, 2_000
COVER, LEAST_RATIO = 3, 8.0
BEST, EACH = 4, 8
SPAN, DECAY = 5, 0.7
WIDTH = 24  # longer tokens are read in windows of this many bytes, half overlapping
CACHE = 300_000

_DROP = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b) in " \t\n\r\x0b\x0c"))
_CODES = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 5 if b >= 128 else 0 for b in range(256)], np.int64)
_ACCENTS = re.compile(rb"[\xcc\xcd][\x80-\xbf]")  # combining marks, in UTF-8
_SPACED = re.compile(rb"(?<!\S)(?:[a-z] ){2,}[a-z](?!\S)")


def words(text: str | None) -> set[bytes]:
    """A text's distinct words: lower-cased bytes without accents, digits and
    marks, so characters inserted into a word vanish; single letters in a row
    are one word; long tokens come as overlapping windows."""
    low = (text or "").lower()
    raw = low.encode() if low.isascii() else _ACCENTS.sub(b"", unicodedata.normalize("NFKD", low).encode("utf-8", "surrogatepass"))
    raw = raw.translate(None, _DROP)
    raw = _SPACED.sub(lambda m: m[0].replace(b" ", b""), raw)
    out = set()
    for w in set(raw.split()):
        if len(w) <= WIDTH:
            out.add(w)
        else:
            out.update(w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2))
    return out


def _subsequences(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All weighted three-letter subsequences: (word number, letters, weight)."""
    wide = np.zeros((len(batch), WIDTH + SPAN), np.uint8)
    for i, w in enumerate(batch):
        wide[i, : len(w)] = np.frombuffer(w, np.uint8)
    c = _CODES[wide]
    who, what, weight = [], [], []
    for d1 in range(1, SPAN - 1):
        for d2 in range(1, SPAN - d1):
            a, b, e = c[:, :WIDTH], c[:, d1 : d1 + WIDTH], c[:, d1 + d2 : d1 + d2 + WIDTH]
            i, j = np.nonzero((a > 0) & (b > 0) & (e > 0))
            who.append(i)
            what.append((a[i, j] * 32 + b[i, j]) * 32 + e[i, j])
            weight.append(np.full(len(i), DECAY ** (d1 + d2 + 1)))
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


class Kernel:
    """Kernel values of words against fixed landmarks, remembered by word."""

    def __init__(self, landmarks: list[bytes]):
        self.size = len(landmarks)
        table = np.zeros((32768, self.size), np.float32)
        who, what, weight = _subsequences(landmarks)
        np.add.at(table, (what, who), weight.astype(np.float32))
        norm = np.sqrt((table**2).sum(axis=0))
        self.table = table / np.where(norm > 0, norm, 1)
        self.any = self.table.any(axis=1)
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros((1024, self.size), np.float32)  # row 0: words without a common subsequence
        self.used = 1

    def learn(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 2048):
            part = new[lo : lo + 2048]
            who, what, weight = _subsequences(part)
            # Words whose common subsequences are few beside all of theirs are like no landmark.
            total, shared = np.bincount(who, weight, len(part)), np.bincount(who, weight * self.any[what], len(part))
            near = np.flatnonzero(shared > 0.3 * total)
            self.rows.update(dict.fromkeys(part, 0))
            if not len(near):
                continue
            to = np.full(len(part), -1)
            to[near] = np.arange(len(near))
            mine = to[who] >= 0
            key, back = np.unique(to[who[mine]] * 32768 + what[mine], return_inverse=True)
            w = np.bincount(back, weight[mine])
            row, letters = key // 32768, key % 32768
            norm = np.sqrt(np.bincount(row, w**2, len(near)))
            hit = self.any[letters]
            row, letters, w = row[hit], letters[hit], w[hit]
            got = np.zeros((len(near), self.size), np.float32)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            if len(row):
                got[row[begin]] = np.add.reduceat(self.table[letters] * w[:, None].astype(np.float32), begin, axis=0)
            got /= norm[:, None]
            if self.used + len(near) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((max(len(self.values), len(near)), self.size), np.float32)])
            self.values[self.used : self.used + len(near)] = got
            self.rows.update((part[i], self.used + k) for k, i in enumerate(near.tolist()))
            self.used += len(near)

    def texts(self, batch: list[str | None]) -> np.ndarray:
        """A row for each text: its best word's value at each landmark to the
        power of BEST, and all words' values to the power of EACH, summed, by the
        root of their number."""
        if len(self.rows) > CACHE:
            self.rows.clear()
            self.used = 1
        each = [words(t) for t in batch]
        self.learn(list(set().union(*each).difference(self.rows)) if each else [])
        out = np.zeros((len(batch), 2 * self.size), np.float32)
        for i, found in enumerate(each):
            at = [k for w in found if (k := self.rows[w])]
            if at:
                values = self.values[at]
                out[i, : self.size] = values.max(axis=0) ** BEST
                out[i, self.size :] = (values**EACH).sum(axis=0) / np.sqrt(len(found) + 20)
        return out


_KERNELS: dict[tuple[bytes, ...], Kernel] = {}


def kernel(landmarks: list[bytes]) -> Kernel:
    key = tuple(landmarks)
    if key not in _KERNELS:
        _KERNELS.clear()
        _KERNELS[key] = Kernel(landmarks)
    return _KERNELS[key]


def _candidates(text: str | None) -> set[bytes]:
    """A text's words and their beginnings of 4 to 8 bytes."""
    out = set()
    for w in words(text):
        if len(w) > 2:
            out.add(w)
            out.update(w[:k] for k in range(4, min(len(w), 9)))
    return out


def _landmarks(sample: DataFrame) -> list[bytes]:
    """The landmarks, from a table (text, y): toxic ones first. Counts are
    aggregated by word; ties go by the word."""

    def run(batches):
        for pdf in batches:
            rows = [(w, y) for t, y in zip(pdf["text"], pdf["y"], strict=True) for w in _candidates(t)]
            yield pd.DataFrame(rows, columns=["word", "y"])

    counts = save(sample.mapInPandas(run, "word binary, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")), "words")
    toxic, n = sample.filter("y = 1").count(), sample.count()
    ratio = (F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1.0))
    ranked = counts.withColumn("ratio", ratio)
    worth = F.col("toxic") * F.least(F.lit(1.0), F.col("ratio") / 100)
    pool = [bytes(r["word"]) for r in ranked.filter((F.col("toxic") >= 3) & (F.col("ratio") > LEAST_RATIO)).orderBy(worth.desc(), "word").limit(POOL).collect()]
    plain = [bytes(r["word"]) for r in ranked.filter("ratio < 1.2").orderBy(F.desc("n"), "word").limit(PLAIN_WORDS).collect()]
    if not pool:
        return []
    at = {w: i for i, w in enumerate(pool)}

    def bits(batches):
        for pdf in batches:
            held = np.zeros((len(pdf), len(pool)), bool)
            for i, t in enumerate(pdf["text"]):
                held[i, [at[w] for w in _candidates(t) if w in at]] = True
            yield pd.DataFrame({"bits": [x.tobytes() for x in np.packbits(held, axis=1)], "y": pdf["y"]})

    got = sample.mapInPandas(bits, "bits binary, y int").toPandas()
    held = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1)[:, : len(pool)].astype(np.float32)
    y = got["y"].to_numpy()
    need, clean = np.where(y == 1, float(COVER), 0.0), held[y == 0].sum(axis=0)
    marks: list[int] = []
    while len(marks) < TOXIC_WORDS:
        gain = np.minimum(need, 1) @ held - 2 * clean
        gain[marks] = -np.inf
        best = int(gain.argmax())
        if gain[best] < 2 and marks:
            break
        marks.append(best)
        need = np.maximum(need - held[:, best], 0)
    return [*(pool[k] for k in marks), *(w for w in plain if w not in at)]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 0.01) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last entry is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    s = 2.0 * y - 1
    ridge = np.eye(x.shape[1]) / c
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = s * (x @ w) < 1
        a = x[active] * weight[active, None]
        step = np.linalg.solve(a.T @ x[active] + ridge, a.T @ s[active])
        if np.allclose(step, w, atol=1e-9):
            break
        w = step
    return w


def _whitening(gram: np.ndarray) -> np.ndarray:
    """The inverse root of a kernel matrix."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
    return vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T


def _sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's fit of score = 1 / (1 + exp(-(a margin + b)))."""
    x = np.stack([np.clip(margin, -4, 4), np.ones(len(margin))], axis=1)
    t, w = np.where(y == 1, 0.99, 0.01), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (weight * (t - p)))
    return float(max(w[0], 1e-3)), float(w[1])


def chosen(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most ``sample`` labels of each class, those with the
    least hashes; so few that a join with the texts may broadcast them."""
    order = F.xxhash64("doc_id"), "doc_id"
    return labels.filter("y = 0").orderBy(*order).limit(sample).unionByName(labels.filter("y = 1").orderBy(*order).limit(sample))


def train(labelled: DataFrame, sample: int = SAMPLE, held: dict[int, int] | None = None) -> dict:
    """A model from a table (text, y): at most ``sample`` texts of each class,
    those with the least hashes. ``held``: the classes' sizes, where the table
    is a sample already. Rows without a label are left out. With one class
    alone, or none, the model gives every text the share of ones seen (none: 0)."""
    ship(labelled.sparkSession)
    rows = labelled.filter("y is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int"))
    order = F.xxhash64("text")
    parts = [rows.filter(F.col("y") == y).orderBy(order).limit(sample) for y in (0, 1)]
    held = held or {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not held.get(0) or not held.get(1):
        return {"share": 1.0 if held.get(1) else 0.0}
    taken = save(parts[0].unionByName(parts[1]).repartition(16), "sample")
    if taken.select("y").distinct().count() < 2:
        return {"share": held[1] / (held[0] + held[1])}
    marks = _landmarks(taken)
    if not marks:
        return {"share": held[1] / (held[0] + held[1])}

    def run(batches):
        for pdf in batches:
            got = kernel(marks).texts(pdf["text"].tolist())
            yield pd.DataFrame({"x": list(got.astype(np.float64)), "y": pdf["y"]})

    # In an order of their own, so that the folds below are the same in every run.
    got = taken.mapInPandas(run, "x array<double>, y int").toPandas()
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    own = kernel(marks)
    own.learn([m for m in marks if m not in own.rows])
    gram = np.array([own.values[own.rows[m]] for m in marks], np.float64)
    n = len(marks)
    white = np.zeros((2 * n, 2 * n))
    white[:n, :n], white[n:, n:] = _whitening(gram**BEST), _whitening(gram**EACH)
    z = x @ white
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = (z - mean) / scale
    weight = np.where(y == 1, held[1] / (y == 1).sum(), held[0] / (y == 0).sum())  # as frequent as they are
    weight = weight * np.where(y == 1, (held[0] / held[1]) ** 0.75, 1.0)  # and most of the way to balanced
    weight = weight / weight.mean()
    with_one = lambda v: np.concatenate([v, np.ones((len(v), 1))], axis=1)
    w, margin, fold = _svm(z, y, weight), np.zeros(len(y)), np.arange(len(y)) % 5
    for k in range(5):
        rest = fold != k
        margin[~rest] = with_one(z[~rest]) @ (_svm(z[rest], y[rest], weight[rest]) if len(np.unique(y[rest])) == 2 else w)
    a, b = _sigmoid(margin, y, weight)
    return {"marks": marks, "w": white @ (w[:-1] / scale), "bias": float(w[-1] - (mean / scale) @ w[:-1]), "a": a, "b": b}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with all columns and ``score`` (an input's is replaced),
    0 to 1: higher, the text is toxic likelier. A null or empty text scores as
    one without words, equal texts score the same; no rows, none."""
    if "share" in model:
        return documents.withColumn("score", F.lit(float(model["share"])))

    ship(documents.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        own = kernel(model["marks"])
        out = []
        for lo in range(0, len(texts), 256):
            x = own.texts(texts.iloc[lo : lo + 256].tolist()).astype(np.float64)
            out.append(1 / (1 + np.exp(-(model["a"] * np.clip(x @ model["w"] + model["bias"], -4, 4) + model["b"]))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return documents.withColumn("score", run("text"))
