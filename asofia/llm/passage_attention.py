"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Every passage is
encoded: statistics of its words and a signed hashed projection of them go
through a learned layer. Gated attention weights, learned from document labels
alone, combine the passages into one representation, which is scored.

Training takes a bounded sample of labelled texts; scoring is one map over all
documents and reads every passage.

Defined cases: a null or empty text is one passage without words and gets the
score of that; texts of any length are read whole; repeated rows get equal
scores; without labels of both classes every score is the share of label 1 (0.5
without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from asofia.llm import base, units

PASSAGE = 64            # words
SAMPLE = 3_000          # labelled texts of each class
THRESHOLD = 0.3
PROJECTION = 16
STATS = 9               # word statistics; passage-level ones follow
HIDDEN, GATE = 24, 12
STEPS, BATCH, RATE = 900, 64, 0.01
MOST_WORDS = 400_000    # distinct words that a worker keeps
SYMBOL = re.compile(rb"[^A-Za-z0-9\x80-\xff.,;:!?'\"()-]")


class Words:
    """Statistics and projection of every distinct word that a worker has met."""

    def __init__(self) -> None:
        self.number = units.Numbering()
        self.table = np.zeros((1 << 14, STATS + PROJECTION), np.float32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.fresh:
            first = len(self.number) - len(self.number.fresh)
            if len(self.number) > len(self.table):
                self.table = np.resize(self.table, (2 * len(self.number), self.table.shape[1]))
            self.table[first:len(self.number)] = [self.describe(w) for w in self.number.fresh]
            self.number.fresh = []
        return at

    @staticmethod
    def describe(w: bytes) -> list[float]:
        n = len(w)
        symbols = len(SYMBOL.findall(w))
        letters = sum(c.isalpha() for c in w.decode("utf-8", "replace"))
        upper = sum(65 <= b <= 90 for b in w)
        bits = xxhash.xxh3_64_intdigest(w.strip(b".,;:!?").lower())
        return [min(n, 40) / 10, float(symbols > 0), min(symbols, 8) / n, float(w == b"|"), float(b"!!" in w), float(upper > 1 and upper >= letters - 1),
                float(any(48 <= b <= 57 for b in w)), float(w[-1:] in (b".", b",", b";", b":", b"!", b"?")), float(n <= 3)] \
            + [1.0 if bits >> k & 1 else -1.0 for k in range(PROJECTION)]


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text)."""
    known = units.once(Words)
    if len(known.number) > MOST_WORDS:
        known.__init__()
    words, counts = [], []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").split()
        counts.append(len(own))
        words += own
    n = np.array(counts, np.int64)
    bags = np.maximum(1, (n + PASSAGE - 1) // PASSAGE)
    if not len(n):
        return np.zeros((0, STATS + PROJECTION + 3), np.float32), bags
    at = known.look_up(words)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.cumsum(bags) - bags, n) + inside // PASSAGE     # passage of each word
    total = int(bags.sum())
    size = np.bincount(row, minlength=total)
    out = np.zeros((total, STATS + PROJECTION + 3), np.float32)
    full = size > 0
    if len(at):
        starts = (np.cumsum(size) - size)[full]
        out[full, :-3] = np.add.reduceat(known.table[at], starts, axis=0) / size[full, None]
        distinct = np.bincount(np.unique(row * (1 << 22) + at) >> 22, minlength=total) if len(known.number) < 1 << 22 else size
        pairs = np.unique(row[1:][row[1:] == row[:-1]] * (1 << 44) + at[1:][row[1:] == row[:-1]] * (1 << 22) + at[:-1][row[1:] == row[:-1]]) if total < 1 << 18 and len(known.number) < 1 << 22 else None
        out[full, -3] = 1 - distinct[full] / size[full]                  # repeated words
        if pairs is not None:
            out[full, -2] = 1 - (np.bincount(pairs >> 44, minlength=total)[full] + 1) / size[full]   # repeated pairs
    out[:, -1] = size / PASSAGE
    return out, bags


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and scorer; parameters in a dict."""

    def __init__(self, width: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(width, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": g(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def forward(self, x: np.ndarray, bags: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        starts = np.cumsum(bags) - bags
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags))
        a = e / np.repeat(np.add.reduceat(e, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])

    def gradient(self, x, bags, y, weight):
        p = self.p
        h, t, s, a, z, out = self.forward(x, bags)
        starts = np.cumsum(bags) - bags
        do = weight * (out - y)
        dz = np.repeat(do[:, None] * p["c"], bags, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), bags))
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True)}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if not len(bags):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return self.forward((x - self.mean) / self.scale, bags)[-1]


def fit(texts: list, labels: list, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on mini-batches of bags, classes in equal shares; the number of steps does not depend on the sample."""
    y = np.array(labels, float)
    x, bags = passages(texts)
    m = Model(x.shape[1], seed)
    if not len(y) or y.min() == y.max():
        m.constant = float(y[0]) if len(y) else 0.5
        return m
    x = x.astype(float)
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - m.mean) / m.scale
    rng = np.random.default_rng(seed)
    first = np.cumsum(bags) - bags
    classes = [np.flatnonzero(y == k) for k in (0, 1)]
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        n = bags[pick]
        rows = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grad = m.gradient(x[rows], n, y[pick], np.full(len(pick), 1 / len(pick)))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grad.items():
            a, b = mom[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            m.p[k] = (1 - 0.05 * rate) * m.p[k] - rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    sample = base.training_sample(docs, labels, "quality", per_class)
    return base.fit_in_task(sample, lambda rows: fit([r["text"] for r in rows], [r["y"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "score": model.score(*passages(part.column("text").to_pylist()))}

    return base.map_rows(base.dealt(docs.select("doc_id", "text")), make, "doc_id long, score double")


def op1_passage_attention(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, base.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", base.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
