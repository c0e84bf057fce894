"""Quality rules: exact document statistics and gradient-boosted trees over them.

Statistics are computed per document in one map over the input, without a
shuffle. The trees are grown on histograms of a bounded labelled sample with
monotonic constraints, flattened into node arrays and applied to whole batches
by array indexing.

Defined cases: a null or empty text has no words and fails the base rules;
a text of any length is read whole; repeated rows are judged each on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from asofia.llm import base

SYMBOL = re.compile(r"[#*$%&|<>]")
WORD_GAP = b" \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30   # base rules
SAMPLE = 4_000                   # labelled texts of each class
MIN_QUALITY = 0.3                # the trees reject below this probability

FEATURES = ("log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
            "punct_rate", "distinct_rate", "bar_rate", "bang_rate", "odd_word_rate")
# More of these never makes a document better: symbols, repeated lines, repeated words, capitals, odd words.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, 0, 0, -1, -1, -1)


# ---- statistics ----------------------------------------------------------

def _fold(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dense number of each pair; equal numbers if and only if equal pairs."""
    return np.unique(ids.astype(np.int64) * (int(other.max()) + 1) + other, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions inside windows of `window` (a power of two) words that occur more than once."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        h ^= h >> np.uint64(29)
        step = 1
        while step < window:   # hash of 2, 4, 8 words
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():   # equal windows have equal hashes
        return 0
    exact, step = ids, 1
    while step < window:
        exact = _fold(exact[:-step], exact[step:])
        step *= 2
    again = np.bincount(exact)[exact] > 1
    edges = np.zeros(len(ids) + 1, np.int32)
    edges[:n] += again
    edges[window:window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(SYMBOL.findall(text)), 0, 0, np.zeros(len(FEATURES))
    gaps = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(text) - gaps
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen, dup_lines, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            lines += 1
        elif not line.isspace() and line:
            seen.add(line)
            lines += 1
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    flat = np.frombuffer(raw, np.uint8)
    counts = np.bincount(flat, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    punct = counts[[33, 44, 45, 46, 58, 59, 63]].sum()
    odd = sum(1 for w in number if not w.strip(b".,;:!?'\"()-").isalnum() and w.isascii())
    feats = np.array([np.log1p(n), chars / n, symbols / chars, dup_lines / lines, repeats / n, upper / max(1, upper + lower),
                      digits / chars, punct / chars, len(number) / n, counts[124] / n, counts[33] / n, odd / len(number)])
    return n, chars, symbols, dup_lines, repeats, feats


# ---- trees ---------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, rounds: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 64, ridge: float = 1.0, smallest: int = 5) -> Trees:
    """Second-order boosting of the logistic loss; classes weigh the same.

    A split of a constrained feature whose children are in the wrong order is
    not taken; its children inherit the midpoint as a bound on their values, so
    the whole ensemble is monotonic in that feature.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        side = 0.0 if len(y) == 0 else (2.0 if y[0] else -2.0)
        z = np.zeros(1, np.int64)
        return Trees(z, np.zeros(1), z, z, np.zeros(1), z[:0], 0, side)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)   # x <= cut[k] if and only if code <= k
    f = np.zeros(len(y))
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        best_value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, 0.0, me, me, rate * best_value])
        if level == depth or len(rows) < 2 * smallest:
            return me
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = code[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl ** 2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr ** 2) \
                + gs * best_value + 0.5 * (hs + ridge) * best_value ** 2
            gain[(nl < smallest) | (len(rows) - nl < smallest) | (monotone[j] * (vr - vl) < 0)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            return me
        j, k, vl, vr = best[1]
        mid, sign = (vl + vr) / 2, monotone[j]
        near = code[rows, j] <= k
        left = grow(rows[near], g, h, level + 1, mid if sign < 0 else low, mid if sign > 0 else high)
        right = grow(rows[~near], g, h, level + 1, mid if sign > 0 else low, mid if sign < 0 else high)
        nodes[me] = [j, float(cuts[j][k]), left, right, 0.0]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (p - y), weight * p * (1 - p)
        start = len(nodes)
        roots.append(grow(np.arange(len(y)), g, h, 0, -4.0, 4.0))
        at = np.full(len(y), roots[-1])
        table = np.array([[n[0], n[2], n[3]] for n in nodes[start:]]) - [0, start, start]
        cut = np.array([n[1] for n in nodes[start:]])
        at -= start
        for _ in range(depth):
            j = table[at, 0]
            at = np.where(x[np.arange(len(y)), j] <= cut[at], table[at, 1], table[at, 2])
        f += np.array([n[4] for n in nodes[start:]])[at]
    a = np.array([[n[0], n[2], n[3]] for n in nodes], np.int64)
    return Trees(a[:, 0], np.array([n[1] for n in nodes]), a[:, 1], a[:, 2], np.array([n[4] for n in nodes]), np.array(roots), depth, 0.0)


# ---- Spark ---------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Trees:
    """Trees from a sample of at most per_class texts of each label; only their statistics reach the driver."""
    sample = base.training_sample(docs, labels, "quality", per_class)

    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "y": part.column("y"), "x": [statistics(t)[5].tolist() for t in part.column("text").to_pylist()]}

    rows = base.map_rows(base.dealt(sample), make, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return fit_trees(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def verdicts(part: pa.RecordBatch, trees: Trees) -> dict:
    """Statistics and verdict of each row of a batch with a text column."""
    made = [statistics(t) for t in part.column("text").to_pylist()]
    n, chars, symbols, lines, repeats = np.array([m[:5] for m in made], np.int64).reshape(-1, 5).T
    quality = trees.score(np.array([m[5] for m in made]).reshape(len(made), -1))
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats,
            "base_failed": failed, "kept": ~failed & (quality >= MIN_QUALITY), "quality": quality}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, kept, quality."""
    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), **verdicts(part, trees)}

    return base.map_rows(base.dealt(docs.select("doc_id", "text")), make, f"doc_id long, {SCHEMA}")


def keep_rows(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    def run(batches):
        for part in base.slices(batches):
            yield part.filter(pa.array(verdicts(part, trees)["kept"]))

    return base.map_batches(base.dealt(docs), run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, base.table(spark, sf_dir, "labels")))
