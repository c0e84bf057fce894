"""Toxicity by a bidirectional gated recurrent network over words and characters.

A text is read in overlapping windows of words. The input of a word joins word
features (a smoothed log-odds of its hash, a hashed projection) and character
features (log-odds and projection of its character trigrams), so that variants
of a word that was never seen are close to it. Two GRUs read the window in both
directions, attention pools their states, and the pooled state is scored. A
document's score is calibrated on its highest window and the number of windows.

Labels are of documents: training starts from each document's window with the
highest log-odds and then takes those that the network itself ranks highest,
against the highest and a random window of clean documents. All is numpy, on a
bounded sample; scoring is one map over all documents and all windows. Inputs of
the gates are computed once for each distinct word.

Defined cases: a null or empty text is one window without words; texts of any
length are read whole; repeated rows get equal scores; without labels of both
classes every score is the share of label 1 (0 without labels); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from asofia.llm import base, units

WINDOW, STRIDE = 24, 12
SAMPLE = 2_000          # labelled texts of each class
THRESHOLD = 0.5
CLEAN_WEIGHT = 2.0      # of a clean text in the calibration: the sample holds fewer of them than a corpus
WORD_BITS, TRIGRAM_BITS = 16, 14
PROJECTION = 6
WIDTH = 4 + 2 * PROJECTION
HIDDEN = 8
ROUNDS, EPOCHS, BATCH, RATE = 2, 4, 128, 0.01
MOST_WORDS = 150_000    # distinct words that a worker keeps
EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_"


def word_of(token: str) -> str:
    return token.lower().strip(EDGE)


def hashes(word: str) -> tuple[int, list[int]]:
    """Bucket of the word and of its trigrams."""
    marked = f"^{word}$"
    return (xxhash.xxh3_64_intdigest(word) & ((1 << WORD_BITS) - 1),
            [xxhash.xxh3_64_intdigest(marked[k:k + 3], seed=1) & ((1 << TRIGRAM_BITS) - 1) for k in range(max(1, len(marked) - 2))])


def log_odds(found: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-odds of a bucket between the classes by number of texts, drawn to 0 where few texts have it."""
    a, b = found[1], found[0]
    lo = np.log((a + 0.5) / (texts[1] + 1)) - np.log((b + 0.5) / (texts[0] + 1))
    return lo * np.minimum(1, (a + b) / 12)


class Lexicon:
    """Counts of texts with each word and trigram bucket, by class."""

    def __init__(self) -> None:
        self.words = np.zeros((2, 1 << WORD_BITS))
        self.trigrams = np.zeros((2, 1 << TRIGRAM_BITS))
        self.texts = np.zeros(2)

    def add(self, words: list[int], trigrams: list[int], y: int) -> None:
        self.words[y, words] += 1
        self.trigrams[y, trigrams] += 1
        self.texts[y] += 1

    def minus(self, other: "Lexicon") -> "Lexicon":
        out = Lexicon()
        out.words, out.trigrams, out.texts = self.words - other.words, self.trigrams - other.trigrams, self.texts - other.texts
        return out

    def settle(self) -> "Odds":
        return Odds(log_odds(self.words, self.texts).astype(np.float32), log_odds(self.trigrams, self.texts).astype(np.float32))


class Odds:
    def __init__(self, words: np.ndarray, trigrams: np.ndarray) -> None:
        self.words, self.trigrams = words, trigrams

    def features(self, words: list[str]) -> np.ndarray:
        """Input of each word; the empty word has zeros."""
        if len(words) > 8_192:   # keeps what is held for a call small
            return np.concatenate([self.features(words[k:k + 8_192]) for k in range(0, len(words), 8_192)])
        x = np.zeros((len(words), WIDTH), np.float32)
        if not words:
            return x
        found = [hashes(w) for w in words]
        own = np.fromiter((f[0] for f in found), np.int64, len(found))
        sizes = np.fromiter((len(f[1]) for f in found), np.int64, len(found))
        tri = np.fromiter((t for f in found for t in f[1]), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        odds = self.trigrams[tri]
        x[:, 0], x[:, 1], x[:, 2] = self.words[own], np.maximum.reduceat(odds, starts), np.add.reduceat(odds, starts) / sizes
        x[:, 3] = np.minimum(sizes, 20) / 10
        spread = lambda h, k: np.where((h * 0x9E3779B1 >> (5 + k)) & 1, 0.3, -0.3)
        for k in range(PROJECTION):
            x[:, 4 + k] = spread(own, k)
            x[:, 4 + PROJECTION + k] = np.add.reduceat(spread(tri, k), starts) / sizes
        x[np.fromiter((not w for w in words), bool, len(words))] = 0
        return x


# ---- network ---------------------------------------------------------------

# sigmoid(x) = 0.5 + 0.5 tanh(x / 2): the halving of the first two gates goes into their weights
HALF = np.array([0.5] * (2 * HIDDEN) + [1.0] * HIDDEN, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start(seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    g = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
    p = {}
    for d in "fb":
        p |= {f"W{d}": g(WIDTH, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"R{d}": g(HIDDEN, 2 * HIDDEN), f"N{d}": g(HIDDEN, HIDDEN)}
    return p | {"v": g(2 * HIDDEN), "o": g(2 * HIDDEN), "k": np.full(1, -1.0, np.float32)}


def read(gates: np.ndarray, mask: np.ndarray, R: np.ndarray, N: np.ndarray, order, keep: bool = False):
    """States of one direction. gates (windows, steps, 3H); a masked step leaves the state as it is."""
    n, steps, _ = gates.shape
    H = HIDDEN
    h = np.zeros((n, H), np.float32)
    states = np.empty((n, steps, H), np.float32)
    trail = []
    for t in order:
        x, m = gates[:, t], mask[:, t, None]
        ru = _sigmoid(x[:, :2 * H] + h @ R)
        r, u = ru[:, :H], ru[:, H:]
        q = h @ N
        c = np.tanh(x[:, 2 * H:] + r * q)
        new = h + m * (1 - u) * (c - h)
        if keep:
            trail.append((h, r, u, q, c))
        h = new
        states[:, t] = h
    return states, trail


def pooled(p: dict, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
    steps = range(mask.shape[1])
    sf, tf = read(gf, mask, p["Rf"], p["Nf"], steps, keep)
    sb, tb = read(gb, mask, p["Rb"], p["Nb"], reversed(steps), keep)
    s = np.concatenate([sf, sb], 2)
    e = np.where(mask > 0, s @ p["v"], -30)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    z = (a[:, :, None] * s).sum(1)
    return z @ p["o"] + p["k"][0], (s, a, z, tf, tb)


def gradient(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    gates = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    logit, (s, a, z, tf, tb) = pooled(p, gates["f"], gates["b"], mask, True)
    H, steps = HIDDEN, mask.shape[1]
    do = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    dz = do[:, None] * p["o"]
    da = (s * dz[:, None]).sum(2)
    de = a * (da - (a * da).sum(1, keepdims=True)) * (mask > 0)
    ds = a[:, :, None] * dz[:, None] + de[:, :, None] * p["v"]
    out = {"o": z.T @ do, "k": do.sum(keepdims=True), "v": np.einsum("nth,nt->h", s, de)}
    for d, trail, order in (("f", tf, list(range(steps))), ("b", tb, list(reversed(range(steps))))):
        dstate = ds[:, :, :H] if d == "f" else ds[:, :, H:]
        dg = np.zeros_like(gates[d])
        dR, dN = np.zeros_like(p[f"R{d}"]), np.zeros_like(p[f"N{d}"])
        dh = np.zeros((len(y), H), np.float32)
        for t, (h, r, u, q, c) in zip(reversed(order), reversed(trail)):
            dh = dh + dstate[:, t]
            m = mask[:, t, None]
            dc = dh * m * (1 - u) * (1 - c * c)
            du = -dh * m * (c - h) * u * (1 - u)
            dr = dc * q * r * (1 - r)
            dru = np.concatenate([dr, du], 1)
            dg[:, t] = np.concatenate([dru, dc], 1)
            dR += h.T @ dru
            dN += h.T @ (dc * r)
            dh = dh * (1 - m * (1 - u)) + dru @ p[f"R{d}"].T + (dc * r) @ p[f"N{d}"].T
        flat = dg.reshape(-1, 3 * H)
        out |= {f"W{d}": x.reshape(-1, WIDTH).T @ flat, f"c{d}": flat.sum(0), f"R{d}": dR, f"N{d}": dN}
    return out


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of every window, one row each, -1 beyond the text; number of windows of each text)."""
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    inside = at[:, None] + np.arange(WINDOW)
    return np.where(inside < n[text, None], (np.cumsum(n) - n)[text, None] + inside, -1), count


class Model:
    """Parameters, and the gate inputs of the words that a worker has met."""

    def __init__(self, odds: Odds | None, p: dict | None, constant: float | None = None) -> None:
        self.odds, self.p, self.constant = odds, p, constant
        self.scale = np.array([1.0, 0.0, 0.0])
        self.key = uuid.uuid4().hex
        self.number = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "tables")} | {"number": None}

    def _tokens(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if self.number is None or len(self.number) > MOST_WORDS:
            self.number = units.Numbering()
            self.tables = [np.zeros((1 << 12, 3 * HIDDEN), np.float32) for _ in "fb"]
        tokens, counts = [], []
        for t in texts:
            own = (t or "").split()
            counts.append(len(own))
            tokens += own
        at = np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens))
        fresh, self.number.fresh = self.number.fresh, []
        if fresh:
            first = len(self.number) - len(fresh)
            x = self.odds.features([word_of(w) for w in fresh])
            for k, d in enumerate("fb"):
                if len(self.number) > len(self.tables[k]):
                    self.tables[k] = np.resize(self.tables[k], (2 * len(self.number), 3 * HIDDEN))
                self.tables[k][first:len(self.number)] = (x @ self.p[f"W{d}"] + self.p[f"c{d}"]) * HALF
        return at, np.array(counts, np.int64)

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every window, number of windows of each text). Both directions advance together;
        the scorer is linear in the pooled state, so two numbers of each state are kept."""
        at, n = self._tokens(texts)
        where, count = windows(n)
        p, H = self.p, HIDDEN
        inner = np.stack([np.concatenate([p[f"R{d}"], p[f"N{d}"]], 1) * HALF for d in "fb"])
        heads = np.stack([np.stack([p["v"][k * H:(k + 1) * H], p["o"][k * H:(k + 1) * H]], 1) for k in (0, 1)])
        out = np.empty(len(where), np.float32)
        at = at if len(at) else np.zeros(1, np.int32)
        order = np.argsort(where[:, -1] < 0, kind="stable")      # whole windows first: they need no mask
        for k in range(0, len(where), 1_024):
            part = order[k:k + 1_024]
            w = where[part]
            mask = None if (w[:, -1] >= 0).all() else (w >= 0).astype(np.float32)
            rows = at[np.maximum(w, 0)].T.copy()
            b = len(part)
            h = np.zeros((2, b, H), np.float32)
            x = np.empty((2, b, 3 * H), np.float32)
            said = np.empty((2, WINDOW, b, 2), np.float32)
            for t in range(WINDOW):
                back = WINDOW - 1 - t
                np.take(self.tables[0], rows[t], axis=0, out=x[0])
                np.take(self.tables[1], rows[back], axis=0, out=x[1])
                g = np.matmul(h, inner)
                ru = np.tanh(g[:, :, :2 * H] + x[:, :, :2 * H])
                c = np.tanh(x[:, :, 2 * H:] + (0.5 + 0.5 * ru[:, :, :H]) * g[:, :, 2 * H:])
                c -= h
                c *= 0.5 - 0.5 * ru[:, :, H:]
                if mask is not None:
                    c *= np.stack([mask[:, t], mask[:, back]])[:, :, None]
                h += c
                y = np.matmul(h, heads)
                said[0, t], said[1, back] = y[0], y[1]
            y = said[0] + said[1]
            e = y[:, :, 0] if mask is None else np.where(mask.T > 0, y[:, :, 0], -30)
            a = np.exp(e - e.max(0))
            out[part] = (a * y[:, :, 1]).sum(0) / a.sum(0) + p["k"][0]
        return out, count

    def score(self, texts: list) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        logit, count = self.logits(texts)
        top = np.maximum.reduceat(logit, np.cumsum(count) - count)
        return 1 / (1 + np.exp(-(self.scale[0] * top + self.scale[1] * np.log(count) + self.scale[2])))

    def here(self) -> "Model":
        """This model as the worker keeps it from task to task."""
        return units.once(_Kept, self.key).hold(self)


class _Kept:
    def __init__(self, key: str) -> None:
        self.model = None

    def hold(self, model: Model) -> Model:
        self.model = self.model or model
        return self.model


def fit(texts: list, labels: list, seed: int = 11) -> Model:
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words_of: dict = {}       # one object for each word
    token = [[words_of.get(w) or words_of.setdefault(w, word_of(w)) for w in (t or "").split()] for t in texts]
    half = np.arange(len(y)) % 2     # the odds that a training text sees come from the other half
    both, parts = Lexicon(), [Lexicon(), Lexicon()]
    for words, k, side in zip(token, y, half):
        found = [hashes(w) for w in set(words)]
        buckets = list({f[0] for f in found}), list({t for f in found for t in f[1]})
        both.add(*buckets, k)
        parts[side].add(*buckets, k)
    odds = [both.minus(parts[0]).settle(), both.minus(parts[1]).settle()]
    n = np.array(list(map(len, token)))
    where, count = windows(n)
    first = np.cumsum(count) - count
    flat = np.zeros((int(n.sum()) + 1, WIDTH), np.float32)
    for side in (0, 1):
        number = units.Numbering()
        own = np.array([number[w] for words, s in zip(token, half) if s == side for w in words], np.int64)
        flat[np.flatnonzero(np.repeat(half, n) == side)] = odds[side].features(number.fresh)[own]
    mask = (where >= 0).astype(np.float32)
    rank = (np.maximum(flat[:, 0], flat[:, 1])[where] * mask).max(1)      # index -1 is the row of zeros at the end
    p = start(seed)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, total = 0, ROUNDS * EPOCHS * 70
    for _ in range(ROUNDS):
        chosen = []
        for i in range(len(y)):
            own = np.arange(first[i], first[i] + count[i])
            chosen.append(own[rank[own].argmax()])
            if y[i] == 0:
                chosen.append(rng.choice(own))
        chosen = np.array(chosen)
        target = np.repeat(y, count)[chosen]
        sides = [np.flatnonzero(target == k) for k in (0, 1)]
        for _ in range(EPOCHS * 70):
            pick = chosen[np.concatenate([rng.choice(s, BATCH // 2) for s in sides])]
            step += 1
            grad = gradient(p, flat[where[pick]], mask[pick], np.repeat([0, 1], BATCH // 2))
            for k, g in grad.items():
                a, b = mom[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p[k] = (p[k] - RATE * (1 - step / (total + 1)) * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        gates = lambda w, d: flat[w] @ p[f"W{d}"] + p[f"c{d}"]
        rank = np.concatenate([pooled(p, gates(where[k:k + 4096], "f"), gates(where[k:k + 4096], "b"), mask[k:k + 4096])[0] for k in range(0, len(where), 4096)])
    m = Model(both.settle(), p)
    top = np.maximum.reduceat(rank, first)
    x = np.stack([top, np.log(count), np.ones(len(y))], 1)
    beta, weight = np.array([1.0, 0.0, 0.0]), np.where(y == 0, CLEAN_WEIGHT, 1.0)
    weight = weight / weight.sum()
    for _ in range(600):     # logistic calibration by gradient steps from the network's own scale
        beta = beta - 0.3 * (np.einsum("ij,i->j", x, weight * (1 / (1 + np.exp(-np.einsum("ij,j->i", x, beta))) - y)) / np.array([4.0, 4.0, 1.0]))
    m.scale = beta
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    sample = base.training_sample(docs, labels, "toxic", per_class)
    return base.fit_in_task(sample, lambda rows: fit([r["text"] for r in rows], [r["y"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "score": model.here().score(part.column("text").to_pylist())}

    return base.map_rows(base.dealt(docs.select("doc_id", "text")), make, "doc_id long, score double")


def keep_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic."""
    def run(batches):
        for part in base.slices(batches):
            yield part.filter(pa.array(model.here().score(part.column("text").to_pylist()) < THRESHOLD))

    return base.map_batches(base.dealt(docs), run, docs.schema)


def op3_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, base.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", base.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
