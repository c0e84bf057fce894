"""Language identification by multilingual mixtures.

A language is a distribution over hashed letter n-grams, counted over every
labelled training text. A document is a mixture of languages: expectation-
maximisation estimates its proportions from the n-gram likelihoods, and the set
of languages grows while the likelihood gains more than its penalty. The
predicted language is the one with the largest proportion.

The set starts with the single likeliest language. The slope D of the log
likelihood towards another language bounds what that language can add, because
the likelihood is concave in the proportions; a language whose slope is below
the penalty is therefore left out without fitting. Otherwise the steepest one is
fitted and stays if its gain exceeds the penalty of N * ln(n) for n n-grams,
each letter being in N of them.

On Spark: one map counts n-grams for each task and language, a sum by (language,
bucket) adds them, and one map scores whole texts against a table of languages x
BUCKETS. No text is shuffled and no key grows with a language's share of rows.

Defined cases: a null text, an empty one or one without a letter is `und` with
score 0; so is every text when no labelled text was learned; ties go to the
first language by name; rows with a null lang are not learned from, rows with a
null doc_id are; repeated rows count each time; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from asofia.llm import base

N = 3
BUCKETS = 1 << 16
SMOOTH = 0.5            # added to the count of every bucket
STEPS, CLOSE = 60, 1e-3  # of expectation-maximisation
MOST_LANGUAGES = 256    # that a counting task holds before it hands its counts over
ENTRIES = 1 << 22       # n-grams times languages that are worked on at a time
UNKNOWN = "und"
MARK = 0x200000         # set on code points that belong to words but are no letters

SCORED = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point its lower-case letter or mark, 0 for what separates words."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif kind == "M":
            out[c] = c + MARK
    return out


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every letter n-gram in order, and which documents have a letter.

    Runs of other characters count as one separator; a text has one on both sides.
    """
    sizes = [len(t or "") + 1 for t in texts]
    points = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    z = _letters()[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    lettered = np.zeros(len(texts), bool)
    lettered[doc[(z > 0) & (z < MARK)]] = True
    keep = z > 0
    keep[1:] |= z[:-1] > 0   # the first separator after a word
    z, doc = np.r_[np.uint32(0), z[keep]], np.r_[np.int32(-1), doc[keep]]
    if len(z) < N:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), lettered
    count = len(z) - N + 1
    h = np.zeros(count, np.uint32)
    for k in range(N):
        h = (h ^ z[k:k + count]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    own = doc[1:1 + count] == doc[N - 1:N - 1 + count]   # only the separator before a text may be another's
    return (h[own] % np.uint32(BUCKETS)).astype(np.int32), doc[1:1 + count][own], lettered


# ---- model -----------------------------------------------------------------

class Languages(NamedTuple):
    names: list
    table: np.ndarray    # float32, BUCKETS x languages


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed over all rows of labelled (lang, text)."""
    def run(batches):
        held: dict = {}

        def rows():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
            held.clear()

        for part in base.slices(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            bucket, doc, _ = ngrams(part.column("text").to_pylist())
            names, of = np.unique(langs.astype(str), return_inverse=True)
            of = of[doc]
            for k, lang in enumerate(names.tolist()):
                if lang not in held:
                    if len(held) >= MOST_LANGUAGES:
                        yield from rows()
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(bucket[of == k], minlength=BUCKETS)
        yield from rows()

    return base.map_batches(base.dealt(labelled.select("lang", "text")), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Languages:
    """Smoothed n-gram distributions of every language of labelled (lang, text).

    The table has BUCKETS numbers for each language, whatever the number of rows.
    """
    found = count_ngrams(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())).toArrow()
    langs, of = np.unique(np.array(found.column("lang").to_pylist(), str), return_inverse=True)
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found.column("bucket").to_numpy(), of] = found.column("n").to_numpy()
    return Languages(langs.tolist(), ((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32))


# ---- inference -------------------------------------------------------------

def _sums(values, doc: np.ndarray, docs: int, width: int) -> np.ndarray:
    """Sum of `values(a, b)` (rows of `width` numbers for positions a..b) for each document, a bounded stretch at a time."""
    out = np.zeros((docs, width))
    step = max(1, ENTRIES // max(width, 1))
    for a in range(0, len(doc), step):
        own = doc[a:a + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(values(a, a + step), first, axis=0, dtype=np.float64)
    return out


def expectation_maximisation(p: np.ndarray, c: np.ndarray, doc: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and their log likelihood, from the proportions `pi`.

    p: likelihoods (entries x languages), c: how often each entry occurs, doc: its
    document, ascending. A language with proportion 0 keeps it.
    """
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.add.reduceat(c, first)[:, None]
    for _ in range(STEPS):
        q = p * pi[doc]
        new = np.add.reduceat(q * (c / q.sum(1))[:, None], first, axis=0) / n
        moved = np.abs(new - pi).max()
        pi = new
        if moved < CLOSE:
            break
    return pi, np.add.reduceat(c * np.log((p * pi[doc]).sum(1)), first)


def _grow(p: np.ndarray, c: np.ndarray, doc: np.ndarray, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Proportions over the language sets of highest penalised likelihood, found by adding one language at a time."""
    out, penalty = pi.copy(), N * np.log(np.maximum(n, 2))
    active = np.arange(len(n))
    like = None
    while len(active):
        s = (p * pi[doc]).sum(1)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        if like is None:
            like = np.add.reduceat(c * np.log(s), first)
        slope = np.add.reduceat(p * (c / s)[:, None], first, axis=0) - n[active][:, None]
        slope[pi > 0] = -np.inf
        more = slope.argmax(1)
        steep = slope[np.arange(len(active)), more] > penalty[active]
        if not steep.any():
            break
        rows = steep[doc]
        p, c, doc = p[rows], c[rows], (np.cumsum(steep) - 1)[doc[rows]]
        active, more, like, pi = active[steep], more[steep], like[steep], pi[steep] * 0.9
        pi[np.arange(len(active)), more] = 0.1
        pi, found = expectation_maximisation(p, c, doc, pi)
        better = found - like > penalty[active]
        out[active[better]] = pi[better]
        rows = better[doc]
        p, c, doc = p[rows], c[rows], (np.cumsum(better) - 1)[doc[rows]]
        active, like, pi = active[better], found[better], pi[better]
    return out


def mixtures(texts: list, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each text (rows of zeros where unknown), and which texts are known."""
    width, docs = len(model.names), len(texts)
    bucket, doc, known = ngrams(texts)
    if not width or not docs:
        return np.zeros((docs, width)), np.zeros(docs, bool)
    n = np.bincount(doc, minlength=docs)
    log = np.log(model.table)
    best = _sums(lambda a, b: log[bucket[a:b]], doc, docs, width).argmax(1)
    pi = np.zeros((docs, width))
    pi[np.arange(docs), best] = known

    def ratio(a, b):
        p = model.table[bucket[a:b]]
        return p / np.take_along_axis(p, best[doc[a:b]][:, None], 1)

    slope = _sums(ratio, doc, docs, width) - n[:, None]
    slope[np.arange(docs), best] = -np.inf
    mixed = np.flatnonzero(known & (slope.max(1) > N * np.log(np.maximum(n, 2))))
    if len(mixed):
        place = np.full(docs, -1)
        place[mixed] = np.arange(len(mixed))
        own = place[doc] >= 0
        entry, c = np.unique(place[doc[own]] * BUCKETS + bucket[own], return_counts=True)
        of, g = entry // BUCKETS, entry % BUCKETS
        ends = np.searchsorted(of, np.arange(len(mixed)), "right")
        a = 0
        while a < len(mixed):   # documents whose entries fit together, one at least
            begin = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, begin + ENTRIES // width, "right")))
            part = slice(begin, ends[b - 1])
            pi[mixed[a:b]] = _grow(model.table[g[part]].astype(np.float64), c[part].astype(np.float64), of[part] - a, n[mixed[a:b]], pi[mixed[a:b]])
            a = b
    return pi, known


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), languages and proportions (largest first) of every row."""
    def make(part: pa.RecordBatch) -> dict:
        pi, known = mixtures(part.column("text").to_pylist(), model)
        ranked = [np.lexsort((np.arange(len(row)), -row))[:int((row > 0).sum())] for row in pi]
        return {"doc_id": part.column("doc_id"), "lang_pred": [model.names[r[0]] if k else UNKNOWN for r, k in zip(ranked, known)],
                "score": [min(1.0, float(row[r[0]])) if k else 0.0 for row, r, k in zip(pi, ranked, known)],
                "languages": [[model.names[i] for i in r] for r in ranked], "proportions": [row[r].tolist() for row, r in zip(pi, ranked)]}

    return base.map_rows(base.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), make, SCORED)


def op11_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = predict(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions")
