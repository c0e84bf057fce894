"""Near-duplicates: MinHash candidates, sequential Bayesian verification, exact confirmation.

1. One map gives every document the hash of its shingle set, a MinHash
   signature and its band keys. Documents with equal sets form a class; only
   one representative of each class goes on.
2. Every bucket links its members to its center: as many pairs as rows, however
   large the bucket. The center is the member with the most bucket mates over
   all bands; among copies with edits that is the text they were made from.
   Pairs are compared on growing parts of the signatures and dropped once the
   posterior probability of the similarity bound is below MISS; survivors are
   confirmed on their full sets. This joins nearly all copies of a text.
3. Buckets that still hold more than one component are compared across
   components only, in blocks of bounded rows and bytes that carry the full sets;
   a pair is looked at in the first band that it shares. Survivors are confirmed
   and united at once, so a block gives no more links than it has members. Every
   candidate pair that could join two components is decided, and no link is lost
   by the choice of the center in step 2.
4. Components come from alternating star contractions of the confirmed links.

A link is missed if all bands differ (probability below 1e-5 at similarity 0.8)
or if its posterior falls below MISS. Sets are compared by 64-bit shingle
hashes.

Defined cases: a document without words or text has an empty set and links with
nothing; fewer words than a shingle are one shingle; rows of one doc_id with the
same text are one document, with different texts each is a document of its own;
rows with a null doc_id take no part and are kept; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from asofia.llm import base, units

WORDS = 4               # of a shingle; the query's contract asks for four
PERCENT = 80            # least similarity
BANDS, ROWS = 24, 4
HASHES = 128            # the bands use the first BANDS * ROWS
STEPS = (32, 64, 96, 128)
MISS = 1e-5
BLOCK, BLOCK_BYTES = 1_024, 16 << 20   # members of a bucket that meet in one group, and their sets
MOST_WORDS = 500_000  # distinct words that a worker keeps

FEATURES = "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, bands array<long>"
_RNG = np.random.default_rng(20240711)
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


# ---- sets and signatures ---------------------------------------------------

class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    known = units.once(WordHash)
    if len(known) > MOST_WORDS:
        known.clear()
    out = []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only
        if not own:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        take = min(words, len(h))
        s = np.full(len(h) - take + 1, np.uint64(take))
        for k in range(take):
            s = _mix(s * np.uint64(0xD6E8FEB86659FD93) + h[k:len(h) - take + 1 + k])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32), one row for each set; an empty set has all ones."""
    sig = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.r_[0, np.cumsum([len(sets[i]) for i in full])][:-1]
        for k in range(HASHES):
            sig[full, k] = np.minimum.reduceat((flat * _MUL[k] + _ADD[k]) >> np.uint64(32), starts).astype(np.uint32)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band; the band's number is in the top bits, so keys of different bands differ and sort by band."""
    h = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, r:BANDS * ROWS:ROWS].astype(np.uint64) + np.uint64(1))
    return ((h >> np.uint64(8)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(56))).astype(np.int64)


def features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def make(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column("text").to_pylist(), words)
        sig = signatures(sets)
        return {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": list(map(len, sets)), "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "signature": [s.tobytes() for s in sig], "bands": list(band_keys(sig))}

    return base.map_rows(base.dealt(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))), make, FEATURES)


# ---- verification ----------------------------------------------------------

def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each step, the fewest equal hashes at which P(similarity >= percent) is at least `miss`.

    With a uniform prior the posterior after m of n matches is Beta(m + 1,
    n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = percent / 100
    out = []
    for n in STEPS:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def similar_enough(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature arrays survive every step; a row that fails is not read further."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in zip(STEPS, least):
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(1)
        stay = matches >= m
        alive, matches, at = alive[stay], matches[stay], n
    return alive


def _signature_rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    side = lambda name: reps.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"_n{name}"), F.col("signature").alias(f"_s{name}"))
    rows = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent).select("a", "b", "_sa", "_sb"))
    least = least_matches(percent)

    def run(batches):
        for part in batches:
            if part.num_rows:
                alive = pa.array(similar_enough(_signature_rows(part.column("_sa")), _signature_rows(part.column("_sb")), least))
                yield part.select(["a", "b"]).take(alive)

    return base.map_batches(rows, run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    rows = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_sa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_sb")), "b").select("a", "b", "_sa", "_sb")

    def run(batches):
        for part in batches:
            keep = []
            for x, y in zip(part.column("_sa"), part.column("_sb")):
                keep.append(linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return base.map_batches(rows, run, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Forest:
    """Components of the members of a block, united link by link."""

    def __init__(self, comp: np.ndarray) -> None:
        self.name = np.unique(comp, return_inverse=True)[1]   # component of each member, as a small number
        self.links: list[tuple[int, int]] = []

    def unite(self, i: int, j: int) -> None:
        self.name[self.name == self.name[j]] = self.name[i]
        self.links.append((i, j))


def across(buckets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that join the components within the blocks of each bucket, a spanning forest of each block.

    buckets: band, i, j, side (0 in block i, 1 in block j), rep, comp, n_shingles, signature, bands, shingles.
    """
    least = least_matches(percent)

    def run(t: pa.Table) -> pa.Table:
        side, rep, comp, n = (t.column(c).to_numpy() for c in ("side", "rep", "comp", "n_shingles"))
        sig = _signature_rows(t.column("signature"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        same_block = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        earlier = t.column("band")[0].as_py() >> 56
        forest = Forest(comp)
        left = np.arange(len(rep)) if same_block else np.flatnonzero(side == 0)
        right = left if same_block else np.flatnonzero(side == 1)
        for k in left:
            other = right[(forest.name[right] != forest.name[k]) & (np.minimum(n[right], n[k]) * 100 >= np.maximum(n[right], n[k]) * percent)]
            if same_block:
                other = other[rep[other] > rep[k]]
            if earlier and len(other):
                other = other[~(bands[other, :earlier] == bands[k, :earlier]).any(1)]
            if len(other):
                for m in other[similar_enough(np.broadcast_to(sig[k], (len(other), HASHES)), sig[other], least)]:
                    if forest.name[m] != forest.name[k] and linked(sets[k], sets[m], percent):
                        forest.unite(k, m)
        i, j = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})

    return buckets.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


# ---- components ------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Alternates large-star (every neighbour above a node hangs on the node's
    smallest neighbour) and small-star (the others hang on it too) until the
    edges no longer change; each round is written to shared storage.
    """
    current = base.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v")).distinct()
        current = base.stored(small)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


# ---- operator --------------------------------------------------------------

def _decided(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row."""
    f = base.stored(features(docs, words))
    classes = base.stored(f.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "bands")).alias("x"))
                          .select("set_key", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.signature", "x.bands"))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = base.stored(banded.join(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band"))
    members = shared.select("rep").distinct()

    def make(part: pa.RecordBatch) -> dict:
        return {"rep": part.column("doc_id"), "shingles": [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), words)]}

    texts = docs.select("doc_id", "text").join(members.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = base.stored(base.map_rows(texts, make, "rep long, shingles binary"))

    mates = shared.groupBy("rep").agg(F.sum("size").alias("mates"))
    centers = shared.join(mates, "rep").groupBy("band").agg(F.max(F.struct("mates", -F.col("rep"))).alias("_m")).select("band", (-F.col("_m.col2")).alias("center"))
    star = plausible(shared.join(centers, "band").where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), classes, percent)
    first = star.join(mates.withColumnRenamed("rep", "a"), "a").groupBy("b").agg(F.max(F.struct("mates", "a")).alias("_m")).select(F.col("_m.a").alias("a"), "b")
    links = base.stored(confirmed(first, sets, percent))
    found = base.stored(components(links))

    rows = (shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(classes.select("rep", "n_shingles"), "rep")
            .select("band", "rep", "size", "n_shingles", F.coalesce("component", "rep").alias("comp")))
    mixed = (rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("_held"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
                                      F.bit_xor(F.xxhash64("rep")).alias("_x"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("_y"))
             .where("_lo <> _hi").groupBy("size", "_held", "_x", "_y").agg(F.min("band").alias("band")))   # buckets with the same members count once
    parts = F.least(F.col("size"), F.ceil(F.col("size") / BLOCK) + F.floor(F.col("_held") * 8 / BLOCK_BYTES)).cast("int")
    rows = (rows.drop("size").join(mixed.select("band", "size", "_held"), "band").withColumn("_parts", parts)
            .withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int")))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.struct(
        F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j"), (F.col("_own") > k).cast("int").alias("side"))))
    rows = rows.select("band", "rep", "comp", meets.alias("m")).select("band", "rep", "comp", "m.i", "m.j", "m.side")
    rows = rows.join(classes.select("rep", "n_shingles", "signature", "bands").join(sets, "rep"), "rep")
    more = base.stored(across(rows, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    named = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("_c"))
    joined = f.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _decided(docs, words, percent).drop("text_key")


def drop_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component.

    Rows go by their id and text, so of an id that has several texts only those
    go that another document stands for. Rows without id, words or text stay; an
    empty table stays empty; other columns, whatever their names, are passed on.
    """
    gone_id, gone_key = base.free_names(docs.columns, "gone_id", "gone_key")
    gone = _decided(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_key)), "left_anti").select(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"))
