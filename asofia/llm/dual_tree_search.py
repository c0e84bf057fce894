"""Ranked lexical search by a dual tree over items and documents.

A document's weight for a term does not depend on the item, so documents are
vectors of term weights and items are sets of terms; a score is the sum of a
document's weights over the item's terms. Both sides are put into hierarchies
whose nodes hold coordinate maxima: the largest weight of any document below,
the union of the term sets below. The product of two nodes bounds every score
between them. A pair of nodes is left with all that is below it when its bound
is under the weakest k-th score of the items of the node; pairs that reach the
leaves are scored exactly in 64-bit integers, so nothing is lost.

On Spark: one map reads each whole text once and keeps, of the items' terms,
which it holds and how often; document frequencies are summed from one short row
per task and term. A second map searches blocks of these postings, carrying its
k-th scores from block to block; it starts from the k-th scores of about
SEED_DOCS documents, which are a lower bound of the final ones. At most k rows
for each item leave a task. Items are worked on in groups of bounded bytes, each
group with a scan of its own, so that the terms sent to the tasks are bounded.

Defined cases: rows of one item_id are one item, rows without item_id are none;
an item without terms has no rows; each row of documents is a document, also
when its doc_id repeats; documents without a term or with a null text count
nowhere; documents with a null doc_id count in the statistics and are not
ranked; equal scores go to the smaller doc_id; texts of any length are read
whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from asofia.llm import base

K = 50
FAN = 8                    # children of a node
GROUP_BYTES = 256 << 10    # text of the items that share a scan
CELLS = 1 << 23            # documents x terms of a block
BLOCK_DOCS = 2_048
SEED_DOCS = 4_096
ROUND = 1 + 1e-5           # float32 bounds are raised by more than their rounding

POSTINGS = "stats boolean, docs long, doc_id long, n long, terms array<int>, counts array<bigint>"
HITS = "item long, doc_id long, score long"

# A-Z become a-z; what is no ASCII letter or digit and no part of a longer character becomes a space.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


# ---- postings --------------------------------------------------------------

class _Known(dict):
    """Number of each term of the items; others are -1 and not remembered."""

    def __missing__(self, term: bytes) -> int:
        return -1


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """For each document with a term: n and its counts of the vocabulary; for each task a row of document frequencies."""
    width = len(vocabulary)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    wanted = to_arrow_schema(StructType.fromDDL(POSTINGS))

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, wanted)], schema=wanted)

    def lists(parts: list, kind) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))

    def run(batches):
        known = _Known({t: i for i, t in enumerate(vocabulary)})
        df, seen, total = np.zeros(width, np.int64), 0, 0
        for part in base.slices(batches):
            ids, ns, terms, counts = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                own = terms_of(text)
                if not own:
                    continue
                at = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                at, tf = np.unique(at[at >= 0], return_counts=True)
                df[at] += 1
                seen, total = seen + 1, total + len(own)
                ids.append(doc_id)
                ns.append(len(own))
                terms.append(at)
                counts.append(tf)
            if ids:
                yield batch([False] * len(ids), [1] * len(ids), ids, ns, lists(terms, pa.int32()), lists(counts, pa.int64()))
        if seen:
            at = np.flatnonzero(df)
            yield batch([True], [seen], [None], [total], lists([at], pa.int32()), lists([df[at]], pa.int64()))

    return base.map_batches(base.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), run, POSTINGS)


# ---- hierarchies and search ------------------------------------------------

def order_of_items(held: np.ndarray) -> np.ndarray:
    """An order that puts items with common terms next to each other: halves around two distant items, again and again."""
    out, stack = [], [np.arange(len(held))]
    size = np.sqrt(np.maximum(held.sum(1), 1))
    while stack:
        own = stack.pop()
        if len(own) <= FAN:
            out.append(own)
            continue
        near = lambda i: held[own] @ held[own[i]] / size[own]
        a = near(0).argmin()
        b = near(a).argmin()
        lean = np.argsort(near(b) / size[own[b]] - near(a) / size[own[a]], kind="stable")
        stack += [own[lean[len(own) // 2:]], own[lean[:len(own) // 2]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima from one root's children down to the leaves; node i of a level has the children FAN * i and following below it."""
    out = [leaves]
    while len(out[0]) > FAN:
        out.insert(0, np.maximum.reduceat(out[0], np.arange(0, len(out[0]), FAN), axis=0))
    return out


class Search(NamedTuple):
    """What a task needs: per item its terms, per term its weight, the statistics of all documents."""

    items: list            # arrays of term numbers
    weight: np.ndarray     # int64
    n_docs: int
    n_terms: int
    k: int


class Trees:
    """Best k documents of each item over blocks of postings."""

    def __init__(self, search: Search, floors: np.ndarray) -> None:
        self.search, width = search, len(search.weight)
        held = np.zeros((len(search.items), width), np.float32)
        for i, t in enumerate(search.items):
            held[i, t] = 1
        self.order = order_of_items(held)
        self.tree = levels(held[self.order])
        self.floor = np.maximum(floors, 1)       # scores below it are not wanted, by item
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in search.items]   # scores, ids
        self.block_docs = max(FAN, min(BLOCK_DOCS, CELLS // max(width, 1)))
        self.scored = self.pairs = 0

    def _weakest(self) -> list[np.ndarray]:
        """The least wanted score of the items below each node, level by level from the top."""
        out = [self.floor[self.order]]
        for below in reversed(self.tree[1:]):
            out.insert(0, np.minimum.reduceat(out[0], np.arange(0, len(below), FAN)))
        return out

    def add(self, ids: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Search a block: document d has the postings starts[d]..starts[d + 1]."""
        s, docs = self.search, len(ids)
        if not docs or not len(s.items):
            return
        m = 50 + (50 * n * s.n_docs) // s.n_terms
        row = np.repeat(np.arange(docs), np.diff(starts))
        weight = s.weight[terms] * ((1_000_000_000 * counts) // (1_000 * counts + 20 * m[row]))
        # documents near the same items, and of like strength, get the same nodes
        exact = np.zeros((docs, len(s.weight)), np.int64)
        exact[row, terms] = weight
        near = exact.astype(np.float32) @ self.tree[0].T
        place = np.lexsort((-near.max(1), near.argmax(1)))
        exact, ids = exact[place], ids[place]
        mine = levels(exact.astype(np.float32))
        weakest = self._weakest()
        self.pairs += docs * len(s.items)
        # both trees go down together; the one with fewer levels waits at its top
        alive, i, d = np.ones((len(self.tree[0]), len(mine[0])), bool), 0, 0
        while True:
            bound = np.zeros(alive.shape, np.float32)
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            bound[np.ix_(rows, columns)] = self.tree[i][rows] @ mine[d][columns].T
            alive &= bound * ROUND >= weakest[i][:, None]
            last_i, last_d = i == len(self.tree) - 1, d >= len(mine) - 2   # single documents are scored, not bounded
            if last_i and last_d or not alive.any():
                break
            if not last_i and len(self.tree) - i >= len(mine) - 1 - d:
                i += 1
                alive = np.repeat(alive, FAN, 0)[:len(self.tree[i])]
            if not last_d and (last_i or len(mine) - 1 - d >= len(self.tree) - i):
                d += 1
                alive = np.repeat(alive, FAN, 1)[:, :len(mine[d])]
        if d < len(mine) - 1:
            alive = np.repeat(alive, FAN ** (len(mine) - 1 - d), 1)[:, :docs]
        for at in np.flatnonzero(alive.any(1)):
            item, own = self.order[at], np.flatnonzero(alive[at])
            score = exact[np.ix_(own, s.items[item])].sum(1)
            self.scored += len(own)
            good = score >= self.floor[item]
            if good.any():
                self._take(item, score[good], ids[own[good]])

    def _take(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.found[item][0], score], np.r_[self.found[item][1], ids]
        if len(score) > self.search.k:
            best = np.lexsort((ids, -score))[:self.search.k]
            score, ids = score[best], ids[best]
        self.found[item] = score, ids
        if len(score) == self.search.k:
            self.floor[item] = max(self.floor[item], score.min())


def searched(rows: DataFrame, search: Search, floors: np.ndarray) -> DataFrame:
    """(item, doc_id, score): at most k rows of each item for each task; scores below an item's floor are left out."""
    def run(batches):
        trees = Trees(search, floors.copy())
        held: list = []
        size = 0

        def flush() -> None:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                lens = pa.compute.list_value_length(t.column("terms")).to_numpy()
                flat = [t.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts")]
                ids, n = t.column("doc_id").to_numpy(), t.column("n").to_numpy()
                starts = np.r_[0, np.cumsum(lens)]
                for a in range(0, len(ids), trees.block_docs):
                    b = min(len(ids), a + trees.block_docs)
                    trees.add(ids[a:b], n[a:b], starts[a:b + 1] - starts[a], *(x[starts[a]:starts[b]] for x in flat))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= trees.block_docs:
                flush()
                held, size = [], 0
        flush()
        item = [np.full(len(s), i) for i, (s, _) in enumerate(trees.found)]
        score, ids = ([f[j] for f in trees.found] for j in (0, 1))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none), pa.int64()) for x in (item, ids, score)], names=["item", "doc_id", "score"])

    return base.map_batches(rows.where(F.col("doc_id").isNotNull()).select("doc_id", "n", "terms", "counts"), run, HITS)


# ---- operator --------------------------------------------------------------

def rank_group(docs: DataFrame, item_ids: list, texts: list, k: int = K) -> DataFrame:
    """(item, doc_id, score) of candidates that hold the k best of each item; `item` is the place in item_ids."""
    spark = docs.sparkSession
    own = [sorted({t for text in item for t in terms_of(text)}) for item in texts]
    vocabulary = sorted({t for terms in own for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    folder = base.shared_folder(spark)
    postings(docs, vocabulary).write.partitionBy("stats").parquet(folder)
    stored = spark.read.schema(POSTINGS).parquet(folder)
    facts = stored.where("stats")
    df = np.zeros(len(vocabulary), np.int64)   # one number for each term of the group
    for r in facts.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).collect():
        df[r.terms] = r.df
    n_docs, n_terms = (x or 0 for x in facts.agg(F.sum("docs"), F.sum("n")).first())
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    search = Search([np.array([number[t] for t in terms], np.int64) for terms in own], weight, n_docs, max(n_terms, 1), k)
    rows = stored.where("NOT stats")
    floors = np.ones(len(own), np.int64)
    if n_docs > 2 * SEED_DOCS:   # any documents will do: their k-th scores are only a lower bound of the final ones
        some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_docs // SEED_DOCS)) == 0)
        found = searched(some, search, floors).groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        for r in found.where(F.size("s") >= k).select("item", F.col("s")[k - 1].alias("kth")).collect():   # one row for each item of the group
            floors[r.item] = r.kth
    return searched(rows, search, floors)


def rank(items: DataFrame, docs: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for every item."""
    spark = docs.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        texts: dict = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect():   # bounded by group_bytes, or by one item
            texts.setdefault(r.item_id, []).append(r.text)
        if texts:
            ids = sorted(texts)
            names = spark.createDataFrame(list(enumerate(ids)), f"item long, {schema.split(',')[0]}")
            out = out.unionByName(rank_group(docs, ids, [texts[i] for i in ids], k).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_dual_tree_search(spark, sf_dir: str) -> DataFrame:
    return rank(base.table(spark, sf_dir, "benchmark"), base.table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
t AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) x WHERE term IN (SELECT term FROM b) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, n_docs),
s AS (SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(d.terms) * n_docs) // n_terms)))) AS part FROM p JOIN w ON w.term = p.term JOIN d ON d.r = p.r, t),
m AS (SELECT b.item_id, s.r, CAST(sum(s.part) AS BIGINT) AS score FROM b JOIN s ON s.term = b.term GROUP BY b.item_id, s.r)
SELECT item_id, rank, doc_id, score FROM (SELECT m.item_id, d.doc_id, m.score, CAST(row_number() OVER (PARTITION BY m.item_id ORDER BY m.score DESC, d.doc_id) AS INTEGER) AS rank
  FROM m JOIN d ON d.r = m.r WHERE m.score > 0 AND d.doc_id IS NOT NULL) x WHERE rank <= 50"""
