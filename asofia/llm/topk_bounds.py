"""Exact top-k by inner product without random access (NRA).

Every component of the candidates is a list sorted by value, read from the end
that a query's sign prefers. After a stretch of sequential reads a candidate's
score lies below the sum over what was read and, for each list not yet reached,
the last value read; that is the product of the query with the candidate's
values clipped at the last ones read. A query stops reading when few candidates
of the block can still reach its k-th bound; those are then resolved exactly.

The k-th bound of a query starts from a bounded set of SEED candidates, whose
k-th score is a lower bound of the final one, and rises with every block of rows
that a task has finished. Queries and candidates are dealt into blocks, so no
query and no vector is a group of its own, and only rows that reach the bound
leave a task; the best k of them are the answer.

Defined cases: null ids, null vectors and vectors with a null or non-finite
component take no part; each row is a candidate and each row with a query's id a
query of its own, also when the id repeats, and only its own row is left out;
vectors meet only vectors of their own length; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from asofia.llm import base

SCALE = 64
K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 8_192
SEED = 4_096                                # candidates that give the first bounds
ROWS_AT_ONCE = 2_048                        # of a block, between which the bounds rise
READS = (0.5, 0.6, 0.7, 0.8, 0.9)           # parts of the lists after which bounds are compared
FEW = 0.02                                  # part of the rows that may be left when a query stops
OUT = "query long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of every component of the vectors that take part; `row` is unique."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")))


class Bounds:
    """Best k rows of each query over the rows added so far, by sorted reads and bounds.

    queries: (rows, components) whole numbers; own: the row number of each query;
    least: scores below it are not wanted.
    """

    def __init__(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> None:
        self.q, self.own, self.least, self.k = queries, own, least.astype(np.float64), k
        self.found: list = []        # (query, row's id, score) arrays
        self.stops = self.reads = 0  # queries that stopped on their bounds, of all that read

    def add(self, rows: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(rows), ROWS_AT_ONCE):
            self._add(rows[a:a + ROWS_AT_ONCE], row[a:a + ROWS_AT_ONCE], ids[a:a + ROWS_AT_ONCE])

    def _add(self, rows: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        n, d = rows.shape
        limit = float(np.abs(self.q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(d, 1)
        if limit >= 2.0 ** 62:
            raise OverflowError("inner products beyond 64 bits")
        kind = np.float32 if limit < 2 ** 24 else np.float64 if limit < 2 ** 53 else np.int64   # sums are exact in each
        c, q = rows.astype(kind), self.q.astype(kind)
        lists = np.sort(c, axis=0)
        active = np.arange(len(q))
        self.reads += len(q)
        for part in READS:
            depth = int(n * part)
            bounded = active[np.isfinite(self.least[active])]
            if not depth or not len(bounded):
                break
            down, up = lists[n - depth], lists[depth - 1]   # the last values read from either end
            most = np.maximum(q[bounded], 0) @ np.maximum(c, down).T + np.minimum(q[bounded], 0) @ np.minimum(c, up).T
            alive = most >= self.least[bounded][:, None]
            done = alive.mean(1) <= FEW
            self.stops += int(done.sum())
            i, j = np.nonzero(alive[done])
            self._take(bounded[done][i], j, np.concatenate([np.einsum("ij,ij->i", q[bounded[done][i[x:x + 65536]]], c[j[x:x + 65536]]) for x in range(0, len(i), 65536)] or [np.zeros(0, kind)]), row, ids)
            active = np.setdiff1d(active, bounded[done], assume_unique=True)
        if len(active):   # read to the end of every list
            score = q[active] @ c.T
            i, j = np.nonzero(score >= self.least[active][:, None])
            self._take(active[i], j, score[i, j], row, ids)
        self._keep()

    def _take(self, query: np.ndarray, at: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        good = (score >= self.least[query]) & (row[at] != self.own[query])
        self.found.append((query[good], ids[at[good]], score[good].astype(np.int64)))

    def _keep(self) -> None:
        """The k best of each query so far, and its bound."""
        query, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        last = place == self.k - 1
        kth = score[last].astype(np.float64)
        kth = np.where(np.abs(kth) < 2.0 ** 52, kth, np.nextafter(kth, -np.inf))   # not above the whole number
        self.least[query[last]] = np.maximum(self.least[query[last]], kth)
        self.found = [(query[best], ids[best], score[best])]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return self.found[0] if self.found else (none, none, none)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(t.num_rows, -1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; both are (row, vec_id, v)."""
    nq = max(1, -(-queries.count() // query_block))
    nc = max(1, -(-candidates.count() // candidate_block))
    base.ship(queries.sparkSession)
    of_row = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    q = queries.select("row", "vec_id", "v", F.size("v").alias("d"), of_row(nq).alias("qb"))
    every = F.explode(F.expr(f"sequence(0L, {nq - 1}L)")).alias("qb")
    some = candidates.orderBy(F.xxhash64("row"), "row").limit(seed).select("row", "vec_id", "v", F.size("v").alias("d"), every)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Bounds(_matrix(left), _column(left, "row"), np.full(left.num_rows, -np.inf), k) if left.num_rows else None
        if found and right.num_rows:
            found.add(_matrix(right), _column(right, "row"), _column(right, "vec_id"))
        known = np.isfinite(found.least) if found else np.zeros(0, bool)
        return pa.table({"row": _column(left, "row")[known], "least": pa.array(found.least[known].astype(np.int64) if found else [], pa.int64())})

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids, score = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            found = Bounds(_matrix(left), _column(left, "row"), pa.compute.fill_null(left.column("least").cast(pa.float64()), -np.inf).to_numpy(), k)
            found.add(_matrix(right), _column(right, "row"), _column(right, "vec_id"))
            at, ids, score = found.result()
        return pa.table({"query": _column(left, "row")[at], "query_id": _column(left, "vec_id")[at], "vec_id": ids, "score": score})

    seeds = q.groupBy("d", "qb").cogroup(some.groupBy("d", "qb")).applyInArrow(first, "row long, least long")
    left = base.stored(q.join(seeds, "row", "left")).withColumn("cb", F.explode(F.expr(f"sequence(0L, {nc - 1}L)")))
    right = candidates.select("row", "vec_id", "v", F.size("v").alias("d"), of_row(nc).alias("cb"), every)
    pairs = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInArrow(best, OUT)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_bounds(spark, sf_dir: str) -> DataFrame:
    vectors = base.stored(quantised(base.table(spark, sf_dir, "embeddings")))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20"""
