"""Packing into sequences of fixed length by cutting-stock column generation.

Documents are cut into full pieces and one remainder. Remainders fall into
length classes (steps of STEP ids). A linear program over patterns - how many
pieces of each class one sequence holds - covers the histogram of classes; its
columns are priced by a knapsack dynamic program over the duals. The solution is
rounded down and what is left is packed greedily into a few further patterns.

Only the histogram (one count for each class) reaches the driver. Pieces are
ranked within their class by document; the place of a rank in the list of
patterns is arithmetic, so every task finds the sequence of its pieces without
seeing any other.

Defined cases: a null text has the end id only; rows with equal doc_id are
ordered by a hash of their text; texts of any length are cut as often as
needed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from asofia.llm import base, units

SEQUENCE = 2_048
STEP = 8

PIECES = "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long, class int"


# ---- linear program ------------------------------------------------------

def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Pattern of the highest dual value that fits the room (unbounded knapsack)."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for cap in range(1, room + 1):
        fit = int(np.searchsorted(sizes, cap, "right"))
        best[cap] = best[cap - 1]
        if fit:
            value = duals[:fit] + best[cap - sizes[:fit]]
            k = int(value.argmax())
            if value[k] > best[cap] + 1e-12:
                best[cap], pick[cap] = value[k], k
    pattern = np.zeros(len(sizes))
    cap = room
    while cap > 0:
        if pick[cap] < 0:
            cap -= 1
        else:
            pattern[pick[cap]] += 1
            cap -= sizes[pick[cap]]
    return best[room], pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4_000, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used): a basic solution that meets the demand.

    A best column of dual value v proves that no solution uses fewer than
    use.sum() / v sequences, so the search ends once v is at most 1 + gap.
    """
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    use = demand / np.diag(basis)
    # einsum has its own loops: threaded linear algebra in a driver that has forked a JVM can hang
    for _ in range(rounds):
        value, column = price(inverse.sum(0), sizes, room)
        if value <= 1 + gap:
            break
        way = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / way[out]
        inverse = inverse - way[:, None] * pivot
        inverse[out] = pivot
        use = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    return basis, use


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """[(pieces of each class 1..room, copies)] that hold exactly `demand` pieces (index 0 is class 1)."""
    left = np.asarray(demand, np.int64).copy()
    out = []
    asked = np.flatnonzero(left)
    if len(asked):
        sizes = asked + 1
        patterns, use = solve(sizes, left[asked].astype(float), room)
        for p in np.argsort(-use, kind="stable"):
            column = np.round(patterns[:, p]).astype(np.int64)
            copies = int(use[p] + 1e-6)
            if (column > 0).any():
                copies = min(copies, int((left[asked][column > 0] // column[column > 0]).min()))
            if copies > 0 and column.any():
                full = np.zeros(room, np.int64)
                full[asked] = column
                left -= copies * full
                out.append((full, copies))
    while left.any():   # what rounding left: largest pieces first
        full, cap = np.zeros(room, np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            n = min(int(left[c]), cap // (c + 1))
            full[c] += n
            cap -= n * (c + 1)
        copies = int((left[full > 0] // full[full > 0]).min())
        left -= copies * full
        out.append((full, copies))
    return out


class Places:
    """Where the piece of a given class and rank goes."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], room: int) -> None:
        copies = np.array([c for _, c in patterns], np.int64)
        self.first = np.r_[0, np.cumsum(copies)][:-1] if len(copies) else copies
        self.of = []
        for c in range(room):
            which = [i for i, (p, _) in enumerate(patterns) if p[c]]
            each = np.array([patterns[i][0][c] for i in which], np.int64)
            self.of.append((np.array(which, np.int64), each, np.cumsum(each * copies[which]) if which else each))

    def sequence(self, klass: int, rank: np.ndarray) -> np.ndarray:
        which, each, upto = self.of[klass - 1]
        i = np.searchsorted(upto, rank, "right")
        within = rank - np.r_[0, upto][i]
        return self.first[which[i]] + within // each[i]


# ---- Spark ---------------------------------------------------------------

def cut(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE, step: int = STEP, whole_added: bool = False) -> DataFrame:
    """Pieces of every document: full ones from its start, then the remainder."""
    def make(part: pa.RecordBatch) -> dict:
        ids, n = units.once(units.TokenIds, path, whole_added).encode(part.column("text").to_pylist())
        ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
        n = n + 1
        pieces = (n + size - 1) // size
        row = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        length = np.minimum(size, n[row] - start)
        at = (np.cumsum(n) - n)[row] + start
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
        take = pa.array(row)
        return {"doc_id": part.column("doc_id").take(take), "tie": part.column("tie").take(take), "start": start, "length": length,
                "ids_crc32": crc, "doc_tokens": n[row], "class": ((length + step - 1) // step).astype(np.int32)}

    return base.map_rows(base.dealt(docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))), make, PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE, step: int = STEP, whole_added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; `whole_added` as in TokenIds."""
    room = size // step
    pieces = base.stored(cut(docs, path, end_id, size, step, whole_added))
    histogram = np.zeros(room, np.int64)
    for r in pieces.groupBy("class").count().collect():   # at most `room` rows
        histogram[r["class"] - 1] = r["count"]
    places = Places(plan(histogram, room), room)
    first_of = np.r_[0, np.cumsum(histogram)]
    order = ["class", "doc_id", "tie", "start"]

    def number(frames):
        at = 0
        for f in frames:
            yield f.assign(_part=TaskContext.get().partitionId(), _row=np.arange(at, at + len(f)))
            at += len(f)

    base.ship(docs.sparkSession)
    ranked = base.stored(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInPandas(number, f"{PIECES}, _part int, _row long"))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))   # one row for each written partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))

    def assign(frames):
        for f in frames:
            klass = f["class"].to_numpy()
            rank = (f["_before"] + f["_row"]).to_numpy() - first_of[klass - 1]
            seq = np.zeros(len(f), np.int64)
            for c in np.unique(klass):
                seq[klass == c] = places.sequence(int(c), rank[klass == c])
            yield pd.DataFrame({"doc_id": f.doc_id, "start": f.start, "length": f.length, "ids_crc32": f.ids_crc32,
                                "doc_tokens": f.doc_tokens, "tie": f.tie, "sequence_id": seq})

    placed = ranked.join(F.broadcast(offsets), "_part").mapInPandas(
        assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "tie", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def sequences(docs: DataFrame, packed: DataFrame, path: str, end_id: int = 1, pad_id: int = 0, size: int = SEQUENCE,
              whole_added: bool = False) -> DataFrame:
    """sequence_id, ids: the padded sequences themselves; a length that is a power of two is not padded.

    For documents with unique ids.
    """
    def make(part: pa.RecordBatch) -> dict:
        tokens = units.once(units.TokenIds, path, whole_added)
        out = []
        for t in part.column("text").to_pylist():
            out.append(np.r_[tokens.encode([t])[0], end_id].astype(np.int32))
        return {"doc_id": part.column("doc_id"), "ids": out}

    ids = base.map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("_ids"))
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "_ids"))), lambda x: x["_ids"])).alias("ids"))
    n = F.size("ids")
    return whole.select("sequence_id", F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(size) - n))).alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), whole_added=True)
