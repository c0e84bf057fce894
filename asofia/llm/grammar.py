"""Token ids in grammar-compressed shards (Re-Pair), decodable at any position.

Documents are ordered by id, encoded and cut into shards of a bounded number of
ids. In each shard the frequent adjacent pairs are replaced by nonterminals,
again and again; a pair never spans two documents. A shard row holds the rules,
the length of each rule's expansion and the remaining sequence, so that any
range of ids is decoded from the few symbols that cover it.

The pairs of a shard are counted in a table of hashed counters. Each round takes
the most frequent counters, lets each stand for one pair, replaces all its
non-overlapping occurrences, left to right, and counts the places beside them
anew, until no pair reaches LEAST. Pairs that share a counter with another wait
for a later round.

Defined cases: a null text has the end id only; a null doc_id sorts first;
rows with one doc_id are ordered by a hash of their text; a text longer than a
shard makes a shard of its own; an empty table gives empty files and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from asofia.llm import base, units

SHARD_IDS = 1 << 20
LEAST = 8         # places that a pair needs
SPAN = 2_048      # a round takes the counters within this factor of the highest
COUNTERS = 18   # bits
NOTHING = 1 << COUNTERS

SHARDS = ("part int, ids_before long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, first_rule int,"
          " rules binary, rule_lens binary, planes int, symbols binary")


# ---- grammar -------------------------------------------------------------

def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counter of each pair (a, b)."""
    return (((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - COUNTERS)).astype(np.int32)


def compress(ids: np.ndarray, doc_lens: np.ndarray, first_rule: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k is the pair that symbol first_rule + k stands for.

    Goes on until no pair that could be replaced reaches `least`; a pair whose
    places overlap needs half as many. Only the places beside a replaced pair
    are counted anew.
    """
    s = ids.astype(np.uint32)
    ends = np.cumsum(doc_lens)
    rules: list[np.ndarray] = []
    made = 0
    stuck = np.zeros(NOTHING + 1, bool)       # counters whose pair has too few places of its own
    slot = np.full(len(s), NOTHING, np.int32)   # of the pair that begins at each place; the end of a document begins none
    slot[:-1] = _slots(s[:-1], s[1:])
    slot[ends[np.asarray(doc_lens) > 0] - 1] = NOTHING
    counts = np.bincount(slot, minlength=NOTHING + 1)
    while True:
        counts[NOTHING] = 0
        counts[stuck] = 0
        top = int(counts.max())
        if top < least:
            break
        floor = max(least, top // SPAN)
        at = np.flatnonzero((counts >= floor).take(slot))
        pair, own = s[at].astype(np.int64) << 32 | s[at + 1], slot[at]
        stands_for = np.zeros(NOTHING + 1, np.int64)
        stands_for[own] = pair
        same = stands_for[own] == pair
        at, own = at[same], own[same]
        order = np.arange(len(at), dtype=np.int32)
        begin = np.r_[True, at[1:] != at[:-1] + 1]
        left = (order - np.maximum.accumulate(np.where(begin, order, 0))) & 1 == 0   # of overlapping ones the left
        at, own = at[left], own[left]
        uses = np.bincount(own, minlength=NOTHING + 1)
        enough = uses >= max(2, least // 2)
        stuck |= (counts >= floor) & ~enough
        taken = np.flatnonzero(enough)
        if not len(taken):
            continue
        taken = taken[np.argsort(-uses[taken], kind="stable")]
        name = np.zeros(NOTHING + 1, np.uint32)
        name[taken] = first_rule + made + np.arange(len(taken))
        chosen = enough[own]
        at, own = at[chosen], own[chosen]
        rules.append(np.stack([stands_for[taken] >> 32, stands_for[taken] & 0xFFFFFFFF], 1).astype(np.uint32))
        made += len(taken)
        gained = len(at)
        before = at[np.r_[at[:1] > 0, at[1:] - 2 != at[:-1]]] - 1   # where it is not the second of another place
        counts -= np.bincount(slot[np.concatenate([before, at, at + 1])], minlength=NOTHING + 1)
        s[at] = name[own]
        slot[at] = slot[at + 1]                # ends a document if the second symbol did
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, slot = s[stay], slot[stay]
        at = at - np.arange(gained)            # one symbol went after each place before
        at = np.concatenate([at[np.r_[at[:1] > 0, at[1:] - 1 != at[:-1]]] - 1, at])
        at = at[slot[at] != NOTHING]
        slot[at] = _slots(s[at], s[at + 1])
        counts += np.bincount(slot[at], minlength=NOTHING + 1)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), s


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for. A rule refers to earlier rules only, so layers settle one after another."""
    n = np.ones(len(rules), np.int64)
    while len(rules):
        of = lambda side: np.where(side >= first_rule, n[np.maximum(side.astype(np.int64) - first_rule, 0)], 1)
        new = of(rules[:, 0]) + of(rules[:, 1])
        if (new == n).all():
            break
        n = new
    return n


def unfold(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids of a few symbols, by replacing rules layer by layer."""
    s = symbols.astype(np.uint32)
    while True:
        inner = s >= first_rule
        if not inner.any():
            return s
        size = inner + 1
        ends = np.cumsum(size)[inner] - 1
        rule = s[inner] - first_rule
        s = np.repeat(s, size)
        s[ends - 1], s[ends] = rules[rule, 0], rules[rule, 1]


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids of a whole shard: every rule is unfolded once and then copied to its places."""
    s = symbols.astype(np.uint32)
    inner = s >= first_rule
    if not inner.any():
        return s
    lens = expansion_lengths(rules, first_rule)
    body, begin = unfold(rules.ravel(), rules, first_rule), np.cumsum(lens) - lens
    rule = s[inner].astype(np.int64) - first_rule
    size = np.ones(len(s), np.int64)
    size[inner] = lens[rule]
    out = np.repeat(s, size)
    own = size[inner]
    filled = np.repeat(inner, size)
    out[filled] = body[np.arange(int(own.sum())) + np.repeat(begin[rule] - (np.cumsum(own) - own), own)]
    return out


def lengths_of(symbols: np.ndarray, rule_lens: np.ndarray, first_rule: int) -> np.ndarray:
    s = symbols.astype(np.int64)
    if not len(rule_lens):
        return np.ones(len(s), np.int64)
    return np.where(s >= first_rule, rule_lens[np.maximum(s - first_rule, 0)], 1)


def decode_range(symbols, rules, rule_lens, first_rule: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard from the symbols that cover them alone."""
    ends = np.cumsum(lengths_of(symbols, rule_lens, first_rule))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return unfold(symbols[a:b], rules, first_rule)[start - before:max(start, stop) - before]


def pack_symbols(symbols: np.ndarray) -> tuple[int, bytes]:
    """(number of bit planes, bytes): the low 16 bits of all symbols, then a plane of bits for each higher one in use."""
    planes = max(0, int(symbols.max(initial=0)).bit_length() - 16)
    high = [np.packbits((symbols >> np.uint32(16 + p)) & np.uint32(1)).tobytes() for p in range(planes)]
    return planes, symbols.astype("<u2").tobytes() + b"".join(high)


def unpack_symbols(packed: bytes, planes: int) -> np.ndarray:
    n = len(packed) * 8 // (16 + planes)
    while 2 * n + planes * -(-n // 8) > len(packed):   # planes end on whole bytes
        n -= 1
    out = np.frombuffer(packed, "<u2", n).astype(np.uint32)
    size = -(-n // 8)
    for p in range(planes):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, size, 2 * n + p * size), count=n)
        out |= bits.astype(np.uint32) << np.uint32(16 + p)
    return out


# ---- files ---------------------------------------------------------------

def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int, whole_added: bool) -> Iterator[dict]:
    tokens = units.once(units.TokenIds, path, whole_added)
    first_rule = max(tokens.tokenizer.get_vocab_size(), end_id + 1)
    before = 0
    doc_ids, parts, lens, held = [], [], [], 0

    def shard() -> dict:
        nonlocal doc_ids, parts, lens, held, before
        ids, doc_lens = np.concatenate(parts), np.concatenate(lens)
        rules, symbols = compress(ids, doc_lens, first_rule)
        planes, packed = pack_symbols(symbols)
        row = {"part": TaskContext.get().partitionId(), "ids_before": before, "n_ids": held, "doc_ids": doc_ids, "doc_lens": doc_lens,
               "first_rule": first_rule, "rules": rules.astype("<u4").tobytes(), "rule_lens": expansion_lengths(rules, first_rule).astype("<u4").tobytes(),
               "planes": planes, "symbols": packed}
        before += held
        doc_ids, parts, lens, held = [], [], [], 0
        return row

    for part in base.slices(batches):
        ids, n = tokens.encode(part.column("text").to_pylist())
        ids = np.insert(ids, np.cumsum(n), end_id)
        doc_ids += part.column("doc_id").to_pylist()
        parts.append(ids)
        lens.append(n + 1)
        held += len(ids)
        if held >= shard_ids:
            yield shard()
    if doc_ids:
        yield shard()


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, whole_added: bool = False) -> None:
    """Encode docs (doc_id, text) in ascending order and write the shard files; `whole_added` as in TokenIds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie")
               .sortWithinPartitions("doc_id", "_tie").select("doc_id", "text"))
    wanted = to_arrow_schema(StructType.fromDDL(SHARDS))

    def run(batches):
        for row in _shards(batches, path, end_id, shard_ids, whole_added):
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in wanted], schema=wanted)

    base.map_batches(ordered, run, SHARDS).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array) of every document, in file order within a shard."""
    return _documents(spark, folder, "doc_id long, start long, ids array<int>",
                      lambda doc_ids, starts, pieces: [doc_ids, starts, [p.astype(np.int32) for p in pieces]])


def _documents(spark: SparkSession, folder: str, schema: str, columns) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(folder)
    # one row for each written partition
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                ids = expand(unpack_symbols(row["symbols"], row["planes"]), rules, row["first_rule"])
                ends = np.cumsum(np.array(row["doc_lens"], np.int64))
                starts = row["_offset"] + row["ids_before"] + np.r_[0, ends[:-1]].astype(np.int64)
                made = columns(row["doc_ids"], starts, np.split(ids, ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, wanted)], schema=wanted)

    return base.map_batches(shards.join(F.broadcast(offsets), "part"), run, schema)


def op5_grammar(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = base.shared_folder(spark)
    write_shards(base.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), whole_added=True)
    return _documents(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long",
                      lambda doc_ids, starts, pieces: [doc_ids, starts, list(map(len, pieces)), [zlib.crc32(p.astype("<u4").tobytes()) for p in pieces]])
