"""Byte-level BPE by replaying the merges over a whole vocabulary at once.

The distinct pattern matches of a task's texts form one corpus of symbol
chains. An inverted index leads from the rank of an adjacent pair to the
positions where it stands. Ranks are taken in ascending order, all positions of
a rank are merged left to right, and only the two neighbours of each merge are
looked up and indexed again. Texts are then put together from the ids of their
units. There is no shuffle and no state beyond a bounded vocabulary.

Defined cases: a null text is empty and has no ids; texts of any length are
encoded whole (a match of any length is one chain); repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from asofia.llm import base, units


# Distinct units that a worker keeps before it starts over.
MOST_UNITS = 800_000


def replay(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each piece after every merge of the vocabulary has been applied in rank order."""
    whole = [ranks.get(p) for p in pieces]
    todo = [i for i, w in enumerate(whole) if w is None]
    chain: list[bytes | None] = []
    follow: list[int] = []
    before: list[int] = []
    heads = []
    for i in todo:
        at = len(chain)
        n = len(pieces[i])
        heads.append(at)
        chain += [pieces[i][k:k + 1] for k in range(n)]
        follow += range(at + 1, at + n + 1)
        before += range(at - 1, at + n - 1)
        if n:
            follow[-1], before[at] = -1, -1
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    for p, q in enumerate(follow):
        if q >= 0 and (r := rank_of(chain[p] + chain[q])) is not None:
            index.setdefault(r, []).append(p)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        for k, p in enumerate(places):
            left = chain[p]
            q = follow[p]
            if left is None or q < 0 or rank_of(both := left + chain[q]) != r:
                continue
            chain[p], chain[q] = both, None
            after = follow[p] = follow[q]
            earlier = before[p]
            lower = False
            if after >= 0:
                before[after] = p
                if (s := rank_of(both + chain[after])) is not None:
                    if s in index:
                        index[s].append(p)
                    else:
                        index[s] = [p]
                        heapq.heappush(heap, s)
                    lower = s < r
            if earlier >= 0 and (s := rank_of(chain[earlier] + both)) is not None:
                if s in index:
                    index[s].append(earlier)
                else:
                    index[s] = [earlier]
                    heapq.heappush(heap, s)
                lower = lower or s < r
            if lower and k + 1 < len(places):   # a merge of lower rank has appeared: it goes first
                index.setdefault(r, []).extend(places[k + 1:])
                heapq.heappush(heap, r)
                break
    out: list[list[int]] = [[w] if w is not None else [] for w in whole]
    for i, p in zip(todo, heads):
        ids = out[i]
        while p >= 0 and pieces[i]:
            ids.append(ranks[chain[p]])
            p = follow[p]
    return out


class Encoder:
    """A vocabulary with what a worker has encoded so far, by unit."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.reset()

    def reset(self) -> None:
        self.number = units.Numbering()
        self.pieces: dict[str, tuple[str, int, bytes]] = {}
        self.said: list[str] = []
        self.counts: list[int] = []
        self.raw: list[bytes] = []

    def learn(self) -> None:
        """Replay the merges over the pattern matches that no earlier unit had."""
        fresh, self.number.fresh = self.number.fresh, []
        split = [self.pattern.findall(units.text_of(k)) for k in fresh]
        known = self.pieces
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in known))
        for p, ids in zip(new, replay([p.encode("utf-8", "surrogatepass") for p in new], self.ranks)):
            known[p] = ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids))
        for parts in split:
            said, counts, raw = zip(*map(known.__getitem__, parts)) if parts else ((), (), ())
            self.said.append(",".join(said))
            self.counts.append(sum(counts))
            self.raw.append(b"".join(raw))

    def numbers(self, text: str) -> list[int]:
        if len(self.number) > MOST_UNITS:
            self.reset()
        at = list(map(self.number.__getitem__, units.keys_of(text)))
        if self.number.fresh:
            self.learn()
        return at

    def encode(self, text: str) -> list[int]:
        return [int(i) for n in self.numbers(text) if self.said[n] for i in self.said[n].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: list) -> dict:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        if len(self.number) > MOST_UNITS:
            self.reset()
        every = [list(map(self.number.__getitem__, units.keys_of(t or ""))) for t in texts]
        if self.number.fresh:
            self.learn()
        count, said, raw = self.counts.__getitem__, self.said.__getitem__, self.raw.__getitem__
        n, a, b = [], [], []
        for at in every:
            n.append(sum(map(count, at)))
            a.append(hashlib.sha256(",".join(filter(None, map(said, at))).encode()).hexdigest())
            b.append(hashlib.sha256(b"".join(map(raw, at))).hexdigest())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    def make(part: pa.RecordBatch) -> dict:
        e = units.once(Encoder, path, pattern)
        return {"doc_id": part.column("doc_id"), "ids": [e.encode(t or "") for t in part.column("text").to_pylist()]}

    return base.map_rows(base.dealt(docs.select("doc_id", "text")), make, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows of encode_texts; null ids give no bytes."""
    def run(batches):
        e = units.once(Encoder, path, pattern)
        for part in batches:
            done = [e.decode(ids or []) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(done, pa.binary())], names=["doc_id", "decoded"])

    return base.map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def op8_merge_replay(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def make(part: pa.RecordBatch) -> dict:
        e = units.once(Encoder, path, pattern)
        return {"doc_id": part.column("doc_id"), **e.digests(part.column("text").to_pylist())}

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return base.map_rows(base.dealt(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
