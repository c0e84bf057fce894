"""Conversation structure repair by a checkpointed dynamic program.

A conversation is repaired to role initials (s?(ua)+)? by the cheapest edits:
Keep (0), Rerole to user or assistant (2), Delete (3, required for a blank or
duplicate row) and Insert of an empty turn (2); a truncated row that stays costs
one more. Among cheapest edit lists the ASCII-least one is taken.

The state before a row is what the role pattern has reached: start, system,
user, assistant. The cost of the best way to the end is a vector of four numbers
for each row, computed backwards. Only checkpoints of it are stored:

1. Rows are reduced to (conversation, turn, role, text, copies), ordered over the
   cluster by range, and cut into segments of bounded rows and bytes wherever
   the order was cut. A segment is one row, so a conversation of any size is
   many rows in many tasks.
2. Each segment gives the 4 x 4 matrix of costs between its ends. Chaining the
   matrices of a conversation backwards gives the cost vector at every segment
   end: the outer checkpoints.
3. Walking forward, a segment is cut into blocks of about the square root of its
   length. Vectors are kept at block ends, one block at a time is recomputed, and
   at each row the ASCII-least edit is taken whose cost is tight. The walk streams
   segments in order and carries the state, the counts and the hash along.

The last pass is sequential within one conversation, as the hash over its whole
repaired text is; it holds one segment and the edits at a time.

Defined cases: rows of one turn are ordered by role and text; equal rows are
copies next to each other; null role or text is one space, a null conv_id or
turn counts as one space in the damage key; a null conv_id is a conversation of
its own; null turns come first; a conversation whose rows were all dropped has
zeros and the hash of the empty string; an empty table gives an empty result;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from asofia.llm import base

SEGMENT_ROWS, SEGMENT_BYTES = 4_096, 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
TURN_AFTER = (USER, USER, ASSISTANT, USER)   # the state that a rerole or an insert leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
NO_FAULT, TRUNCATED, BLANK, DUPLICATE = range(4)
SALTS = 32
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
LEGAL = {"su", "ua", "au"}

ROWS = "conv_id {kind}, turn long, role string, text string, copies long, fault int"
SEGMENTS = ("seg long, conv_id {kind}, turns array<bigint>, roles array<string>, texts array<string>, copies array<bigint>,"
            " faults array<int>, costs array<bigint>")
REPAIRED = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- dynamic program -------------------------------------------------------

def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row of this role initial, None where the pattern forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def relaxed(v: list) -> list:
    """Costs when turns may be inserted first."""
    u, a = min(v[USER], v[ASSISTANT] + COST[INSERT]), min(v[ASSISTANT], v[USER] + COST[INSERT])
    return [min(v[START], u + COST[INSERT]), min(v[SYSTEM], u + COST[INSERT]), u, a]


def before(initial: str, fault: int, copies: int, after: list) -> list:
    """The cost vector before a row from the one after it."""
    if fault >= BLANK:
        return relaxed([COST[DELETE] * copies + c for c in after])
    extra, rest = int(fault == TRUNCATED), COST[DELETE] * (copies - 1)   # further copies are duplicates
    out = []
    for q in range(4):
        best = min(COST[DELETE] + after[q], COST[REROLE] + extra + after[TURN_AFTER[q]])
        kept = kept_state(q, initial)
        if kept is not None:
            best = min(best, extra + after[kept])
        out.append(best + rest)
    return relaxed(out)


END = relaxed([0, FAR, FAR, 0])


def matrix(rows: list) -> list:
    """Costs from each state before the rows (initial, fault, copies) to each state after them, row by row in one list."""
    columns = []
    for r in range(4):
        v = [0 if q == r else FAR for q in range(4)]
        for row in reversed(rows):
            v = before(*row, v)
        columns.append(v)
    return [min(FAR, columns[r][q]) for q in range(4) for r in range(4)]


def apply(costs: list, after: list) -> list:
    return [min(costs[4 * q + r] + after[r] for r in range(4)) for q in range(4)]


def walk(rows: list, after: list, state: int) -> Iterator[tuple[int, str, int]]:
    """(row, edit, state after it) of the ASCII-least cheapest edits of the rows before the cost vector `after`.

    An insert comes before the row it is given with; further copies of a row are not listed.
    """
    step = max(1, isqrt(len(rows)))
    kept, v = {}, after
    for i in range(len(rows), 0, -1):
        if i % step == 0 or i == len(rows):
            kept[i] = v
        v = before(*rows[i - 1], v)
    begin = 0
    for end in sorted(kept):
        block = [kept.pop(end)]
        for i in range(end, begin, -1):
            block.append(before(*rows[i - 1], block[-1]))
        block.reverse()
        for i in range(begin, end):
            initial, fault, copies = rows[i]
            here, there = block[i - begin], block[i - begin + 1]
            extra, rest = int(fault == TRUNCATED), COST[DELETE] * (copies - 1)
            while True:
                if here[state] == COST[DELETE] * copies + there[state]:
                    edit = DELETE
                elif here[state] == COST[INSERT] + here[TURN_AFTER[state]]:
                    state = TURN_AFTER[state]
                    yield i, INSERT, state
                    continue
                elif (kept_to := kept_state(state, initial)) is not None and here[state] == extra + rest + there[kept_to]:
                    edit, state = KEEP, kept_to
                else:
                    edit, state = REROLE, TURN_AFTER[state]
                yield i, edit, state
                break
        begin = end


class Repair:
    """What the forward walk carries along one conversation."""

    def __init__(self) -> None:
        self.state, self.last, self.first = START, None, True
        self.turn, self.low, self.distinct = None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def segment(self, turns: list, roles: list, texts: list, copies: list, faults: list, after: list) -> None:
        for turn, role, n, fault in zip(turns, roles, copies, faults):
            if turn is not None and turn != self.turn:
                self.low, self.turn, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
            self.blank += n if fault == BLANK else 0
            self.duplicate += n if fault == DUPLICATE else n - 1 if fault != BLANK else 0
            self.truncated += fault == TRUNCATED
            self.illegal += (self.last is not None and self.last + role[:1] not in LEGAL) + n - 1
            self.last = role[:1]
        rows = [(r[:1], f, n) for r, f, n in zip(roles, faults, copies)]
        for i, edit, state in walk(rows, after, self.state):
            self.state = state
            self.audit.append(edit)
            self.cost += COST[edit]
            if edit == INSERT:
                self.say(ROLE[state], "")
                continue
            self.audit.append(DELETE * (copies[i] - 1))
            self.cost += COST[DELETE] * (copies[i] - 1)
            if edit != DELETE:
                self.cost += faults[i] == TRUNCATED
                self.say(roles[i] if edit == KEEP else ROLE[state], texts[i])

    def end(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.state = TURN_AFTER[self.state]
            self.audit.append(INSERT)
            self.cost += COST[INSERT]
            self.say(ROLE[self.state], "")
        gaps = self.turn - self.low + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


# ---- rows ------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the planted damage."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(told("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                 F.explode(F.array_repeat(F.lit(True), times)).alias("_")).drop("_"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with `copies` and the first fault of the first copy.

    A text that is said again and again in one conversation is looked up under
    SALTS keys: each salt finds its first turn, and the first of those goes back
    to the salts that hold it.
    """
    rows = base.stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.withColumns({"_key": F.sha2(F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")), F.length("role"), "role", "text"), 256),
                             "_salt": F.pmod(F.xxhash64("turn"), F.lit(SALTS))})
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))   # null turns come first
    own = rows.groupBy("_key", "_salt").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("_n"))
    least = (own.groupBy("_key").agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salt")).where("_n > 1")
             .select("_key", F.col("_least.turn").alias("_first"), F.explode("_salt").alias("_salt")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.col("_n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(NO_FAULT)
    return (rows.join(least.withColumn("_n", F.lit(1)), ["_key", "_salt"], "left")
            .select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")))


def segments(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Runs of a conversation's rows in order, each one row with the costs between its ends; `seg` rises along a conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    ordered = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .select(F.monotonically_increasing_id().alias("seg"), "conv_id", "turn", "role", "text", "copies", "fault"))
    schema = SEGMENTS.format(kind=rows.schema["conv_id"].dataType.simpleString())
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held, size = [], 0

        def row() -> pa.RecordBatch:
            seg, conv = held[0][:2]
            _, _, turns, roles, texts, copies, faults = map(list, zip(*held))
            values = [seg, conv, turns, roles, texts, copies, faults, matrix([(r[:1], f, n) for r, f, n in zip(roles, faults, copies)])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, wanted)], schema=wanted)

        made = []
        for batch in batches:
            for part in base.slices(iter([batch])):
                for r in zip(*(c.to_pylist() for c in part.columns)):
                    if held and (r[1] != held[0][1] or len(held) >= most_rows or size >= most_bytes):
                        made.append(row())
                        held, size = [], 0
                        if len(made) >= 256:
                            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                            made = []
                    held.append(r)
                    size += len(r[4])
        if held:
            made.append(row())
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return base.map_batches(ordered, run, schema)


def checkpoints(parts: DataFrame) -> DataFrame:
    """(seg, after): the cost vector after each segment.

    One short row for each segment meets its conversation here, never the rows themselves.
    """
    small = parts.select("conv_id", "seg", "costs").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("seg"))

    def run(batches):
        conv, v = (), END
        for batch in batches:
            seg, after = [], []
            for c, s, costs in zip(*(x.to_pylist() for x in batch.columns)):
                if (c,) != conv:
                    conv, v = (c,), END
                seg.append(s)
                after.append(v)
                v = apply(costs, v)
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(after, pa.list_(pa.int64()))], names=["seg", "after"])

    return base.map_batches(small, run, "seg long, after array<bigint>")


def repaired(rows: DataFrame) -> DataFrame:
    """One row of counts, cost, edits and hash for each conversation of (conv_id, turn, role, text)."""
    parts = base.stored(segments(with_faults(rows)))
    ordered = (parts.drop("costs").join(checkpoints(parts), "seg").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg")
               .select("conv_id", "turns", "roles", "texts", "copies", "faults", "after"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = REPAIRED.format(kind=rows.schema["conv_id"].dataType.simpleString())
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        conv, repair, done = (), None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), wanted)], schema=wanted)

        for batch in batches:
            for i in range(batch.num_rows):
                c, *values = (x[i].as_py() for x in batch.columns)
                if (c,) != conv:
                    if repair:
                        done.append((conv[0], *repair.end()))
                    if len(done) >= 4_096:
                        yield out()
                        done = []
                    conv, repair = (c,), Repair()
                repair.segment(*values)
        if repair:
            done.append((conv[0], *repair.end()))
        if done:
            yield out()

    return base.map_batches(ordered, run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The result for every conv_id of `conversations`, after the planted damage."""
    found = repaired(damaged(conversations))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    ids = conversations.select("conv_id", *nothing, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")).distinct()
    both = found.withColumn("_rows", F.lit(1)).unionByName(ids.withColumn("_rows", F.lit(0)))
    values = [c for c in found.columns if c != "conv_id"]
    return both.groupBy("conv_id").agg(F.max(F.struct("_rows", *values)).alias("x")).select("conv_id", *[f"x.{c}" for c in values])


def op13_dialogue_repair(spark, sf_dir: str) -> DataFrame:
    return repair(base.table(spark, sf_dir, "conversations"))


# ---- the same in SQL ---------------------------------------------------------

def _sql() -> str:
    """A recursive query from the last row to the first; each state holds cost, edits and repaired lines in one text that sorts by the first two."""
    mark = "chr(1)"
    line = lambda role, text="''": f"chr(10) || '{role}:' || {text}"

    def add(v: str, cost: str, edit: str, said: str = "''") -> str:
        p = f"strpos({v}, {mark})"
        return f"lpad(CAST(CAST(left({v}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({v}, 10, {p} - 10) || {mark} || {said} || substr({v}, {p} + 1)"

    kept = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
    base_of = []
    for q in range(4):
        keep = " ".join(f"WHEN '{i}' THEN {add(f'v{to}', 'x', KEEP, 'said')}" for i, to in kept[q].items())
        to = TURN_AFTER[q]
        base_of.append(f"CASE WHEN forced THEN {add(f'v{q}', '3', DELETE)} ELSE least({add(f'v{q}', '3', DELETE)}, {add(f'v{to}', '2 + x', REROLE, line(ROLE[to], 'text'))}, CASE initial {keep} END) END AS b{q}")
    put = lambda v, role: add(v, "2", INSERT, line(role))
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, _: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS previous
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
g AS (SELECT *, left(role, 1) AS initial, role || ':' || text AS row_text, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault FROM h),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, '000000000' || {mark} AS v0, '000000004II' || {mark} || {line("user")} || {line("assistant")} AS v1, '000000002I' || {mark} || {line("assistant")} AS v2, '000000000' || {mark} AS v3 FROM counts
  UNION ALL SELECT conv_id, i, least(b0, {put("u", "user")}), least(b1, {put("u", "user")}), u, a FROM
   (SELECT *, least(b2, {put("b3", "assistant")}) AS u, least(b3, {put("b2", "user")}) AS a FROM
    (SELECT w.conv_id, w.i - 1 AS i, {", ".join(base_of)} FROM walk w JOIN
     (SELECT *, fault IN ('b', 'd') AS forced, CAST(fault = 't' AS INTEGER) AS x, chr(10) || row_text AS said FROM g) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i) s1) s2)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(CAST(left(v0, 9) AS BIGINT), 0) AS cost, coalesce(substr(v0, 10, strpos(v0, {mark}) - 10), '') AS audit, sha256(coalesce(substr(v0, strpos(v0, {mark}) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0"""


OP13_SQL = _sql()
