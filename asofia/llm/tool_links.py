"""Chat formatting: tool calls linked to their results, ordered and validated.

Calls and results are matched by identifier in an equi-join. Calls may name
other calls whose results they use; their topological level is found by rounds
of joins over the dependency edges alone (as many rounds as the longest chain),
and what never becomes ready is marked as part of a cycle. Arguments are
checked against the tool's schema and every event is written as canonical JSON:
keys sorted, no spaces, null members left out.

Frames:
  calls   conv_id, turn, call_id, tool, arguments (map<string,string>), depends_on (array<string>)
  results conv_id, turn, call_id, content
  schemas tool, name, type ('string' | 'integer' | 'number' | 'boolean'), required

Defined cases: identifiers are scoped by conv_id, compared null-safe; a call
without an identifier links with nothing; of several calls or results with one
identifier the earliest (turn, then text) counts and the others are counted as
repeated; a result without a call is an orphan; a dependency on a call that does
not exist is ignored and counted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.llm import base

CUT_EVERY = 8   # rounds between writes of the frontier


def quoted(text: Column) -> Column:
    """A JSON string: the quote, the backslash and the control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(char), F.lit(name))
    for code in [c for c in range(32) if c not in (8, 9, 10, 12, 13)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_map(values: Column) -> Column:
    """Canonical JSON object of a map of strings: keys in order, null members left out."""
    items = F.array_sort(F.filter(F.map_entries(values), lambda e: e["value"].isNotNull()))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))


def canonical(**members: Column) -> Column:
    """Canonical JSON object of ready-made JSON values; a null value leaves its member out."""
    parts = [F.concat(F.lit(f'"{name}":'), members[name]) for name in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


TYPES = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": r"^(true|false)$"}


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key with `repeats`, the number of further ones; partial aggregation before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(packed.alias("_x"), (F.count(F.lit(1)) - 1).alias("repeats")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest], "repeats")


def levels(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level: 0 without dependencies, else one more than the highest of them; null on or behind a cycle.

    edges: keys and `needs`, the call_id it needs. Each round settles the calls
    whose dependencies are all settled; only unsettled edges go into the next.
    """
    settled = nodes.join(edges.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("level"))
    done, left, k = settled, edges.withColumn("level", F.lit(None).cast("int")), 0
    frontier = settled
    while True:
        known = frontier.select(keys[0], F.col(keys[1]).alias("needs"), F.col("level").alias("_l"))
        left = left.join(known, [keys[0], "needs"], "left").withColumn("level", F.coalesce("level", "_l")).drop("_l")
        left = base.stored(left)
        ready = left.groupBy(*keys).agg(F.max("level").alias("_m"), F.bool_and(F.col("level").isNotNull()).alias("_all"))
        frontier = base.stored(ready.where("_all").select(*keys, (F.col("_m") + 1).alias("level")))
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
        left = left.join(frontier.select(*keys), keys, "left_anti")
        k += 1
        if k % CUT_EVERY == 0:
            done = base.stored(done)
    return nodes.select(*keys).join(done, keys, "left")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identified call or orphan result: its link status, level, argument errors and canonical JSON."""
    keys = ["conv_id", "call_id"]
    asked = first_of(calls.select("conv_id", "turn", "call_id", "tool", "arguments", "depends_on").where("conv_id IS NOT NULL AND call_id IS NOT NULL")
                     .withColumn("arguments", F.array_sort(F.map_entries("arguments"))), keys, ["turn", "tool"]).withColumn("arguments", F.map_from_entries("arguments"))
    asked = base.stored(asked)
    said = first_of(results.select("conv_id", "turn", "call_id", "content").where("conv_id IS NOT NULL AND call_id IS NOT NULL"), keys, ["turn", "content"])
    edges = asked.select(*keys, F.explode("depends_on").alias("needs")).where("needs IS NOT NULL").distinct()
    there = asked.select("conv_id", F.col("call_id").alias("needs"))
    real = base.stored(edges.join(there, ["conv_id", "needs"], "left_semi"))
    level = levels(real.select(*keys, "needs"), asked, keys)
    missing = edges.join(there, ["conv_id", "needs"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))

    # schemas are a list of tools, one row for each argument: joined by tool, one row per call
    spec = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("name", "type", "required"))).alias("spec"))
    known = F.transform("spec", lambda s: s["name"])
    value = lambda s: F.try_element_at(F.col("arguments"), s["name"])
    mistyped = lambda s: F.coalesce(F.when(s["type"] == "integer", ~value(s).rlike(TYPES["integer"])).when(s["type"] == "number", ~value(s).rlike(TYPES["number"]))
                                    .when(s["type"] == "boolean", ~value(s).rlike(TYPES["boolean"])), F.lit(False))
    errors = F.when(F.col("spec").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(
        F.transform(F.filter("spec", lambda s: s["required"] & value(s).isNull()), lambda s: F.concat(F.lit("missing "), s["name"])),
        F.transform(F.filter("spec", mistyped), lambda s: F.concat(F.lit("type "), s["name"])),
        F.transform(F.filter(F.coalesce(F.map_keys("arguments"), F.array().cast("array<string>")), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown "), k)))))

    answered = said.select(*keys, F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("result_repeats"))
    rows = asked.join(answered, keys, "full").join(level, keys, "left").join(missing, keys, "left").join(spec, "tool", "left")
    call_json = canonical(arguments=canonical_map(F.col("arguments")), id=quoted(F.col("call_id")), name=quoted(F.col("tool")),
                          result=quoted(F.col("content")), type=F.lit('"tool_call"'))
    orphan_json = canonical(content=quoted(F.col("content")), id=quoted(F.col("call_id")), type=F.lit('"orphan_result"'))
    orphan = F.col("turn").isNull() & F.col("depends_on").isNull() & F.col("repeats").isNull()
    status = (F.when(orphan, "ORPHAN_RESULT").when(F.col("level").isNull(), "CYCLE").when(F.col("result_turn").isNull() & F.col("result_repeats").isNull(), "UNANSWERED")
              .when(F.col("result_turn") < F.col("turn"), "ANSWERED_TOO_EARLY").otherwise("LINKED"))
    out = rows.select(
        *keys, "turn", "result_turn", "tool", status.alias("status"), "level", F.coalesce("missing", F.lit(0)).alias("missing_dependencies"),
        (F.coalesce("repeats", F.lit(0)) + F.coalesce("result_repeats", F.lit(0))).alias("repeated"),
        F.when(~orphan, F.array_join(errors, ", ")).alias("argument_errors"), F.when(orphan, orphan_json).otherwise(call_json).alias("json"))
    return out


def in_order(linked: DataFrame) -> DataFrame:
    """`position` of every call in its conversation: by level, then turn, then identifier; cycles and orphans last.

    The window holds one conversation. Its sort spills, and no list of it is
    collected into a row.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_last(), "call_id")
    return linked.withColumn("position", F.row_number().over(w))


# ---- query over conversations ---------------------------------------------

def calls_of(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls and assistant turns as their results.

    A user turn t asks the tool `reply` with its text, its word count and its
    turn; the assistant turn t + 1 answers it. Every later call of the
    conversation uses the result of the call two turns before it.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    t = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    calls = m.where("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"),
        F.create_map(F.lit("text"), F.col("text"), F.lit("words"), words.cast("string"), F.lit("turn"), F.col("turn").cast("string")).alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("depends_on"))
    results = m.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SCHEMAS = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("reply", "words", "integer", False)]


def op9_tool_links(spark, sf_dir: str) -> DataFrame:
    calls, results = calls_of(base.table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean")
    out = in_order(link(calls, results, schemas))
    return out.select("conv_id", "call_id", "turn", "result_turn", "tool", "status", "level", "missing_dependencies", "repeated", "argument_errors", "json", "position")


# The given conversations have unique turns; their chains have no cycle.
OP9_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, 'call_' || turn AS call_id, text, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS words FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text FROM m WHERE role = 'assistant'),
lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.turn AS result_turn, c.text AS asked, c.words, r.text AS said FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
e AS (SELECT j.*, lv.level,
  '"' || replace(replace(replace(replace(replace(asked, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS qa,
  '"' || replace(replace(replace(replace(replace(said, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS qs FROM j LEFT JOIN lv ON j.conv_id = lv.conv_id AND j.turn = lv.turn)
SELECT conv_id, call_id, turn, result_turn, CASE WHEN turn IS NOT NULL THEN 'reply' END AS tool,
 CASE WHEN turn IS NULL THEN 'ORPHAN_RESULT' WHEN result_turn IS NULL THEN 'UNANSWERED' ELSE 'LINKED' END AS status, level,
 CASE WHEN turn IS NOT NULL AND level = 0 THEN 1 ELSE 0 END::BIGINT AS missing_dependencies, 0::BIGINT AS repeated,
 CASE WHEN turn IS NOT NULL THEN CASE WHEN asked IS NULL THEN 'missing text' ELSE '' END END AS argument_errors,
 CASE WHEN turn IS NULL THEN '{' || coalesce('"content":' || qs || ',', '') || '"id":"' || call_id || '","type":"orphan_result"}'
  ELSE '{"arguments":{' || coalesce('"text":' || qa || ',', '') || '"turn":"' || turn || '","words":"' || words || '"},"id":"' || call_id || '","name":"reply",' || coalesce('"result":' || qs || ',', '') || '"type":"tool_call"}' END AS json,
 CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn NULLS LAST, call_id) AS INTEGER) AS position FROM e"""
