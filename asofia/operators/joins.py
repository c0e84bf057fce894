"""Time-aware joins without pair explosion.

Dates are days, so once both sides are reduced to one row per (key, day) a
window over a key is bounded by the calendar, however many rows the key has.
The reduction is a map-side combined aggregation; the answer is joined back
with an equi-join on (key, day) whose right side is unique, which AQE can split
when a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.norm import OPEN_END, day_number, to_day


def _stack(left: DataFrame, right: DataFrame, by: Sequence[str], forward: bool) -> DataFrame:
    """Answer per left row: the struct ``_r`` of the nearest right row at or before (after) it."""
    w = Window.partitionBy(*by)
    both = left.unionByName(right, allowMissingColumns=True)
    if forward:
        frame = w.orderBy(F.col("_ts").desc(), F.col("_side").asc())
    else:
        frame = w.orderBy("_ts", "_side")
    frame = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_hit", F.last("_r", ignorenulls=True).over(frame)).where(F.col("_side") == 1)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              take: Sequence[str], left_unique: bool = False, right_unique: bool = False,
              forward: bool = False) -> DataFrame:
    """Left join to the newest right row with right_ts <= left_ts (equality allowed).

    ``forward`` looks for the oldest right row with right_ts >= left_ts. The
    right columns travel in one struct, so a null field of the matched row is
    kept and not filled from an older row. Where a right key repeats on a day,
    the greatest row in the order of ``take`` is used. Left rows without a
    timestamp stay and match nothing.
    """
    by = list(by)
    facts = right.where(F.col(right_ts).isNotNull()).select(
        *by, F.col(right_ts).alias("_ts"), F.struct(*take).alias("_r"))
    if not right_unique:
        facts = facts.groupBy(*by, "_ts").agg(F.max("_r").alias("_r"))
    facts = facts.withColumn("_side", F.lit(0))
    fields = [F.col(f"_hit.{c}").alias(c) for c in take]
    if left_unique:
        rows = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"),
                           F.lit(1).alias("_side"))
        hit = _stack(rows, facts, by, forward)
        return hit.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns],
                          *[F.when(F.col("_ts").isNotNull(), f).alias(c) for c, f in zip(take, fields)])
    asked = left.where(F.col(left_ts).isNotNull()).select(*by, F.col(left_ts).alias("_ts")).distinct()
    hit = _stack(asked.withColumn("_side", F.lit(1)), facts, by, forward)
    answers = hit.where(F.col("_hit").isNotNull()).select(*by, F.col("_ts").alias(left_ts), *fields)
    return left.join(answers, [*by, left_ts], "left")


def asof_few(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str]) -> DataFrame:
    """As ``asof_join`` for a right side of few days per key, such as yearly reports.

    The right rows of a key travel as one sorted array, so the left side is
    neither stacked nor dealt anew where it already lies by the key.
    """
    by = list(by)
    facts = (right.where(F.col(right_ts).isNotNull()).groupBy(*by)
             .agg(F.sort_array(F.collect_list(F.struct(F.col(right_ts).alias("_ts"), F.struct(*take).alias("_r")))).alias("_facts")))
    hit = F.try_element_at(F.filter("_facts", lambda f: f["_ts"] <= F.col(left_ts)), F.lit(-1))["_r"]
    return (left.join(facts, by, "left").withColumn("_hit", hit)
            .select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in take]))


def on_day(left: DataFrame, right: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """Left join on (``by``, ``day``), a date as text, for one value of the right side, the greatest where a day repeats.

    The days of a key travel as one map, bounded by the calendar, so the left side
    is not dealt anew where it lies by the key.
    """
    facts = right.select(F.col(by).alias("_by"), F.col(day).cast("int").alias("_day"), value).where(F.col("_day").isNotNull()).repartition("_by")
    facts = facts.groupBy("_by", "_day").agg(F.max(value).alias(value)).groupBy("_by").agg(F.map_from_entries(F.collect_list(F.struct("_day", value))).alias("_of"))
    return left.join(facts, F.col(by) == F.col("_by"), "left").select(*left.columns, F.try_element_at("_of", F.col(day).cast("int")).alias(value))


def interval_join(df: DataFrame, history: DataFrame, by: str = "code", day: str = "feature_date") -> DataFrame:
    """Is the row's day inside a known membership interval, and inside an eligible one?

    Intervals may overlap. Instead of pairing rows with intervals, interval
    starts and ends are summed up along the calendar of the code.
    """
    end = F.least(F.coalesce(F.when(F.col("effective_to") != "", F.col("effective_to")), F.lit(OPEN_END)),
                  F.coalesce(F.when(F.col("delisting_date") != "", F.col("delisting_date")), F.lit(OPEN_END)))
    start = F.greatest("effective_from", "selection_known_at", "listing_date")
    spans = history.select(by, start.alias("a"), end.alias("b"),
                           F.col("liquidity_eligible").cast("int").alias("e")).where(F.col("a") <= F.col("b"))
    edges = spans.select(by, F.explode(F.array(
        F.struct(F.col("a").alias("_ts"), F.lit(0).alias("_side"), F.lit(1).alias("_c"), F.col("e").alias("_e")),
        F.struct(F.col("b").alias("_ts"), F.lit(2).alias("_side"), F.lit(-1).alias("_c"), (-F.col("e")).alias("_e"))))
        .alias("x")).groupBy(by, "x._ts", "x._side").agg(F.sum("x._c").alias("_c"), F.sum("x._e").alias("_e"))
    asked = df.select(by, F.col(day).alias("_ts")).distinct().withColumn("_side", F.lit(1))
    w = (Window.partitionBy(by).orderBy("_ts", "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = (asked.unionByName(edges, allowMissingColumns=True)
             .withColumns({"covered": F.coalesce(F.sum("_c").over(w), F.lit(0)) > 0,
                           "eligible": F.coalesce(F.sum("_e").over(w), F.lit(0)) > 0})
             .where(F.col("_side") == 1).select(by, F.col("_ts").alias(day), "covered", "eligible"))
    return df.join(swept, [by, day], "left")


def universe_audit(joined: DataFrame, history: DataFrame, by: str = "code",
                   day: str = "feature_date") -> DataFrame:
    n = history.groupBy(by).agg(F.count(F.lit(1)).alias("intervals"))
    rows = joined.groupBy(by).agg(
        F.min(day).alias("first_observed"), F.max(day).alias("last_observed"),
        F.count(F.lit(1)).alias("raw_rows"), F.count_if("eligible").alias("eligible_rows"),
        F.bool_and("covered").alias("coverage_complete"))
    return (rows.join(n, by, "left").withColumn("intervals", F.coalesce("intervals", F.lit(0)))
            .withColumn("excluded_rows", F.col("raw_rows") - F.col("eligible_rows"))
            .withColumn("history_status", F.when(F.col("coverage_complete"), "COVERED")
                        .otherwise("INCOMPLETE_HISTORY")))


def entry_exit(df: DataFrame, prices: DataFrame, benchmark: DataFrame, value: str = "close",
               entry: str = "feature_date", exit: str = "label_available_at") -> DataFrame:
    """Price at both ends of a label for the code and for the benchmark.

    The benchmark sides hold one row per calendar day and may be broadcast.
    """
    bench = benchmark.select("date", value)
    return (df.join(prices.select("code", F.col("date").alias(entry), F.col(value).alias("entry_price")),
                    ["code", entry], "left")
            .join(prices.select("code", F.col("date").alias(exit), F.col(value).alias("exit_price")),
                  ["code", exit], "left")
            .join(bench.toDF(entry, "benchmark_entry"), entry, "left")
            .join(bench.toDF(exit, "benchmark_exit"), exit, "left")
            .withColumn("price_covered", F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
                        & F.col("benchmark_entry").isNotNull() & F.col("benchmark_exit").isNotNull()))


def keep_in(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_in(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def coalesce_join(left: DataFrame, right: DataFrame, on: Sequence[str], column: str,
                  fallback: str) -> DataFrame:
    """Left equi-join where a missing right value falls back to a left column."""
    return left.join(right.select(*on, column), list(on), "left").withColumn(
        column, F.coalesce(column, fallback))


def calendar_context(events: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Last and last-but-one trading day before a date, first one at or after it.

    Both sides are reduced to distinct days first, so the single-partition
    windows run over one calendar.
    """
    days = calendar.select(F.col("date")).distinct()
    whole = Window.partitionBy(F.lit(0))
    lagged = days.withColumns({"_p1": F.lag("date", 1).over(whole.orderBy("date")), "_k": F.lit(0)})
    asked = events.where(to_day(day).isNotNull()).select(F.col(day)).distinct().withColumn("_k", F.lit(0))
    before = asked.withColumn("_eve", F.date_format(F.date_sub(F.to_date(day, "yyyyMMdd"), 1), "yyyyMMdd"))
    back = asof_join(before, lagged.select("_k", F.col("date").alias("prior_1"), F.col("_p1").alias("prior_2")),
                     ["_k"], "_eve", "prior_1", ["prior_1", "prior_2"], left_unique=True, right_unique=True)
    both = asof_join(back, lagged.select("_k", F.col("date").alias("next_or_same")), ["_k"], day,
                     "next_or_same", ["next_or_same"], left_unique=True, right_unique=True, forward=True)
    return events.join(both.drop("_k", "_eve"), day, "left")


def count_within(left: DataFrame, right: DataFrame, by: Sequence[str], left_day: str, right_day: str,
                 before: int, after: int, carry: str, prefix: str = "match") -> DataFrame:
    """Right rows of the same key whose day lies in [left - before, left + after].

    Adds their number and, when there is exactly one, the value of ``carry``.
    Right rows are counted per (key, day) and summed over a range frame, so no
    pair of rows is ever formed.
    """
    by = list(by)
    facts = (right.withColumn("_ts", day_number(right_day)).where(F.col("_ts").isNotNull())
             .groupBy(*by, "_ts").agg(F.count(F.lit(1)).alias("_n"), F.max(carry).alias("_one"))
             .withColumn("_side", F.lit(0)))
    asked = (left.withColumn("_ts", day_number(left_day)).where(F.col("_ts").isNotNull())
             .select(*by, "_ts").distinct().withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*by).orderBy("_ts").rangeBetween(-before, after)
    found = (asked.unionByName(facts, allowMissingColumns=True)
             .withColumns({"_sum": F.coalesce(F.sum("_n").over(w), F.lit(0)),
                           "_max": F.max("_one").over(w)})
             .where(F.col("_side") == 1)
             .select(*by, "_ts", F.col("_sum").alias(f"{prefix}_count"),
                     F.when(F.col("_sum") == 1, F.col("_max")).alias(f"{prefix}_only")))
    return (left.withColumn("_ts", day_number(left_day)).join(found, [*by, "_ts"], "left").drop("_ts")
            .withColumn(f"{prefix}_count", F.coalesce(f"{prefix}_count", F.lit(0))))


def match_status(count: Column, unique: str = "UNIQUE", many: str = "AMBIGUOUS", none: str = "NONE") -> Column:
    return F.when(count == 1, unique).when(count > 1, many).otherwise(none)


def latest_per_key(left: DataFrame, facts: DataFrame, on: Sequence[str], order: str,
                   take: Sequence[str]) -> DataFrame:
    """Left join to the newest fact per key, found by a combinable aggregate."""
    newest = facts.groupBy(*on).agg(F.max_by(F.struct(*take), order).alias("_f"))
    return left.join(newest, list(on), "left").select(
        *left.columns, *[F.col(f"_f.{c}").alias(c) for c in take])
