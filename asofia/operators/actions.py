"""Corporate actions: total-return index, adjustment breaks, factor checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.windows import bar_window, running
from asofia.operators.joins import asof_join, calendar_context, count_within

# Action types whose effect on a price can be derived.
DERIVABLE = ("CASH_DIVIDEND", "STOCK_DIVIDEND", "BONUS_ISSUE", "SPLIT", "REVERSE_SPLIT")
COVERAGE_FLAGS = ("prices_complete", "dividends_complete", "corporate_actions_complete")


def total_return_index(bars: DataFrame, actions: DataFrame, start: str, end: str) -> DataFrame:
    """Index that starts at 100 and reinvests cash and factors on the effective day.

    Several actions of one day multiply their factors and add up their cash. A
    code with a non-positive gross return is marked and gets no index.
    """
    w = bar_window()
    daily = actions.groupBy("code", F.col("effective_date").alias("date")).agg(
        F.exp(F.sum(F.log("adjustment_factor"))).alias("factor"), F.sum("cash_amount").alias("cash"))
    df = bars.where(F.col("date").between(start, end)).select("code", "date", "close").join(daily, ["code", "date"], "left")
    gross = (F.col("close") * F.coalesce("factor", F.lit(1.0)) + F.coalesce("cash", F.lit(0.0))) / F.lag("close").over(w)
    df = df.withColumn("gross", F.coalesce(gross, F.lit(1.0)))
    whole = Window.partitionBy("code")
    df = df.withColumn("index_valid", F.min("gross").over(whole) > 0)
    return df.withColumn("total_return_index", F.when(F.col("index_valid"), 100 * F.exp(
        F.sum(F.log("gross")).over(running(w))))).drop("factor", "cash")


def coverage_gate(spec: dict, cutoff: str) -> list[str]:
    """Reasons why a coverage declaration may not be used (driver-side, one small record)."""
    reasons = [f"missing:{k}" for k in ("start", "end", "status", *COVERAGE_FLAGS) if k not in spec]
    if spec.get("status") != "PASS":
        reasons.append("status")
    reasons += [k for k in COVERAGE_FLAGS if spec.get(k) is not True]
    if str(spec.get("end", "")) > cutoff:
        reasons.append("cutoff")
    return reasons


def missing_prices(codes: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Codes without a single bar in the window."""
    return codes.select("code").distinct().join(bars.where(F.col("date").between(start, end)).select("code"),
                                                "code", "left_anti")


def unsupported_actions(actions: DataFrame, allowed: Sequence[str] = DERIVABLE) -> DataFrame:
    return actions.where(~F.col("action_type").isin(*allowed))


def split_direction(title: Column) -> Column:
    return F.when(title.contains("병합"), "REVERSE_SPLIT").when(title.contains("분할"), "SPLIT")


def adjustment_breaks(raw: DataFrame, adjusted: DataFrame, tolerance: float = .002) -> DataFrame:
    """Days on which adjusted / raw changes, with the factor of the change."""
    w = bar_window()
    both = raw.select("code", "date", F.col("close").alias("raw")).join(
        adjusted.select("code", "date", F.col("close").alias("adjusted")), ["code", "date"])
    df = both.withColumn("ratio", F.col("adjusted") / F.col("raw"))
    df = df.withColumn("previous_ratio", F.lag("ratio").over(w)).withColumn(
        "change", F.col("ratio") / F.col("previous_ratio") - 1)
    return df.where(F.abs("change") > tolerance).withColumn("factor", F.col("ratio") / F.col("previous_ratio"))


def market_factor_evidence(candidates: DataFrame, breaks: DataFrame, days: int = 10,
                           safe: Sequence[str] = ("SPLIT", "REVERSE_SPLIT", "BONUS_ISSUE")) -> DataFrame:
    """Confirm a factor when exactly one price break lies within ``days`` of the event."""
    facts = breaks.select("code", "date", F.struct("date", "factor").alias("hit"))
    df = count_within(candidates, facts, ["code"], "effective_date", "date", days, days, "hit", "break")
    status = (F.when(~F.col("action_type").isin(*safe), "UNSAFE_TYPE")
              .when(F.col("known_at") > F.col("effective_date"), "KNOWN_AFTER_EFFECTIVE")
              .when(F.col("break_count") == 0, "NO_BREAK").when(F.col("break_count") > 1, "AMBIGUOUS_BREAKS")
              .otherwise("VERIFIED"))
    df = df.withColumn("status", status)
    ok = F.col("status") == "VERIFIED"
    return df.withColumns({"market_date": F.when(ok, F.col("break_only.date")),
                           "market_factor": F.when(ok, F.col("break_only.factor"))}).drop("break_only")


def terp_check(terms: DataFrame, raw: DataFrame, adjusted: DataFrame, tolerance: float = .01) -> DataFrame:
    """Theoretical ex-rights price against the adjusted close of the last cum-rights day.

    ``terms``: code, allotment_ratio, issue_price.
    """
    both = raw.select("code", "date", F.col("close").alias("raw")).join(
        adjusted.select("code", "date", F.col("close").alias("adjusted")), ["code", "date"])
    changed = F.abs(F.col("adjusted") / F.col("raw") - 1) > 1e-9
    cum = both.groupBy("code").agg(
        F.max(F.when(changed, F.struct("date", "raw", "adjusted"))).alias("c"),
        F.max(F.when(changed, F.col("date"))).alias("_last"))
    first = both.join(cum.select("code", "_last"), "code").where(F.col("date") > F.col("_last")).groupBy("code").agg(
        F.min("date").alias("ex_date"))
    df = terms.join(cum.where("c IS NOT NULL"), "code").join(first, "code", "left")
    terp = (F.col("c.raw") + F.col("allotment_ratio") * F.col("issue_price")) / (1 + F.col("allotment_ratio"))
    df = df.select("code", F.col("c.date").alias("cum_date"), "ex_date", terp.alias("theoretical"),
                   F.col("c.adjusted").alias("adjusted_close"), (F.col("c.raw") / F.col("c.adjusted")).alias("factor"))
    return df.withColumn("gap", F.abs(F.col("adjusted_close") / F.col("theoretical") - 1)).withColumn(
        "verified", F.col("gap") <= tolerance)


def spinoff_audit(pairs: DataFrame, bars: DataFrame, tolerance: float = .05) -> DataFrame:
    """Value continuity of a spin-off.

    ``pairs``: surviving, distributed, event_date, surviving_ratio, distributed_ratio.
    """
    traded = bars.where("volume > 0").select("code", "date", "close")
    before = asof_join(pairs.withColumn("code", F.col("surviving")).withColumn(
        "eve", F.date_format(F.date_sub(F.to_date("event_date", "yyyyMMdd"), 1), "yyyyMMdd")),
        traded.select("code", F.col("date").alias("pre_date"), F.col("close").alias("pre_close")),
        ["code"], "eve", "pre_date", ["pre_date", "pre_close"], right_unique=True).drop("code", "eve")
    a = pairs.select("surviving", "distributed", "event_date").join(
        traded.select(F.col("code").alias("surviving"), "date", F.col("close").alias("s_close")), "surviving")
    joint = a.where(F.col("date") >= F.col("event_date")).join(
        traded.select(F.col("code").alias("distributed"), "date", F.col("close").alias("d_close")), ["distributed", "date"])
    first = joint.groupBy("surviving", "distributed").agg(
        F.min(F.struct("date", "s_close", "d_close")).alias("j"))
    df = before.join(first, ["surviving", "distributed"], "left")
    after = F.col("j.s_close") * F.col("surviving_ratio") + F.col("j.d_close") * F.col("distributed_ratio")
    return df.select("surviving", "distributed", "event_date", "pre_date", F.col("j.date").alias("first_joint_date"),
                     after.alias("post_value"), (after / F.col("pre_close") - 1).alias("boundary_return"),
                     (F.abs(F.col("surviving_ratio") + F.col("distributed_ratio") - 1) <= 1e-6).alias("ratios_sum_to_one")
                     ).withColumn("verified", F.coalesce(
                         (F.abs("boundary_return") <= tolerance) & F.col("ratios_sum_to_one"), F.lit(False)))


def spinoff_ledger(pairs: DataFrame, closes: DataFrame) -> DataFrame:
    """Two rows per event: what a holder of one old share has afterwards."""
    rows = F.array(
        F.struct(F.lit("SURVIVING").alias("role"), F.col("surviving").alias("code"), F.col("surviving_ratio").alias("units")),
        F.struct(F.lit("DISTRIBUTED").alias("role"), F.col("distributed").alias("code"), F.col("distributed_ratio").alias("units")))
    df = pairs.select("surviving", "event_date", F.explode(rows).alias("r")).select(
        F.col("surviving").alias("event_code"), "event_date", "r.*")
    return df.join(closes.select("code", "close"), "code", "left").withColumn("value", F.col("units") * F.col("close"))


def fractional_cash(ledger: DataFrame, quantities: Sequence[int]) -> DataFrame:
    """Whole shares and cash for fractions, for several holdings."""
    q = F.explode(F.array(*[F.lit(x) for x in quantities])).alias("held")
    df = ledger.select("*", q).withColumn("entitled", F.col("held") * F.col("units"))
    return df.withColumn("whole", F.floor(F.col("entitled") + 1e-12)).withColumn(
        "cash", (F.col("entitled") - F.col("whole")) * F.col("close"))


def bonus_check(terms: DataFrame, calendar: DataFrame) -> DataFrame:
    """Allotment, share counts and ex-date of a bonus issue agree; factor = 1 + allotment.

    ``terms``: code, allotment_ratio, shares_before, shares_after, record_date, ex_date.
    """
    df = calendar_context(terms, calendar, "record_date")
    counted = F.abs(F.col("shares_before") * (1 + F.col("allotment_ratio")) - F.col("shares_after")) < 1
    boundary = F.col("ex_date") == F.col("prior_1")
    return df.withColumns({"factor": 1 + F.col("allotment_ratio"), "shares_match": counted,
                           "ex_date_is_boundary": F.coalesce(boundary, F.lit(False))}).withColumn(
        "verified", F.col("shares_match") & F.col("ex_date_is_boundary"))
