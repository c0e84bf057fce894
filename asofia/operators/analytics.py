"""Evaluation of scores and of the books built from them.

A book is two tables: ``holdings`` (scope, top_fraction, period, feature_date,
code, weight, ...) and ``periods`` (one row per scope, fraction and rebalance).
Changes between neighbouring rebalances come from one union of the holdings
with themselves shifted by one period and a combinable aggregate per code - no
self-join and no set columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.windows import bar_window, compound, pct_change, running
from asofia.operators.joins import entry_exit
from asofia.operators.labels import rebalance_index
from asofia.operators.ranks import average_rank, exact_quantiles, rank_columns, top_fraction
from asofia.sources.session import durable

BOOK = ["scope", "top_fraction"]
COSTS = {"commission": .015, "tax": .18, "slippage": .05}


# ---- information coefficient --------------------------------------------

def daily_ic(pred: DataFrame) -> DataFrame:
    """Spearman correlation of score and excess return per date; null on constant days."""
    both = pred.where(F.col("score").isNotNull() & F.col("excess_return").isNotNull()).select("feature_date", "score", "excess_return")
    ranked = average_rank(both, "score", ["feature_date"], "_a", pct=False)
    ranked = average_rank(ranked, "excess_return", ["feature_date"], "_b", pct=False)
    varied = (F.min("score") != F.max("score")) & (F.min("excess_return") != F.max("excess_return"))
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")   # 0 on a constant day, where F.corr would divide by it
    return ranked.groupBy("feature_date").agg(F.when(varied, F.covar_pop("_a", "_b") / F.nullif(spread, F.lit(0.0))).alias("rank_ic"))


def ic_rows(pred: DataFrame, horizon: int) -> DataFrame:
    flags = rebalance_index(pred, horizon).select("feature_date", "non_overlapping")
    return flags.join(daily_ic(pred), "feature_date", "left")


def ic_summary(ic: DataFrame) -> DataFrame:
    use = F.col("non_overlapping")
    return ic.agg(F.avg("rank_ic").alias("daily_rank_ic"),
                  F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_daily_ic_rate"),
                  F.avg(F.when(use, F.col("rank_ic"))).alias("nonoverlap_rank_ic"),
                  F.avg(F.when(use, (F.col("rank_ic") > 0).cast("double"))).alias("nonoverlap_ic_positive_rate"),
                  F.count(F.when(use, F.col("rank_ic"))).alias("independent_ic_periods"))


DRAW_MODULUS, DRAW_FACTOR = 2_147_483_647, 40_503


def counter_draw(sim: Column, step: Column, seed: int) -> Column:
    """A number below DRAW_MODULUS for each (sim, step); products stay far below 64 bits."""
    x = (sim.cast("long") * 1_640_531_527 + step.cast("long") * 362_437 + seed * 9_973 + 1) % DRAW_MODULUS
    for k in range(3):
        x = (x * (F.floor(x / 65_536) + DRAW_FACTOR) + F.floor(x / 7) + k) % DRAW_MODULUS
    return x


def bootstrap_draws(values: DataFrame, order: str, value: str, sims: int, seed: int) -> DataFrame:
    """(sim, step, value): every simulation draws as many values as there are.

    A draw is a number made of (seed, sim, step) by whole-number arithmetic,
    modulo the number of values, so it is the same on every run, after every
    retry and in any engine. Values are one per rebalance or per trade of one
    report; they are numbered once and joined.
    """
    known = values.where(F.col(value).isNotNull())
    whole = Window.partitionBy(F.lit(0))
    numbered = known.select(F.col(value).alias("value"), (F.row_number().over(whole.orderBy(order)) - 1).alias("pick"),
                            F.count(F.lit(1)).over(whole).alias("n"))
    size = known.agg(F.count(F.lit(1))).scalar()
    spark = values.sparkSession
    draws = (spark.range(sims).withColumnRenamed("id", "sim").withColumn("n", size).where(F.col("n") >= 2)
             .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
             .withColumn("pick", (counter_draw(F.col("sim"), F.col("step"), seed) % F.col("n")).cast("int")))
    return draws.select("sim", "step", "pick").join(numbered.select("pick", "value"), "pick")


def bootstrap_ci(values: DataFrame, order: str, value: str, sims: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean; no row values when fewer than two observations exist."""
    means = bootstrap_draws(values, order, value, sims, seed).groupBy("sim").agg(F.avg("value").alias("m"))
    return means.agg(F.percentile("m", .025).alias("ci_low"), F.percentile("m", .975).alias("ci_high"))


# ---- equal-weight books -------------------------------------------------

def book_holdings(rows: DataFrame, scope: str, fractions: Sequence[float] = (.1, .2, .3)) -> DataFrame:
    """Top fraction of every rebalance date, equally weighted (``rows`` from on_rebalance_days)."""
    picked = top_fraction(rows, fractions)
    return picked.withColumns({"scope": F.lit(scope), "weight": F.lit(1.0) / F.col("selected_count")})


def on_rebalance_days(pred: DataFrame, horizon: int) -> DataFrame:
    """Rows of every h-th date with their period number (one row per day is broadcast)."""
    days = rebalance_index(pred, horizon).where("non_overlapping").select(
        "feature_date", (F.col("day_index") / horizon).cast("int").alias("period"))
    return pred.join(F.broadcast(days), "feature_date")


def moves(holdings: DataFrame) -> DataFrame:
    """(scope, top_fraction, period, code, now, before) for every code held now or one period ago."""
    now = holdings.select(*BOOK, "period", "code", F.col("weight").alias("now"), F.lit(0.0).alias("before"))
    before = holdings.select(*BOOK, (F.col("period") + 1).alias("period"), "code", F.lit(0.0).alias("now"),
                             F.col("weight").alias("before"))
    return now.unionByName(before).groupBy(*BOOK, "period", "code").agg(
        F.sum("now").alias("now"), F.sum("before").alias("before"))


def turnover(holdings: DataFrame, commission: float = COSTS["commission"], tax: float = COSTS["tax"],
             slippage: float = COSTS["slippage"]) -> DataFrame:
    """Buys, sells, turnover and cost (percent) of each rebalance."""
    change = F.col("now") - F.col("before")
    flows = moves(holdings).groupBy(*BOOK, "period").agg(
        F.sum(F.greatest(change, F.lit(0.0))).alias("buys"), F.sum(F.greatest(-change, F.lit(0.0))).alias("sells"))
    return flows.withColumns({
        "turnover": F.col("buys") + F.col("sells"),
        "cost_pct": F.col("buys") * (commission + slippage) + F.col("sells") * (commission + slippage + tax)})


def book_periods(rows: DataFrame, holdings: DataFrame, **costs: float) -> DataFrame:
    """Gross, net, universe and index return of each rebalance."""
    cross = rows.groupBy("period", "feature_date").agg(
        F.count(F.lit(1)).alias("eligible_count"), F.avg("forward_return").alias("universe_return"),
        F.avg("benchmark_forward_return").alias("etf_return"))
    gross = holdings.groupBy(*BOOK, "period").agg(
        F.sum(F.col("weight") * F.col("forward_return")).alias("gross_return"),
        F.count(F.lit(1)).alias("selected_count"))
    return (gross.join(turnover(holdings, **costs), [*BOOK, "period"]).join(cross, "period")
            .withColumn("net_return", F.col("gross_return") - F.col("cost_pct"))
            .withColumns({"universe_excess_return": F.col("net_return") - F.col("universe_return"),
                          "etf_excess_return": F.col("net_return") - F.col("etf_return"),
                          "dual_win": (F.col("net_return") > F.col("universe_return"))
                          & (F.col("net_return") > F.col("etf_return"))}))


def transitions(holdings: DataFrame, pred_rows: DataFrame) -> DataFrame:
    """Codes added to and removed from the book, with their score and the cut-off."""
    cut = holdings.groupBy(*BOOK, "period", "feature_date").agg(F.min("score").alias("cutoff_score"))
    changed = moves(holdings).where((F.col("now") == 0) | (F.col("before") == 0))
    scores = pred_rows.select("period", "code", "score")
    kind = F.when(F.col("before") == 0, "ADDED").otherwise("REMOVED")
    return (changed.join(cut, [*BOOK, "period"]).join(scores, ["period", "code"], "left")
            .withColumns({"transition": kind, "reason": F.when(kind == "ADDED", "SCORE_ABOVE_CUTOFF")
                          .otherwise("SCORE_BELOW_CUTOFF")})
            .select(*BOOK, "feature_date", "code", "score", "cutoff_score", "transition", "reason"))


def contributions(holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """Gross, allocated cost and net contribution of each holding, and whether it was held before."""
    status = moves(holdings).where("now > 0").select(
        *BOOK, "period", "code", F.when(F.col("before") > 0, "HELD").otherwise("NEW").alias("position_status"))
    costed = holdings.join(periods.select(*BOOK, "period", "cost_pct"), [*BOOK, "period"])
    invested = costed.groupBy(*BOOK, "period").agg(F.sum("weight").alias("_w"))
    gross = F.col("weight") * F.col("forward_return")
    share = F.col("cost_pct") * F.col("weight") / F.greatest(F.col("_w"), F.lit(1e-12))
    return (costed.join(invested, [*BOOK, "period"]).join(status, [*BOOK, "period", "code"])
            .withColumns({"weighted_gross_contribution": gross, "allocated_cost_pct": share,
                          "weighted_net_contribution": gross - share}).drop("_w"))


def book_summary(periods: DataFrame, net: str = "net_return") -> DataFrame:
    """Compounded results of a book against the universe and the index."""
    growth = {n: compound(F.col(c) / 100) * 100 for n, c in
              (("net_return", net), ("universe_equal_weight_return", "universe_return"), ("etf_return", "etf_return"))}
    n, u, e = F.col(net), F.col("universe_return"), F.col("etf_return")
    rates = {"positive_vs_universe_rate": n > u, "positive_vs_etf_rate": n > e,
             "simultaneous_dual_win_rate": (n > u) & (n > e)}
    return periods.groupBy(*BOOK).agg(
        F.count(F.lit(1)).alias("periods"), *[c.alias(k) for k, c in growth.items()],
        *[F.avg(c.cast("double")).alias(k) for k, c in rates.items()],
        F.sum("turnover").alias("turnover"), F.sum("cost_pct").alias("total_cost_pct"),
    ).withColumns({
        "universe_net_excess_return": F.col("net_return") - F.col("universe_equal_weight_return"),
        "etf_net_excess_return": F.col("net_return") - F.col("etf_return")})


def concentration(contrib: DataFrame) -> DataFrame:
    """Held rate, loss periods, net and worst contribution per code, with warnings."""
    total = contrib.groupBy(*BOOK).agg(F.countDistinct("period").alias("total_periods"))
    net = F.col("weighted_net_contribution")
    rows = contrib.groupBy(*BOOK, "code").agg(
        F.count(F.lit(1)).alias("periods_held"), F.count_if(net < 0).alias("loss_periods"),
        F.sum(net).alias("net_contribution"), F.min(net).alias("worst_period_contribution"))
    return rows.join(total, BOOK).withColumn(
        "held_rate", F.col("periods_held") / F.col("total_periods")).withColumn(
        "warnings", F.concat_ws(" | ", F.when(F.col("held_rate") >= .80, "LONG_TERM_FIXED_HOLDING"),
                                F.when((F.col("loss_periods") >= 2) & (F.col("net_contribution") < 0), "REPEATED_LOSS")))


def portfolio_risk(holdings: DataFrame) -> DataFrame:
    """Largest stock and industry weight, Herfindahl index and size per date."""
    keys = [*BOOK, "feature_date"]
    by_industry = holdings.groupBy(*keys, "industry").agg(
        F.sum("weight").alias("w"), F.max("weight").alias("m"), F.sum(F.col("weight") ** 2).alias("h"),
        F.count(F.lit(1)).alias("c"))
    return by_industry.groupBy(*keys).agg(
        F.max("m").alias("max_stock_weight"), F.max("w").alias("max_industry_weight"),
        F.sum("h").alias("weight_hhi"), F.sum("c").alias("selected_count"))


def fixation(holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean Jaccard overlap of neighbouring books, highest held rate, mean turnover."""
    last = holdings.groupBy(*BOOK).agg(F.max("period").alias("_last"), F.min("period").alias("_first"),
                                       F.countDistinct("period").alias("_n"))
    overlap = (moves(holdings).groupBy(*BOOK, "period")
               .agg((F.count_if((F.col("now") > 0) & (F.col("before") > 0)) / F.count(F.lit(1))).alias("j"))
               .join(last, BOOK)
               .where((F.col("period") > F.col("_first")) & (F.col("period") <= F.col("_last"))))
    jaccard = overlap.groupBy(*BOOK).agg(F.avg("j").alias("mean_jaccard"))
    held = (holdings.groupBy(*BOOK, "code").agg(F.countDistinct("period").alias("k"))
            .groupBy(*BOOK).agg(F.max("k").alias("k")))
    flow = periods.groupBy(*BOOK).agg(F.avg("turnover").alias("mean_turnover"))
    return (held.join(last, BOOK).join(jaccard, BOOK, "left").join(flow, BOOK, "left")
            .withColumns({"mean_jaccard": F.coalesce("mean_jaccard", F.lit(1.0)),
                          "max_stock_held_rate": F.col("k") / F.col("_n")})
            .withColumns({"portfolio_fixed_flag": F.col("mean_jaccard") >= .80,
                          "single_stock_fixed_flag": F.col("max_stock_held_rate") >= .80})
            .drop("k", "_n", "_first", "_last"))


def persistence(holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """How long each code stays in the book and whether that paid off."""
    n = periods.groupBy(*BOOK).agg(F.countDistinct("period").alias("total_periods"))
    joined = holdings.join(periods.select(*BOOK, "period", "universe_return", "etf_return"), [*BOOK, "period"])
    w = Window.partitionBy(*BOOK, "code").orderBy("period")     # at most one row per rebalance day
    islands = joined.withColumn("_island", F.col("period") - F.row_number().over(w))
    islands = islands.withColumn("_run", F.count(F.lit(1)).over(Window.partitionBy(*BOOK, "code", "_island")))
    u = F.col("forward_return") - F.col("universe_return")
    e = F.col("forward_return") - F.col("etf_return")
    rows = islands.groupBy(*BOOK, "code").agg(
        F.count(F.lit(1)).alias("selected_periods"), F.max("_run").alias("max_consecutive_selections"),
        F.avg("forward_return").alias("mean_forward_return"), F.avg(u).alias("mean_universe_excess"),
        F.avg(e).alias("mean_etf_excess"), F.avg((u > 0).cast("double")).alias("positive_universe_excess_rate"),
        F.avg((e > 0).cast("double")).alias("positive_etf_excess_rate"))
    rows = rows.join(n, BOOK).withColumn("held_rate", F.col("selected_periods") / F.col("total_periods"))
    supported = ((F.col("positive_universe_excess_rate") >= .5) & (F.col("positive_etf_excess_rate") >= .5)
                 & (F.col("mean_universe_excess") > 0) & (F.col("mean_etf_excess") > 0))
    return rows.withColumn("persistent_flag", F.col("held_rate") >= .80).withColumn(
        "persistent_but_supported", F.col("persistent_flag") & supported)


def constraint_audit(holdings: DataFrame, periods: DataFrame, stock_cap: float = .15,
                     industry_cap: float = .40, tolerance: float = 1e-9) -> DataFrame:
    """Cap and exposure violations of every rebalance; periods without holdings count as zero."""
    keys = [*BOOK, "feature_date"]
    risk = portfolio_risk(holdings).select(*keys, "max_stock_weight", "max_industry_weight")
    df = periods.select(*keys, "target_exposure", "market_exposure_limit").join(risk, keys, "left").fillna(
        0.0, ["max_stock_weight", "max_industry_weight"])
    return df.withColumns({
        "stock_cap_violation": F.col("max_stock_weight") > stock_cap + tolerance,
        "industry_cap_violation": F.col("max_industry_weight") > industry_cap + tolerance,
        "exposure_violation": F.col("target_exposure") > F.col("market_exposure_limit") + tolerance})


def outlier_stress(contrib: DataFrame, periods: DataFrame) -> DataFrame:
    """Results of each book without its best contributor."""
    per_code = contrib.groupBy(*BOOK, "code").agg(F.sum("weighted_net_contribution").alias("c"))
    best = per_code.groupBy(*BOOK).agg(
        F.max_by("code", F.struct("c", "code")).alias("removed_code"), F.max("c").alias("removed_contribution_pct"))
    removed = (contrib.join(best, BOOK).where(F.col("code") == F.col("removed_code"))
               .groupBy(*BOOK, "period").agg(F.sum("weighted_net_contribution").alias("_gone")))
    stressed = periods.join(removed, [*BOOK, "period"], "left").withColumn(
        "stressed_net", F.col("net_return") - F.coalesce("_gone", F.lit(0.0)))
    out = book_summary(stressed, "stressed_net").select(
        *BOOK, F.col("net_return").alias("stressed_net_return"),
        F.col("universe_net_excess_return").alias("stressed_universe_excess_return"),
        F.col("etf_net_excess_return").alias("stressed_etf_excess_return"),
        F.col("simultaneous_dual_win_rate").alias("stressed_simultaneous_dual_win_rate"))
    return best.join(out, BOOK).withColumn("stressed_dual_positive",
                                           (F.col("stressed_universe_excess_return") > 0)
                                           & (F.col("stressed_etf_excess_return") > 0))


def monotonic(summary: DataFrame) -> DataFrame:
    """Does the excess fall as the fraction widens?"""
    def at(f: float) -> Column:
        return F.max(F.when(F.col("top_fraction") == f, F.col("universe_net_excess_return")))
    return summary.groupBy("scope").agg(
        F.coalesce((at(.1) >= at(.2)) & (at(.2) >= at(.3)), F.lit(False)).alias("monotonic"))


# ---- classifier and regime evaluation -----------------------------------

def auc_from_ranks(positives: Column, negatives: Column, rank_sum: Column) -> Column:
    """Area under the ROC curve; null when one class is missing."""
    return F.when((positives > 0) & (negatives > 0),
                  (rank_sum - positives * (positives + 1) / 2) / (positives * negatives))


def classification_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC, accuracy at .5, Brier score, mean and top-quintile excess per group.

    The rank behind the AUC and the quantile cut-off come from the same split
    ranking, so a group may be larger than a task.
    """
    by = list(by)
    base = pred if by else pred.withColumn("_whole", F.lit(0))
    keys = by or ["_whole"]
    base = base.select(*keys, "probability", "positive_excess", "excess_return")   # only these are stored and ranked
    cut = exact_quantiles(base, "probability", keys, {"_cut": .8})
    ranked = rank_columns(base, "probability", keys).join(cut, keys)
    y, p = F.col("positive_excess"), F.col("probability")
    rank = F.col("_first") + (F.col("_ties") - 1) / 2
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(y.cast("double")).alias("positive_rate"),
        auc_from_ranks(F.sum(y), F.sum(1 - y), F.sum(F.when(y == 1, rank))).alias("roc_auc"),
        F.avg(((p >= .5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg("excess_return").alias("mean_excess_return"),
        F.avg(F.when(p >= F.col("_cut"), F.col("excess_return"))).alias("top_quintile_excess_return"))
    return out.drop("_whole")


def regression_metrics(pred: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return pred.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def brier_skill(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Skill of the probabilities over a constant class rate."""
    by = list(by)
    rate = pred.groupBy(*by).agg(F.avg(F.col("positive_excess").cast("double")).alias("prior"))
    y, p, prior = F.col("positive_excess"), F.col("probability"), F.col("prior")
    scored = pred.join(rate, by).groupBy(*by, "prior").agg(
        F.avg((p - y) * (p - y)).alias("brier"), F.avg((prior - y) * (prior - y)).alias("prior_brier"))
    return scored.withColumn("brier_skill", F.when(F.col("prior_brier") != 0,
                                                   1 - F.col("brier") / F.col("prior_brier")))


def volatility_terciles(pred: DataFrame) -> DataFrame:
    """low / medium / high per (split, date); ranks are compared with quantiles of 1..n.

    Runs over the dates of a split, that is over one calendar.
    """
    daily = pred.select("split", "feature_date", "benchmark_volatility_60").distinct()
    w = Window.partitionBy("split")
    k = F.row_number().over(w.orderBy("benchmark_volatility_60", "feature_date"))
    n = F.count(F.lit(1)).over(w)
    staged = daily.withColumns({"_k": k, "_n": n}).where(F.col("_n") >= 3)
    step = (F.col("_n") - 1) / 3
    label = (F.when(F.col("_k") <= 1 + step, "low").when(F.col("_k") <= 1 + 2 * step, "medium").otherwise("high"))
    return staged.select("split", "feature_date", label.alias("volatility_regime"))


def regime_rows(pred: DataFrame) -> DataFrame:
    """Samples, AUC and means by market trend and by volatility tercile."""
    trend = pred.select("*", F.lit("market_trend").alias("dimension"), F.col("market_regime").cast("string").alias("regime"))
    vol = pred.join(volatility_terciles(pred), ["split", "feature_date"]).withColumns({
        "dimension": F.lit("market_volatility"), "regime": F.col("volatility_regime")}).drop("volatility_regime")
    keys = ["split", "dimension", "regime"]
    ranked = rank_columns(trend.unionByName(vol), "probability", keys)
    y = F.col("positive_excess")
    rank = F.col("_first") + (F.col("_ties") - 1) / 2
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        auc_from_ranks(F.sum(y), F.sum(1 - y), F.sum(F.when(y == 1, rank))).alias("roc_auc"),
        F.avg("excess_return").alias("mean_excess_return"), F.avg("probability").alias("mean_probability"))


# ---- audits -------------------------------------------------------------

def return_audit(data: DataFrame, prices: DataFrame, benchmark: DataFrame, horizon: int,
                 value: str = "close", tolerance: float = 1e-8) -> DataFrame:
    """Recompute sampled label returns from prices (or total-return indices) and compare."""
    sampled = on_rebalance_days(data, horizon)
    df = entry_exit(sampled, prices, benchmark, value)
    fwd = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    mkt = (F.col("benchmark_exit") / F.col("benchmark_entry") - 1) * 100
    return df.withColumns({
        "recomputed_return": fwd, "forward_return_difference": fwd - F.col("forward_return"),
        "recomputed_benchmark_return": mkt, "benchmark_return_difference": mkt - F.col("benchmark_forward_return"),
    }).withColumns({
        "label_return_match": F.abs("forward_return_difference") <= tolerance,
        "benchmark_return_match": F.abs("benchmark_return_difference") <= tolerance})


def return_audit_summary(audit: DataFrame, min_coverage: float = .999) -> DataFrame:
    ok = F.col("price_covered")
    return audit.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("comparable_rows"),
        F.avg(ok.cast("double")).alias("coverage_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("label_return_match").cast("double"))), F.lit(0.0)).alias("label_match_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("benchmark_return_match").cast("double"))), F.lit(0.0))
        .alias("benchmark_match_rate"),
    ).withColumn("coverage_verified", F.coalesce(F.col("coverage_rate") >= min_coverage, F.lit(False)))


FACT_COLUMNS = ["revenue_growth", "operating_margin", "roe", "debt_ratio", "operating_cash_flow_positive",
                "reported_eps", "estimated_bps"]


def pit_audit(rows: DataFrame, valuations: DataFrame) -> DataFrame:
    """Was every stored fact public on its feature date, and does its source row exist?"""
    source = valuations.select("code", F.col("snapshot_date").alias("valuation_snapshot_date"),
                               F.col("source").alias("valuation_source"))
    any_fact = F.lit(False)
    for c in FACT_COLUMNS:
        any_fact = any_fact | F.col(c).isNotNull()
    day = F.col("feature_date")

    def known(column: str, *limits: Column) -> Column:
        test = F.length(column) == 8
        for limit in limits:
            test = test & (F.col(column) <= limit)
        return F.coalesce(test, F.lit(False))

    df = rows.join(source, ["code", "valuation_snapshot_date"], "left").withColumns({
        "financial_fact_present": any_fact,
        "valuation_fact_present": F.col("valuation_per").isNotNull() | F.col("valuation_pbr").isNotNull(),
        "financial_date_valid": known("financial_disclosed_at", day),
        "valuation_date_valid": known("valuation_snapshot_date", day),
        "valuation_known_at_valid": known("valuation_known_at", F.col("valuation_snapshot_date"), day),
        "valuation_source_row_found": F.coalesce(F.col("valuation_source"), F.lit("")) != ""})
    return df.withColumn("row_valid", (~F.col("financial_fact_present") | F.col("financial_date_valid")) & (
        ~F.col("valuation_fact_present") | (F.col("valuation_date_valid") & F.col("valuation_known_at_valid")
                                            & F.col("valuation_source_row_found"))))


def pit_verdict(audit: DataFrame) -> DataFrame:
    full = (F.bool_and("row_valid") & F.bool_or("financial_fact_present") & F.bool_or("valuation_fact_present"))
    return audit.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("row_valid").alias("valid_rows"),
        F.count_if("financial_fact_present").alias("financial_fact_rows"),
        F.count_if("valuation_fact_present").alias("valuation_fact_rows"),
        F.when(full, "FULL_PIT_VERIFIED").otherwise("FINANCIAL_DISCLOSURE_PIT_PARTIAL").alias("status"))


def criteria_table(facts: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """(criterion, passed, verdict) from one row of facts; null counts as failed."""
    one = facts.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in criteria.items()])
    everything = F.lit(True)
    for n in criteria:
        everything = everything & F.col(n)
    pairs = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("passed")) for n in criteria])
    return one.select(F.explode(pairs).alias("p"), F.when(everything, "ADOPT").otherwise("RESEARCH_ONLY").alias("verdict")
                      ).select("p.criterion", "p.passed", "verdict")


def adoption_facts_criteria() -> dict[str, Column]:
    """The adoption tests over a one-row fact table (column names are the inputs)."""
    c = F.col
    # Names and limits of the criteria.
    return {
        "nested_purged_selection_completed": c("nested_folds") >= 3,
        "nested_selection_leakage_free": c("nested_clean"),
        "validation_untouched_during_selection": c("nested_clean"),
        "current_champion_preserved": c("champion_present"),
        "common_risk_overlay_applied_to_all_strategies": F.lit(True),
        "point_in_time_universe_verified": c("universe_verified"),
        "total_return_history_verified": c("total_return_verified"),
        "financial_disclosure_point_in_time_verified": c("financial_verified"),
        "corporate_action_input_verified": c("corporate_verified"),
        "nested_simultaneous_dual_win_rate_at_least_60pct": c("nested_dual_rate") >= .60,
        "validation_nonoverlap_rank_ic_positive": c("nonoverlap_rank_ic") > 0,
        "validation_nonoverlap_ic_ci_low_positive": c("nonoverlap_ic_ci_low") > 0,
        "minimum_12_independent_validation_periods": c("independent_ic_periods") >= 12,
        "validation_cumulative_dual_benchmark_positive": c("cumulative_dual_outperformance"),
        "validation_simultaneous_dual_win_rate_at_least_60pct": c("simultaneous_dual_win_rate") >= .60,
        "validation_top_fraction_monotonic": c("monotonic"),
        "validation_portfolio_not_fixed_jaccard": c("mean_jaccard") < .80,
        "validation_individual_stock_not_fixed": c("max_stock_held_rate") < .80,
        "persistent_stock_selection_economically_supported": c("unsupported_persistent") == 0,
        "validation_turnover_observed": c("mean_turnover") > 0,
        "validation_hard_constraints_no_violations": c("validation_constraints_ok"),
        "published_test_hard_constraints_no_violations": c("published_constraints_ok"),
        "single_top_contributor_removed_still_dual_positive": c("stressed_dual_positive"),
        "immutable_v3_lockbox_registered": c("lockbox_registered"),
        "fresh_v3_lockbox_after_research_cutoff": c("fresh_lockbox"),
        "fresh_lockbox_dual_benchmark_top20_positive": c("fresh_lockbox") & (c("published_universe_excess") > 0)
        & (c("published_etf_excess") > 0),
    }


def compare_scores(scored: dict[str, DataFrame], horizon: int) -> DataFrame:
    """One metrics row per (strategy, split) for champion and challenger side by side."""
    rows = None
    for name, pred in scored.items():
        ic = ic_summary(ic_rows(pred, horizon)).select(F.lit(name).alias("scope"), "nonoverlap_rank_ic",
                                                              "independent_ic_periods")
        on_days = durable(on_rebalance_days(pred, horizon))
        held = book_holdings(on_days, name, (.2,))
        book = book_summary(book_periods(on_days, held)).select(
            "scope", "universe_net_excess_return", "etf_net_excess_return", "positive_vs_universe_rate",
            "positive_vs_etf_rate")
        row = book.join(ic, "scope")
        rows = row if rows is None else rows.unionByName(row)
    return rows


# ---- curves -------------------------------------------------------------

def curve_metrics(curve: DataFrame, value: str = "equity", by: str = "code") -> DataFrame:
    """CAGR on 365.25-day years, maximum drawdown and Sharpe ratio (percent)."""
    w = bar_window(by)
    staged = curve.withColumns({"_r": pct_change(F.col(value), 1, w),
                                "_dd": F.col(value) / F.max(value).over(running(w)) - 1})
    day = F.to_date("date", "yyyyMMdd")
    out = staged.groupBy(by).agg(
        F.min_by(value, "date").alias("_a"), F.max_by(value, "date").alias("_b"),
        (F.datediff(F.max(day), F.min(day)) / 365.25).alias("_years"), (F.min("_dd") * 100).alias("mdd"),
        F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    return out.select(
        by, F.when((F.col("_years") > 0) & (F.col("_a") > 0),
                   (F.pow(F.col("_b") / F.col("_a"), 1 / F.col("_years")) - 1) * 100).alias("cagr"),
        "mdd", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))


def yearly(curve: DataFrame, value: str = "equity", by: str = "code") -> DataFrame:
    """Compounded return per calendar year; the first day of a curve counts as zero."""
    r = curve.withColumn("_r", F.coalesce(pct_change(F.col(value), 1, bar_window(by)), F.lit(0.0)))
    return r.groupBy(by, F.substring("date", 1, 4).cast("int").alias("year")).agg(
        (compound(F.col("_r")) * 100).alias("return_pct"))


def regime_performance(df: DataFrame, by: str = "code") -> DataFrame:
    """Days and compounded return of the close per price regime."""
    r = df.withColumn("_r", F.coalesce(pct_change(F.col("close"), 1, bar_window(by)), F.lit(0.0)))
    return r.groupBy(by, "regime").agg(F.count(F.lit(1)).alias("days"), (compound(F.col("_r")) * 100).alias("return_pct"))


def buy_hold(bars: DataFrame, capital: float = 100_000_000, commission: float = .00015,
             tax: float = .0018, slippage: float = .0005, by: str = "code") -> DataFrame:
    """Integer lots bought at the first open and sold at the last close, costs included."""
    ends = bars.groupBy(by).agg(F.min_by("open", "date").alias("_o"), F.max_by("close", "date").alias("_c"))
    entry = F.col("_o") * (1 + slippage)
    df = ends.withColumn("quantity", F.floor(F.lit(float(capital)) / (entry * (1 + commission))))
    cash = capital - F.col("quantity") * entry * (1 + commission)
    final = cash + F.col("quantity") * F.col("_c") * (1 - slippage) * (1 - commission - tax)
    return df.withColumn("final_value", final).withColumn(
        "return_pct", (F.col("final_value") / capital - 1) * 100).drop("_o", "_c")


def fold_rollup(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample results by stock, and by industry (fold mean first, then compounded)."""
    stock = folds.groupBy("code").agg(
        F.count(F.lit(1)).alias("folds"), (compound(F.col("return_pct") / 100) * 100).alias("oos_return"),
        (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("positive_rate"),
        F.avg("mdd").alias("mean_mdd"), F.avg("sharpe").alias("mean_sharpe"))
    per_fold = folds.groupBy("industry", "fold").agg(F.avg("return_pct").alias("r"))
    industry = per_fold.groupBy("industry").agg(
        F.count(F.lit(1)).alias("folds"), (compound(F.col("r") / 100) * 100).alias("oos_return"),
        (F.avg((F.col("r") > 0).cast("double")) * 100).alias("positive_rate"))
    return stock, industry


def stability(chosen: DataFrame, by: Sequence[str] = ("code",), pass_rate: float = .5) -> DataFrame:
    """Share of the most frequent parameter set over the folds."""
    counts = chosen.groupBy(*by, "param_id").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(*by).agg((F.max("k") / F.sum("k")).alias("stability")).withColumn(
        "verdict", F.when(F.col("stability") >= pass_rate, "통과").otherwise("주의"))


def equal_weight_returns(bars: DataFrame) -> DataFrame:
    """Mean daily return over all codes per date and its compounded curve."""
    r = bars.withColumn("_r", pct_change(F.col("close"), 1, bar_window()))
    daily = r.where(F.col("_r").isNotNull()).groupBy("date").agg(F.avg("_r").alias("daily_return"),
                                                               F.count(F.lit(1)).alias("codes"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)   # one calendar
    return daily.withColumn("curve", F.exp(F.sum(F.log1p("daily_return")).over(w)))
