"""Signals, statistics of given trades, target weights and the paper book."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.windows import bar_window, full_mean, running
from asofia.operators import analytics as pa, indicators as ti
from asofia.operators.ranks import exact_quantiles
from asofia.sources.session import durable

# The default walk-forward grid.
GRID_AXES = {"fast": (10, 20), "slow": (60, 120), "rsi_min": (40, 45), "rsi_max": (68,),
             "stop_loss": (-.05, -.08), "take_profit": (.12, .20), "min_hold": (5,)}
ATR_MULTIPLE = 3.0
COMMISSION, SELL_TAX, SLIPPAGE = .00015, .0018, .0005


def default_grid() -> list[dict]:
    rows = [dict(zip(GRID_AXES, values)) for values in itertools.product(*GRID_AXES.values())]
    return [{"param_id": i, **row} for i, row in enumerate(r for r in rows if r["fast"] < r["slow"])]


def indicator_columns(bars: DataFrame, fasts: Sequence[int] = GRID_AXES["fast"],
                      slows: Sequence[int] = GRID_AXES["slow"]) -> DataFrame:
    """Everything the trading rules look at, for all grid windows in one pass."""
    w = bar_window()
    df = ti.atr(ti.rsi(bars))
    df = df.withColumns({f"ma{n}": full_mean(F.col("close"), n, w) for n in {*fasts, *slows}})
    return df.withColumns({f"slope{n}": F.col(f"ma{n}") - F.lag(f"ma{n}", 5).over(w) for n in slows})


def entry_signal(bars: DataFrame, fast: int = 20, slow: int = 60, rsi_min: float = 40, rsi_max: float = 68,
                 confirm: bool = True) -> DataFrame:
    """Buy at this open because of the previous close."""
    df = indicator_columns(bars, (fast,), (slow,))
    ok = ((F.col(f"ma{fast}") > F.col(f"ma{slow}")) & (F.col("close") >= F.col(f"ma{fast}"))
          & F.col("rsi14").between(rsi_min, rsi_max))
    if confirm:
        ok = ok & (F.col(f"slope{slow}") > 0)
    staged = df.withColumn("_today", F.coalesce(ok, F.lit(False)))
    return staged.withColumn("entry_signal", F.coalesce(F.lag("_today").over(bar_window()), F.lit(False))).drop("_today")


def exit_flags(bars: DataFrame, fast: int = 20, slow: int = 60, stop_loss: float = -.05,
               atr_multiple: float = ATR_MULTIPLE) -> DataFrame:
    """The parts of the exit rule that do not depend on the entry."""
    df = indicator_columns(bars, (fast,), (slow,))
    f, s = F.col(f"ma{fast}"), F.col(f"ma{slow}")
    ratio = F.coalesce(F.col("atr14") / F.col("close"), F.lit(abs(stop_loss) / 2))
    return df.withColumns({
        "trend_exit": F.coalesce((f < s) | (F.col("close") < s), F.lit(False)),
        "strong_trend": F.coalesce((f > s) & (F.col(f"slope{slow}") > 0) & (F.col("close") >= f), F.lit(False)),
        "atr_ratio": ratio,
        "trailing_width": F.greatest(F.lit(.07), F.least(F.lit(.20), ratio * atr_multiple)),
        "volatility_stop": -F.greatest(F.lit(abs(stop_loss)), F.least(F.lit(.15), ratio * 2))})


def trade_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Win rate, profit factor (infinite without losses), mean holding, count."""
    r = F.col("return_pct")
    won, lost = F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), (F.avg((r > 0).cast("double")) * 100).alias("win_rate"),
        F.when(lost > 0, won / lost).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        F.avg("holding_days").alias("avg_holding_days"))


def param_variants(base: DataFrame) -> DataFrame:
    """The base parameters and every one-at-a-time neighbour, without repeats."""
    b = {c: F.col(c) for c in ("fast", "slow", "rsi_max", "stop_loss", "take_profit")}

    def variant(**change: Column) -> Column:
        return F.struct(*[change.get(n, c).alias(n) for n, c in b.items()])

    rows = [variant(), variant(fast=F.greatest(F.lit(5), b["fast"] - 5)), variant(fast=b["fast"] + 5),
            variant(slow=F.greatest(b["fast"] + 10, b["slow"] - 20)), variant(slow=b["slow"] + 20),
            variant(rsi_max=b["rsi_max"] - 3), variant(rsi_max=b["rsi_max"] + 3),
            variant(stop_loss=b["stop_loss"] - .02), variant(stop_loss=b["stop_loss"] + .02),
            variant(take_profit=b["take_profit"] - .05), variant(take_profit=b["take_profit"] + .05)]
    keys = [c for c in base.columns if c not in b]
    return base.select(*keys, F.explode(F.array_distinct(F.array(*rows))).alias("v")).select(*keys, "v.*")


def score_params(results: DataFrame, by: Sequence[str], min_trades: int) -> DataFrame:
    """Penalised score per parameter set and the best one per group."""
    score = F.when(F.col("trades") < min_trades, F.lit(-10_000.0) + F.col("trades")).otherwise(
        F.col("cagr") + F.col("sharpe") * 3 + F.col("mdd") * .20
        + (F.col("cagr") - F.col("benchmark_cagr")) * .25 - F.col("total_cost") / 1_000_000)
    scored = results.withColumn("score", score)
    return scored.groupBy(*by).agg(
        F.max_by(F.struct("param_id", "score"), F.struct("score", -F.col("param_id"))).alias("b")).select(
        *by, F.col("b.param_id").alias("param_id"), F.col("b.score").alias("score"))


def sensitivity(details: DataFrame, by: Sequence[str]) -> DataFrame:
    """Robustness over the variants of one base; the exact median comes from ranks."""
    median = exact_quantiles(details, "return_pct", by, {"median_return": .5})
    out = details.groupBy(*by).agg(
        (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("positive_rate"),
        (F.avg((F.col("excess_return") > 0).cast("double")) * 100).alias("beat_rate"),
        F.stddev_pop("return_pct").alias("dispersion")).join(median, list(by))
    calm = ((F.col("positive_rate") >= 80) & (F.col("beat_rate") >= 60)
            & (F.col("dispersion") <= F.greatest(F.abs("median_return"), F.lit(1.0))))
    return out.withColumn("verdict", F.when(calm, "안정").otherwise("민감"))


AHEAD = 32   # steps of all paths of a block that are looked up at once
BOOTSTRAP_COLUMNS = ("simulations long, median_return double, return_p05 double, return_p95 double, loss_probability double,"
                     " median_mdd double, mdd_p05 double, verdict string")


def trade_bootstrap(trades: DataFrame, by: Sequence[str], sims: int = 5000, seed: int = 42) -> DataFrame:
    """Resampled compounded result and path drawdown of the trades of each report.

    Every trade of a group is resampled. A report is one security's trades, so a
    group is bounded by the calendar; paths are drawn in blocks of bounded size.
    """
    keys = trades.select(*by).schema

    def walk(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
        values = np.log1p(np.maximum(np.sort(day["return_pct"].dropna().to_numpy(float)) / 100, -.999999))
        n = len(values)
        if not n:
            return pd.DataFrame(columns=[*by, *(c.split()[0] for c in BOOTSTRAP_COLUMNS.split(", "))])
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        total, worst = _walks(values, sims, rng)
        result, mdd = np.expm1(total) * 100, np.minimum(np.expm1(worst), 0) * 100
        low, mid, high = np.quantile(result, (.05, .5, .95))
        loss, bad = (result < 0).mean() * 100, np.quantile(mdd, .05)
        steady = low > 0 and loss < 10 and bad > -40
        return pd.DataFrame([(*key, sims, mid, low, high, loss, np.median(mdd), bad, "안정" if steady else "주의")],
                            columns=[*by, *(c.split()[0] for c in BOOTSTRAP_COLUMNS.split(", "))])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + BOOTSTRAP_COLUMNS
    return trades.select(*by, "return_pct").groupBy(*by).applyInPandas(walk, schema)


def _walks(values: np.ndarray, sims: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sum and deepest fall below the highest point so far (at least 0) of ``sims`` paths of draws with replacement.

    Paths are drawn one after the other and walked side by side, ``AHEAD`` steps looked
    up at a time, so that what a step touches stays in the processor's cache.
    """
    n = len(values)
    total, worst = [], []
    for size in _blocks(sims, min(1_000, max(1, 2_000_000 // n))):
        drawn = rng.integers(0, n, (size, n), np.int32)
        path, peak, fall, deepest = np.zeros(size), np.zeros(size), np.empty(size), np.full(size, np.inf)
        ahead = np.empty((AHEAD, size))
        for at in range(0, n, AHEAD):
            near = np.ascontiguousarray(drawn[:, at:at + AHEAD].T)
            for step in np.take(values, near, out=ahead[:len(near)], mode="clip"):   # every index is in range
                np.add(path, step, out=path)
                np.maximum(peak, path, out=peak)
                np.subtract(path, peak, out=fall)
                np.minimum(deepest, fall, out=deepest)
        total.append(path)
        worst.append(deepest)
    return np.concatenate(total), np.concatenate(worst)


def _blocks(total: int, most: int) -> Iterator[int]:
    while total > 0:
        yield min(total, most)
        total -= most


# ---- weights ------------------------------------------------------------

def share_of_group(df: DataFrame, value: Column, by: Sequence[str], total: Column, out: str) -> DataFrame:
    """value / sum(value) * total per group; sums combine map-side and join back."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*by).agg(F.sum("_v").alias("_sum"))
    return df.join(sums, list(by)).withColumn(
        out, F.when(F.col("_sum") > 0, F.col("_v") / F.col("_sum") * total).otherwise(0.0)).drop("_v", "_sum")


def inverse_risk(df: DataFrame, core_budget: Column, tactical_budget: Column, by: Sequence[str] = ("date",)) -> DataFrame:
    """Core weights over all securities, tactical ones over the eligible, by inverse daily risk."""
    risk = F.greatest(F.col("atr14") / F.col("close"), F.col("vol60") / F.sqrt(F.lit(252.0)), F.lit(.005))
    known = F.col("atr14").isNotNull() & F.col("vol60").isNotNull()
    df = df.withColumn("inverse_risk", F.when(known, 1 / risk))
    base = F.coalesce("inverse_risk", F.lit(0.0))
    df = share_of_group(df, base, by, core_budget, "core_weight")
    return share_of_group(df, F.when(F.col("eligible"), base).otherwise(0.0), by, tactical_budget, "tactical_weight")


def cap_weights(df: DataFrame, raw: str, stock_cap: float, sector_cap: float, total: Column,
                by: Sequence[str] = ("date",), rounds: int = 4) -> DataFrame:
    """Normalise to the total, then alternately clip stocks and scale sectors; (code, by) is unique.

    A round needs the sum of each sector, taken over all rows by partial
    aggregation, and the row again. Rounds work on the key columns alone and
    each is written once, so the plan does not grow with their number.
    """
    row, keys = ["code", *by], [*by, "industry"]
    start = df.withColumn("_raw", F.greatest(F.coalesce(F.col(raw), F.lit(0.0)), F.lit(0.0)))
    narrow = durable(share_of_group(start, F.col("_raw"), by, total, "weight").select(*row, "industry", "weight"))
    for _ in range(rounds):
        clipped = narrow.withColumn("weight", F.least(F.col("weight"), F.lit(stock_cap)))
        sector = clipped.groupBy(*keys).agg(F.sum("weight").alias("_s"))
        narrow = durable(clipped.join(sector, keys).select(*row, "industry", F.when(
            F.col("_s") > sector_cap, F.col("weight") * (F.lit(sector_cap) / F.col("_s"))).otherwise(F.col("weight")).alias("weight")))
    return df.drop("weight").join(narrow.select(*row, "weight"), row)


def rebalance_dates(bars: DataFrame, freq: str = "monthly") -> DataFrame:
    """First day per month or quarter on which every security traded."""
    codes = bars.agg(F.countDistinct("code")).scalar()
    common = bars.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == codes)
    day = F.to_date("date", "yyyyMMdd")
    period = F.date_format(day, "yyyyMM") if freq == "monthly" else F.concat(
        F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return common.groupBy(period.alias("rebalance_period")).agg(F.min("date").alias("rebalance_date"))


def target_book(ranking: DataFrame, top_n: int, exposure: Column, stock_cap: float = .20, sector_cap: float = .35,
                by: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    """Best eligible securities weighted by score over volatility, under the caps.

    ``row_number <= top_n`` with a literal is pruned before the exchange, so a
    portfolio's candidates never meet in one task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("total_score"), F.asc("code"))
    best = ranking.where("eligible").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n).drop("_k")
    raw = F.greatest(F.col("total_score"), F.lit(1.0)) / F.greatest(F.col("volatility_60"), F.lit(5.0))
    best = share_of_group(best.withColumn("raw", raw), F.col("raw"), by, exposure, "uncapped_weight")
    return cap_weights(best, "raw", stock_cap, sector_cap, exposure, by).withColumnRenamed("weight", "target_weight")


def book_equity(positions: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    value = positions.join(prices, "code").groupBy("portfolio_id").agg(
        F.sum(F.col("quantity") * F.col("price")).alias("market_value"))
    return cash.join(value, "portfolio_id", "left").withColumn(
        "market_value", F.coalesce("market_value", F.lit(0.0))).withColumn(
        "equity", F.col("cash") + F.col("market_value"))


def order_candidates(targets: DataFrame, positions: DataFrame, prices: DataFrame, equity: DataFrame,
                     band: float = .01, min_order: float = 10_000) -> DataFrame:
    """Target and current quantity per (portfolio, code) with the reason not to trade, if any."""
    both = targets.select("portfolio_id", "code", "target_weight").join(
        positions.select("portfolio_id", "code", "quantity", "average_price"), ["portfolio_id", "code"], "full_outer")
    df = both.join(prices, "code").join(equity.select("portfolio_id", "cash", "equity"), "portfolio_id")
    df = df.fillna(0, ["target_weight", "quantity", "average_price"])
    df = df.withColumn("target_quantity", F.floor(F.col("equity") * F.col("target_weight") / F.col("price")))
    df = df.withColumn("difference", F.col("target_quantity") - F.col("quantity"))
    gap = F.abs(F.col("target_weight") - F.col("quantity") * F.col("price") / F.greatest(F.col("equity"), F.lit(1.0)))
    return df.withColumns({
        "notional": F.abs("difference") * F.col("price"),
        "side": F.when(F.col("difference") < 0, "SELL").when(F.col("difference") > 0, "BUY"),
    }).withColumn("skip_reason", F.when(F.col("difference") == 0, "NO_QUANTITY_CHANGE")
                  .when(gap < band, "WITHIN_REBALANCE_BAND")
                  .when(F.col("notional") < min_order, "BELOW_MIN_ORDER"))


def proposals(candidates: DataFrame) -> DataFrame:
    """Sells first, then buys in code order out of the cash that is left.

    A portfolio holds at most its top-N targets plus its positions, so the
    buys of one portfolio fit a short array that ``aggregate`` folds with the
    remaining cash as its state.
    """
    go = candidates.where(F.col("skip_reason").isNull() & F.col("side").isNotNull())
    sells = go.where("side = 'SELL'").withColumn("filled", F.least(-F.col("difference"), F.col("quantity")))
    price = F.col("price")
    gain = F.col("filled") * price * (1 - SLIPPAGE) * (1 - COMMISSION - SELL_TAX)
    raised = sells.groupBy("portfolio_id").agg(F.sum(gain).alias("_raised"))
    wish = go.where("side = 'BUY'").groupBy("portfolio_id", "cash").agg(
        F.array_sort(F.collect_list(F.struct("code", F.col("difference").alias("want"), "price"))).alias("_w"))
    zero = F.struct(F.col("_c").alias("cash"), F.array().cast("array<struct<code:string,filled:bigint>>").alias("fills"))

    def spend(state, x):
        unit = x.price * (1 + SLIPPAGE)
        n = F.greatest(F.least(x.want, F.floor(state.cash / (unit * (1 + COMMISSION)))), F.lit(0).cast("bigint"))
        return F.struct((state.cash - n * unit * (1 + COMMISSION)).alias("cash"),
                        F.concat(state.fills, F.array(F.struct(x.code.alias("code"), n.alias("filled")))).alias("fills"))

    filled = (wish.join(raised, "portfolio_id", "left")
              .withColumn("_c", F.col("cash") + F.coalesce("_raised", F.lit(0.0)))
              .withColumn("_s", F.aggregate("_w", zero, spend))
              .select("portfolio_id", F.explode("_s.fills").alias("f")).select("portfolio_id", "f.code", "f.filled"))
    buys = go.where("side = 'BUY'").join(filled, ["portfolio_id", "code"])
    rows = sells.unionByName(buys)
    sell = F.col("side") == "SELL"
    gross = F.col("filled") * price * F.when(sell, 1 - SLIPPAGE).otherwise(1 + SLIPPAGE)
    return rows.withColumns({
        "gross": gross, "commission": gross * COMMISSION, "tax": F.when(sell, gross * SELL_TAX).otherwise(0.0),
        "slippage": F.col("filled") * price * SLIPPAGE})


def skips(candidates: DataFrame, orders: DataFrame, ineligible: DataFrame | None = None) -> DataFrame:
    """Why a security was not traded."""
    base = candidates.where("skip_reason IS NOT NULL").select("portfolio_id", "code", F.col("skip_reason").alias("reason"))
    broke = orders.where((F.col("side") == "BUY") & (F.col("filled") <= 0)).select(
        "portfolio_id", "code", F.lit("INSUFFICIENT_CASH").alias("reason"))
    out = base.unionByName(broke)
    if ineligible is not None:
        out = out.unionByName(ineligible.select(
            "portfolio_id", "code", F.concat(F.lit("INELIGIBLE: "), "ineligible_reason").alias("reason")))
    return out


def attribution(positions: DataFrame, prices: DataFrame, prior_targets: DataFrame, equity: DataFrame) -> DataFrame:
    """Price contribution of each position and the opportunity cost of the caps."""
    df = positions.join(prices, "code").join(
        prior_targets.select("portfolio_id", "code", "uncapped_weight", "target_weight"), ["portfolio_id", "code"], "left")
    df = df.join(equity.select("portfolio_id", "equity"), "portfolio_id")
    lost = F.coalesce("uncapped_weight", F.lit(0.0)) - F.coalesce("target_weight", F.lit(0.0))
    return df.withColumns({
        "pnl_contribution": F.col("quantity") * (F.col("price") - F.col("previous_price")),
        "constraint_opportunity": F.col("equity") * lost * (F.col("price") / F.col("previous_price") - 1)})


def apply_fills(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """New quantity and average price (fees included); closed positions drop out."""
    done = orders.where("filled > 0").select("portfolio_id", "code", "side", "filled", "gross", "commission")
    df = positions.select("portfolio_id", "code", "quantity", "average_price").join(
        done, ["portfolio_id", "code"], "full_outer").fillna(0, ["quantity", "average_price", "filled", "gross", "commission"])
    buy = F.col("side") == "BUY"
    after = F.when(buy, F.col("quantity") + F.col("filled")).otherwise(F.col("quantity") - F.col("filled"))
    paid = (F.col("quantity") * F.col("average_price") + F.col("gross") + F.col("commission")) / (
        F.col("quantity") + F.col("filled"))
    return df.select("portfolio_id", "code", after.alias("quantity"),
                     F.when(buy, paid).otherwise(F.col("average_price")).alias("average_price")).where("quantity > 0")


def performance(positions: DataFrame, prices: DataFrame, cash: DataFrame, previous: DataFrame,
                benchmark_price: Column, initial_capital: float, target_exposure: float) -> DataFrame:
    """Equity, returns, benchmark value and exposure gap per portfolio."""
    df = book_equity(positions, prices, cash).join(previous, "portfolio_id", "left")
    bench = F.when(F.col("previous_benchmark_price") != 0,
                   F.col("previous_benchmark_value") * benchmark_price / F.col("previous_benchmark_price")
                   ).otherwise(F.lit(float(initial_capital)))
    return df.withColumns({
        "daily_return": F.coalesce(F.col("equity") / F.col("previous_equity") - 1, F.lit(0.0)),
        "cumulative_return": F.col("equity") / initial_capital - 1, "benchmark_value": bench,
        "exposure": F.col("market_value") / F.col("equity"), "target_exposure": F.lit(target_exposure)}).withColumns({
            "benchmark_return": F.col("benchmark_value") / initial_capital - 1,
            "exposure_gap": F.col("target_exposure") - F.col("exposure"),
            "cash_drag": F.when(F.col("previous_equity").isNotNull(), (1 - F.col("exposure")) * (
                F.col("benchmark_value") / F.col("previous_benchmark_value") - 1)).otherwise(0.0)})


def guard(requests: DataFrame, processed: DataFrame, registered: DataFrame, config: Sequence[str]) -> DataFrame:
    """Skip processed (portfolio, date) pairs; flag portfolios whose configuration changed."""
    hashed = requests.withColumn("config_hash", F.sha2(F.to_json(F.struct(*sorted(config))), 256))
    fresh = hashed.join(processed.select("portfolio_id", "date"), ["portfolio_id", "date"], "left_anti")
    known = registered.select("portfolio_id", F.col("config_hash").alias("_known"))
    return fresh.join(known, "portfolio_id", "left").withColumn(
        "accepted", F.col("_known").isNull() | (F.col("_known") == F.col("config_hash"))).drop("_known")


def aligned_date(bars: DataFrame) -> DataFrame:
    """Latest date per universe, whether all codes share it, and the oldest of them."""
    last = bars.groupBy("code").agg(F.max("date").alias("d"))
    return last.agg(F.count(F.lit(1)).alias("codes"), (F.min("d") == F.max("d")).alias("aligned"),
                    F.min("d").alias("aligned_date"), F.max("d").alias("latest_date"))


def book_report(curve: DataFrame, orders: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Drawdown, Sharpe, cost and turnover of a paper book with its observation stage."""
    m = pa.curve_metrics(curve, "equity", by)
    days = curve.groupBy(by).agg(F.countDistinct("date").alias("days"), F.avg("equity").alias("_eq"))
    cost = orders.groupBy(by).agg(F.sum(F.col("commission") + F.col("tax") + F.col("slippage")).alias("total_cost"),
                                  F.sum("gross").alias("_gross"))
    stage = (F.when(F.col("days") < 20, "COLLECTING").when(F.col("days") < 60, "EARLY")
             .when(F.col("days") < 120, "REVIEW").otherwise("MATURE"))
    return (m.join(days, by).join(cost, by, "left").withColumn("turnover", F.coalesce(F.col("_gross") / F.col("_eq"), F.lit(0.0)))
            .withColumns({"total_cost": F.coalesce("total_cost", F.lit(0.0)), "stage": stage}).drop("_eq", "_gross"))


def backfill_performance(perf: DataFrame, default_target: float) -> DataFrame:
    """Fill exposure, target and gap of older rows; the first day has no cash drag."""
    first = perf.groupBy("portfolio_id").agg(F.min("date").alias("_first"))
    df = perf.join(first, "portfolio_id").withColumns({
        "exposure": F.coalesce("exposure", 1 - F.col("cash") / F.col("equity")),
        "target_exposure": F.coalesce("target_exposure", F.lit(default_target))})
    return df.withColumns({"exposure_gap": F.coalesce("exposure_gap", F.col("target_exposure") - F.col("exposure")),
                           "cash_drag": F.when(F.col("date") == F.col("_first"), 0.0).otherwise(F.col("cash_drag"))}).drop("_first")


def lockbox_compare(curve: DataFrame, months: int = 12, value: str = "equity", by: str = "code") -> DataFrame:
    """Development period against the last months on the same metrics."""
    end = curve.agg(F.max(F.to_date("date", "yyyyMMdd"))).scalar()
    cut = F.date_format(F.add_months(end, -months), "yyyyMMdd")
    part = curve.withColumn("_cut", cut)
    dev = pa.curve_metrics(part.where(F.col("date") <= F.col("_cut")), value, by)
    box = pa.curve_metrics(part.where(F.col("date") > F.col("_cut")), value, by)
    names = [c for c in dev.columns if c != by]
    both = dev.withColumnsRenamed({n: f"development_{n}" for n in names}).join(
        box.withColumnsRenamed({n: f"lockbox_{n}" for n in names}), by)
    return both.withColumn("passed", F.coalesce((F.col("lockbox_cagr") > 0) & (
        F.col("lockbox_sharpe") >= F.col("development_sharpe") * .5), F.lit(False)))


def strategy_scorecard(bars: DataFrame, trades: DataFrame, min_trades: int = 1) -> DataFrame:
    """One row per code from its bars and a table of its trades; too few trades is a status, not a failure."""
    stats = trade_stats(trades, ["code"])
    total = trades.groupBy("code").agg(
        ((F.exp(F.sum(F.log1p(F.greatest(F.col("return_pct") / 100, F.lit(-.999999))))) - 1) * 100).alias("total_return"))
    hold = pa.buy_hold(bars).select("code", F.col("return_pct").alias("benchmark_return"))
    curve = pa.curve_metrics(bars, "close").select("code", "mdd", "sharpe")
    df = hold.join(curve, "code").join(stats, "code", "left").join(total, "code", "left")
    return df.withColumns({
        "trades": F.coalesce("trades", F.lit(0)), "total_return": F.coalesce("total_return", F.lit(0.0))}).withColumns({
            "excess_return": F.col("total_return") - F.col("benchmark_return"),
            "status": F.when(F.col("trades") < min_trades, "INSUFFICIENT_DATA").otherwise("OK")})


# ---- market exposure ------------------------------------------------------

def market_exposure(rows: DataFrame, by: Sequence[str] = ("period", "feature_date")) -> DataFrame:
    """Exposure limit from the median regime of the cross-section.

    The regime takes three values, so the exact median needs only their counts.
    """
    r = F.coalesce(F.col("market_regime"), F.lit(0))
    regime = F.percentile(r, .5).cast("int")
    return rows.groupBy(*by).agg(regime.alias("market_regime")).withColumn(
        "market_exposure_limit", F.when(F.col("market_regime") > 0, 1.0).when(F.col("market_regime") == 0, .70).otherwise(.40))
