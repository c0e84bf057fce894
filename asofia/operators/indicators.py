"""Technical indicators over daily bars.

Every function expects one row per (code, date) and adds columns. They share
one window specification, so a chain of them is planned with a single exchange
and a single sort by (code, date); a partition of that window holds one
security's calendar and nothing more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.windows import bar_window, full_mean, full_std, pct_change, running, trailing

YEAR_ROOT = math.sqrt(252)
MIN_HISTORY = 127


def sma(bars: DataFrame, periods: Sequence[int] = (5, 20, 60, 120)) -> DataFrame:
    w = bar_window()
    return bars.withColumns({f"ma{n}": full_mean(F.col("close"), n, w) for n in periods})


def rsi(bars: DataFrame, n: int = 14, flat: float | None = 50.0, out: str = "rsi14") -> DataFrame:
    """Relative strength from simple means; ``flat`` is the value of a flat stretch."""
    w = bar_window()
    delta = F.col("close") - F.lag("close").over(w)
    up = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    down = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    staged = bars.withColumns({"_up": up, "_down": down}).withColumns({
        "_gain": full_mean(F.col("_up"), n, w), "_loss": full_mean(F.col("_down"), n, w)})
    value = (F.when((F.col("_loss") == 0) & (F.col("_gain") == 0), F.lit(flat).cast("double"))
             .when(F.col("_loss") == 0, F.lit(100.0))
             .otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss"))))
    value = F.when(F.col("_gain").isNotNull() & F.col("_loss").isNotNull(), value)
    return staged.withColumn(out, value).drop("_up", "_down", "_gain", "_loss")


def returns(bars: DataFrame, periods: Sequence[int] = (1, 5, 20, 60, 126),
            scale: float = 1.0) -> DataFrame:
    w = bar_window()
    return bars.withColumns(
        {f"return_{n}": pct_change(F.col("close"), n, w) * scale for n in periods})


def volume_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume_change", pct_change(F.col("volume"), 1, bar_window()))


def true_range(has_range: bool = True) -> Column:
    previous = F.lag("close").over(bar_window())
    if not has_range:
        return F.abs(F.col("close") - previous)
    return F.greatest(F.abs(F.col("high") - F.col("low")),
                      F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def atr(bars: DataFrame, n: int = 14, out: str = "atr14") -> DataFrame:
    """Mean true range; close-to-close moves when the bars carry no high/low."""
    has_range = {"high", "low"} <= set(bars.columns)
    return (bars.withColumn("_tr", true_range(has_range))
            .withColumn(out, full_mean(F.col("_tr"), n, bar_window())).drop("_tr"))


def volatility(bars: DataFrame, periods: Sequence[int] = (20, 60), scale: float = 100.0) -> DataFrame:
    w = bar_window()
    staged = bars.withColumn("_r", pct_change(F.col("close"), 1, w))
    return staged.withColumns({
        f"volatility_{n}": full_std(F.col("_r"), n, w) * YEAR_ROOT * scale for n in periods}).drop("_r")


def ma_gap(bars: DataFrame, periods: Sequence[int] = (20, 60, 120)) -> DataFrame:
    w = bar_window()
    return bars.withColumns({
        f"ma_{n}_gap": (F.col("close") / full_mean(F.col("close"), n, w) - 1) * 100 for n in periods})


def ma_slope(bars: DataFrame, n: int, steps: Sequence[int] = (5, 20)) -> DataFrame:
    """Change of the n-bar mean over k bars."""
    w = bar_window()
    staged = bars.withColumn("_ma", full_mean(F.col("close"), n, w))
    return staged.withColumns({
        f"ma{n}_slope_{k}": F.col("_ma") - F.lag("_ma", k).over(w) for k in steps}).drop("_ma")


def liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn(f"liquidity_{n}",
                           full_mean(F.col("close") * F.col("volume"), n, bar_window()))


def regime_from_gap(gap: Column, band: float = 3.0) -> Column:
    return F.when(gap > band, 1).when(gap < -band, -1).otherwise(0)


def benchmark_features(benchmark: DataFrame) -> DataFrame:
    """Market context per date from the benchmark's own closes.

    One row per trading day, so the result is bounded by the calendar.
    """
    w = bar_window("benchmark_code")
    close = F.col("benchmark_close")
    base = benchmark.select(F.col("code").alias("benchmark_code"), "date",
                            F.col("close").alias("benchmark_close"))
    staged = base.withColumn("_r", pct_change(close, 1, w))
    return (staged.withColumns({
        "benchmark_return_20": pct_change(close, 20, w) * 100,
        "benchmark_return_60": pct_change(close, 60, w) * 100,
        "benchmark_ma_120_gap": (close / full_mean(close, 120, w) - 1) * 100,
        "benchmark_volatility_60": full_std(F.col("_r"), 60, w) * YEAR_ROOT * 100,
    }).withColumn("market_regime", regime_from_gap(F.col("benchmark_ma_120_gap")))
        .drop("_r"))


def with_market(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Left join on the date.

    ``market`` has one row per calendar day (366 a year at most), which is what
    makes the broadcast hint safe at any number of securities.
    """
    return bars.join(market, "date", "left")


def relative_returns(df: DataFrame, periods: Sequence[int] = (20, 60)) -> DataFrame:
    return df.withColumns({
        f"relative_{n}": F.col(f"return_{n}") - F.col(f"benchmark_return_{n}") for n in periods})


# Regime name, total exposure, core budget, in order of strength.
MARKET_BUDGETS = (("강한상승", .95, .70), ("상승", .75, .50), ("횡보", .45, .25), ("하락", .15, .05))


def market_budget(df: DataFrame) -> DataFrame:
    """Trend regime of a close series with its exposure and core budget."""
    w = bar_window()
    staged = df.withColumns({"_m60": full_mean(F.col("close"), 60, w),
                             "_m120": full_mean(F.col("close"), 120, w)})
    staged = staged.withColumn("_slope", F.col("_m120") - F.lag("_m120", 20).over(w))
    c, m60, m120 = F.col("close"), F.col("_m60"), F.col("_m120")
    level = (F.when((c > m120) & (m60 > m120) & (F.col("_slope") > 0), 0)
             .when(c > m120, 1).when(c >= m120 * .90, 2).otherwise(3))

    def pick(position: int) -> Column:
        out = None
        for i, row in enumerate(MARKET_BUDGETS):
            test = F.col("_level") == i
            out = F.when(test, row[position]) if out is None else out.when(test, row[position])
        return out

    return (staged.withColumn("_level", level)
            .withColumns({"budget_regime": pick(0), "exposure": pick(1), "core_budget": pick(2)})
            .drop("_m60", "_m120", "_slope", "_level"))


def price_regime(df: DataFrame, slow: int = 60, lookback: int = 60, band: float = .05) -> DataFrame:
    """Up / down / sideways from the slow mean and the momentum of the close."""
    w = bar_window()
    staged = df.withColumns({"_slow": full_mean(F.col("close"), slow, w),
                             "_mom": pct_change(F.col("close"), lookback, w)})
    label = (F.when((F.col("close") > F.col("_slow")) & (F.col("_mom") > band), "상승")
             .when((F.col("close") < F.col("_slow")) & (F.col("_mom") < -band), "하락")
             .otherwise("횡보"))
    return staged.withColumn("regime", label).drop("_slow", "_mom")


def drawdown_from_high(df: DataFrame, n: int = 126) -> DataFrame:
    high = F.max("close").over(trailing(bar_window(), n))
    return df.withColumn(f"drawdown_{n}", F.col("close") / high - 1)


def latest_momentum(bars: DataFrame, benchmark: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Last bar per code with 63 / 126 bar returns, risk and liquidity.

    Codes with too little history are dropped; a short benchmark counts as 0.
    """
    w = bar_window()
    b = bar_window()
    bench = (benchmark.withColumn("_b63", pct_change(F.col("close"), 63, b))
             .agg(F.max_by("_b63", "date").alias("_b63")))   # one row
    close = F.col("close")
    staged = bars.withColumn("_r", pct_change(close, 1, w)).withColumns({
        "_rn": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))),
        "_bars": F.count(F.lit(1)).over(Window.partitionBy("code")),
        "return_63": pct_change(close, 63, w), "return_126": pct_change(close, 126, w),
        "volatility_60": F.stddev_samp("_r").over(trailing(w, 60)) * YEAR_ROOT,
        "drawdown_126": close / F.max("close").over(trailing(w, 126)) - 1,
        "liquidity": F.avg(close * F.col("volume")).over(trailing(w, 20)),
    })
    last = staged.where((F.col("_rn") == 1) & (F.col("_bars") >= min_history))
    return (last.withColumn("relative_63", F.col("return_63") - F.coalesce(bench.scalar(), F.lit(0.0)))
            .select("code", "date", "close", "return_63", "return_126", "relative_63",
                    "volatility_60", "drawdown_126", "liquidity"))


def drawdown(curve: DataFrame, value: str = "equity", by: str = "code", order: str = "date") -> DataFrame:
    """Running maximum and drawdown of a value curve."""
    peak = F.max(value).over(running(bar_window(by, order)))
    return curve.withColumns({"peak": peak, "drawdown": F.col(value) / peak - 1})


def technical_score(df: DataFrame) -> DataFrame:
    """50 plus or minus 7/10/13 for three means, adjusted by RSI bands, in 0..100."""
    score = F.lit(50.0)
    for ma, weight in (("ma5", 7), ("ma20", 10), ("ma60", 13)):
        score = score + F.coalesce(
            F.when(F.col("close") >= F.col(ma), weight).when(F.col("close") < F.col(ma), -weight), F.lit(0))
    r = F.col("rsi14")
    band = F.when(r.between(45, 65), 5).when(r >= 75, -10).when(r <= 25, -5).otherwise(0)
    return df.withColumn("technical_score",
                         F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + band)), 2))


def technical_features(bars: DataFrame, benchmark: DataFrame,
                       min_history: int = MIN_HISTORY) -> DataFrame:
    """The price side of the feature store.

    Rows need a 126-bar return and a benchmark trend; codes need 127 bars.
    """
    df = bars.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("code")))
    df = returns(df, (5, 20, 60, 126), scale=100.0)
    df = volatility(df)
    df = rsi(df, flat=None, out="rsi_14")
    df = atr(df, out="_atr").withColumn("atr_14_pct", F.col("_atr") / F.col("close") * 100).drop("_atr")
    df = liquidity(ma_gap(df, (20, 60)))
    df = df.where((F.col("_bars") >= min_history) & F.col("return_126").isNotNull()).drop("_bars")
    df = relative_returns(with_market(df, benchmark_features(benchmark)))
    return df.where(F.col("benchmark_ma_120_gap").isNotNull()).withColumnRenamed("date", "feature_date")
