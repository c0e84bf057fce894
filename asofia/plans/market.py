"""Queries over bars: technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofia.functions.rounding import snap, snap_sql as r
from asofia.functions.windows import bar_window
from asofia.operators import indicators as ti
from asofia.plans.registry import query
from asofia.plans.sqlbase import chg, mean, sql
from asofia.sources import derived as d


def out(df, keys, values, n=4):
    return df.select(*keys, *[snap(v, n).alias(v) for v in values])


def osql(cols, values, n=4):
    return ", ".join([*cols, *[f"{r(v, n)} AS {v}" for v in values]])


@query("moving_averages", "TI1", sql(
    f"SELECT {osql(['code', 'date'], ['ma5', 'ma20', 'ma60', 'ma120'])} FROM tech", "tech"))
def moving_averages(spark, sf):
    return out(ti.sma(d.bars(spark, sf)), ["code", "date"], ["ma5", "ma20", "ma60", "ma120"])


@query("rsi_14", "TI2", sql(f"SELECT {osql(['code', 'date'], ['rsi14'])} FROM tech", "tech"))
def rsi_14(spark, sf):
    return out(ti.rsi(d.bars(spark, sf)), ["code", "date"], ["rsi14"])


RET = ["return_1", "return_5", "return_20", "return_60", "return_126"]


@query("periodic_returns", "TI3", sql(
    f"SELECT code, date, {r('ret1*100')} AS return_1, {osql([], RET[1:])} FROM tech", "tech"))
def periodic_returns(spark, sf):
    return out(ti.returns(d.bars(spark, sf), scale=100.0), ["code", "date"], RET)


@query("volume_changes", "TI4", sql(
    f"SELECT code, date, {r(chg('CAST(volume AS DOUBLE)', 1))} AS volume_change FROM bars "
    "WINDOW w AS (PARTITION BY code ORDER BY date)", "bars"))
def volume_changes(spark, sf):
    return out(ti.volume_change(d.bars(spark, sf)), ["code", "date"], ["volume_change"])


@query("average_true_range", "TI5", sql(
    f"SELECT code, date, {r('atr14')} AS atr14, {r('atr14/close*100')} AS atr_14_pct FROM tech", "tech"))
def average_true_range(spark, sf):
    df = ti.atr(d.bars(spark, sf)).withColumn("atr_14_pct", F.col("atr14") / F.col("close") * 100)
    return out(df, ["code", "date"], ["atr14", "atr_14_pct"])


@query("atr_close_only", "TI5", sql(
    f"SELECT code, date, {r(mean('tr', 14))} AS atr14 FROM "
    "(SELECT code, date, abs(delta) AS tr FROM tech0) WINDOW w AS (PARTITION BY code ORDER BY date)", "tech0"))
def atr_close_only(spark, sf):
    return out(ti.atr(d.bars(spark, sf).drop("high", "low")), ["code", "date"], ["atr14"])


@query("annualized_volatility", "TI6", sql(
    f"SELECT {osql(['code', 'date'], ['volatility_20', 'volatility_60'])} FROM tech", "tech"))
def annualized_volatility(spark, sf):
    return out(ti.volatility(d.bars(spark, sf)), ["code", "date"], ["volatility_20", "volatility_60"])


@query("moving_average_gaps", "TI7", sql(
    f"SELECT code, date, {r('(close/ma20-1)*100')} AS ma_20_gap, {r('(close/ma60-1)*100')} AS ma_60_gap, "
    f"{r('(close/ma120-1)*100')} AS ma_120_gap FROM tech", "tech"))
def moving_average_gaps(spark, sf):
    return out(ti.ma_gap(d.bars(spark, sf)), ["code", "date"], ["ma_20_gap", "ma_60_gap", "ma_120_gap"])


@query("moving_average_slopes", "TI8", sql(
    f"SELECT code, date, {r('ma60-lag(ma60,5) OVER w')} AS ma60_slope_5, "
    f"{r('ma60-lag(ma60,20) OVER w')} AS ma60_slope_20 FROM tech WINDOW w AS (PARTITION BY code ORDER BY date)", "tech"))
def moving_average_slopes(spark, sf):
    return out(ti.ma_slope(d.bars(spark, sf), 60), ["code", "date"], ["ma60_slope_5", "ma60_slope_20"])


@query("trading_liquidity", "TI9", sql(
    f"SELECT {osql(['code', 'date'], ['liquidity_20'], 2)} FROM tech", "tech"))
def trading_liquidity(spark, sf):
    return out(ti.liquidity(d.bars(spark, sf)), ["code", "date"], ["liquidity_20"], 2)


CTX = ["benchmark_return_20", "benchmark_return_60", "benchmark_ma_120_gap", "benchmark_volatility_60"]


@query("benchmark_context", "TI10 J5", sql(
    f"SELECT t.code, t.date, {osql([], CTX)} FROM bars t LEFT JOIN market m ON t.date=m.date", "bars", "market"))
def benchmark_context(spark, sf):
    return out(ti.with_market(d.bars(spark, sf), ti.benchmark_features(d.benchmark(spark, sf))),
               ["code", "date"], CTX)


@query("relative_returns", "TI11", sql(
    f"""SELECT t.code, t.date, {r('return_20-benchmark_return_20')} AS relative_20,
 {r('return_60-benchmark_return_60')} AS relative_60 FROM tech t LEFT JOIN market m ON t.date=m.date""", "tech", "market"))
def relative_returns(spark, sf):
    df = ti.with_market(ti.returns(d.bars(spark, sf), (20, 60), 100.0),
                        ti.benchmark_features(d.benchmark(spark, sf)))
    return out(ti.relative_returns(df), ["code", "date"], ["relative_20", "relative_60"])


@query("market_regime", "TI12", sql(
    """SELECT date, CASE WHEN benchmark_ma_120_gap>3 THEN 1 WHEN benchmark_ma_120_gap<-3 THEN -1 ELSE 0 END AS market_regime
 FROM market""", "market"))
def market_regime(spark, sf):
    return ti.benchmark_features(d.benchmark(spark, sf)).select("date", "market_regime")


@query("market_budget", "TI13", sql(
    """SELECT code, date, CASE WHEN close>ma120 AND ma60>ma120 AND slope>0 THEN '강한상승' WHEN close>ma120 THEN '상승'
 WHEN close>=ma120*0.90::DOUBLE THEN '횡보' ELSE '하락' END AS budget_regime,
 CASE WHEN close>ma120 AND ma60>ma120 AND slope>0 THEN 0.95::DOUBLE WHEN close>ma120 THEN 0.75::DOUBLE
 WHEN close>=ma120*0.90::DOUBLE THEN 0.45::DOUBLE ELSE 0.15::DOUBLE END AS exposure,
 CASE WHEN close>ma120 AND ma60>ma120 AND slope>0 THEN 0.70::DOUBLE WHEN close>ma120 THEN 0.50::DOUBLE
 WHEN close>=ma120*0.90::DOUBLE THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END AS core_budget
 FROM (SELECT *, ma120-lag(ma120,20) OVER (PARTITION BY code ORDER BY date) AS slope FROM tech)""", "tech"))
def market_budget(spark, sf):
    return ti.market_budget(d.bars(spark, sf)).select("code", "date", "budget_regime", "exposure", "core_budget")


@query("price_regime", "TI14", sql(
    """SELECT code, date, CASE WHEN close>ma60 AND return_60>5 THEN '상승' WHEN close<ma60 AND return_60<-5 THEN '하락'
 ELSE '횡보' END AS regime FROM tech""", "tech"))
def price_regime(spark, sf):
    return ti.price_regime(d.bars(spark, sf)).select("code", "date", "regime")


@query("drawdown_from_high", "TI15", sql(
    f"""SELECT code, date, {r('close/max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)-1', 6)}
 AS drawdown_126 FROM bars""", "bars"))
def drawdown_from_high(spark, sf):
    return out(ti.drawdown_from_high(d.bars(spark, sf)), ["code", "date"], ["drawdown_126"], 6)


MOM = ["return_63", "return_126", "relative_63", "volatility_60", "drawdown_126", "liquidity"]
MOMENTUM_SQL = f"""SELECT t.code, t.date, t.close, r63 AS return_63, r126 AS return_126,
 r63-coalesce((SELECT {chg('close', 63)} AS x FROM bench WINDOW w AS (ORDER BY date) ORDER BY date DESC LIMIT 1),0) AS relative_63,
 v AS volatility_60, dd AS drawdown_126, lq AS liquidity FROM (
 SELECT code, date, close, nbars, {chg('close', 63)} AS r63, {chg('close', 126)} AS r126,
 stddev_samp(ret1) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)*sqrt(252::DOUBLE) AS v,
 close/max(close) OVER (w ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)-1 AS dd,
 avg(close*volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lq,
 row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM tech0
 WINDOW w AS (PARTITION BY code ORDER BY date)) t WHERE back=1 AND nbars>=127"""


@query("latest_momentum", "TI16", sql(
    f"SELECT code, date, close, {osql([], MOM[:-1], 6)}, {r('liquidity', 2)} AS liquidity FROM ({MOMENTUM_SQL})", "tech0", "bench"))
def latest_momentum(spark, sf):
    df = ti.latest_momentum(d.bars(spark, sf), d.benchmark(spark, sf))
    return df.select("code", "date", "close", *[snap(m, 6).alias(m) for m in MOM[:-1]],
                     snap("liquidity", 2).alias("liquidity"))


@query("running_drawdown", "TI17", sql(
    f"""SELECT code, date, peak, {r('close/peak-1', 6)} AS drawdown FROM (
 SELECT *, max(close) OVER (PARTITION BY code ORDER BY date) AS peak FROM bars)""", "bars"))
def running_drawdown(spark, sf):
    return out(ti.drawdown(d.bars(spark, sf), "close"), ["code", "date", "peak"], ["drawdown"], 6)


TECH_SCORE = """greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50.0::DOUBLE
 + coalesce(CASE WHEN close>=ma5 THEN 7 WHEN close<ma5 THEN -7 END,0)
 + coalesce(CASE WHEN close>=ma20 THEN 10 WHEN close<ma20 THEN -10 END,0)
 + coalesce(CASE WHEN close>=ma60 THEN 13 WHEN close<ma60 THEN -13 END,0)
 + CASE WHEN rsi14 BETWEEN 45 AND 65 THEN 5 WHEN rsi14>=75 THEN -10 WHEN rsi14<=25 THEN -5 ELSE 0 END))"""


@query("technical_score", "TI18", sql(f"SELECT code, date, {TECH_SCORE} AS technical_score FROM tech", "tech"))
def technical_score(spark, sf):
    df = ti.technical_score(ti.rsi(ti.sma(d.bars(spark, sf), (5, 20, 60))))
    return df.select("code", "date", "technical_score")


FEATS = ["return_5", "return_20", "return_60", "return_126", "relative_20", "relative_60", "volatility_20",
         "volatility_60", "rsi_14", "atr_14_pct", "ma_20_gap", "ma_60_gap", "liquidity_20",
         "benchmark_return_20", "benchmark_ma_120_gap", "benchmark_volatility_60"]


@query("technical_features", "TI19", sql(
    f"SELECT {osql(['code', 'feature_date', 'close', 'volume', 'market_regime'], FEATS)} FROM features", "features"))
def technical_features(spark, sf):
    df = ti.technical_features(d.bars(spark, sf), d.benchmark(spark, sf))
    return out(df, ["code", "feature_date", "close", "volume", "market_regime"], FEATS)
