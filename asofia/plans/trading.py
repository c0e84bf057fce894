"""Queries over signals, trades, target weights and the paper book."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from asofia.functions.rounding import snap, snap_sql as r
from asofia.functions.windows import full_mean, full_std, pct_change, bar_window
from asofia.operators import analytics as pa, fundamentals as fa, indicators as ti, ranks as rk, signals as sg
from asofia.plans.evaluation import H, _yearly_folds
from asofia.plans.market import osql, out
from asofia.plans.registry import query
from asofia.plans.research import dataset, labels, universe
from asofia.plans.sqlbase import chg, cte, mean, sql, std
from asofia.sources import derived as d
from asofia.sources.session import durable

cte("sig", f"""SELECT *, ma60-lag(ma60,5) OVER w AS slope60, lag(close) OVER w AS pclose FROM tech WINDOW w AS (PARTITION BY code ORDER BY date)""", "tech")


@query("entry_signals", "SG1", sql("""SELECT code, date, coalesce(lag(coalesce(ma20>ma60 AND close>=ma20 AND rsi14 BETWEEN 40 AND 68
 AND slope60>0,false)) OVER (PARTITION BY code ORDER BY date),false) AS entry_signal FROM sig""", "sig"))
def entry_signals(spark, sf):
    return sg.entry_signal(d.bars(spark, sf)).select("code", "date", "entry_signal")


@query("exit_conditions", "SG2", sql(f"""SELECT code, date, coalesce(ma20<ma60 OR close<ma60,false) AS trend_exit,
 coalesce(ma20>ma60 AND slope60>0 AND close>=ma20,false) AS strong_trend, {r('a', 6)} AS atr_ratio,
 {r('greatest(0.07,least(0.20,a*3))', 6)} AS trailing_width, {r('-greatest(0.05,least(0.15,a*2))', 6)} AS volatility_stop
 FROM (SELECT *, coalesce(atr14/close,0.025::DOUBLE) AS a FROM sig)""", "sig"))
def exit_conditions(spark, sf):
    return out(sg.exit_flags(d.bars(spark, sf)), ["code", "date", "trend_exit", "strong_trend"],
               ["atr_ratio", "trailing_width", "volatility_stop"], 6)


cte("ltrades", "SELECT code, horizon, CAST(horizon AS INTEGER) AS holding_days, forward_return AS return_pct, feature_date, label_available_at FROM labels_h", "labels_h")


def label_trades(spark, sf):
    return labels(spark, sf).select("code", "horizon", F.col("horizon").alias("holding_days"),
                                    F.col("forward_return").alias("return_pct"), "feature_date", "label_available_at")


@query("trade_statistics", "SG4", sql(f"""SELECT code, horizon, count(*) AS trades, {r('avg((return_pct>0)::INT)*100')} AS win_rate,
 {r('sum(greatest(return_pct,0))/sum(greatest(-return_pct,0))')} AS profit_factor, {r('avg(holding_days)')} AS avg_holding_days
 FROM ltrades GROUP BY 1,2""", "ltrades"))
def trade_statistics(spark, sf):
    return out(sg.trade_stats(label_trades(spark, sf), ["code", "horizon"]), ["code", "horizon", "trades"],
               ["win_rate", "profit_factor", "avg_holding_days"])


@query("parameter_neighbourhood", "SG5", sql(f"""SELECT DISTINCT code, fast, slow, rsi_max, {r('sl', 6)} AS stop_loss, {r('tp', 6)} AS take_profit FROM (
 SELECT code, 10+CAST(code AS INTEGER)%2*10+df AS fast, CASE WHEN ds=-20 THEN greatest(20+CAST(code AS INTEGER)%2*10, 40) ELSE 60+ds END AS slow,
 68+dr AS rsi_max, -0.05::DOUBLE+dl AS sl, 0.12::DOUBLE+dt AS tp FROM (SELECT DISTINCT code FROM bars), (VALUES (0,0,0,0.0::DOUBLE,0.0::DOUBLE),
 (-5,0,0,0,0),(5,0,0,0,0),(0,-20,0,0,0),(0,20,0,0,0),(0,0,-3,0,0),(0,0,3,0,0),(0,0,0,-0.02,0),(0,0,0,0.02,0),(0,0,0,0,-0.05),(0,0,0,0,0.05)) v(df,ds,dr,dl,dt))""", "bars"))
def parameter_neighbourhood(spark, sf):
    odd = F.col("code").cast("int") % 2
    base = d.bars(spark, sf).select("code").distinct().select(
        "code", (F.lit(10) + odd * 10).alias("fast"), F.lit(60).alias("slow"), F.lit(68).alias("rsi_max"),
        F.lit(-.05).alias("stop_loss"), F.lit(.12).alias("take_profit"))
    return out(sg.param_variants(base), ["code", "fast", "slow", "rsi_max"], ["stop_loss", "take_profit"], 6)


@query("parameter_choice", "SG6", sql(f"""SELECT industry, fold, CAST(-p AS INTEGER) AS param_id, {r('s')} AS score FROM (
 SELECT industry, fold, max_by(-pid, {{'a': s, 'b': -pid}}) AS p, max(s) AS s FROM (SELECT industry, fold, CAST(code AS INTEGER)%7 AS pid,
 CASE WHEN count(*)<2 THEN -10000.0::DOUBLE+count(*) ELSE avg(return_pct)+avg(return_pct/10)*3+avg(least(return_pct,0))*0.2::DOUBLE
 +(avg(return_pct)-5)*0.25::DOUBLE-count(*)*100/1000000.0::DOUBLE END AS s FROM yfold GROUP BY 1,2,3) GROUP BY 1,2)""", "yfold"))
def parameter_choice(spark, sf):
    y = _yearly_folds(spark, sf).withColumn("param_id", F.col("code").cast("int") % 7)
    res = y.groupBy("industry", "fold", "param_id").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("return_pct").alias("cagr"), F.avg("sharpe").alias("sharpe"),
        F.avg("mdd").alias("mdd"), F.lit(5.0).alias("benchmark_cagr"), (F.count(F.lit(1)) * 100).alias("total_cost"))
    return sg.score_params(res, ["industry", "fold"], 2).select("industry", "fold", "param_id", snap("score").alias("score"))


@query("sensitivity_verdict", "SG7", sql(f"""SELECT industry, {r('p')} AS positive_rate, {r('b')} AS beat_rate, {r('m')} AS median_return, {r('s')} AS dispersion,
 CASE WHEN p>=80 AND b>=60 AND s<=greatest(abs(m),1) THEN '안정' ELSE '민감' END AS verdict FROM (SELECT industry, avg((return_pct>0)::INT)*100 AS p,
 avg((return_pct-5>0)::INT)*100 AS b, quantile_cont(return_pct,0.5) AS m, stddev_pop(return_pct) AS s FROM yfold GROUP BY 1)""", "yfold"))
def sensitivity_verdict(spark, sf):
    y = _yearly_folds(spark, sf).withColumn("excess_return", F.col("return_pct") - 5)
    return out(sg.sensitivity(y, ["industry"]), ["industry", "verdict"], ["positive_rate", "beat_rate", "median_return", "dispersion"])


@query("trade_bootstrap", "SG8")
def trade_bootstrap(spark, sf):
    return sg.trade_bootstrap(label_trades(spark, sf), ["code", "horizon"])


# ---- weights ------------------------------------------------------------

cte("riskin", f"""SELECT b.code, b.date, b.close, atr14, industry, {std('ret1', 60)}*sqrt(252.0::DOUBLE) AS vol60, coalesce(ma20>ma60,false) AS eligible
 FROM tech b JOIN industries i ON b.code=i.code WINDOW w AS (PARTITION BY b.code ORDER BY b.date)""", "tech", "industries")


def risk_inputs(spark, sf):
    b = ti.sma(ti.atr(d.bars(spark, sf)), (20, 60)).withColumn("_r", pct_change(F.col("close"), 1, bar_window()))
    b = b.withColumns({"vol60": full_std(F.col("_r"), 60, bar_window()) * F.sqrt(F.lit(252.0)),
                       "eligible": F.coalesce(F.col("ma20") > F.col("ma60"), F.lit(False))})
    return b.join(d.industries(spark, sf).select("code", "industry"), "code")


cte("invr", """SELECT *, iv/nullif(sum(iv) OVER (PARTITION BY date),0)*0.5::DOUBLE AS core0,
 CASE WHEN eligible THEN iv ELSE 0 END/nullif(sum(CASE WHEN eligible THEN iv ELSE 0 END) OVER (PARTITION BY date),0)*0.25::DOUBLE AS tac0 FROM (
 SELECT *, CASE WHEN atr14 IS NOT NULL AND vol60 IS NOT NULL THEN 1/greatest(atr14/close, vol60/sqrt(252.0::DOUBLE), 0.005::DOUBLE) ELSE 0 END AS iv FROM riskin)""", "riskin")


@query("inverse_risk_weights", "SG9", sql(
    f"SELECT code, date, {r('coalesce(core0,0)', 6)} AS core_weight, {r('coalesce(tac0,0)', 6)} AS tactical_weight FROM invr", "invr"))
def inverse_risk_weights(spark, sf):
    return out(sg.inverse_risk(risk_inputs(spark, sf), F.lit(.5), F.lit(.25)), ["code", "date"], ["core_weight", "tactical_weight"], 6)


def _cap_ctes(prefix, src, raw, by, stock, sector, total):
    cte(f"{prefix}0", f"SELECT *, coalesce({raw}/nullif(sum({raw}) OVER (PARTITION BY {by}),0)*{total},0) AS w0 FROM {src}", src)
    for i in range(1, 5):
        c = f"least(w{i - 1},{stock}::DOUBLE)"
        cte(f"{prefix}{i}", f"""SELECT *, CASE WHEN sum({c}) OVER (PARTITION BY {by}, industry)>{sector}::DOUBLE THEN {c}*({sector}::DOUBLE/sum({c})
 OVER (PARTITION BY {by}, industry)) ELSE {c} END AS w{i} FROM {prefix}{i - 1}""", f"{prefix}{i - 1}")


_cap_ctes("capw", "invr", "iv", "date", "0.20", "0.35", "0.9::DOUBLE")


@query("capped_weights", "SG10", sql(f"SELECT code, date, {r('w4', 6)} AS weight FROM capw4", "capw4"))
def capped_weights(spark, sf):
    df = sg.inverse_risk(risk_inputs(spark, sf), F.lit(.5), F.lit(.25))
    return out(sg.cap_weights(df, "inverse_risk", .20, .35, F.lit(.9)), ["code", "date"], ["weight"], 6)


def industry_bars(spark, sf):
    return (d.bars(spark, sf).join(d.industries(spark, sf).select("code", "industry"), "code")
            .groupBy(F.col("industry").alias("code"), "date").agg(F.avg("close").alias("close")))


@query("rebalance_calendar", "SG11", sql("""SELECT substr(date,1,6) AS rebalance_period, min(date) AS rebalance_date FROM (
 SELECT date FROM bars JOIN industries USING (code) GROUP BY date HAVING count(DISTINCT industry)=(SELECT count(DISTINCT industry) FROM industries)) GROUP BY 1""",
    "bars", "industries"))
def rebalance_calendar(spark, sf):
    return sg.rebalance_dates(industry_bars(spark, sf))


# ---- paper book: one portfolio per industry -----------------------------

cte("pb_price", """SELECT code, industry, close AS price, prev AS previous_price, volume, date FROM (SELECT b.*, industry, lag(close) OVER w AS prev,
 row_number() OVER (PARTITION BY b.code ORDER BY date DESC) AS k FROM bars b JOIN industries i ON b.code=i.code WINDOW w AS (PARTITION BY b.code ORDER BY date)) WHERE k=1""",
    "bars", "industries")
cte("pb_rank", f"""SELECT industry AS portfolio_id, code, industry, {r('total_score', 6)} AS total_score, {r('volatility_60', 6)} AS volatility_60,
 ineligible_reason, quality_score>=45 AS eligible FROM ru""", "ru")
cte("pb_best", """SELECT *, greatest(total_score,1)/greatest(volatility_60,5) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id
 ORDER BY total_score DESC, code) AS k FROM pb_rank WHERE eligible) WHERE k<=7""", "pb_rank")
_cap_ctes("pbc", "pb_best", "raw", "portfolio_id", "0.20", "0.85", "0.9::DOUBLE")
cte("pb_target", """SELECT portfolio_id, code, raw/sum(raw) OVER (PARTITION BY portfolio_id)*0.9::DOUBLE AS uncapped_weight, w4 AS target_weight FROM pbc4""", "pbc4")
cte("pb_pos", """SELECT industry AS portfolio_id, code, volume*3 AS quantity, previous_price AS average_price FROM pb_price WHERE volume%2=0""", "pb_price")
cte("pb_eq", """SELECT p.portfolio_id, 20000.0::DOUBLE AS cash, sum(quantity*price) AS market_value, 20000.0::DOUBLE+sum(quantity*price) AS equity
 FROM pb_pos p JOIN pb_price USING (code) GROUP BY 1""", "pb_pos", "pb_price")
cte("pb_cand", f"""SELECT *, CASE WHEN difference=0 THEN 'NO_QUANTITY_CHANGE' WHEN abs(tw-quantity*price/greatest(equity,1))<0.01::DOUBLE THEN 'WITHIN_REBALANCE_BAND'
 WHEN abs(difference)*price<10000 THEN 'BELOW_MIN_ORDER' END AS skip_reason, CASE WHEN difference<0 THEN 'SELL' WHEN difference>0 THEN 'BUY' END AS side FROM (
 SELECT *, tq-quantity AS difference FROM (SELECT coalesce(t.portfolio_id,p.portfolio_id) AS portfolio_id, coalesce(t.code,p.code) AS code,
 coalesce(target_weight,0) AS tw, coalesce(quantity,0) AS quantity, coalesce(average_price,0) AS average_price, x.price, e.cash, e.equity,
 CAST(floor(e.equity*coalesce(target_weight,0)/x.price) AS BIGINT) AS tq FROM pb_target t FULL JOIN pb_pos p ON t.portfolio_id=p.portfolio_id AND t.code=p.code
 JOIN pb_price x ON x.code=coalesce(t.code,p.code) JOIN pb_eq e ON e.portfolio_id=coalesce(t.portfolio_id,p.portfolio_id)))""", "pb_target", "pb_pos", "pb_price", "pb_eq")
cte("pb_sell", """SELECT *, least(-difference,quantity) AS filled FROM pb_cand WHERE skip_reason IS NULL AND side='SELL'""", "pb_cand")
cte("pb_buy", """SELECT c.*, row_number() OVER (PARTITION BY c.portfolio_id ORDER BY code) AS k,
 c.cash+coalesce(s.g,0) AS start_cash FROM pb_cand c LEFT JOIN (SELECT portfolio_id,
 sum(filled*price*(1-0.0005::DOUBLE)*(1-0.00015::DOUBLE-0.0018::DOUBLE)) AS g FROM pb_sell GROUP BY 1) s ON c.portfolio_id=s.portfolio_id
 WHERE skip_reason IS NULL AND side='BUY'""", "pb_cand", "pb_sell")
cte("pb_fold", """SELECT portfolio_id, code, k, CAST(greatest(least(difference,floor(start_cash/(price*1.0005::DOUBLE*1.00015::DOUBLE))),0) AS BIGINT) AS filled,
 start_cash-greatest(least(difference,floor(start_cash/(price*1.0005::DOUBLE*1.00015::DOUBLE))),0)*(price*1.0005::DOUBLE)*1.00015::DOUBLE AS left_cash FROM pb_buy WHERE k=1
 UNION ALL SELECT b.portfolio_id, b.code, b.k, CAST(greatest(least(b.difference,floor(f.left_cash/(b.price*1.0005::DOUBLE*1.00015::DOUBLE))),0) AS BIGINT),
 f.left_cash-greatest(least(b.difference,floor(f.left_cash/(b.price*1.0005::DOUBLE*1.00015::DOUBLE))),0)*(b.price*1.0005::DOUBLE)*1.00015::DOUBLE
 FROM pb_fold f JOIN pb_buy b ON b.portfolio_id=f.portfolio_id AND b.k=f.k+1""", "pb_buy")
cte("pb_orders", """SELECT portfolio_id, code, side, filled, quantity, average_price, price, filled*price*(1-0.0005::DOUBLE) AS gross, filled*price*(1-0.0005::DOUBLE)*0.00015::DOUBLE AS commission,
 filled*price*(1-0.0005::DOUBLE)*0.0018::DOUBLE AS tax FROM pb_sell
 UNION ALL SELECT b.portfolio_id, b.code, b.side, f.filled, b.quantity, b.average_price, b.price, f.filled*b.price*1.0005::DOUBLE, f.filled*b.price*1.0005::DOUBLE*0.00015::DOUBLE, 0
 FROM pb_buy b JOIN pb_fold f ON b.portfolio_id=f.portfolio_id AND b.code=f.code""", "pb_sell", "pb_buy", "pb_fold")


def paper_book(spark, sf):
    """Targets, positions, prices, equity of one day; the ranking is written once and reused."""
    w = bar_window()
    priced = d.bars(spark, sf).withColumn("previous_price", F.lag("close").over(w))
    last = priced.groupBy("code").agg(F.max_by(F.struct("close", "previous_price", "volume"), "date").alias("x"))
    base = durable(last.select("code", F.col("x.close").alias("price"), "x.previous_price", "x.volume").join(
        d.industries(spark, sf).select("code", "industry"), "code"))
    ranking = durable(universe(spark, sf).select(
        F.col("industry").alias("portfolio_id"), "code", "industry", snap("total_score", 6).alias("total_score"),
        snap("volatility_60", 6).alias("volatility_60"), (F.col("quality_score") >= 45).alias("eligible"), "ineligible_reason"))
    targets = sg.target_book(ranking, 7, F.lit(.9), .20, .85)
    positions = base.where("volume % 2 = 0").select(
        F.col("industry").alias("portfolio_id"), "code", (F.col("volume") * 3).alias("quantity"),
        F.col("previous_price").alias("average_price"))
    prices = base.select("code", "price", "previous_price")
    cash = base.select(F.col("industry").alias("portfolio_id")).distinct().withColumn("cash", F.lit(20000.0))
    equity = sg.book_equity(positions, prices, cash)
    return ranking, targets, positions, prices, cash, equity


def paper_orders(spark, sf):
    ranking, targets, positions, prices, cash, equity = paper_book(spark, sf)
    candidates = durable(sg.order_candidates(targets, positions, prices, equity))
    return candidates, sg.proposals(candidates), ranking, positions, prices, cash, equity


@query("target_book", "SG12", sql(
    f"SELECT portfolio_id, code, {r('uncapped_weight', 6)} AS uncapped_weight, {r('target_weight', 6)} AS target_weight FROM pb_target", "pb_target"))
def target_book(spark, sf):
    return out(paper_book(spark, sf)[1], ["portfolio_id", "code"], ["uncapped_weight", "target_weight"], 6)


@query("order_proposals", "SG13", sql(
    f"SELECT portfolio_id, code, side, filled, {r('gross', 2)} AS gross, {r('commission')} AS commission, {r('tax')} AS tax FROM pb_orders", "pb_orders"))
def order_proposals(spark, sf):
    o = paper_orders(spark, sf)[1]
    return o.select("portfolio_id", "code", "side", "filled", snap("gross", 2).alias("gross"),
                    snap("commission").alias("commission"), snap("tax").alias("tax"))


@query("skip_reasons", "SG14", sql("""SELECT portfolio_id, code, skip_reason AS reason FROM pb_cand WHERE skip_reason IS NOT NULL
 UNION ALL SELECT portfolio_id, code, 'INSUFFICIENT_CASH' FROM pb_orders WHERE side='BUY' AND filled<=0
 UNION ALL SELECT portfolio_id, code, 'INELIGIBLE: '||ineligible_reason FROM pb_rank WHERE NOT eligible""", "pb_cand", "pb_orders", "pb_rank"))
def skip_reasons(spark, sf):
    candidates, orders, ranking, *_ = paper_orders(spark, sf)
    return sg.skips(candidates, orders, ranking.where("NOT eligible"))


@query("pnl_attribution", "SG15", sql(f"""SELECT p.portfolio_id, p.code, {r('quantity*(price-previous_price)', 2)} AS pnl_contribution,
 {r('equity*(coalesce(uncapped_weight,0)-coalesce(target_weight,0))*(price/previous_price-1)', 2)} AS constraint_opportunity
 FROM pb_pos p JOIN pb_price x ON p.code=x.code JOIN pb_eq e ON p.portfolio_id=e.portfolio_id LEFT JOIN pb_target t ON t.portfolio_id=p.portfolio_id AND t.code=p.code""",
    "pb_pos", "pb_price", "pb_eq", "pb_target"))
def pnl_attribution(spark, sf):
    _, targets, positions, prices, _, equity = paper_book(spark, sf)
    return out(sg.attribution(positions, prices, targets, equity), ["portfolio_id", "code"],
               ["pnl_contribution", "constraint_opportunity"], 2)


@query("paper_performance", "SG16", sql(f"""SELECT portfolio_id, {r('equity', 2)} AS equity, {r('equity/(equity*0.98::DOUBLE)-1', 6)} AS daily_return,
 {r('equity/1000000-1', 6)} AS cumulative_return, {r('market_value/equity', 6)} AS exposure, {r('0.9::DOUBLE-market_value/equity', 6)} AS exposure_gap,
 {r('(1-market_value/equity)*(1100000.0::DOUBLE*(SELECT max_by(close,date) FROM bench)/1500/1100000-1)', 6)} AS cash_drag FROM pb_eq""", "pb_eq", "bench"))
def paper_performance(spark, sf):
    _, _, positions, prices, cash, equity = paper_book(spark, sf)
    previous = equity.select("portfolio_id", (F.col("equity") * .98).alias("previous_equity"),
                             F.lit(1_100_000.0).alias("previous_benchmark_value"), F.lit(1500.0).alias("previous_benchmark_price"))
    bench = d.benchmark(spark, sf).agg(F.max_by("close", "date")).scalar()
    df = sg.performance(positions, prices, cash, previous, bench, 1_000_000, .9)
    return df.select("portfolio_id", snap("equity", 2).alias("equity"), *[snap(c, 6).alias(c) for c in (
        "daily_return", "cumulative_return", "exposure", "exposure_gap", "cash_drag")])


@query("position_updates", "SG17", sql(f"""SELECT portfolio_id, code, q AS quantity, {r('ap')} AS average_price FROM (
 SELECT coalesce(p.portfolio_id,o.portfolio_id) AS portfolio_id, coalesce(p.code,o.code) AS code,
 coalesce(p.quantity,0)+CASE WHEN side='BUY' THEN filled ELSE -coalesce(filled,0) END AS q,
 CASE WHEN side='BUY' THEN (coalesce(p.quantity,0)*coalesce(p.average_price,0)+gross+commission)/(coalesce(p.quantity,0)+filled) ELSE p.average_price END AS ap
 FROM pb_pos p FULL JOIN (SELECT * FROM pb_orders WHERE filled>0) o ON p.portfolio_id=o.portfolio_id AND p.code=o.code) WHERE q>0""", "pb_pos", "pb_orders"))
def position_updates(spark, sf):
    _, orders, _, positions, *_ = paper_orders(spark, sf)
    return out(sg.apply_fills(positions, orders), ["portfolio_id", "code", "quantity"], ["average_price"])


@query("run_guard", "SG18", sql("""SELECT code AS portfolio_id, date, CAST(code AS INTEGER)%3<>0 OR volume%5=1 AS accepted FROM bars
 WHERE volume%2=1""", "bars"))
def run_guard(spark, sf):
    b = d.bars(spark, sf).select(F.col("code").alias("portfolio_id"), "date", "volume")
    requests = b.select("portfolio_id", "date", (F.col("volume") % 5).alias("top_n"), F.lit(.9).alias("exposure"))
    processed = b.where("volume % 2 = 0")
    # every third portfolio has registered the configuration top_n = 1
    known = b.select("portfolio_id").distinct().where(F.col("portfolio_id").cast("int") % 3 == 0).select(
        "portfolio_id", F.lit(1).cast("long").alias("top_n"), F.lit(.9).alias("exposure"))
    known = known.withColumn("config_hash", F.sha2(F.to_json(F.struct("exposure", "top_n")), 256))
    return sg.guard(requests, processed, known, ["top_n", "exposure"]).select("portfolio_id", "date", "accepted")


@query("aligned_latest_date", "SG19", sql("""SELECT count(*) AS codes, min(m)=max(m) AS aligned, min(m) AS aligned_date, max(m) AS latest_date
 FROM (SELECT code, max(date) AS m FROM bars GROUP BY 1)""", "bars"))
def aligned_latest_date(spark, sf):
    return sg.aligned_date(d.bars(spark, sf))


@query("book_report", "SG20", sql(f"""SELECT c.code AS portfolio_id, days, stage, {r('mdd')} AS mdd, {r('total_cost', 2)} AS total_cost FROM (
 SELECT code, count(*) AS days, min(dd)*100 AS mdd, CASE WHEN count(*)<20 THEN 'COLLECTING' WHEN count(*)<60 THEN 'EARLY' WHEN count(*)<120 THEN 'REVIEW' ELSE 'MATURE' END AS stage
 FROM (SELECT code, close/max(close) OVER (PARTITION BY code ORDER BY date)-1 AS dd FROM bars) GROUP BY 1) c
 JOIN (SELECT code, sum(close*volume*0.001::DOUBLE+volume*0.5::DOUBLE+volume) AS total_cost FROM bars GROUP BY 1) o ON c.code=o.code""", "bars"))
def book_report(spark, sf):
    b = d.bars(spark, sf).withColumn("portfolio_id", F.col("code"))
    curve = b.select("portfolio_id", "date", F.col("close").alias("equity"))
    orders = b.select("portfolio_id", (F.col("close") * F.col("volume")).alias("gross"),
                      (F.col("close") * F.col("volume") * .001).alias("commission"), (F.col("volume") * .5).alias("tax"),
                      F.col("volume").alias("slippage"))
    return sg.book_report(curve, orders).select("portfolio_id", "days", "stage", snap("mdd").alias("mdd"),
                                                snap("total_cost", 2).alias("total_cost"))


@query("performance_backfill", "SG21", sql(f"""SELECT code AS portfolio_id, date, {r('e', 6)} AS exposure, {r('0.9::DOUBLE-e', 6)} AS exposure_gap,
 CASE WHEN date=min(date) OVER (PARTITION BY code) THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS cash_drag FROM (
 SELECT code, date, CASE WHEN volume%2=0 THEN 0.5::DOUBLE ELSE 1-volume/close END AS e FROM bars)""", "bars"))
def performance_backfill(spark, sf):
    b = d.bars(spark, sf)
    perf = b.select(F.col("code").alias("portfolio_id"), "date", F.col("volume").cast("double").alias("cash"),
                    F.col("close").alias("equity"), F.when(F.col("volume") % 2 == 0, .5).alias("exposure"),
                    F.lit(None).cast("double").alias("target_exposure"), F.lit(None).cast("double").alias("exposure_gap"),
                    F.lit(1.5).alias("cash_drag"))
    return sg.backfill_performance(perf, .9).select("portfolio_id", "date", snap("exposure", 6).alias("exposure"),
                                                    snap("exposure_gap", 6).alias("exposure_gap"), "cash_drag")


cte("cutd", "SELECT strftime(strptime(max(date),'%Y%m%d')-INTERVAL 12 MONTH,'%Y%m%d') AS cut FROM bars", "bars")
_half = """SELECT code, min(dd)*100 AS mdd FROM (SELECT code, close/max(close) OVER (PARTITION BY code ORDER BY date)-1 AS dd
 FROM bars, cutd WHERE date{0}cut) GROUP BY 1"""


@query("lockbox_comparison", "SG22", sql(f"""SELECT x.code, {r('x.mdd')} AS development_mdd, {r('y.mdd')} AS lockbox_mdd
 FROM ({_half.format('<=')}) x JOIN ({_half.format('>')}) y ON x.code=y.code""", "bars", "cutd"))
def lockbox_comparison(spark, sf):
    df = sg.lockbox_compare(d.bars(spark, sf).withColumn("equity", F.col("close")))
    return out(df, ["code"], ["development_mdd", "lockbox_mdd"])


@query("strategy_scorecard", "SG23")
def strategy_scorecard(spark, sf):
    return sg.strategy_scorecard(d.bars(spark, sf), label_trades(spark, sf).where("horizon = 60"), 30)


@query("market_exposure_limits", "PA9", sql("""SELECT period, market_regime, CASE WHEN market_regime>0 THEN 1.0::DOUBLE WHEN market_regime=0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS market_exposure_limit
 FROM (SELECT period, CAST(trunc(median(market_regime)) AS INTEGER) AS market_regime FROM preds JOIN reb USING (feature_date) GROUP BY 1)""", "preds", "reb"))
def market_exposure_limits(spark, sf):
    return sg.market_exposure(pa.on_rebalance_days(dataset(spark, sf, ["market_regime"]), H)).select("period", "market_regime", "market_exposure_limit")
