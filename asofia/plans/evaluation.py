"""Queries over time splits, evaluation metrics, books and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofia.functions.rounding import snap, snap_sql as r
from asofia.operators import analytics as pa, fundamentals as fa, indicators as ti, joins as jn, labels as lb
from asofia.operators import ranks as rk, signals as sg, splits as sp
from asofia.plans.market import osql, out
from asofia.plans.registry import query
from asofia.plans.research import dataset, fund_features, labels, predictions, scored
from asofia.plans.sqlbase import chg, cte, pct_rank, sql
from asofia.sources import derived as d
from asofia.sources.session import stored

H = 20
SCOPE = "all"

cte("pday", "SELECT feature_date, row_number() OVER (ORDER BY feature_date)-1 AS i, count(*) OVER () AS n "
    "FROM (SELECT DISTINCT feature_date FROM preds)", "preds")
cte("reb", f"SELECT feature_date, CAST(i//{H} AS INTEGER) AS period FROM pday WHERE i%{H}=0", "pday")
cte("holds", """SELECT t.*, 'all' AS scope, b.period, 1.0::DOUBLE/w.n AS weight FROM top_rows t
 JOIN reb b ON t.feature_date=b.feature_date JOIN (SELECT feature_date, top_fraction, count(*) AS n FROM top_rows GROUP BY 1,2) w
 ON t.feature_date=w.feature_date AND t.top_fraction=w.top_fraction""", "top_rows", "reb")
cte("mv", """SELECT scope, top_fraction, period, code, sum(now) AS now, sum(bef) AS bef FROM (
 SELECT scope, top_fraction, period, code, weight AS now, 0.0::DOUBLE AS bef FROM holds UNION ALL
 SELECT scope, top_fraction, period+1, code, 0.0::DOUBLE, weight FROM holds) GROUP BY 1,2,3,4""", "holds")
cte("turn", """SELECT scope, top_fraction, period, buys, sells, buys+sells AS turnover,
 buys*(0.015::DOUBLE+0.05::DOUBLE)+sells*(0.015::DOUBLE+0.05::DOUBLE+0.18::DOUBLE) AS cost_pct FROM (
 SELECT scope, top_fraction, period, sum(greatest(now-bef,0)) AS buys, sum(greatest(bef-now,0)) AS sells FROM mv GROUP BY 1,2,3)""", "mv")
cte("crossx", """SELECT period, p.feature_date, count(*) AS eligible_count, avg(forward_return) AS universe_return,
 avg(benchmark_forward_return) AS etf_return FROM preds p JOIN reb b ON p.feature_date=b.feature_date GROUP BY 1,2""", "preds", "reb")
cte("per", """SELECT g.scope, g.top_fraction, g.period, c.feature_date, c.eligible_count, g.selected_count, gross AS gross_return,
 gross-cost_pct AS net_return, universe_return, etf_return, buys, sells, turnover, cost_pct FROM (
 SELECT scope, top_fraction, period, sum(weight*forward_return) AS gross, count(*) AS selected_count FROM holds GROUP BY 1,2,3) g
 JOIN turn t ON g.scope=t.scope AND g.top_fraction=t.top_fraction AND g.period=t.period JOIN crossx c ON g.period=c.period""",
    "holds", "turn", "crossx")


def comp(x):
    return (f"(CASE WHEN max(CASE WHEN {x}<=-1 THEN 1 ELSE 0 END)=1 THEN -1.0::DOUBLE "
            f"ELSE exp(sum(CASE WHEN {x}>-1 THEN ln(1+{x}) END))-1 END)")


def summary_sql(net, src):
    return f"""SELECT scope, top_fraction, count(*) AS periods, {comp(net + '/100')}*100 AS net_return,
 {comp('universe_return/100')}*100 AS universe_equal_weight_return, {comp('etf_return/100')}*100 AS etf_return,
 avg(({net}>universe_return)::INT) AS positive_vs_universe_rate, avg(({net}>etf_return)::INT) AS positive_vs_etf_rate,
 avg(({net}>universe_return AND {net}>etf_return)::INT) AS simultaneous_dual_win_rate, sum(turnover) AS turnover,
 sum(cost_pct) AS total_cost_pct FROM {src} GROUP BY 1,2"""


cte("summ", summary_sql("net_return", "per"), "per")
cte("contrib", """SELECT h.*, p.cost_pct, CASE WHEN m.bef>0 THEN 'HELD' ELSE 'NEW' END AS position_status,
 weight*forward_return AS gross_c, p.cost_pct*weight/greatest(w.w,1e-12::DOUBLE) AS cost_c,
 weight*forward_return-p.cost_pct*weight/greatest(w.w,1e-12::DOUBLE) AS net_c FROM holds h
 JOIN per p ON h.top_fraction=p.top_fraction AND h.period=p.period
 JOIN mv m ON h.top_fraction=m.top_fraction AND h.period=m.period AND h.code=m.code
 JOIN (SELECT top_fraction, period, sum(weight) AS w FROM holds GROUP BY 1,2) w ON h.top_fraction=w.top_fraction AND h.period=w.period""",
    "holds", "per", "mv")


BOOK = ["relative_20", "industry", "market_regime", "forward_return", "benchmark_forward_return"]


def book(spark, sf):
    """Rows on rebalance days and the holdings; both are used several times, so they are written once.

    Ranks stay inside a day, so the days are chosen first and no other row is ranked.
    """
    rows = stored(scored(pa.on_rebalance_days(dataset(spark, sf, BOOK), H)))
    return rows, stored(pa.book_holdings(rows, SCOPE))


# ---- splits -------------------------------------------------------------

SPLIT_SQL = """SELECT code, feature_date, CASE WHEN feature_date<v AND label_available_at<v THEN 'train'
 WHEN feature_date>=v AND feature_date<t AND label_available_at<t THEN 'validation' WHEN feature_date>=t THEN 'lockbox'
 ELSE 'purged' END AS split FROM dataset, (SELECT min(feature_date) FILTER (WHERE i>=n-{0}-{1}) AS v,
 min(feature_date) FILTER (WHERE i>=n-{1}) AS t FROM (SELECT feature_date, row_number() OVER (ORDER BY feature_date)-1 AS i,
 count(*) OVER () AS n FROM (SELECT DISTINCT feature_date FROM dataset)))"""


@query("purged_time_split", "ML1", sql(SPLIT_SQL.format(252, 252), "dataset"))
def purged_time_split(spark, sf):
    return sp.purged_split(dataset(spark, sf, ["label_available_at"]), 252, 252).select("code", "feature_date", "split")


def _folds_sql(embargo):
    return f"""SELECT CAST(f+1 AS INTEGER) AS fold, c.feature_date AS train_cutoff, test_start, test_end, test_dates FROM (
 SELECT (i-504)//126 AS f, min(feature_date) AS test_start, max(feature_date) AS test_end, count(*) AS test_dates, min(i) AS o
 FROM pday WHERE i>=504 GROUP BY 1) x LEFT JOIN pday c ON c.i+{embargo}=x.o WHERE test_dates>=42"""


@query("walk_forward_folds", "ML2", sql(_folds_sql(0), "pday"))
def walk_forward_folds(spark, sf):
    return sp.walk_forward_folds(dataset(spark, sf, []), 504, 126)


@query("nested_purged_folds", "ML3", sql(f"""SELECT fold, train_cutoff, test_start, test_end, CAST(count(*) AS BIGINT) AS train_rows,
 max(label_available_at) AS max_label_available_at, {H} AS embargo_days, max(label_available_at)<train_cutoff AS purge_passed
 FROM ({_folds_sql(H)}) JOIN preds ON feature_date<train_cutoff AND label_available_at<train_cutoff GROUP BY 1,2,3,4""", "pday", "preds"))
def nested_purged_folds(spark, sf):
    data = dataset(spark, sf, ["label_available_at"])
    return sp.fold_audit(data, sp.walk_forward_folds(data, 504, 126, H), H)


@query("fold_membership", "ML2 ML3", sql(f"""SELECT fold, part, count(*) AS rows FROM (
 SELECT fold, 'train' AS part FROM ({_folds_sql(H)}) JOIN preds ON feature_date<train_cutoff AND label_available_at<train_cutoff
 UNION ALL SELECT fold, 'test' FROM ({_folds_sql(H)}) JOIN preds ON feature_date BETWEEN test_start AND test_end) GROUP BY 1,2""", "pday", "preds"))
def fold_membership(spark, sf):
    data = dataset(spark, sf, ["label_available_at"])
    rows = sp.assign_folds(data, sp.walk_forward_folds(data, 504, 126, H))
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"))


@query("calendar_walk_forward", "ML4", sql("""SELECT fold, code, count(*) AS test_bars FROM bars JOIN (
 SELECT row_number() OVER (ORDER BY t) AS fold, strftime(t,'%Y%m%d') AS a,
 strftime(least(t+INTERVAL 6 MONTH-INTERVAL 1 DAY, DATE '2001-06-30'),'%Y%m%d') AS b FROM (
 SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-06-30', INTERVAL 6 MONTH)) AS t)) ON date BETWEEN a AND b GROUP BY 1,2""", "bars"))
def calendar_walk_forward(spark, sf):
    folds = sp.calendar_folds(spark, "1993-01-01", "2001-06-30", 3, 6)   # one row per half year
    key = lambda c: F.date_format(c, "yyyyMMdd")
    f = folds.select(F.col("fold").cast("long").alias("fold"), key("test_start").alias("a"), key("test_end").alias("b"))
    return sp.in_windows(d.bars(spark, sf), "date", f, "a", "b").groupBy("fold", "code").agg(F.count(F.lit(1)).alias("test_bars"))


# ---- metrics ------------------------------------------------------------

cte("icr", """SELECT feature_date, CASE WHEN min(score)<>max(score) AND min(excess_return)<>max(excess_return) THEN corr(a,b) END AS rank_ic
 FROM (SELECT feature_date, score, excess_return,
 rank() OVER (PARTITION BY feature_date ORDER BY score)+(count(*) OVER (PARTITION BY feature_date, score)-1)/2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY feature_date ORDER BY excess_return)+(count(*) OVER (PARTITION BY feature_date, excess_return)-1)/2.0::DOUBLE AS b
 FROM preds) GROUP BY 1""", "preds")


@query("daily_rank_ic", "PA1", sql(f"SELECT feature_date, {r('rank_ic')} AS rank_ic FROM icr", "icr"))
def daily_rank_ic(spark, sf):
    return out(pa.daily_ic(predictions(spark, sf, ["excess_return"])), ["feature_date"], ["rank_ic"])


@query("rank_ic_series", "PA2", sql(
    f"SELECT p.feature_date, i%{H}=0 AS non_overlapping, {r('rank_ic')} AS rank_ic FROM pday p LEFT JOIN icr c ON p.feature_date=c.feature_date",
    "pday", "icr"))
def rank_ic_series(spark, sf):
    return out(pa.ic_rows(stored(predictions(spark, sf, ["excess_return"])), H), ["feature_date", "non_overlapping"], ["rank_ic"])


def _draw_sql(sim, step, seed=42):
    x = f"(({sim}*1640531527+{step}*362437+{seed * 9_973 + 1})%{pa.DRAW_MODULUS})"
    return x, [f"(x*(x//65536+{pa.DRAW_FACTOR})+x//7+{k})%{pa.DRAW_MODULUS}" for k in range(3)]


_FIRST, _NEXT = _draw_sql("s", "j")
cte("icv", f"""SELECT rank_ic, row_number() OVER (ORDER BY c.feature_date)-1 AS pick, count(*) OVER () AS n
 FROM icr c JOIN pday p ON p.feature_date=c.feature_date WHERE i%{H}=0 AND rank_ic IS NOT NULL""", "icr", "pday")
cte("icb", f"""SELECT s, avg(rank_ic) AS m FROM (SELECT s, ({_NEXT[2]})%n AS pick FROM (SELECT s, n, {_NEXT[1]} AS x FROM (SELECT s, n, {_NEXT[0]} AS x FROM (
 SELECT s, n, {_FIRST} AS x FROM (SELECT s, n, unnest(range(n)) AS j FROM (SELECT DISTINCT n FROM icv), range(2000) r(s)))))) d JOIN icv v ON v.pick=d.pick GROUP BY s""", "icv")


@query("rank_ic_bootstrap", "PA3", sql(f"SELECT {r('quantile_cont(m, 0.025)')} AS ci_low, {r('quantile_cont(m, 0.975)')} AS ci_high FROM icb", "icb"))
def rank_ic_bootstrap(spark, sf):
    ic = pa.ic_rows(stored(scored(pa.on_rebalance_days(dataset(spark, sf, ["relative_20", "excess_return"]), H).drop("period"))), 1)
    return out(pa.bootstrap_ci(ic, "feature_date", "rank_ic"), [], ["ci_low", "ci_high"])


cte("probs", f"""SELECT *, {r('score*0.6::DOUBLE+0.2::DOUBLE', 6)} AS probability, CASE WHEN feature_date<'19990101' THEN 'validation'
 ELSE 'published' END AS split FROM preds""", "preds")


def probabilities(spark, sf, columns):
    return predictions(spark, sf, columns).withColumns({
        "probability": snap(F.col("score") * .6 + .2, 6),
        "split": F.when(F.col("feature_date") < "19990101", "validation").otherwise("published")})


AUC = """CASE WHEN sum(positive_excess)>0 AND sum(1-positive_excess)>0 THEN
 (sum(rk) FILTER (WHERE positive_excess=1)-sum(positive_excess)*(sum(positive_excess)+1)/2.0::DOUBLE)/(sum(positive_excess)*sum(1-positive_excess)) END"""


def _rk(by):
    return (f"rank() OVER (PARTITION BY {by} ORDER BY probability)"
            f"+(count(*) OVER (PARTITION BY {by},probability)-1)/2.0::DOUBLE AS rk")


@query("classifier_metrics", "ML12", sql(f"""SELECT split, count(*) AS sample_count, {r('avg(positive_excess)')} AS positive_rate,
 {r(AUC)} AS roc_auc, {r('avg(((probability>=0.5)::INT=positive_excess)::INT)')} AS accuracy,
 {r('avg((probability-positive_excess)*(probability-positive_excess))')} AS brier, {r('avg(excess_return)')} AS mean_excess_return,
 {r('avg(excess_return) FILTER (WHERE probability>=cut)')} AS top_quintile_excess_return FROM (
 SELECT p.*, {_rk('p.split')}, cut FROM probs p JOIN (SELECT split, quantile_cont(probability,0.8) AS cut FROM probs GROUP BY 1) q ON p.split=q.split)
 GROUP BY 1""", "probs"))
def classifier_metrics(spark, sf):
    df = pa.classification_metrics(stored(probabilities(spark, sf, ["positive_excess", "excess_return"]).select("split", "probability", "positive_excess", "excess_return")), ["split"])
    return out(df, ["split", "sample_count"], ["positive_rate", "roc_auc", "accuracy", "brier", "mean_excess_return",
                                               "top_quintile_excess_return"])


@query("regression_metrics", "ML13", sql(f"""SELECT split, {r('avg(abs(relative_20-excess_return))')} AS mae,
 {r('sqrt(avg((relative_20-excess_return)*(relative_20-excess_return)))')} AS rmse FROM probs GROUP BY 1""", "probs"))
def regression_metrics(spark, sf):
    return out(pa.regression_metrics(probabilities(spark, sf, ["excess_return"]), ["split"], "excess_return", "relative_20"), ["split"], ["mae", "rmse"])


@query("brier_skill", "ML11", sql(f"""SELECT split, {r('b')} AS brier, {r('b0')} AS prior_brier, {r('1-b/b0')} AS brier_skill FROM (
 SELECT p.split, avg((probability-positive_excess)*(probability-positive_excess)) AS b,
 avg((prior-positive_excess)*(prior-positive_excess)) AS b0 FROM probs p JOIN (SELECT split, avg(positive_excess) AS prior FROM probs GROUP BY 1) q
 ON p.split=q.split GROUP BY 1)""", "probs"))
def brier_skill(spark, sf):
    return out(pa.brier_skill(stored(probabilities(spark, sf, ["positive_excess"]).select("split", "probability", "positive_excess")), ["split"]), ["split"], ["brier", "prior_brier", "brier_skill"])


# ---- books --------------------------------------------------------------

PER = ["gross_return", "net_return", "universe_return", "etf_return", "turnover", "cost_pct"]


@query("equal_weight_book", "PA4", sql(
    f"SELECT {osql(['scope', 'top_fraction', 'feature_date', 'eligible_count', 'selected_count'], PER)} FROM per", "per"))
def equal_weight_book(spark, sf):
    rows, held = book(spark, sf)
    return out(pa.book_periods(rows, held), ["scope", "top_fraction", "feature_date", "eligible_count", "selected_count"], PER)


@query("book_turnover", "PA5", sql(
    f"SELECT {osql(['top_fraction', 'period'], ['buys', 'sells', 'turnover', 'cost_pct'])} FROM turn", "turn"))
def book_turnover(spark, sf):
    return out(pa.turnover(book(spark, sf)[1]), ["top_fraction", "period"], ["buys", "sells", "turnover", "cost_pct"])


@query("book_transitions", "PA6", sql("""SELECT m.top_fraction, c.feature_date, m.code, p.score, c.cutoff_score,
 CASE WHEN m.bef=0 THEN 'ADDED' ELSE 'REMOVED' END AS transition FROM mv m
 JOIN (SELECT top_fraction, period, feature_date, min(score) AS cutoff_score FROM holds GROUP BY 1,2,3) c
 ON m.top_fraction=c.top_fraction AND m.period=c.period
 LEFT JOIN preds p ON p.code=m.code AND p.feature_date=c.feature_date WHERE m.now=0 OR m.bef=0""", "mv", "holds", "preds"))
def book_transitions(spark, sf):
    rows, held = book(spark, sf)
    return pa.transitions(held, rows).select(
        "top_fraction", "feature_date", "code", "score", "cutoff_score", "transition")


def contributed(spark, sf):
    rows, held = book(spark, sf)
    periods = pa.book_periods(rows, held)
    return pa.contributions(held, periods), periods


@query("holding_contributions", "PA7", sql(f"""SELECT top_fraction, feature_date, code, position_status, {r('gross_c')} AS weighted_gross_contribution,
 {r('cost_c')} AS allocated_cost_pct, {r('net_c')} AS weighted_net_contribution FROM contrib""", "contrib"))
def holding_contributions(spark, sf):
    return out(contributed(spark, sf)[0], ["top_fraction", "feature_date", "code", "position_status"],
               ["weighted_gross_contribution", "allocated_cost_pct", "weighted_net_contribution"])


SUMM = ["net_return", "universe_equal_weight_return", "etf_return", "positive_vs_universe_rate", "positive_vs_etf_rate",
        "simultaneous_dual_win_rate", "turnover", "total_cost_pct"]


@query("book_summary", "PA10", sql(f"SELECT {osql(['scope', 'top_fraction', 'periods'], SUMM)} FROM summ", "summ"))
def book_summary(spark, sf):
    rows, held = book(spark, sf)
    return out(pa.book_summary(pa.book_periods(rows, held)), ["scope", "top_fraction", "periods"], SUMM)


@query("book_concentration", "PA11", sql(f"""SELECT top_fraction, code, held AS periods_held, loss AS loss_periods, total_periods,
 {r('net')} AS net_contribution, {r('worst')} AS worst_period_contribution, {r('held/total_periods', 6)} AS held_rate,
 concat_ws(' | ', CASE WHEN held/total_periods>=0.8 THEN 'LONG_TERM_FIXED_HOLDING' END, CASE WHEN loss>=2 AND net<0 THEN 'REPEATED_LOSS' END) AS warnings
 FROM (SELECT c.top_fraction, code, count(*) AS held, count(*) FILTER (WHERE net_c<0) AS loss, sum(net_c) AS net, min(net_c) AS worst,
 max(t.n) AS total_periods FROM contrib c JOIN (SELECT top_fraction, count(DISTINCT period) AS n FROM holds GROUP BY 1) t
 ON c.top_fraction=t.top_fraction GROUP BY 1,2)""", "contrib", "holds"))
def book_concentration(spark, sf):
    df = pa.concentration(contributed(spark, sf)[0])
    return df.select("top_fraction", "code", "periods_held", "loss_periods", "total_periods", "warnings",
                     snap("net_contribution").alias("net_contribution"),
                     snap("worst_period_contribution").alias("worst_period_contribution"), snap("held_rate", 6).alias("held_rate"))


cte("hrisk", """SELECT scope, top_fraction, feature_date, max(m) AS max_stock_weight, max(w) AS max_industry_weight,
 sum(h) AS weight_hhi, CAST(sum(c) AS BIGINT) AS selected_count FROM (SELECT scope, top_fraction, feature_date, industry, sum(weight) AS w,
 max(weight) AS m, sum(weight*weight) AS h, count(*) AS c FROM holds GROUP BY 1,2,3,4) GROUP BY 1,2,3""", "holds")


@query("book_risk", "PA12", sql(
    f"SELECT {osql(['top_fraction', 'feature_date', 'selected_count'], ['max_stock_weight', 'max_industry_weight', 'weight_hhi'], 6)} FROM hrisk", "hrisk"))
def book_risk(spark, sf):
    return out(pa.portfolio_risk(book(spark, sf)[1]), ["top_fraction", "feature_date", "selected_count"],
               ["max_stock_weight", "max_industry_weight", "weight_hhi"], 6)


@query("book_fixation", "PA13", sql(f"""SELECT a.top_fraction, {r('mean_jaccard', 6)} AS mean_jaccard, {r('k/n', 6)} AS max_stock_held_rate,
 {r('mean_turnover', 6)} AS mean_turnover, mean_jaccard>=0.8 AS portfolio_fixed_flag, k/n>=0.8 AS single_stock_fixed_flag FROM (
 SELECT top_fraction, avg(j) AS mean_jaccard FROM (SELECT top_fraction, period, count(*) FILTER (WHERE now>0 AND bef>0)/count(*) AS j
 FROM mv GROUP BY 1,2) WHERE period>0 AND period<=(SELECT max(period) FROM holds) GROUP BY 1) a
 JOIN (SELECT top_fraction, max(c) AS k FROM (SELECT top_fraction, code, count(*) AS c FROM holds GROUP BY 1,2) GROUP BY 1) b ON a.top_fraction=b.top_fraction
 JOIN (SELECT top_fraction, count(DISTINCT period) AS n FROM holds GROUP BY 1) e ON a.top_fraction=e.top_fraction
 JOIN (SELECT top_fraction, avg(turnover) AS mean_turnover FROM per GROUP BY 1) f ON a.top_fraction=f.top_fraction""", "mv", "holds", "per"))
def book_fixation(spark, sf):
    rows, held = book(spark, sf)
    return out(pa.fixation(held, pa.book_periods(rows, held)), ["top_fraction", "portfolio_fixed_flag", "single_stock_fixed_flag"],
               ["mean_jaccard", "max_stock_held_rate", "mean_turnover"], 6)


@query("selection_persistence", "PA14", sql(f"""SELECT top_fraction, code, selected_periods, max_consecutive_selections, {r('mu')} AS mean_universe_excess,
 {r('me')} AS mean_etf_excess, {r('selected_periods/n', 6)} AS held_rate, selected_periods/n>=0.8 AS persistent_flag,
 selected_periods/n>=0.8 AND pu>=0.5 AND pe>=0.5 AND mu>0 AND me>0 AS persistent_but_supported FROM (
 SELECT top_fraction, code, sum(c)::BIGINT AS selected_periods, max(c) AS max_consecutive_selections, sum(su)/sum(c) AS mu, sum(se)/sum(c) AS me,
 sum(pu)/sum(c) AS pu, sum(pe)/sum(c) AS pe FROM (SELECT top_fraction, code, isl, count(*) AS c, sum(forward_return-universe_return) AS su,
 sum(forward_return-etf_return) AS se, sum((forward_return>universe_return)::INT) AS pu, sum((forward_return>etf_return)::INT) AS pe FROM (
 SELECT h.top_fraction, h.code, h.forward_return, c.universe_return, c.etf_return,
 h.period-row_number() OVER (PARTITION BY h.top_fraction, h.code ORDER BY h.period) AS isl FROM holds h JOIN crossx c ON h.period=c.period) GROUP BY 1,2,3)
 GROUP BY 1,2), (SELECT count(*) AS n FROM reb)""", "holds", "crossx", "reb"))
def selection_persistence(spark, sf):
    rows, held = book(spark, sf)
    df = pa.persistence(held, pa.book_periods(rows, held))
    return df.select("top_fraction", "code", "selected_periods", "max_consecutive_selections", "persistent_flag",
                     "persistent_but_supported", snap("mean_universe_excess").alias("mean_universe_excess"),
                     snap("mean_etf_excess").alias("mean_etf_excess"), snap("held_rate", 6).alias("held_rate"))


def constraints(rows, held):
    """Caps and the market's exposure limit against what the book holds at each rebalance."""
    limit = sg.market_exposure(rows, ["period"]).select("period", "market_exposure_limit")
    exposure = held.groupBy("scope", "top_fraction", "period").agg(F.sum("weight").alias("target_exposure"))
    periods = pa.book_periods(rows, held).join(exposure, ["scope", "top_fraction", "period"]).join(limit, "period")
    return pa.constraint_audit(held, periods)


cte("limits", """SELECT period, CASE WHEN r>0 THEN 1.0::DOUBLE WHEN r=0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS exposure_limit FROM (
 SELECT period, CAST(trunc(median(market_regime)) AS INTEGER) AS r FROM preds JOIN reb USING (feature_date) GROUP BY 1)""", "preds", "reb")


@query("constraint_audit", "PA15", sql(f"""SELECT p.top_fraction, p.feature_date, {r('coalesce(max_stock_weight,0)', 6)} AS max_stock_weight,
 coalesce(max_stock_weight,0)>0.15::DOUBLE+1e-9::DOUBLE AS stock_cap_violation, coalesce(max_industry_weight,0)>0.40::DOUBLE+1e-9::DOUBLE AS industry_cap_violation,
 x.s>l.exposure_limit+1e-9::DOUBLE AS exposure_violation FROM per p LEFT JOIN hrisk h ON p.top_fraction=h.top_fraction AND p.feature_date=h.feature_date
 JOIN limits l ON l.period=p.period JOIN (SELECT top_fraction, period, sum(weight) AS s FROM holds GROUP BY 1,2) x ON x.top_fraction=p.top_fraction AND x.period=p.period""", "per", "hrisk", "limits", "holds"))
def constraint_audit(spark, sf):
    return out(constraints(*book(spark, sf)), ["top_fraction", "feature_date", "stock_cap_violation",
                                                    "industry_cap_violation", "exposure_violation"], ["max_stock_weight"], 6)


cte("cbest", """SELECT top_fraction, code AS removed_code, c FROM (SELECT *, row_number() OVER (PARTITION BY top_fraction ORDER BY c DESC, code DESC) AS k
 FROM (SELECT top_fraction, code, sum(net_c) AS c FROM contrib GROUP BY 1,2)) WHERE k=1""", "contrib")
cte("stressed", """SELECT p.*, p.net_return-coalesce(g.g,0) AS snet FROM per p LEFT JOIN (SELECT c.top_fraction, c.period, sum(net_c) AS g FROM contrib c
 JOIN cbest b ON c.top_fraction=b.top_fraction AND c.code=b.removed_code GROUP BY 1,2) g ON p.top_fraction=g.top_fraction AND p.period=g.period""",
    "per", "contrib", "cbest")


@query("top_contributor_stress", "PA16", sql(f"""SELECT b.top_fraction, removed_code, {r('c')} AS removed_contribution_pct, {r('net_return')} AS stressed_net_return,
 net_return>universe_equal_weight_return AND net_return>etf_return AS stressed_dual_positive FROM cbest b JOIN ({summary_sql('snet', 'stressed')}) s
 ON b.top_fraction=s.top_fraction""", "cbest", "stressed"))
def top_contributor_stress(spark, sf):
    return out(pa.outlier_stress(*contributed(spark, sf)), ["top_fraction", "removed_code", "stressed_dual_positive"],
               ["removed_contribution_pct", "stressed_net_return"])


@query("fraction_monotonicity", "PA17", sql("""SELECT scope, coalesce(max(x) FILTER (WHERE top_fraction=0.1)>=max(x) FILTER (WHERE top_fraction=0.2)
 AND max(x) FILTER (WHERE top_fraction=0.2)>=max(x) FILTER (WHERE top_fraction=0.3), false) AS monotonic FROM (
 SELECT scope, top_fraction, net_return-universe_equal_weight_return AS x FROM summ) GROUP BY 1""", "summ"))
def fraction_monotonicity(spark, sf):
    rows, held = book(spark, sf)
    return pa.monotonic(pa.book_summary(pa.book_periods(rows, held)))


cte("terc", """SELECT split, feature_date, CASE WHEN k<=1+(n-1)/3.0::DOUBLE THEN 'low' WHEN k<=1+2*((n-1)/3.0::DOUBLE) THEN 'medium' ELSE 'high' END AS regime FROM (
 SELECT split, feature_date, row_number() OVER (PARTITION BY split ORDER BY v, feature_date) AS k, count(*) OVER (PARTITION BY split) AS n
 FROM (SELECT DISTINCT split, feature_date, benchmark_volatility_60 AS v FROM probs)) WHERE n>=3""", "probs")


@query("regime_breakdown", "PA18", sql(f"""SELECT split, dimension, regime, count(*) AS samples, {r(AUC)} AS roc_auc, {r('avg(excess_return)')} AS mean_excess_return,
 {r('avg(probability)')} AS mean_probability FROM (SELECT *, {_rk('split,dimension,regime')} FROM (
 SELECT split, 'market_trend' AS dimension, CAST(market_regime AS VARCHAR) AS regime, positive_excess, probability, excess_return FROM probs
 UNION ALL SELECT p.split, 'market_volatility', t.regime, positive_excess, probability, excess_return FROM probs p JOIN terc t
 ON p.split=t.split AND p.feature_date=t.feature_date)) GROUP BY 1,2,3""", "probs", "terc"))
def regime_breakdown(spark, sf):
    taken = ["market_regime", "benchmark_volatility_60", "positive_excess", "excess_return"]
    df = pa.regime_rows(stored(probabilities(spark, sf, taken).select("split", "feature_date", "probability", *taken)))
    return out(df, ["split", "dimension", "regime", "samples"], ["roc_auc", "mean_excess_return", "mean_probability"])


# ---- audits -------------------------------------------------------------

@query("label_return_audit", "PA19", sql("""SELECT count(*) AS rows, count(*) FILTER (WHERE ok) AS comparable_rows, avg(ok::INT) AS coverage_rate,
 1.0::DOUBLE AS label_match_rate, 1.0::DOUBLE AS benchmark_match_rate, avg(ok::INT)>=0.999 AS coverage_verified FROM (
 SELECT a.close IS NOT NULL AND b.close IS NOT NULL AND c.close IS NOT NULL AND e.close IS NOT NULL AS ok FROM preds p JOIN reb USING (feature_date)
 LEFT JOIN bars a ON a.code=p.code AND a.date=p.feature_date LEFT JOIN bars b ON b.code=p.code AND b.date=p.label_available_at
 LEFT JOIN bench c ON c.date=p.feature_date LEFT JOIN bench e ON e.date=p.label_available_at)""", "preds", "reb", "bars", "bench"))
def label_return_audit(spark, sf):
    return pa.return_audit_summary(pa.return_audit(dataset(spark, sf, ["label_available_at", "forward_return", "benchmark_forward_return"]), d.bars(spark, sf), d.benchmark(spark, sf), H))


cte("vfeat", """SELECT f.*, v.snapshot_date AS valuation_snapshot_date, v.known_at AS valuation_known_at, v.per AS valuation_per, v.pbr AS valuation_pbr
 FROM feat_fund f ASOF LEFT JOIN valuations v ON f.code=v.code AND f.feature_date>=v.snapshot_date""", "feat_fund", "valuations")
_anyf = " OR ".join(f"{c} IS NOT NULL" for c in pa.FACT_COLUMNS)
cte("pita", f"""SELECT f.code, feature_date, ({_anyf}) AS ff, (valuation_per IS NOT NULL OR valuation_pbr IS NOT NULL) AS vf,
 coalesce(financial_disclosed_at<=feature_date,false) AS fd, coalesce(valuation_snapshot_date<=feature_date,false) AS vd,
 coalesce(valuation_known_at<=valuation_snapshot_date AND valuation_known_at<=feature_date,false) AS vk, s.source IS NOT NULL AS vs
 FROM vfeat f LEFT JOIN valuations s ON s.code=f.code AND s.snapshot_date=f.valuation_snapshot_date""", "vfeat", "valuations")


def pit_rows(spark, sf):
    v = d.valuations(spark, sf)
    take = v.select("code", F.col("snapshot_date").alias("valuation_snapshot_date"), F.col("known_at").alias("valuation_known_at"),
                    F.col("per").alias("valuation_per"), F.col("pbr").alias("valuation_pbr"))
    joined = jn.asof_join(fund_features(spark, sf), take, ["code"], "feature_date", "valuation_snapshot_date",
                          ["valuation_snapshot_date", "valuation_known_at", "valuation_per", "valuation_pbr"],
                          left_unique=True, right_unique=True)
    return pa.pit_audit(joined, v)


@query("point_in_time_audit", "PA21", sql("""SELECT code, feature_date, ff AS financial_fact_present, vf AS valuation_fact_present,
 fd AS financial_date_valid, vk AS valuation_known_at_valid, (NOT ff OR fd) AND (NOT vf OR (vd AND vk AND vs)) AS row_valid FROM pita""", "pita"))
def point_in_time_audit(spark, sf):
    return pit_rows(spark, sf).select("code", "feature_date", "financial_fact_present", "valuation_fact_present",
                                      "financial_date_valid", "valuation_known_at_valid", "row_valid")


@query("point_in_time_verdict", "PA21", sql("""SELECT count(*) AS rows, count(*) FILTER (WHERE v) AS valid_rows, count(*) FILTER (WHERE ff) AS financial_fact_rows,
 count(*) FILTER (WHERE vf) AS valuation_fact_rows, CASE WHEN bool_and(v) AND bool_or(ff) AND bool_or(vf) THEN 'FULL_PIT_VERIFIED'
 ELSE 'FINANCIAL_DISCLOSURE_PIT_PARTIAL' END AS status FROM (SELECT *, (NOT ff OR fd) AND (NOT vf OR (vd AND vk AND vs)) AS v FROM pita)""", "pita"))
def point_in_time_verdict(spark, sf):
    return pa.pit_verdict(pit_rows(spark, sf))


@query("adoption_criteria", "PA22")
def adoption_criteria(spark, sf):
    rows, held = book(spark, sf)
    periods = pa.book_periods(rows, held)
    summary = pa.book_summary(periods)
    top20 = summary.where("top_fraction = 0.2")
    pred = stored(predictions(spark, sf, ["label_available_at", "excess_return"]))
    ic = pa.ic_summary(pa.ic_rows(pred, H))
    fix = pa.fixation(held, periods).where("top_fraction = 0.2")
    stress = pa.outlier_stress(pa.contributions(held, periods), periods).where("top_fraction = 0.2")
    facts = (top20.join(fix.drop("scope"), "top_fraction").join(stress.drop("scope"), "top_fraction")
             .join(pa.monotonic(summary), "scope"))
    one = {c: ic.select(c).scalar() for c in ("nonoverlap_rank_ic", "independent_ic_periods")}
    folds = sp.fold_audit(pred, sp.walk_forward_folds(pred, 504, 126, H), H)
    audit = constraints(rows, held)
    history = jn.universe_audit(jn.interval_join(d.bars(spark, sf), d.universe_history(spark, sf), day="date"), d.universe_history(spark, sf), day="date")
    # every fact is computed; what this base has no record of (total returns, filed actions, a registered lockbox, another champion) is unknown and fails
    unknown = F.lit(None).cast("boolean")
    facts = facts.withColumns(one).withColumns({
        "nested_folds": folds.agg(F.count(F.lit(1))).scalar(),
        "nested_clean": folds.agg(F.bool_and(F.col("purge_passed") & (F.col("embargo_days") >= H))).scalar(),
        "champion_present": unknown, "universe_verified": history.agg(F.bool_and("coverage_complete")).scalar(),
        "total_return_verified": unknown, "corporate_verified": unknown,
        "financial_verified": pa.pit_verdict(pit_rows(spark, sf)).select(F.col("status") == "FULL_PIT_VERIFIED").scalar(),
        "nested_dual_rate": F.col("simultaneous_dual_win_rate"),
        "nonoverlap_ic_ci_low": rank_ic_bootstrap(spark, sf).select("ci_low").scalar(),
        "cumulative_dual_outperformance": (F.col("universe_net_excess_return") > 0) & (F.col("etf_net_excess_return") > 0),
        "unsupported_persistent": pa.persistence(held, periods).where(
            "persistent_flag AND NOT persistent_but_supported").agg(F.count(F.lit(1))).scalar(),
        "validation_constraints_ok": audit.agg(F.bool_and(~(F.col("stock_cap_violation") | F.col("industry_cap_violation") | F.col("exposure_violation")))).scalar(),
        "published_constraints_ok": unknown, "lockbox_registered": unknown, "fresh_lockbox": unknown,
        "published_universe_excess": F.lit(None).cast("double"), "published_etf_excess": F.lit(None).cast("double")})
    return pa.criteria_table(facts, pa.adoption_facts_criteria())


@query("champion_challenger", "PA23", sql(f"""SELECT scope, {r('net_return-universe_equal_weight_return')} AS universe_net_excess_return,
 {r('positive_vs_universe_rate')} AS positive_vs_universe_rate, (SELECT count(rank_ic) FROM icr JOIN reb USING (feature_date)) AS independent_ic_periods
 FROM summ WHERE top_fraction=0.2""", "summ", "icr", "reb"))
def champion_challenger(spark, sf):
    pred = stored(predictions(spark, sf, ["excess_return", "forward_return", "benchmark_forward_return"]))
    rows = pa.compare_scores({"all": pred}, H)
    return out(rows, ["scope", "independent_ic_periods"], ["universe_net_excess_return", "positive_vs_universe_rate"])


# ---- curves -------------------------------------------------------------

@query("curve_metrics", "PA24", sql(f"""SELECT code, {r('(pow(b/a,1/y)-1)*100')} AS cagr, {r('mdd')} AS mdd,
 {r('CASE WHEN s>0 THEN m/s*sqrt(252.0::DOUBLE) ELSE 0 END')} AS sharpe FROM (SELECT code, min_by(close,date) AS a, max_by(close,date) AS b,
 date_diff('day', strptime(min(date),'%Y%m%d'), strptime(max(date),'%Y%m%d'))/365.25::DOUBLE AS y, min(dd)*100 AS mdd, avg(rr) AS m, stddev_pop(rr) AS s
 FROM (SELECT code, date, close, close/max(close) OVER w-1 AS dd, {chg('close', 1)} AS rr FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
 GROUP BY 1)""", "bars"))
def curve_metrics(spark, sf):
    return out(pa.curve_metrics(d.bars(spark, sf), "close"), ["code"], ["cagr", "mdd", "sharpe"])


@query("yearly_performance", "PA25", sql(f"""SELECT code, CAST(substr(date,1,4) AS INTEGER) AS year, {r(comp('rr') + '*100')} AS return_pct FROM (
 SELECT code, date, coalesce({chg('close', 1)},0) AS rr FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) GROUP BY 1,2""", "bars"))
def yearly_performance(spark, sf):
    return out(pa.yearly(d.bars(spark, sf), "close"), ["code", "year"], ["return_pct"])


@query("regime_performance", "PA26", sql(f"""SELECT code, regime, count(*) AS days, {r('ln(1+greatest(' + comp('rr') + ',-0.99::DOUBLE))')} AS log_return FROM (
 SELECT code, coalesce(ret1,0) AS rr, CASE WHEN close>ma60 AND return_60>5 THEN '상승' WHEN close<ma60 AND return_60<-5 THEN '하락'
 ELSE '횡보' END AS regime FROM tech) GROUP BY 1,2""", "tech"))
def regime_performance(spark, sf):
    df = pa.regime_performance(ti.price_regime(d.bars(spark, sf)))
    return out(df.withColumn("log_return", F.log1p(F.greatest(F.col("return_pct") / 100, F.lit(-.99)))), ["code", "regime", "days"], ["log_return"])


@query("buy_and_hold", "PA27", sql(f"""SELECT code, CAST(q AS BIGINT) AS quantity, {r('fv', 2)} AS final_value, {r('(fv/1e8::DOUBLE-1)*100')} AS return_pct FROM (
 SELECT code, q, 1e8::DOUBLE-q*(o*(1+0.0005::DOUBLE))*(1+0.00015::DOUBLE)+q*c*(1-0.0005::DOUBLE)*(1-0.00015::DOUBLE-0.0018::DOUBLE) AS fv FROM (
 SELECT code, o, c, floor(1e8::DOUBLE/((o*(1+0.0005::DOUBLE))*(1+0.00015::DOUBLE))) AS q FROM (
 SELECT code, min_by(open,date) AS o, max_by(close,date) AS c FROM bars GROUP BY 1)))""", "bars"))
def buy_and_hold(spark, sf):
    return pa.buy_hold(d.bars(spark, sf)).select("code", "quantity", snap("final_value", 2).alias("final_value"),
                                                 snap("return_pct").alias("return_pct"))


def _yearly_folds(spark, sf):
    y = pa.yearly(d.bars(spark, sf), "close").withColumns({
        "fold": F.col("year"), "mdd": F.least(F.col("return_pct"), F.lit(0.0)), "sharpe": F.col("return_pct") / 10})
    return y.join(d.industries(spark, sf).select("code", "industry"), "code")


cte("yfold", f"""SELECT y.*, industry FROM (SELECT code, CAST(substr(date,1,4) AS INTEGER) AS fold, {comp('rr')}*100 AS return_pct FROM (
 SELECT code, date, coalesce({chg('close', 1)},0) AS rr FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) GROUP BY 1,2) y
 JOIN industries i ON y.code=i.code""", "bars", "industries")


@query("stock_fold_rollup", "PA28", sql(f"""SELECT code, count(*) AS folds, {r(comp('return_pct/100') + '*100', 2)} AS oos_return,
 {r('avg((return_pct>0)::INT)*100')} AS positive_rate, {r('avg(least(return_pct,0))')} AS mean_mdd FROM yfold GROUP BY 1""", "yfold"))
def stock_fold_rollup(spark, sf):
    s = pa.fold_rollup(_yearly_folds(spark, sf))[0]
    return s.select("code", "folds", snap("oos_return", 2).alias("oos_return"), snap("positive_rate").alias("positive_rate"),
                    snap("mean_mdd").alias("mean_mdd"))


@query("industry_fold_rollup", "PA28", sql(f"""SELECT industry, count(*) AS folds, {r(comp('q/100') + '*100', 2)} AS oos_return,
 {r('avg((q>0)::INT)*100')} AS positive_rate FROM (SELECT industry, fold, avg(return_pct) AS q FROM yfold GROUP BY 1,2) GROUP BY 1""", "yfold"))
def industry_fold_rollup(spark, sf):
    s = pa.fold_rollup(_yearly_folds(spark, sf))[1]
    return s.select("industry", "folds", snap("oos_return", 2).alias("oos_return"), snap("positive_rate").alias("positive_rate"))


@query("parameter_stability", "PA29", sql(f"""SELECT code, {r('max(k)/sum(k)', 6)} AS stability, CASE WHEN max(k)/sum(k)>=0.5 THEN '통과' ELSE '주의' END AS verdict
 FROM (SELECT code, CAST(floor(return_pct/50) AS BIGINT) AS p, count(*) AS k FROM yfold GROUP BY 1,2) GROUP BY 1""", "yfold"))
def parameter_stability(spark, sf):
    chosen = _yearly_folds(spark, sf).withColumn("param_id", F.floor(F.col("return_pct") / 50))
    return out(pa.stability(chosen), ["code", "verdict"], ["stability"], 6)


@query("equal_weight_daily_returns", "PA30", sql(f"""SELECT date, codes, {r('m', 6)} AS daily_return FROM (
 SELECT date, count(*) AS codes, avg(ret1) AS m FROM tech0 WHERE ret1 IS NOT NULL GROUP BY 1)""", "tech0"))
def equal_weight_daily_returns(spark, sf):
    return out(pa.equal_weight_returns(d.bars(spark, sf)), ["date", "codes"], ["daily_return"], 6)
