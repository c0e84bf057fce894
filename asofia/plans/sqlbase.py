"""Shared pieces of the oracle SQL: common table expressions by name."""

from __future__ import annotations

from asofia.functions.rounding import snap_sql as r
from asofia.sources.derived import ACCOUNTS, TITLES

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    CTES[name] = (deps, text)


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the named CTEs and what they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


def code(expr: str) -> str:
    t = f"CAST({expr} AS VARCHAR)"
    return f"(CASE WHEN length({t})<6 THEN lpad({t},6,'0') ELSE {t} END)"


def mean(x: str, n: int, w: str = "w") -> str:
    f = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {f}={n} THEN avg({x}) OVER {f} END)"


def std(x: str, n: int, w: str = "w") -> str:
    f = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {f}={n} THEN stddev_samp({x}) OVER {f} END)"


def chg(x: str, n: int, w: str = "w") -> str:
    return f"({x}/nullif(lag({x},{n}) OVER {w},0)-1)"


def pct_rank(x: str, by: str, desc: bool = False) -> str:
    """Average-tie percentile over the non-null values of a group."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by},{x}" if by else f"PARTITION BY {x}"
    order = f"{x} {'DESC' if desc else 'ASC'} NULLS LAST"
    return (f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {order})"
            f"+(count(*) OVER ({tie})-1)/2.0::DOUBLE)/count({x}) OVER ({part}) END)")


cte("bars", f"""SELECT {code('l_suppkey')} AS code, strftime(CAST(l_shipdate AS DATE),'%Y%m%d') AS date,
 {r('(max(l_extendedprice/l_quantity)+min(l_extendedprice/l_quantity))/2', 6)} AS open,
 {r('max(l_extendedprice/l_quantity)', 6)} AS high, {r('min(l_extendedprice/l_quantity)', 6)} AS low,
 {r(r('sum(l_extendedprice)', 2) + '/sum(l_quantity)', 6)} AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
 FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""")

cte("bench", f"""SELECT 'BENCH0' AS code, strftime(CAST(l_shipdate AS DATE),'%Y%m%d') AS date,
 {r(r('sum(l_extendedprice)', 2) + '/sum(l_quantity)', 6)} AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
 FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""")

cte("industries", f"""SELECT {code('s_suppkey')} AS code, s_name AS name,
 CASE WHEN r_name='ASIA' THEN '은행' ELSE r_name END AS industry
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")

cte("yearly_sums", f"""SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
 {r('sum(l_extendedprice)')} AS rev, {r('sum(l_extendedprice*(l_discount-0.02::DOUBLE))')} AS opi,
 {r('sum(l_extendedprice*(l_discount-0.03::DOUBLE))')} AS net, {r('sum(l_extendedprice)*2')} AS ast,
 {r('sum(l_extendedprice*l_tax)*10')} AS lia, {r('sum(l_quantity)*500')} AS equ,
 {r('sum(l_extendedprice*(l_discount-0.04::DOUBLE))')} AS ocf,
 {r('sum(l_extendedprice*(l_discount-0.03::DOUBLE))/sum(l_quantity)')} AS eps
 FROM lineitem GROUP BY 1,2""")

cte("statements", " UNION ALL ".join(
    f"""SELECT {code('l_suppkey')} AS code, fiscal_year, '11011' AS report_code, '{fs}' AS fs_div,
 '{s}' AS sj_div, '{a}' AS account_id, '{n}' AS account_name, {v}{'' if fs == 'CFS' else '*0.5::DOUBLE'} AS amount,
 {i + 1} AS account_order, CAST(fiscal_year+1 AS VARCHAR)||'0331' AS disclosed_at FROM yearly_sums
 {'WHERE l_suppkey%2=0' if fs == 'CFS' else ''}"""
    for fs in ("CFS", "OFS") for i, (a, n, s, v) in enumerate(ACCOUNTS)), "yearly_sums")

cte("valuations", f"""SELECT code, date AS snapshot_date, close AS price, close*volume*1000 AS market_cap,
 CASE WHEN volume%11<>0 THEN {r('close/nullif((volume-12)*100.0::DOUBLE,0)')} END AS per,
 {r('close/(volume*40.0::DOUBLE)')} AS pbr, (volume-12)*100.0::DOUBLE AS eps, volume*40.0::DOUBLE AS bps,
 CASE WHEN volume%5<>0 THEN volume/10.0::DOUBLE END AS dividend_yield,
 strftime(strptime(date,'%Y%m%d')+to_days(CAST(volume%3 AS INTEGER)),'%Y%m%d') AS known_at,
 CASE WHEN volume%13=0 THEN 'PLACEHOLDER' ELSE 'KRX' END AS source
 FROM (SELECT *, row_number() OVER (PARTITION BY code, substr(date,1,6) ORDER BY date DESC) rn FROM bars) WHERE rn=1""",
    "bars")

cte("universe_history", """SELECT code, ef AS effective_from, et AS effective_to, ef AS selection_known_at,
 lo AS listing_date, CASE WHEN code LIKE '%7' THEN '19991231' ELSE '' END AS delisting_date,
 le AS liquidity_eligible, 'INDEX' AS source FROM (
 SELECT code, min(date) AS ef, '19961231' AS et, true AS le, min(date) AS lo FROM bars GROUP BY code
 UNION ALL SELECT code, '19970301', '', CAST(right(code,1) AS INTEGER)%2=1, min(date) FROM bars GROUP BY code)""", "bars")

cte("actions", f"""SELECT code, date AS effective_date, action_type, CASE WHEN action_type='SPLIT' THEN 2.0::DOUBLE
 ELSE 1.0::DOUBLE END AS adjustment_factor, CASE WHEN action_type='SPLIT' THEN 0.0::DOUBLE ELSE {r('close*0.01::DOUBLE')} END
 AS cash_amount, date AS known_at, 'FILING' AS source FROM (
 SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) n FROM bars)
 JOIN (VALUES ('CASH_DIVIDEND',97),('SPLIT',389)) t(action_type, step) ON n%step=0""", "bars")

cte("tech0", f"""SELECT *, close/nullif(lag(close) OVER w,0)-1 AS ret1, lag(close) OVER w AS pc,
 close-lag(close) OVER w AS delta, count(*) OVER (PARTITION BY code) AS nbars,
 row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)""", "bars")
cte("tech1", f"""SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta,0) END AS up,
 CASE WHEN delta IS NOT NULL THEN greatest(-delta,0) END AS down,
 greatest(abs(high-low),abs(high-pc),abs(low-pc)) AS tr FROM tech0""", "tech0")
cte("tech2", f"""SELECT *, {mean('up', 14)} AS gain, {mean('down', 14)} AS loss, {mean('tr', 14)} AS atr14,
 {mean('close', 5)} AS ma5, {mean('close', 20)} AS ma20, {mean('close', 60)} AS ma60, {mean('close', 120)} AS ma120,
 {std('ret1', 20)}*sqrt(252::DOUBLE)*100 AS volatility_20, {std('ret1', 60)}*sqrt(252::DOUBLE)*100 AS volatility_60,
 {chg('close', 5)}*100 AS return_5, {chg('close', 20)}*100 AS return_20, {chg('close', 60)}*100 AS return_60,
 {chg('close', 126)}*100 AS return_126, {mean('close*volume', 20)} AS liquidity_20
 FROM tech1 WINDOW w AS (PARTITION BY code ORDER BY date)""", "tech1")
cte("tech", """SELECT *, CASE WHEN gain IS NULL OR loss IS NULL THEN NULL WHEN loss=0 AND gain=0 THEN 50.0::DOUBLE
 WHEN loss=0 THEN 100.0::DOUBLE ELSE 100-100/(1+gain/loss) END AS rsi14 FROM tech2""", "tech2")
cte("market", f"""SELECT date, close AS benchmark_close, {chg('close', 20)}*100 AS benchmark_return_20,
 {chg('close', 60)}*100 AS benchmark_return_60, (close/{mean('close', 120)}-1)*100 AS benchmark_ma_120_gap,
 {std('ret1', 60)}*sqrt(252::DOUBLE)*100 AS benchmark_volatility_60
 FROM (SELECT *, close/nullif(lag(close) OVER (ORDER BY date),0)-1 AS ret1 FROM bench) WINDOW w AS (ORDER BY date)""", "bench")
cte("features", """SELECT t.code, t.date AS feature_date, open, high, low, close, volume, return_5, return_20, return_60,
 return_126, volatility_20, volatility_60, CASE WHEN gain=0 AND loss=0 THEN NULL ELSE rsi14 END AS rsi_14,
 atr14/close*100 AS atr_14_pct, (close/ma20-1)*100 AS ma_20_gap, (close/ma60-1)*100 AS ma_60_gap, liquidity_20,
 benchmark_return_20, benchmark_return_60, benchmark_ma_120_gap, benchmark_volatility_60,
 CASE WHEN benchmark_ma_120_gap>3 THEN 1 WHEN benchmark_ma_120_gap<-3 THEN -1 ELSE 0 END AS market_regime,
 return_20-benchmark_return_20 AS relative_20, return_60-benchmark_return_60 AS relative_60
 FROM tech t LEFT JOIN market m ON t.date=m.date
 WHERE nbars>=127 AND return_126 IS NOT NULL AND benchmark_ma_120_gap IS NOT NULL""", "tech", "market")

cte("queue", f"""SELECT CAST(o_orderkey AS VARCHAR) AS queue_event_id, {code('(o_custkey%(SELECT count(*) FROM supplier))')} AS code,
 CASE o_orderstatus WHEN 'F' THEN 'DIVIDEND_OR_DISTRIBUTION' ELSE 'CORPORATE_ACTION' END AS event_family,
 strftime(CAST(o_orderdate AS DATE),'%Y%m%d') AS source_reference_date, o_orderpriority AS source_description FROM orders""")

_titles = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES))
cte("disc", f"""SELECT {code('(o_custkey%(SELECT count(*) FROM supplier))')} AS code,
 strftime(CAST(o_orderdate AS DATE),'%Y%m%d')||substr(CAST(1000000+o_orderkey%1000000 AS VARCHAR),2) AS rcept_no,
 strftime(CAST(o_orderdate AS DATE),'%Y%m%d') AS rcept_dt, CASE o_orderkey%6 {_titles} END AS report_nm,
 CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_orderkey AS order_key, o_totalprice AS amount FROM orders""")
cte("evidence", f"""SELECT CAST(o_orderkey AS VARCHAR)||'-'||CAST(copy AS VARCHAR) AS evidence_id,
 CASE WHEN o_orderkey%7=0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS queue_event_id,
 {code('(o_custkey%(SELECT count(*) FROM supplier))')} AS code,
 CASE o_orderstatus WHEN 'F' THEN 'DIVIDEND_OR_DISTRIBUTION' ELSE 'CORPORATE_ACTION' END AS event_family,
 CASE WHEN o_orderkey%2=0 THEN strftime(CAST(o_orderdate AS DATE),'%Y%m%d') ELSE '' END AS source_reference_date,
 strftime(CAST(o_orderdate AS DATE)+to_days(CAST(copy*60 AS INTEGER)),'%Y%m%d') AS effective_date,
 strftime(CAST(o_orderdate AS DATE),'%Y%m%d') AS known_at, 'CASH_DIVIDEND' AS action_type, o_totalprice AS cash_amount
 FROM orders JOIN (VALUES (1),(2)) c(copy) ON copy<=o_orderkey%3""")
