"""Annual fundamentals, restated as of the day they became public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.norm import norm_text, pct_ratio

# Account ids in priority order, account names (compared without
# blanks and underscores), statements in which the account may stand.
ACCOUNT_RULES = {
    "revenue": (("ifrs-full_Revenue", "ifrs-full_RevenueFromContractsWithCustomers"),
                ("매출액", "영업수익", "수익(매출액)"), ("IS", "CIS")),
    "operating_income": (("dart_OperatingIncomeLoss", "ifrs-full_ProfitLossFromOperatingActivities"),
                         ("영업이익", "영업이익(손실)"), ("IS", "CIS")),
    "net_income": (("ifrs-full_ProfitLoss",),
                   ("당기순이익", "당기순이익(손실)", "연결당기순이익"), ("IS", "CIS")),
    "assets": (("ifrs-full_Assets",), ("자산총계",), ("BS",)),
    "liabilities": (("ifrs-full_Liabilities",), ("부채총계",), ("BS",)),
    "equity": (("ifrs-full_Equity", "ifrs-full_EquityAttributableToOwnersOfParent"), ("자본총계",), ("BS",)),
    "operating_cash_flow": (("ifrs-full_CashFlowsFromUsedInOperatingActivities",),
                            ("영업활동으로인한현금흐름", "영업활동현금흐름"), ("CF",)),
    "eps": (("ifrs-full_BasicEarningsLossPerShare", "ifrs-full_DilutedEarningsLossPerShare"),
            ("기본주당이익", "기본주당이익(손실)", "주당이익"), ("IS", "CIS")),
}
ANNUAL_REPORT = "11011"


def pick_account(key: str) -> Column:
    """Aggregate: the amount of the best matching row of one account.

    Account ids win over names, earlier ids over later ones, then the order of
    the rows in the statement. The rules are literals, so no join is needed and
    the aggregate combines before the shuffle.
    """
    ids, names, statements = ACCOUNT_RULES[key]
    priority: Column | None = None
    for i, account_id in enumerate(ids):
        test = F.col("account_id") == account_id
        priority = F.when(test, i) if priority is None else priority.when(test, i)
    compact = [n.replace(" ", "").replace("_", "").lower() for n in names]
    priority = priority.when(norm_text("account_name").isin(*compact), len(ids))
    usable = F.col("sj_div").isin(*statements) & F.col("amount").isNotNull() & priority.isNotNull()
    return F.min_by("amount", F.when(usable, F.struct(priority, "account_order", "amount"))).alias(key)


def pick_accounts(facts: DataFrame, by: list[str], accounts: list[str] | None = None) -> DataFrame:
    return facts.groupBy(*by).agg(*[pick_account(k) for k in accounts or ACCOUNT_RULES])


def prefer_cfs(facts: DataFrame) -> DataFrame:
    """Per fiscal year: consolidated rows if there are any, else separate ones."""
    annual = facts.where((F.col("report_code") == ANNUAL_REPORT) & F.col("fs_div").isin("CFS", "OFS"))
    any_cfs = annual.groupBy("code", "fiscal_year").agg(F.bool_or(F.col("fs_div") == "CFS").alias("_cfs"))
    return (annual.join(any_cfs, ["code", "fiscal_year"])
            .where(F.col("fs_div") == F.when(F.col("_cfs"), "CFS").otherwise("OFS")).drop("_cfs"))


def _previous_year(column: str) -> Column:
    w = Window.partitionBy("code").orderBy("fiscal_year")
    consecutive = F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1
    return F.when(consecutive, F.lag(column).over(w))


def _ratios(df: DataFrame, digits: int | None) -> DataFrame:
    df = df.withColumns({"_prev_rev": _previous_year("revenue"), "_prev_eq": _previous_year("equity")})
    growth = F.round((F.when(F.col("_prev_rev") != 0, F.col("revenue") / F.col("_prev_rev")) - 1) * 100,
                     10 if digits is None else digits)
    base = F.when(F.col("_prev_eq").isNotNull(), (F.col("equity") + F.col("_prev_eq")) / 2).otherwise(F.col("equity"))
    return df.withColumns({
        "revenue_growth": growth,
        "operating_margin": pct_ratio("operating_income", "revenue", digits),
        "roe": pct_ratio(F.col("net_income"), base, digits),
        "debt_ratio": pct_ratio("liabilities", "equity", digits)}).drop("_prev_rev", "_prev_eq")


def pit_facts(facts: DataFrame) -> DataFrame:
    """One row per (code, fiscal year) as first disclosed, with ratios and implied per-share values."""
    known = prefer_cfs(facts.where(F.coalesce("disclosed_at", F.lit("")) != "")
                       .withColumn("disclosed_at", F.regexp_replace("disclosed_at", "-", "")))
    picked = pick_accounts(known, ["code", "fiscal_year", "disclosed_at", "fs_div"])
    first = picked.groupBy("code", "fiscal_year").agg(
        F.min_by(F.struct("disclosed_at", "fs_div", *ACCOUNT_RULES), "disclosed_at").alias("f")
    ).select("code", "fiscal_year", "f.*")
    implied = F.when((F.col("eps") != 0) & (F.col("net_income") != 0), F.col("net_income") / F.col("eps"))
    return (_ratios(first, None)
            .withColumn("_shares", F.when(implied > 0, implied))
            .select("code", F.col("fiscal_year").alias("financial_fiscal_year"),
                    F.col("disclosed_at").alias("financial_disclosed_at"),
                    F.col("fs_div").alias("financial_fs_div"),
                    "revenue_growth", "operating_margin", "roe", "debt_ratio",
                    (F.col("operating_cash_flow") > 0).cast("double").alias("operating_cash_flow_positive"),
                    F.col("eps").alias("reported_eps"),
                    (F.col("equity") / F.col("_shares")).alias("estimated_bps")))


PIT_COLUMNS = ["financial_fiscal_year", "financial_disclosed_at", "financial_fs_div", "revenue_growth",
               "operating_margin", "roe", "debt_ratio", "operating_cash_flow_positive", "reported_eps",
               "estimated_bps"]


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def financial_score() -> Column:
    """Weighted growth, margin, debt, ROE and cash flow scores; missing parts are neutral."""
    # least() skips nulls, so a missing input must be tested before the clamp
    def part(column: str, score: Column) -> Column:
        return F.when(F.col(column).isNull(), F.lit(50.0)).otherwise(clamp(score))
    growth = part("revenue_growth", 50 + F.col("revenue_growth") * 2)
    margin = part("operating_margin", 40 + F.col("operating_margin") * 3)
    debt = part("debt_ratio", 100 - F.col("debt_ratio") / 2)
    roe = part("roe", 40 + F.col("roe") * 3)
    cash = (F.when(F.col("operating_cash_flow").isNull(), 50)
            .when(F.col("operating_cash_flow") > 0, 75).otherwise(20))
    return growth * .20 + margin * .25 + debt * .20 + roe * .20 + cash * .15


def annual_analysis(facts: DataFrame, as_of: str | DataFrame | None = None) -> DataFrame:
    """Latest consolidated annual report per code against the year before, with warnings.

    With ``as_of`` (a date, or a frame of code and as_of) only rows disclosed by
    then count; rows without a disclosure date pass, and so do codes without a
    date of their own.
    """
    keys = [k for k in ACCOUNT_RULES if k != "eps"]
    annual = facts.where((F.col("report_code") == ANNUAL_REPORT) & (F.col("fs_div") == "CFS"))
    if isinstance(as_of, DataFrame):
        annual = annual.join(as_of.select("code", "as_of"), "code", "left").where(
            F.col("as_of").isNull() | F.col("disclosed_at").isNull() | (F.col("disclosed_at") <= F.col("as_of")))
    elif as_of:
        annual = annual.where(F.col("disclosed_at").isNull() | (F.col("disclosed_at") <= as_of))
    yearly = _ratios(pick_accounts(annual, ["code", "fiscal_year"], keys), 6)
    latest = yearly.groupBy("code").agg(
        F.max_by(F.struct(*[c for c in yearly.columns if c != "code"]), "fiscal_year").alias("f")).select("code", "f.*")
    missing = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    warnings = F.array_compact(F.array(
        F.when(missing != "", F.concat(F.lit("누락 계정: "), missing)),
        F.when(~F.col("roe").between(-100, 100), F.lit("ROE가 검증 범위를 벗어났습니다.")),
        F.when(~F.col("debt_ratio").between(0, 1000), F.lit("부채비율이 검증 범위를 벗어났습니다."))))
    return latest.withColumns({"financial_score": F.round(financial_score(), 2), "warnings": warnings})


def combined_score(df: DataFrame) -> DataFrame:
    total = F.col("technical_score") * .4 + F.col("financial_score") * .6
    opinion = F.when(total >= 70, "긍정").when(total >= 55, "관심").when(total >= 40, "중립").otherwise("주의")
    return df.withColumns({"combined_score": total, "opinion": opinion})


def valuation_multiples(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "historical_per": F.when(F.col("reported_eps") != 0, F.col("close") / F.col("reported_eps")),
        "historical_pbr": F.when(F.col("estimated_bps") != 0, F.col("close") / F.col("estimated_bps"))})


def latest_valuation(valuations: DataFrame, today: str) -> DataFrame:
    """Newest snapshot per code, its age in days and whether it is complete."""
    fields = ["snapshot_date", "price", "market_cap", "per", "pbr", "eps", "bps", "dividend_yield"]
    newest = valuations.groupBy("code").agg(F.max_by(F.struct(*fields), "snapshot_date").alias("v"))
    complete = F.lit(True)
    for c in ("per", "pbr", "eps", "bps"):
        complete = complete & F.col(c).isNotNull()
    return (newest.select("code", "v.*").withColumnRenamed("snapshot_date", "valuation_date")
            .withColumns({"valuation_age_days": F.datediff(F.to_date(F.lit(today), "yyyyMMdd"),
                                                           F.to_date("valuation_date", "yyyyMMdd")),
                          "valuation_complete": complete, "earnings_yield": earnings_yield()}))


def earnings_yield(per: str = "per") -> Column:
    return F.when(F.col(per) > 0, 100 / F.col(per))
