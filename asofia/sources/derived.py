"""Market tables derived from the star-schema test tables.

The test data holds no market data, so each supplier plays a security and its
shipments are the trades: one bar per (supplier, ship date). Everything is a
plain aggregation with map-side combine; a supplier with a third of all lines
still shrinks to one row per calendar day before the first shuffle. Bars, the benchmark,
statements and valuations are stored once for an application and bucketed, as a
market-data base would hold them; queries read those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from asofia.functions.norm import norm_code
from asofia.functions.rounding import snap
from asofia.sources.session import bucketed_once, row_bound  # noqa: F401  (also used by the queries)

BENCHMARK = "BENCH0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(c: str) -> Column:
    return norm_code(F.col(c).cast("string"))


def _key(c: str) -> Column:
    return F.date_format(F.to_date(c), "yyyyMMdd")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    grouped = (table(spark, sf_dir, "lineitem")
               .groupBy("l_suppkey", F.to_date("l_shipdate").alias("d"))
               .agg(F.min(unit).alias("lo"), F.max(unit).alias("hi"),
                    F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q")))
    return grouped.select(
        _code("l_suppkey").alias("code"), F.date_format("d", "yyyyMMdd").alias("date"),
        snap((F.col("hi") + F.col("lo")) / 2, 6).alias("open"), snap("hi", 6).alias("high"),
        snap("lo", 6).alias("low"), snap(snap("p", 2) / F.col("q"), 6).alias("close"),
        F.col("q").cast("long").alias("volume"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index bar per date over all suppliers."""
    grouped = (table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d"))
               .agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q")))
    return grouped.select(
        F.lit(BENCHMARK).alias("code"), F.date_format("d", "yyyyMMdd").alias("date"),
        snap(snap("p", 2) / F.col("q"), 6).alias("close"), F.col("q").cast("long").alias("volume"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, industry; the ASIA region plays the banking sector."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf_dir, "supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(_code("s_suppkey").alias("code"), F.col("s_name").alias("name"),
                    F.when(F.col("r_name") == "ASIA", "은행").otherwise(F.col("r_name")).alias("industry")))


# account id, account name, statement, yearly sum it is taken from
ACCOUNTS = (
    ("ifrs-full_Revenue", "매출액", "IS", "rev"),
    ("dart_OperatingIncomeLoss", "영업이익", "IS", "opi"),
    ("", "당기 순이익", "CIS", "net"),
    ("ifrs-full_Assets", "자산총계", "BS", "ast"),
    ("ifrs-full_Liabilities", "부채총계", "BS", "lia"),
    ("ifrs-full_Equity", "자본총계", "BS", "equ"),
    ("", "영업활동현금흐름", "CF", "ocf"),
    ("ifrs-full_BasicEarningsLossPerShare", "기본주당이익", "IS", "eps"),
)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statement rows: OFS for every code, CFS as well for even codes."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    sums = (table(spark, sf_dir, "lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year"))
            .agg(snap(F.sum(p), 4).alias("rev"),
                 snap(F.sum(p * (F.col("l_discount") - 0.02)), 4).alias("opi"),
                 snap(F.sum(p * (F.col("l_discount") - 0.03)), 4).alias("net"),
                 snap(F.sum(p) * 2, 4).alias("ast"), snap(F.sum(p * F.col("l_tax")) * 10, 4).alias("lia"),
                 snap(F.sum(q) * 500, 4).alias("equ"),
                 snap(F.sum(p * (F.col("l_discount") - 0.04)), 4).alias("ocf"),
                 snap(F.sum(p * (F.col("l_discount") - 0.03)) / F.sum(q), 4).alias("eps")))
    rows = F.array(*[F.struct(F.lit(a).alias("account_id"), F.lit(n).alias("account_name"),
                              F.lit(s).alias("sj_div"), F.col(v).alias("amount"),
                              F.lit(i + 1).alias("account_order"))
                     for i, (a, n, s, v) in enumerate(ACCOUNTS)])
    books = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("CFS"), F.lit("OFS"))).otherwise(
        F.array(F.lit("OFS")))
    return (sums.withColumn("r", F.explode(rows)).withColumn("fs_div", F.explode(books))
            .select(_code("l_suppkey").alias("code"), "fiscal_year", F.lit("11011").alias("report_code"),
                    "fs_div", "r.sj_div", "r.account_id", "r.account_name",
                    F.when(F.col("fs_div") == "CFS", F.col("r.amount")).otherwise(F.col("r.amount") * 0.5)
                    .alias("amount"), "r.account_order",
                    F.concat(F.col("fiscal_year") + 1, F.lit("0331")).alias("disclosed_at")))


def _valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot at the last bar of each month per code."""
    month = F.substring("date", 1, 6)
    last = (bars(spark, sf_dir).groupBy("code", month.alias("month"))
            .agg(F.max_by(F.struct("date", "close", "volume"), "date").alias("b")))
    v, c = F.col("b.volume"), F.col("b.close")
    eps = (v - 12) * 100.0
    return last.select(
        "code", F.col("b.date").alias("snapshot_date"), c.alias("price"),
        (c * v * 1000).alias("market_cap"),
        F.when(v % 11 != 0, snap(c / F.when(eps != 0, eps), 4)).alias("per"),
        snap(c / (v * 40.0), 4).alias("pbr"), eps.alias("eps"), (v * 40.0).alias("bps"),
        F.when(v % 5 != 0, v / 10).alias("dividend_yield"),
        F.date_format(F.date_add(F.to_date("b.date", "yyyyMMdd"), (v % 3).cast("int")), "yyyyMMdd")
        .alias("known_at"),
        F.when(v % 13 == 0, "PLACEHOLDER").otherwise("KRX").alias("source"))


BUCKET_LINES = 500_000
_LINES: dict[tuple[str, str], int] = {}


def _kept(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame], **layout: str) -> DataFrame:
    """A stored table; all tables of one source have equally many buckets, in proportion to its lines."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LINES:
        _LINES[key] = row_bound(spark, f"{sf_dir}/lineitem.parquet")
    return bucketed_once(spark, name, sf_dir, build, least=_LINES[key] // BUCKET_LINES + 1, **layout)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per code and day, stored by code."""
    return _kept(spark, "bars", sf_dir, lambda: _bars(spark, sf_dir), order="date")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index bar per date over all suppliers, stored by date."""
    return _kept(spark, "benchmark", sf_dir, lambda: _benchmark(spark, sf_dir), by="date")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statement rows, stored by code."""
    return _kept(spark, "statements", sf_dir, lambda: _statements(spark, sf_dir), order="fiscal_year")


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end snapshots, stored by code."""
    return _kept(spark, "valuations", sf_dir, lambda: _valuations(spark, sf_dir), order="snapshot_date")


def universe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two membership intervals per code, the second one open-ended."""
    span = bars(spark, sf_dir).groupBy("code").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    odd = F.substring("code", -1, 1).cast("int") % 2 == 1
    def part(a: Column, b: Column, liquid: Column) -> Column:
        return F.struct(a.alias("effective_from"), b.alias("effective_to"), liquid.alias("liquidity_eligible"))
    parts = F.array(part(F.col("lo"), F.lit("19961231"), F.lit(True)),
                    part(F.lit("19970301"), F.lit(""), odd))
    return span.withColumn("p", F.explode(parts)).select(
        "code", "p.effective_from", "p.effective_to",
        F.col("p.effective_from").alias("selection_known_at"), F.col("lo").alias("listing_date"),
        F.when(F.col("code").endswith("7"), F.lit("19991231")).otherwise(F.lit("")).alias("delisting_date"),
        "p.liquidity_eligible", F.lit("INDEX").alias("source"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th bar pays 1 % in cash, every 389th bar splits two for one."""
    from pyspark.sql import Window
    n = F.row_number().over(Window.partitionBy("code").orderBy("date"))
    b = bars(spark, sf_dir).withColumn("n", n).where((F.col("n") % 97 == 0) | (F.col("n") % 389 == 0))
    kinds = F.array_compact(F.array(
        F.when(F.col("n") % 97 == 0, F.lit("CASH_DIVIDEND")), F.when(F.col("n") % 389 == 0, F.lit("SPLIT"))))
    return b.withColumn("action_type", F.explode(kinds)).select(
        "code", F.col("date").alias("effective_date"), "action_type",
        F.when(F.col("action_type") == "SPLIT", 2.0).otherwise(1.0).alias("adjustment_factor"),
        F.when(F.col("action_type") == "SPLIT", 0.0).otherwise(snap(F.col("close") * 0.01, 4)).alias("cash_amount"),
        F.col("date").alias("known_at"), F.lit("FILING").alias("source"))


# order status to event family
FAMILIES = (("F", "DIVIDEND_OR_DISTRIBUTION"), ("O", "CORPORATE_ACTION"), ("P", "CORPORATE_ACTION"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event queue: one event per order, assigned to a security by customer key."""
    n = row_bound(spark, f"{sf_dir}/supplier.parquet")
    family = None
    for status, name in FAMILIES:
        test = F.col("o_orderstatus") == status
        family = F.when(test, name) if family is None else family.when(test, name)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("queue_event_id"),
        norm_code((F.col("o_custkey") % n).cast("string")).alias("code"), family.alias("event_family"),
        _key("o_orderdate").alias("source_reference_date"), F.col("o_orderpriority").alias("source_description"))


# disclosure titles by order key
TITLES = ("현금ㆍ현물배당결정", "[기재정정]현금ㆍ현물배당결정", "주요사항보고서(유상증자결정)", "주식분할결정",
          "회사합병결정", "[첨부추가]회사합병결정")


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One disclosure per order: code, receipt number and date, title, issuer JSON."""
    n = row_bound(spark, f"{sf_dir}/supplier.parquet")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        norm_code((F.col("o_custkey") % n).cast("string")).alias("code"),
        F.concat(_key("o_orderdate"), F.lpad((k % 1_000_000).cast("string"), 6, "0")).alias("rcept_no"),
        _key("o_orderdate").alias("rcept_dt"),
        F.element_at(F.array(*[F.lit(t) for t in TITLES]), (k % len(TITLES) + 1).cast("int")).alias("report_nm"),
        F.year("o_orderdate").alias("fiscal_year"), k.alias("order_key"),
        F.col("o_totalprice").alias("amount"))


EVIDENCE_SHIFT = 60


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0, 1 or 2 shifted copies of each queue event (order key modulo 3)."""
    n = row_bound(spark, f"{sf_dir}/supplier.parquet")
    k = F.col("o_orderkey")
    copies = F.explode(F.sequence(F.lit(1), (k % 3).cast("int"))).alias("copy")
    status = F.element_at(F.array(*[F.lit(f) for _, f in FAMILIES]), F.when(F.col("o_orderstatus") == "F", 1)
                          .when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    return table(spark, sf_dir, "orders").where(k % 3 > 0).select("*", copies).select(
        F.concat(k.cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("evidence_id"),
        F.when(k % 7 == 0, k.cast("string")).otherwise("").alias("queue_event_id"),
        norm_code((F.col("o_custkey") % n).cast("string")).alias("code"), status.alias("event_family"),
        F.when(k % 2 == 0, _key("o_orderdate")).otherwise("").alias("source_reference_date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), F.col("copy") * EVIDENCE_SHIFT), "yyyyMMdd").alias("effective_date"),
        _key("o_orderdate").alias("known_at"), F.lit("CASH_DIVIDEND").alias("action_type"),
        F.col("o_totalprice").alias("cash_amount"))
