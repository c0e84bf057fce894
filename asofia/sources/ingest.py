"""Ingest rules, normalisation, keyed writes and health reports.

Readers take all-string frames (leading zeros survive), add typed columns, a
``reasons`` array and ``row_valid``; nothing is dropped silently. A dataset is
written only when every row is valid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from asofia.functions.norm import (OPEN_END, RESEARCH_CUTOFF, apply_rules, clean_number, contains_any, is_placeholder,
                                   norm_code, norm_date, parse_bool, require)
from asofia.sources.session import stored

# Action types accepted at ingest.
ACTION_TYPES = ("CASH_DIVIDEND", "STOCK_DIVIDEND", "BONUS_ISSUE", "SPLIT", "REVERSE_SPLIT", "RIGHTS_ISSUE",
                "MERGER", "SPINOFF")
BAR_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("code", T.StringType()), ("date", T.StringType()), ("open", T.DoubleType()), ("high", T.DoubleType()),
    ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.LongType()), ("source", T.StringType()))])
READINESS = {"bars": 756, "quarters": 120, "annual_years": 3, "features": 500, "labels": 400}


def read_bars(spark: SparkSession, path: str, codes: Sequence[str] | None = None, end: str | None = None) -> DataFrame:
    """Bars of many codes in one scan; both filters reach the Parquet reader."""
    df = spark.read.schema(BAR_SCHEMA).parquet(path)
    if codes is not None:
        df = df.where(F.col("code").isin(list(codes)))
    return df if end is None else df.where(F.col("date") <= end)


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-string CSV; the header decides the columns, so extra ones are kept."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return require(df, columns).fillna("")


def universe_rows(df: DataFrame) -> DataFrame:
    """Enabled securities in file order (``line``), first occurrence wins."""
    on = F.lower(F.trim(F.coalesce("enabled", F.lit("")))).isin("1", "true", "yes", "y")
    industry = F.when(F.trim(F.coalesce("industry", F.lit(""))) == "", "미분류").otherwise(F.trim("industry"))
    rows = df.where(on).select(norm_code("code").alias("code"), industry.alias("industry"), "line")
    return rows.groupBy("code").agg(F.min_by("industry", "line").alias("industry"), F.min("line").alias("line"))


def merge_universe(universe: DataFrame, extra_codes: DataFrame, overrides: DataFrame) -> DataFrame:
    """File codes, then argument codes; overrides replace the industry."""
    extra = extra_codes.select(norm_code("code").alias("code"), F.lit("미분류").alias("industry"),
                               F.col("line") + F.lit(1 << 40)).toDF("code", "industry", "line")
    both = universe.select("code", "industry", "line").unionByName(extra).groupBy("code").agg(
        F.min_by("industry", "line").alias("industry"), F.min("line").alias("line"))
    new = overrides.select(norm_code("code").alias("code"), F.col("industry").alias("_new")).distinct()
    return both.join(new, "code", "left").withColumn("industry", F.coalesce("_new", "industry")).drop("_new")


def _duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_copies``: rows per key, counted with map-side combine and joined back."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")), list(keys))


def _bad_date(c: str) -> Column:
    return F.length(c) != 8


def valuation_rows(df: DataFrame, cutoff: str = RESEARCH_CUTOFF) -> DataFrame:
    require(df, ("code", "snapshot_date", "known_at", "price", "market_cap", "source"))
    df = df.withColumns({"code": norm_code("code"), "snapshot_date": norm_date("snapshot_date"),
                         "known_at": norm_date("known_at"), "price": F.col("price").try_cast("double"),
                         "market_cap": F.col("market_cap").try_cast("double")})
    return apply_rules(_duplicates(df, ["code", "snapshot_date"]), [
        ("snapshot_date", _bad_date("snapshot_date")), ("known_at", _bad_date("known_at")),
        ("known_after_snapshot", F.col("known_at") > F.col("snapshot_date")),
        ("after_cutoff", F.col("snapshot_date") > cutoff), ("price", ~(F.col("price") > 0)),
        ("market_cap", ~(F.col("market_cap") > 0)), ("source", (F.trim("source") == "") | is_placeholder("source")),
        ("duplicate", F.col("_copies") > 1)]).drop("_copies")


def total_return_rows(df: DataFrame, cutoff: str = RESEARCH_CUTOFF, strict: bool = True) -> DataFrame:
    require(df, ("code", "date", "total_return_index", "known_at", "source"))
    df = df.withColumns({"code": norm_code("code"), "date": norm_date("date"), "known_at": norm_date("known_at"),
                         "total_return_index": F.col("total_return_index").try_cast("double")})
    rules = [("date", _bad_date("date")), ("known_at", _bad_date("known_at")),
             ("total_return_index", ~(F.col("total_return_index") > 0)), ("blank_source", F.trim("source") == ""),
             ("duplicate", F.col("_copies") > 1)]
    if strict:
        rules += [("after_cutoff", F.col("date") > cutoff), ("placeholder_source", is_placeholder("source"))]
    return apply_rules(_duplicates(df, ["code", "date"]), rules).drop("_copies")


def action_rows(df: DataFrame, cutoff: str = RESEARCH_CUTOFF, strict: bool = True) -> DataFrame:
    require(df, ("code", "effective_date", "action_type", "adjustment_factor", "cash_amount", "known_at", "source"))
    cash = F.when(F.trim(F.col("cash_amount").cast("string")) == "", F.lit("0")).otherwise(F.col("cash_amount").cast("string"))
    df = df.withColumns({"code": norm_code("code"), "effective_date": norm_date("effective_date"),
                         "known_at": norm_date("known_at"), "action_type": F.upper(F.trim("action_type")),
                         "adjustment_factor": F.col("adjustment_factor").try_cast("double"),
                         "cash_amount": cash.try_cast("double")})
    rules = [("effective_date", _bad_date("effective_date")), ("known_at", _bad_date("known_at")),
             ("known_after_effective", F.col("known_at") > F.col("effective_date")),
             ("action_type", ~F.col("action_type").isin(*ACTION_TYPES)), ("factor", ~(F.col("adjustment_factor") > 0)),
             ("cash", ~(F.col("cash_amount") >= 0)), ("blank_source", F.trim("source") == ""),
             ("duplicate", F.col("_copies") > 1)]
    if strict:
        rules += [("after_cutoff", F.col("effective_date") > cutoff), ("placeholder_source", is_placeholder("source"))]
    return apply_rules(_duplicates(df, ["code", "effective_date", "action_type"]), rules).drop("_copies")


def universe_history_rows(df: DataFrame, cutoff: str = RESEARCH_CUTOFF, strict: bool = True) -> DataFrame:
    dates = ("effective_from", "effective_to", "selection_known_at", "listing_date", "delisting_date")
    require(df, ("code", *dates, "liquidity_eligible", "source"))
    df = df.withColumns({"code": norm_code("code"), **{c: norm_date(c) for c in dates},
                         "liquidity_eligible": parse_bool(F.col("liquidity_eligible").cast("string"))})
    rules = [("effective_from", _bad_date("effective_from")), ("selection_known_at", _bad_date("selection_known_at")),
             ("listing_date", _bad_date("listing_date")),
             ("effective_to", (F.col("effective_to") != "") & _bad_date("effective_to")),
             ("delisting_date", (F.col("delisting_date") != "") & _bad_date("delisting_date")),
             ("selected_late", F.col("selection_known_at") > F.col("effective_from")),
             ("listed_late", F.col("listing_date") > F.col("effective_from")),
             ("ends_before_start", (F.col("effective_to") != "") & (F.col("effective_to") < F.col("effective_from"))),
             ("delisted_before_listing", (F.col("delisting_date") != "") & (F.col("delisting_date") < F.col("listing_date"))),
             ("liquidity_eligible", F.col("liquidity_eligible").isNull()), ("source", F.trim("source") == ""),
             ("duplicate", F.col("_copies") > 1)]
    if strict:
        rules += [("after_cutoff", F.col("effective_from") > cutoff), ("placeholder_source", is_placeholder("source"))]
    return apply_rules(_duplicates(df, ["code", "effective_from", "effective_to"]), rules).drop("_copies")


def security_master_rows(df: DataFrame) -> DataFrame:
    require(df, ("code", "name"))
    df = df.withColumns({"code": norm_code("code"), "name": F.trim("name")})
    return apply_rules(_duplicates(df, ["code"]), [
        ("duplicate", F.col("_copies") > 1), ("name", F.col("name") == "")]).drop("_copies")


def foundation_audit(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per validated dataset: rows, codes, date span, invalid rows, status."""
    out = None
    for name, (df, day) in datasets.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("codes"), F.min(day).alias("first_date"),
                     F.max(day).alias("last_date"), F.count_if(~F.col("row_valid")).alias("invalid_rows"))
        row = row.select(F.lit(name).alias("dataset"), "*", F.when(F.col("rows") == 0, "EMPTY").when(
            F.col("invalid_rows") > 0, "REJECTED").otherwise("VALID").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def write_foundation(datasets: dict[str, tuple[DataFrame, str]], folder: str) -> dict[str, str]:
    """Write every dataset whose rows are all valid; report the status of each."""
    status = {r.dataset: r.status for r in foundation_audit(datasets).collect()}     # one row per dataset
    for name, (df, _) in datasets.items():
        if status[name] == "VALID":
            df.drop("reasons", "row_valid").write.mode("overwrite").parquet(f"{folder}/{name}")
    return status


def merge_latest(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keyed upsert: the delta wins over the base; inside the delta the greatest ``order`` wins.

    One combinable aggregate; no window, so a key with many versions never
    meets in one task.
    """
    rest = [c for c in base.columns if c not in keys]
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.select(*base.columns).withColumn("_side", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max(F.struct("_side", F.col(order).alias("_rank"), *rest)).alias("n"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"n.{c}").alias(c) for c in base.columns])


def touched_partitions(spark: SparkSession, path: str, delta: DataFrame, partition: str) -> DataFrame:
    """The rows of the partitions of the table at ``path`` that ``delta`` has rows for; the scan reads no others."""
    values = [r[0] for r in delta.select(partition).distinct().collect()]   # partition values, not rows
    own = F.col(partition).cast("string").isin([str(v) for v in values if v is not None])
    rows = spark.read.parquet(path).where(own | F.col(partition).isNull() if None in values else own)
    return rows.withColumn(partition, F.col(partition).cast(delta.schema[partition].dataType))


def upsert(spark: SparkSession, path: str, delta: DataFrame, keys: Sequence[str], order: str, partition: str) -> None:
    """Merge ``delta`` into the partitioned table at ``path``; only partitions that it touches are read and replaced.

    ``partition`` is one of the keys or follows from them. The merged partitions
    are written beside the table first and then swapped in by one commit, so a
    run that dies in between leaves the table as it was.
    """
    merged = stored(merge_latest(touched_partitions(spark, path, delta, partition), delta, keys, order))
    write_merged(merged, path, partition)


def write_merged(merged: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``merged`` (dynamic overwrite)."""
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def normalize_prices(raw: DataFrame, source: str) -> DataFrame:
    """Typed bars from text fields of a price service."""
    return raw.select(norm_code("code").alias("code"), norm_date("date").alias("date"),
                      *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
                      F.col("volume").try_cast("double").cast("long").alias("volume"), F.lit(source).alias("source"))


def normalize_financials(raw: DataFrame) -> DataFrame:
    """Typed statement rows; CFS where a (code, year) has any, else OFS."""
    amount = F.regexp_replace(F.coalesce("amount", F.lit("")), ",", "").try_cast("double")
    df = raw.withColumns({
        "amount": amount, "account_order": F.col("account_order").try_cast("int"),
        "disclosed_at": F.coalesce(F.nullif("disclosed_at", F.lit("")), F.substring("rcept_no", 1, 8))})
    cfs = df.groupBy("code", "fiscal_year").agg(F.bool_or(F.col("fs_div") == "CFS").alias("_cfs"))
    return df.join(cfs, ["code", "fiscal_year"]).where(
        F.col("fs_div") == F.when(F.col("_cfs"), "CFS").otherwise("OFS")).drop("_cfs")


def normalize_valuation(raw: DataFrame, unit: float = 100_000_000) -> DataFrame:
    """Market cap arrives in hundreds of millions; unreadable numbers become null."""
    numbers = ("price", "per", "pbr", "eps", "bps")
    return raw.withColumns({**{c: clean_number(c) for c in numbers}, "market_cap": clean_number("market_cap") * unit})


def assemble_valuation(fundamentals: DataFrame, caps: DataFrame, prices: DataFrame, cutoff: str = RESEARCH_CUTOFF) -> DataFrame:
    """Full outer join of three sources on (code, date); rows need a price and a market cap."""
    keys = ["code", "snapshot_date"]
    df = fundamentals.join(caps, keys, "full_outer").join(prices, keys, "full_outer")
    def either(*names: str) -> Column:
        present = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("double")
    df = df.select(*keys, either("price", "종가").alias("price"), either("market_cap", "시가총액").alias("market_cap"),
                   either("per", "PER").alias("per"), either("pbr", "PBR").alias("pbr"),
                   F.col("snapshot_date").alias("known_at"))
    return df.where(F.col("price").isNotNull() & F.col("market_cap").isNotNull() & (F.col("snapshot_date") <= cutoff))


def concat_chunks(chunks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Append chunks in order; the last chunk wins per key."""
    out = None
    for i, c in enumerate(chunks):
        part = c.withColumn("_chunk", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in chunks[0].columns if c not in keys]
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_chunk").alias("n"))
    return newest.select(*keys, *[F.col(f"n.{c}").alias(c) for c in rest])


def calendar_chunks(df: DataFrame, start: str, end: str, unit: str = "YEAR") -> DataFrame:
    """Cut each [start, end] range at calendar years or months."""
    a, b = F.to_date(start, "yyyyMMdd"), F.to_date(end, "yyyyMMdd")
    opened = df.withColumn("_s", F.explode(F.sequence(F.trunc(a, unit), b, F.expr(f"INTERVAL 1 {unit}"))))
    last = F.date_sub(F.add_months("_s", 12 if unit == "YEAR" else 1), 1)
    return opened.withColumns({"chunk_start": F.date_format(F.greatest(F.col("_s"), a), "yyyyMMdd"),
                               "chunk_end": F.date_format(F.least(last, b), "yyyyMMdd")}).drop("_s")


def explode_membership(observed: DataFrame) -> DataFrame:
    """(snapshot_date, codes) to one row per code."""
    return observed.select("snapshot_date", F.explode("codes").alias("code")).select(
        "snapshot_date", norm_code("code").alias("code")).distinct()


def missing_ranges(spans: DataFrame, want_start: str, today: str, refresh_days: int = 7, stale_days: int = 4) -> DataFrame:
    """Date ranges to fetch per code: leading gap, trailing gap, refresh window - merged.

    ``spans``: code, first_date, last_date (null when the code has no bars). A
    code yields at most three candidate ranges, so merging is a fold over a
    three-element array.
    """
    def day(c) -> Column:
        return F.to_date(c, "yyyyMMdd")
    want, now = day(F.lit(want_start)), day(F.lit(today))
    first, last = day(F.col("first_date")), day(F.col("last_date"))
    def rng(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))
    # a leading gap made of weekend days only is no gap
    weekdays = F.size(F.filter(F.sequence(want, F.date_sub(first, 1)), lambda x: F.weekday(x) < 5))
    ranges = F.array_sort(F.array_compact(F.array(
        F.when(first.isNull(), rng(want, now)),
        F.when((first > want) & (weekdays > 0), rng(want, F.date_sub(first, 1))),
        F.when(F.datediff(now, last) > stale_days, rng(F.date_add(last, 1), now)),
        F.when(last.isNotNull(), rng(F.greatest(want, F.date_sub(now, refresh_days - 1)), now)))))
    def merge(acc: Column, x: Column) -> Column:
        tail = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(tail.a.alias("a"), F.greatest(tail.b, x.b).alias("b"))))
        touches = (F.size(acc) > 0) & (x.a <= F.date_add(F.try_element_at(acc, F.lit(-1)).b, 1))
        return F.when(touches, joined).otherwise(F.concat(acc, F.array(x)))
    empty = F.slice(ranges, 1, 0)
    return (spans.withColumn("r", F.explode(F.aggregate(ranges, empty, merge)))
            .select("code", F.date_format("r.a", "yyyyMMdd").alias("range_start"), F.date_format("r.b", "yyyyMMdd").alias("range_end")))


def normalize_dividend_rows(raw: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Common fields plus the whole record as JSON."""
    return raw.select(norm_code("code").alias("code"), *keep, *[F.coalesce(F.get_json_object("payload", f"$.{f}"), F.lit("")).alias(f)
                                                         for f in fields], F.col("payload").alias("raw_json"))


def filter_action_disclosures(raw: DataFrame, keywords: Sequence[str], cutoff: str = RESEARCH_CUTOFF) -> DataFrame:
    return raw.where(contains_any("report_nm", keywords) & (F.col("rcept_dt") <= cutoff))


def event_candidates(raw: DataFrame, date_fields: dict[str, Sequence[str]], hints: dict[str, str]) -> DataFrame:
    """First non-empty date of the endpoint's fields, action hint, bonus factor."""
    date = F.lit(None).cast("string")
    hint = F.lit(None).cast("string")
    for endpoint, fields in date_fields.items():
        first = F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields])
        date = F.when(F.col("endpoint") == endpoint, first).otherwise(date)
        hint = F.when(F.col("endpoint") == endpoint, hints.get(endpoint)).otherwise(hint)
    factor = F.when(hint == "BONUS_ISSUE", 1 + clean_number("allotment_ratio"))
    return raw.withColumns({"candidate_date": norm_date(date), "action_hint": hint, "factor_hint": factor})


def report_disclosure_date(disclosures: DataFrame, report: str, narrow: Sequence[str]) -> DataFrame:
    """Earliest receipt date of a periodic report, narrowed to the quarter where titles allow."""
    hit = disclosures.where(F.col("report_nm").contains(report))
    return hit.groupBy("code", "fiscal_year").agg(F.coalesce(
        F.min(F.when(contains_any("report_nm", narrow), F.col("rcept_dt"))), F.min("rcept_dt")).alias("disclosed_at"))


def trading_calendar(bars: DataFrame, cutoff: str) -> DataFrame:
    return bars.where(F.col("date") <= cutoff).select("date").distinct()


def table_health(tables: dict[str, DataFrame], benchmark_code: str, prices: str = "bars", least_codes: int = 2) -> DataFrame:
    """Row, code and benchmark-row counts per table; ``healthy`` per table and ``all_healthy`` for the whole base.

    Prices need rows of ``least_codes`` codes and of the benchmark, every other
    table some row. Existence is checked, not exact counts, so that legitimate
    updates do not trip it.
    """
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("codes"),
                     F.count_if(F.col("code") == benchmark_code).alias("benchmark_rows")).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    guard = F.when(F.col("table") == prices, (F.col("codes") >= least_codes) & (F.col("benchmark_rows") > 0)).otherwise(True)
    out = out.withColumn("healthy", (F.col("rows") > 0) & guard)
    return out.withColumn("all_healthy", F.bool_and("healthy").over(Window.partitionBy(F.lit(0))))   # one row for each table


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Do the counts of two health reports agree? ``mismatches`` names the counts that differ."""
    metrics = ("rows", "codes", "benchmark_rows")
    both = source.select("table", *[F.col(m).alias(f"source_{m}") for m in metrics]).join(
        copy.select("table", *[F.col(m).alias(f"copy_{m}") for m in metrics]), "table", "full_outer")
    differs = [F.when(~F.col(f"source_{m}").eqNullSafe(F.col(f"copy_{m}")), F.lit(m)) for m in metrics]
    return both.withColumn("mismatches", F.array_compact(F.array(*differs))).withColumn("matches", F.size("mismatches") == 0)


def ml_readiness(codes: DataFrame, counts: dict[str, DataFrame], limits: dict[str, int] = READINESS) -> DataFrame:
    """Rows per code and source against the thresholds for training; a limit without facts is an error."""
    if set(counts) != set(limits):
        raise ValueError(f"facts and limits differ: {sorted(set(counts) ^ set(limits))}")
    df, ready = codes.select("code").distinct(), F.lit(True)
    for name, facts in counts.items():
        df = df.join(facts.groupBy("code").agg(F.count(F.lit(1)).alias(f"{name}_rows")), "code", "left").fillna(0, [f"{name}_rows"])
        ready = ready & (F.col(f"{name}_rows") >= limits[name])
    return df.withColumn("ready", ready)


def run_status(logs: DataFrame, limit: int, today: str, portfolio: str | None = None, stale_days: int = 4) -> DataFrame:
    """Newest runs (a top-n report) with a warning when the last success is old."""
    if portfolio:
        logs = logs.where(F.col("portfolio_id") == portfolio)
    last = logs.agg(F.max(F.when(F.col("status") == "SUCCESS", F.col("run_date")))).scalar()
    age = F.datediff(F.to_date(F.lit(today), "yyyyMMdd"), F.to_date(F.col("last_success"), "yyyyMMdd"))
    return logs.orderBy(F.desc("run_id")).limit(limit).withColumn("last_success", last).withColumn(
        "stale_warning", F.coalesce(age > stale_days, F.lit(True)))


def append_run(spark: SparkSession, record: dict, path: str) -> None:
    """Append one row to a run registry."""
    spark.createDataFrame([record]).write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def book_tables(tables: dict[str, DataFrame], portfolio_id: str) -> dict[str, DataFrame]:
    """The tables of one portfolio, ready to be written."""
    return {name: df.where(F.col("portfolio_id") == portfolio_id) for name, df in tables.items()}
