"""Cross-sectional ranks that survive a hot group.

A cross-section (one date, one industry on one date) can hold any number of
securities, so a window over the group alone would put all of it in one task.
Ranks come from one exchange of the rows by (group, cell) and one sort inside
the cells, in the engine's own order:

* A group that holds more than 1/PARTS of all rows is cut into cells at
  quantiles of a sample of its own order keys. There are at most PARTS such
  groups and 2 PARTS cells, whatever the data, so the tables about them are
  broadcast. A smaller group is one cell. The key ends with a unique tie, so hot
  groups, near-equal values and equal values are all cut alike, and the cut moves
  no rank: a cell's rows are numbered inside it and shifted by the cells before.
* A run of equal values that a cut divides gets its rank and length from counts
  of its cells; there are no more such runs than cuts.

The input is written once before it is read by the counts, the sample and the
ranks, so it is computed once and cells are the same in all of them.

Groups are compared null-safe. Null values have no rank; NaN is the greatest
value, as in Spark's own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.norm import finite, is_financial, join_reasons
from asofia.functions.search import count_at_most
from asofia.sources.session import stored

LEAST_PARTS = 16
SAMPLE = 128   # keys for each part
ROWS_IN_PART = 500_000
ROWS_AT_ONCE = 100_000   # rows that are ranked in one step, if their groups allow


def on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    if not keys:
        return left.join(right, how=how) if how != "inner" else left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_same_{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def parts_of(df: DataFrame) -> int:
    """Cells that the rows are dealt into at least; only the dealing depends on it."""
    return max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame) -> DataFrame:
    """The frame written once, with a unique number ``_row``."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def _in_cells(kept: DataFrame, by: Sequence[str], key: Sequence[Column], taking_part: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_cell`` and ``_cuts`` (keys that divide a hot group), and the cells of the hot groups.

    ``key`` orders a group, ascending, and is unique in it. The second frame has
    ``_before`` (rows of the group in earlier cells), ``_in_cell`` and ``_in_group``.
    """
    by, parts = list(by), parts_of(kept)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    rows = kept.where(taking_part)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.select(F.sum("_n")).scalar()
    hot = sizes.where(F.col("_n") * parts > total).select(*by, F.ceil(F.col("_n") * parts / total).alias("_want"))   # at most `parts` groups
    sample = on_same(rows.select(*by, key.alias("_key"), F.xxhash64("_row").alias("_h")), F.broadcast(hot), by).orderBy("_h").limit(SAMPLE * parts)
    keys = F.sort_array(F.collect_list("_key"))
    at = lambda j: F.element_at("_keys", (F.floor(j * F.size("_keys") / F.col("_want")) + 1).cast("int"))
    cuts = (sample.groupBy(*by).agg(keys.alias("_keys"), F.first("_want").alias("_want"))   # the sample is bounded
            .select(*by, F.when(F.col("_want") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("_want") - 1)), at)).alias("_cuts")))
    cell = count_at_most(F.col("_cuts"), key, (2 * parts).bit_length())
    keyed = on_same(kept, F.broadcast(cuts), by, "left").withColumn("_cell", F.when(taking_part & F.col("_cuts").isNotNull(), cell).otherwise(0))
    counted = keyed.where(taking_part & F.col("_cuts").isNotNull()).groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return keyed, counted.select(*by, "_cell", "_in_cell", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_before"), F.sum("_in_cell").over(group).alias("_in_group"))


def _ranked(kept: DataFrame, value: str, by: Sequence[str], ascending: bool) -> DataFrame:
    """A numbered frame with ``_first`` (competition rank), ``_ties`` and ``_total`` over non-null values."""
    by = list(by)
    v = F.col(value).cast("double")
    place = [v] if ascending else [~F.isnan(v), -v]   # NaN is the greatest
    known = F.col(value).isNotNull()
    keyed, cells = _in_cells(kept, by, [*place, F.col("_row")], known)
    own = Window.partitionBy(*by, "_cell")
    sorted_ = own.orderBy(*[c.asc_nulls_last() for c in place])
    local = keyed.withColumns({"_lo": F.rank().over(sorted_), "_hi": F.count(value).over(sorted_), "_all": F.count(value).over(own)})
    # runs of one value in more than one cell: in the first of them they are its last rows
    last = len(place) - 1
    cut = F.array_contains(F.transform("_cuts", lambda c: c[f"k{last}"]), place[last])
    inside = on_same(keyed.where(known & cut).groupBy(*by, value, "_cell").agg(F.count(F.lit(1)).alias("_c")), cells, [*by, "_cell"])
    runs = (inside.groupBy(*by, value).agg(F.min(F.struct("_cell", (F.col("_before") + F.col("_in_cell") - F.col("_c") + 1).alias("first"))).alias("_x"),
                                           F.sum("_c").alias("_run_ties"), F.count(F.lit(1)).alias("_cells"))
            .where("_cells > 1").select(*by, value, F.col("_x.first").alias("_run_first"), "_run_ties"))
    out = on_same(on_same(local, F.broadcast(cells), [*by, "_cell"], "left"), F.broadcast(runs), [*by, value], "left")
    return out.withColumns({
        "_first": F.when(known, F.coalesce("_run_first", F.coalesce("_before", F.lit(0)) + F.col("_lo"))),
        "_ties": F.when(known, F.coalesce("_run_ties", F.col("_hi") - F.col("_lo") + 1)),
        "_total": F.when(known, F.coalesce("_in_group", "_all")),
    }).drop("_cuts", "_cell", "_lo", "_hi", "_all", "_in_cell", "_before", "_in_group", "_run_first", "_run_ties")


def _positions(kept: DataFrame, by: Sequence[str], key: Sequence[Column]) -> DataFrame:
    """A kept frame with ``_position`` (from 1) in the order of ``key``, unique in a group, and ``_in_group``."""
    by = list(by)
    keyed, cells = _in_cells(kept, by, key, F.lit(True))
    own = Window.partitionBy(*by, "_cell")
    local = keyed.withColumns({"_place": F.row_number().over(own.orderBy(*key)), "_all": F.count(F.lit(1)).over(own)})
    out = on_same(local, F.broadcast(cells), [*by, "_cell"], "left")
    return (out.withColumns({"_position": F.coalesce("_before", F.lit(0)) + F.col("_place"), "_in_group": F.coalesce("_in_group", "_all")})
            .drop("_cuts", "_cell", "_place", "_all", "_in_cell", "_before"))


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Number from 1 of each row in its group, nulls of ``order`` first; equal rows are numbered in any order."""
    key = [x for c in order for x in (F.col(c).isNotNull(), F.col(c))]
    return _positions(numbered(df), by, [*key, F.col("_row")]).withColumnRenamed("_position", out).drop("_in_group", "_row")


def rank_columns(df: DataFrame, value: str, by: Sequence[str], ascending: bool = True) -> DataFrame:
    """Add ``_first`` (competition rank), ``_ties`` and ``_total`` over non-null values."""
    if not by:
        return rank_columns(df.withColumn("_whole", F.lit(0)), value, ["_whole"], ascending).drop("_whole")
    return _ranked(numbered(df), value, by, ascending).drop("_row")


def average_rank(df: DataFrame, value: str, by: Sequence[str], out: str, ascending: bool = True,
                 pct: bool = True) -> DataFrame:
    """Average-tie rank, as a share of the non-null values when ``pct``; null stays null."""
    ranked = rank_columns(df.withColumn("_value", finite(F.col(value).cast("double"))), "_value", by,
                          ascending)
    place = F.col("_first") + (F.col("_ties") - 1) / 2
    return (ranked.withColumn(out, place / F.col("_total") if pct else place)
            .drop("_value", "_first", "_ties", "_total"))


def pct_score(df: DataFrame, value: str, out: str, higher: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Percentile score 0..100 with a neutral 50 for missing values."""
    ranked = average_rank(df, value, by, out, ascending=higher)
    return ranked.withColumn(out, F.coalesce(F.col(out) * 100, F.lit(50.0)))


def xs_percentile(df: DataFrame, value: str, out: str, by: Sequence[str] = ("feature_date",)) -> DataFrame:
    """Same-day percentile with a neutral 0.5."""
    return average_rank(df, value, by, out).withColumn(
        out, F.coalesce(out, F.lit(.5)))


def rank_many(df: DataFrame, specs: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Average-tie percentiles of many expressions in one pass.

    ``specs`` maps an output name to (value, group); negate a value to rank it
    downwards. Only (row number, name, group, value) are stacked and ranked, by
    one exchange for all of them; the percentiles go back to their row once.
    Nulls stay null.
    """
    kept = numbered(df)
    cells = [F.struct(
        F.lit(i).alias("i"), (F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))).alias("g"),
        finite(value.cast("double")).alias("v")) for i, (value, group) in enumerate(specs.values())]
    long = kept.select("_row", F.explode(F.array(*cells)).alias("p")).select("_row", "p.i", "p.g", "p.v").where(F.col("v").isNotNull())
    place = (F.col("_first") + (F.col("_ties") - 1) / 2) / F.col("_total")
    placed = _ranked(long, "v", ["i", "g"], True).select("_row", "i", place.alias("_p"))
    wide = placed.repartition("_row").groupBy("_row").agg(   # the exchange moves single percentiles, not rows of partial maxima
        *[F.max(F.when(F.col("i") == i, F.col("_p"))).alias(out) for i, out in enumerate(specs)])
    return kept.drop(*specs).join(wide, "_row", "left").drop("_row")


def _percentiles(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average-tie percentile of each value among those of its group; NaN stands for null and stays."""
    order = np.argsort(values)
    order = order[np.argsort(group[order], kind="stable")]   # by group, then by value, NaN last
    v, g = values[order], group[order]
    at = np.arange(len(v))
    starts = np.r_[True, g[1:] != g[:-1]]
    first = np.maximum.accumulate(np.where(starts, at, 0))
    runs = np.flatnonzero(starts | np.r_[True, v[1:] != v[:-1]])
    length = np.diff(np.r_[runs, len(v)])
    lo = np.repeat(runs, length) - first + 1
    hi = np.repeat(runs + length, length) - first
    out = np.empty(len(v))
    with np.errstate(invalid="ignore", divide="ignore"):
        out[order] = np.where(np.isnan(v), np.nan, (lo + (hi - lo) / 2) / np.bincount(group[~np.isnan(values)], minlength=int(group.max()) + 1)[g])
    return out


def _changes(rows: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Whether a row begins a new group; nulls are equal to each other."""
    begins = np.zeros(rows.num_rows, bool)
    begins[:1] = True
    for c in by:
        codes = rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return begins


def _grouped_percentiles(columns: Sequence[str], by: Sequence[str], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Percentiles of ``columns`` over batches that lie sorted by ``by``; at least ``least`` rows, if there are, and whole groups at a time."""
    def ranked(rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = begins.cumsum() - 1
        group = group.astype(np.uint16 if group[-1] < 65_536 else np.int64)   # short keys are sorted by radix
        for c in columns:
            values = rows[c].combine_chunks().to_numpy(zero_copy_only=False)
            rows = rows.set_column(rows.column_names.index(c), rows.schema.field(c), pa.array(_percentiles(values, group), from_pandas=True))
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, wanted = [], 0, least
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < wanted:
                continue
            rows = pa.Table.from_batches(waiting)
            begins = _changes(rows, by)
            cut = int(np.flatnonzero(begins)[-1])
            if cut:
                yield from ranked(rows.slice(0, cut), begins[:cut])
            waiting, n = rows.slice(cut).to_batches(), n - cut
            wanted = max(least, 2 * n)   # a group that goes on is looked at again when it has doubled
        if n:
            rows = pa.Table.from_batches(waiting)
            yield from ranked(rows, _changes(rows, by))

    return run


def _ranked_in_groups(df: DataFrame, columns: Sequence[str], by: Sequence[str], rows: int) -> DataFrame:
    """Percentiles of many columns where no group is hot: one exchange and one sort of whole rows, by their group.

    The groups of a task are ranked a bounded number of rows at a time, column by column.
    """
    parts = max(parts_of(df), rows // ROWS_IN_PART + 1)
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns}).repartition(parts, *by).sortWithinPartitions(*by)
    return df.mapInArrow(_grouped_percentiles(columns, by, ROWS_AT_ONCE), df.schema)


def rank_features(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("feature_date",),
                  keys: Sequence[str] = ("code", "feature_date")) -> DataFrame:
    """Same-day percentile of many columns at once; nulls are kept.

    Whole rows are dealt by their group once and ranked there, column by column.
    Rows of groups that are hot, or too many for one step, are stacked and ranked in cells, as in ``rank_many``.
    """
    extra = [c for c in by if c not in keys]
    names = [*keys, *extra, *columns]
    rows = df.select(*names)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = sizes.where((F.col("_n") * parts_of(df) > total) | (F.col("_n") > ROWS_IN_PART)).drop("_n")   # at most `parts` groups, and one for each ROWS_IN_PART rows
    if hot.isEmpty():
        return _ranked_in_groups(rows, columns, by, total).select(*names)
    kept = stored(rows)
    group = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in by])
    ranked = rank_many(on_same(kept, F.broadcast(hot), by), {f"{c}_rank": (F.col(c), group) for c in columns})
    ranked = ranked.select(*keys, *extra, *[F.col(f"{c}_rank").alias(c) for c in columns])
    return ranked.unionByName(_ranked_in_groups(on_same(kept, F.broadcast(hot), by, "left_anti"), columns, by, total).select(*names))


def with_total_order(df: DataFrame, by: Sequence[str], score: str, tie: str, out: str = "score_rank") -> DataFrame:
    """Row number by score descending, then tie key ascending, and ``group_rows``.

    The tie key must be unique inside a group; rows without a score come last.
    """
    if not by:
        return with_total_order(df.withColumn("_whole", F.lit(0)), ["_whole"], score, tie, out).drop("_whole")
    s = F.col(score).cast("double")
    placed = _positions(numbered(df), by, [s.isNull(), ~F.isnan(s), -s, F.col(tie), F.col("_row")])
    return placed.withColumns({out: F.col("_position").cast("int"), "group_rows": F.col("_in_group")}).drop("_position", "_in_group", "_row")


def top_fraction(df: DataFrame, fractions: Sequence[float] = (.1, .2, .3),
                 by: Sequence[str] = ("feature_date",), score: str = "score", tie: str = "code",
                 minimum: int = 1) -> DataFrame:
    """Best ceil(n * fraction) rows of each group, for several fractions at once."""
    ordered = with_total_order(df, by, score, tie)
    want = F.greatest(F.lit(minimum), F.ceil(F.col("group_rows") * F.col("top_fraction")))
    return (ordered.withColumn("top_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
            .where(F.col("score_rank") <= want)
            .withColumn("selected_count", F.least(want, F.col("group_rows"))))


def quality_value_momentum(df: DataFrame, key: Sequence[str] = ("code",), min_peers: int = 3) -> DataFrame:
    """Quality, value, momentum and risk scores of a universe in one ranking pass.

    Quality is the mean of five part scores; financial firms use ROE, growth
    and profit only. Value compares PER, PBR and dividend inside the industry,
    or in the whole universe where fewer than ``min_peers`` values are valid.
    """
    c = F.col
    valid = {"per": F.when(c("per") > 0, c("per")), "pbr": F.when(c("pbr") > 0, c("pbr")),
             "dividend_yield": F.when(c("dividend_yield") >= 0, c("dividend_yield"))}
    specs = {"_roe": (c("roe"), None), "_margin": (c("operating_margin"), None),
             "_growth": (c("revenue_growth"), None), "_debt": (-c("debt_ratio"), None),
             "_rel": (c("relative_3m"), None), "_r6": (c("return_6m"), None), "_r3": (c("return_3m"), None),
             "_vol": (-c("volatility_60"), None), "_dd": (c("drawdown_6m"), None)}
    for field, value in valid.items():
        signed = value if field == "dividend_yield" else -value
        specs |= {f"_local_{field}": (signed, c("industry")), f"_all_{field}": (signed, None)}
    counts = df.groupBy("industry").agg(*[F.count(v).alias(f"_n_{f}") for f, v in valid.items()])
    whole = counts.agg(*[F.sum(f"_n_{f}").alias(f) for f in ("per", "pbr")])
    df = rank_many(df, specs).join(counts, "industry")

    def score(name: str) -> Column:
        return F.coalesce(c(name) * 100, F.lit(50.0))

    def peer(field: str) -> Column:
        return F.coalesce(F.when(local[field], c(f"_local_{field}")).otherwise(c(f"_all_{field}")) * 100, F.lit(50.0))

    local = {f: c(f"_n_{f}") >= min_peers for f in valid}
    financial = is_financial("industry")
    cash = F.coalesce((c("operating_cash_flow") > 0).cast("int"), F.lit(0)) * 100
    profit = F.coalesce((c("net_income") > 0).cast("int"), F.lit(0)) * 100
    general = (score("_roe") + score("_margin") + score("_growth") + score("_debt") + cash) / 5
    bank = score("_roe") * .60 + score("_growth") * .20 + profit * .20
    return df.withColumns({
        "quality_score": F.when(financial, bank).otherwise(general),
        "quality_model": F.when(financial, "금융업").otherwise("일반업종"),
        "value_score": peer("per") * .45 + peer("pbr") * .35 + peer("dividend_yield") * .20,
        "per_peer_count": F.when(local["per"], c("_n_per")).otherwise(whole.select("per").scalar()),
        "pbr_peer_count": F.when(local["pbr"], c("_n_pbr")).otherwise(whole.select("pbr").scalar()),
        "valuation_reference": F.concat(F.when(local["per"], "PER:업종").otherwise("PER:전체"), F.lit("/"),
                                        F.when(local["pbr"], "PBR:업종").otherwise("PBR:전체")),
        "momentum_score": score("_rel") * .45 + score("_r6") * .35 + score("_r3") * .20,
        "risk_score": score("_vol") * .60 + score("_dd") * .40,
    }).drop(*specs, *[f"_n_{f}" for f in valid])


def data_confidence(df: DataFrame) -> DataFrame:
    def share(columns: Sequence[str]) -> Column:
        total = F.lit(0)
        for c in columns:
            total = total + F.col(c).isNotNull().cast("int")
        return total / len(columns)
    return df.withColumn("data_confidence", share(("per", "pbr", "eps", "bps")) * 40
                         + share(("roe", "operating_margin", "revenue_growth", "debt_ratio")) * 40 + 20)


def input_status(df: DataFrame) -> DataFrame:
    """Valuation, earnings and financial status from which inputs are there."""
    complete = (F.col("per").isNotNull() & F.col("pbr").isNotNull()
                & F.col("eps").isNotNull() & F.col("bps").isNotNull())
    return df.withColumns({
        "valuation_status": F.when(F.coalesce(F.col("valuation_date"), F.lit("")) == "", "누락")
        .when(~complete, "일부 누락").when(F.col("valuation_age_days") > 7, "오래됨").otherwise("정상"),
        "earnings_status": F.when(F.col("per").isNull(), "누락").when(F.col("per") <= 0, "적자").otherwise("흑자"),
        "financial_status": F.when(F.col("data_confidence") >= 100, "완전")
        .when(F.col("data_confidence") >= 80, "일부 누락").otherwise("부족")})


def eligibility(df: DataFrame, min_liquidity: float = 1_000_000_000) -> DataFrame:
    reasons = join_reasons([
        (F.col("earnings_status") != "흑자", "적자 또는 PER 누락"),
        (F.coalesce("roe", F.lit(0.0)) <= 0, "ROE 0% 이하 또는 누락"),
        (F.col("data_confidence") < 80, "데이터 신뢰도 80 미만"),
        (F.col("liquidity") < min_liquidity, "20일 평균 거래대금 부족")])
    warning = join_reasons([
        (F.col("earnings_status") == "적자", "적자 PER 제외"),
        (F.coalesce("valuation_age_days", F.lit(9999)) > 7, "가치지표 7일 초과")])
    return df.withColumns({"ineligible_reason": reasons, "eligible": reasons == "", "data_warning": warning})


def rank_universe(momentum: DataFrame, valuation: DataFrame, annual: DataFrame, industry: DataFrame,
                  min_liquidity: float = 1_000_000_000) -> DataFrame:
    """Score every security: 30 % quality, 25 % value, 25 % momentum, 20 % risk."""
    df = (momentum.join(industry.select("code", "industry"), "code", "left")
          .withColumn("industry", F.coalesce("industry", F.lit("미분류")))
          .join(valuation, "code", "left").join(annual, "code", "left"))
    df = df.withColumns({
        "price": F.coalesce(F.when(F.col("price") != 0, F.col("price")), F.col("close")),
        "return_3m": F.col("return_63") * 100, "return_6m": F.col("return_126") * 100,
        "relative_3m": F.col("relative_63") * 100, "volatility_60": F.col("volatility_60") * 100,
        "drawdown_6m": F.col("drawdown_126") * 100})
    df = quality_value_momentum(df)
    df = eligibility(input_status(data_confidence(df)), min_liquidity)
    return df.withColumn("total_score", F.col("quality_score") * .30 + F.col("value_score") * .25
                         + F.col("momentum_score") * .25 + F.col("risk_score") * .20)


def skip_mean(columns: Sequence[Column]) -> Column:
    """Row mean over the non-null columns."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
        n = n + c.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def factor_score(df: DataFrame) -> DataFrame:
    def m(*names: str) -> Column:
        return skip_mean([F.col(n) for n in names])
    parts = [m("relative_20", "relative_60"), m("roe", "operating_margin"),
             1 - m("historical_pbr", "historical_per"), 1 - m("volatility_20", "volatility_60")]
    return df.withColumn("factor_score", F.coalesce(skip_mean(parts), F.lit(.5)))


def blend(financial: Column, momentum: Column, weight: float | None = None,
          regime: Column | None = None) -> Column:
    """Fixed financial weight, or .30 / .50 / .65 in rising / flat / falling markets."""
    if weight is not None:
        w = F.lit(weight)
    else:
        r = F.coalesce(regime, F.lit(0))
        w = F.when(r > 0, .30).when(r < 0, .65).otherwise(.50)
    return financial * w + momentum * (1 - w)


def strategy_scores(df: DataFrame, raw_financial: str, financial_only: bool = False,
                    financial_threshold: float = .0, timing_threshold: float = .0,
                    momentum_weight: float = .0, risk_weight: float = .0) -> DataFrame:
    """Three same-day percentiles, their weighted score and the common entry gate."""
    df = df.withColumns({
        "_mom": skip_mean([F.col(c) for c in ("relative_20", "relative_60", "ma_60_gap")]),
        "_risk": 1 - skip_mean([F.col(c) for c in ("volatility_20", "volatility_60", "atr_14_pct")])})
    named = {"financial_score": raw_financial, "momentum_score": "_mom", "risk_score": "_risk"}
    df = rank_many(df, {out: (F.col(c), F.col("feature_date")) for out, c in named.items()}).drop("_mom", "_risk")
    df = df.withColumns({out: F.coalesce(out, F.lit(.5)) for out in named})
    weighted = (F.col("financial_score") * (1 - momentum_weight - risk_weight)
                + F.col("momentum_score") * momentum_weight + F.col("risk_score") * risk_weight)
    return df.withColumns({
        "score": F.col("financial_score") if financial_only else weighted,
        "financial_eligible": F.col("financial_score") >= max(.35, financial_threshold),
        "momentum_eligible": F.col("momentum_score") >= max(.35, timing_threshold),
    }).withColumn("signal_eligible", F.col("financial_eligible") & F.col("momentum_eligible"))


def rank_predictions(df: DataFrame, score: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """Competition rank, best first."""
    return (rank_columns(df, score, by, ascending=False)
            .withColumnRenamed("_first", "prediction_rank").drop("_ties", "_total"))


def select_best(metrics: DataFrame, weights: dict[str, float], ties: Sequence[Column | str]) -> DataFrame:
    """Weighted sum of metric percentiles; ``selected`` marks the best row.

    ``metrics`` has one row per predeclared candidate, so its windows are tiny.
    """
    df = rank_many(metrics, {f"_p_{m}": (F.coalesce(finite(F.col(m).cast("double")), F.lit(-999.0)), None) for m in weights})
    total = F.lit(0.0)
    for metric, weight in weights.items():
        total = total + F.col(f"_p_{metric}") * weight
    df = df.withColumn("selection_score", total)
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("selection_score"), *ties)
    return (df.withColumn("selected", F.row_number().over(best) == 1)
            .drop(*[f"_p_{m}" for m in weights]))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group from order statistics.

    Once every row has its position, a combinable aggregate is enough.
    """
    by = list(by)
    whole = not by
    if whole:
        df, by = df.withColumn("_whole", F.lit(0)), ["_whole"]
    ranked = _positions(numbered(df.where(F.col(value).isNotNull()).select(*by, value)), by, [F.col(value), F.col("_row")])
    cols = {}
    for name, q in quantiles.items():
        pos = (F.col("_in_group") - 1) * q + 1
        cols |= {f"_lo_{name}": F.max(F.when(F.col("_position") <= F.floor(pos), F.col(value))),
                 f"_hi_{name}": F.max(F.when(F.col("_position") <= F.ceil(pos), F.col(value))),
                 f"_f_{name}": F.max(pos - F.floor(pos))}
    out = ranked.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])
    out = out.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                            for n in quantiles])
    return out.drop("_whole") if whole else out
