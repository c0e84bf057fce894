"""Forward-looking labels. Each row carries the day on which it became knowable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from asofia.functions.windows import bar_window
from asofia.operators.joins import entry_exit
from asofia.operators.ranks import average_rank

HORIZONS = (5, 20, 60)


def forward_labels(bars: DataFrame, benchmark: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward return, benchmark return, excess, path drawdown, availability date.

    All horizons come from one window pass. A row is skipped when the benchmark
    lacks a close at either end or when the horizon runs past the last bar.
    """
    bench = benchmark.select("date", F.col("close").alias("_b"))   # one row per day
    w = bar_window()
    base = bars.select("code", "date", "close").join(bench, "date", "left")
    ahead = {}
    for h in horizons:
        ahead |= {f"_c{h}": F.lead("close", h).over(w), f"_b{h}": F.lead("_b", h).over(w),
                  f"_low{h}": F.min("close").over(w.rowsBetween(1, h)), f"_d{h}": F.lead("date", h).over(w)}
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_c{h}").alias("c1"), F.col(f"_b{h}").alias("b1"),
                              F.col(f"_low{h}").alias("low"), F.col(f"_d{h}").alias("label_available_at"))
                     for h in horizons])
    long = base.withColumns(ahead).select("code", "date", "close", "_b", F.explode(rows).alias("h")).select(
        "code", "date", "close", "_b", "h.*")
    future = F.col("c1") / F.col("close") - 1
    market = F.col("b1") / F.col("_b") - 1
    return (long.where(F.col("label_available_at").isNotNull() & F.col("_b").isNotNull() & F.col("b1").isNotNull())
            .select("code", F.col("date").alias("feature_date"), "horizon",
                    (future * 100).alias("forward_return"), (market * 100).alias("benchmark_forward_return"),
                    ((future - market) * 100).alias("excess_return"),
                    (future - market > 0).cast("int").alias("positive_excess"),
                    ((F.col("low") / F.col("close") - 1) * 100).alias("max_drawdown"), "label_available_at"))


def with_labels(bars: DataFrame, benchmark: DataFrame, horizon: int) -> DataFrame:
    """The bars with the columns of ``forward_labels`` at one horizon, null where it has no row.

    They come from the windows of the bars themselves, so a frame that goes on
    with windows over the code needs no join to carry labels.
    """
    w = bar_window()
    bench = benchmark.select("date", F.col("close").alias("_b"))   # one row per day
    staged = bars.join(bench, "date", "left").withColumns({
        "_c1": F.lead("close", horizon).over(w), "_b1": F.lead("_b", horizon).over(w),
        "_low": F.min("close").over(w.rowsBetween(1, horizon)), "_d1": F.lead("date", horizon).over(w)})
    known = F.col("_d1").isNotNull() & F.col("_b").isNotNull() & F.col("_b1").isNotNull()
    future = F.col("_c1") / F.col("close") - 1
    market = F.col("_b1") / F.col("_b") - 1
    labels = {"forward_return": future * 100, "benchmark_forward_return": market * 100, "excess_return": (future - market) * 100,
              "positive_excess": (future - market > 0).cast("int"), "max_drawdown": (F.col("_low") / F.col("close") - 1) * 100,
              "label_available_at": F.col("_d1")}
    return staged.withColumns({name: F.when(known, c) for name, c in labels.items()}).drop("_b", "_c1", "_b1", "_low", "_d1")


def ml_dataset(features: DataFrame, labels: DataFrame, horizon: int,
               keys: Sequence[str] = ("code", "feature_date")) -> DataFrame:
    """Feature rows with their label at one horizon; rows without an excess return drop out."""
    chosen = labels.where((F.col("horizon") == horizon) & F.col("excess_return").isNotNull()).drop("horizon")
    return features.join(chosen, list(keys))


def total_return_labels(data: DataFrame, history: DataFrame, benchmark_code: str,
                        min_coverage: float = .999) -> DataFrame:
    """Replace price labels by total-return labels if nearly all endpoints exist.

    The coverage is one number, used as a scalar subquery, so the decision needs
    no driver round trip.
    """
    joined = entry_exit(data, history.where(F.col("code") != benchmark_code),
                        history.where(F.col("code") == benchmark_code), "total_return_index")
    rate = joined.agg(F.avg(F.col("price_covered").cast("double"))).scalar()
    use = rate >= min_coverage
    fwd = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    mkt = (F.col("benchmark_exit") / F.col("benchmark_entry") - 1) * 100
    staged = joined.withColumns({
        "_use": use, "raw_close_forward_return": F.col("forward_return"),
        "raw_close_benchmark_forward_return": F.col("benchmark_forward_return")})
    staged = staged.withColumns({
        "forward_return": F.when(F.col("_use"), fwd).otherwise(F.col("forward_return")),
        "benchmark_forward_return": F.when(F.col("_use"), mkt).otherwise(F.col("benchmark_forward_return"))})
    excess = F.col("forward_return") - F.col("benchmark_forward_return")
    return (staged.withColumns({
        "excess_return": F.when(F.col("_use"), excess).otherwise(F.col("excess_return")),
        "positive_excess": F.when(F.col("_use"), F.coalesce((excess > 0).cast("int"), F.lit(0)))
        .otherwise(F.col("positive_excess"))})
        .withColumnRenamed("_use", "total_return_used")
        .drop("entry_price", "exit_price", "benchmark_entry", "benchmark_exit", "price_covered"))


def make_target(df: DataFrame, kind: str, out: str = "target") -> DataFrame:
    """Excess value, or its same-day percentile over the market or the industry."""
    if kind == "excess_regression":
        return df.withColumn(out, F.col("excess_return").cast("double"))
    by = {"cross_sectional_rank": ["feature_date"],
          "industry_neutral_rank": ["feature_date", "industry"]}[kind]
    return average_rank(df, "excess_return", by, out)


def rebalance_index(df: DataFrame, horizon: int, day: str = "feature_date") -> DataFrame:
    """Distinct days with their order and whether every h-th one (no overlap).

    The window runs over distinct days, that is over one calendar.
    """
    days = df.select(day).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    return (days.withColumn("day_index", F.row_number().over(w) - 1)
            .withColumn("non_overlapping", F.col("day_index") % horizon == 0))
