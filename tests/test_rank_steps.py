"""Ranks of many columns: one sort of the rows by their group, whatever the number of columns; groups are never cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from asofia.operators import ranks as rk


def rows_of(spark, n=4000):
    k = F.col("id")
    value = lambda m, share: F.when(F.xxhash64(k, F.lit(m)) % share != 0, (F.xxhash64(k, F.lit(m + 10)) % m).cast("double"))
    day = F.when(k % 30 != 0, F.concat(F.lit("d"), k % 50))   # null is a group, too
    return spark.range(n).select(F.concat(F.lit("c"), k).alias("code"), day.alias("feature_date"), F.when(k % 7 != 0, F.concat(F.lit("i"), k % 4)).alias("industry"),
                                 value(5, 3).alias("x"), value(1000, 4).alias("y"), F.when(k % 50 != 3, value(3, 9)).alias("z"))


@pytest.mark.parametrize("by", [["feature_date"], ["feature_date", "industry"]])
@pytest.mark.parametrize("step", [1, 700, 100_000])
def test_percentiles_are_those_of_windows(spark, monkeypatch, by, step):
    monkeypatch.setattr(rk, "ROWS_AT_ONCE", step)
    df, names = rows_of(spark), ["x", "y", "z"]
    group = Window.partitionBy(*by)
    lo = lambda c: F.rank().over(group.orderBy(F.col(c).asc_nulls_last()))
    hi = lambda c: F.count(c).over(group.orderBy(F.col(c).asc_nulls_last()))
    want = df.select("code", *by, *[F.when(F.col(c).isNotNull(), (lo(c) + (hi(c) - lo(c)) / 2) / F.count(c).over(group)).alias(c) for c in names])
    got = rk.rank_features(df, names, by).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_are_sorted_once(spark):
    df = rows_of(spark)
    plan = rk.rank_features(df, ["x", "y", "z"], ["feature_date", "industry"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort ") == 1 and "Window" not in plan


def test_a_long_group_is_ranked_whole():
    day = ["a"] * 3 + ["b"] * 50 + ["c"] * 2
    table = pa.table({"day": day, "x": np.arange(55.0)})
    out = pa.Table.from_batches(rk._grouped_percentiles(["x"], ["day"], 4)(iter(table.to_batches(max_chunksize=5))))
    assert out["day"].to_pylist() == day
    np.testing.assert_allclose(out["x"].to_numpy(), [*np.arange(1, 4) / 3, *np.arange(1, 51) / 50, .5, 1])
