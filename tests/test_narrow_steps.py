"""Features and labels are derived by need: no wide table is written, and a query moves the columns it names."""

from pyspark.sql import functions as F

from asofia.operators import joins as jn, labels as lb
from asofia.plans import research
from asofia.sources import derived as d, session

SF = "/root/testdata/sf0.001"


def test_dataset_is_derived_and_narrow(spark):
    session._TABLES.clear()
    df = research.dataset(spark, SF, ["excess_return"])
    assert df.columns == ["code", "feature_date", "excess_return"]
    assert df.limit(1).count() == 1
    assert not [t for t in session._TABLES if t.startswith(("asofia_features", "asofia_labels"))]


def test_labels_on_bars_are_the_forward_labels(spark):
    bars, bench = d.bars(spark, SF), d.benchmark(spark, SF)
    names = ["forward_return", "benchmark_forward_return", "excess_return", "positive_excess", "max_drawdown", "label_available_at"]
    want = lb.forward_labels(bars, bench).where("horizon = 20").select("code", "feature_date", *names)
    got = lb.with_labels(bars, bench, 20).where("label_available_at IS NOT NULL").select("code", F.col("date").alias("feature_date"), *names)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_few_facts_are_found_as_by_the_stacked_join(spark):
    left = spark.createDataFrame([("a", "3"), ("a", "5"), ("b", "1"), ("c", "4")], "code string, day string")
    right = spark.createDataFrame([("a", "2", 1, None), ("a", "5", 2, 7.0), ("a", "5", 3, None), ("b", "2", 4, 1.0), ("c", None, 5, 1.0)], "code string, known string, x int, y double")
    few = jn.asof_few(left, right, ["code"], "day", "known", ["x", "y"])
    full = jn.asof_join(left, right, ["code"], "day", "known", ["x", "y"])
    assert sorted(map(str, few.select(full.columns).collect())) == sorted(map(str, full.collect()))


def test_buckets_follow_the_lines(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(d, "BUCKET_LINES", 1000)
    monkeypatch.setattr(d, "_LINES", {})
    monkeypatch.setattr(d, "bucketed_once", lambda spark, name, source, build, **layout: seen.setdefault(name, layout["least"]))
    d.bars(spark, SF), d.statements(spark, SF)
    assert seen["bars"] == seen["statements"] == d.table(spark, SF, "lineitem").count() // 1000 + 1


def test_features_of_small_groups_are_ranked_without_stacking(spark):
    from asofia.operators import ranks as rk
    rows = [(f"c{i}", f"d{i % 40}", "x" if i % 3 else None, float(i * 7919 % 11) if i % 5 else None, float("nan") if i % 9 == 0 else i / 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "code string, feature_date string, industry string, a double, b double")
    for by in (["feature_date"], ["feature_date", "industry"]):
        got = rk.rank_features(df, ["a", "b"], by)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        wide = rk.average_rank(rk.average_rank(df, "a", by, "a_rank"), "b", by, "b_rank")
        want = wide.select("code", "feature_date", *by[1:], wide["a_rank"].alias("a"), wide["b_rank"].alias("b"))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_features_of_hot_and_small_groups(spark):
    from asofia.operators import ranks as rk
    rows = [(f"c{i}", "d0" if i < 900 else f"d{i % 60}", float(i * 7919 % 101) if i % 5 else None) for i in range(2400)]
    df = spark.createDataFrame(rows, "code string, feature_date string, a double")
    got = rk.rank_features(df, ["a"])
    want = rk.average_rank(df, "a", ["feature_date"], "r").select("code", "feature_date", F.col("r").alias("a"))
    assert got.count() == 2400 and got.exceptAll(want).isEmpty()
