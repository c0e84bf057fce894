"""Model selection writes no second copy of its rows, and metrics move only their own columns."""

from pyspark.sql import functions as F

from asofia.operators import analytics as pa, models as ml, ranks as rk


def test_no_features_are_written_again(spark, monkeypatch):
    seen = []

    def recorded(real):
        return lambda df: seen.append(df.columns) or real(df)

    monkeypatch.setattr(ml, "durable", recorded(ml.durable))
    monkeypatch.setattr(rk, "stored", recorded(rk.stored))
    if hasattr(ml, "stored"):
        monkeypatch.setattr(ml, "stored", recorded(ml.stored))
    n = F.col("id")
    data = spark.range(400).select(
        F.concat(F.lit("c"), n % 10).alias("code"), F.format_string("1998%04d", (n / 10).cast("int")).alias("feature_date"), F.format_string("1998%04d", (n / 10).cast("int")).alias("label_available_at"),
        (n % 7 / 7).alias("x"), (n % 11 / 11).alias("z"), (n * 7919 % 13 > 6).cast("int").alias("positive_excess"), (n % 5 - 2.0).alias("excess_return"),
        F.when(n < 240, "train").when(n < 320, "validation").otherwise("lockbox").alias("split"))
    name, metrics, _ = ml.select_and_refit(data, ["x", "z"], iterations=2)
    assert name in ml.CLASSIFIERS and metrics.count() == 3
    assert seen and not [c for c in seen if {"x", "z", "code"} & set(c)]


def test_metrics_move_their_own_columns(spark, monkeypatch):
    seen = []
    real = rk.stored
    monkeypatch.setattr(rk, "stored", lambda df: seen.append(df.columns) or real(df))
    df = spark.createDataFrame([(f"c{i}", i / 20, i % 2, float(i), "wide") for i in range(20)], "code string, probability double, positive_excess int, excess_return double, rest string")
    assert pa.classification_metrics(df).first()["sample_count"] == 20
    assert seen and not [c for c in seen if {"code", "rest"} & set(c)]
