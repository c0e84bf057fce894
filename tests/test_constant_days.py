"""Days on which all securities tie have no rank correlation, and the query goes on."""

from pyspark.sql import functions as F

from asofia.operators import analytics as pa


def test_constant_day_has_no_correlation(spark):
    rows = [("d1", 1.0, 2.0), ("d1", 1.0, 3.0), ("d2", 1.0, 5.0), ("d2", 2.0, 5.0), ("d3", .5, 1.0), ("d3", .5, 1.0), ("d4", 1.0, 1.0),
            ("d5", 1.0, 4.0), ("d5", 2.0, 6.0), ("d5", 3.0, 5.0)]
    ic = pa.daily_ic(spark.createDataFrame(rows, "feature_date string, score double, excess_return double"))
    got = {r["feature_date"]: r["rank_ic"] for r in ic.select("feature_date", F.round("rank_ic", 9).alias("rank_ic")).collect()}
    assert got == {"d1": None, "d2": None, "d3": None, "d4": None, "d5": .5}
