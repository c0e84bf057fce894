"""The ensemble writes its features once; targets and percentiles are ranked without them."""

import itertools

from pyspark.sql import functions as F

from asofia.operators import joins as jn, labels as lb, models as ml, ranks as rk
from asofia.plans import learning


def test_day_lookup_is_a_left_join(spark):
    left = spark.createDataFrame([("a", "20200101", 1), ("a", "20200102", 2), ("a", None, 3), ("b", "20200101", 4), (None, "20200101", 5), ("a", "20200101", 6)],
                                 "code string, day string, n int")
    right = spark.createDataFrame([("a", "20200101", .5), ("a", "20200101", .5), ("b", "20200102", .1), ("a", None, .2), (None, "20200101", .3)], "code string, day string, v double")
    got = {r["n"]: r["v"] for r in jn.on_day(left, right, "code", "day", "v").collect()}
    assert got == {1: .5, 2: None, 3: None, 4: None, 5: None, 6: .5}


def test_features_are_written_once(spark, monkeypatch):
    k = F.col("id")
    noise = lambda m: F.xxhash64(k, F.lit(m)) % 1000 / 1000.0
    day = lambda n: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")), "yyyyMMdd")
    given = spark.range(7 * 800).select(F.concat(F.lit("c"), k % 7).alias("code"), day(F.floor(k / 7)).alias("feature_date"), day(F.floor(k / 7) + 5).alias("label_available_at"),
                                        noise(99).alias("excess_return"), *[noise(i).alias(c) for i, c in enumerate(learning.FEATURES) if c != "market_regime"], F.lit(1).alias("market_regime"))
    monkeypatch.setattr(learning, "dataset", lambda spark, sf, columns: given.select(*dict.fromkeys(["code", "feature_date", *columns])))
    seen = []
    for module in (learning, rk, ml):
        monkeypatch.setattr(module, "stored", lambda df, real=module.stored: seen.append(df.columns) or real(df))
    got = learning.ensemble_scores(spark, "")
    assert [c for c in seen if "roe" in c] == seen[1:2] and len(seen) == 4
    plain = learning.sp.purged_split(lb.make_target(given, "cross_sectional_rank"), 252, 252)
    for (target, want) in itertools.pairwise([learning.ranked_split_data(spark, ""), plain]):
        key = ["code", "feature_date", "target", "split"]
        assert target.select(key).exceptAll(want.select(key)).isEmpty() and target.count() == want.count()
    want = ml.ensemble(plain.where("split = 'train'"), plain.where("split = 'validation'"), learning.FINANCIAL, learning.PRICE, "ridge")
    pairs = got.join(want.select("code", "feature_date", F.col("score").alias("want")), ["code", "feature_date"])
    assert got.count() == pairs.count() == 7 * (252 - 5) and pairs.where("abs(score - want) > 1e-9").isEmpty()
