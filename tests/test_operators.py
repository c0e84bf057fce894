"""Hand-computed and brute-force checks on small tables."""

import math
import random
import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofia.functions import norm as nm
from asofia.operators import actions as ca, analytics as pa, documents as dx, evidence as ev, indicators as ti
from asofia.operators import joins as jn, labels as lb, models as ml, ranks as rk, signals as sg, splits as sp
from asofia.sources import ingest as ig


def days(n, start=date(2020, 1, 1)):
    return [(start + timedelta(days=i)).strftime("%Y%m%d") for i in range(n)]


def bars_frame(spark, codes=("000001", "000002"), n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in codes:
        p = 100.0
        for d in days(n):
            p = round(max(5.0, p * (1 + rng.uniform(-.05, .05))), 4)
            rows.append((c, d, p * .99, p * 1.02, p * .97, p, rng.randint(1, 50)))
    return spark.createDataFrame(rows, "code string, date string, open double, high double, low double, close double, volume long")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- ranks --------------------------------------------------------------

def rank_table(spark, seed=3):
    """Groups (one of them null) whose values share cells, repeat, are missing or infinite."""
    rng = random.Random(seed)
    values = [None, float("nan"), 0.0, -0.0, *[rng.randint(0, 30) / 2 for _ in range(8)], *[1 + k * 1e-7 for k in range(9)], -1e12, 1e-9, 2e-9]
    data = [(None if i % 11 == 0 else "g%d" % (0 if i % 3 else i % 4), "common_prefix_%s%04d" % ("가나다라마"[i % 5], i), rng.choice(values)) for i in range(400)]
    return spark.createDataFrame(data, "grp string, code string, v double")


@pytest.mark.parametrize("ascending", [True, False])
def test_average_rank_equals_pandas(spark, ascending):
    df = rank_table(spark)
    got = rows(rk.average_rank(df, "v", ["grp"], "r", ascending).select("code", "r"), "code")
    pdf = df.toPandas().sort_values("code")
    want = pdf.groupby(pdf["grp"].fillna("none"))["v"].rank(pct=True, ascending=ascending)
    assert [x[0] for x in got] == sorted(pdf["code"], key=str.encode)
    for x, w in zip(got, want):
        assert (x[1] is None) == bool(pd.isna(w))
        assert x[1] is None or x[1] == pytest.approx(w)


def test_rank_features_keep_groups_apart(spark):
    df = spark.createDataFrame([("a", None, "k1", 1.0), (None, "a", "k2", 2.0), ("a", None, "k3", 3.0), (None, None, "k4", 4.0)],
                               "x string, y string, code string, v double")
    got = {r.code: r.v for r in rk.rank_features(df, ["v"], ["x", "y"], ["code"]).collect()}
    assert got == {"k1": 0.5, "k2": 1.0, "k3": 1.0, "k4": 1.0}


def test_total_order_with_ties_nulls_and_infinities(spark):
    rng = random.Random(5)
    scores = [None, float("-inf"), float("inf"), 1.0, 1.0 + 1e-12, 2.0]
    data = [(None if i % 5 == 0 else "g", rng.choice(["삼성", "현대", "prefix_", "prefix_long_", ""]) + "%03d" % i, rng.choice(scores)) for i in range(300)]
    df = spark.createDataFrame(data, "grp string, code string, v double")
    got = {r.code: (r.score_rank, r.group_rows) for r in rk.with_total_order(df, ["grp"], "v", "code").collect()}
    want = {}
    for g in ("g", None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0.0), x[1].encode()))
        want |= {x[1]: (k + 1, len(own)) for k, x in enumerate(own)}
    assert got == want
    top = rk.top_fraction(df, (.1, .3), ["grp"], "v", "code").groupBy("grp", "top_fraction", "selected_count").count().collect()
    assert len(top) == 4 and all(r["count"] == r.selected_count for r in top)


def test_exact_quantiles(spark):
    df = rank_table(spark).withColumn("v", nm.finite("v")).where("grp IS NOT NULL")
    got = {r["grp"]: r["q"] for r in rk.exact_quantiles(df, "v", ["grp"], {"q": .8}).collect()}
    want = df.toPandas().groupby("grp")["v"].quantile(.8).to_dict()
    assert got == pytest.approx(want)


def test_direction_and_neutral_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "code string, v double")
    up = dict(rows(rk.pct_score(df, "v", "s", True).select("code", "s"), "code"))
    down = dict(rows(rk.pct_score(df, "v", "s", False).select("code", "s"), "code"))
    assert up == {"a": 50.0, "b": 100.0, "c": 50.0} and down == {"a": 100.0, "b": 50.0, "c": 50.0}


# ---- time ---------------------------------------------------------------

def test_future_rows_do_not_change_past_features(spark):
    full = bars_frame(spark, n=200)
    bench = bars_frame(spark, ("B",), n=200, seed=9)
    cut = days(200)[170]
    keep = F.col("date") <= cut
    a = ti.technical_features(full, bench).where(F.col("feature_date") <= cut)
    b = ti.technical_features(full.where(keep).repartition(3), bench.where(keep))
    assert rows(a, "code", "feature_date") == rows(b.select(a.columns), "code", "feature_date")


def test_rsi_flat_values(spark):
    df = spark.createDataFrame([("a", d, 10.0) for d in days(16)], "code string, date string, close double")
    assert ti.rsi(df, flat=50.0).agg(F.max("rsi14")).first()[0] == 50.0
    assert ti.rsi(df, flat=None).agg(F.max("rsi14")).first()[0] is None


def test_label_counts(spark):
    b = bars_frame(spark, n=100)
    bench = bars_frame(spark, ("B",), n=100, seed=5)
    counts = dict(rows(lb.forward_labels(b, bench).groupBy("horizon").count(), "horizon"))
    assert counts == {5: 190, 20: 160, 60: 80}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("unique", [False, True])
def test_asof_against_brute_force(spark, unique, forward):
    rng = random.Random(2)
    d = days(60)
    left = [(c, x, i) for i, (c, x) in enumerate((c, x) for c in "ab" for x in rng.sample(d, 30))]
    right = [(c, x, None if rng.random() < .3 else rng.random()) for c in "ab" for x in rng.sample(d, 12)]
    got = jn.asof_join(spark.createDataFrame(left, "code string, t string, i int"),
                       spark.createDataFrame(right, "code string, k string, v double"), ["code"], "t", "k", ["k", "v"],
                       left_unique=unique, forward=forward)
    for r in got.collect():
        near = [(k, v) for c, k, v in right if c == r.code and (k >= r.t if forward else k <= r.t)]
        want = (min(near) if forward else max(near, key=lambda x: x[0])) if near else (None, None)
        assert (r.k, r.v) == want


def test_count_within_and_interval_join_against_brute_force(spark):
    rng = random.Random(4)
    d = days(90)
    left = [(rng.choice("ab"), rng.choice(d), i) for i in range(50)]
    right = [(rng.choice("ab"), rng.choice(d), f"r{i}") for i in range(30)]
    num = {x: i for i, x in enumerate(d)}
    got = jn.count_within(spark.createDataFrame(left, "code string, t string, i int"),
                          spark.createDataFrame(right, "code string, k string, v string"), ["code"], "t", "k", 3, 5, "v")
    for r in got.collect():
        near = [v for c, k, v in right if c == r.code and -3 <= num[k] - num[r.t] <= 5]
        assert r.match_count == len(near) and r.match_only == (near[0] if len(near) == 1 else None)
    spans = [(c, *sorted(rng.sample(d, 2)), rng.random() < .5) for c in "ab" for _ in range(4)]
    hist = spark.createDataFrame([(c, a, b, a, d[0], "", e) for c, a, b, e in spans],
                                 "code string, effective_from string, effective_to string, selection_known_at string,"
                                 " listing_date string, delisting_date string, liquidity_eligible boolean")
    grid = spark.createDataFrame([(c, x) for c in "ab" for x in d], "code string, feature_date string")
    for r in jn.interval_join(grid, hist).collect():
        inside = [e for c, a, b, e in spans if c == r.code and a <= r.feature_date <= b]
        assert r.covered == bool(inside) and r.eligible == any(inside)


def test_calendar_context_keeps_unreadable_days(spark):
    cal = spark.createDataFrame([("20240102",), ("20240104",), ("20240105",)], "date string")
    ev_ = spark.createDataFrame([("20240105",), ("bad",), (None,)], "day string")
    got = {r.day: (r.prior_1, r.prior_2, r.next_or_same) for r in jn.calendar_context(ev_, cal, "day").collect()}
    assert got == {"20240105": ("20240104", "20240102", "20240105"), "bad": (None,) * 3, None: (None,) * 3}


# ---- books and trades ---------------------------------------------------

def test_total_return_index_reinvests_cash(spark):
    b = spark.createDataFrame([("a", "20200101", 100.0), ("a", "20200102", 99.0)], "code string, date string, close double")
    act = spark.createDataFrame([("a", "20200102", 1.0, 2.0)], "code string, effective_date string, adjustment_factor double, cash_amount double")
    last = ca.total_return_index(b, act, "20200101", "20201231").orderBy(F.desc("date")).first()
    assert last["total_return_index"] == pytest.approx(101.0)


def test_adjustment_break_factor(spark):
    d = days(4)
    raw = spark.createDataFrame([("a", x, c) for x, c in zip(d, (100.0, 100.0, 50.0, 50.0))], "code string, date string, close double")
    adj = spark.createDataFrame([("a", x, 50.0) for x in d], "code string, date string, close double")
    r = ca.adjustment_breaks(raw, adj).collect()
    assert [(x.date, x.factor) for x in r] == [(d[2], 2.0)]


def test_trade_bootstrap_resamples_every_trade(spark):
    rng = random.Random(3)
    data = [(c, rng.uniform(-4, 5)) for c in "ab" for _ in range(40)] + [("c", 2.0)] * 5 + [("d", None)]
    df = spark.createDataFrame(data, "code string, return_pct double")
    got = {r.code: r for r in sg.trade_bootstrap(df, ["code"], sims=4000).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].median_return == pytest.approx((1.02 ** 5 - 1) * 100) and got["c"].mdd_p05 == 0
    for c in "ab":
        logs = [math.log1p(x / 100) for k, x in data if k == c]
        assert math.log1p(got[c].median_return / 100) == pytest.approx(sum(logs), abs=0.05)
        assert got[c].return_p05 < got[c].median_return < got[c].return_p95
    again = {r.code: r for r in sg.trade_bootstrap(df.repartition(3), ["code"], sims=4000).collect()}
    assert again == got


def test_bootstrap_is_reproducible(spark):
    v = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "k int, v double")
    a, b = (pa.bootstrap_ci(v, "k", "v", 200).first() for _ in range(2))
    assert a == b and a.ci_low < 2.0 < a.ci_high


def test_buys_stop_when_cash_is_spent(spark):
    c = "portfolio_id string, code string, cash double, price double, quantity long, difference long, side string, skip_reason string"
    df = spark.createDataFrame([("p", "1", 100.0, 40.0, 0, 2, "BUY", None), ("p", "2", 100.0, 30.0, 0, 5, "BUY", None),
                                ("p", "3", 100.0, 50.0, 1, -1, "SELL", None)], c)
    got = {r.code: r.filled for r in sg.proposals(df).collect()}
    assert got == {"3": 1, "1": 2, "2": 2}


# ---- evidence, text, intake ---------------------------------------------

def test_fail_closed_rules_count_unreadable_values_as_broken(spark):
    df = spark.createDataFrame([("1", "20240101", "20240101", "x", "5", "KRX"), ("2", "20240101", "20240102", "1", "5", "EXAMPLE")],
                               "code string, snapshot_date string, known_at string, price string, market_cap string, source string")
    got = {r.code: r.reasons for r in ig.valuation_rows(df).collect()}
    assert got == {"000001": ["price"], "000002": ["known_after_snapshot", "source"]}


def test_requires_columns(spark):
    with pytest.raises(ValueError, match="missing columns: known_at, source"):
        nm.require(spark.range(1).toDF("code"), ("code", "source", "known_at"))


def test_codes_dates_numbers(spark):
    df = spark.createDataFrame([(" 7 ", "2024-02-30", "1,234원"), ("1234567", "2024.02.03", "-")], "c string, d string, n string")
    got = rows(df.select(nm.norm_code("c"), nm.strict_date("d"), nm.clean_number("n")), F.col("c"))
    assert got == [("000007", "", 1234.0), ("1234567", "20240203", None)]


def test_latest_wins_and_partitioned_write(spark, folder):
    base = spark.createDataFrame([("a", "2020", 1.0), ("a", "2021", 2.0)], "code string, date string, close double")
    delta = spark.createDataFrame([("a", "2021", 3.0)], "code string, date string, close double")
    merged = ig.merge_latest(base, delta, ["code", "date"], "close")
    assert rows(merged, "date") == [("a", "2020", 1.0), ("a", "2021", 3.0)]
    path = f"{folder}/bars"
    ig.write_merged(merged, path, "date")
    ig.write_merged(delta.withColumn("close", F.lit(9.0)), path, "date")
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [1.0, 9.0]


def test_text_reader_keeps_leading_zeros_and_foundation_rejects(spark, folder):
    src = spark.createDataFrame([("000123", "20240101", "20240101", "10", "5", "KRX"), ("000124", "2024", "20240101", "10", "5", "KRX")],
                                "code string, snapshot_date string, known_at string, price string, market_cap string, source string")
    ig.write_report(src, f"{folder}/csv", "csv")
    back = ig.read_text_table(spark, f"{folder}/csv", ["code"])
    assert {r.code for r in back.collect()} == {"000123", "000124"}
    good, bad = back.where("code = '000123'"), back
    status = ig.write_foundation({"good": (ig.valuation_rows(good), "snapshot_date"), "bad": (ig.valuation_rows(bad), "snapshot_date")}, folder)
    assert status == {"good": "VALID", "bad": "REJECTED"} and spark.read.parquet(f"{folder}/good").count() == 1
    ig.append_run(spark, {"model": "m"}, f"{folder}/runs")
    ig.append_run(spark, {"model": "n"}, f"{folder}/runs")
    assert spark.read.parquet(f"{folder}/runs").count() == 2


def test_bar_scan_pushes_filters(spark, folder):
    bars_frame(spark).withColumn("source", F.lit("x")).write.parquet(f"{folder}/b")
    df = ig.read_bars(spark, f"{folder}/b", ["000001"], "20200110")
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,000001)" in plan and "LessThanOrEqual(date,20200110)" in plan


def test_coverage_gate_lists_reasons():
    spec = {"start": "20200101", "end": "20260709", "status": "PASS", **{k: True for k in ca.COVERAGE_FLAGS}}
    assert ca.coverage_gate(spec, "20260709") == [] and "cutoff" in ca.coverage_gate(spec, "20250101")


def test_ambiguous_evidence_stays_open(spark):
    q = spark.createDataFrame([("q1", "1", ev.ACTION, "20240101"), ("q2", "1", ev.DIVIDEND, "20240101"), ("q3", "2", ev.ACTION, "bad")],
                              "queue_event_id string, code string, event_family string, source_reference_date string")
    e = spark.createDataFrame([("e1", "", "1", ev.ACTION, "", "20240105", "20240101", "MERGER", 0.0),
                               ("e2", "", "1", ev.ACTION, "", "20240110", "20240101", "MERGER", 0.0),
                               ("e3", "", "1", ev.DIVIDEND, "", "20240105", "20240101", "CASH_DIVIDEND", 1.0),
                               ("e4", "", "1", ev.DIVIDEND, "", "20240110", "20240101", "CASH_DIVIDEND", 2.0)],
                              "evidence_id string, queue_event_id string, code string, event_family string, source_reference_date string,"
                              " effective_date string, known_at string, action_type string, cash_amount double")
    na = spark.createDataFrame([("q3",)], "queue_event_id string")
    done = ev.resolve_events(q, e, na, 30)
    assert rows(done.select("queue_event_id", "resolution", "note"), "queue_event_id") == [
        ("q1", "UNRESOLVED", "ambiguous_2"), ("q2", "VERIFIED", "expanded_2_cash_events"),
        ("q3", "NOT_APPLICABLE", "explicit_not_applicable_evidence")]
    assert [r.evidence_id for r in ev.verified_rows(done, e, 30).orderBy("evidence_id").collect()] == ["e3", "e4"]


def test_text_without_labels_gives_no_dates(spark):
    df = spark.createDataFrame([(1, "배당기준일 2024년 3월 5일, 배당기준일 2024-03-06"), (2, "nothing"), (3, None)], "i int, t string")
    got = rows(dx.date_after_label(df, "t", ["배당기준일"], 20).select("i", "label_date", "label_date_status"), "i")
    assert got == [(1, None, "AMBIGUOUS"), (2, None, "NONE"), (3, None, "NONE")]


def test_names_in_text_equals_contains(spark):
    names = spark.createDataFrame([("ab",), ("abcdefgh",), ("zz",), ("bcdefg",)], "n string")
    docs = spark.createDataFrame([(1, "xxabcdefghyy"), (2, "a b"), (3, "zabz"), (4, "")], "i int, t string")
    assert rows(dx.names_in_text(names, docs, "n", "i", "t"), "i", "n") == [(1, "ab"), (1, "abcdefgh"), (1, "bcdefg"), (3, "ab")]


def test_models_learn_a_planted_signal(spark):
    rng = random.Random(42)
    data = []
    for i in range(600):
        x = rng.gauss(0, 1)
        data.append(("%06d" % (i % 6), days(100)[i // 6], x, None if i % 7 == 0 else rng.gauss(0, 1), int(x + rng.gauss(0, .7) > 0), x * 2))
    df = spark.createDataFrame(data, "code string, feature_date string, a double, b double, positive_excess int, target double")
    for name in ml.CLASSIFIERS:
        pred = ml.score(ml.fit_classifier(df, ["a", "b"], name, 10), df, ["a", "b"], "probability").withColumn("excess_return", F.lit(1.0))
        r = pa.brier_skill(pred.withColumn("g", F.lit(1)), ["g"]).first()
        assert r["brier_skill"] > .2 and pred.where("probability < 0 OR probability > 1").count() == 0
    fit = ml.fit_regressor(df, ["a", "b"], "ridge")
    assert ml.coefficients(fit, ["a", "b"], spark).first()["feature"] == "a_filled"
    assert ml.candidates(spark).count() == 5


def test_book_tables_hold_one_portfolio(spark, folder):
    df = spark.createDataFrame([("p", 1), ("q", 2)], "portfolio_id string, v int")
    tables = ig.book_tables({"ranking": df, "positions": df.where("v = 2")}, "p")
    ig.write_report(tables["ranking"], f"{folder}/ranking")
    assert spark.read.parquet(f"{folder}/ranking").count() == 1 and tables["positions"].count() == 0


def test_json_walk_reaches_every_leaf(spark):
    from asofia.operators import documents as dx
    data = [(1, '{"a":{"b":{"c":"2024-01-02","n":null}},"l":[{"x":1},2,[]],"e":{}}'), (2, '[1,{"k":"v"}]'), (3, "bad{"), (4, None), (5, '"lone"')]
    got = {(r.k, r.path, r.value, r.date_like) for r in dx.json_fields(spark.createDataFrame(data, "k long, p string"), "k", "p").collect()}
    assert got == {(1, "a.b.c", "2024-01-02", True), (1, "a.b.n", None, None), (1, "l[0].x", "1", False), (1, "l[1]", "2", False), (2, "[0]", "1", False),
                   (2, "[1].k", "v", False), (5, "", "lone", False)}


# ---- hot groups of ranks ---------------------------------------------------

def largest_cell(kept, by, key):
    keyed, cells = rk._in_cells(kept, by, key, F.lit(True))
    assert cells.count() <= 2 * rk.parts_of(kept)
    return keyed.groupBy(*by, "_cell").count().agg(F.max("count")).first()[0]


def test_near_equal_values_and_outlier_ties_are_split(spark):
    n = 100_000
    share = 3 * n / rk.LEAST_PARTS
    near = rk.numbered(spark.range(n).select(F.lit("20200101").alias("day"), (F.lit(100.0) + F.col("id") / 1e7).alias("v"), F.concat(F.lit("KR"), F.lpad("id", 9, "0")).alias("code")))
    assert largest_cell(near, ["day"], [F.col("v"), F.col("_row")]) <= share
    equal = near.withColumn("v", F.lit(1.0)).unionByName(near.limit(1).withColumns({"v": F.lit(1.0), "code": F.lit("US000000001")}))
    assert largest_cell(equal, ["day"], [-F.col("v"), F.col("code"), F.col("_row")]) <= share
    ordered = rk.with_total_order(equal.drop("_row"), ["day"], "v", "code").agg(F.count_distinct("score_rank"), F.max("score_rank"), F.max(F.when(F.col("code") == "US000000001", F.col("score_rank"))), F.max("group_rows")).first()
    assert tuple(ordered) == (n + 1, n + 1, n + 1, n + 1)
    tied = rk.rank_columns(equal.drop("_row"), "v", ["day"]).agg(F.min("_first"), F.max("_first"), F.min("_ties"), F.max("_ties"), F.max("_total")).first()
    assert tuple(tied) == (1, 1, n + 1, n + 1, n + 1)


def test_ranks_equal_pandas_over_hot_and_small_groups(spark):
    rng = np.random.default_rng(9)
    n = 6_000
    frame = pd.DataFrame({"g": np.where(rng.random(n) < .5, "hot", rng.integers(0, 400, n).astype(str)), "v": np.round(rng.normal(size=n), 1), "id": np.arange(n)})
    frame.loc[rng.random(n) < .3, "v"] = 2.5          # one value holds a third of all rows
    frame.loc[rng.random(n) < .1, "v"] = np.nan
    frame.loc[rng.random(n) < .05, "g"] = None
    df = spark.createDataFrame([(None if pd.isna(g) else g, None if np.isnan(v) else float(v), int(i)) for g, v, i in frame.itertuples(index=False)], "g string, v double, id long").repartition(5)
    for ascending in (True, False):
        got = rk.rank_columns(df, "v", ["g"], ascending).toPandas().set_index("id").sort_index()
        by = frame.groupby("g", dropna=False)["v"]
        want = by.rank("min", ascending=ascending)
        assert got["_first"].isna().equals(want.isna()) and (got["_first"].dropna() == want.dropna()).all()
        assert (got["_total"].dropna() == by.transform("count")[want.notna()]).all()
        average = rk.average_rank(df, "v", ["g"], "r", ascending).toPandas().set_index("id").sort_index()["r"]
        assert np.allclose(average.dropna(), by.rank("average", ascending=ascending, pct=True).dropna())
    order = rk.with_total_order(df, ["g"], "v", "id").toPandas().set_index("id").sort_index()
    best = frame.sort_values(["v", "id"], ascending=[False, True], na_position="last").groupby("g", dropna=False).cumcount() + 1
    assert (order["score_rank"] == best.sort_index()).all()
    q = rk.exact_quantiles(df.where("v is not null"), "v", ["g"], {"q": .3}).toPandas().set_index("g")["q"]
    want = frame.dropna(subset=["v"]).groupby("g", dropna=False)["v"].quantile(.3)
    assert len(q) == len(want) and np.allclose(q[q.index.notna()].sort_index(), want[want.index.notna()].sort_index())


def test_ranks_of_no_rows_and_infinite_values(spark):
    none = spark.createDataFrame([], "g string, v double, code string")
    assert rk.rank_columns(none, "v", ["g"]).count() == 0 and rk.with_total_order(none, [], "v", "code").count() == 0
    odd = spark.createDataFrame([("a", float("nan"), "1"), ("a", float("inf"), "2"), ("a", 0.0, "3"), ("a", -0.0, "4"), ("a", None, "5")], "g string, v double, code string")
    up = {r.code: (r["_first"], r["_ties"]) for r in rk.rank_columns(odd, "v", ["g"]).collect()}
    assert up == {"1": (4, 1), "2": (3, 1), "3": (1, 2), "4": (1, 2), "5": (None, None)}
    down = {r.code: r.score_rank for r in rk.with_total_order(odd, ["g"], "v", "code").collect()}
    assert down == {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5}


# ---- local contexts and links ------------------------------------------------

def test_amounts_belong_to_dates_near_them(spark):
    text = "2024-03-05 분배금 지급 100원 " + "가" * 600 + " 2023-01-02 회의 999원. 분배금 2022-02-02 5원"
    df = spark.createDataFrame([(1, text), (2, None), (3, "분배금 2024.1.9 12,500원 12,500 원 0원"), (4, "2024-03-05 100원")], "id long, t string")
    got = {(r.id, r.event_date, r.amount) for r in dx.date_amount_pairs(df, "id", "t", ["분배금"]).collect()}
    assert got == {(1, "20240305", 100.0), (1, "20230102", 999.0), (1, "20230102", 5.0), (1, "20220202", 999.0), (1, "20220202", 5.0), (3, "20240109", 12500.0)}
    assert dx.date_amount_pairs(df, "id", "t", ["분배금"], cutoff="20221231").count() == 2
    assert dx.date_amount_pairs(df.limit(0), "id", "t", ["분배금"]).count() == 0


def test_contexts_are_those_of_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1 2\n") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["1" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = sorted((r.id, r.pattern, r.start, tuple(r.groups), r.context) for r in dx.contexts(df, "id", "t", [r"(a)(b)", r"(1)"], 5, 9).collect())
    want = sorted((i, k, m.start(), m.groups(), t[max(0, m.start() - 5):m.end() + 9]) for i, t in enumerate(texts) for k, p in enumerate([r"(a)(b)", r"(1)"]) for m in re.finditer(p, t))
    assert got == want


def test_links_in_scripts(spark):
    body = """<a href='/a'>x</a> <script>fetch("/api/x"); $.ajax({url: "/api/y", type: 'GET'}); var z = { URL : 'list.do' }; go("javascript:void(0)"); u='//cdn.example.com/s.js'</script>"""
    pages = spark.createDataFrame([(1, "http://h.example.com/d/p.html?q=1", body), (2, "http://h.example.com/", 'fetch("/api/x")')], "id long, url string, html string")
    got = {r.link: r for r in dx.links(pages, "id", "url", "html", ["api"], same_host=True).collect()}
    assert set(got) == {"http://h.example.com" + x for x in ("/a", "/api/x", "/api/y", "/d/list.do")}
    x = got["http://h.example.com/api/x"]
    assert (x.hits, x.sources, x.score) == (4, 2, 1) and len(x.contexts) == 3   # the quoted path and the call, on both pages
    best = dx.rank_endpoints(dx.links(pages, "id", "url", "html", ["api"]), ["api", "ajax"], 1).first()
    assert best.link == "http://h.example.com/api/x" and best.rank_score == 10 + 4 + 3 * 2
    assert "http://cdn.example.com/s.js" in {r.link for r in dx.links(pages, "id", "url", "html", ["api"]).collect()}


def test_selected_document_whatever_the_attribute_order(spark):
    first = '<option value="20230101000001|Y">a</option><option selected value="20240101000002|N">b</option>'
    last = "<option value='20230101000001|Y'>a</option><option value='20240101000003|N' selected>b</option>"
    none = '<option value="20230101000001|Y">a</option> 99999999999999 parent.setPath("x", "https://v.example.com/external/1.htm")'
    rows = dx.doc_ids(spark.createDataFrame([(1, first), (2, last), (3, none), (4, None)], "id int, h string"), "h").orderBy("id").collect()
    assert [r.document_no for r in rows] == ["20240101000002", "20240101000003", "20230101000001", ""]
    assert rows[2].viewer_url == "https://v.example.com/external/1.htm"


# ---- folds, numbering, upsert ------------------------------------------------

def test_folds_are_looked_up_without_a_join(spark):
    rng = random.Random(3)
    d = days(160)
    data = [(f"c{i % 7}", rng.choice(d), rng.choice([*d, None])) for i in range(900)] + [("x", None, d[5])]
    df = spark.createDataFrame(data, "code string, feature_date string, label_available_at string")
    folds = sp.walk_forward_folds(spark.createDataFrame([(x,) for x in d], "feature_date string"), 40, 25, 5)
    table = [tuple(r) for r in folds.orderBy("fold").collect()]
    want = sorted([(c, str(a), str(b), f[0], "train") for c, a, b in data if a and b for f in table if f[1] and a < f[1] and b < f[1]]
                  + [(c, str(a), str(b), f[0], "test") for c, a, b in data if a for f in table if f[2] <= a <= f[3]])
    placed = sp.assign_folds(df, folds)
    assert sorted((r.code, str(r.feature_date), str(r.label_available_at), r.fold, r.part) for r in placed.collect()) == want
    assert "NestedLoop" not in placed._jdf.queryExecution().executedPlan().toString()
    audit = {r.fold: (r.train_rows, r.max_label_available_at) for r in sp.fold_audit(df, folds, 5).collect()}
    for f in table:
        used = [b for _, a, b in data if a and b and f[1] and a < f[1] and b < f[1]]
        assert audit.get(f[0]) == ((len(used), max(used)) if used else None)


def test_one_event_repeated_is_numbered_in_many_tasks(spark):
    n = 20_000
    q = spark.range(n).select("id", *[F.lit(x).alias(c) for c, x in (("code", "000001"), ("event_family", "F"), ("source_reference_date", "20200101"), ("source_description", "same"))])
    q = q.unionByName(q.limit(2).withColumns({"code": F.lit(None).cast("string"), "id": F.col("id") + n}))
    got = ev.with_event_ids(q, ["id"])
    assert got.select("queue_event_id").distinct().count() == n + 2
    import hashlib
    name = lambda code, k: hashlib.sha256("|".join([*([code] if code else []), "F", "20200101", "same", str(k)]).encode()).hexdigest()[:20]
    ids = dict(got.select("id", "queue_event_id").collect())
    assert all(ids[k] == name("000001", k) for k in (0, 1, 777, n - 1)) and ids[n] == name(None, 0)
    key = ["code", "event_family", "source_reference_date", "source_description"]
    assert largest_cell(rk.numbered(q), key, [F.col("id").isNotNull(), F.col("id"), F.col("_row")]) <= 3 * n / rk.LEAST_PARTS


def test_upsert_reads_and_replaces_touched_partitions_only(spark, folder):
    import os
    path = f"{folder}/table"
    rows_ = [(c, f"{y}0{m}01", float(m), 0, str(y)) for c in "ab" for y in (2019, 2020, 2021) for m in range(1, 6)]
    schema = "code string, date string, close double, version int, year string"
    spark.createDataFrame(rows_, schema).repartition(1).write.partitionBy("year").parquet(path)
    before = {y: sorted(os.listdir(f"{path}/year={y}")) for y in (2019, 2020, 2021)}
    delta = spark.createDataFrame([("a", "20200101", 7.0, 1, "2020"), ("a", "20200101", 8.0, 2, "2020"), ("c", "20220101", 9.0, 1, "2022")], schema)
    scan = ig.touched_partitions(spark, path, delta, "year")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "IN (2020,2022)" in plan.split("PartitionFilters:")[1].split("]")[0] and {r.year for r in scan.collect()} == {"2020"}
    ig.upsert(spark, path, delta, ["code", "date"], "version", "year")
    after = {y: sorted(os.listdir(f"{path}/year={y}")) for y in (2019, 2020, 2021)}
    assert after[2019] == before[2019] and after[2021] == before[2021] and after[2020] != before[2020]
    got = {(r.code, r.date): r.close for r in spark.read.parquet(path).collect()}
    assert got == {(c, d): v for c, d, v, _, _ in rows_} | {("a", "20200101"): 8.0, ("c", "20220101"): 9.0}


def test_names_are_found_by_one_scan_in_any_groups(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c漢") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "ab" * 5_000]
    names = ["".join(rng.choice("abc漢") for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["", None, "ab", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    table = spark.createDataFrame([(n,) for n in names], "n string")
    want = sorted({(i, n) for i, t in enumerate(texts) for n in names if n and t and n in t})
    for most in (1 << 20, 20):
        assert sorted(map(tuple, dx.names_in_text(table, docs, "n", "id", "t", most).collect())) == want
    assert dx.names_in_text(table.limit(0), docs, "n", "id", "t").count() == 0


def test_draws_are_even_and_give_the_usual_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=37)
    v = spark.createDataFrame([(i, float(y)) for i, y in enumerate(x)], "k int, v double")
    picks = pa.bootstrap_draws(v, "k", "v", 2_000, 42).groupBy("pick").count().toPandas()["count"]
    assert len(picks) == 37 and abs(picks / 2_000 - 1).max() < 0.12
    got = pa.bootstrap_ci(v, "k", "v").first()
    low, high = np.quantile(x[rng.integers(0, 37, (20_000, 37))].mean(1), [.025, .975])
    assert abs(got.ci_low - low) < 0.03 and abs(got.ci_high - high) < 0.03
