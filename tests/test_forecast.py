"""Per-key forecasting: recovery of trend + weekday effect, dates, intervals."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tabulyst.operators import forecast as FC


@pytest.fixture(scope="module")
def weekly(spark):
    """F5 weekly: 3 keys x 200 days of trend + weekday effect + small noise."""
    rng = np.random.default_rng(11)
    rows = []
    for k, (base, slope) in enumerate([(100, 0.5), (50, -0.1), (500, 2.0)]):
        for i in range(200):
            day = dt.date(2023, 1, 1) + dt.timedelta(days=i)
            y = base + slope * i + 8 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 0.5)
            rows.append((f"k{k}", day, float(y)))
    return spark.createDataFrame(rows, "k string, ds date, y double")


def test_forecast_recovers_pattern(weekly):
    res = FC.forecast(weekly, "ds", "y", keys=["k"], periods=14)
    fc = res.forecast.toPandas()
    assert len(fc) == 42
    assert (fc.yhat_lower <= fc.yhat).all() and (fc.yhat <= fc.yhat_upper).all()
    # horizon starts the day after the last training day (day 160 of 200)
    assert fc.ds.min() == dt.date(2023, 1, 1) + dt.timedelta(days=160)
    test = res.test.toPandas()
    truth = {(f"k{k}", dt.date(2023, 1, 1) + dt.timedelta(days=i)): b + s * i + 8 * np.sin(2 * np.pi * i / 7)
             for k, (b, s) in enumerate([(100, 0.5), (50, -0.1), (500, 2.0)]) for i in range(200)}
    err = max(abs(r.yhat - truth[(r.k, r.ds)]) for r in test.itertuples())
    assert err < 3.0
    summ = {r["k"]: r for r in res.summary.collect()}
    assert summ["k0"]["historical_points"] == 200 and summ["k0"]["mape"] < 0.05


def test_refit_and_dates(weekly):
    one = weekly.where("k = 'k0'").drop("k")
    res = FC.forecast(one, "ds", "y", periods=5, refit=True)
    assert [r["ds"] for r in res.forecast.orderBy("ds").collect()][0] == dt.date(2023, 7, 20)
    dates = FC.future_dates(weekly, "ds", "y", ["k"], periods=3).where("k = 'k1'").orderBy("ds").collect()
    assert [r["ds"] for r in dates] == [dt.date(2023, 6, 10), dt.date(2023, 6, 11), dt.date(2023, 6, 12)]


def test_too_few_points(spark):
    small = spark.createDataFrame([(dt.date(2024, 1, i + 1), float(i)) for i in range(10)], "ds date, y double")
    with pytest.raises(ValueError):
        FC.forecast(small, "ds", "y")


def test_text_dates_parse(spark):
    rows = [((dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "d string, v double")
    res = FC.forecast(df, "d", "v", periods=3)
    assert res.forecast.count() == 3
    assert pd.notna(res.summary.first()["projected_value"])


def test_short_series_are_skipped(spark, weekly):
    short = spark.createDataFrame([("tiny", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(10)],
                                  "k string, ds date, y double")
    res = FC.forecast(weekly.unionByName(short), "ds", "y", keys=["k"], periods=2)
    assert {r["k"] for r in res.skipped.collect()} == {"tiny"}
    assert {r["k"] for r in res.forecast.collect()} == {"k0", "k1", "k2"}


def test_a_failing_series_is_a_row_among_good_ones(spark):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float("inf") if k == "bad" and i == 9 else float(i)) for k in ("good", "bad", "fine") for i in range(40)]
    res = FC.forecast(spark.createDataFrame(rows, "k string, d date, v double"), "d", "v", keys=["k"], periods=3)
    assert [(r["k"], "not finite" in r["error"]) for r in res.failed.collect()] == [("bad", True)]
    assert {r["k"] for r in res.forecast.collect()} == {"good", "fine"} and res.forecast.count() == 6
    assert {r["k"] for r in res.test.collect()} == {"good", "fine"}


def test_the_cut_falls_inside_equal_instants(spark):
    # 30 instants of 7 rows, an instant of 40 equal rows, a null key; int(.8 n) falls inside an instant
    at = lambda i: dt.datetime(2024, 3, 1, 6, 30) + dt.timedelta(hours=i)
    rows = [(k, at(i), float(i + j)) for k in ("a", None) for i in range(30) for j in range(7)] + [("b", at(i), 2.0) for i in (0, 1) for _ in range(40)]
    series = FC.prepare_series(spark.createDataFrame(rows, "k string, t timestamp, v double"), "t", "v", ["k"], keep_time=True)
    stats, holdout = FC.instant_split(series, ["k"])
    got = stats.groupBy("k", "is_train").agg({"n": "sum", "sy": "sum", "ds": "count"}).collect()
    counts = {(r["k"], r["is_train"]): (r["sum(n)"], r["count(ds)"]) for r in got}
    assert counts == {(k, True): (168, 24) for k in ("a", None)} | {(k, False): (42, 6) for k in ("a", None)} | {("b", True): (64, 2), ("b", False): (16, 1)}
    assert {r["k"]: r["sum(sy)"] for r in got if r["k"] == "b" and r["is_train"]} == {"b": 128.0}
    odd = series.where("k = 'a'").limit(0).unionByName(series.where("k = 'a' and y <> 3"))
    stats, holdout = FC.instant_split(odd, ["k"])
    n = odd.count()
    sides = {r["is_train"]: r["n"] for r in stats.groupBy("is_train").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert sides == {True: int(n * 0.8), False: n - int(n * 0.8)}
    kept = sorted((r["ds"], r["y"]) for r in holdout.collect() for _ in range(r["n"]))
    first = stats.where("is_train").agg({"ds": "max"}).first()[0]
    assert len(kept) == sides[False] and kept[0][0] >= first
    assert FC.instant_split(odd, ["k"])[1].exceptAll(holdout.repartition(5)).count() == 0


def test_series_with_a_time_of_day(spark):
    # a weekly wave sampled each six hours; the horizon goes on from the last training instant
    at = lambda i: dt.datetime(2024, 1, 1, 3) + dt.timedelta(hours=6 * i)
    wave = lambda i: 100 + 0.1 * i + 8 * np.sin(2 * np.pi * i / 28)
    df = spark.createDataFrame([(at(i), float(wave(i))) for i in range(600)], "t timestamp, v double")
    res = FC.forecast(df, "t", "v", periods=8, step_seconds=6 * 3600)
    got = res.forecast.orderBy("ds").collect()
    assert [r["ds"] for r in got] == [at(i) for i in range(480, 488)]
    assert max(abs(r["yhat"] - wave(480 + j)) for j, r in enumerate(got)) < 3
    assert res.test.count() == 120 and res.summary.first()["mape"] < 0.05
    # whole days by default, as for series of dates
    assert [r["ds"] for r in FC.forecast(df, "t", "v", periods=2).forecast.orderBy("ds").collect()] == [at(483), at(487)]
    assert FC.forecast(df, "t", "v", periods=2, grain="day").forecast.schema["ds"].dataType.typeName() == "date"
    with pytest.raises(ValueError):
        FC.forecast(df, "t", "v", grain="week")
