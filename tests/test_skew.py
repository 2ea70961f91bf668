"""Hot keys: one value holding a third of all rows must not change results.

Each check compares the distributed operator with a plain pandas computation on
a table where one key / value / day / row holds about a third of the rows.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tabulyst.functions.cells import cell_counts, modes, top_values
from tabulyst.operators import compare as CMP
from tabulyst.operators import correlate as COR
from tabulyst.operators import forecast as FC
from tabulyst.operators import profile as P


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(21)
    n = 3000
    hot_mask = rng.random(n) < 0.34
    k = np.where(hot_mask, 0, rng.integers(1, 400, n))
    x = np.where(hot_mask, 5.0, rng.normal(10, 3, n).round(2))
    y = np.where(hot_mask, 1.0, rng.integers(0, 40, n).astype(float))
    s = np.where(hot_mask, "hot", np.char.add("v", rng.integers(0, 50, n).astype(str)))
    pdf = pd.DataFrame({"k": k, "x": x, "y": y, "s": s})
    return spark.createDataFrame(pdf), pdf


def test_duplicates_with_a_hot_row(hot):
    df, pdf = hot
    q = P.quality_summary(df).first()
    assert q["duplicate_rows"] == int(pdf.duplicated().sum())


def test_modes_and_top_values_with_a_hot_value(hot):
    df, pdf = hot
    cnt = cell_counts(df, ["s", "k"])
    m = {r["column"]: r["mode"] for r in modes(cnt).collect()}
    assert m["s"] == "hot" and m["k"] == "0"
    top = top_values(cnt, 3).where("column = 's'").orderBy("rank").collect()
    vc = pdf.s.value_counts()
    assert [r["n"] for r in top] == sorted(vc.values, reverse=True)[:3]


def test_statistics_and_ranks_with_a_hot_value(hot):
    df, pdf = hot
    st = {r["column"]: r for r in P.describe_numeric(df, ["x", "y"], max_exact_rows=100, bins=16).collect()}
    assert st["x"]["median"] == pytest.approx(pdf.x.median()) and st["y"]["median"] == pytest.approx(pdf.y.median())
    sp = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in COR.correlate(df, method="spearman").pairs.collect()}
    assert sp[("x", "y")] == pytest.approx(round(pdf[["x", "y"]].corr(method="spearman").loc["x", "y"], 4), abs=1e-4)


def test_key_diff_with_a_hot_key(spark, hot):
    df, pdf = hot
    other = df.where("k % 2 = 0")
    ks = CMP.key_summary(df, other, "k").first()
    assert ks["common_rows"] == pdf.k[pdf.k % 2 == 0].nunique()
    assert ks["rows_only_in_1"] == pdf.k[pdf.k % 2 == 1].nunique()


def test_forecast_with_a_hot_day(spark):
    """Repeated rows on one day: the fit uses per-day sums, equal to the row-level fit."""
    rows = []
    for i in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        reps = 400 if i == 10 else 1  # one day holds most of the rows
        rows += [(day, 100.0 + i)] * reps
    df = spark.createDataFrame(rows, "ds date, y double")
    res = FC.forecast(df, "ds", "y", periods=5)
    split = res.split.orderBy("ds").collect()
    assert split[10]["n"] == 400 and sum(r["n"] for r in split) == 459
    # the boundary follows row counts: int(0.8 * 459) = 367 rows train
    assert sum(r["n"] for r in split if r["is_train"]) >= 367
    fc = res.forecast.orderBy("ds").collect()
    assert len(fc) == 5 and all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in fc)
