"""Exact distributed quantiles and ranks against numpy/pandas brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tabulyst.functions.quantiles import exact_quantiles, group_quantiles, quantile_map
from tabulyst.functions.ranking import column_ranks


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, n)
    b = np.round(rng.exponential(5, n), 1)  # many ties, heavy tail
    hot = np.where(rng.random(n) < 0.34, 7.0, rng.integers(0, 1000, n).astype(float))  # a third is one value
    g = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"a": a, "b": b, "hot": hot, "g": g})
    pdf.loc[::17, "a"] = np.nan
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("max_rows,bins", [(2_000_000, 1024), (50, 8), (7, 2)])
def test_global_quantiles_match_numpy(spark, max_rows, bins):
    df, pdf = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantile_map(df, ["a", "b", "hot"], probs, max_exact_rows=max_rows, bins=bins)
    for c in ["a", "b", "hot"]:
        vals = pdf[c].dropna().to_numpy()
        for p in probs:
            assert got[(c, p)] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-12)


def test_grouped_quantiles_match_pandas(spark):
    df, pdf = _frame(spark)
    res = exact_quantiles(df, ["a", "b"], [0.5, 0.9], by=["g"], max_exact_rows=40, bins=4)
    for r in res:
        vals = pdf.loc[pdf.g == r["g"], r["column"]].dropna()
        assert r["value"] == pytest.approx(float(np.percentile(vals, r["p"] * 100)), rel=1e-12)
        assert r["n"] == len(vals)
        assert r["mean"] == pytest.approx(vals.mean())


def test_all_null_column_is_absent(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert quantile_map(df, ["v"], [0.5]) == {("v", 0.5): None}


@pytest.mark.parametrize("group_rows", [1_000_000, 10])
def test_column_ranks_match_pandas(spark, group_rows):
    df, pdf = _frame(spark, n=800)
    ranks, nd = column_ranks(df, ["b", "hot"], group_rows=group_rows)
    got = ranks.toPandas()
    for c in ["b", "hot"]:
        s = pdf[c].dropna()
        avg = s.rank(method="average")
        dense = s.rank(method="dense") - 1
        g = got[got.column == c].set_index("value")
        assert nd[c] == s.nunique()
        for v, r_avg, r_dense in zip(s, avg, dense):
            row = g.loc[v]
            assert row["below"] + (row["cnt"] + 1) / 2.0 == pytest.approx(r_avg)
            assert row["below_distinct"] == r_dense


@pytest.mark.parametrize("max_rows", [2_000_000, 5])
def test_null_group_key(spark, max_rows):
    df = spark.createDataFrame([(None, float(i)) for i in range(20)] + [("a", float(i)) for i in range(7)],
                               "g string, v double")
    res = {r["g"]: r["value"] for r in exact_quantiles(df, ["v"], [0.5], by=["g"], max_exact_rows=max_rows, bins=4)}
    assert res == {None: 9.5, "a": 3.0}


def _passes(monkeypatch):
    from tabulyst.functions import quantiles as q
    seen, real = [], q._refine
    monkeypatch.setattr(q, "_refine", lambda *a: (seen.append(1), real(*a))[1])
    return seen


@pytest.mark.parametrize("kind", ["infinite", "largest", "log_uniform", "cluster"])
def test_hard_distributions_take_few_rounds(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = {"infinite": np.r_[rng.normal(size=3000), [np.inf] * 5, [-np.inf] * 7],
         "largest": np.r_[rng.normal(size=3000), 1e308, -1e308, 1.7e308],
         "log_uniform": 10.0 ** rng.uniform(-300, 300, 3000),
         "cluster": np.r_[1 + rng.random(3000) * 1e-9, 0.0, 1e300, -5.0]}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    seen = _passes(monkeypatch)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs, max_exact_rows=100, bins=64)}
    x = np.sort(x)
    for p in probs:
        pos = (len(x) - 1) * p
        k = int(pos)
        a, b = x[k], x[min(k + 1, len(x) - 1)]
        assert got[p] == pytest.approx(a if a == b else a + (b - a) * (pos - k), rel=1e-9, abs=1e-12)
    assert len(seen) <= 8


def test_group_quantiles_many_small_and_large_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in range(400) for v in rng.normal(size=3)]
    rows += [(None, float(v)) for v in rng.normal(size=900)] + [(1000, float(v)) for v in rng.normal(size=1200)] + [(2000, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["p"]): r["value"] for r in group_quantiles(df, ["x"], [0.25, 0.5], ["g"], max_exact_rows=100).collect()}
    assert len(got) == 2 * 402
    for g in {g for g, _ in rows} - {2000}:
        values = [v for h, v in rows if h == g]
        for p in (0.25, 0.5):
            assert got[g, p] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("accuracy", [20_000, 100, 20])
@pytest.mark.parametrize("kind", ["uniform", "log", "infinite", "hot", "few"])
def test_three_passes_whatever_the_values(spark, kind, accuracy):
    rng = np.random.default_rng(7)
    n = 4001
    x = {"uniform": rng.random(n), "log": 10.0 ** rng.uniform(-300, 300, n), "infinite": np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.3, -np.inf, rng.normal(size=n))),
         "hot": np.where(rng.random(n) < 0.4, 0.25, rng.random(n)), "few": rng.integers(0, 3, n).astype(float)}[kind]
    df = spark.createDataFrame([(float(v), float(-v), None if i % 5 == 0 else float("nan")) for i, v in enumerate(x)], "x double, `y.z` double, w double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    passes: list[str] = []
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, ["x", "y.z", "w"], probs, max_exact_rows=50, accuracy=accuracy, passes=passes)}
    assert passes in (["sketch", "count"], ["sketch", "count", "finish"])
    assert {c for c, _ in got} == {"x", "y.z"}
    for p in probs:
        for c, v in (("x", np.sort(x)), ("y.z", np.sort(-x))):
            k = int((n - 1) * p)
            a, b, frac = v[k], v[min(k + 1, n - 1)], (n - 1) * p - k
            assert got[(c, p)] == pytest.approx(a if a == b or not frac else a + (b - a) * frac, rel=1e-12, nan_ok=True)


def test_three_passes_with_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(None if g == 0 else f"g.{g}", float(v)) for g in range(4) for v in rng.normal(size=300 * g + 5)]
    passes: list[str] = []
    res = exact_quantiles(spark.createDataFrame(rows, "`g.k` string, x double").repartition(4), ["x"], [0.1, 0.5], by=["g.k"], accuracy=50, passes=passes)
    assert passes == ["sketch", "count", "finish"] and len(res) == 8
    for r in res:
        assert r["value"] == pytest.approx(np.quantile([v for g, v in rows if g == r["g.k"]], r["p"]), rel=1e-12)


def test_targets_outside_a_bracket_are_narrowed(spark, monkeypatch):
    """Were the sketch wrong, the counts would tell and rounds of buckets would find the value."""
    from tabulyst.functions import quantiles as Q

    true = F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda v, near, accuracy: true(v, [0.9 for _ in near], accuracy))
    x = np.arange(1000.0)
    passes: list[str] = []
    got = Q.exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], [0.25, 0.97], max_exact_rows=30, bins=8, passes=passes)
    assert [r["value"] for r in got] == [np.quantile(x, 0.25), np.quantile(x, 0.97)] and "refine" in passes
