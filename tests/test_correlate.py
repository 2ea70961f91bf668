"""Correlation: Pearson/Spearman against pandas, Kendall tau-b against brute force, p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tabulyst.functions.pvalues import correlation_p_value
from tabulyst.operators import correlate as COR


def _brute_tau_b(x, y):
    n = len(x)
    s = nx = ny = 0
    for i in range(n):
        dx = np.sign(x[i] - x[i + 1:])
        dy = np.sign(y[i] - y[i + 1:])
        s += int(np.sum(dx * dy))
        nx += int(np.sum(dx != 0))
        ny += int(np.sum(dy != 0))
    return s / math.sqrt(nx * ny)


def test_kendall_tau_b_with_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 2000)
    y = (x // 3 + rng.integers(0, 8, 2000)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert COR.kendall_tau_b(df, "x", "y") == pytest.approx(_brute_tau_b(x, y), abs=1e-12)


@pytest.mark.parametrize("block_points", [None, 40, 7])
def test_kendall_blocks_and_hot_values(spark, block_points):
    rng = np.random.default_rng(11)
    x = np.where(rng.random(900) < 0.4, 5, rng.integers(0, 300, 900))  # one value holds a third of the rows
    y = np.where(rng.random(900) < 0.4, -3.5, np.round(rng.normal(size=900) + x / 200, 2))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y.z": y})).repartition(3)
    assert COR.kendall_tau_b(df, "x", "y.z", block_points=block_points) == pytest.approx(_brute_tau_b(x, y), abs=1e-12)
    assert COR.kendall_tau_b(df, "y.z", "x", block_points=block_points) == pytest.approx(_brute_tau_b(x, y), abs=1e-12)


def test_inversions_equal_brute_force():
    from tabulyst.functions.inversions import inversions

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        y, c = rng.integers(0, 12, n), rng.integers(1, 9, n)
        assert inversions(y, c) == sum(c[i] * c[j] for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


def test_kendall_blocks_stay_small_with_a_hot_value(spark):
    """A value of X that holds a third of all rows is cut along Y."""
    from tabulyst.functions import inversions as INV
    from tabulyst.functions.ranking import attach_ranks

    n = 3000
    x = np.where(np.arange(n) % 3 == 0, 1, np.arange(n))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (np.arange(n) * 7919) % n}))
    sizes = {}
    r = attach_ranks(df, ["x", "y"], kind="below")
    yat = r["y"] / float(n)
    for row in r.select(((r["x"] + r["x__n"] * yat) / float(n) * 30).cast("int").alias("block")).groupBy("block").count().collect():
        sizes[row["block"]] = row["count"]
    assert len(sizes) == 30 and max(sizes.values()) < 3 * n / 30
    assert INV.BLOCK_POINTS >= 1


@pytest.mark.parametrize("broadcast_rows", [100_000, 50, 0])
def test_spearman_with_repeated_rows_and_hot_values(spark, broadcast_rows):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"a.b": np.where(rng.random(600) < 0.4, 1.0, rng.integers(0, 40, 600)), "b": rng.integers(0, 5, 600), "c": rng.normal(size=600), "d": 2.0})
    pdf = pd.concat([pdf, pdf.iloc[:200]])  # repeated rows
    got = COR.spearman_values(spark.createDataFrame(pdf).repartition(4), list(pdf.columns), broadcast_rows=broadcast_rows)
    want = pdf.corr(method="spearman")
    assert len(got) == 6 and got[("a.b", "d")] is None
    for (x, y), v in got.items():
        if "d" not in (x, y):
            assert v == pytest.approx(want.loc[x, y], abs=1e-12)


def test_pearson_spearman_match_pandas(spark, shop):
    pdf = shop.toPandas().drop(columns=["date"])
    for method in ("pearson", "spearman"):
        res = COR.correlate(shop, target="sales", method=method)
        got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in res.pairs.collect()}
        exp = pdf.corr(method=method)
        for (a, b), v in got.items():
            assert v == pytest.approx(round(exp.loc[a, b], 4), abs=1e-4)
        # constant conversion_rate: undefined, excluded from pairs and target ranking
        assert not any("conversion_rate" in k for k in got)
        target = [r["feature"] for r in res.target.orderBy("rank").collect()]
        assert "conversion_rate" not in target and len(target) == 3
    res = COR.correlate(shop, target="sales")
    assert {(r["feature_a"], r["feature_b"]) for r in res.multicollinear.collect()} == {("marketing_spend", "traffic"),
                                                                                         ("marketing_spend", "customers"),
                                                                                         ("traffic", "customers")}


def test_p_value_known_values():
    # two-sided Student t tails, checked by numerical integration of the t density
    assert correlation_p_value(0.5, 10) == pytest.approx(0.1411133, abs=1e-6)
    assert correlation_p_value(0.3, 30) == pytest.approx(0.1072459, abs=1e-6)
    assert correlation_p_value(0.0, 50) == pytest.approx(1.0)
    assert correlation_p_value(1.0, 50) == 0.0


def test_kendall_matrix(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 300), "b": rng.normal(size=300), "c": rng.integers(0, 50, 300)})
    res = COR.correlate(spark.createDataFrame(pdf), method="kendall")
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in res.pairs.collect()}
    assert len(got) == 3
    for (a, b), v in got.items():
        assert v == pytest.approx(round(_brute_tau_b(pdf[a].to_numpy(float), pdf[b].to_numpy(float)), 4), abs=1e-4)
    assert res.top_pairs.where("p_value IS NOT NULL").count() == 0


def test_all_null_and_constant_columns(spark):
    rows = [(float(i), None, 1.0, float(i * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, empty double, c double, b double")
    res = COR.correlate(df, target="a")
    got = {(r["feature_a"], r["feature_b"]) for r in res.pairs.collect()}
    assert got == {("a", "b")}
    assert [r["feature"] for r in res.target.collect()] == ["b"]


def test_kendall_reads_rows_once_without_a_shuffle_join(spark, monkeypatch):
    seen = []
    whole = COR.kendall_pairs
    monkeypatch.setattr(COR, "kendall_pairs", lambda ranked, *rest: seen.append(ranked) or whole(ranked, *rest))
    # 120,000 distinct values in x
    df = spark.range(0, 120_000, numPartitions=4).selectExpr("cast(id as double) as x", "cast(id % 3 as double) as y")
    got = COR.correlation_values(df, ["x", "y"], "kendall")[("x", "y")]
    n, t = 120_000, 40_000
    # for classes a < b of y, row i of a is above the first i rows of b and, but for them, below the others
    conc, disc = sum(t * (t + 1) / 2 for _ in range(3)), sum(t * (t - 1) / 2 for _ in range(3))
    n0 = n * (n - 1) / 2
    assert got == pytest.approx((conc - disc) / np.sqrt(n0 * (n0 - 3 * t * (t - 1) / 2)), abs=1e-12)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not seen[0].is_cached


def test_kendall_ties_with_gaps(spark):
    rng = np.random.default_rng(21)
    x, y = rng.integers(0, 6, 200).astype(float), rng.integers(0, 5, 200).astype(float)
    rows = [(None if i % 9 == 0 else float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    both = [(a, b) for a, b in rows if a is not None and b is not None]
    df = spark.createDataFrame(rows, "x double, y double")
    assert COR.kendall_tau_b(df, "x", "y") == pytest.approx(_brute_tau_b(*map(np.array, zip(*both))), abs=1e-12)
