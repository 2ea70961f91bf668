"""Z-score, IQR and isolation forest anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tabulyst.operators import anomaly as A


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(500), "a": rng.normal(0, 1, 500), "b": rng.normal(10, 2, 500)})
    pdf.loc[7, "a"] = 12.0
    pdf.loc[11, "b"] = -40.0
    return spark.createDataFrame(pdf), pdf


def test_zscore_matches_pandas(points):
    df, pdf = points
    res = A.anomalies(df, method="zscore", columns="a, b, missing_col")
    z = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std()).abs()
    expect = set(pdf.id[(z > 3).any(axis=1)])
    got = {r["id"]: r["anomaly_score"] for r in res.anomalies.collect()}
    assert set(got) == expect and {7, 11} <= expect
    assert got[7] == pytest.approx(round(z.max(axis=1)[7], 4))
    s = res.summary.first()
    assert s["ignored_columns"] == "missing_col" and s["anomalies_found"] == len(expect)


def test_iqr_matches_pandas(points):
    df, pdf = points
    res = A.anomalies(df, method="iqr", columns=["a", "b"])
    q1, q3 = pdf[["a", "b"]].quantile(0.25), pdf[["a", "b"]].quantile(0.75)
    iqr = q3 - q1
    flag = ((pdf[["a", "b"]] < q1 - 1.5 * iqr) | (pdf[["a", "b"]] > q3 + 1.5 * iqr)).any(axis=1)
    assert {r["id"] for r in res.anomalies.collect()} == set(pdf.id[flag])
    stats = {r["column"]: r for r in res.column_stats.collect()}
    assert stats["a"]["outliers_iqr"] == int(((pdf.a < q1.a - 1.5 * iqr.a) | (pdf.a > q3.a + 1.5 * iqr.a)).sum())
    assert res.clean.count() + res.anomalies.count() == 500


def test_constant_column_never_flags(spark):
    df = spark.createDataFrame([(1.0,)] * 30, "c double")
    assert A.anomalies(df, method="zscore").anomalies.count() == 0


def test_isolation_forest_invariants(points):
    df, _ = points
    res = A.anomalies(df, method="isolation_forest", contamination=0.05, columns="a, b")
    rows = {r["id"]: r for r in res.scored.collect()}
    flagged = [i for i, r in rows.items() if r["is_anomaly"]]
    assert abs(len(flagged) - 25) <= 2  # contamination share of 500 rows
    assert rows[7]["is_anomaly"] and rows[11]["is_anomaly"]
    # the planted points are among the lowest scores
    lowest = sorted(rows, key=lambda i: rows[i]["anomaly_score"])[:5]
    assert 7 in lowest and 11 in lowest
    with pytest.raises(ValueError):
        A.anomalies(df, method="nope")


def test_zscore_and_bounds(points):
    df, pdf = points
    z = A.zscore(df, ["a"]).where("id = 7").first()["a_z"]
    assert z == pytest.approx(abs((12.0 - pdf.a.mean()) / pdf.a.std()))
    b = {r["column"]: r for r in A.iqr_bounds(df, ["a"]).collect()}["a"]
    assert b["q1"] == pytest.approx(pdf.a.quantile(0.25)) and b["upper"] == pytest.approx(
        pdf.a.quantile(0.75) + 1.5 * (pdf.a.quantile(0.75) - pdf.a.quantile(0.25)))


def test_text_column_named_for_anomalies_raises(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    with pytest.raises(ValueError):
        A.anomalies(df, method="zscore", columns="x, s")


def test_isolation_forest_does_not_depend_on_partitions(spark):
    """A third of the rows are equal; the flags are the same for 2 and 7 partitions."""
    from tabulyst.operators.iforest import isolation_forest

    rows = spark.range(6000).selectExpr(
        "id", "if(id % 3 = 0, 1D, (id * 7919) % 1000 / 10D) AS a", "if(id % 3 = 0, 2D, (id * 104729) % 977 / 7D) AS b")
    flagged = [{(r["id"], r["is_anomaly"], round(r["anomaly_score"], 9)) for r in isolation_forest(
        rows.repartition(parts, "id"), ["a", "b"], n_trees=20, max_samples=64).select("id", "is_anomaly", "anomaly_score").collect()}
        for parts in (2, 7)]
    assert flagged[0] == flagged[1] and len(flagged[0]) == 6000
    assert 0 < sum(x[1] for x in flagged[0]) <= 300
