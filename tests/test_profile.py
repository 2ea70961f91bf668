"""Profiling and quality report on the shop fixture and edge fixtures."""

from __future__ import annotations

import pytest

from tabulyst.operators import profile as P
from tabulyst.sources import schema as S


def test_shop_profile(shop):
    res = P.profile(shop)
    shape = res.shape.first()
    assert (shape["rows"], shape["columns"], shape["numeric_columns"], shape["categorical_columns"]) == (25, 6, 5, 1)
    q = res.quality.first()
    assert q["missing_values"] == 0 and q["duplicate_rows"] == 0 and q["completeness"] == 100.0
    stats = {r["column"]: r for r in res.statistics.collect()}
    assert set(stats) == {"sales", "marketing_spend", "traffic", "customers", "conversion_rate"}
    assert stats["conversion_rate"]["std"] == pytest.approx(0.0)
    sales = sorted(r["sales"] for r in shop.collect())
    assert stats["sales"]["median"] == sales[12]
    assert res.missing.count() == 0


def test_dirty_quality(dirty):
    q = P.quality_summary(dirty).first()
    # nulls: name 1, grp 1, x 2 (null and NaN), y 1 -> 5 of 60 cells; one exact duplicate row
    assert q["missing_values"] == 5
    assert q["duplicate_rows"] == 1
    assert q["missing_percent"] == pytest.approx(5 / 60 * 100)
    missing = {r["column"]: r["count"] for r in P.missing_by_column(dirty).collect()}
    assert missing == {"name": 1, "grp": 1, "x": 2, "y": 1}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    q = P.quality_summary(empty).first()
    assert q["missing_percent"] == 0.0 and q["completeness"] == 100.0 and q["duplicate_rows"] == 0
    assert P.describe_numeric(empty).count() == 0


def test_one_row_and_all_null(spark):
    one = spark.createDataFrame([(1.5, "x")], "a double, b string")
    r = P.describe_numeric(one).first()
    assert r["std"] is None and r["median"] == 1.5
    alln = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert [r["column"] for r in P.describe_numeric(alln).collect()] == ["id"]


def test_report_tables(dirty):
    rep = P.quality_report(dirty)
    grade = rep.grade.first()
    assert grade["assessment"] == "Good"  # 8.3 % missing
    recs = [r["text"] for r in rep.recommendations.orderBy("seq").collect()]
    assert recs == ["Found 1 duplicate rows. Remove before analysis."]
    cols = {r["name"]: r for r in rep.columns.collect()}
    assert cols["grp"]["unique_values"] == 3 and cols["x"]["null_count"] == 2
    assert cols["name"]["mean"] is None and cols["y"]["max"] == 80


def test_roles_and_size(shop):
    roles = {r["column"]: r["role"] for r in S.column_roles(shop).collect()}
    assert roles["date"] == "text" and roles["sales"] == "numeric"
    assert S.approx_size(shop).first()["bytes"] > 0


def test_report_with_model_section(shop):
    rep = P.quality_report(shop, target="sales", models=["Linear Regression", "Decision Tree"])
    assert {"ml_leaderboard", "ml_best", "ml_importance", "ml_split"} <= set(rep)
    assert rep.ml_best.first()["type"] == "regression"
    assert "ml_leaderboard" not in P.quality_report(shop, target="sales", include_ml=False)


def test_fingerprint_matches_full_rows(spark, dirty):
    gaps = spark.createDataFrame([(None, 1), (1, None), (None, 1), (2, 2)], "a int, b int")
    for df in (dirty, gaps):
        assert P.quality_summary(df, fingerprint=True).first() == P.quality_summary(df, fingerprint=False).first()
    assert P.quality_summary(gaps).first()["duplicate_rows"] == 1
