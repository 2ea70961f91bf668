"""Cleaning steps on the dirty fixture."""

from __future__ import annotations

import pytest

from tabulyst.operators import clean as C


def test_clean_defaults(dirty):
    res = C.clean(dirty)
    rows = res.cleaned.orderBy("id").collect()
    # the exact duplicate (id 6) goes; strip leaves "alice"
    assert len(rows) == 11
    assert rows[0]["name"] == "alice" and rows[1]["name"] == "bob"
    # x median of the 9 non-null x after de-duplication: 1,2,4,6,7,1000,1,3,5 -> 4.0
    assert [r for r in rows if r["id"] == 3][0]["x"] == 4.0
    # text mode: name tie -> "alice" (2 rows) ; grp mode: a (4) vs b (4) -> "a" (smallest on ties)
    assert [r for r in rows if r["id"] == 4][0]["name"] == "alice"
    assert [r for r in rows if r["id"] == 5][0]["grp"] == "a"
    # an int column with gaps becomes double (median fill)
    assert dict(res.cleaned.dtypes)["y"] == "double"
    s = res.summary.first()
    assert (s["rows_before"], s["rows_after"], s["rows_removed"], s["completeness"]) == (12, 11, 1, 100.0)
    steps = [r["step"] for r in res.report.orderBy("seq").collect()]
    assert steps == ["strip_whitespace", "drop_duplicates", "fill_missing"]


def test_fill_options(dirty):
    drop = C.clean(dirty, fill_numeric="drop", fill_categorical="drop").cleaned
    assert drop.where("x IS NULL OR y IS NULL OR name IS NULL OR grp IS NULL").count() == 0
    assert drop.count() == 8
    unk = C.clean(dirty, fill_numeric="zero", fill_categorical="unknown").cleaned
    assert unk.where("id = 4").first()["name"] == "Unknown"
    assert unk.where("id = 3").first()["x"] == 0.0
    with pytest.raises(ValueError):
        C.clean(dirty, fill_numeric="nope")


def test_outliers_sequential_and_single_pass(dirty):
    seq = C.clean(dirty, remove_outliers=True, outlier_threshold=2.0).cleaned
    assert seq.where("x = 1000").count() == 0
    single = C.clean(dirty, remove_outliers=True, outlier_threshold=2.0, outlier_mode="single_pass").cleaned
    assert single.where("x = 1000").count() == 0


def test_constant_column_never_filters(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "c double, x double")
    assert C.zscore_filter(df, ["c", "x"], 3.0).count() == 20


def test_named_fill_functions(dirty):
    x = C.impute_median(dirty, ["x"]).where("id = 3").first()["x"]
    assert x == 4.5  # median of the 10 non-null x before de-duplication
    assert C.impute_zero(dirty, ["y"]).where("id = 4").first()["y"] == 0.0
    assert C.drop_nulls(dirty, ["name", "grp"]).count() == 10
    assert C.fill_categorical(dirty, "unknown", ["grp"]).where("id = 5").first()["grp"] == "Unknown"
