"""Column names and categories that hold dots."""

from tabulyst.operators import anomaly as A
from tabulyst.operators import automl as ML
from tabulyst.operators import clean as CL
from tabulyst.operators import profile as P


def _dotted(spark):
    rows = [(float(i), None if i % 10 == 3 else float(i % 7), f"v1.{i % 3}" if i % 11 else None, 2.0 * i + 1.0) for i in range(60)]
    return spark.createDataFrame(rows + rows[:1], "`unit.price` double, `a.b.c` double, `kind.of` string, `y.out` double")


def test_profile_and_clean(spark):
    df = _dotted(spark)
    res = P.profile(df)
    assert {r["column"]: r["count"] for r in res.statistics.collect()} == {"unit.price": 61, "a.b.c": 55, "y.out": 61}
    out = CL.clean(df, remove_outliers=True)
    assert out.cleaned.columns == df.columns and out.cleaned.count() == 60
    assert out.summary.first()["completeness"] == 100.0
    for numeric, text in (("mean", "unknown"), ("zero", "mode"), ("drop", "drop")):
        kept = CL.clean(df, fill_numeric=numeric, fill_categorical=text).cleaned
        assert kept.count() == (60 if numeric != "drop" else sum(i % 10 != 3 and i % 11 != 0 for i in range(60)))


def test_anomalies(spark):
    for method in ("zscore", "iqr", "isolation_forest"):
        res = A.anomalies(_dotted(spark), method=method)
        assert res.summary.first()["total_rows"] == 61


def test_models(spark):
    res = ML.automl(_dotted(spark), "y.out", features=["unit.price", "kind.of"], models=["Linear Regression", "Decision Tree"])
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert board["Linear Regression"]["score"] > 0.999 and board["Decision Tree"]["status"] == "success"
    assert {r["feature"] for r in ML.feature_importance(_dotted(spark), "y.out").importance.collect()} == {"unit.price", "a.b.c"}


def test_comparison_correlation_segments_and_forecasts(spark):
    from pyspark.sql import functions as F

    from tabulyst.operators import compare as CMP
    from tabulyst.operators import correlate as COR
    from tabulyst.operators import forecast as FC
    from tabulyst.operators import segment as SEG

    a = _dotted(spark)
    res = CMP.compare(a, a.where("`unit.price` > 3"), key="unit.price")
    assert {r["column"] for r in res.statistics.collect()} == {"unit.price", "a.b.c", "y.out"}
    assert res.key_summary.first()["rows_only_in_2"] == 0
    for method in ("pearson", "spearman", "kendall"):
        pairs = {(r["feature_a"], r["feature_b"]) for r in COR.correlate(a, target="y.out", method=method).pairs.collect()}
        assert ("unit.price", "y.out") in pairs or ("y.out", "unit.price") in pairs
    seg = SEG.segment(a, k=2, columns="unit.price, a.b.c", n_init=2)
    assert seg.labelled.columns == [*a.columns, "cluster_label"] and seg.profiles.count() == 4
    days = spark.range(60).select(F.expr("date_add(date '2024-01-01', cast(id as int))").alias("on.day"), (F.col("id") * 2.0).alias("v.al"), F.lit("s.1").alias("k.ey"))
    out = FC.forecast(days, "on.day", "v.al", keys=["k.ey"], periods=5)
    assert out.forecast.count() == 5 and out.summary.first()["k.ey"] == "s.1"
