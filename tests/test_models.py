"""Segmentation, AutoML, feature importance and model facts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabulyst.operators import automl as ML
from tabulyst.operators import segment as SEG


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(2)
    centers = [(0, 0), (10, 10), (-10, 10)]
    pts = np.vstack([rng.normal(c, 0.5, size=(60, 2)) for c in centers])
    df = spark.createDataFrame(pd.DataFrame({"u": pts[:, 0], "v": pts[:, 1], "tag": np.repeat([0, 1, 2], 60)}))
    res = SEG.segment(df, k=3, columns="u, v, tag_missing", n_init=3)
    lab = res.labelled.toPandas()
    # every blob maps to exactly one cluster
    assert lab.groupby("tag")["cluster_label"].nunique().max() == 1
    assert sorted(r["size"] for r in res.sizes.collect()) == [60, 60, 60]
    prof = res.profiles.toPandas()
    assert len(prof) == 6 and set(prof.percent) == {33.3}
    s = res.summary.first()
    assert s["ignored_columns"] == "tag_missing" and s["inertia"] > 0
    assert res.distinguishing.count() == 2
    with pytest.raises(ValueError):
        SEG.segment(df.limit(2), k=3)


def test_automl_regression_linear_target(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "noise": rng.normal(size=400), "y": 3 * x1 - 2 * x2 + 5})
    res = ML.automl(spark.createDataFrame(pdf), "y",
                    models=["Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree"])
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert board["Linear Regression"]["score"] == pytest.approx(1.0, abs=1e-9)
    assert board["Ridge Regression"]["score"] > 0.999
    best = res.best.first()
    assert best["type"] == "regression" and best["training_samples"] + best["test_samples"] == 400
    assert res.importance.count() == 0  # the winner is linear


def test_automl_classification_with_text_feature(spark):
    rng = np.random.default_rng(6)
    n = 300
    grp = rng.choice(["alpha", "beta", "gamma"], n)
    x = rng.normal(size=n)
    label = np.where((grp == "gamma") | (x > 1.0), "yes", "no")
    pdf = pd.DataFrame({"grp": grp, "x": x, "label": label})
    res = ML.automl(spark.createDataFrame(pdf), "label", features=["grp", "x"],
                    models=["Random Forest", "Logistic Regression", "Decision Tree"])
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert all(r["status"] == "success" for r in board.values())
    assert board["Decision Tree"]["score"] > 0.9
    feats = [r["feature"] for r in res.importance.orderBy("rank").collect()]
    assert set(feats) == {"x", "grp_beta", "grp_gamma"}  # first category (alpha) dropped


def test_multiclass_boosting(spark):
    rng = np.random.default_rng(8)
    f1, f2 = rng.normal(size=240), rng.normal(size=240)
    y = (f1 > 0).astype(int) * 2 + (f2 > 0).astype(int)  # 4 classes
    df = spark.createDataFrame(pd.DataFrame({"f1": f1, "f2": f2, "y": y}))
    res = ML.model_facts(df, "y")
    facts = res.facts.first()
    assert facts["task_type"] == "classification" and facts["score"] > 0.85
    assert {r["feature"] for r in res.drivers.collect()} == {"f1", "f2"}


def test_feature_importance_ranks_informative_first(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"signal": rng.normal(size=300), "junk": rng.normal(size=300)})
    pdf["y"] = 4 * pdf.signal + rng.normal(0, 0.1, 300)
    res = ML.feature_importance(spark.createDataFrame(pdf), "y")
    assert res.importance.orderBy("rank").first()["feature"] == "signal"
    s = res.summary.first()
    assert s["top_driver"] == "signal" and s["cumulative_importance"] == pytest.approx(1.0)


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    out, cols = ML.one_hot(df, ["s"])
    assert cols == ["s_b", "s_c"]
    rows = out.collect()
    assert [(r["s_b"], r["s_c"]) for r in rows] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    enc, classes = ML.label_encode(spark.createDataFrame([(10.0,), (2.0,), (2.0,)], "t double"), "t")
    assert classes == [2.0, 10.0] and [r["label"] for r in enc.collect()] == [1.0, 0.0, 0.0]


def test_group_profile_keeps_null_label(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 10.0), ("a", 20.0), ("a", 30.0)], "g string, x double")
    rows = {r["cluster"]: r for r in SEG.group_profile(df, "g", ["x"]).collect()}
    assert rows[None]["size"] == 2 and rows[None]["median"] == 2.0 and rows[None]["percent"] == 40.0
    assert rows["a"]["median"] == 20.0


def test_split_gives_repeated_rows_their_exact_share(spark, monkeypatch):
    monkeypatch.setattr(ML, "LOT", 64)
    rows = [("a", 1.0)] * 1000 + [("b", None)] * 1000 + [(f"x{i}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "`k.1` string, v double").repartition(7)
    train, test = ML.train_test_split(df, 0.2)
    counts = {(r[0], s): r["count"] for s, d in (("train", train), ("test", test)) for r in d.groupBy("`k.1`").count().collect()}
    assert [counts[("a", "train")], counts[("a", "test")], counts[("b", "train")], counts[("b", "test")]] == [800, 200, 800, 200]
    assert train.columns == df.columns and train.count() + test.count() == len(rows)
    singles = test.where("`k.1` like 'x%'").count()
    assert 320 < singles < 480
    again = ML.train_test_split(df.repartition(3), 0.2)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, test.collect()))


def test_codes_and_vectors_of_many_values(spark):
    rng = np.random.default_rng(3)
    vals = [None if i % 50 == 0 else f"v{rng.integers(0, 1500):04d}" for i in range(4000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, `t.x` string").repartition(5)
    kinds = sorted({v for v in vals if v})
    coded, n = ML.label_codes(df, "t.x")
    assert n == len(kinds) > 1000
    assert {r["id"]: r["label"] for r in coded.collect()} == {i: (None if v is None else float(kinds.index(v))) for i, v in enumerate(vals)}
    out, places = ML.one_hot_vectors(df, ["t.x"])
    assert out.columns == df.columns
    assert [(r["place"], r["category"]) for r in places.orderBy("place").collect()] == list(enumerate(kinds[1:]))
    for r in out.collect():
        v = r["t.x"]
        want = [] if vals[r["id"]] in (None, kinds[0]) else [kinds.index(vals[r["id"]]) - 1]
        assert v.size == len(kinds) - 1 and list(v.indices) == want


def test_one_category_or_none_leaves_empty_vectors(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id long, s string, t string")
    out, places = ML.one_hot_vectors(df, ["s", "t"])
    assert [(r["s"].size, r["t"].size) for r in out.collect()] == [(0, 0)] * 2 and places.count() == 0


def test_models_with_many_categories_and_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(0, 700):03d}", float(rng.normal()), i % 20) for i in range(3000)]
    df = spark.createDataFrame([(c, x, f"k{k:02d}") for c, x, k in rows], "cat string, x double, y string")
    res = ML.automl(df, "y", features=["cat", "x"], models=["Logistic Regression", "Decision Tree"])
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert {r["status"] for r in board.values()} == {"success"} and res.best.first()["type"] == "classification"
    assert res.best.first()["training_samples"] + res.best.first()["test_samples"] == 3000


def test_trees_grow_with_distinct_ranges_not_rows(spark, monkeypatch):
    monkeypatch.setattr(ML, "CELLS_FROM", 1000)
    monkeypatch.setattr(ML, "FOREST_LOTS", 500)
    rng = np.random.default_rng(12)
    a, b = rng.integers(0, 8, 3000), rng.integers(0, 5, 3000)
    pdf = pd.DataFrame({"a": a.astype(float), "b": b.astype(float), "one": 1.0, "y": 2.0 * a - b + rng.normal(0, 2, 3000)})
    data = ML._prepare(spark.createDataFrame(pdf), "y", None)[0]
    train, test = ML._split(data, 3000, 0.2, 42)
    assert train.columns == data.columns and train.count() + test.count() == 3000
    n = train.count()
    cells, by_range = ML._cells(train, test, n, False)
    whole = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    own = cells.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    assert cells.count() == train.select("f0", "f1").distinct().count() == 40 and own[0] == n and own[1] == pytest.approx(whole[1])
    lots = ML._lots(cells, n)
    assert lots.agg(F.max("weight"), F.sum("weight")).first()[0] <= n // 500 and lots.agg(F.sum("weight")).first()[0] == pytest.approx(n)
    gbt = GBTRegressor(maxIter=5, maxDepth=3, seed=1)
    ev = RegressionEvaluator(metricName="r2")
    plain, weighted = gbt.fit(train), gbt.copy({gbt.weightCol: "weight"}).fit(cells)
    assert weighted.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)
    assert ev.evaluate(weighted.transform(by_range)) == pytest.approx(ev.evaluate(plain.transform(test)), abs=1e-6)
    # values that hardly repeat stay rows
    pdf["a"], pdf["b"] = rng.normal(size=3000), rng.normal(size=3000)
    assert ML._cells(*ML._split(ML._prepare(spark.createDataFrame(pdf.assign(c=rng.normal(size=3000))), "y", None)[0], 3000, 0.2, 42), 2400, False) is None


def test_forest_on_distinct_ranges(spark, monkeypatch):
    monkeypatch.setattr(ML, "CELLS_FROM", 1000)
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 2000).astype(float), "b": rng.integers(0, 60, 2000) / 60})
    for target, least in ((3 * pdf.a - 5 * pdf.b, 0.95), ((pdf.a > 4).astype(int), 0.99)):
        res = ML.automl(spark.createDataFrame(pdf.assign(y=target)), "y", models=["Random Forest", "Decision Tree"], forest_depth=8)
        board = {r["model"]: r for r in res.leaderboard.collect()}
        assert {r["status"] for r in board.values()} == {"success"} and board["Random Forest"]["score"] > least
        assert res.best.first()["training_samples"] + res.best.first()["test_samples"] == 2000
