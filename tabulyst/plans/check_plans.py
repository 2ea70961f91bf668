"""Queries that check model outputs against facts which SQL can compute.

Each runs the operator over its whole table and derives from the model's rows what must hold whatever the
model's random draws: sizes, dates, ranks, sums, and agreement between its result tables. The oracle
computes the same facts from the base tables.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.operators import anomaly as A
from tabulyst.operators import automl as ML
from tabulyst.operators import correlate as COR
from tabulyst.operators import forecast as FC
from tabulyst.operators import segment as SEG
from tabulyst.operators.boosting import JointBoosting
from tabulyst.plans.registry import register
from tabulyst.plans.tables import table, view, with_views

_PART_PAIRS = [("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice")]


# Student's t tail by Simpson's rule over 4000 steps of 0 to |t| (at most 40, where the tail is 0)
@register("correlation_p_values", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS seq, corr({a}, {b}) AS r, count(*) - 2 AS v FROM part"
    for i, (a, b) in enumerate(_PART_PAIRS)) + """),
t AS (SELECT *, least(abs(r) * sqrt(v / (1 - r * r)), 40) AS t FROM c),
f AS (SELECT feature_a, feature_b, i,
        (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * t / 12000
        * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0) - 0.5 * ln(v * pi()) - (v + 1) / 2.0 * ln(1 + (i * t / 4000) * (i * t / 4000) / v)) AS area
      FROM t, range(0, 4001) AS s(i)),
p AS (SELECT feature_a, feature_b, 1 - 2 * sum(area) AS p FROM f GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY round(abs(r), 4) DESC, seq) AS INTEGER) AS rank, feature_a, feature_b,
  round(r, 4) AS correlation, abs(round(p, 4)) AS p_value, p < 0.05 AS significant
FROM c JOIN p USING (feature_a, feature_b)""")
def correlation_p_values(spark, sf_dir):
    top = COR.correlate(table(spark, sf_dir, "part"), threshold=0.0, top_n=10).top_pairs
    return top.select(F.col("rank").cast("int").alias("rank"), "feature_a", "feature_b", "correlation",
                      F.round("p_value", 4).alias("p_value"), "significant")


@register("isolation_forest_check", """
SELECT count(*) AS total_rows, true AS flags_follow_scores, true AS share_is_contamination, true AS flagged_deviate_more
FROM events""")
def isolation_forest_check(spark, sf_dir):
    """Flags are the rows of negative score, about one in twenty, and lie farther from the mean than others."""
    rows = A.anomalies(table(spark, sf_dir, "events"), method="isolation_forest", columns="user_id, value").scored
    far = rows.select("is_anomaly", "anomaly_score", "value")
    mean = far.agg(F.avg("value")).first()[0]
    off = F.abs(F.col("value") - F.lit(mean))
    return far.agg(
        F.count(F.lit(1)).alias("total_rows"), F.every(F.col("is_anomaly") == (F.col("anomaly_score") < 0)).alias("flags_follow_scores"),
        (F.abs(F.avg(F.col("is_anomaly").cast("double")) - 0.05) < 0.005).alias("share_is_contamination"),
        (F.avg(F.when(F.col("is_anomaly"), off)) > F.avg(F.when(~F.col("is_anomaly"), off))).alias("flagged_deviate_more"))


@register("cluster_check", """
SELECT c AS "column", count(*) AS "rows", 4 AS k, true AS percents_add_up, true AS means_from_labels
FROM customer, (VALUES ('c_nationkey'), ('c_acctbal')) AS v(c) GROUP BY c""")
def cluster_check(spark, sf_dir):
    """Profiles agree with means and sizes taken anew from the returned labels."""
    res = SEG.segment(table(spark, sf_dir, "customer"), k=4, columns="c_nationkey, c_acctbal")
    cells = res.labelled.select("cluster_label", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("c_nationkey", "c_acctbal")])))
    anew = cells.groupBy(F.col("cluster_label").alias("cluster"), "column").agg(F.avg("v").alias("again"), F.count(F.lit(1)).alias("n"))
    both = res.profiles.join(anew, ["cluster", "column"])
    return both.groupBy("column").agg(
        F.sum("size").alias("rows"), F.count_distinct("cluster").cast("int").alias("k"), (F.abs(F.sum("percent") - 100) < 0.5).alias("percents_add_up"),
        F.every((F.abs(F.col("mean") - F.col("again")) < 1e-3) & (F.col("n") == F.col("size"))).alias("means_from_labels"))


_REGRESSORS = ["Random Forest", "Gradient Boosting", "Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree"]


@register("automl_check", """
SELECT model, 'r2' AS metric, 'success' AS status, 'regression' AS type, count(*) AS "rows", true AS score_holds
FROM lineitem, (VALUES """ + ", ".join(f"('{m}')" for m in _REGRESSORS) + ") AS v(model) GROUP BY model")
def automl_check(spark, sf_dir):
    """On a target that is linear in its features the linear model's R² is 1, and no model's is above."""
    res = ML.automl(view(spark, sf_dir, "lineitem_target"), "target")
    rows = res.best.select("type", (F.col("training_samples") + F.col("test_samples")).alias("rows"))
    holds = F.when(F.col("model") == "Linear Regression", F.abs(F.col("score") - 1) < 1e-6).otherwise(F.col("score").between(0.0, 1.0 + 1e-9))
    return res.leaderboard.crossJoin(rows).select("model", "metric", "status", "type", "rows", holds.alias("score_holds"))  # one row


@register("joint_boosting_check", """
SELECT label, count(*) AS "rows", true AS classes_known, 1.0 AS importance, true AS above_largest_class FROM embeddings GROUP BY label""")
def joint_boosting_check(spark, sf_dir):
    """Ten rounds over all embeddings and classes: every row gets a class, importances add up to 1, more rows are right than the largest class has."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    data, classes = ML.label_codes(rows, "class", "label")
    model = JointBoosting(classes, rounds=10, step=0.5).fit(data)
    known = F.col("prediction").between(0, classes - 1)
    out = model.transform(data).groupBy(F.col("class").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.every(known).alias("classes_known"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))
    above = out.agg((F.sum("right") > F.max("rows")).alias("above_largest_class"))
    total = round(float(model.featureImportances.toArray().sum()), 6)
    return out.crossJoin(above).select("label", "rows", "classes_known", F.lit(total).alias("importance"), "above_largest_class")  # one row


@register("feature_importance_check", """
SELECT 'p_retailprice' AS target, 'p_partkey, p_size' AS features, true AS ranks_dense, 1.0 AS total, true AS in_order, count(*) AS "rows" FROM part""")
def feature_importance_check(spark, sf_dir):
    """Importances of all numeric features add up to 1 and fall with the rank."""
    part = table(spark, sf_dir, "part")
    imp = ML.feature_importance(part, "p_retailprice").importance
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "importance"))), lambda x: x["importance"])  # one per column
    return imp.agg(
        F.lit("p_retailprice").alias("target"), F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("features"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count_distinct("rank")) & (F.count("rank") == F.max("rank"))).alias("ranks_dense"),
        F.round(F.sum("importance"), 6).alias("total"), (ordered == F.sort_array(ordered, asc=False)).alias("in_order")).withColumn("rows", F.lit(part.count()))


@register("model_facts_check", """
SELECT 'Gradient Boosting' AS model, 'regression' AS task_type, count(*) AS "rows", true AS test_share_holds, 2 AS drivers,
  true AS percents_from_importances FROM part""")
def model_facts_check(spark, sf_dir):
    res = ML.model_facts(table(spark, sf_dir, "part"), "p_retailprice")
    drivers = res.drivers.agg(F.count(F.lit(1)).cast("int").alias("drivers"),
                              F.every(F.abs(F.col("percent") - 100 * F.col("importance")) < 0.06).alias("percents_from_importances"))
    rows = F.col("training_rows") + F.col("test_rows")
    return res.facts.crossJoin(drivers).select(  # one row each
        "model", "task_type", rows.alias("rows"), (F.abs(F.col("test_rows") / rows - 0.2) < 0.1).alias("test_share_holds"), "drivers",
        "percents_from_importances")


def _forecast_sql(source: str, key: str, days: int) -> str:
    return with_views(f"""
WITH d AS (SELECT {key} AS series, ds, y FROM {source} WHERE ds IS NOT NULL AND y IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY series) AS points, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS before FROM d),
l AS (SELECT series, max(ds) FILTER (before < floor(points * 0.8)) AS last, count(*) FILTER (before >= floor(points * 0.8)) AS test_days,
        count(*) AS points, arg_max(y, ds) AS latest FROM s GROUP BY series)
SELECT series, CAST(points AS BIGINT) AS historical_points, round(latest, 4) AS latest_value, CAST(test_days AS BIGINT) AS test_days,
  CAST({days} AS BIGINT) AS future_days, CAST(CAST(last + 1 AS DATE) AS VARCHAR) AS first_day, CAST(CAST(last + {days} AS DATE) AS VARCHAR) AS last_day,
  true AS intervals_hold, true AS change_holds, true AS mape_holds
FROM l""", source)


def _forecast_facts(data: DataFrame, keyed: bool, days: int) -> DataFrame:
    """Days, latest values, ordered intervals, and the summary's change and MAPE taken anew from the predictions."""
    data = data if keyed else data.withColumn("series", F.lit("all"))
    res = FC.forecast(data, "ds", "y", keys=["series"], periods=days)
    future = res.forecast.groupBy("series").agg(
        F.count(F.lit(1)).alias("future_days"), F.min("ds").cast("string").alias("first_day"), F.max("ds").cast("string").alias("last_day"),
        F.every((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("intervals_hold"),
        F.max_by("yhat", "ds").alias("end"))
    off = F.abs((F.col("y") - F.col("yhat")) / F.nullif(F.col("y"), F.lit(0.0)))
    again = res.test.join(data, ["series", "ds"]).groupBy("series").agg(F.count(F.lit(1)).alias("test_days"), F.avg(off).alias("again"))
    change = (F.col("end") - F.col("latest_value")) / F.nullif(F.col("latest_value"), F.lit(0.0)) * 100
    near = lambda a, b: F.abs(a - b) <= 1e-6 * (1 + F.abs(b))
    return res.summary.join(future, "series").join(again, "series").select(
        "series", "historical_points", F.round("latest_value", 4).alias("latest_value"), "test_days", "future_days", "first_day", "last_day",
        "intervals_hold", near(F.col("change_percent"), F.coalesce(change, F.lit(0.0))).alias("change_holds"), near(F.col("mape"), F.col("again")).alias("mape_holds"))


@register("forecast_events_check", _forecast_sql("events_daily", "series", 7))
def forecast_events_check(spark, sf_dir):
    return _forecast_facts(view(spark, sf_dir, "events_daily"), True, 7)


@register("forecast_orders_check", _forecast_sql("orders_daily", "'all'", 30))
def forecast_orders_check(spark, sf_dir):
    return _forecast_facts(view(spark, sf_dir, "orders_daily"), False, 30)
