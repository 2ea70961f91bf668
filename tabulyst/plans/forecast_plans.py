"""Forecast queries (I-01..I-06, G-17, D-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyst.operators import forecast as FC
from tabulyst.plans.registry import register, rounded
from tabulyst.plans.tables import table, view, with_views


@register("forecast_prepare", with_views(
    "SELECT series, CAST(ds AS VARCHAR) AS ds, round(y, 4) AS y FROM events_daily WHERE ds IS NOT NULL AND y IS NOT NULL",
    "events_daily"))
def forecast_prepare(spark, sf_dir):
    out = FC.prepare_series(view(spark, sf_dir, "events_daily"), "ds", "y", ["series"])
    return rounded(out.withColumn("ds", F.col("ds").cast("string")))


_SPLIT_SQL = """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS ds, count(*) AS n, sum(value) AS sy
           FROM events WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS points,
             coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS before
      FROM d)
SELECT event_type, CAST(ds AS VARCHAR) AS ds, CAST(n AS BIGINT) AS n, round(sy, 4) AS sy, CAST(points AS BIGINT) AS points,
       CAST(floor(points * 0.8) AS BIGINT) AS train_n, before < floor(points * 0.8) AS is_train
FROM s"""


@register("forecast_split", _SPLIT_SQL)
def forecast_split(spark, sf_dir):
    stats = FC.chrono_split(FC.daily_stats(FC.prepare_series(table(spark, sf_dir, "events"), "ts", "value",
                                                             ["event_type"]), ["event_type"]), ["event_type"])
    return rounded(stats.select("event_type", F.col("ds").cast("string").alias("ds"), "n", "sy", "points", "train_n",
                                "is_train"))


@register("forecast_dates", _SPLIT_SQL.rsplit("SELECT event_type, CAST(ds AS VARCHAR) AS ds, CAST(n", 1)[0] + """,
l AS (SELECT event_type, max(ds) AS last FROM s WHERE before < floor(points * 0.8) GROUP BY event_type)
SELECT event_type, CAST(CAST(last + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS ds FROM l, range(1, 8) AS r(i)""")
def forecast_dates(spark, sf_dir):
    out = FC.future_dates(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], periods=7)
    return out.withColumn("ds", F.col("ds").cast("string"))


def _events(spark, sf_dir):
    return FC.forecast(view(spark, sf_dir, "events_daily"), "ds", "y", keys=["series"], periods=7)


@register("forecast_events")
def forecast_events(spark, sf_dir):
    """Model output per series (rows-only): 5 series x 7 days."""
    return rounded(_events(spark, sf_dir).forecast)


@register("forecast_events_summary")
def forecast_events_summary(spark, sf_dir):
    return rounded(_events(spark, sf_dir).summary)


@register("forecast_orders")
def forecast_orders(spark, sf_dir):
    """One long daily series (orders revenue), 30-day horizon, yearly seasonality."""
    res = FC.forecast(view(spark, sf_dir, "orders_daily"), "ds", "y", periods=30)
    return rounded(res.forecast)


@register("forecast_orders_summary")
def forecast_orders_summary(spark, sf_dir):
    res = FC.forecast(view(spark, sf_dir, "orders_daily"), "ds", "y", periods=30)
    return rounded(res.summary.withColumn("mape", F.col("mape")))


_HOURLY = """
WITH d AS (SELECT series, ds, count(*) AS n, sum(y) AS sy FROM events_hourly WHERE ds IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY series) AS points,
        coalesce(sum(n) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
t AS (SELECT *, least(n, greatest(0, floor(points * 0.8) - before)) AS train FROM s)"""


@register("forecast_hourly_split", with_views(_HOURLY + """
SELECT series, CAST(ds AS VARCHAR) AS ds, CAST(train AS BIGINT) AS train_rows, CAST(n - train AS BIGINT) AS test_rows, round(sy, 4) AS sy,
  CAST(n - train AS BIGINT) AS holdout_rows FROM t""", "events_hourly"))
def forecast_hourly_split(spark, sf_dir):
    """Rows of each hour on either side of the cut, which falls inside an hour's equal instants."""
    series = FC.prepare_series(view(spark, sf_dir, "events_hourly"), "ds", "y", ["series"], keep_time=True)
    stats, holdout = FC.instant_split(series, ["series"])
    sides = stats.groupBy("series", "ds").agg(
        F.sum(F.when(F.col("is_train"), F.col("n")).otherwise(0)).alias("train_rows"), F.sum(F.when(F.col("is_train"), 0).otherwise(F.col("n"))).alias("test_rows"),
        F.round(F.sum("sy"), 4).alias("sy"))
    held = holdout.groupBy("series", "ds").agg(F.sum("n").alias("holdout_rows"))
    return sides.join(held, ["series", "ds"], "left").select(
        "series", F.timestamp_micros("ds").cast("string").alias("ds"), "train_rows", "test_rows", "sy", F.coalesce("holdout_rows", F.lit(0)).alias("holdout_rows"))


@register("forecast_hourly_check", with_views(_HOURLY + """,
l AS (SELECT series, max(ds) FILTER (train > 0) AS last, CAST(max(points) AS BIGINT) AS historical_points, count(*) FILTER (train < n) AS test_hours FROM t GROUP BY series)
SELECT series, historical_points, CAST(test_hours AS BIGINT) AS test_hours, CAST(48 AS BIGINT) AS future_hours,
  CAST(last + INTERVAL 1 HOUR AS VARCHAR) AS first_hour, CAST(last + INTERVAL 48 HOUR AS VARCHAR) AS last_hour, true AS intervals_hold, true AS has_mape
FROM l""", "events_hourly"))
def forecast_hourly_check(spark, sf_dir):
    """48 hours ahead per event type: hours of test and horizon against SQL, ordered intervals."""
    res = FC.forecast(view(spark, sf_dir, "events_hourly"), "ds", "y", keys=["series"], periods=48, step_seconds=3600)
    future = res.forecast.groupBy("series").agg(
        F.count(F.lit(1)).alias("future_hours"), F.min("ds").cast("string").alias("first_hour"), F.max("ds").cast("string").alias("last_hour"),
        F.every((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("intervals_hold"))
    hours = res.test.groupBy("series").agg(F.count_distinct("ds").alias("test_hours"))
    return res.summary.join(future, "series").join(hours, "series").select(
        "series", "historical_points", "test_hours", "future_hours", "first_hour", "last_hour", "intervals_hold", (F.col("mape") >= 0).alias("has_mape"))
