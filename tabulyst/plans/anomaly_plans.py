"""Anomaly queries (G-06..G-08, C-18, H-04) on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyst.operators import anomaly as A
from tabulyst.plans.registry import register, rounded
from tabulyst.plans.tables import table

EVENT_NUM = ["event_id", "user_id", "value"]
EVENT_COLS = "event_id, ts, user_id, event_type, round(value, 4) AS value, props"


def _z_sql(select: str, where: str) -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(EVENT_NUM))
    zs = ", ".join(f"abs(({c} - m{i}) / s{i}) AS z{i}" for i, c in enumerate(EVENT_NUM))
    return (f"WITH st AS (SELECT {stats} FROM events),\n"
            f"z AS (SELECT e.*, {zs} FROM events e, st)\n"
            f"SELECT {select} FROM z {where}")


_ZFLAG = " OR ".join(f"z{i} > 3.0" for i in range(len(EVENT_NUM)))


@register("zscore_anomalies", _z_sql(f"{EVENT_COLS}, round(greatest(z0, z1, z2), 4) AS anomaly_score",
                                     f"WHERE {_ZFLAG}"))
def zscore_anomalies(spark, sf_dir):
    return rounded(A.anomalies(table(spark, sf_dir, "events"), method="zscore").anomalies)


@register("zscore_summary", _z_sql(
    "'zscore' AS method, CAST(count(*) AS BIGINT) AS total_rows, "
    f"CAST(count(*) FILTER (WHERE {_ZFLAG}) AS BIGINT) AS anomalies_found, "
    f"round(count(*) FILTER (WHERE {_ZFLAG}) * 100.0 / count(*), 2) AS anomaly_percent, "
    "'event_id, user_id, value' AS columns_analyzed, '' AS ignored_columns", ""))
def zscore_summary(spark, sf_dir):
    return A.anomalies(table(spark, sf_dir, "events"), method="zscore").summary


def _iqr_sql(select: str, where: str, cols=("user_id", "value")) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{i}, quantile_cont({c}, 0.5) AS md_{i}, "
                   f"quantile_cont({c}, 0.75) AS q3_{i}" for i, c in enumerate(cols))
    flags = " OR ".join(f"{c} < q1_{i} - 1.5 * (q3_{i} - q1_{i}) OR {c} > q3_{i} + 1.5 * (q3_{i} - q1_{i})"
                        for i, c in enumerate(cols))
    devs = ", ".join(f"abs({c} - md_{i}) / ((q3_{i} - q1_{i}) + 1e-9)" for i, c in enumerate(cols))
    return (f"WITH q AS (SELECT {qs} FROM events),\n"
            f"f AS (SELECT e.*, ({flags}) AS flag, greatest({devs}) AS dev FROM events e, q)\n"
            f"SELECT {select} FROM f {where}")


@register("iqr_anomalies", _iqr_sql(f"{EVENT_COLS}, round(dev, 4) AS anomaly_score", "WHERE flag"))
def iqr_anomalies(spark, sf_dir):
    return rounded(A.anomalies(table(spark, sf_dir, "events"), method="iqr", columns="user_id, value").anomalies)


@register("iqr_clean_rows", _iqr_sql(EVENT_COLS, "WHERE NOT flag"))
def iqr_clean_rows(spark, sf_dir):
    return rounded(A.anomalies(table(spark, sf_dir, "events"), method="iqr", columns="user_id, value").clean)


@register("anomaly_column_stats", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}) + 0.0, 4) AS min, round(max({c}) + 0.0, 4) AS max, "
    f"CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers_iqr "
    f"FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events) q"
    for c in EVENT_NUM))
def anomaly_column_stats(spark, sf_dir):
    return A.anomalies(table(spark, sf_dir, "events"), method="zscore").column_stats


@register("isolation_forest_summary")
def isolation_forest_summary(spark, sf_dir):
    """Model output (random trees): rows-only check; flagged share ~ contamination."""
    res = A.anomalies(table(spark, sf_dir, "events"), method="isolation_forest", columns="user_id, value")
    return res.summary


@register("isolation_forest_scores")
def isolation_forest_scores(spark, sf_dir):
    res = A.anomalies(table(spark, sf_dir, "events"), method="isolation_forest", columns="user_id, value")
    return res.scored.select("event_id", "is_anomaly", F.round("anomaly_score", 4).alias("anomaly_score"))
