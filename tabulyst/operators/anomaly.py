"""Anomaly detection: z-score, IQR fences, isolation forest; per-column statistics.

Statistics (mean/sd, exact quartiles and medians) come from one or two
aggregates and enter the row expressions as literals, so scoring is a single
narrow ``select`` over the table: no shuffle, whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.functions.expressions import col_
from tabulyst.functions.quantiles import exact_quantiles
from tabulyst.result import Tables
from tabulyst.sources.schema import normalize_missing, select_columns

METHODS = ("isolation_forest", "zscore", "iqr")
IQR_K = 1.5  # fixed value: Tukey fence multiplier
IQR_EPS = 1e-9  # fixed value: added to the IQR in the deviation score


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds], F.lit(False))


def _quartiles(df: DataFrame, cols: list[str], **qkw) -> dict[str, dict[float, float | None]]:
    res = exact_quantiles(df, cols, [0.25, 0.5, 0.75], **qkw)
    out: dict[str, dict[float, float | None]] = {c: {0.25: None, 0.5: None, 0.75: None} for c in cols}
    for r in res:
        out[r["column"]][r["p"]] = r["value"]
    return out


def _z_exprs(df: DataFrame, cols: list[str]) -> list[Column]:
    row = df.agg(*[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(col_(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    zs = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        # sd 0 or undefined: the column never flags (0/0 is NaN in the reference)
        zs.append(F.abs((col_(c) - F.lit(m)) / F.lit(s)) if s else F.lit(None).cast("double"))
    return zs


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<col>_z`` = |x - mean| / sd (sample sd; null where sd is 0 or undefined)."""
    return df.select("*", *[z.alias(f"{c}_z") for c, z in zip(cols, _z_exprs(df, cols))])


def iqr_bounds(df: DataFrame, cols: list[str], k: float = IQR_K, **qkw) -> DataFrame:
    """``(column, q1, median, q3, iqr, lower, upper)`` with exact quartiles and ``k * IQR`` fences."""
    quart = _quartiles(df, cols, **qkw)
    rows = []
    for c in cols:
        q1, med, q3 = quart[c][0.25], quart[c][0.5], quart[c][0.75]
        iqr = None if q1 is None else q3 - q1
        rows.append((c, q1, med, q3, iqr, None if q1 is None else q1 - k * iqr, None if q1 is None else q3 + k * iqr))
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double, lower double, upper double")


def zscore_scores(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Adds ``is_anomaly`` (any |z| > threshold) and ``anomaly_score`` (max |z|, 4 dp)."""
    zs = _z_exprs(df, cols)
    return df.select("*", _any([z > threshold for z in zs]).alias("is_anomaly"),
                     F.round(F.greatest(*zs, F.lit(None).cast("double"), F.lit(None).cast("double")), 4).alias("anomaly_score"))


def iqr_scores(df: DataFrame, cols: list[str], quart: dict | None = None, **qkw) -> DataFrame:
    """Adds ``is_anomaly`` (outside Q1-1.5 IQR, Q3+1.5 IQR in any column) and
    ``anomaly_score`` (max |x - median| / (IQR + 1e-9), 4 dp)."""
    quart = quart or _quartiles(df, cols, **qkw)
    flags, devs = [], []
    for c in cols:
        q1, med, q3 = quart[c][0.25], quart[c][0.5], quart[c][0.75]
        if q1 is None:
            continue
        iqr = q3 - q1
        flags += [col_(c) < q1 - IQR_K * iqr, col_(c) > q3 + IQR_K * iqr]
        devs.append(F.abs(col_(c) - F.lit(med)) / F.lit(iqr + IQR_EPS))
    return df.select("*", _any(flags).alias("is_anomaly"),
                     F.round(F.greatest(*devs, F.lit(None).cast("double"), F.lit(None).cast("double")), 4).alias("anomaly_score"))


def column_stats(df: DataFrame, cols: list[str], quart: dict | None = None, **qkw) -> DataFrame:
    """``(column, mean, std, min, max, outliers_iqr)`` — moments to 4 dp, one aggregate."""
    quart = quart or _quartiles(df, cols, **qkw)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = quart[c][0.25], quart[c][0.75]
        x = col_(c).cast("double")
        if q1 is None:
            out_cnt = F.lit(0).cast("bigint")
        else:
            iqr = q3 - q1
            out_cnt = F.count_if((x < q1 - IQR_K * iqr) | (x > q3 + IQR_K * iqr))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}"), out_cnt.cast("bigint").alias(f"o{i}")]
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(f"m{i}"), 4).alias("mean"),
                             F.round(F.col(f"s{i}"), 4).alias("std"), F.round(F.col(f"lo{i}"), 4).alias("min"),
                             F.round(F.col(f"hi{i}"), 4).alias("max"), F.col(f"o{i}").alias("outliers_iqr"))
                    for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.inline(arr))


def anomalies(df: DataFrame, method: str = "isolation_forest", contamination: float = 0.05,
              zscore_threshold: float = 3.0, columns: str | list[str] = "", seed: int = 42, **kw) -> Tables:
    """Detect anomalous rows.

    Tables: ``scored`` (all rows + is_anomaly, anomaly_score), ``anomalies`` (flagged
    rows with their score), ``clean`` (rows not flagged), ``summary`` and
    ``column_stats``. For the isolation forest, lower scores are more anomalous
    and a row is flagged when its score is below 0.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}")
    df = normalize_missing(df)
    cols, ignored = select_columns(df, columns)
    if not cols:
        raise ValueError("No numeric columns found or specified.")
    quart = _quartiles(df, cols, **{k: v for k, v in kw.items() if k in ("max_exact_rows", "bins")})
    if method == "zscore":
        scored = zscore_scores(df, cols, zscore_threshold)
    elif method == "iqr":
        scored = iqr_scores(df, cols, quart)
    else:
        from tabulyst.operators.iforest import isolation_forest
        scored = isolation_forest(df, cols, contamination=contamination, seed=seed, medians={c: quart[c][0.5] for c in cols},
                                  **{k: v for k, v in kw.items() if k not in ("max_exact_rows", "bins")})
    summary = scored.agg(F.count(F.lit(1)).alias("total_rows"),
                         F.count_if(F.col("is_anomaly")).cast("bigint").alias("anomalies_found")).select(
        F.lit(method).alias("method"), "total_rows", "anomalies_found",
        F.when(F.col("total_rows") > 0, F.round(F.col("anomalies_found") / F.col("total_rows") * 100.0, 2))
        .alias("anomaly_percent"),
        F.lit(", ".join(cols)).alias("columns_analyzed"), F.lit(", ".join(ignored)).alias("ignored_columns"))
    return Tables(
        scored=scored,
        anomalies=scored.where(F.col("is_anomaly")).drop("is_anomaly"),
        clean=scored.where(~F.col("is_anomaly")).drop("is_anomaly", "anomaly_score"),
        summary=summary,
        column_stats=column_stats(df, cols, quart),
    )
