"""Forecasting many series by key, by days or by instants: additive trend + seasonality model.

Spark plan:

1. ``prepare_series`` – project (keys, ds, y), drop gaps (I-01);
2. one ``groupBy(keys, ds)`` aggregate to sufficient statistics ``(n, sum y,
   sum y^2)`` per day – a least-squares fit only needs these, so duplicate days and
   hot keys shrink to one row per calendar day before the shuffle;
3. chronological split (I-02): the first ``int(0.8 n)`` rows by date train (split at
   day granularity; the boundary day goes to training). Series with a time of day keep their instants and are cut at the
   row (:func:`instant_split`);
4. ``groupBy(keys).applyInPandas(fit)`` (I-04): one group per series, sized by its
   number of distinct days; numpy solves the weighted ridge normal equations;
5. holdout MAPE (I-05) and the summary (I-06) are Spark aggregates over the rows
   joined with the per-day predictions.

Model (Prophet's published defaults, fitted by penalised least squares): a
piecewise-linear trend with up to 25 changepoints over the first 80 % of the
training span (Gaussian prior, scale 0.05), yearly Fourier order 10 and weekly
order 3 (prior scale 10), on y scaled by max |y|. Interval: ``yhat ± z * sd``
with ``sd^2 = sigma^2 + 2 r b^2 h^3 / 3`` – residual variance plus the variance of
future trend changes arriving at the historical changepoint rate ``r`` with mean
magnitude ``b``, ``h`` the horizon in trend-time units. Numbers differ from
Prophet's sampler; the contract is the table schema, horizon dates, lower <=
yhat <= upper, and recovery of trend and weekly pattern.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.expressions import col_
from tabulyst.result import Tables
from tabulyst.session import ship_package
from tabulyst.sources.schema import require_columns

# Model defaults (Prophet's published defaults).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
TREND_PRIOR = 5.0
YEARLY = (365.25, 10)
WEEKLY = (7.0, 3)
TRAIN_SHARE = 0.8
MIN_POINTS = 20
DAY_MICROS = 86_400_000_000
LOT_BITS = 12  # the rows of one instant are told apart in 2**LOT_BITS lots


def prepare_series(df: DataFrame, date: str, value: str, keys: list[str] | None = None, keep_time: bool = False) -> DataFrame:
    """``(keys..., ds, y)`` with ds a date, y a double, rows with gaps dropped; ``keep_time`` adds the full timestamp ``ts``."""
    keys = list(keys or [])
    require_columns(df, date, value, *keys)
    dt = df.schema[date].dataType
    ts = col_(date).cast("timestamp") if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) \
        else F.try_to_timestamp(col_(date).cast("string"))
    y = col_(value).cast("double")
    return (df.select(*[col_(k) for k in keys], F.to_date(ts).alias("ds"), F.when(F.isnan(y), None).otherwise(y).alias("y"),
                      *([ts.alias("ts")] if keep_time else []))
            .dropna(subset=["ds", "y"]))


def daily_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., ds, n, sy, syy)`` – sufficient statistics per series and day."""
    return series.groupBy(*[col_(k) for k in keys], "ds").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"),
                                           F.sum(F.col("y") * F.col("y")).alias("syy"))


def chrono_split(stats: DataFrame, keys: list[str], share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``points`` (rows of the series), ``train_n`` and ``is_train`` (day granularity).

    Windows are partitioned by series key and ordered by day: one group per
    series holding one row per day.
    """
    part = [col_(k) for k in keys] if keys else [F.lit(0)]
    w_all = Window.partitionBy(*part)
    w_run = Window.partitionBy(*part).orderBy("ds").rowsBetween(Window.unboundedPreceding, -1)
    return (stats.withColumn("points", F.sum("n").over(w_all))
            .withColumn("train_n", F.floor(F.col("points") * share).cast("bigint"))
            .withColumn("before", F.coalesce(F.sum("n").over(w_run), F.lit(0)))
            .withColumn("is_train", F.col("before") < F.col("train_n")).drop("before"))


def _with(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``names``, null keys equal."""
    own = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    on: Column = reduce(lambda a, b: a & b, [left[n].eqNullSafe(own[f"__r_{n}"]) for n in names])
    return left.join(own, on, how).drop(*[f"__r_{n}" for n in names])


def finest_grain(series: DataFrame) -> str:
    """``instant`` if any ``ts`` has a time of day, else ``day``; one aggregate."""
    return "instant" if series.agg(F.bool_or(F.col("ts") != F.date_trunc("day", "ts"))).first()[0] else "day"


def instant_split(series: DataFrame, keys: list[str], share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Row-exact chronological split of ``(keys..., ts, y)``: the first ``int(share * n)`` rows of a series train.

    Returns ``(stats, holdout)``: ``keys..., ds, n, sy, syy, points, train_n, is_train`` with ds in microseconds, and the
    test rows as ``keys..., ds, y, n``. Rows of one instant have no order in time; where the cut falls among them they are taken
    by a hash of their value, and the instant has a row in ``stats`` for either side.

    Scaling: equal rows are counted before any shuffle; an instant's rows meet in lots by that hash, so only one lot of
    the cut instant is sorted; the running count of a series is taken over days first, then inside each day.
    """
    part = [col_(k) for k in keys]
    cells = series.groupBy(*part, F.unix_micros("ts").alias("ds"), "y").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("lot", F.shiftrightunsigned(F.xxhash64("y"), 64 - LOT_BITS))
    sums = lambda n, y: [F.sum(n).alias("n"), F.sum(n * y).alias("sy"), F.sum(n * y * y).alias("syy")]
    lots = cells.groupBy(*part, "ds", "lot").agg(*sums(F.col("n"), F.col("y")))
    stats = lots.groupBy(*part, "ds").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy")]).withColumn("day", F.floor(F.col("ds") / DAY_MICROS))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = stats.groupBy(*part, "day").agg(F.sum("n").alias("n"))
    days = days.select(*part, "day", ahead(Window.partitionBy(*part).orderBy("day")).alias("day_before"), F.sum("n").over(Window.partitionBy(*part)).alias("points"))
    stats = _with(stats, days, [*keys, "day"])
    stats = stats.withColumn("before", F.col("day_before") + ahead(Window.partitionBy(*part, "day").orderBy("ds")))
    stats = stats.withColumn("train_n", F.floor(F.col("points") * share).cast("bigint")).drop("day", "day_before")
    stats = stats.withColumn("room", F.col("train_n") - F.col("before")).drop("before")
    inside = (F.col("room") > 0) & (F.col("room") < F.col("n"))

    cut = stats.where(inside).select(*part, "ds", "room", "points", "train_n")
    lots = _with(lots.select(*part, "ds", "lot", "n"), cut, [*keys, "ds"])
    lots = lots.withColumn("room", F.col("room") - ahead(Window.partitionBy(*part, "ds").orderBy("lot"))).drop("n")
    rows = _with(cells, lots, [*keys, "ds", "lot"])
    free = F.col("room") - ahead(Window.partitionBy(*part, "ds", "lot").orderBy("y"))
    rows = rows.withColumn("train", F.greatest(F.lit(0), F.least(F.col("n"), free)))
    rows = rows.select(*part, "ds", "y", "points", "train_n", F.inline(F.array(
        F.struct(F.lit(True).alias("is_train"), F.col("train").alias("n")), F.struct(F.lit(False).alias("is_train"), (F.col("n") - F.col("train")).alias("n"))))).where("n > 0")
    halves = rows.groupBy(*part, "ds", "points", "train_n", "is_train").agg(*sums(F.col("n"), F.col("y")))
    out = [*part, "ds", "n", "sy", "syy", "points", "train_n", "is_train"]
    whole = stats.where(~inside).withColumn("is_train", F.col("room") > 0)
    tested = _with(cells.drop("lot"), whole.where(~F.col("is_train")).select(*part, "ds"), [*keys, "ds"])
    holdout = tested.unionByName(rows.where(~F.col("is_train")).select(*part, "ds", "y", "n"))
    return whole.select(*out).unionByName(halves.select(*out)), holdout


def _design(days: np.ndarray, t0: float, span: float, cps: np.ndarray) -> np.ndarray:
    t = (days - t0) / span
    cols = [np.ones_like(t), t] + [np.maximum(t - s, 0.0) for s in cps]
    for period, order in (YEARLY, WEEKLY):
        for k in range(1, order + 1):
            ang = 2.0 * np.pi * k * days / period
            cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def fit_predict_series(pdf: pd.DataFrame, periods: int, interval: float, refit: bool, step: int = DAY_MICROS) -> pd.DataFrame:
    """Fit one series from its statistics by day (ds a date) or by instant (ds in microseconds); predict the test days or instants
    and the horizon, ``periods`` days or ``step``s after the last one of the training rows."""
    pdf = pdf.sort_values("ds")
    by_instant = pd.api.types.is_integer_dtype(pdf["ds"])
    at = pdf["ds"].to_numpy(dtype=np.int64) if by_instant else pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(np.int64)
    unit = DAY_MICROS if by_instant else 1
    days = at / unit
    n, sy, syy = (pdf[c].to_numpy(dtype=float) for c in ("n", "sy", "syy"))
    train = np.ones(len(pdf), dtype=bool) if refit else pdf["is_train"].to_numpy(dtype=bool)
    dtr = days[train]
    t0, span = dtr.min(), max(dtr.max() - dtr.min(), 1.0)
    scale = float(np.max(np.abs(sy[train] / n[train]))) or 1.0
    # changepoints: evenly spaced days in the first 80 % of the training days
    cand = dtr[: max(1, int(np.ceil(CHANGEPOINT_RANGE * len(dtr))))]
    n_cp = min(N_CHANGEPOINTS, max(len(cand) - 1, 0))
    cps = (np.unique(cand[np.linspace(0, len(cand) - 1, n_cp + 1).round().astype(int)[1:]]) - t0) / span \
        if n_cp > 0 else np.array([])
    X = _design(dtr, t0, span, cps)
    w, b = n[train], sy[train] / scale
    q = syy[train] / scale ** 2
    # a yearly cycle is not identifiable from less than a year of data: its prior is
    # off below one year of training span and ramps to full strength at two years
    yearly_prior = SEASONALITY_PRIOR * min(1.0, max(0.0, span / YEARLY[0] - 1.0)) ** 2
    prior = np.concatenate([[TREND_PRIOR, TREND_PRIOR], np.full(len(cps), CHANGEPOINT_PRIOR),
                            np.full(2 * YEARLY[1], max(yearly_prior, 1e-6)), np.full(2 * WEEKLY[1], SEASONALITY_PRIOR)])
    xtwx, xtb = X.T @ (X * w[:, None]), X.T @ b
    # noise variance from residuals over the ridge's effective degrees of freedom
    # (trace of the hat matrix); iterated because the penalty scales with it
    sigma2 = max(float(np.sum(q) / w.sum() - (b.sum() / w.sum()) ** 2), 1e-6)
    for _ in range(20):
        a = xtwx + np.diag(sigma2 / prior ** 2)
        beta = np.linalg.solve(a, xtb)
        fit = X @ beta
        rss = max(float(np.sum(q - 2 * fit * b + w * fit * fit)), 0.0)
        dof = float(np.trace(np.linalg.solve(a, xtwx)))
        new = max(rss / max(w.sum() - dof, 1.0), 1e-12)
        if abs(new - sigma2) <= 1e-6 * sigma2:
            sigma2 = new
            break
        sigma2 = new
    deltas = beta[2:2 + len(cps)]
    mean_abs = float(np.mean(np.abs(deltas))) + 1e-8 if len(cps) else 0.0
    rate = len(cps)  # changepoints per unit of trend time in history
    z = NormalDist().inv_cdf(0.5 + interval / 2.0)

    future = at[train].max() + np.arange(1, periods + 1) * (step if by_instant else 1)
    out_at = np.concatenate([at[~train], future])
    out_days = out_at / unit
    part = np.array(["test"] * int((~train).sum()) + ["future"] * len(future))
    Xo = _design(out_days, t0, span, cps)
    yhat = Xo @ beta
    h = np.maximum((out_days - t0) / span - 1.0, 0.0)
    sd = np.sqrt(sigma2 + 2.0 * rate * mean_abs ** 2 * h ** 3 / 3.0)
    res = pd.DataFrame({
        "ds": out_at if by_instant else pd.Series(out_at.astype("datetime64[D]")).dt.date,
        "part": part, "yhat": yhat * scale, "yhat_lower": (yhat - z * sd) * scale,
        "yhat_upper": (yhat + z * sd) * scale,
    })
    return res


def fit_predict(stats: DataFrame, keys: list[str], periods: int = 30, interval: float = 0.95,
                refit: bool = False, step: int = DAY_MICROS) -> DataFrame:
    """``(keys..., ds, part, yhat, yhat_lower, yhat_upper, error)`` from the output of ``chrono_split`` or ``instant_split``;
    ``part`` is ``test`` (holdout days), ``future`` (the horizon) or ``failed`` (one row with the error of a series that has no fit). One
    ``applyInPandas`` group per series, one row per day (bounded by the calendar span) or per distinct instant."""
    ship_package(stats.sparkSession)
    schema = T.StructType([stats.schema[k] for k in keys] + [
        stats.schema["ds"], T.StructField("part", T.StringType()),
        T.StructField("yhat", T.DoubleType()), T.StructField("yhat_lower", T.DoubleType()),
        T.StructField("yhat_upper", T.DoubleType()), T.StructField("error", T.StringType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            if not np.isfinite(pdf[["sy", "syy"]].to_numpy(dtype=float)).all():
                raise ValueError("the series holds values that are not finite")
            res = fit_predict_series(pdf, periods, interval, refit, step).assign(error=None)
        except Exception as exc:  # noqa: BLE001 - a series that fails is a row, not the end of the job
            res = pd.DataFrame([{"ds": None, "part": "failed", "yhat": None, "yhat_lower": None, "yhat_upper": None, "error": f"{type(exc).__name__}: {exc}"}])
        for i, k in enumerate(keys):
            res.insert(i, k, key[i])
        if pd.api.types.is_integer_dtype(pdf["ds"]):
            res["ds"] = res["ds"].astype("Int64")
        return res[[f.name for f in schema.fields]]

    return stats.groupBy(*[col_(k) for k in keys]).applyInPandas(fit, schema)


def _off() -> Column:
    """|(y - yhat) / y|; 0 where both are 0, infinite for a missed zero."""
    return F.when(F.col("y") != 0, F.abs((F.col("y") - F.col("yhat")) / F.col("y"))).when(F.col("yhat") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def holdout_mape(series: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., mape)``: mean |(y - yhat) / y| over holdout rows (a fraction, not percent);
    a missed zero makes it infinite. Rows with a count ``n`` stand for as many."""
    both = series.join(test.select(*[col_(k) for k in keys], "ds", "yhat"), [*keys, "ds"])
    mean = F.sum(_off() * F.col("n")) / F.sum("n") if "n" in series.columns else F.avg(_off())
    return both.groupBy(*[col_(k) for k in keys]).agg(mean.alias("mape"))


def forecast_summary(series: DataFrame, fc: DataFrame, mape: DataFrame, keys: list[str], periods: int,
                     interval: float) -> DataFrame:
    """``(keys..., historical_points, latest_value, projected_value, change_percent, mape, ...)``;
    the change is 0 when the latest value is 0."""
    wk = Window.partitionBy(*[col_(k) for k in keys]).orderBy(F.desc("ds"))  # one group per series, `periods` rows each
    proj = fc.withColumn("__r", F.row_number().over(wk)).where(F.col("__r") == 1).select(
        *[col_(k) for k in keys], F.col("yhat").alias("projected_value"))
    latest = series.groupBy(*[col_(k) for k in keys]).agg(F.count(F.lit(1)).alias("historical_points"),
                                       F.max_by("y", F.struct("ts", "y")).alias("latest_value"))
    return latest.join(proj, keys).join(mape, keys, "left").select(
        *[col_(k) for k in keys], "historical_points", "latest_value", "projected_value",
        F.when(F.col("latest_value") != 0,
               (F.col("projected_value") - F.col("latest_value")) / F.col("latest_value") * 100.0)
        .otherwise(F.lit(0.0)).alias("change_percent"),
        "mape", F.lit(periods).alias("periods"), F.lit(interval).alias("interval_width"))


def forecast(df: DataFrame, date: str, value: str, keys: list[str] | None = None, periods: int = 30,
             interval: float = 0.95, refit: bool = False, min_points: int = MIN_POINTS, grain: str = "auto",
             step_seconds: int = 86_400) -> Tables:
    """Per-key forecasts: ``forecast`` (keys, ds, yhat, yhat_lower, yhat_upper), ``test``
    (holdout predictions), ``summary`` (points, latest, projected, change %, MAPE),
    ``skipped`` (series with fewer than ``min_points`` rows) and ``failed`` (keys, error): a series whose fit fails leaves the others their forecasts.

    ``grain``: ``day`` sums up each day; ``instant`` fits every instant and cuts at the exact row, ds being a timestamp and the
    horizon ``periods`` steps of ``step_seconds`` after the last training instant; ``auto`` takes instants where any value has a time of day.
    """
    if grain not in ("auto", "day", "instant"):
        raise ValueError(f"unknown grain '{grain}' (auto, day or instant)")
    user_keys = list(keys or [])
    series = prepare_series(df, date, value, user_keys, keep_time=True)
    # grouped pandas functions and joins take names without dots; a keyless call is one series under a constant key
    keys = [f"__k{i}" for i in range(len(user_keys))] or ["__one"]
    series = series.withColumnsRenamed(dict(zip(user_keys, keys))) if user_keys else series.withColumn("__one", F.lit(0))
    by_instant = (finest_grain(series) if grain == "auto" else grain) == "instant"

    def own(t: DataFrame) -> DataFrame:
        if by_instant and "ds" in t.columns:
            t = t.withColumn("ds", F.timestamp_micros("ds"))
        return t.withColumnsRenamed(dict(zip(keys, user_keys))) if user_keys else t.drop("__one")

    stats, holdout = instant_split(series, keys) if by_instant else (chrono_split(daily_stats(series, keys), keys), series)
    enough = stats.where(F.col("points") >= min_points)
    skipped = stats.where(F.col("points") < min_points).select(*[col_(k) for k in keys], "points").distinct()
    if not user_keys and enough.limit(1).count() == 0:
        found = stats.agg(F.max("points")).first()[0] or 0
        raise ValueError(f"Need at least {min_points} data points for forecasting (found {found})")
    # read by the forecast, the holdout join and the summary
    preds = fit_predict(enough, keys, periods, interval, refit, step_seconds * 1_000_000).persist()
    fc = preds.where(F.col("part") == "future").drop("part", "error")
    test = preds.where(F.col("part") == "test").drop("part", "error")
    failed = preds.where(F.col("part") == "failed").select(*[col_(k) for k in keys], "error")
    summary = forecast_summary(series, fc, holdout_mape(holdout, test, keys), keys, periods, interval)
    return Tables(forecast=own(fc), test=own(test), summary=own(summary), skipped=own(skipped), failed=own(failed), split=own(stats))


def future_dates(df: DataFrame, date: str, value: str, keys: list[str] | None = None, periods: int = 30) -> DataFrame:
    """``(keys..., ds)``: the ``periods`` days after each series' last training day (I-03)."""
    keys = list(keys or [])
    stats = chrono_split(daily_stats(prepare_series(df, date, value, keys), keys), keys)
    last = stats.where("is_train").groupBy(*[col_(k) for k in keys]).agg(F.max("ds").alias("last"))
    return last.select(*[col_(k) for k in keys], F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", periods))).alias("ds"))
