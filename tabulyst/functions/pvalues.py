"""Two-sided p-values of correlation coefficients (Student t with n - 2 df).

``p = I_x(df / 2, 1 / 2)`` with ``x = df / (df + t^2)`` and
``t = r * sqrt(df / (1 - r^2))``; ``I`` is the regularised incomplete beta
function, evaluated by its continued fraction (modified Lentz method). Used as a
vectorised pandas UDF over the small table of top pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta ``I_x(a, b)``."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` over ``n`` rows."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return None
    df = n - 2
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * df / (1.0 - r * r)
    return betainc(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def _p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
                      for a, b in zip(r, n)], dtype="float64").astype(np.float64)


def p_value(r: Column | str, n: Column | str) -> Column:
    """Column expression: two-sided p-value of correlation ``r`` over ``n`` rows."""
    return _p_udf(F.col(r) if isinstance(r, str) else r, F.col(n) if isinstance(n, str) else n)
