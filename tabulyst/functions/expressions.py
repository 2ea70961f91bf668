"""Scalar column expressions (JVM-side, stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Grading thresholds and labels of the reference tools.
STRENGTH_LEVELS = [(0.8, "very strong"), (0.6, "strong"), (0.4, "moderate")]  # else "weak"
QUALITY_LEVELS = [(5, "Excellent"), (15, "Good"), (30, "Fair")]  # missing percent below; else "Poor"
SCORE_LEVELS = [(0.9, "excellent"), (0.7, "good")]  # score above; else "fair"
SHIFT_PERCENT = 10.0  # abs(mean change percent) above this is a "significant" shift
STRONG_PAIR = 0.7  # "highly correlated" count threshold
MULTICOLLINEAR = 0.85  # multicollinearity warning threshold
SIGNIFICANCE = 0.05  # p-value cut for "significant"


def col_(c) -> Column:
    """A column by its whole name, which may hold dots; other columns as they are."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def strip_whitespace(c) -> Column:
    """Trim leading/trailing whitespace including tabs and newlines (plain trim only drops spaces)."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def strength(c) -> Column:
    a = F.abs(col_(c))
    out = F.lit("weak")
    for cut, label in reversed(STRENGTH_LEVELS):
        out = F.when(a >= cut, F.lit(label)).otherwise(out)
    return out


def direction(c) -> Column:
    """``positive`` for values above 0, otherwise ``negative`` (0 counts as negative)."""
    return F.when(col_(c) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def quality_grade(missing_percent) -> Column:
    p = col_(missing_percent)
    out = F.lit("Poor")
    for cut, label in reversed(QUALITY_LEVELS):
        out = F.when(p < cut, F.lit(label)).otherwise(out)
    return out


def score_grade(score) -> Column:
    s = col_(score)
    out = F.lit("fair")
    for cut, label in reversed(SCORE_LEVELS):
        out = F.when(s > cut, F.lit(label)).otherwise(out)
    return out


def percent_change(base, new) -> Column:
    """``(new - base) / base * 100``; null when the base is 0."""
    b, n = col_(base), col_(new)
    return F.when(b != 0, (n - b) / b * 100.0)


def key_text(c, dtype: T.DataType | None = None) -> Column:
    """Key rendered as text; missing keys become the text ``nan`` like the reference."""
    x = col_(c)
    if dtype is not None and isinstance(dtype, (T.FloatType, T.DoubleType)):
        x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
    return F.coalesce(x.cast("string"), F.lit("nan"))


def as_text(c, dtype: T.DataType) -> Column:
    """Value rendered as text for distinct/mode/top-value counting.

    Floats: NaN becomes null and -0.0 folds into 0.0 so text equality matches
    numeric equality.
    """
    x = col_(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(x), F.lit(None).cast("string")).otherwise((x + F.lit(0.0)).cast("string"))
    return x.cast("string")


def null_if_nan(c, dtype: T.DataType) -> Column:
    x = col_(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(x), F.lit(None).cast(dtype)).otherwise(x)
    return x


def blank_fill(c) -> Column:
    """Display value: text, with gaps shown as the empty string."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))
