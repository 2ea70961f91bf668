"""Row cleaning: strip text, drop duplicate rows, fill gaps, remove z-score outliers.

Order (as in the reference tool): strip -> de-duplicate -> fill numeric -> fill
text -> outliers, so text modes see the rows left by a numeric ``drop`` and the
"filled" count is taken after de-duplication.

Scale notes: de-duplication is one shuffle on all columns (map-side partial
aggregation collapses a row repeated a third of the table). Its result is
materialised once (``checkpoint`` into the shared checkpoint folder by default)
because the fill constants, modes, outlier statistics and counts each read it.
Fill constants reach the plan as literals; the cleaned rows stay a lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.functions.cells import cell_counts, modes
from tabulyst.functions.expressions import col_
from tabulyst.functions.expressions import strip_whitespace as strip_expr
from tabulyst.functions.quantiles import medians
from tabulyst.result import Tables
from tabulyst.session import checkpoint_dir
from tabulyst.sources.schema import normalize_missing, numeric_columns, text_columns

FILL_NUMERIC = ("median", "mean", "zero", "drop")
FILL_TEXT = ("mode", "unknown", "drop")
UNKNOWN = "Unknown"  # fixed value: text used for gaps without a mode


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Trim both ends of every text column (blank text becomes "", not null)."""
    texts = set(text_columns(df))
    return df.select(*[strip_expr(c).alias(c) if c in texts else col_(c) for c in df.columns])


def drop_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remove rows with a gap in any of ``cols``."""
    for c in cols:
        df = df.where(col_(c).isNotNull())
    return df


def fill_numeric(df: DataFrame, how: str = "median", cols: list[str] | None = None, **qkw) -> DataFrame:
    """Fill gaps of numeric columns: ``median`` / ``mean`` / ``zero`` / ``drop``.

    Filled columns become doubles (a fractional median fits an int column only as
    a double, as in the reference where gaps make an int column float).
    Constants come from one aggregate and enter the plan as literals.
    """
    if how not in FILL_NUMERIC:
        raise ValueError(f"unknown fill_numeric: {how}")
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return df
    if how == "drop":
        return drop_nulls(df, cols)
    if how == "median":
        consts = medians(df, cols, **qkw)
    elif how == "mean":
        row = df.agg(*[F.avg(col_(c)) for c in cols]).first()
        consts = dict(zip(cols, row))
    else:
        consts = {c: 0.0 for c in cols}
    return df.select(*[F.coalesce(col_(c).cast("double"), F.lit(consts[c]).cast("double")).alias(c) if c in cols
                       else col_(c) for c in df.columns])


def impute_median(df: DataFrame, cols: list[str], **qkw) -> DataFrame:
    """Gaps of ``cols`` -> exact column median."""
    return fill_numeric(df, "median", cols, **qkw)


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Gaps of ``cols`` -> 0."""
    return fill_numeric(df, "zero", cols)


def impute_label(df: DataFrame, target: str, **qkw) -> DataFrame:
    """Gaps of a numeric target -> its median."""
    return fill_numeric(df, "median", [target], **qkw)


def fill_categorical(df: DataFrame, how: str = "mode", cols: list[str] | None = None) -> DataFrame:
    """Fill gaps of text columns: ``mode`` (smallest on ties, ``Unknown`` when the
    column has no value) / ``unknown`` / ``drop``. Modes come from one cells shuffle."""
    if how not in FILL_TEXT:
        raise ValueError(f"unknown fill_categorical: {how}")
    cols = text_columns(df) if cols is None else list(cols)
    if not cols:
        return df
    if how == "drop":
        return drop_nulls(df, cols)
    found = {r["column"]: r["mode"] for r in modes(cell_counts(df, cols)).collect()} if how == "mode" else {}
    fill = {c: UNKNOWN if found.get(c) is None else found[c] for c in cols}
    return df.select(*[F.coalesce(col_(c), F.lit(fill[c])).alias(c) if c in fill else col_(c) for c in df.columns])


# ``clean`` takes options named like these functions; it calls them through aliases
_fill_numeric, _fill_categorical = fill_numeric, fill_categorical


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    """Cut lineage: reliable checkpoint into the shared folder, or persist, or nothing."""
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist()
    return df


def _null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.sum(col_(c).isNull().cast("bigint")).alias(f"__m{i}") for i, c in enumerate(df.columns)]).first()
    return int(row["__n"]), {c: int(row[f"__m{i}"] or 0) for i, c in enumerate(df.columns)}


def zscore_filter(df: DataFrame, cols: list[str], threshold: float = 3.0, mode: str = "sequential") -> DataFrame:
    """Keep rows whose |z| <= threshold in every numeric column (sd > 0 only).

    ``sequential`` recomputes mean/sd after each column's filter (reference
    semantics, one aggregate per column); ``single_pass`` uses one aggregate for
    all columns. A gap in a checked column drops the row.
    """
    if mode not in ("sequential", "single_pass"):
        raise ValueError(f"unknown outlier mode: {mode}")
    if mode == "single_pass":
        row = df.agg(*[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(col_(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = row[f"m{i}"], row[f"s{i}"]
            if s is not None and s > 0:
                df = df.where(F.abs((col_(c) - F.lit(m)) / F.lit(s)) <= threshold)
        return df
    for c in cols:
        row = df.agg(F.avg(col_(c)).alias("m"), F.stddev_samp(col_(c)).alias("s")).first()
        m, s = row["m"], row["s"]
        if s is not None and s > 0:
            df = df.where(F.abs((col_(c) - F.lit(m)) / F.lit(s)) <= threshold)
    return df


def clean(df: DataFrame, drop_duplicates: bool = True, fill_numeric: str = "median", fill_categorical: str = "mode",
          remove_outliers: bool = False, outlier_threshold: float = 3.0, strip_whitespace: bool = True,
          outlier_mode: str = "sequential", materialize_as: str = "checkpoint", **qkw) -> Tables:
    """Clean rows; returns ``cleaned`` rows, ``report(seq, step, detail, count)`` and
    ``summary(rows_before, rows_after, rows_removed, columns, completeness)``."""
    if fill_numeric not in FILL_NUMERIC:
        raise ValueError(f"unknown fill_numeric: {fill_numeric}")
    if fill_categorical not in FILL_TEXT:
        raise ValueError(f"unknown fill_categorical: {fill_categorical}")
    fill_numeric_, fill_categorical_ = fill_numeric, fill_categorical
    spark = df.sparkSession
    df = normalize_missing(df)
    report = []
    texts = text_columns(df)
    if strip_whitespace:
        df = strip_whitespace_(df)
        if texts:
            report.append(("strip_whitespace",
                           f"Stripped whitespace from {len(texts)} text columns: {texts!r}", len(texts)))
    base = df.dropDuplicates() if drop_duplicates else df
    base = materialize(base, materialize_as)
    rows_after_dedupe, missing = _null_counts(base)
    if drop_duplicates:
        rows_before = df.count()
        removed = rows_before - rows_after_dedupe
        report.append(("drop_duplicates", f"Removed {removed} duplicate rows" if removed else "No duplicate rows found",
                       removed))
    else:
        rows_before = rows_after_dedupe

    out = base
    total_missing = sum(missing.values())
    if total_missing > 0:
        nums = [c for c in numeric_columns(base) if missing[c] > 0]
        out = _fill_numeric(out, fill_numeric_, nums, **qkw) if nums else out
        cats = [c for c in texts if missing.get(c, 0) > 0]
        out = _fill_categorical(out, fill_categorical_, cats) if cats else out
        filled = "{" + ", ".join(f"{c!r}: {n}" for c, n in missing.items() if n > 0) + "}"
        report.append(("fill_missing", f"Filled {total_missing} missing values: {filled}", total_missing))
    else:
        report.append(("fill_missing", "No missing values found", 0))

    if remove_outliers:
        before = out.count()
        out = zscore_filter(out, numeric_columns(out), outlier_threshold, outlier_mode)
        after = out.count()
        n = before - after
        report.append(("remove_outliers", f"Removed {n} outlier rows (Z-score > {outlier_threshold})" if n
                       else "No outliers removed", n))

    n_cols = len(out.columns)
    summary = out.agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(sum([col_(c).isNull().cast("bigint") for c in out.columns], F.lit(0).cast("bigint"))).alias("missing"),
    ).select(
        F.lit(rows_before).cast("bigint").alias("rows_before"), F.col("rows_after"),
        (F.lit(rows_before) - F.col("rows_after")).cast("bigint").alias("rows_removed"),
        F.lit(n_cols).cast("bigint").alias("columns"),
        F.when(F.col("rows_after") * n_cols > 0,
               F.round((F.lit(1.0) - F.col("missing") / (F.col("rows_after") * n_cols)) * 100.0, 2))
        .otherwise(F.lit(100.0)).alias("completeness"),
    )
    rep = spark.createDataFrame([(i + 1, s, d, int(c)) for i, (s, d, c) in enumerate(report)],
                                "seq int, step string, detail string, count bigint")
    return Tables(cleaned=out, report=rep, summary=summary)


strip_whitespace_ = strip_whitespace
