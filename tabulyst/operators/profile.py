"""Dataset profiling (analyze) and the quality report.

* ``describe_numeric`` – mean, median, sd, min, max, count per numeric column:
  one aggregate over the long value table plus the exact-median refinement.
* ``quality_summary`` – missing cells, duplicate rows and completeness from ONE
  ``groupBy`` on a 128-bit row fingerprint (or on all columns): the null count
  of a row is fixed within its group, so ``sum(c * nulls)`` gives the missing
  cells and ``sum(c - 1)`` the duplicates.
* ``missing_by_column`` – one aggregate, unpivoted.
* ``column_profile`` – per-column non-null/null/unique counts and numeric moments.
* ``profile`` / ``quality_report`` – the composite tools.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.cells import cell_counts, modes, nunique_direct, top_values
from tabulyst.functions.expressions import col_, null_if_nan, quality_grade
from tabulyst.functions.quantiles import exact_quantiles
from tabulyst.result import Tables
from tabulyst.sources.schema import approx_size, categorical_columns, column_types, numeric_columns, table_shape



def _is_null(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    c = col_(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    return False


def groupable_columns(df: DataFrame) -> list[Column]:
    """Columns usable as grouping keys: NaN folded into null, maps rendered as JSON."""
    out = []
    for f in df.schema.fields:
        if _has_map(f.dataType):
            out.append(F.to_json(F.struct(col_(f.name))).alias(f.name))
        else:
            out.append(null_if_nan(f.name, f.dataType).alias(f.name))
    return out


def row_null_count(df: DataFrame) -> Column:
    terms = [_is_null(df, c).cast("bigint") for c in df.columns]
    return reduce(lambda a, b: a + b, terms, F.lit(0).cast("bigint"))


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row (NaN folded into null, with a
    null mask so that rows differing only in where their gaps are do not collide)."""
    cols = groupable_columns(df)
    mask = F.concat(*[F.when(_is_null(df, c), F.lit("1")).otherwise(F.lit("0")) for c in df.columns]) \
        if df.columns else F.lit("")
    return [F.xxhash64(F.lit("fp-a"), mask, *cols).alias("__h1"), F.xxhash64(F.lit("fp-b"), mask, *cols).alias("__h2")]


def quality_summary(df: DataFrame, fingerprint: bool = True) -> DataFrame:
    """``(rows, missing_values, missing_percent, duplicate_rows, duplicate_percent, completeness)``.

    Duplicates are rows beyond the first of equal rows. With ``fingerprint`` the
    shuffle groups rows by a 128-bit fingerprint (about 24 bytes per row instead
    of the whole row; a false duplicate needs a 128-bit collision), otherwise by
    all columns. Missing cells are a per-row count summed in the same pass (a
    row's null count is fixed within its group).
    """
    n_cols = len(df.columns)
    nulls = row_null_count(df).alias("__nulls")
    keyed = df.select(*(row_fingerprint(df) if fingerprint else groupable_columns(df)), nulls)
    keys = [c for c in keyed.columns if c != "__nulls"]
    g = keyed.groupBy(*[col_(c) for c in keys]).agg(F.count(F.lit(1)).alias("__c"), F.max("__nulls").alias("__nulls"))
    s = g.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("__c") * F.col("__nulls")), F.lit(0)).cast("bigint").alias("missing_values"),
    )
    cells = F.col("rows") * F.lit(n_cols)
    mp = F.when(cells > 0, F.col("missing_values") / cells * 100.0).otherwise(F.lit(0.0))
    return s.select(
        "rows", "missing_values", mp.alias("missing_percent"), "duplicate_rows",
        F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows") * 100.0).otherwise(F.lit(0.0))
        .alias("duplicate_percent"),
        ((F.lit(1.0) - mp / 100.0) * 100.0).alias("completeness"),
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """``(rows, duplicate_rows, duplicate_percent)`` — rows beyond the first of equal rows."""
    return quality_summary(df).select("rows", "duplicate_rows", "duplicate_percent")


def missing_summary(df: DataFrame) -> DataFrame:
    """``(missing_values, missing_percent, completeness)`` in one aggregate."""
    n_cols = len(df.columns)
    s = df.agg(F.count(F.lit(1)).alias("rows"),
               F.coalesce(F.sum(row_null_count(df)), F.lit(0)).cast("bigint").alias("missing_values"))
    cells = F.col("rows") * F.lit(n_cols)
    mp = F.when(cells > 0, F.col("missing_values") / cells * 100.0).otherwise(F.lit(0.0))
    return s.select("missing_values", mp.alias("missing_percent"), ((F.lit(1.0) - mp / 100.0) * 100.0).alias("completeness"))


def missing_by_column(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """``(column, count, percent)`` — columns with gaps (all columns when ``only_missing=False``)."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.sum(_is_null(df, c).cast("bigint")).alias(f"__m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"__m{i}"), F.lit(0)).cast("bigint").alias("count"))
                    for i, c in enumerate(df.columns)])
    out = row.select("__rows", F.inline(arr)).select(
        "column", "count",
        F.when(F.col("__rows") > 0, F.col("count") / F.col("__rows") * 100.0).otherwise(F.lit(0.0)).alias("percent"))
    return out.where(F.col("count") > 0) if only_missing else out


def describe_numeric(df: DataFrame, cols: list[str] | None = None, limit: int | None = None, **qkw) -> DataFrame:
    """``(column, mean, median, std, min, max, count)`` for numeric columns with values.

    All columns share one aggregate; the median is exact (see ``functions.quantiles``).
    """
    spark = df.sparkSession
    cols = numeric_columns(df) if cols is None else cols
    if limit is not None:
        cols = cols[:limit]
    schema = "column string, mean double, median double, std double, min double, max double, count bigint"
    res = exact_quantiles(df, cols, [0.5], **qkw) if cols else []
    by_col = {r["column"]: r for r in res}
    rows = [(c, by_col[c]["mean"], by_col[c]["value"], by_col[c]["std"], by_col[c]["min"], by_col[c]["max"], by_col[c]["n"])
            for c in cols if c in by_col]
    return spark.createDataFrame(rows, schema)


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """``(ordinal, name, type, non_null, null_count, unique_values, mean, std, min, max)``.

    Numeric moments only for numeric columns; one aggregate for the counts and
    moments, one cells shuffle for the distinct counts.
    """
    nums = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.sum(_is_null(df, f.name).cast("bigint")).alias(f"__n{i}"))
        if f.name in nums:
            x = null_if_nan(f.name, f.dataType).cast("double")
            aggs += [F.avg(x).alias(f"__a{i}"), F.stddev_samp(x).alias(f"__s{i}"),
                     F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    row = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    arr = F.array(*[F.struct(
        F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
        (F.col("__rows") - F.coalesce(F.col(f"__n{i}"), F.lit(0))).cast("bigint").alias("non_null"),
        F.coalesce(F.col(f"__n{i}"), F.lit(0)).cast("bigint").alias("null_count"),
        (F.col(f"__a{i}") if f.name in nums else null_d).alias("mean"),
        (F.col(f"__s{i}") if f.name in nums else null_d).alias("std"),
        (F.col(f"__lo{i}") if f.name in nums else null_d).alias("min"),
        (F.col(f"__hi{i}") if f.name in nums else null_d).alias("max"),
    ) for i, f in enumerate(df.schema.fields)])
    stats = row.select(F.inline(arr))
    uniq = nunique_direct(df, df.columns, approx=approx_distinct).withColumnRenamed("column", "name")
    # ``uniq`` has one row per column: a bounded broadcast
    return (stats.join(F.broadcast(uniq), "name", "left")
            .select("ordinal", "name", "type", "non_null", "null_count",
                    F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"),
                    "mean", "std", "min", "max"))


def profile(df: DataFrame, kind: str = "full", statistics_columns: int | None = None, **qkw) -> Tables:
    """Dataset analysis: ``full`` / ``quality`` / ``statistics`` / ``quick``.

    Tables: ``shape``, ``types`` always; ``quality`` and ``missing`` for full/quality;
    ``statistics`` (all numeric columns, or the first ``statistics_columns``) for full/statistics.
    """
    if kind not in ("full", "quality", "statistics", "quick"):
        raise ValueError(f"unknown analysis kind: {kind}")
    out = Tables(shape=table_shape(df), types=column_types(df))
    if kind in ("full", "quality"):
        out["quality"] = quality_summary(df).drop("rows")
        out["missing"] = missing_by_column(df)
    if kind in ("full", "statistics"):
        out["statistics"] = describe_numeric(df, limit=statistics_columns, **qkw)
    return out


def recommendations(quality: DataFrame, n_numeric: int) -> DataFrame:
    """``(seq, text)`` rules: missing > 10 %, any duplicates, fewer than 2 numeric columns."""
    rules = F.array(
        F.when(F.col("missing_percent") > 10, F.format_string(
            "High missing data (%.1f%%). Consider data imputation or removal.", F.col("missing_percent"))),
        F.when(F.col("duplicate_rows") > 0, F.format_string(
            "Found %d duplicate rows. Remove before analysis.", F.col("duplicate_rows"))),
        F.lit("Limited numeric columns. Consider feature engineering.") if n_numeric < 2 else F.lit(None).cast("string"),
    )
    kept = F.filter(rules, lambda x: x.isNotNull())
    final = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Dataset quality looks good. Ready for analysis.")))
    return quality.select(F.posexplode(final).alias("pos", "text")).select(
        (F.col("pos") + 1).cast("int").alias("seq"), "text")


def quality_report(df: DataFrame, target: str | None = None, include_ml: bool = True, **automl_kw) -> Tables:
    """Quality report: summary, grade, column profile, recommendations (+ AutoML tables)."""
    n_num = len(numeric_columns(df))
    n_cat = len(categorical_columns(df))
    q = quality_summary(df)
    size = approx_size(df)
    summary = q.crossJoin(size).select(  # both sides are single rows
        F.format_string("%,d rows × %d columns", F.col("rows"), F.lit(len(df.columns))).alias("dataset_size"),
        F.lit(n_num).cast("bigint").alias("numeric_columns"), F.lit(n_cat).cast("bigint").alias("categorical_columns"),
        "missing_values", "duplicate_rows", F.col("megabytes").alias("size_mb"))
    grade = q.select(quality_grade("missing_percent").alias("assessment"), "missing_percent",
                     (F.lit(100.0) - F.col("missing_percent")).alias("quality_score"))
    out = Tables(summary=summary, grade=grade, columns=column_profile(df), recommendations=recommendations(q, n_num))
    if include_ml and target and target in df.columns:
        from tabulyst.operators.automl import automl
        try:
            ml = automl(df, target, **automl_kw)
            out.update({f"ml_{k}": v for k, v in ml.items()})
        except ValueError:
            pass  # the report is still valid without the model section
    return out


def nunique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, unique_values)``: distinct non-null values per column (one cells shuffle,
    or HyperLogLog sketches with ``approx=True``)."""
    return nunique_direct(df, list(cols or df.columns), approx=approx)


def mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, mode)``: most frequent non-null value per column, smallest on ties."""
    return modes(cell_counts(df, list(cols or df.columns)))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Frequency table of one column.

    With ``k``: ``(rank, value, count)``, the k most frequent by (count desc, value
    asc). Without: ``(value, count)`` for every non-null value, left distributed.
    """
    counts = cell_counts(df, [column])
    if k is None:
        return counts.where(F.col("value").isNotNull()).select("value", F.col("n").alias("count"))
    return top_values(counts, k).select("rank", "value", F.col("n").alias("count"))


__all__ = [
    "quality_summary", "duplicate_summary", "missing_summary", "missing_by_column", "describe_numeric",
    "column_profile", "profile", "recommendations", "quality_report", "value_counts", "nunique", "mode", "cell_counts",
]
