"""Compare two datasets: shape, schema, statistics, categories, gaps and keys.

Column-level results (schema, statistics) are small tables built from schemas
and single-row aggregates. Value-level results (new/removed categories, keys
only on one side) are anti-joins of distributed distinct tables, left whole and
distributed; their summary counts come from the same plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.cells import cell_counts, modes, nunique
from tabulyst.functions.expressions import SHIFT_PERCENT, col_, key_text
from tabulyst.functions.quantiles import exact_quantiles
from tabulyst.result import Tables
from tabulyst.sources.schema import is_numeric_type, is_text_type, normalize_missing


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Names present in both, sorted."""
    return sorted(set(a.columns) & set(b.columns))


def shape_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(rows_1, columns_1, rows_2, columns_2, row_diff, col_diff)``."""
    ra = a.agg(F.count(F.lit(1)).alias("rows_1"))
    rb = b.agg(F.count(F.lit(1)).alias("rows_2"))
    return ra.crossJoin(rb).select(  # two single-row aggregates
        "rows_1", F.lit(len(a.columns)).cast("bigint").alias("columns_1"),
        "rows_2", F.lit(len(b.columns)).cast("bigint").alias("columns_2"),
        (F.col("rows_2") - F.col("rows_1")).alias("row_diff"),
        F.lit(len(b.columns) - len(a.columns)).cast("bigint").alias("col_diff"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, status, type_1, type_2, type_changed)``; status in only_in_1/only_in_2/common."""
    ta, tb = _types(a), _types(b)
    rows = []
    for c in sorted(set(ta) | set(tb)):
        s = "common" if c in ta and c in tb else ("only_in_1" if c in ta else "only_in_2")
        t1 = ta[c].simpleString() if c in ta else None
        t2 = tb[c].simpleString() if c in tb else None
        rows.append((c, s, t1, t2, bool(s == "common" and t1 != t2)))
    return a.sparkSession.createDataFrame(
        rows, "column string, status string, type_1 string, type_2 string, type_changed boolean")


def _side_stats(df: DataFrame, cols: list[str], **qkw) -> dict[str, dict]:
    res = exact_quantiles(df, cols, [0.5], **qkw) if cols else []
    out = {c: dict(mean=None, median=None, std=None, min=None, max=None) for c in cols}
    for r in res:
        out[r["column"]] = dict(mean=r["mean"], median=r["value"], std=r["std"], min=r["min"], max=r["max"])
    if cols:
        row = df.agg(*[F.sum(col_(c).isNull().cast("bigint")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            out[c]["missing"] = int(row[f"m{i}"] or 0)
    return out


def _r(x, places):
    return None if x is None else round(float(x), places)


def stats_diff(a: DataFrame, b: DataFrame, **qkw) -> DataFrame:
    """Side-by-side statistics of numeric columns common to both (booleans excluded).

    ``(column, mean_1, median_1, std_1, min_1, max_1, missing_1, …_2, mean_change,
    mean_change_pct, distribution_shift)``; the percent uses the mean change
    rounded to 4 places and is null when the first mean is 0.
    """
    ta, tb = _types(a), _types(b)
    cols = [c for c in common_columns(a, b) if is_numeric_type(ta[c]) and is_numeric_type(tb[c])]
    sa, sb = _side_stats(a, cols, **qkw), _side_stats(b, cols, **qkw)
    rows = []
    for c in cols:
        m1, m2 = sa[c]["mean"], sb[c]["mean"]
        change = _r((m2 or 0.0) - (m1 or 0.0), 4) if m1 is not None and m2 is not None else None
        pct = round(change / m1 * 100, 2) if change is not None and m1 not in (None, 0) else None
        shift = "significant" if abs(pct or 0) > SHIFT_PERCENT else "minor"
        rows.append((c,) + tuple(_r(sa[c][k], 4) for k in ("mean", "median", "std", "min", "max")) + (sa[c]["missing"],)
                    + tuple(_r(sb[c][k], 4) for k in ("mean", "median", "std", "min", "max")) + (sb[c]["missing"],)
                    + (change, pct, shift))
    schema = ("column string, mean_1 double, median_1 double, std_1 double, min_1 double, max_1 double, missing_1 bigint, "
              "mean_2 double, median_2 double, std_2 double, min_2 double, max_2 double, missing_2 bigint, "
              "mean_change double, mean_change_pct double, distribution_shift string")
    return a.sparkSession.createDataFrame(rows, schema)


def _text_common(a: DataFrame, b: DataFrame) -> list[str]:
    ta, tb = _types(a), _types(b)
    return [c for c in common_columns(a, b) if is_text_type(ta[c]) and is_text_type(tb[c])]


def category_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, change, value)``: values new in the second side or removed from the first."""
    cols = _text_common(a, b)
    if not cols:
        return a.sparkSession.createDataFrame([], "column string, change string, value string")
    ca = cell_counts(a, cols).where(F.col("value").isNotNull()).select("column", "value")
    cb = cell_counts(b, cols).where(F.col("value").isNotNull()).select("column", "value")
    new = cb.join(ca, ["column", "value"], "left_anti").select("column", F.lit("new_in_2").alias("change"), "value")
    gone = ca.join(cb, ["column", "value"], "left_anti").select("column", F.lit("removed_from_1").alias("change"), "value")
    return new.unionByName(gone)


def category_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, unique_values_1, unique_values_2, new_values, removed_values, top_value_1, top_value_2)``."""
    spark = a.sparkSession
    cols = _text_common(a, b)
    schema = ("column string, unique_values_1 bigint, unique_values_2 bigint, new_values bigint, removed_values bigint, "
              "top_value_1 string, top_value_2 string")
    if not cols:
        return spark.createDataFrame([], schema)
    ca, cb = cell_counts(a, cols), cell_counts(b, cols)
    base = spark.createDataFrame([(c,) for c in cols], "column string")
    diff = category_diff(a, b).groupBy("column").agg(
        F.count_if(F.col("change") == "new_in_2").alias("new_values"),
        F.count_if(F.col("change") == "removed_from_1").alias("removed_values"))
    out = (base
           .join(nunique(ca).withColumnRenamed("unique_values", "unique_values_1"), "column", "left")
           .join(nunique(cb).withColumnRenamed("unique_values", "unique_values_2"), "column", "left")
           .join(diff, "column", "left")
           .join(modes(ca).withColumnRenamed("mode", "top_value_1"), "column", "left")
           .join(modes(cb).withColumnRenamed("mode", "top_value_2"), "column", "left"))
    return out.select(
        "column", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                    for c in ("unique_values_1", "unique_values_2", "new_values", "removed_values")],
        "top_value_1", "top_value_2")


def missing_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, missing_1, missing_2, change)`` for common columns whose gap counts differ."""
    cols = common_columns(a, b)
    if not cols:
        return a.sparkSession.createDataFrame([], "column string, missing_1 bigint, missing_2 bigint, change bigint")

    def counts(df, suffix):
        row = df.agg(*[F.sum(col_(c).isNull().cast("bigint")).alias(f"m{i}") for i, c in enumerate(cols)])
        arr = F.array(*[F.struct(F.lit(c).alias("column"),
                                 F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("bigint").alias(f"missing_{suffix}"))
                        for i, c in enumerate(cols)])
        return row.select(F.inline(arr))

    # both sides are one row per common column
    j = counts(a, 1).join(counts(b, 2), "column")
    return (j.where(F.col("missing_1") != F.col("missing_2"))
            .select("column", "missing_1", "missing_2", (F.col("missing_2") - F.col("missing_1")).alias("change")))


def _key_frames(a: DataFrame, b: DataFrame, key: str):
    ta, tb = _types(a)[key], _types(b)[key]
    ka, kb = col_(key), col_(key)
    if ta != tb and is_numeric_type(ta) and is_numeric_type(tb):
        # widen both sides first, so 7 and 7.0 render as the same text
        ka, kb, ta, tb = ka.cast("double"), kb.cast("double"), T.DoubleType(), T.DoubleType()
    da = a.select(key_text(ka, ta).alias("key")).distinct()
    db = b.select(key_text(kb, tb).alias("key")).distinct()
    return da, db


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(side, key)``: key texts present on only one side (``only_in_1`` / ``only_in_2``)."""
    da, db = _key_frames(a, b, key)
    return (da.join(db, "key", "left_anti").select(F.lit("only_in_1").alias("side"), "key")
            .unionByName(db.join(da, "key", "left_anti").select(F.lit("only_in_2").alias("side"), "key")))


def key_summary(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(match_column, rows_only_in_1, rows_only_in_2, common_rows)`` in one full outer join."""
    da, db = _key_frames(a, b, key)
    j = da.withColumn("l", F.lit(1)).join(db.withColumn("r", F.lit(1)), "key", "full_outer")
    return j.agg(
        F.count_if(F.col("r").isNull()).cast("bigint").alias("rows_only_in_1"),
        F.count_if(F.col("l").isNull()).cast("bigint").alias("rows_only_in_2"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).cast("bigint").alias("common_rows"),
    ).select(F.lit(key).alias("match_column"), "*")


def compare_summary(schema: DataFrame, stats: DataFrame) -> DataFrame:
    """``(overall_similarity, schema_changed, significant_shifts, shifted_columns, recommendation)``."""
    sch = schema.agg(
        F.count_if(F.col("status") != "common").alias("only"),
        F.count_if(F.col("type_changed")).alias("changed"))
    st = stats.agg(
        F.count_if(F.col("distribution_shift") == "significant").alias("shifts"),
        F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("distribution_shift") == "significant", F.col("column")))), ", ").alias("cols"))
    # both sides are single rows; the collected list is bounded by the column count
    j = sch.crossJoin(st)
    sim = (F.when((F.col("shifts") == 0) & (F.col("only") == 0), F.lit("high"))
           .when(F.col("shifts") <= 2, F.lit("moderate")).otherwise(F.lit("low")))
    rec = F.when(F.col("shifts") == 0, F.lit("Datasets look very similar — minor differences only.")).otherwise(
        F.concat(F.lit("Notable distribution shifts in: "), F.col("cols"), F.lit(". Investigate before merging.")))
    return j.select(sim.alias("overall_similarity"), ((F.col("only") + F.col("changed")) > 0).alias("schema_changed"),
                    F.col("shifts").cast("bigint").alias("significant_shifts"),
                    F.coalesce(F.col("cols"), F.lit("")).alias("shifted_columns"), rec.alias("recommendation"))


def compare(a: DataFrame, b: DataFrame, key: str | None = None, **qkw) -> Tables:
    """All comparison tables; ``key`` adds ``key_diff`` and ``key_summary``."""
    a, b = normalize_missing(a), normalize_missing(b)
    schema = schema_diff(a, b)
    stats = stats_diff(a, b, **qkw)
    out = Tables(shape=shape_diff(a, b), schema=schema, statistics=stats,
                 categories=category_summary(a, b), category_changes=category_diff(a, b),
                 missing=missing_diff(a, b), summary=compare_summary(schema, stats))
    if key and key in a.columns and key in b.columns:
        out["key_diff"] = key_diff(a, b, key)
        out["key_summary"] = key_summary(a, b, key)
    return out
