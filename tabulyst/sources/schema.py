"""Schema-level operators: column roles, types, shape, size, missing normalisation.

All of these read ``df.schema`` (no job) or run one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.expressions import col_

# Text treated as missing when ``normalize_missing(text=True)``;
# these are the default NA strings of the pandas CSV reader.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric role: integral, fractional and decimal types; booleans are not numeric."""
    return isinstance(dt, T.NumericType)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_date_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric (text, dates, booleans, nested)."""
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]


def role_of(dt: T.DataType) -> str:
    if is_numeric_type(dt):
        return "numeric"
    if is_text_type(dt):
        return "text"
    if is_date_type(dt):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def column_roles(df: DataFrame) -> DataFrame:
    """``(ordinal, column, type, role)`` — one row per column, built from the schema."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), role_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = "ordinal int, column string, type string, role string"
    return spark.createDataFrame(rows, schema)


def column_types(df: DataFrame) -> DataFrame:
    """``(column, type)`` with Spark's simple type names."""
    return column_roles(df).select("column", "type")


def table_shape(df: DataFrame) -> DataFrame:
    """``(rows, columns, numeric_columns, categorical_columns)`` in one count job."""
    n_num = len(numeric_columns(df))
    n_col = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(n_col).cast("bigint").alias("columns"),
        F.lit(n_num).cast("bigint").alias("numeric_columns"),
        F.lit(n_col - n_num).cast("bigint").alias("categorical_columns"),
    )


def _width(dt: T.DataType) -> int | None:
    fixed = {
        T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
        T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    for k, v in fixed.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return 16
    return None


def approx_size_expr(df: DataFrame) -> Column:
    """Bytes of the table: fixed widths for scalar types, octet length for text/binary."""
    terms = []
    for f in df.schema.fields:
        w = _width(f.dataType)
        if w is not None:
            terms.append(F.when(F.col(f.name).isNotNull(), F.lit(w)).otherwise(F.lit(0)))
        elif is_text_type(f.dataType) or isinstance(f.dataType, T.BinaryType):
            terms.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        else:
            terms.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f.name)))), F.lit(0)))
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def approx_size(df: DataFrame) -> DataFrame:
    """``(bytes, megabytes)``: data size in one aggregate (re-aim of an in-memory size)."""
    return df.agg(F.sum(approx_size_expr(df)).cast("bigint").alias("bytes")).select(
        F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"),
        F.round(F.coalesce("bytes", F.lit(0)) / F.lit(1024.0 * 1024.0), 4).alias("megabytes"),
    )


def normalize_missing(df: DataFrame, text: bool = False) -> DataFrame:
    """Turn NaN in floating columns into null; optionally NA-like text into null.

    Spark keeps NaN distinct from null, the reference treats them alike; doing this
    once at entry lets every null-skipping aggregate behave like the reference.
    """
    out = []
    for f in df.schema.fields:
        c = col_(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        elif text and is_text_type(f.dataType):
            out.append(F.when(F.trim(c).isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def select_columns(df: DataFrame, columns: str | list[str] | None, default: str = "numeric",
                   require_numeric: bool = True) -> tuple[list[str], list[str]]:
    """Resolve a comma list (or list) of names: returns ``(used, ignored)``.

    Unknown names are dropped (and reported as ignored); an empty spec means all
    numeric columns. A named non-numeric column raises ``ValueError``.
    """
    if columns is None or (isinstance(columns, str) and not columns.strip()) or (isinstance(columns, list) and not columns):
        return (numeric_columns(df) if default == "numeric" else list(df.columns)), []
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else [c.strip() for c in columns]
    names = [c for c in names if c]
    used = [c for c in names if c in df.columns]
    ignored = [c for c in names if c not in df.columns]
    if require_numeric:
        types = dict((f.name, f.dataType) for f in df.schema.fields)
        bad = [c for c in used if not is_numeric_type(types[c])]
        if bad:
            raise ValueError(f"columns are not numeric: {bad}")
    return used, ignored


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n and n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {missing}")
