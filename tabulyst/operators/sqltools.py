"""Schema as SQL DDL with sample values, and SQL over loaded tables.

The reference turns a question into SQL with a remote language model and never
runs it; the data work around it is (a) the schema with types and sample values
and (b) a SQL text meant to run on the loaded table. Both are kept: ``table_ddl``
and ``run_sql`` (Spark SQL over temp views).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.operators.charts import _first
from tabulyst.result import Tables

SAMPLES = 3  # fixed value: sample values shown per column


def sql_type(dt: T.DataType) -> str:
    """INTEGER / FLOAT / DATE / VARCHAR(255) like the reference's type mapping."""
    if isinstance(dt, T.IntegralType):
        return "INTEGER"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    return "VARCHAR(255)"


def table_ddl(df: DataFrame, name: str = "dataset", order_by: list[str] | None = None) -> Tables:
    """``columns(ordinal, column, sql_type, samples)`` and ``ddl(name, ddl)``.

    Samples are the first three non-null values per column (in ``order_by``
    order): one top-3 per column (``TakeOrderedAndProject``: a bounded heap per
    partition, no sort), all in a single job; each scan is pruned to the column
    and the order keys. (A single scan of all columns with a per-column window
    group limit sorts every cell, and ``min_by`` over a wide struct key evaluates
    slowly; both measured slower on the driver tables.)
    """
    spark = df.sparkSession
    parts = []
    for i, f in enumerate(df.schema.fields):
        keep = [f.name] + [c for c in (order_by or []) if c != f.name]
        head = _first(df.select(*keep).where(F.col(f.name).isNotNull()), SAMPLES, order_by)
        parts.append(head.select(F.lit(i + 1).alias("ordinal"), "seq", F.col(f.name).cast("string").alias("v")))
    samples = reduce(DataFrame.unionByName, parts).groupBy("ordinal").agg(  # at most 3 rows per column
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]), ", ")
        .alias("samples"))
    cols = spark.createDataFrame(
        [(i + 1, f.name, sql_type(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "ordinal int, column string, sql_type string")
    columns = cols.join(samples, "ordinal", "left").select(
        "ordinal", "column", "sql_type", F.coalesce("samples", F.lit("")).alias("samples"))
    lines = columns.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "column", "sql_type", "samples"))),
        lambda x: F.concat(F.lit("  "), x["column"], F.lit(" "), x["sql_type"], F.lit("  -- e.g. ["), x["samples"],
                           F.lit("]"))), ",\n").alias("body"))
    ddl = lines.select(F.lit(name).alias("name"),
                       F.concat(F.lit(f"CREATE TABLE {name} (\n"), F.col("body"), F.lit("\n);")).alias("ddl"))
    return Tables(columns=columns, ddl=ddl)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL over the given DataFrames as views that exist during this call alone.

    The result is resolved before they go; a caller's view of the same name comes back.
    """
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in views}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
