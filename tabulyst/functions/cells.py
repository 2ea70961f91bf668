"""The long "cells" table: one shuffle answers distinct counts, modes and top values.

``cell_counts(df, cols)`` unpivots the chosen columns to ``(column, value)`` text
cells and counts them with ``groupBy(column, value)``. Partial aggregation on the
map side collapses repeated values before the shuffle, so a value holding a third
of all rows becomes one row per map task. From the counts:

* ``nunique`` = number of non-null values per column,
* ``mode`` = most frequent value, smallest on ties,
* ``top_values`` = first k by (count desc, value asc); the row-number filter is
  planned as a window group limit, so each map task ships at most k rows per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.functions.expressions import as_text


def cell_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)`` — value as text, null kept as its own cell."""
    types = {f.name: f.dataType for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(c).alias("column"), as_text(c, types[c]).alias("value")) for c in cols])
    return df.select(F.inline(arr)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def nunique(counts: DataFrame) -> DataFrame:
    """``(column, unique_values)`` from a cells table."""
    return (counts.where(F.col("value").isNotNull()).groupBy("column")
            .agg(F.count(F.lit(1)).alias("unique_values")))


def nunique_direct(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """``(column, unique_values)``; ``approx=True`` uses HyperLogLog++ (no shuffle of values)."""
    if not approx:
        return nunique(cell_counts(df, cols))
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[F.approx_count_distinct(as_text(c, types[c]), rsd).alias(f"_u{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_u{i}").cast("bigint").alias("unique_values"))
                    for i, c in enumerate(cols)])
    return row.select(F.inline(arr))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent non-null values per column."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (counts.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def modes(counts: DataFrame) -> DataFrame:
    """``(column, mode)``: most frequent non-null value, smallest on ties (one aggregate)."""
    return (counts.where(F.col("value").isNotNull()).groupBy("column")
            .agg(F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode")))
