"""Distributed ranks of column values (average ranks for ties, dense ranks).

A rank needs the number of rows below each value: a prefix sum in value order.
A plain ``rank() OVER (ORDER BY v)`` puts the whole column in one task. Here, for
all requested columns at once:

1. the long table ``(column, value)`` is counted with ``groupBy(column, value)``:
   distinct values with multiplicities (a value holding a third of the rows is
   one row after the map-side partial aggregate);
2. a column with at most ``group_rows`` distinct values finishes its prefix sums in
   one window group (partitioned by column, so columns run in parallel);
3. a column with more distinct values is cut into about equal-depth buckets by
   approximate quantiles (``Bucketizer``: binary search in the JVM); per-bucket
   totals (one row per bucket) give offsets on the driver, shipped back as a
   bounded broadcast table, and windows partitioned by bucket finish the sums.

Output: ``(column, value, cnt, below, below_distinct)``; average rank =
``below + (cnt + 1) / 2``, dense rank (0-based) = ``below_distinct``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.functions.expressions import col_

DEFAULT_GROUP_ROWS = 1_000_000
MAX_BUCKETS = 20_000


def _distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), col_(c).cast("double").alias("value")) for c in cols])
    return (df.select(F.inline(arr)).where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))


def _small_ranks(d: DataFrame) -> DataFrame:
    wc = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wr = Window.partitionBy("column").orderBy("value")
    return d.select("column", "value", "cnt", (F.sum("cnt").over(wc) - F.col("cnt")).alias("below"),
                    (F.row_number().over(wr) - 1).cast("bigint").alias("below_distinct"))


def _bucketed_ranks(d: DataFrame, col: str, nd: int, group_rows: int) -> DataFrame:
    spark = d.sparkSession
    n_buckets = min(MAX_BUCKETS, max(2, math.ceil(nd / group_rows)))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    one = d.where(F.col("column") == col)
    cuts = one.agg(F.percentile_approx("value", probs, 10 * n_buckets).alias("c")).first()["c"]
    splits = [-math.inf] + sorted(set(float(c) for c in cuts)) + [math.inf]
    b = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(one).withColumn(
        "bucket", F.col("bucket").cast("int"))
    totals = sorted((r["bucket"], int(r["rows"]), int(r["vals"])) for r in
                    b.groupBy("bucket").agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("vals")).collect())
    offs, acc_r, acc_v = [], 0, 0
    for bucket, rows, vals in totals:
        offs.append((bucket, acc_r, acc_v))
        acc_r += rows
        acc_v += vals
    off_df = spark.createDataFrame(offs, "bucket int, off_rows bigint, off_vals bigint")  # <= MAX_BUCKETS rows
    wb = Window.partitionBy("bucket").orderBy("value")
    wc = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (b.join(F.broadcast(off_df), "bucket")
            .select("column", "value", "cnt",
                    (F.col("off_rows") + F.sum("cnt").over(wc) - F.col("cnt")).alias("below"),
                    (F.col("off_vals") + F.row_number().over(wb) - 1).cast("bigint").alias("below_distinct")))


def column_ranks(df: DataFrame, cols: list[str], group_rows: int = DEFAULT_GROUP_ROWS,
                 cached: list | None = None) -> tuple[DataFrame, dict]:
    """Returns ``(ranks, n_distinct_by_column)`` for the non-null values of ``cols``.

    Persisted intermediates are appended to ``cached`` so the caller can release them.
    """
    d = _distinct_counts(df, cols).persist()  # read by the size check and by the rank windows
    if cached is not None:
        cached.append(d)
    nd = {r["column"]: int(r["n"]) for r in d.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c in cols if nd.get(c, 0) <= group_rows]
    big = [c for c in cols if nd.get(c, 0) > group_rows]
    parts = []
    if small:
        parts.append(_small_ranks(d.where(F.col("column").isin(small))))
    for c in big:
        parts.append(_bucketed_ranks(d, c, nd[c], group_rows))
    ranks = parts[0]
    for p in parts[1:]:
        ranks = ranks.unionByName(p)
    return ranks, nd


def value_ranks(df: DataFrame, col: str, group_rows: int = DEFAULT_GROUP_ROWS) -> tuple[DataFrame, int]:
    """Rank table of one column: ``(value, cnt, below, below_distinct)`` and its distinct count."""
    ranks, nd = column_ranks(df, [col], group_rows)
    return ranks.drop("column"), nd.get(col, 0)


def attach_ranks(df: DataFrame, cols: list[str], kind: str = "average", suffix: str = "__rank",
                 group_rows: int = DEFAULT_GROUP_ROWS, broadcast_limit: int = 100_000,
                 cached: list | None = None) -> DataFrame:
    """Add ``<col><suffix>`` rank columns (``average`` 1-based or ``dense`` 0-based).

    Kind ``below`` gives only ``<col>`` (rows below the value) and ``<col>__n`` (rows that share it) instead.

    The rank table is computed once for all columns (and persisted); each column
    joins back on its value: broadcast when its distinct count (just measured) is
    at most ``broadcast_limit``, else a shuffle join (AQE splits a skewed value).
    Persisted intermediates are appended to ``cached`` for the caller to release.
    """
    ranks, nd = column_ranks(df, cols, group_rows, cached)
    ranks = ranks.persist()
    if cached is not None:
        cached.append(ranks)
    r = (F.col("below") + (F.col("cnt") + 1) / 2.0) if kind == "average" else F.col("below_distinct")
    out = df
    for i, c in enumerate(cols):
        new = [F.col("below").alias(f"__b{i}"), F.col("cnt").alias(f"__n{i}")] if kind == "below" else [r.alias(f"{c}{suffix}")]
        rt = ranks.where(F.col("column") == c).select(F.col("value").alias("__v"), *new)
        rt = F.broadcast(rt) if nd.get(c, 0) <= broadcast_limit else rt
        out = out.join(rt, col_(c).cast("double") == F.col("__v"), "left").drop("__v")
    if kind == "below":
        out = out.select(*[x for i, c in enumerate(cols) for x in (F.col(f"__b{i}").alias(c), F.col(f"__n{i}").alias(f"{c}__n"))])
    return out
