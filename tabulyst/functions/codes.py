"""Codes 0, 1, 2, ... of a column's distinct values in order, as a table of any length.

The distinct values are range-partitioned and written with the number of their partition; inside
a partition a window numbers them, and the driver adds up one count per partition. No task and no
driver holds all values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.functions.expressions import col_
from tabulyst.session import checkpoint_dir

#: Rows up to which a counted code table is broadcast.
BROADCAST_CODES = 100_000


def value_codes(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(``value, code``, number of values): null has no code; NaN is the greatest value."""
    spark = df.sparkSession
    values = df.select(col_(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    path = f"{checkpoint_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    ranged = values.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)  # the partition of each value stays as written
    stored = spark.read.schema(ranged.schema).parquet(path)
    counts = stored.groupBy("part").count().orderBy("part").collect()  # one row per partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["part"], total))
        total += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    known = F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint"))
    return stored.withColumn("place", place).join(known, "part").select("value", (F.col("offset") + F.col("place")).alias("code")), total


def with_codes(df: DataFrame, column: Column, codes: DataFrame, n: int, out: str) -> DataFrame:
    """``df`` with the code of a value (null: none): a broadcast up to ``BROADCAST_CODES`` values, else a shuffle."""
    known = codes.select(F.col("value").alias("__value"), F.col("code").alias("__of_value"))
    joined = df.join(F.broadcast(known) if n <= BROADCAST_CODES else known, column == F.col("__value"), "left")
    return joined.withColumn(out, F.col("__of_value")).drop("__value", "__of_value")
