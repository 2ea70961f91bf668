"""Helpers shared by the corpus operators: shared folder, written tables, salted lookups.

Nothing here reads rows to the driver except single counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyst.session import checkpoint_dir

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: A word in Java's and DuckDB's pattern syntax.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows that a forced broadcast may hold; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a higher-order function an inlined expression would be computed for
    every element; as the only element of an array it is computed once.
    """
    return F.transform(F.array(value), use)[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) to the shared folder and read again.

    The files cut the lineage: a lost executor costs no recomputation, and every
    later read sees the same rows.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_key(rows: DataFrame, keys: Sequence[str], salt: Column, first: dict[str, Column], then: dict[str, Column],
            salts: int = 32) -> DataFrame:
    """``rows`` with per-key aggregates, without one task holding a hot key.

    ``first`` are the aggregates per (keys, salt), ``then`` those that combine
    them per key (they may use the names of ``first``). A key's rows are spread
    over ``salts`` sub-keys for both the aggregate and the join back.
    """
    keys = list(keys)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in first.items()])
    total = part.groupBy(*keys).agg(*[c.alias(n) for n, c in then.items()])
    lookup = part.select(*keys, "__salt").join(total, keys)
    return salted.join(lookup, [*keys, "__salt"]).drop("__salt")


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to hold at most ``rows`` rows, else as it is.

    ``df`` must be cheap to count (a written table). Both ways give equal joins.
    """
    return F.broadcast(df) if df.count() <= rows else df
