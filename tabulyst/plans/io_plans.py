"""CSV lines and files: typed tables from lines, and tables written and read back (A-02, A-07)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulyst.plans.registry import register
from tabulyst.plans.tables import table
from tabulyst.session import checkpoint_dir
from tabulyst.sources.io import read_csv_rows, read_table, write_table

_CSV = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("csv_lines", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_lines(spark, sf_dir):
    """Customers as CSV lines, quoted where needed, back as a typed table."""
    rows = table(spark, sf_dir, "customer").select(F.to_csv(F.struct(*_CSV)).alias("line"))
    return read_csv_rows(spark, rows, header=_CSV)


@register("csv_types", """
SELECT 'c_custkey' AS "column", 'int' AS type, count(*) AS "rows" FROM customer UNION ALL SELECT 'c_name', 'string', count(*) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(*) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(*) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*) FROM customer""")
def csv_types(spark, sf_dir):
    """The types that the lattice gives the columns of the customers' CSV lines."""
    typed = csv_lines(spark, sf_dir)
    kinds = spark.createDataFrame(typed.dtypes, '`column` string, type string')  # one row per column
    return kinds.withColumn("rows", F.lit(typed.count()))


@register("write_read_back", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def write_read_back(spark, sf_dir):
    """Orders written as partitioned Parquet and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}.parquet"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    write_table(rows, path, partition_by=["o_orderpriority"])
    return read_table(spark, path)
