"""Loading the driver tables and the derived views shared by Spark and the SQL oracle.

The derived views are written once in a SQL subset that both Spark SQL and DuckDB
accept, so the Spark query and its oracle read exactly the same input. They add
gaps, padding and duplicates to the (clean) driver tables without dropping rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register driver tables as temp views (for ``spark.sql`` over the shared view SQL)."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# Derived views: name -> SQL over the driver tables (Spark SQL and DuckDB compatible).
VIEWS = {
    # part with padded/tabbed text, gaps in every column kind, and equal rows
    # (dropping the key leaves 211 equal rows at sf0.01; padding adds more after stripping)
    "part_dirty": """
        SELECT
          CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS name,
          CASE WHEN p_partkey % 11 = 0 THEN NULL
               WHEN p_partkey % 3 = 0 THEN concat('  ', p_brand, ' ')
               WHEN p_partkey % 5 = 0 THEN concat(p_brand, chr(9))
               ELSE p_brand END AS brand,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS ptype,
          CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size,
          CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(floor(p_retailprice / 100) AS DOUBLE) END AS price
        FROM part""",
    # first and second half of orders by date
    "orders_a": "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
    "orders_b": "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    # second half changed: prices up 20 %, one column dropped, one added, one type
    # changed, status gaps
    "orders_b_changed": """
        SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'PENDING'
                    ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice * 1.2 AS o_totalprice, o_orderdate,
               CASE WHEN o_orderkey % 4 = 0 THEN 'ONLINE' ELSE 'STORE' END AS o_channel
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    # daily event value per event type (a keyed daily series)
    "events_daily": """
        SELECT event_type AS series, CAST(ts AS DATE) AS ds, sum(value) AS y
        FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    # daily order revenue (one long series)
    "orders_daily": """
        SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    # labelled documents: numeric and text features for classification
    "doc_quality": """
        SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.toxic AS DOUBLE) AS toxic, d.lang,
               l.quality
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    # lineitem with a derived linear target (for model sanity: R^2 close to 1)
    "lineitem_target": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
               3 * l_quantity - 200 * l_discount AS target
        FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame (only the base tables it reads are registered).

    The driver tables hold ``timestamp_ntz``; Spark reads a ``TIMESTAMP '...'``
    literal in the session time zone, so literals become ``TIMESTAMP_NTZ`` here
    and the comparison does not depend on the session time zone.
    """
    sql = VIEWS[name]
    register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", sql)])
    return spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the derived views it reads, as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e1, e2, ..., label``: one numeric feature per dimension of the embedding, 10 classes."""
    rows = table(spark, sf_dir, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return rows.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(size)], "label")


VIEWS["lineitem_gaps"] = """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_partkey % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS l_quantity,
               CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_orderkey % 11 = 0 THEN 'NA' WHEN l_orderkey % 17 = 0 THEN 'null' ELSE l_returnflag END
                 AS l_returnflag
        FROM lineitem"""

# event values at the full hour: several rows per series and instant
VIEWS["events_hourly"] = """
        SELECT event_type AS series, date_trunc('hour', ts) AS ds, value AS y FROM events"""
