"""Profiling, quality and schema queries (G-01, G-02/03, A-04/08/09/10, C-01..C-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyst.operators import profile as P
from tabulyst.plans.registry import register, rounded, sql_round
from tabulyst.plans.tables import table, view, with_views
from tabulyst.sources import schema as S

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
PART_DIRTY = ["name", "brand", "ptype", "size", "price"]


def _stats_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", {sql_round(f'avg({x})')} AS mean, {sql_round(f'median({x})')} AS median, "
            f"{sql_round(f'stddev_samp({x})')} AS std, {sql_round(f'min({x}) + 0.0')} AS min, "
            f"{sql_round(f'max({x}) + 0.0')} AS max, CAST(count({c}) AS BIGINT) AS count FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@register("profile_statistics", _stats_sql("lineitem", LINEITEM_NUMERIC))
def profile_statistics(spark, sf_dir):
    return rounded(P.profile(table(spark, sf_dir, "lineitem"), "statistics").statistics)


@register("profile_shape", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns,
       CAST(8 AS BIGINT) AS numeric_columns, CAST(3 AS BIGINT) AS categorical_columns
FROM lineitem""")
def profile_shape(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "lineitem"), "quick").shape


_NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in PART_DIRTY)
_QUALITY_SQL = with_views(f"""
WITH g AS (SELECT {', '.join(PART_DIRTY)}, {_NULLS} AS nulls, count(*) AS c
           FROM part_dirty GROUP BY ALL),
s AS (SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
             CAST(sum(c * nulls) AS BIGINT) AS missing_values FROM g)
SELECT missing_values,
       {sql_round('missing_values / (rows * 5.0) * 100')} AS missing_percent,
       duplicate_rows,
       {sql_round('duplicate_rows / CAST(rows AS DOUBLE) * 100')} AS duplicate_percent,
       {sql_round('(1 - missing_values / (rows * 5.0)) * 100')} AS completeness
FROM s""", "part_dirty")


@register("profile_quality", _QUALITY_SQL)
def profile_quality(spark, sf_dir):
    return rounded(P.profile(view(spark, sf_dir, "part_dirty"), "quality").quality)


@register("missing_by_column", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS count, "
    f"{sql_round(f'(count(*) - count({c})) * 100.0 / count(*)')} AS percent FROM part_dirty "
    f"HAVING count(*) - count({c}) > 0" for c in PART_DIRTY), "part_dirty"))
def missing_by_column(spark, sf_dir):
    return rounded(P.missing_by_column(view(spark, sf_dir, "part_dirty")))


@register("duplicate_summary", """
WITH g AS (SELECT p_name, p_brand, p_type, count(*) AS c FROM part GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
       round(sum(c - 1) * 100.0 / sum(c), 4) AS duplicate_percent FROM g""")
def duplicate_summary(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    return rounded(P.duplicate_summary(part))


_TYPE_MAP = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' "
             "ELSE lower(data_type) END")


@register("column_roles", f"""
SELECT CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS "column", {_TYPE_MAP} AS type,
       CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT') THEN 'numeric'
            WHEN data_type = 'VARCHAR' THEN 'text'
            WHEN data_type IN ('TIMESTAMP', 'DATE') THEN 'date' ELSE 'other' END AS role
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def column_roles(spark, sf_dir):
    return S.column_roles(table(spark, sf_dir, "lineitem"))


@register("approx_size", """
SELECT CAST(sum(8 * 3 + 4 + 8 * 4 + strlen(l_returnflag) + strlen(l_linestatus) + 8) AS BIGINT) AS bytes,
       round(sum(8 * 3 + 4 + 8 * 4 + strlen(l_returnflag) + strlen(l_linestatus) + 8) / (1024.0 * 1024.0), 4)
         AS megabytes
FROM lineitem""")
def approx_size(spark, sf_dir):
    return S.approx_size(table(spark, sf_dir, "lineitem"))


def _colprofile_sql() -> str:
    types = {"name": "string", "brand": "string", "ptype": "string", "size": "int", "price": "double"}
    parts = []
    for i, c in enumerate(PART_DIRTY):
        num = types[c] != "string"
        x = f"CAST({c} AS DOUBLE)"
        stats = (f"{sql_round(f'avg({x})')}, {sql_round(f'stddev_samp({x})')}, {sql_round(f'min({x}) + 0.0')}, "
                 f"{sql_round(f'max({x}) + 0.0')}") if num else "NULL, NULL, NULL, NULL"
        uniq = f"count(DISTINCT {c})"
        parts.append(
            f"SELECT {i + 1} AS ordinal, '{c}' AS name, '{types[c]}' AS type, CAST(count({c}) AS BIGINT) AS non_null, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST({uniq} AS BIGINT) AS unique_values, "
            f"{stats} FROM part_dirty")
    body = "\nUNION ALL\n".join(parts)
    return with_views(
        f"SELECT ordinal, name, type, non_null, null_count, unique_values, "
        f"CAST(m AS DOUBLE) AS mean, CAST(s AS DOUBLE) AS std, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max "
        f"FROM ({body}) AS t(ordinal, name, type, non_null, null_count, unique_values, m, s, lo, hi)", "part_dirty")


@register("quality_report_columns", _colprofile_sql())
def quality_report_columns(spark, sf_dir):
    return rounded(P.column_profile(view(spark, sf_dir, "part_dirty")).withColumn("ordinal", F.col("ordinal").cast("int")))


@register("quality_grade", with_views(f"""
WITH m AS (SELECT (count(*) * 5 - ({' + '.join(f'count({c})' for c in PART_DIRTY)})) * 100.0 / (count(*) * 5) AS p
           FROM part_dirty)
SELECT CASE WHEN p < 5 THEN 'Excellent' WHEN p < 15 THEN 'Good' WHEN p < 30 THEN 'Fair' ELSE 'Poor' END AS assessment,
       round(p, 4) AS missing_percent, round(100 - p, 4) AS quality_score FROM m""", "part_dirty"))
def quality_grade(spark, sf_dir):
    return rounded(P.quality_report(view(spark, sf_dir, "part_dirty")).grade)


@register("quality_recommendations", with_views(f"""
WITH g AS (SELECT {', '.join(PART_DIRTY)}, count(*) AS c FROM part_dirty GROUP BY ALL),
q AS (SELECT (SELECT (count(*) * 5 - ({' + '.join(f'count({c})' for c in PART_DIRTY)})) * 100.0 / (count(*) * 5)
              FROM part_dirty) AS p,
             (SELECT sum(c - 1) FROM g) AS d),
r AS (SELECT 1 AS k, 'High missing data (' || printf('%.1f', p) || '%). Consider data imputation or removal.' AS text
      FROM q WHERE p > 10
      UNION ALL SELECT 2, 'Found ' || CAST(d AS VARCHAR) || ' duplicate rows. Remove before analysis.' FROM q WHERE d > 0)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, text FROM r
UNION ALL
SELECT 1, 'Dataset quality looks good. Ready for analysis.' WHERE NOT EXISTS (SELECT 1 FROM r)""", "part_dirty"))
def quality_recommendations(spark, sf_dir):
    return P.quality_report(view(spark, sf_dir, "part_dirty")).recommendations


@register("quality_summary", """
WITH g AS (SELECT p_name, p_brand, p_type, count(*) AS c FROM part GROUP BY ALL)
SELECT format('{:,} rows × 3 columns', sum(c)) AS dataset_size, CAST(0 AS BIGINT) AS numeric_columns,
       CAST(3 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS missing_values,
       CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
       round((SELECT sum(strlen(p_name) + strlen(p_brand) + strlen(p_type)) FROM part) / (1024.0 * 1024.0), 4) AS size_mb
FROM g""")
def quality_summary(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    return rounded(P.quality_report(part).summary)


@register("value_counts", """
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS INTEGER) AS rank,
       o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count
FROM orders GROUP BY o_orderpriority ORDER BY rank LIMIT 8""")
def value_counts(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority", 8)


@register("normalize_missing", with_views("""
SELECT 'l_quantity' AS "column", CAST(count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity)) AS BIGINT) AS count,
       round(count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity)) * 100.0 / count(*), 4) AS percent
FROM lineitem_gaps
UNION ALL
SELECT 'l_discount', CAST(count(*) - count(l_discount) AS BIGINT), round((count(*) - count(l_discount)) * 100.0 / count(*), 4)
FROM lineitem_gaps
UNION ALL
SELECT 'l_returnflag', CAST(count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag) IN ('NA', 'null')) AS BIGINT),
       round(count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag) IN ('NA', 'null')) * 100.0 / count(*), 4)
FROM lineitem_gaps""", "lineitem_gaps"))
def normalize_missing(spark, sf_dir):
    """NaN and NA-like text become gaps (A-03), then counted per column (C-02)."""
    df = S.normalize_missing(view(spark, sf_dir, "lineitem_gaps"), text=True)
    return rounded(P.missing_by_column(df))


@register("read_table_shape", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns,
       CAST(2 AS BIGINT) AS categorical_columns FROM customer""")
def read_table_shape(spark, sf_dir):
    """A-01 by path (format from the extension) and A-09."""
    from tabulyst.sources.io import read_table
    return S.table_shape(read_table(spark, f"{sf_dir.rstrip('/')}/customer.parquet"))
