"""Dashboard, chart suggestion, DDL and SQL queries (G-18..G-27, A-08, D-05, D-06, D-10)."""

from __future__ import annotations

from tabulyst.operators import charts as CH
from tabulyst.operators import sqltools as SQ
from tabulyst.plans.registry import register
from tabulyst.plans.tables import table

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# (l_orderkey, l_linenumber) repeats in the driver data; all columns give a total order
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER = ", ".join(LINE_KEY)
SQL_TYPES = ["INTEGER"] * 4 + ["FLOAT"] * 4 + ["VARCHAR(255)"] * 2 + ["DATE"]


@register("dashboard_kpi", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, CAST(count({c}) AS BIGINT) AS n FROM lineitem"
    for c in LINE_COLS[:4]))
def dashboard_kpi(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem"), order_by=LINE_KEY).kpi


@register("dashboard_category_share", """
SELECT 'l_returnflag' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS INTEGER) AS rank,
       l_returnflag AS value, CAST(count(*) AS BIGINT) AS count
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY rank LIMIT 8""")
def dashboard_category_share(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem")).category_share


@register("dashboard_trend", f"""
SELECT 'l_extendedprice' AS "column", CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS seq,
       round(l_extendedprice, 2) AS value
FROM lineitem WHERE l_extendedprice IS NOT NULL ORDER BY {ORDER} LIMIT 50""")
def dashboard_trend(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem"), target="l_extendedprice", order_by=LINE_KEY).trend


@register("dashboard_scatter", f"""
SELECT 'l_orderkey' AS x_column, 'l_partkey' AS y_column,
       CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS seq,
       round(CAST(l_orderkey AS DOUBLE), 2) AS x, round(CAST(l_partkey AS DOUBLE), 2) AS y
FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL ORDER BY {ORDER} LIMIT 100""")
def dashboard_scatter(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem"), order_by=LINE_KEY).scatter


@register("dashboard_preview", f"SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS seq, "
          + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in LINE_COLS[:8])
          + " FROM lineitem ORDER BY seq LIMIT 20")
def dashboard_preview(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem"), order_by=LINE_KEY).preview


@register("dashboard_info", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns, CAST(4 AS BIGINT) AS kpis_shown FROM lineitem""")
def dashboard_info(spark, sf_dir):
    return CH.dashboard_tables(table(spark, sf_dir, "lineitem")).info


@register("date_columns", """
SELECT column_name AS "column" FROM information_schema.columns
WHERE table_name = 'lineitem' AND data_type IN ('TIMESTAMP', 'DATE')""")
def date_columns(spark, sf_dir):
    return CH.date_columns_table(table(spark, sf_dir, "lineitem"))


_SUGGEST_SQL = """
WITH u AS (SELECT count(DISTINCT l_returnflag) AS n1, count(DISTINCT l_linestatus) AS n2 FROM lineitem),
s AS (
  SELECT 1 AS k, 1 AS rank, 'Line Chart' AS chart_type, 'l_shipdate' AS x_column, 'l_orderkey' AS y_column,
         '''l_shipdate'' is a date column — line chart shows trend over time for ''l_orderkey''.' AS rationale,
         'Trend analysis, time series visualization' AS use_case, 'high' AS priority
  UNION ALL SELECT 2, 1, 'Line Chart', 'l_shipdate', 'l_partkey',
         '''l_shipdate'' is a date column — line chart shows trend over time for ''l_partkey''.',
         'Trend analysis, time series visualization', 'high'
  UNION ALL SELECT 3, 2, 'Bar Chart', 'l_returnflag', 'l_orderkey',
         '''l_returnflag'' has ' || CAST(n1 AS VARCHAR) || ' categories — bar chart compares ''l_orderkey'' across groups.',
         'Category comparison, ranking', 'high' FROM u WHERE n1 <= 20
  UNION ALL SELECT 4, 2, 'Bar Chart', 'l_linestatus', 'l_orderkey',
         '''l_linestatus'' has ' || CAST(n2 AS VARCHAR) || ' categories — bar chart compares ''l_orderkey'' across groups.',
         'Category comparison, ranking', 'high' FROM u WHERE n2 <= 20
  UNION ALL SELECT 5, 3, 'Scatter Plot', 'l_orderkey', 'l_partkey',
         'Both columns are numeric — scatter reveals correlation between ''l_orderkey'' and ''l_partkey''.',
         'Correlation analysis, outlier detection', 'high'
  UNION ALL SELECT 6, 4, 'Histogram', 'l_orderkey', 'frequency',
         '''l_orderkey'' is numeric — histogram shows its distribution and skewness.',
         'Distribution analysis, outlier spotting', 'medium'
  UNION ALL SELECT 7, 4, 'Histogram', 'l_partkey', 'frequency',
         '''l_partkey'' is numeric — histogram shows its distribution and skewness.',
         'Distribution analysis, outlier spotting', 'medium'
  UNION ALL SELECT 8, 4, 'Histogram', 'l_suppkey', 'frequency',
         '''l_suppkey'' is numeric — histogram shows its distribution and skewness.',
         'Distribution analysis, outlier spotting', 'medium'
  UNION ALL SELECT 9, 5, 'Doughnut Chart', 'l_returnflag', 'count',
         '''l_returnflag'' has ' || CAST(n1 AS VARCHAR) || ' categories — doughnut shows proportional share.',
         'Part-to-whole relationships, market share', 'medium' FROM u WHERE n1 BETWEEN 2 AND 8
  UNION ALL SELECT 10, 5, 'Doughnut Chart', 'l_linestatus', 'count',
         '''l_linestatus'' has ' || CAST(n2 AS VARCHAR) || ' categories — doughnut shows proportional share.',
         'Part-to-whole relationships, market share', 'medium' FROM u WHERE n2 BETWEEN 2 AND 8
  UNION ALL SELECT 11, 6, 'Correlation Heatmap', 'all numeric columns', 'all numeric columns',
         'Dataset has 8 numeric columns — heatmap reveals all pairwise correlations at once.',
         'Feature selection, multicollinearity detection', 'medium'
  UNION ALL SELECT 12, 7, 'Box Plot', 'l_returnflag', 'l_orderkey',
         'Shows distribution spread and outliers of ''l_orderkey'' per ''l_returnflag'' group.',
         'Outlier detection, group distribution comparison', 'medium'
  UNION ALL SELECT 13, 8, 'Scatter Plot', 'l_orderkey', 'l_extendedprice',
         'Shows relationship between ''l_orderkey'' and your target ''l_extendedprice''. Useful for feature analysis.',
         'Feature vs target relationship, regression visualization', 'high'
  UNION ALL SELECT 14, 8, 'Scatter Plot', 'l_partkey', 'l_extendedprice',
         'Shows relationship between ''l_partkey'' and your target ''l_extendedprice''. Useful for feature analysis.',
         'Feature vs target relationship, regression visualization', 'high'
  UNION ALL SELECT 15, 8, 'Scatter Plot', 'l_suppkey', 'l_extendedprice',
         'Shows relationship between ''l_suppkey'' and your target ''l_extendedprice''. Useful for feature analysis.',
         'Feature vs target relationship, regression visualization', 'high'),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chart_type, x_column, y_column ORDER BY k) = 1)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, rank, chart_type, x_column, y_column, rationale,
       use_case, priority
FROM d ORDER BY k LIMIT 12"""


@register("suggest_charts", _SUGGEST_SQL)
def suggest_charts(spark, sf_dir):
    return CH.suggest_charts(table(spark, sf_dir, "lineitem"), target="l_extendedprice", max_suggestions=12).suggestions


def _ddl_cols_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(zip(LINE_COLS, SQL_TYPES)):
        parts.append(
            f"SELECT {i + 1} AS ordinal, '{c}' AS \"column\", '{t}' AS sql_type, "
            f"(SELECT string_agg(v, ', ' ORDER BY {ORDER}) FROM "
            f"(SELECT CAST({c} AS VARCHAR) AS v, {ORDER} FROM lineitem WHERE {c} IS NOT NULL "
            f"ORDER BY {ORDER} LIMIT 3)) AS samples")
    return "\nUNION ALL\n".join(parts)


@register("table_ddl", _ddl_cols_sql())
def table_ddl(spark, sf_dir):
    return SQ.table_ddl(table(spark, sf_dir, "lineitem"), "lineitem", order_by=LINE_KEY).columns


@register("table_ddl_text", f"""
WITH c AS ({_ddl_cols_sql()})
SELECT 'lineitem' AS name,
       'CREATE TABLE lineitem (' || chr(10) ||
       string_agg('  ' || "column" || ' ' || sql_type || '  -- e.g. [' || samples || ']', ',' || chr(10) ORDER BY ordinal)
       || chr(10) || ');' AS ddl
FROM c""")
def table_ddl_text(spark, sf_dir):
    return SQ.table_ddl(table(spark, sf_dir, "lineitem"), "lineitem", order_by=LINE_KEY).ddl


RUN_SQL = ("SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, "
           "round(avg(o_totalprice), 4) AS avg_price FROM {t} GROUP BY o_orderpriority")


@register("run_sql", RUN_SQL.format(t="orders"))
def run_sql(spark, sf_dir):
    return SQ.run_sql(spark, {"dataset": table(spark, sf_dir, "orders")}, RUN_SQL.format(t="dataset"))
