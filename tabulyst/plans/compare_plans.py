"""Comparison queries (E-01..E-06, G-09, G-10): two halves of ``orders``.

``orders_a`` vs ``orders_b_changed`` (prices +20 %, a column dropped/added, a type
changed, status gaps and a renamed status) and ``orders_a`` vs ``orders_b``.
"""

from __future__ import annotations

from tabulyst.operators import compare as CMP
from tabulyst.plans.registry import register
from tabulyst.plans.tables import view, with_views

NUM_COMMON = ["o_custkey", "o_orderkey", "o_totalprice"]
ALL_COMMON_CHANGED = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"]


def _pair(spark, sf_dir, second="orders_b_changed"):
    return view(spark, sf_dir, "orders_a"), view(spark, sf_dir, second)


def _side_sql(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, avg(CAST({c} AS DOUBLE)) AS mean, median(CAST({c} AS DOUBLE)) AS median, "
        f"stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx, "
        f"count(*) - count({c}) AS missing FROM {tbl}" for c in cols)


def _stats_sql(second: str) -> str:
    body = f"""
WITH sa AS ({_side_sql('orders_a', NUM_COMMON)}),
sb AS ({_side_sql(second, NUM_COMMON)}),
j AS (SELECT sa.col, sa.mean AS m1, sa.median AS d1, sa.std AS s1, sa.mn AS lo1, sa.mx AS hi1, sa.missing AS x1,
             sb.mean AS m2, sb.median AS d2, sb.std AS s2, sb.mn AS lo2, sb.mx AS hi2, sb.missing AS x2,
             round(sb.mean - sa.mean, 4) AS chg
      FROM sa JOIN sb ON sa.col = sb.col),
k AS (SELECT *, CASE WHEN m1 <> 0 THEN round(chg / m1 * 100, 2) END AS pct FROM j)
SELECT col AS "column", round(m1, 4) AS mean_1, round(d1, 4) AS median_1, round(s1, 4) AS std_1,
       round(lo1, 4) AS min_1, round(hi1, 4) AS max_1, CAST(x1 AS BIGINT) AS missing_1,
       round(m2, 4) AS mean_2, round(d2, 4) AS median_2, round(s2, 4) AS std_2,
       round(lo2, 4) AS min_2, round(hi2, 4) AS max_2, CAST(x2 AS BIGINT) AS missing_2,
       chg AS mean_change, pct AS mean_change_pct,
       CASE WHEN abs(coalesce(pct, 0)) > 10 THEN 'significant' ELSE 'minor' END AS distribution_shift
FROM k"""
    return with_views(body, "orders_a", second)


@register("compare_stats", _stats_sql("orders_b_changed"))
def compare_stats(spark, sf_dir):
    return CMP.stats_diff(*_pair(spark, sf_dir))


@register("compare_stats_similar", _stats_sql("orders_b"))
def compare_stats_similar(spark, sf_dir):
    return CMP.stats_diff(*_pair(spark, sf_dir, "orders_b"))


@register("compare_shape", with_views("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders_a) AS rows_1, CAST(6 AS BIGINT) AS columns_1,
       (SELECT CAST(count(*) AS BIGINT) FROM orders_b_changed) AS rows_2, CAST(6 AS BIGINT) AS columns_2,
       (SELECT count(*) FROM orders_b_changed) - (SELECT count(*) FROM orders_a) AS row_diff,
       CAST(0 AS BIGINT) AS col_diff""", "orders_a", "orders_b_changed"))
def compare_shape(spark, sf_dir):
    return CMP.shape_diff(*_pair(spark, sf_dir))


@register("compare_schema", """
SELECT * FROM (VALUES
  ('o_channel', 'only_in_2', NULL, 'string', false),
  ('o_custkey', 'common', 'bigint', 'bigint', false),
  ('o_orderdate', 'common', 'timestamp_ntz', 'timestamp_ntz', false),
  ('o_orderkey', 'common', 'bigint', 'double', true),
  ('o_orderpriority', 'only_in_1', 'string', NULL, false),
  ('o_orderstatus', 'common', 'string', 'string', false),
  ('o_totalprice', 'common', 'double', 'double', false)
) AS t("column", status, type_1, type_2, type_changed)""")
def compare_schema(spark, sf_dir):
    return CMP.schema_diff(*_pair(spark, sf_dir))


@register("compare_categories", with_views("""
WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders_a WHERE o_orderstatus IS NOT NULL),
b AS (SELECT DISTINCT o_orderstatus AS v FROM orders_b_changed WHERE o_orderstatus IS NOT NULL)
SELECT 'o_orderstatus' AS "column",
       (SELECT CAST(count(*) AS BIGINT) FROM a) AS unique_values_1, (SELECT CAST(count(*) AS BIGINT) FROM b) AS unique_values_2,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT v FROM b EXCEPT SELECT v FROM a)) AS new_values,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT v FROM a EXCEPT SELECT v FROM b)) AS removed_values,
       (SELECT o_orderstatus FROM orders_a WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
         AS top_value_1,
       (SELECT o_orderstatus FROM orders_b_changed WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1
        LIMIT 1) AS top_value_2""", "orders_a", "orders_b_changed"))
def compare_categories(spark, sf_dir):
    return CMP.category_summary(*_pair(spark, sf_dir))


@register("compare_category_changes", with_views("""
WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders_a WHERE o_orderstatus IS NOT NULL),
b AS (SELECT DISTINCT o_orderstatus AS v FROM orders_b_changed WHERE o_orderstatus IS NOT NULL)
SELECT 'o_orderstatus' AS "column", 'new_in_2' AS change, v AS value FROM (SELECT v FROM b EXCEPT SELECT v FROM a)
UNION ALL
SELECT 'o_orderstatus', 'removed_from_1', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b)""",
                                                  "orders_a", "orders_b_changed"))
def compare_category_changes(spark, sf_dir):
    return CMP.category_diff(*_pair(spark, sf_dir))


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS col, (SELECT count(*) - count({c}) FROM orders_a) AS m1, "
             f"(SELECT count(*) - count({c}) FROM orders_b_changed) AS m2" for c in ALL_COMMON_CHANGED]
    body = ("SELECT col AS \"column\", CAST(m1 AS BIGINT) AS missing_1, CAST(m2 AS BIGINT) AS missing_2, "
            "CAST(m2 - m1 AS BIGINT) AS change FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE m1 <> m2")
    return with_views(body, "orders_a", "orders_b_changed")


@register("compare_missing", _missing_sql())
def compare_missing(spark, sf_dir):
    return CMP.missing_diff(*_pair(spark, sf_dir))


@register("compare_keys", with_views("""
WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders_a),
b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders_b)
SELECT 'only_in_1' AS side, k AS key FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL
SELECT 'only_in_2', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""", "orders_a", "orders_b"))
def compare_keys(spark, sf_dir):
    return CMP.key_diff(*_pair(spark, sf_dir, "orders_b"), "o_custkey")


@register("compare_key_summary", with_views("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders_a),
b AS (SELECT DISTINCT o_custkey AS k FROM orders_b)
SELECT 'o_custkey' AS match_column,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS rows_only_in_1,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS rows_only_in_2,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS common_rows""",
                                             "orders_a", "orders_b"))
def compare_key_summary(spark, sf_dir):
    return CMP.key_summary(*_pair(spark, sf_dir, "orders_b"), "o_custkey")


def _summary_sql(second: str, schema_only: int, type_changes: int) -> str:
    stats = _stats_sql(second)
    head, _, _ = stats.rpartition("SELECT col AS \"column\"")
    return head.rstrip() + f""",
s AS (SELECT col, CASE WHEN abs(coalesce(pct, 0)) > 10 THEN 1 ELSE 0 END AS sig FROM k),
t AS (SELECT sum(sig) AS shifts, string_agg(CASE WHEN sig = 1 THEN col END, ', ' ORDER BY col) AS cols FROM s)
SELECT CASE WHEN shifts = 0 AND {schema_only} = 0 THEN 'high' WHEN shifts <= 2 THEN 'moderate' ELSE 'low' END
         AS overall_similarity,
       {schema_only + type_changes} > 0 AS schema_changed, CAST(shifts AS BIGINT) AS significant_shifts,
       coalesce(cols, '') AS shifted_columns,
       CASE WHEN shifts = 0 THEN 'Datasets look very similar — minor differences only.'
            ELSE 'Notable distribution shifts in: ' || cols || '. Investigate before merging.' END AS recommendation
FROM t"""


@register("compare_summary", _summary_sql("orders_b_changed", 2, 1))
def compare_summary(spark, sf_dir):
    return CMP.compare(*_pair(spark, sf_dir)).summary


@register("compare_summary_similar", _summary_sql("orders_b", 0, 0))
def compare_summary_similar(spark, sf_dir):
    return CMP.compare(*_pair(spark, sf_dir, "orders_b")).summary
