"""Cleaning queries (B-01..B-07, D-01, G-04, G-05)."""

from __future__ import annotations

from tabulyst.operators import clean as C
from tabulyst.plans.registry import register, rounded
from tabulyst.plans.tables import table, view, with_views

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
PART_TEXT = ["name", "brand", "ptype"]
PART_NUM = ["size", "price"]

_STRIPPED = with_views(f"""
WITH s AS (SELECT DISTINCT {', '.join(STRIP.format(c=c) + f' AS {c}' for c in PART_TEXT)}, size, price
           FROM part_dirty)
""".strip(), "part_dirty")


def _mode_cte(c: str) -> str:
    return (f"mode_{c} AS (SELECT {c} AS v FROM s WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


_CLEAN_SQL = _STRIPPED + ",\n" + ",\n".join(
    ["med AS (SELECT median(CAST(size AS DOUBLE)) AS size, median(price) AS price FROM s)"]
    + [_mode_cte(c) for c in PART_TEXT]) + "\nSELECT " + ", ".join(
    [f"coalesce(s.{c}, (SELECT v FROM mode_{c}), 'Unknown') AS {c}" for c in PART_TEXT]
    + [f"round(coalesce(CAST(s.{c} AS DOUBLE), (SELECT {c} FROM med)), 4) AS {c}" for c in PART_NUM]) + "\nFROM s"


@register("clean_rows", _CLEAN_SQL)
def clean_rows(spark, sf_dir):
    return rounded(C.clean(view(spark, sf_dir, "part_dirty")).cleaned)


_FILLED = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN sum(CAST({c} IS NULL AS BIGINT)) > 0 THEN "
    f"'''{c}'': ' || CAST(sum(CAST({c} IS NULL AS BIGINT)) AS VARCHAR) END" for c in PART_TEXT + PART_NUM) + ")"
_MISSING = " + ".join(f"sum(CAST({c} IS NULL AS BIGINT))" for c in ["name", "brand", "ptype", "size", "price"])
_REPORT_SQL = with_views(f"""
WITH s AS (SELECT DISTINCT {', '.join(STRIP.format(c=c) + f' AS {c}' for c in PART_TEXT)}, size, price
           FROM part_dirty),
n AS (SELECT (SELECT count(*) FROM part_dirty) AS before, (SELECT count(*) FROM s) AS after),
m AS (SELECT {_MISSING} AS total, '{{' || {_FILLED} || '}}' AS filled FROM s)
SELECT 1 AS seq, 'strip_whitespace' AS step,
       'Stripped whitespace from 3 text columns: [''name'', ''brand'', ''ptype'']' AS detail, CAST(3 AS BIGINT) AS count
UNION ALL
SELECT 2, 'drop_duplicates',
       CASE WHEN before > after THEN 'Removed ' || CAST(before - after AS VARCHAR) || ' duplicate rows'
            ELSE 'No duplicate rows found' END,
       CAST(before - after AS BIGINT) FROM n
UNION ALL
SELECT 3, 'fill_missing',
       CASE WHEN total > 0 THEN 'Filled ' || CAST(total AS VARCHAR) || ' missing values: ' || filled
            ELSE 'No missing values found' END, CAST(total AS BIGINT)
FROM m""", "part_dirty")


@register("clean_report", _REPORT_SQL)
def clean_report(spark, sf_dir):
    return C.clean(view(spark, sf_dir, "part_dirty")).report


@register("clean_summary", with_views(f"""
WITH s AS (SELECT DISTINCT {', '.join(STRIP.format(c=c) + f' AS {c}' for c in PART_TEXT)}, size, price
           FROM part_dirty)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM part_dirty) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
       (SELECT CAST(count(*) AS BIGINT) FROM part_dirty) - CAST(count(*) AS BIGINT) AS rows_removed,
       CAST(5 AS BIGINT) AS columns, CAST(100.0 AS DOUBLE) AS completeness
FROM s""", "part_dirty"))
def clean_summary(spark, sf_dir):
    return C.clean(view(spark, sf_dir, "part_dirty")).summary


def _outlier_sql() -> str:
    cols = ["event_id", "user_id", "value"]
    ctes = [f"s0 AS (SELECT DISTINCT event_id, ts, user_id, {STRIP.format(c='event_type')} AS event_type, value, "
            f"{STRIP.format(c='props')} AS props FROM events)"]
    for i, c in enumerate(cols, start=1):
        ctes.append(f"a{i} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM s{i - 1})")
        ctes.append(f"s{i} AS (SELECT s{i - 1}.* FROM s{i - 1}, a{i} "
                    f"WHERE coalesce(a{i}.s, 0) <= 0 OR abs(({c} - a{i}.m) / a{i}.s) <= 3.0)")
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM s{len(cols)}")


@register("outlier_filter", _outlier_sql())
def outlier_filter(spark, sf_dir):
    return rounded(C.clean(table(spark, sf_dir, "events"), remove_outliers=True).cleaned)


@register("outlier_filter_single_pass", f"""
WITH s0 AS (SELECT DISTINCT event_id, ts, user_id, {STRIP.format(c='event_type')} AS event_type, value,
                   {STRIP.format(c='props')} AS props FROM events),
a AS (SELECT avg(event_id) AS m1, stddev_samp(event_id) AS s1, avg(user_id) AS m2, stddev_samp(user_id) AS s2,
             avg(value) AS m3, stddev_samp(value) AS s3 FROM s0)
SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM s0, a
WHERE abs((event_id - m1) / s1) <= 3.0 AND abs((user_id - m2) / s2) <= 3.0 AND abs((value - m3) / s3) <= 3.0""")
def outlier_filter_single_pass(spark, sf_dir):
    res = C.clean(table(spark, sf_dir, "events"), remove_outliers=True, outlier_mode="single_pass")
    return rounded(res.cleaned)


@register("strip_whitespace", with_views(
    "SELECT " + ", ".join(STRIP.format(c=c) + f" AS {c}" for c in PART_TEXT) + ", size, round(price, 4) AS price "
    "FROM part_dirty", "part_dirty"))
def strip_whitespace(spark, sf_dir):
    return rounded(C.strip_whitespace(view(spark, sf_dir, "part_dirty")))
