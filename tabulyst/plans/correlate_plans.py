"""Correlation queries (H-06, H-07, G-12, G-13, B-15, B-16, C-16, D-04)."""

from __future__ import annotations

from tabulyst.operators import correlate as COR
from tabulyst.plans.registry import register
from tabulyst.plans.tables import table, view, with_views

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]
TARGET_VIEW = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "target"]

STRENGTH = ("CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' "
            "WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END")
DIRECTION = "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END"


def _pairs(cols):
    return [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def _r_table(src: str, cols: list[str]) -> str:
    """``(a, b, seq, r)`` for every pair, Pearson over ``src``."""
    return "\nUNION ALL\n".join(
        f"SELECT '{cols[i]}' AS a, '{cols[j]}' AS b, {k} AS seq, "
        f"corr(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE)) AS r FROM {src}"
        for k, (i, j) in enumerate(_pairs(cols)))


def _pairs_sql(src: str, cols: list[str], pre: str = "") -> str:
    return (f"{pre}SELECT a AS feature_a, b AS feature_b, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation, "
            f"{STRENGTH} AS strength, {DIRECTION} AS direction FROM ({_r_table(src, cols)}) "
            f"WHERE r IS NOT NULL AND NOT isnan(r)")


@register("correlation_pairs", _pairs_sql("lineitem", LINEITEM_NUMERIC))
def correlation_pairs(spark, sf_dir):
    return COR.correlate(table(spark, sf_dir, "lineitem"), target="l_extendedprice").pairs


@register("correlation_target", f"""
WITH p AS ({_r_table('lineitem', LINEITEM_NUMERIC)}),
t AS (SELECT CASE WHEN a = 'l_extendedprice' THEN b ELSE a END AS feature, r, seq FROM p
      WHERE (a = 'l_extendedprice' OR b = 'l_extendedprice') AND r IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, seq) AS INTEGER) AS rank, feature, round(r, 4) AS correlation,
       {STRENGTH} AS strength, {DIRECTION} AS direction FROM t""")
def correlation_target(spark, sf_dir):
    return COR.correlate(table(spark, sf_dir, "lineitem"), target="l_extendedprice").target


@register("correlation_matrix", f"""
WITH p AS ({_r_table('lineitem', LINEITEM_NUMERIC)})
SELECT a AS feature_a, b AS feature_b, round(r, 4) AS correlation FROM p
UNION ALL SELECT b, a, round(r, 4) FROM p
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{c}', '{c}', 1.0)" for c in LINEITEM_NUMERIC)})""")
def correlation_matrix(spark, sf_dir):
    return COR.correlate(table(spark, sf_dir, "lineitem")).matrix


@register("correlation_summary", f"""
WITH p AS ({_r_table('lineitem', LINEITEM_NUMERIC)}),
q AS (SELECT a, b, seq, round(r, 4) AS c, round(abs(r), 4) AS ac FROM p WHERE r IS NOT NULL),
top AS (SELECT a, b, c FROM q ORDER BY ac DESC, seq LIMIT 1)
SELECT 'pearson' AS method, CAST({len(LINEITEM_NUMERIC)} AS BIGINT) AS columns_analyzed,
       CAST(count(*) AS BIGINT) AS total_pairs, round(avg(ac), 4) AS avg_abs_correlation,
       CAST(count(*) FILTER (WHERE ac >= 0.7) AS BIGINT) AS highly_correlated_count,
       (SELECT a FROM top) AS strongest_a, (SELECT b FROM top) AS strongest_b,
       (SELECT c FROM top) AS strongest_correlation
FROM q""")
def correlation_summary(spark, sf_dir):
    return COR.correlate(table(spark, sf_dir, "lineitem")).summary


@register("correlation_top_pairs")
def correlation_top_pairs(spark, sf_dir):
    """Top pairs with p-values (Student t tail has no SQL equivalent): rows-only."""
    return COR.correlate(table(spark, sf_dir, "lineitem"), top_n=10).top_pairs


def _rank_view(src: str, cols: list[str]) -> str:
    return ("ranked AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols)
        + f" FROM {src})")


@register("spearman_pairs", _pairs_sql("ranked", LINEITEM_NUMERIC,
                                       pre=f"WITH {_rank_view('lineitem', LINEITEM_NUMERIC)}\n"))
def spearman_pairs(spark, sf_dir):
    return COR.correlate(table(spark, sf_dir, "lineitem"), method="spearman").pairs


def _kendall_sql(src: str, cols: list[str]) -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(cols))
    parts = []
    for i, j in _pairs(cols):
        parts.append(
            f"SELECT '{cols[i]}' AS a, '{cols[j]}' AS b, "
            f"sum(sign(p.x{i} - q.x{i}) * sign(p.x{j} - q.x{j})) / "
            f"sqrt(sum(CASE WHEN p.x{i} <> q.x{i} THEN 1 ELSE 0 END) * sum(CASE WHEN p.x{j} <> q.x{j} THEN 1 ELSE 0 END))"
            f" AS r FROM t p JOIN t q ON p.id < q.id")
    return (f"WITH t AS (SELECT {sel}, row_number() OVER () AS id FROM {src}),\n"
            f"k AS ({' UNION ALL '.join(parts)})\n"
            f"SELECT a AS feature_a, b AS feature_b, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation, "
            f"{STRENGTH} AS strength, {DIRECTION} AS direction FROM k WHERE r IS NOT NULL")


@register("kendall_pairs", _kendall_sql("customer", CUSTOMER_NUMERIC))
def kendall_pairs(spark, sf_dir):
    """Exact tau-b against an O(n^2) self-join oracle (customer: 1,500 rows at sf0.01)."""
    return COR.correlate(table(spark, sf_dir, "customer"), method="kendall").pairs


def _kendall_steps_sql(src: str, pairs: list[tuple[str, str]]) -> str:
    """Tau-b of (x, y) with few distinct x: for any two of them, the rows of the one above and below each row of the other."""
    parts = []
    for k, (x, y) in enumerate(pairs):
        parts.append(f"""SELECT '{x}' AS a, '{y}' AS b, (SELECT (conc - disc) / sqrt((n0 - n1) * (n0 - n2)) FROM (
  WITH w AS (SELECT {x} AS x, {y} AS y, count(*) AS c FROM {src} GROUP BY ALL), v AS (SELECT DISTINCT x FROM w),
  pools AS (SELECT p.x AS v1, q.x AS v2 FROM v p JOIN v q ON p.x < q.x),
  pooled AS (SELECT v1, v2, y, sum(c1) AS c1, sum(c2) AS c2 FROM (SELECT v1, v2, y, c AS c1, 0 AS c2 FROM pools JOIN w ON x = v1
    UNION ALL SELECT v1, v2, y, 0, c FROM pools JOIN w ON x = v2) GROUP BY ALL),
  s AS (SELECT c1, c2, sum(c1) OVER (PARTITION BY v1, v2 ORDER BY y) AS upto, sum(c1) OVER (PARTITION BY v1, v2) AS total FROM pooled),
  t AS (SELECT sum(c2 * (upto - c1)) AS conc, sum(c2 * (total - upto)) AS disc FROM s),
  n AS (SELECT sum(c) * (sum(c) - 1) / 2.0 AS n0 FROM w), x1 AS (SELECT sum(c * (c - 1)) / 2.0 AS n1 FROM (SELECT sum(c) AS c FROM w GROUP BY x)),
  x2 AS (SELECT sum(c * (c - 1)) / 2.0 AS n2 FROM (SELECT sum(c) AS c FROM w GROUP BY y)) SELECT * FROM t, n, x1, x2)) AS r""")
    return (f"SELECT a AS feature_a, b AS feature_b, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation, "
            f"{STRENGTH} AS strength, {DIRECTION} AS direction FROM ({' UNION ALL '.join(parts)}) WHERE r IS NOT NULL")


KENDALL_LINEITEM = ["l_linenumber", "l_discount", "l_quantity", "l_extendedprice"]


@register("kendall_lineitem", _kendall_steps_sql("lineitem", [(KENDALL_LINEITEM[i], KENDALL_LINEITEM[j]) for i, j in _pairs(KENDALL_LINEITEM)]))
def kendall_lineitem(spark, sf_dir):
    """Exact tau-b of all lineitem rows."""
    return COR.correlate(table(spark, sf_dir, "lineitem").select(*KENDALL_LINEITEM), method="kendall").pairs


@register("multicollinear_pairs", with_views(f"""
WITH p AS ({_r_table('lineitem_target', TARGET_VIEW)}),
q AS (SELECT a, b, seq, r, round(abs(r), 4) AS ac FROM p WHERE r IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY ac DESC, seq) AS INTEGER) AS rank, a AS feature_a, b AS feature_b,
       round(r, 4) AS correlation, ac AS abs_correlation, {STRENGTH} AS strength, {DIRECTION} AS direction
FROM q QUALIFY ac >= 0.85""", "lineitem_target"))
def multicollinear_pairs(spark, sf_dir):
    return COR.correlate(view(spark, sf_dir, "lineitem_target")).multicollinear
