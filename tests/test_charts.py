"""Dashboard tables, chart suggestions, DDL and SQL over tables."""

from __future__ import annotations

from tabulyst.operators import charts as CH
from tabulyst.operators import sqltools as SQ


def test_suggestions_on_shop(shop):
    res = CH.suggest_charts(shop, target="sales", max_suggestions=20)
    rows = res.suggestions.orderBy("position").collect()
    kinds = [(r["chart_type"], r["x_column"], r["y_column"]) for r in rows]
    # the text date column is detected as a date: line charts first
    assert kinds[0] == ("Line Chart", "date", "sales") and kinds[1] == ("Line Chart", "date", "marketing_spend")
    assert ("Correlation Heatmap", "all numeric columns", "all numeric columns") in kinds
    # (sales, marketing_spend) scatter from rule 3 is not repeated by the target rule
    assert kinds.count(("Scatter Plot", "sales", "marketing_spend")) == 1
    assert ("Scatter Plot", "marketing_spend", "sales") in kinds
    assert len(kinds) == len(set(kinds))
    assert {r["role"] for r in res.profile.collect()} == {"numeric", "date"}
    assert CH.suggest_charts(shop, max_suggestions=3).suggestions.count() == 3


def test_dashboard_tables(dirty):
    res = CH.dashboard_tables(dirty, target="y", order_by=["id", "name"])
    kpi = {r["column"]: r for r in res.kpi.collect()}
    assert set(kpi) == {"id", "x", "y"} and kpi["x"]["n"] == 10
    share = res.category_share.orderBy("rank").collect()
    assert share[0]["value"] == "  alice " and share[0]["count"] == 2  # raw text; (count desc, value asc)
    trend = res.trend.orderBy("seq").collect()
    assert [r["value"] for r in trend][:3] == [10.0, 20.0, 30.0] and len(trend) == 11
    assert res.scatter.count() == 10
    prev = res.preview.orderBy("seq").collect()
    assert len(prev) == 12 and prev[3]["name"] == "" and prev[0]["id"] == "1"


def test_ddl_and_sql(spark, shop):
    res = SQ.table_ddl(shop, "shop", order_by=["date"])
    cols = {r["column"]: r for r in res.columns.collect()}
    assert cols["sales"]["sql_type"] == "INTEGER" and cols["conversion_rate"]["sql_type"] == "FLOAT"
    assert cols["date"]["samples"] == "2024-01-01, 2024-01-02, 2024-01-03"
    ddl = res.ddl.first()["ddl"]
    assert ddl.startswith("CREATE TABLE shop (\n  date VARCHAR(255)") and ddl.endswith("\n);")
    out = SQ.run_sql(spark, {"shop": shop}, "SELECT count(*) AS n, max(sales) AS m FROM shop").first()
    assert out["n"] == 25
