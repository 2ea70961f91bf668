"""The small tables behind a dashboard and chart suggestions.

"First N rows" in the reference means file order; here it is always an explicit
``order_by`` (top-N by ``orderBy(...).limit(n)`` is planned as a per-partition
top-N + merge, never a full sort). Without ``order_by`` a monotonically
increasing id stands in for file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.cells import cell_counts, nunique, top_values
from tabulyst.functions.expressions import blank_fill
from tabulyst.result import Tables
from tabulyst.sources.schema import is_date_type, normalize_missing, numeric_columns, text_columns

# Sizes of the dashboard pieces.
KPI_COLUMNS = 4
CATEGORY_TOP = 8
TREND_POINTS = 50
SCATTER_POINTS = 100
PREVIEW_COLUMNS = 8
PREVIEW_ROWS = 20


def _order(df: DataFrame, order_by: list[str] | None) -> list[Column]:
    if order_by:
        return [F.col(c).asc_nulls_last() for c in order_by]
    return [F.monotonically_increasing_id()]


def _first(df: DataFrame, n: int, order_by: list[str] | None) -> DataFrame:
    """First ``n`` rows in order, with a 1-based ``seq`` (the window sees at most n rows)."""
    if not order_by:
        df = df.withColumn("__pos", F.monotonically_increasing_id())
    order = _order(df, order_by) if order_by else [F.col("__pos")]
    head = df.orderBy(*order).limit(n)
    return head.withColumn("seq", F.row_number().over(Window.orderBy(*order))).drop("__pos")


def kpi(df: DataFrame) -> DataFrame:
    """``(column, mean, n)`` for the first four numeric columns (mean to 2 places)."""
    cols = numeric_columns(df)[:KPI_COLUMNS]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mean double, n bigint")
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(f"m{i}"), 2).alias("mean"),
                             F.col(f"n{i}").cast("bigint").alias("n")) for i, c in enumerate(cols)])
    return row.select(F.inline(arr))


def category_share(df: DataFrame) -> DataFrame:
    """``(column, rank, value, count)``: top-8 values of the first text column."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint")
    return top_values(cell_counts(df, texts[:1]), CATEGORY_TOP).select(
        "column", F.col("rank").cast("int").alias("rank"), "value", F.col("n").alias("count"))


def trend(df: DataFrame, target: str = "", order_by: list[str] | None = None) -> DataFrame:
    """``(column, seq, value)``: first 50 non-null values of the target (if numeric) or first numeric."""
    nums = numeric_columns(df)
    if not nums:
        return df.sparkSession.createDataFrame([], "column string, seq int, value double")
    col = target if target in nums else nums[0]
    keep = [col] + [c for c in (order_by or []) if c != col]
    head = _first(df.select(*keep).where(F.col(col).isNotNull()), TREND_POINTS, order_by)
    return head.select(F.lit(col).alias("column"), F.col("seq").cast("int").alias("seq"),
                       F.round(F.col(col).cast("double"), 2).alias("value"))


def scatter(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``(x_column, y_column, seq, x, y)``: first 100 complete pairs of the first two numeric columns."""
    nums = numeric_columns(df)
    if len(nums) < 2:
        return df.sparkSession.createDataFrame([], "x_column string, y_column string, seq int, x double, y double")
    x, y = nums[0], nums[1]
    keep = [x, y] + [c for c in (order_by or []) if c not in (x, y)]
    head = _first(df.select(*keep).dropna(subset=[x, y]), SCATTER_POINTS, order_by)
    return head.select(F.lit(x).alias("x_column"), F.lit(y).alias("y_column"), F.col("seq").cast("int").alias("seq"),
                       F.round(F.col(x).cast("double"), 2).alias("x"), F.round(F.col(y).cast("double"), 2).alias("y"))


def preview(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """First 20 rows of the first 8 columns, rendered as text with gaps blank, plus ``seq``."""
    cols = df.columns[:PREVIEW_COLUMNS]
    keep = cols + [c for c in (order_by or []) if c not in cols]
    head = _first(df.select(*keep), PREVIEW_ROWS, order_by)
    return head.select(F.col("seq").cast("int").alias("seq"), *[blank_fill(c).alias(c) for c in cols])


def dashboard_tables(df: DataFrame, target: str = "", order_by: list[str] | None = None) -> Tables:
    """Data behind the dashboard: ``kpi``, ``category_share``, ``trend``, ``scatter``, ``preview``, ``info``."""
    df = normalize_missing(df)
    info = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(min(KPI_COLUMNS, len(numeric_columns(df)))).cast("bigint").alias("kpis_shown"))
    return Tables(kpi=kpi(df), category_share=category_share(df), trend=trend(df, target, order_by),
                  scatter=scatter(df, order_by), preview=preview(df, order_by), info=info)


def date_columns(df: DataFrame) -> list[str]:
    """Date/timestamp typed columns, plus text columns all of whose values parse (one aggregate)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parsed = df.agg(F.lit(0).alias("none"), *[
        F.min(F.when(F.col(f"`{c}`").isNotNull(), F.try_to_timestamp(F.col(f"`{c}`")).isNotNull().cast("int"))).alias(f"c{i}")
        for i, c in enumerate(texts)]).first()
    dates = {c for i, c in enumerate(texts) if parsed[f"c{i}"] == 1}
    out = []
    for f in df.schema.fields:
        if is_date_type(f.dataType):
            out.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            if f.name in dates:
                out.append(f.name)
    return out


def date_columns_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in date_columns(df)], "column string")


# What each chart is for, the roles and category counts it needs, and its texts.
# ``x``/``y`` name a role and how many of its columns are tried; a quoted text is used as it is. ``target`` is the
# caller's target column. ``needs`` is a condition on the columns of the joined rows. ``{x}``, ``{y}``, ``{k}`` (values of x) and ``{n}`` (numeric columns) fill the rationale.
CHART_RULES = """
rank | chart_type | x | y | needs | rationale | use_case | priority
1 | Line Chart | date 2 | numeric 2 | | '{x}' is a date column — line chart shows trend over time for '{y}'. | Trend analysis, time series visualization | high
2 | Bar Chart | category 2 | numeric 1 | k <= 20 | '{x}' has {k} categories — bar chart compares '{y}' across groups. | Category comparison, ranking | high
3 | Scatter Plot | numeric 1 | numeric 2 | y_place = x_place + 1 | Both columns are numeric — scatter reveals correlation between '{x}' and '{y}'. | Correlation analysis, outlier detection | high
4 | Histogram | numeric 3 | "frequency" | | '{x}' is numeric — histogram shows its distribution and skewness. | Distribution analysis, outlier spotting | medium
5 | Doughnut Chart | category 2 | "count" | k between 2 and 8 | '{x}' has {k} categories — doughnut shows proportional share. | Part-to-whole relationships, market share | medium
6 | Correlation Heatmap | "all numeric columns" | "all numeric columns" | n >= 3 | Dataset has {n} numeric columns — heatmap reveals all pairwise correlations at once. | Feature selection, multicollinearity detection | medium
7 | Box Plot | category 1 | numeric 1 | | Shows distribution spread and outliers of '{y}' per '{x}' group. | Outlier detection, group distribution comparison | medium
8 | Scatter Plot | numeric 3 | target 1 | x_column <> y_column | Shows relationship between '{x}' and your target '{y}'. Useful for feature analysis. | Feature vs target relationship, regression visualization | high
"""


def _chart_rules(spark) -> DataFrame:
    """The rule table, one row per chart, with the sides split into role and number of columns."""
    head, *lines = [[cell.strip() for cell in line.split("|")] for line in CHART_RULES.strip().splitlines()]
    rules = spark.createDataFrame([tuple(line) for line in lines], ", ".join(f"{c} string" for c in head))
    for side in ("x", "y"):
        quoted = F.col(side).startswith('"')
        rules = rules.withColumns({
            f"{side}_text": F.when(quoted, F.trim(F.col(side), F.lit('"'))),
            f"{side}_role": F.when(quoted, F.lit("text")).otherwise(F.split_part(F.col(side), F.lit(" "), F.lit(1))),
            f"{side}_most": F.when(quoted, F.lit(1)).otherwise(F.try_element_at(F.split(F.col(side), " "), F.lit(2)).cast("int"))})
    return rules.withColumn("rank", F.col("rank").cast("int"))


def column_roles_profile(df: DataFrame, target: str = "") -> DataFrame:
    """``(role, column, ordinal, k)``: columns by chart role in order; ``k`` counts a category's values."""
    dates = date_columns(df)
    categories = [c for c in text_columns(df) if c not in dates]
    numbers = numeric_columns(df)
    roles = {"numeric": numbers, "category": categories, "date": dates, "target": [c for c in numbers if c == target], "text": [""]}
    listed = [(role, c, i) for role, names in roles.items() for i, c in enumerate(names, 1)]
    profile = df.sparkSession.createDataFrame(listed, "role string, column string, ordinal int")
    if not categories:
        return profile.withColumn("k", F.lit(0).cast("bigint"))
    tried = categories[:2]  # the rules try no more
    counts = nunique(cell_counts(df, tried)).select(F.lit("category").alias("role"), "column", F.col("unique_values").cast("bigint").alias("k"))
    return profile.join(F.broadcast(counts), ["role", "column"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("bigint")))


def suggest_charts(df: DataFrame, target: str = "", max_suggestions: int = 8) -> Tables:
    """Ranked chart suggestions from column roles; ``suggestions`` and ``profile`` tables.

    The rule table is joined with the column profile on both sides' roles; conditions and texts are
    evaluated on the joined rows. Of equal (chart, x, y) the first stays.
    """
    profile = column_roles_profile(df, target)
    numbers = len(numeric_columns(df))
    conditions = {line.split("|")[4].strip() for line in CHART_RULES.strip().splitlines()[1:]} - {""}
    met = F.col("needs") == ""
    for condition in sorted(conditions):
        met = met | ((F.col("needs") == condition) & F.expr(condition))
    x, y = profile.alias("x"), profile.alias("y")
    pairs = (_chart_rules(df.sparkSession)
             .join(x, (F.col("x_role") == F.col("x.role")) & (F.col("x.ordinal") <= F.col("x_most")))
             .join(y, (F.col("y_role") == F.col("y.role")) & (F.col("y.ordinal") <= F.col("y_most")))
             .select("rank", "chart_type", "needs", "rationale", "use_case", "priority",
                     F.coalesce("x_text", F.col("x.column")).alias("x_column"), F.coalesce("y_text", F.col("y.column")).alias("y_column"),
                     F.col("x.ordinal").alias("x_place"), F.col("y.ordinal").alias("y_place"), F.col("x.k").alias("k"), F.lit(numbers).alias("n"))
             .where(met))
    names = {"x": "x_column", "y": "y_column", "k": "k", "n": "n"}
    pieces = F.split("rationale", r"[{}]")  # text and names in turn
    filled = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(
        F.coalesce(*[F.when(p == name, F.col(c).cast("string")) for name, c in names.items()]))), "")
    found = pairs.withColumn("rationale", filled).withColumn("place", F.struct("rank", "x_place", "y_place"))
    first = found.groupBy("chart_type", "x_column", "y_column").agg(
        F.min_by(F.struct("rank", "rationale", "use_case", "priority", "place"), "place").alias("row"))
    # a few rows whatever the table: rules times the columns that they try
    position = F.row_number().over(Window.orderBy("row.place")).cast("int")
    suggestions = (first.select(position.alias("position"), "row.rank", "chart_type", "x_column", "y_column",
                                "row.rationale", "row.use_case", "row.priority")
                   .where(F.col("position") <= max_suggestions))
    shown = profile.where(F.col("role").isin("numeric", "category", "date")).select(
        F.when(F.col("role") == "category", F.lit("categorical")).otherwise(F.col("role")).alias("role"), "column")
    return Tables(suggestions=suggestions, profile=shown)
