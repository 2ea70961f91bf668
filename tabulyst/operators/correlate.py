"""Correlation analysis: Pearson, Spearman and Kendall tau-b, with significance.

* Gaps are filled with exact column medians first (literals in the plan).
* Pearson: every pair in ONE aggregate (``corr`` is partially aggregated per map
  task); beyond ``MAX_PAIR_COLUMNS`` columns the covariance comes from
  ``pyspark.ml.stat.Correlation`` on an assembled vector.
* Spearman: Pearson on average ranks (``functions.ranking``: no global window), which reach the rows by one join
  of all columns' cells.
* Kendall tau-b: exact, by distributed inversion counting (``kendall_pairs``).
* p-values for the top pairs: Student t tail, vectorised pandas UDF over the
  small pair table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.functions.expressions import MULTICOLLINEAR, SIGNIFICANCE, STRONG_PAIR, col_, direction, strength
from tabulyst.functions.inversions import discordant
from tabulyst.functions.pvalues import p_value
from tabulyst.functions.quantiles import medians
from tabulyst.functions.ranking import attach_ranks, column_ranks
from tabulyst.result import Tables
from tabulyst.session import ship_package
from tabulyst.sources.schema import normalize_missing, numeric_columns

METHODS = ("pearson", "spearman", "kendall")
MAX_PAIR_COLUMNS = 60
KENDALL_BROADCAST = 1_000_000  # distinct values whose ranks are broadcast, about 100 MB


def median_filled(df: DataFrame, cols: list[str], with_means: bool = False, **qkw):
    """Numeric columns as doubles with gaps set to the column median.

    With ``with_means`` also returns the column means (of the present values, from
    the same aggregate that counts the gaps) for use as numerical shifts.
    """
    df = normalize_missing(df.select(*[col_(c) for c in cols]))
    row = df.agg(*[F.count_if(col_(c).isNull()).alias(f"g{i}") for i, c in enumerate(cols)],
                 *[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    need = [c for i, c in enumerate(cols) if row[f"g{i}"]]
    meds = medians(df, need, **qkw) if need else {}
    out = df.select(*[F.coalesce(col_(c).cast("double"), F.lit(meds.get(c)).cast("double")).alias(c)
                      if c in meds else col_(c).cast("double").alias(c) for c in cols])
    if with_means:
        return out, {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return out


def _pearson_values(df: DataFrame, cols: list[str], shifts: dict[str, float] | None = None
                    ) -> dict[tuple[str, str], float | None]:
    """Pearson r for every pair from ONE aggregate of plain sums.

    With u = x - s_x (s_x near the mean keeps the sums well conditioned):
    ``r = (n Suv - Su Sv) / sqrt((n Suu - Su^2)(n Svv - Sv^2))``; k + k + k(k-1)/2
    sums, all partially aggregated per map task and kept in generated code.
    """
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    if k > MAX_PAIR_COLUMNS:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation
        plain = [f"f{i}" for i in range(k)]  # the assembler splits names at dots
        vec = VectorAssembler(inputCols=plain, outputCol="__v").transform(df.select(*[col_(c).alias(p) for p, c in zip(plain, cols)])).select("__v")
        m = Correlation.corr(vec, "__v", "pearson").first()[0].toArray()  # k x k, bounded by columns
        vals = {(cols[i], cols[j]): float(m[i, j]) for i, j in pairs}
        return {p: (None if v is None or math.isnan(v) else float(v)) for p, v in vals.items()}
    if shifts is None:
        row = df.agg(*[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        shifts = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(cols)}
    u = [col_(c).cast("double") - F.lit(float(shifts.get(c) or 0.0)) for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(u[i]).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(u[i] * u[i]).alias(f"q{i}") for i in range(k)]
    aggs += [F.sum(u[i] * u[j]).alias(f"p{i}_{j}") for i, j in pairs]
    row = df.agg(*aggs).first()
    n = row["n"]
    out: dict[tuple[str, str], float | None] = {}
    for i, j in pairs:
        si, sj = row[f"s{i}"], row[f"s{j}"]
        if si is None or sj is None or row[f"p{i}_{j}"] is None:  # a column without values
            out[(cols[i], cols[j])] = None
            continue
        vi = n * row[f"q{i}"] - si * si
        vj = n * row[f"q{j}"] - sj * sj
        cov = n * row[f"p{i}_{j}"] - si * sj
        if n is None or n < 2 or vi <= 0 or vj <= 0:
            out[(cols[i], cols[j])] = None
        else:
            out[(cols[i], cols[j])] = max(-1.0, min(1.0, cov / math.sqrt(vi * vj)))
    return out


def spearman_values(df: DataFrame, cols: list[str], cached: list | None = None, broadcast_rows: int = 100_000, n: int | None = None) -> dict[tuple[str, str], float | None]:
    """Spearman's rho for every pair of gap-free columns: Pearson sums of average ranks.

    A row is known by a 128-bit fingerprint, so equal rows count as one with a weight. The cells form one long table (row, column, value), which
    takes the ranks by a join on (column, value) - one broadcast join for all columns of few values, one shuffled join for all
    others - and goes back to one row of ranks per distinct row.
    """
    k, n_key = len(cols), ["__i", "__j"]
    values = [col_(c).cast("double") for c in cols]
    rows = df.select(F.xxhash64(F.lit(1), *values).alias("__i"), F.xxhash64(F.lit(2), *values).alias("__j"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    plain = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    ranks, nd = column_ranks(plain, [f"v{i}" for i in range(k)], cached=cached)
    ranks = ranks.select("column", "value", (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("rank"))
    # columns of few values take the broadcast part of the table, the others its shuffled part
    few: list[int] = []
    for i in sorted(range(k), key=lambda i: nd.get(f"v{i}", 0)):
        if sum(nd.get(f"v{j}", 0) for j in [*few, i]) <= broadcast_rows:
            few.append(i)
    found = None
    for some in (few, [i for i in range(k) if i not in few]):
        if some:
            cells = rows.select(*n_key, F.inline(F.array(*[F.struct(F.lit(f"v{i}").alias("column"), F.col(f"v{i}").alias("value")) for i in some])))
            known = ranks.where(F.col("column").isin([f"v{i}" for i in some]))
            part = cells.join(F.broadcast(known) if some is few else known, ["column", "value"]).select(*n_key, "column", "rank")
            found = part if found is None else found.unionByName(part)
    wide = found.groupBy(*n_key).agg(
        F.count_if(F.col("column") == "v0").alias("c"), *[F.max(F.when(F.col("column") == f"v{i}", F.col("rank"))).alias(f"r{i}") for i in range(k)])
    # ranks of n values have the mean (n + 1) / 2
    n = df.count() if n is None else n
    u = [F.col(f"r{i}") - F.lit((n + 1) / 2.0) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = wide.agg(*[F.sum(F.col("c") * u[i] * u[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out: dict[tuple[str, str], float | None] = {}
    for i, j in pairs:
        if i < j:
            both = (row[f"p{i}_{i}"] or 0.0) * (row[f"p{j}_{j}"] or 0.0)
            out[(cols[i], cols[j])] = max(-1.0, min(1.0, row[f"p{i}_{j}"] / math.sqrt(both))) if n > 1 and both > 0 else None
    return out


def kendall_pairs(ranked: DataFrame, pairs: list[tuple[str, str]], n_rows: int | None = None,
                  block_points: int | None = None) -> dict[tuple[str, str], float | None]:
    """Exact Kendall tau-b for many column pairs at once.

    ``ranked`` holds per column ``c`` the rows below its value and in ``c__n`` the rows that share it (``attach_ranks`` of kind
    ``below``). Per pair, rows collapse to weights ``c`` per distinct (X, Y); discordant pairs are counted
    by :func:`tabulyst.functions.inversions.discordant`, all pairs in the same jobs, and the rest follows from tie counts.
    """
    if not pairs:
        return {}
    n_rows = ranked.count() if n_rows is None else n_rows
    # one pass over the rows for all pairs
    long = ranked.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("pair"), col_(a).alias("X"), col_(b).alias("Y"), col_(f"{a}__n").alias("xn"), col_(f"{b}__n").alias("yn"))
        for p, (a, b) in enumerate(pairs)])))
    yat = F.col("Y") / float(max(1, n_rows))
    # read by the aggregates below and by two steps of the count; its size is the number of distinct (pair, X, Y)
    w = (long.where(F.col("X").isNotNull() & F.col("Y").isNotNull())
         .groupBy("pair", "X", "Y").agg(F.count(F.lit(1)).alias("c"), F.min("xn").alias("xn"), F.min("yn").alias("yn"))
         .select("pair", "X", "Y", "c", "xn", "yn", yat.alias("yat"), ((F.col("X") + F.col("xn") * yat) / float(max(1, n_rows))).alias("at"))
         .persist())
    tied = lambda n: F.sum(F.col("c").cast("double") * (F.col(n) - 1) / 2)
    tot = {r["pair"]: r for r in w.groupBy("pair").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("points"), tied("c").alias("n3"), tied("xn").alias("n1"), tied("yn").alias("n2")).collect()}
    # a pair without gaps has every row that shares a value; the others count theirs anew
    gaps = [p for p, r in tot.items() if r["n"] != n_rows]

    def ties(key, known):
        out = {p: r[known] or 0 for p, r in tot.items()}
        if gaps:
            out |= {r["pair"]: r["t"] or 0 for r in w.where(F.col("pair").isin(gaps)).groupBy("pair", key).agg(F.sum("c").alias("t"))
                    .groupBy("pair").agg(F.sum(F.col("t").cast("double") * (F.col("t") - 1) / 2).alias("t")).collect()}
        return out

    n1, n2 = ties("X", "n1"), ties("Y", "n2")
    disc = discordant(w, max((r["points"] for r in tot.values()), default=0), block_points)
    w.unpersist()
    out: dict[tuple[str, str], float | None] = {}
    for p, key in enumerate(pairs):
        r = tot.get(p)
        if r is None or r["n"] is None or r["n"] < 2:
            out[key] = None
            continue
        n = int(r["n"])
        n0 = n * (n - 1) / 2
        a1, a2, a3 = n1.get(p, 0), n2.get(p, 0), r["n3"] or 0
        denom = (n0 - a1) * (n0 - a2)
        out[key] = None if denom <= 0 else float((n0 - a1 - a2 + a3 - 2 * disc.get(p, 0)) / math.sqrt(denom))
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str, **options) -> float | None:
    """Exact Kendall tau-b of two columns (see ``kendall_pairs``)."""
    return kendall_pairs(attach_ranks(df.select(col_(x), col_(y)), [x, y], kind="below"), [(x, y)], **options)[(x, y)]


def correlation_values(df: DataFrame, cols: list[str], method: str = "pearson", n: int | None = None,
                       shifts: dict[str, float] | None = None) -> dict[tuple[str, str], float | None]:
    """``{(a, b): r}`` for every pair a before b (None where undefined).

    ``df`` has no gaps (see ``median_filled``); ``n`` is its row count when known.
    """
    if method == "pearson":
        return _pearson_values(df, cols, shifts)
    cached: list = []
    if method == "spearman":
        out = spearman_values(df, cols, cached, n=n)
        for frame in cached:  # the coefficients are on the driver: release the rank tables
            frame.unpersist()
        return out
    # read once; the values of a column reach the rows without a shuffle while they fit a broadcast
    ranked = attach_ranks(df, cols, kind="below", broadcast_limit=KENDALL_BROADCAST, cached=cached)
    out = kendall_pairs(ranked, [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))], n)
    for frame in cached:
        frame.unpersist()
    return out


def correlate(df: DataFrame, target: str = "", method: str = "pearson", top_n: int = 10, threshold: float = 0.0,
              **qkw) -> Tables:
    """Correlation analysis tables: ``pairs``, ``top_pairs`` (with p-values), ``target``,
    ``multicollinear``, ``matrix`` and ``summary``."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    spark = df.sparkSession
    ship_package(spark)  # p-values run in a pandas UDF
    cols = numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("Need at least 2 numeric columns.")
    filled, means = median_filled(df, cols, with_means=True, **qkw)
    n = filled.count()
    vals = correlation_values(filled, cols, method, n=n, shifts=means)

    seq = {p: i for i, p in enumerate(vals)}
    rows = [(a, b, seq[(a, b)], v) for (a, b), v in vals.items()]
    allp = spark.createDataFrame(rows, "feature_a string, feature_b string, seq int, r double")  # k^2 rows
    pairs = (allp.where(F.col("r").isNotNull() & (F.abs("r") >= threshold))
             .select("feature_a", "feature_b", "seq", F.round("r", 4).alias("correlation"),
                     F.round(F.abs("r"), 4).alias("abs_correlation"), strength("r").alias("strength"),
                     direction("r").alias("direction"), "r"))
    order = Window.orderBy(F.desc("abs_correlation"), F.asc("seq"))  # at most k^2 rows
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = ranked.where(F.col("rank") <= top_n)
    if method in ("pearson", "spearman"):
        top = top.withColumn("p_value", F.round(p_value("r", F.lit(n)), 6)).withColumn(
            "significant", F.col("p_value") < SIGNIFICANCE)
    else:
        top = top.withColumn("p_value", F.lit(None).cast("double")).withColumn(
            "significant", F.lit(None).cast("boolean"))
    keep = ["rank", "feature_a", "feature_b", "correlation", "abs_correlation", "strength", "direction"]

    mirror = allp.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "seq", "r")
    diag = spark.createDataFrame([(c, c, -1, 1.0) for c in cols], "feature_a string, feature_b string, seq int, r double")
    matrix = allp.unionByName(mirror).unionByName(diag).select(
        "feature_a", "feature_b", F.round("r", 4).alias("correlation"))

    if target and target in cols:
        t = (allp.where((F.col("feature_a") == target) | (F.col("feature_b") == target))
             .where(F.col("r").isNotNull())
             .select(F.when(F.col("feature_a") == target, F.col("feature_b")).otherwise(F.col("feature_a"))
                     .alias("feature"), "r", "seq"))
        tw = Window.orderBy(F.desc(F.abs("r")), F.asc("seq"))
        target_df = t.select(F.row_number().over(tw).alias("rank"), "feature", F.round("r", 4).alias("correlation"),
                             strength("r").alias("strength"), direction("r").alias("direction"))
    else:
        target_df = spark.createDataFrame(
            [], "rank int, feature string, correlation double, strength string, direction string")

    multi = ranked.where((F.col("abs_correlation") >= MULTICOLLINEAR) & (F.col("feature_a") != F.lit(target))
                         & (F.col("feature_b") != F.lit(target)))
    summary = ranked.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_pairs"),
        F.coalesce(F.round(F.avg("abs_correlation"), 4), F.lit(0.0)).alias("avg_abs_correlation"),
        F.count_if(F.col("abs_correlation") >= STRONG_PAIR).cast("bigint").alias("highly_correlated_count"),
        F.min_by("feature_a", "rank").alias("strongest_a"), F.min_by("feature_b", "rank").alias("strongest_b"),
        F.min_by("correlation", "rank").alias("strongest_correlation"),
    ).select(F.lit(method).alias("method"), F.lit(len(cols)).cast("bigint").alias("columns_analyzed"), "*")
    return Tables(
        pairs=pairs.select(*keep[1:]),
        top_pairs=top.select(*keep, "p_value", "significant"),
        target=target_df,
        multicollinear=multi.select(*keep),
        matrix=matrix,
        summary=summary,
    )
