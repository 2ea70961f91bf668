"""Segmentation: K-means on (scaled) numeric columns, then group profiles.

* Gaps take the exact column median; features are assembled once and persisted
  because K-means restarts read them ``n_init`` times.
* ``StandardScaler`` (Spark divides by the sample sd; the reference's population
  sd only rescales every axis by the same factor, so the clustering is the same
  and the reported inertia is multiplied back by ``n / (n - 1)``).
* Best of ``n_init`` runs of ``KMeans`` (k-means||, seeds ``seed .. seed+n_init-1``)
  by training cost.
* ``group_profile`` / ``between_group_variance`` work for any label column: one
  ``groupBy(label)`` aggregate plus exact per-group medians.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.functions.expressions import col_
from tabulyst.functions.quantiles import group_quantiles, medians
from tabulyst.result import Tables
from tabulyst.sources.schema import normalize_missing, select_columns


def standardize(df: DataFrame, cols: list[str], population: bool = False) -> DataFrame:
    """Columns centred and divided by their sd (sample sd like Spark's ``StandardScaler``;
    ``population=True`` for the population sd). A constant column becomes 0."""
    fn = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[fn(col_(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        z = (col_(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0) * col_(c)
        out.append(z.cast("double").alias(c))
    return df.select(*[o for o in out], *[col_(c) for c in df.columns if c not in cols])


def group_profile(df: DataFrame, label: str, cols: list[str], **qkw) -> DataFrame:
    """``(cluster, column, size, percent, mean, median, std)`` per label value and column (4 dp)."""
    total = df.count()
    sizes = df.groupBy(col_(label)).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(col_(label).alias("cluster"), "size",
                         F.round(F.col("size") / F.lit(float(total)) * 100.0, 1).alias("percent"))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(col_(c)).alias(f"m{i}"), F.stddev_samp(col_(c)).alias(f"s{i}")]
    mom = df.groupBy(col_(label)).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                    for i, c in enumerate(cols)])
    mom = mom.select(col_(label).alias("cluster"), F.inline(arr))
    med = group_quantiles(df, cols, [0.5], [label], **qkw)
    med = med.select(col_(label).alias("cluster"), "column", F.col("value").alias("median"))
    # null-safe joins keep a group whose label is null
    m2 = mom.withColumnRenamed("cluster", "__c")
    j = sizes.join(m2, sizes["cluster"].eqNullSafe(m2["__c"])).drop("__c")
    md = med.withColumnRenamed("cluster", "__c").withColumnRenamed("column", "__col")
    j = j.join(md, j["cluster"].eqNullSafe(md["__c"]) & (j["column"] == md["__col"]), "left")
    return j.select("cluster", "column", "size", "percent", F.round("mean", 4).alias("mean"),
                    F.round("median", 4).alias("median"), F.round("std", 4).alias("std"))


def between_group_variance(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """``(rank, column, between_variance)``: sample variance of the group means, largest first."""
    means = df.groupBy(col_(label)).agg(*[F.avg(col_(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    v = means.agg(*[F.var_samp(f"m{i}").alias(f"v{i}") for i in range(len(cols))])
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"v{i}").alias("between_variance"))
                    for i, c in enumerate(cols)])
    long = v.select(F.inline(arr))
    w = Window.orderBy(F.desc_nulls_last("between_variance"), "pos")  # one row per column
    return long.select(F.row_number().over(w).alias("rank"), "column", "between_variance")


def segment(df: DataFrame, k: int = 3, columns: str | list[str] = "", scale: bool = True, n_init: int = 10,
            seed: int = 42, max_iter: int = 300, parallelism: int = 4, **qkw) -> Tables:
    """K-means segmentation: ``labelled`` rows (+ ``cluster_label``), ``profiles``,
    ``distinguishing``, ``sizes`` and ``summary``."""
    df = normalize_missing(df)
    cols, ignored = select_columns(df, columns)
    if not cols:
        raise ValueError("No numeric columns found.")
    n = df.count()
    if n < k:
        raise ValueError(f"Need at least {k} rows.")
    meds = medians(df, cols, **qkw)
    filled = {c: F.coalesce(col_(c).cast("double"), F.lit(meds[c]).cast("double")) for c in cols}
    fnames = [f"__f{i}" for i in range(len(cols))]
    feats = df.select("*", *[filled[c].alias(f) for c, f in zip(cols, fnames)])
    vec = VectorAssembler(inputCols=fnames, outputCol="__raw").transform(feats)
    if scale:
        vec = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(vec).transform(vec)
    else:
        vec = vec.withColumnRenamed("__raw", "__x")
    # read by every K-means restart and by the final labelling
    vec = vec.drop(*fnames, *(["__raw"] if scale else [])).persist()
    def run(s):
        model = KMeans(k=min(k, n), seed=s, maxIter=max_iter, featuresCol="__x", predictionCol="cluster_label").fit(vec)
        return model.summary.trainingCost, s, model

    # restarts are independent Spark jobs: run them concurrently, keep the least cost (lowest seed on ties)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = list(pool.map(run, range(seed, seed + n_init)))
    cost, _, model = min(fits, key=lambda t: (t[0], t[1]))
    inertia = cost * n / (n - 1) if scale and n > 1 else cost
    labelled = (model.transform(vec).withColumn("cluster_label", F.col("cluster_label").cast("int"))
                .drop("__x"))
    sizes = labelled.groupBy(F.col("cluster_label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    summary = labelled.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(min(k, n)).cast("int").alias("k"), "rows", F.lit(round(inertia, 2)).alias("inertia"),
        F.lit(", ".join(cols)).alias("columns_used"), F.lit(", ".join(ignored)).alias("ignored_columns"))
    return Tables(labelled=labelled, profiles=group_profile(labelled, "cluster_label", cols, **qkw),
                  distinguishing=between_group_variance(labelled, "cluster_label", cols), sizes=sizes,
                  summary=summary)
