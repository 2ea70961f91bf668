"""Isolation forest (Liu, Ting & Zhou, 2008) as Spark jobs.

1. **Sample** – rows are counted by feature values (partial counts on the map
   side, so a hot row costs nothing extra). Each distinct row takes
   ``floor(count * 2 psi * trees / n + u)`` draws, ``u`` being a hash of its values,
   spread evenly over the trees; each tree keeps its first ``psi`` draws by hash.
   About ``2 psi`` draws per tree whatever the table size, and the same
   ones however the table is partitioned.
2. **Build** – ``groupBy(tree).applyInPandas``: one group of at most ``2 psi`` rows
   per tree; random feature among non-constant ones, uniform threshold, depth
   limit ``ceil(log2 psi)``. Output: a node table (at most ``trees * (2 psi - 1)``
   rows), collected and broadcast – its size is bounded by the parameters, not
   the data.
3. **Score** – a pandas UDF over the feature columns alone: vectorised numpy
   traversal of every tree per Arrow batch; ``score = -2 ** (-E[h] / c(psi))``.
4. **Offset** – exact distributed quantile of the scores at ``contamination``;
   ``anomaly_score = score - offset`` and a row is anomalous when it is below 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.expressions import col_
from tabulyst.functions.quantiles import exact_quantiles
from tabulyst.session import ship_package

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType()),
])


def average_path_length(n):
    """c(n): expected path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _build_tree(x: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        node_id = len(nodes)
        nodes.append([tree, node_id, -1, 0.0, -1, -1, len(idx), depth])
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = node_id
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            continue
        f = int(rng.choice(candidates))
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        go_left = sub[:, f] <= thr
        nodes[node_id][2], nodes[node_id][3] = f, thr
        stack.append((idx[~go_left], depth + 1, node_id, True))
        stack.append((idx[go_left], depth + 1, node_id, False))
    return [tuple(n) for n in nodes]


def _forest_arrays(nodes: list, n_trees: int):
    width = max(r["node"] for r in nodes) + 1
    feat = np.full((n_trees, width), -1, dtype=np.int32)
    thr = np.zeros((n_trees, width))
    left = np.zeros((n_trees, width), dtype=np.int32)
    right = np.zeros((n_trees, width), dtype=np.int32)
    leaf = np.zeros((n_trees, width))
    for r in nodes:
        t, k = r["tree"], r["node"]
        feat[t, k], thr[t, k], left[t, k], right[t, k] = r["feature"], r["threshold"], r["left"], r["right"]
        leaf[t, k] = r["depth"] + average_path_length([r["size"]])[0]
    return feat, thr, left, right, leaf


def _path_lengths(x: np.ndarray, arrays) -> np.ndarray:
    """Mean path length over all trees: every tree advances one level per step."""
    feat, thr, left, right, leaf = arrays
    n_trees = feat.shape[0]
    t_idx = np.arange(n_trees)[:, None]
    rows = np.arange(len(x))[None, :]
    node = np.zeros((n_trees, len(x)), dtype=np.int32)
    while True:
        f = feat[t_idx, node]
        inner = f >= 0
        if not inner.any():
            break
        go_left = x[rows, np.where(inner, f, 0)] <= thr[t_idx, node]
        node = np.where(inner, np.where(go_left, left[t_idx, node], right[t_idx, node]), node)
    return leaf[t_idx, node].mean(axis=0)


def isolation_forest(df: DataFrame, cols: list[str], contamination: float = 0.05, n_trees: int = 100,
                     max_samples: int = 256, seed: int = 42, medians: dict | None = None,
                     persist: bool = True) -> DataFrame:
    """All rows of ``df`` plus ``is_anomaly`` and ``anomaly_score`` (lower = more anomalous)."""
    spark = df.sparkSession
    ship_package(spark)
    contamination = max(0.01, min(0.5, contamination))
    if medians is None:
        res = exact_quantiles(df, cols, [0.5])
        medians = {r["column"]: r["value"] for r in res}
    filled = {c: F.coalesce(col_(c).cast("double"), F.lit(medians.get(c)).cast("double")) for c in cols}
    n = df.count()
    if n == 0:
        return df.select("*", F.lit(False).alias("is_anomaly"), F.lit(None).cast("double").alias("anomaly_score"))
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    # 1. bounded training sample, a function of the rows alone
    feature_names = [f"x{i}" for i in range(len(cols))]
    counted = df.select(*[filled[c].alias(x) for x, c in zip(feature_names, cols)]).groupBy(*feature_names).agg(
        F.count(F.lit(1)).alias("rows"))
    per_row = n_trees * min(1.0, 2.0 * psi / n)
    scale = 1 << 30
    u = F.pmod(F.xxhash64(*feature_names, F.lit(seed)), F.lit(scale)) / F.lit(float(scale))
    drawn = counted.withColumn("draws", F.floor(F.col("rows") * F.lit(per_row) + u).cast("int")).where("draws > 0")
    start = F.pmod(F.xxhash64(*feature_names, F.lit(seed + 1)), F.lit(n_trees))
    member = drawn.select(*feature_names, start.alias("start"), F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("draw"))
    member = member.withColumn("tree", F.pmod(F.col("start") + F.col("draw"), F.lit(n_trees)).cast("int")).withColumn(
        "h", F.xxhash64(*feature_names, "draw", F.lit(seed + 2)))
    w = Window.partitionBy("tree").orderBy("h", *feature_names)
    sample = member.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= psi).select(*feature_names, "tree")

    # 2. build one tree per group (bounded group size)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = _build_tree(pdf[feature_names].to_numpy(dtype=float), tree, seed, max_depth)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA).collect()
    arrays = spark.sparkContext.broadcast(_forest_arrays(nodes, n_trees))
    c_psi = float(average_path_length([psi])[0])

    # 3. score every row (Arrow batches of the features, vectorised numpy)
    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        h = _path_lengths(np.column_stack([f.to_numpy(dtype=float) for f in features]), arrays.value)
        return pd.Series(-np.power(2.0, -h / c_psi) if c_psi > 0 else -np.ones(len(h)))

    scored = df.withColumn("__score", score(*filled.values()))
    if persist:
        scored = scored.persist()

    # 4. offset = contamination quantile of all scores (exact, distributed)
    offset = exact_quantiles(scored, ["__score"], [contamination])[0]["value"]
    return scored.select(
        *[col_(c) for c in df.columns],
        ((F.col("__score") - F.lit(offset)) < 0).alias("is_anomaly"),
        (F.col("__score") - F.lit(offset)).alias("anomaly_score"))
