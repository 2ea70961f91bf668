"""AutoML leaderboard, feature importance and model facts on Spark ML.

Preparation (the reference's rules): features default to numeric columns other
than the target; text features become 0/1 columns with the first sorted
category dropped (gaps -> all zeros); feature gaps -> 0; target gaps -> target
median; ``1 < distinct targets < 15`` means classification, classes encoded
0..k-1 in sorted order.

Split: equal rows are counted and their exact share goes to the test set, single rows by a hash of their
content – stable under any repartitioning, one pre-aggregated shuffle. The assembled
frame is persisted once and every model of the sweep reads it; one failing
model becomes a ``failed`` leaderboard row.

Forest and boosting see ``BINS`` ranges of a feature, so of many rows those of equal ranges (and class) become one weighted row
(:func:`_cells`): the sums of every split stay those of all rows, and the fit grows with the distinct ranges. Where
rows rarely agree the frame stays as it is.

Model mapping (scikit-learn defaults -> Spark ML):

* random forest: 100 trees, ``maxDepth`` 12 (Spark's limit is 30)
* gradient boosting: 100 rounds, step 0.1, depth 3; more than two classes share one
  ensemble with a softmax gradient (:mod:`tabulyst.operators.boosting`)
* logistic regression: C = 1 -> ``regParam = 1 / n_train``, no standardisation
* linear regression: no penalty, normal equations
* ridge (alpha 1): ``regParam = alpha * sd(y) / n_train`` (Spark penalises in
  label-scaled space)
* lasso (alpha 1): ``elasticNetParam = 1, regParam = alpha``
* decision tree: depth 10
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.functions.cells import cell_counts
from tabulyst.functions.codes import value_codes, with_codes
from tabulyst.functions.expressions import col_, score_grade
from tabulyst.functions.quantiles import medians
from tabulyst.operators.boosting import JointBoosting
from tabulyst.result import Tables
from tabulyst.sources.schema import is_numeric_type, is_text_type, normalize_missing, numeric_columns, require_columns

MAX_CLASSES = 15  # fixed value: fewer distinct targets than this (and more than 1) means classification
MAX_DUMMY_CATEGORIES = 1000
RF_DEPTH = 12
NODE_IDS = {"cacheNodeIds": True, "checkpointInterval": -1}  # a forest's rows keep their node of every tree, not looked up from the root at each level
LOT = 65_536  # copies of one row made by one task
BINS = 32  # ranges of a feature that forest and boosting tell apart (Spark's default)
CELLS_FROM = 50_000  # rows from which equal ranges are put together
FOREST_LOTS = 500_000  # weighted rows that the forest's bootstrap draws from, at least, where there are as many rows


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = True,
            max_categories: int = MAX_DUMMY_CATEGORIES) -> tuple[DataFrame, list[str]]:
    """0/1 columns ``<col>_<value>`` per category (first sorted category dropped; gaps all 0).

    The category list becomes part of the schema, so it is collected – after a
    distinct count proves it is at most ``max_categories`` per column.
    """
    if not cols:
        return df, []
    counts = cell_counts(df, cols).where(F.col("value").isNotNull())
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_many = [c for c, n in sizes.items() if n > max_categories]
    if too_many:
        raise ValueError(f"too many categories to one-hot encode: {too_many}")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in counts.select("column", "value").collect():
        cats[r["column"]].append(r["value"])
    new_cols, exprs = [], []
    for c in cols:
        values = sorted(cats[c])[1 if drop_first else 0:]
        for v in values:
            name = f"{c}_{v}"
            new_cols.append(name)
            exprs.append(F.when(col_(c) == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(name))
    return df.select(*[col_(c) for c in df.columns if c not in cols], *exprs), new_cols


def one_hot_vectors(df: DataFrame, cols: list[str], drop_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """Any number of categories: each column becomes a sparse 0/1 vector of the same name.

    Returns the table and ``column, place, category``, the vectors' places in order (first sorted category dropped, gaps all 0). The
    categories are a table of codes that joins the rows; neither the schema nor the driver holds them.
    """
    places = None
    for c in cols:
        codes, n = value_codes(df, c)
        keep = codes.select(F.lit(c).alias("column"), (F.col("code") - int(drop_first)).alias("place"), F.col("value").alias("category")).where("place >= 0")
        places = keep if places is None else places.unionByName(keep)
        # the encoder drops its last index: gaps, and with them the first category
        gap = float(n - int(drop_first))
        index = F.col("__code") - int(drop_first)
        rows = with_codes(df, col_(c), codes, n, "__code").withColumn("__index", F.when(F.col("__code").isNull() | (index < 0), F.lit(gap)).otherwise(index).cast("double"))
        rows = rows.withColumn("__index", F.col("__index").alias("__index", metadata={"ml_attr": {"type": "nominal", "num_vals": int(gap) + 1, "name": "__index"}}))
        if gap < 1:  # one category or none: nothing is left of it
            df = rows.withColumn(c, array_to_vector(F.array().cast("array<double>"))).drop("__code", "__index")
            continue
        fitted = OneHotEncoder(inputCols=["__index"], outputCols=["__hot"], dropLast=True).fit(rows.limit(1))
        out = fitted.transform(rows)
        df = out.select(*[(F.col("__hot") if x == c else col_(x)).alias(x) for x in df.columns])
    return df, places


def label_encode(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, list]:
    """Classes -> 0..k-1 in sorted order (numeric order for numeric targets), and the classes in order."""
    codes, _ = value_codes(df, target)
    return label_codes(df, target, out)[0], [r["value"] for r in codes.orderBy("code").collect()]


def label_codes(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, int]:
    """Classes -> 0..k-1 in sorted order, and k; the codes are a table of any length
    (:func:`tabulyst.functions.codes.value_codes`) that joins the rows, gaps stay gaps."""
    codes, n = value_codes(df, target)
    return with_codes(df, col_(target), codes.select("value", F.col("code").cast("double").alias("code")), n, out), n


def _prepare(df: DataFrame, target: str, features: list[str] | None, fill_features: bool = True, dummies: bool = True):
    require_columns(df, target)
    df = normalize_missing(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    if not features:
        features = [c for c in numeric_columns(df) if c != target]
    if not features:
        raise ValueError("No numeric features found for training")
    require_columns(df, *features)
    texts = [c for c in features if is_text_type(types[c])]
    nums = [c for c in features if is_numeric_type(types[c])]
    work = df.select(*[col_(c) for c in features], col_(target))
    names = list(nums)
    vectors: list[str] = []  # text features of many categories, as sparse vectors
    if texts and dummies:
        sizes = work.agg(*[F.approx_count_distinct(col_(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
        vectors = [c for i, c in enumerate(texts) if sizes[i] > MAX_DUMMY_CATEGORIES // 2]
        work, dummy_cols = one_hot(work, [c for c in texts if c not in vectors])
        names += dummy_cols
    work = work.select(*[F.coalesce(col_(c).cast("double"), F.lit(0.0)).alias(c) if fill_features
                         else col_(c).cast("double").alias(c) for c in names], *[col_(c) for c in vectors], col_(target))
    if is_numeric_type(types[target]):
        med = medians(work, [target])[target]
        work = work.withColumn(target, F.coalesce(col_(target).cast("double"), F.lit(med)))
    n_classes = work.select(col_(target)).where(col_(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).count()
    is_cls = 1 < n_classes < MAX_CLASSES
    if is_cls:
        work, classes = label_codes(work, target)
    else:
        if not is_numeric_type(types[target]):
            # the reference's rule for numbers would make this a regression, which text has not
            work, classes = label_codes(work, target)
            is_cls = True
        else:
            work, classes = work.withColumn("label", col_(target).cast("double")), 0
    plain = [f"f{i}" for i in range(len(names))]  # the assembler splits names at dots
    flat = work.select(*[col_(c).alias(p) for p, c in zip(plain, names)], *[col_(c).alias(f"t{i}") for i, c in enumerate(vectors)], "label")
    if vectors:
        renamed = [f"t{i}" for i in range(len(vectors))]
        flat, places = one_hot_vectors(flat, renamed)
        # one name per feature of the model, which is as long as the model's own weights
        listed = sorted(((int(r["column"][1:]), r["place"], r["category"]) for r in places.collect()))
        names = names + [f"{vectors[i]}_{category}" for i, _, category in listed]
        vec = VectorAssembler(inputCols=plain + renamed, outputCol="features", handleInvalid="keep").transform(flat)
        return vec.select(*plain, *renamed, "features", "label"), names, is_cls, classes
    vec = VectorAssembler(inputCols=plain, outputCol="features", handleInvalid="keep").transform(flat)
    return vec.select(*plain, "features", "label"), names, is_cls, classes


def task_type(df: DataFrame, target: str) -> DataFrame:
    """``(target, unique_values, type)``: classification when 1 < distinct targets < 15,
    counted after the target gaps take the target median (numeric targets)."""
    require_columns(df, target)
    df = normalize_missing(df.select(col_(target)))
    y = col_(target)
    if is_numeric_type(df.schema[target].dataType):
        y = F.coalesce(y.cast("double"), F.lit(medians(df, [target])[target]))
    n = df.agg(F.count_distinct(y).alias("u"))
    return n.select(F.lit(target).alias("target"), F.col("u").cast("bigint").alias("unique_values"),
                    F.when((F.col("u") > 1) & (F.col("u") < MAX_CLASSES), F.lit("classification"))
                    .otherwise(F.lit("regression")).alias("type"))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split with the exact share of repeated rows, deterministic per content and seed, independent of partitioning.

    Rows of equal content are counted, which pre-aggregates a content that holds a third of all rows. Of its n rows
    ``floor(n * test_size + u)`` go to the test set, u being the content's own uniform draw: a single row goes there with
    probability ``test_size``, and of a thousand equal rows its share does. The copies are written out again in
    lots, so that no task makes more than ``LOT`` of one row. Rows with vectors alone keep ``features`` from their group.
    """
    keys = [c for c in df.columns if c != "features"]
    rest = [F.first("features").alias("features")] if "features" in df.columns else []
    rows = df.groupBy(*[col_(c) for c in keys]).agg(F.count(F.lit(1)).alias("__n"), *rest)
    plain = [c for c in keys if df.schema[c].dataType.typeName() != "udt" and not isinstance(df.schema[c].dataType, VectorUDT)]
    draw = F.pmod(F.xxhash64(*[col_(c) for c in plain], F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.withColumn("__t", F.least(F.col("__n"), F.floor(F.col("__n") * test_size + draw)))

    def copies(n: Column) -> DataFrame:
        some = rows.withColumn("__c", n)
        few = some.where((F.col("__c") > 0) & (F.col("__c") <= LOT)).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c"))))
        lots = some.where(F.col("__c") > LOT).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1, F.lit(LOT).cast("long"))))
        lots = lots.repartition(F.xxhash64("__k", *[col_(c) for c in plain]))
        many = lots.withColumn("__k", F.explode(F.sequence(F.col("__k") + 1, F.least(F.col("__k") + LOT, F.col("__c")))))
        return few.unionByName(many).select(*[col_(c) for c in df.columns])

    return copies(F.col("__n") - F.col("__t")), copies(F.col("__t"))


def _split(data: DataFrame, n: int, test_size: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """:func:`train_test_split` of prepared rows; many rows go without their vectors, which are made anew from the plain features."""
    cols = [c for c in data.columns if c not in ("features", "label")]
    if n < CELLS_FROM or any(isinstance(data.schema[c].dataType, VectorUDT) for c in cols):
        return train_test_split(data, test_size, seed)
    vec = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    train, test = (vec.transform(d).select(*data.columns) for d in train_test_split(data.drop("features"), test_size, seed))
    return train, test


def _spread(df: DataFrame, n: int | None) -> DataFrame:
    """Rows in as many partitions as the session has cores (fewer where one would hold under 2,000 of the ``n`` rows), of at most a
    million rows each. A boosted model runs hundreds of jobs over this frame, whose time on a small one is that of starting tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores if n is None else max(1, min(cores, n // 2_000), n // 1_000_000))


def _ranges(train: DataFrame, cols: list[str]) -> Bucketizer:
    """Numbers of the ranges of ``cols``, as ``b0, b1, ...``: every value of a feature with at most ``BINS``, else about equal shares of the rows."""
    # finer than the ranges, so that a value that holds most rows takes one and the others keep theirs
    shares = [i / (8 * BINS) for i in range(8 * BINS + 1)]
    found = train.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 10_000).alias(c) for c in cols]).first()
    splits = []
    for c in cols:
        cuts = np.unique(np.array(found[c] or [], float))[1:]  # each starts a range, the least value is in the first
        cuts = cuts[np.isfinite(cuts)]
        if len(cuts) > BINS - 1:
            cuts = cuts[np.linspace(0, len(cuts) - 1, BINS - 1).round().astype(int)]
        splits.append([-np.inf, *(float(v) for v in (cuts if len(cuts) else [0.0])), np.inf])
    return Bucketizer(splitsArray=splits, inputCols=cols, outputCols=[f"b{i}" for i in range(len(cols))], handleInvalid="keep")


def _cells(train: DataFrame, test: DataFrame, n: int, is_cls: bool) -> tuple[DataFrame, DataFrame] | None:
    """Rows of equal ranges (and class) as one with ``weight``, their number, and ``label``, their mean; and the test rows by range.

    A split's sums of rows, labels and residuals are the same over either, since both losses' residuals of a cell are those of its label's
    mean (regression) or its class. None where it would not halve the rows, or with features that are vectors.
    """
    cols = [c for c in train.columns if c not in ("features", "label")]
    if n < CELLS_FROM or any(isinstance(train.schema[c].dataType, VectorUDT) for c in cols):
        return None
    ranges = _ranges(train, cols)
    numbers = ranges.getOutputCols()
    keys = numbers + (["label"] if is_cls else [])

    def by_number(rows: DataFrame) -> DataFrame:  # plain numbers: the bucketizer marks its ranges as categories, which trees would group in any order
        return ranges.transform(rows).select("label", *[(F.col(b) + 0.0).alias(b) for b in numbers])

    binned = by_number(train)
    if binned.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] > n / 2:
        return None
    cells = binned.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("weight"), *([] if is_cls else [F.avg("label").alias("label")]))
    vec = VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="keep")
    return vec.transform(cells).select("features", "label", "weight"), vec.transform(by_number(test)).select("features", "label")


def _lots(cells: DataFrame, n: int) -> DataFrame:
    """Cells of more than their share of ``FOREST_LOTS`` as several rows of less weight: the bootstrap draws rows, and all of a cell would come or go together."""
    most = max(1, n // FOREST_LOTS)
    lots = cells.withColumn("__lots", F.ceil(F.col("weight") / most))
    return lots.withColumn("weight", F.col("weight") / F.col("__lots")).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__lots")))).drop("__lots", "__k")


def _models(is_cls: bool, n_classes: int, n_train: int, sd_y: float | None, seed: int, depth: int = RF_DEPTH):
    if is_cls:
        gbt = GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)
        return [
            ("Random Forest", RandomForestClassifier(numTrees=100, maxDepth=depth, maxMemoryInMB=1024, seed=seed, **NODE_IDS)),
            ("Gradient Boosting", gbt if n_classes <= 2 else JointBoosting(n_classes)),
            ("Logistic Regression", LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1),
                                                       elasticNetParam=0.0, standardization=False)),
            ("Decision Tree", DecisionTreeClassifier(maxDepth=10, maxBins=128, seed=seed)),
        ]
    ridge = (sd_y or 0.0) / max(n_train, 1)
    return [
        ("Random Forest", RandomForestRegressor(numTrees=100, maxDepth=depth, maxMemoryInMB=1024, featureSubsetStrategy="all", seed=seed, **NODE_IDS)),
        ("Gradient Boosting", GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)),
        ("Linear Regression", LinearRegression(regParam=0.0, solver="normal")),
        ("Ridge Regression", LinearRegression(regParam=ridge, elasticNetParam=0.0, standardization=False)),
        ("Lasso Regression", LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False, maxIter=5000)),
        ("Decision Tree", DecisionTreeRegressor(maxDepth=10, maxBins=128, seed=seed)),
    ]


def importances(model, names: list[str]) -> list[tuple[str, float]] | None:
    """Tree importances; None for linear models."""
    if not hasattr(model, "featureImportances"):
        return None
    return [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]


def _rank_table(spark, imp: list[tuple[str, float]] | None) -> DataFrame:
    rows = sorted(imp or [], key=lambda t: -t[1])
    return spark.createDataFrame([(i + 1, n, v, v * 100.0) for i, (n, v) in enumerate(rows)],
                                 "rank int, feature string, importance double, percent double")


def automl(df: DataFrame, target: str, features: list[str] | None = None, test_size: float = 0.2,
           seed: int = 42, models: list[str] | None = None, parallelism: int = 4, forest_depth: int = RF_DEPTH) -> Tables:
    """Train the model sweep; tables ``leaderboard``, ``best``, ``importance`` and ``split``."""
    spark = df.sparkSession
    data, names, is_cls, classes = _prepare(df, target, features)
    data = data.persist()
    n = data.count()
    train, test = (_spread(d, n).persist() for d in _split(data, n, test_size, seed))
    n_train, n_test = train.count(), test.count()
    data.unpersist()
    sd_y = None if is_cls else train.agg(F.stddev_samp("label")).first()[0]
    metric = "accuracy" if is_cls else "r2"
    ev = (MulticlassClassificationEvaluator(metricName="accuracy") if is_cls
          else RegressionEvaluator(metricName="r2"))
    sweep = [(name, est) for name, est in _models(is_cls, classes, n_train, sd_y, seed, forest_depth)
             if not models or name in models]

    own: dict[str, tuple[DataFrame, DataFrame]] = {}  # frames of single models
    held: list[DataFrame] = []
    binning = {name for name, est in sweep if name in ("Random Forest", "Gradient Boosting") and not isinstance(est, JointBoosting)}
    binned = _cells(train, test, n_train, is_cls) if binning else None
    if binned:
        cells, by_range = (d.persist() for d in binned)
        n_cells = cells.count()
        held += [cells, by_range]
        frames = {"Gradient Boosting": (cells, n_cells)}
        if "Random Forest" in binning:
            lots = _lots(cells, n_train).persist()
            held.append(lots)
            frames["Random Forest"] = (lots, lots.count())
        for name in binning:
            frame, size = frames[name]
            own[name] = (_spread(frame, size).persist(), by_range)
            held.append(own[name][0])

    def run(item):
        name, est = item
        rows, tests = own.get(name, (train, test))
        if name in own:
            est.setWeightCol("weight")
        try:
            fitted = est.fit(rows)
            return name, float(ev.evaluate(fitted.transform(tests))), fitted, None
        except Exception as exc:  # noqa: BLE001 - one failing model is a leaderboard row
            return name, None, None, str(exc)

    # models are independent Spark jobs: fit them concurrently (like ML tuning's ``parallelism``)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(run, sweep))
    board, best = [], None
    for name, score, fitted, err in results:  # sweep order: strict ">" keeps the first best
        if err is None:
            board.append((name, score, metric, "success", None))
            if best is None or score > best[1]:
                best = (name, score, fitted)
        else:
            board.append((name, None, metric, "failed", err))
    for d in (train, test, *held):
        d.unpersist()
    leaderboard = spark.createDataFrame(board, "model string, score double, metric string, status string, error string")
    kind = "classification" if is_cls else "regression"
    best_df = spark.createDataFrame(
        [(best[0] if best else None, best[1] if best else None, metric, kind, n_train, n_test, len(board))],
        "model string, score double, metric string, type string, training_samples bigint, test_samples bigint, "
        "models_tested int")
    imp = importances(best[2], names) if best else None
    return Tables(leaderboard=leaderboard, best=best_df, importance=_rank_table(spark, imp),
                  split=spark.createDataFrame([(n_train, n_test)], "train bigint, test bigint"))


def feature_importance(df: DataFrame, target: str, top_n: int = 10, features: list[str] | None = None,
                       seed: int = 42, forest_depth: int = RF_DEPTH) -> Tables:
    """Random forest on all rows (numeric features only); ``importance`` and ``summary``."""
    spark = df.sparkSession
    if features:
        types = {f.name: f.dataType for f in df.schema.fields}
        features = [c for c in features if c in types and is_numeric_type(types[c])]
    data, names, is_cls, _ = _prepare(df, target, features, dummies=False)
    est = (RandomForestClassifier if is_cls else RandomForestRegressor)(
        numTrees=100, maxDepth=forest_depth, maxMemoryInMB=1024, featureSubsetStrategy="auto" if is_cls else "all", seed=seed, **NODE_IDS)
    data = _spread(data, None).persist()
    model = est.fit(data)
    data.unpersist()
    table = _rank_table(spark, importances(model, names))
    top = table.where(F.col("rank") <= top_n)
    summary = top.agg(
        F.min_by("feature", "rank").alias("top_driver"),
        F.coalesce(F.sum("importance"), F.lit(0.0)).alias("cumulative_importance"),
    ).select("top_driver", "cumulative_importance", F.lit(len(names)).cast("int").alias("total_features"),
             F.lit("classification" if is_cls else "regression").alias("type"))
    return Tables(importance=table, summary=summary)


def model_facts(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42, top: int = 5) -> Tables:
    """Deterministic facts of a boosted-trees model: ``facts`` and ``drivers`` (with sentences)."""
    spark = df.sparkSession
    data, names, is_cls, classes = _prepare(df, target, None, dummies=False)
    data = data.persist()
    n = data.count()
    train, test = (_spread(d, n).persist() for d in _split(data, n, test_size, seed))
    n_train, n_test = train.count(), test.count()
    data.unpersist()
    gbt = (GBTClassifier if is_cls else GBTRegressor)(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)
    est = JointBoosting(classes) if is_cls and classes > 2 else gbt
    rows, tests, held = train, test, []
    binned = _cells(train, test, n_train, is_cls) if est is gbt else None
    if binned:
        cells, tests = binned[0].persist(), binned[1]
        rows = _spread(cells, cells.count()).persist()
        held += [cells, rows]
        est.setWeightCol("weight")
    model = est.fit(rows)
    ev = (MulticlassClassificationEvaluator(metricName="accuracy") if is_cls
          else RegressionEvaluator(metricName="r2"))
    score = float(ev.evaluate(model.transform(tests)))
    facts = spark.createDataFrame(
        [("Gradient Boosting", "classification" if is_cls else "regression", "accuracy" if is_cls else "R²",
          round(score, 4), n_train, n_test)],
        "model string, task_type string, metric string, score double, training_rows bigint, test_rows bigint",
    ).withColumn("grade", score_grade("score"))
    for d in (train, test, *held):
        d.unpersist()
    ranked = _rank_table(spark, importances(model, names)).where(F.col("rank") <= top)
    drivers = ranked.select(
        "rank", "feature", F.round("importance", 4).alias("importance"), F.round("percent", 1).alias("percent"),
        F.format_string("- %s: %s%% importance", F.col("feature"), F.round("percent", 1).cast("string")).alias("sentence"))
    return Tables(facts=facts, drivers=drivers)


__all__ = ["automl", "feature_importance", "model_facts", "one_hot", "one_hot_vectors", "label_encode", "label_codes", "train_test_split",
           "importances"]
