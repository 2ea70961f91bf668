"""Segmentation and model queries (G-11, C-12, C-13, H-01..H-05, G-14..G-16, B-08..B-10).

Model outputs (labels, scores, importances) have no SQL equivalent and register
without an oracle; the deterministic pieces (group profiles for a given label,
one-hot columns, label encoding) do have one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyst.operators import automl as ML
from tabulyst.operators import segment as SEG
from tabulyst.plans.registry import register
from tabulyst.plans.tables import embedding_features, table, view

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _customers(spark, sf_dir):
    return SEG.segment(table(spark, sf_dir, "customer"), k=4, columns="c_nationkey, c_acctbal")


@register("cluster_profiles")
def cluster_profiles(spark, sf_dir):
    return _customers(spark, sf_dir).profiles


@register("cluster_summary")
def cluster_summary(spark, sf_dir):
    return _customers(spark, sf_dir).summary


@register("cluster_labels")
def cluster_labels(spark, sf_dir):
    return _customers(spark, sf_dir).labelled.select("c_custkey", "cluster_label")


@register("group_profile", "\nUNION ALL\n".join(
    f"SELECT c_mktsegment AS cluster, '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS size, "
    f"round(count(*) * 100.0 / (SELECT count(*) FROM customer), 1) AS percent, round(avg({c}), 4) AS mean, "
    f"round(median(CAST({c} AS DOUBLE)), 4) AS median, round(stddev_samp({c}), 4) AS std "
    f"FROM customer GROUP BY c_mktsegment" for c in ["c_nationkey", "c_acctbal"]))
def group_profile(spark, sf_dir):
    return SEG.group_profile(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey", "c_acctbal"])


@register("between_group_variance", """
WITH m AS (SELECT c_mktsegment, avg(c_nationkey) AS a, avg(c_acctbal) AS b FROM customer GROUP BY c_mktsegment),
v AS (SELECT 0 AS pos, 'c_nationkey' AS "column", var_samp(a) AS between_variance FROM m
      UNION ALL SELECT 1, 'c_acctbal', var_samp(b) FROM m)
SELECT CAST(row_number() OVER (ORDER BY between_variance DESC NULLS LAST, pos) AS INTEGER) AS rank, "column",
       round(between_variance, 4) AS between_variance FROM v""")
def between_group_variance(spark, sf_dir):
    out = SEG.between_group_variance(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey", "c_acctbal"])
    return out.select(F.col("rank").cast("int").alias("rank"), "column",
                      F.round("between_variance", 4).alias("between_variance"))


@register("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"c_mktsegment_{v}\"" for v in SEGMENTS[1:])
    + " FROM customer")
def one_hot(spark, sf_dir):
    out, _ = ML.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    return out


@register("label_encode", """
SELECT o_orderkey, o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders""")
def label_encode(spark, sf_dir):
    out, _ = ML.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return out


@register("label_codes_many", """
SELECT l_orderkey, l_linenumber, l_shipdate, CAST(dense_rank() OVER (ORDER BY l_shipdate) - 1 AS DOUBLE) AS label FROM lineitem""")
def label_codes_many(spark, sf_dir):
    """Codes of a column of more than 2,000 values."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ML.label_codes(rows, "l_shipdate")[0]


@register("one_hot_vectors", """
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 7 = 0 AS INT) AS gap, dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) AS r, l_partkey FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey = (SELECT min(CAST(l_partkey AS VARCHAR)) FROM lineitem)::BIGINT THEN NULL ELSE r - 2 END AS BIGINT) AS place,
  CAST((SELECT max(r) - 1 FROM c) AS BIGINT) AS places FROM c""")
def one_hot_vectors(spark, sf_dir):
    """Text with more than 1,000 categories as sparse vectors: each row's place, and the vector's length."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    out, _ = ML.one_hot_vectors(rows, ["part"])
    parts = F.from_json(F.to_json(F.struct("part")), "part struct<indices: array<bigint>, size: bigint>")["part"]
    return out.select("l_orderkey", "l_linenumber", F.get(parts["indices"], 0).alias("place"), parts["size"].alias("places"))


_SPLIT_CONTENT = "l_returnflag, l_linestatus, l_linenumber"


@register("split_repeated", f"""
SELECT {_SPLIT_CONTENT}, count(*) AS "rows", true AS share_holds FROM lineitem GROUP BY {_SPLIT_CONTENT}""")
def split_repeated(spark, sf_dir):
    """Of n equal rows the test set holds 0.2 n, rounded to one of its neighbours, and no row is lost."""
    rows = table(spark, sf_dir, "lineitem").select(*_SPLIT_CONTENT.split(", "))
    train, test = ML.train_test_split(rows, 0.2)
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return both.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"), F.sum("t").alias("t")).select(
        *rows.columns, "rows", (F.abs(F.col("t") - 0.2 * F.col("rows")) < 1).alias("share_holds"))


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@register("automl_leaderboard")
def automl_leaderboard(spark, sf_dir):
    res = ML.automl(_part(spark, sf_dir), "p_retailprice")
    return res.leaderboard.select("model", F.round("score", 4).alias("score"), "metric", "status")


@register("automl_best")
def automl_best(spark, sf_dir):
    return ML.automl(view(spark, sf_dir, "lineitem_target"), "target").best


@register("automl_classification")
def automl_classification(spark, sf_dir):
    res = ML.automl(view(spark, sf_dir, "doc_quality"), "quality", features=["n_chars", "toxic", "lang"])
    return res.leaderboard.select("model", F.round("score", 4).alias("score"), "metric", "status")


@register("automl_multiclass")
def automl_multiclass(spark, sf_dir):
    """All four models on the whole embedding vector, one feature per dimension."""
    res = ML.automl(embedding_features(spark, sf_dir), "label")
    return res.leaderboard.select("model", F.round("score", 4).alias("score"), "metric", "status")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    return ML.feature_importance(_part(spark, sf_dir), "p_retailprice").importance


@register("feature_importance_summary")
def feature_importance_summary(spark, sf_dir):
    return ML.feature_importance(_part(spark, sf_dir), "p_retailprice").summary


@register("model_facts")
def model_facts(spark, sf_dir):
    return ML.model_facts(_part(spark, sf_dir), "p_retailprice").facts


@register("model_drivers")
def model_drivers(spark, sf_dir):
    return ML.model_facts(_part(spark, sf_dir), "p_retailprice").drivers


@register("task_type_quality", """
SELECT 'quality' AS target, CAST(count(DISTINCT coalesce(CAST(quality AS DOUBLE),
         (SELECT median(CAST(quality AS DOUBLE)) FROM labels))) AS BIGINT) AS unique_values,
       CASE WHEN count(DISTINCT quality) > 1 AND count(DISTINCT quality) < 15 THEN 'classification'
            ELSE 'regression' END AS type
FROM labels""")
def task_type_quality(spark, sf_dir):
    return ML.task_type(table(spark, sf_dir, "labels"), "quality")


@register("task_type_price", """
SELECT 'p_retailprice' AS target, CAST(count(DISTINCT p_retailprice) AS BIGINT) AS unique_values,
       CASE WHEN count(DISTINCT p_retailprice) > 1 AND count(DISTINCT p_retailprice) < 15 THEN 'classification'
            ELSE 'regression' END AS type
FROM part""")
def task_type_price(spark, sf_dir):
    return ML.task_type(table(spark, sf_dir, "part"), "p_retailprice")


@register("standardize", """
WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_samp(c_acctbal) AS s1, avg(c_nationkey) AS m2,
                  stddev_samp(c_nationkey) AS s2 FROM customer)
SELECT c_custkey, round((c_acctbal - m1) / s1, 4) AS c_acctbal, round((c_nationkey - m2) / s2, 4) AS c_nationkey
FROM customer, s""")
def standardize(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = SEG.standardize(cust, ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), F.round("c_nationkey", 4).alias("c_nationkey"))
