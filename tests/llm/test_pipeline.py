"""The registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from tabulyst.llm import decontaminate, neardup, queries, sharding
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(want)


def test_stages_return_documents(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        back = spark.read.parquet(f"{tmp_path}/{k}")
        own = [c for c in back.columns if c not in ("shard", "slot")]
        assert own == docs.columns or k == 4 and set(own) == set(docs.columns)
        left = [r[0] for r in back.select("doc_id").collect()]
        assert set(left) <= ids and left
        assert name == "mixing_sources" or len(left) == len(set(left)) or k == 4
        ids, docs = set(left), back
    assert docs.groupBy("shard").agg(F.max("slot") + 1 == F.count("*")).select(F.min(F.col(docs.groupBy("shard").agg(F.max("slot") + 1 == F.count("*")).columns[1]).cast("int"))).first()[0] == 1


def test_every_stage_takes_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_stage_takes_null_and_repeated_rows(spark):
    text = " ".join(f"word{i}." for i in range(60))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " more", None, None, None), (2, None, "en", "b", 0), (3, "", None, "b", 0), (4, "x " * 20_000, "en", "b", 1)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, base, SF).collect()
        assert out, name
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in out) in (["1", "2", "4"], ["1", "2", "4", "None"])
        if name == "sharding":
            assert len(out) == len(rows)


def test_texts_with_null_and_shared_ids_are_told_apart(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (6, text("e")), (6, text("e")), (None, text("e")), (7, text("c"))]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), r[1][0]) for r in corpus_pipeline.near_duplicates(spark, base, SF).collect())
    assert got == [("5", "c"), ("5", "d"), ("6", "e"), ("None", "a"), ("None", "b")]
    item = spark.createDataFrame([(1, text("a")), (2, text("c"))], "item_id long, text string")
    left = sorted((str(r[0]), r[1][0]) for r in decontaminate.remove_leaks(base, item).collect())
    assert left == [("5", "d"), ("6", "e"), ("6", "e"), ("None", "b"), ("None", "b"), ("None", "e")]


def test_columns_named_like_the_operators_own_come_back(spark):
    text = " ".join(f"word{i}." for i in range(60)) + "\nhome | about | contact"
    names = ["kept", "n_words", "lost_words", "clean_text", "m_n_words", "base_failed", "size", "target", "source_size", "repeats", "a.b", "root", "node", "id"]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    base = spark.createDataFrame([(k, text.replace("word", f"w{k}x"), "s", 5, *[f"mine-{c}" for c in names]) for k in range(4)], schema)
    docs = base
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns[:len(base.columns)] == base.columns or set(base.columns) <= set(docs.columns), name
        assert [f.dataType for f in docs.schema.fields if f.name in base.columns] == [f.dataType for f in base.schema.fields], name
        rows = docs.collect()
        assert rows and all(r[c] == f"mine-{c}" for r in rows for c in names), name
        assert all("about" not in r["text"] and r["n_chars"] == len(r["text"]) for r in rows), name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and set(out.columns) >= {"doc_id", "text", "shard", "slot"}


def test_runs_of_texts_are_small_and_change_no_shingle():
    text = lambda name: " ".join(f"{name}{i}" for i in range(120_000))
    batch = pa.record_batch([pa.array([text("a"), None, text("b"), text("c"), "d"])], ["text"])
    runs = list(neardup.slices(batch, "text"))
    assert len(runs) >= 3 and [t for b in runs for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    whole = neardup.shingle_counts(batch.column("text"))[1]
    parts = np.concatenate([neardup.shingle_counts(b.column("text"))[1] for b in runs])
    assert (np.sort(whole) == np.sort(parts)).all()


def test_fixed_rows_start_no_python_workers(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five "), F.floor(F.col("id") / 2)).alias("text"))

    def refuse(*_, **__):
        raise AssertionError("rows from a Python list")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    placed = sharding.shard(docs, F.col("text"), F.lit(5), 4, max_nodes=16).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in placed) == [150, 150, 150, 150]
    assert neardup.rooted(docs).groupBy("root").count().where("count >= 2").agg(F.sum("count")).first()[0] == 600
