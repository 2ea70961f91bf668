"""A training corpus from ``documents``: quality rules, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame with the columns of ``documents`` (the last adds
``shard`` and ``slot``). :func:`run` writes every stage as Parquet to the shared folder
and rereads it as the next one's ``docs``.

* quality: documents rejected by the rules go; the others lose their failing lines.
* near duplicates: of each group the document with the least id stays.
* decontamination: documents into which a benchmark item leaks go.
* mixing: documents are repeated or left out to meet their source's target.
* sharding: 16 shards of near equal bytes, equal texts together.

An empty table passes all stages as an empty table. Columns that are named like an operator's own ones (``kept``, ``size``, ...)
come back as they were: quality and mixing see the text, id and source alone and carry the row beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyst.llm import decontaminate, mixing, neardup, queries, sharding
from tabulyst.llm.common import written
from tabulyst.session import ship_package


ROW = "__pipeline_row"


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and, as one struct, the whole row, out of the way of what operators add."""
    return docs.select(F.struct("*").alias(ROW), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    changed = F.col("lost_words") > 0
    kept = queries.judged(carried(docs, "text")).where("kept")
    own = {c: F.col(ROW).getField(c) for c in docs.columns}
    own["text"] = F.when(changed, F.col("clean_text")).otherwise(F.col("text"))
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("clean_text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[value.alias(c) for c, value in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship_package(spark)
    return neardup.remove_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark leaks."""
    return decontaminate.remove_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = carried(docs, "doc_id", "source", "text").withColumn("size", queries.n_words(F.col("text"))).drop("text")
    weights = mixing.cyclic_weights(docs, queries.MIX_WEIGHTS)
    mixed = mixing.mix(sized, weights, queries.MIX_SHARE, queries.MIX_EPOCHS, "doc_id")
    return mixed.select(ROW, F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select(f"{ROW}.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` and ``slot``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return sharding.shard(docs, neardup.node_of(F.col("text")), size, queries.SHARDS, slot_order=F.col("doc_id"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing_sources", mixing_sources), ("sharding", shards)]

#: The draws of near duplicates and of mixing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
