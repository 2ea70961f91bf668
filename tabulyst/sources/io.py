"""Reading and writing tables.

``read_table`` accepts a path (parquet, CSV, JSON, ORC by extension or an explicit
format) or inline CSV text; ``read_csv_rows`` reads a distributed dataset of CSV
lines. Inline text is only meant for small inputs: large data is read by path so
that the scan is split across executors.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.expressions import col_

_EXT = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".txt": "csv"}


def _guess_format(path: str) -> str:
    p = path.rstrip("/").lower()
    for ext, fmt in _EXT.items():
        if p.endswith(ext):
            return fmt
    return "parquet"


def read_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a table from a path, or from inline CSV text.

    Text holding a newline or a comma is treated as inline CSV (header row first,
    schema inferred), anything else as a path. Failures become ``ValueError``.
    """
    try:
        if fmt is None and ("\n" in source or "," in source):
            return read_csv_rows(spark, [ln for ln in source.strip().splitlines()])
        fmt = fmt or _guess_format(source)
        reader = spark.read.options(**options)
        if fmt == "csv":
            return reader.option("header", options.get("header", True)).option(
                "inferSchema", options.get("inferSchema", True)).csv(source)
        return reader.format(fmt).load(source)
    except Exception as exc:  # noqa: BLE001 - surface as a single error type
        raise ValueError(f"could not read table: {exc}") from exc


#: The type lattice of CSV cells, narrowest first; a column takes the first type that reads all its cells.
CSV_TYPES = ["int", "bigint", "double", "timestamp", "boolean", "string"]


def infer_csv_schema(cells: DataFrame) -> T.StructType:
    """Types of a table of text cells: one aggregate over the lattice, counting per column and type the cells that do not fit."""
    names = cells.columns

    def misfits(c: Column, kind: str) -> Column:
        whole = c.rlike(r"^\s*[+-]?[0-9]+\s*$")
        number = c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$") | F.lower(F.trim(c)).isin("nan", "inf", "-inf", "infinity", "-infinity")
        fits = {"int": whole & c.try_cast("int").isNotNull(), "bigint": whole & c.try_cast("bigint").isNotNull(), "double": number & c.try_cast("double").isNotNull(),
                "timestamp": c.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") & c.try_cast("timestamp").isNotNull(), "boolean": F.lower(F.trim(c)).isin("true", "false")}[kind]
        return F.count_if(c.isNotNull() & ~fits)

    kinds = CSV_TYPES[:-1]
    row = cells.agg(*[F.struct(F.count(col_(c)).alias("n"), *[misfits(col_(c), k).alias(k) for k in kinds]).alias(f"c{i}") for i, c in enumerate(names)]).first()
    found = [next((k for k in kinds if r["n"] and r[k] == 0), "string") for r in row]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(names, found)])


def read_csv_rows(spark: SparkSession, rows, header: bool | list[str] = True, infer_schema: bool = True) -> DataFrame:
    """A typed table of CSV lines (a list of strings or a DataFrame with one string column), parsed by the JVM.

    ``header``: True takes the first line of a list, or that line of a table which its partitions yield first; a list gives the
    names. Lines that repeat the header are left out. Empty cells are null; blank lines are skipped; a line with fewer cells ends in nulls. Types come from
    one aggregate over all cells (:func:`infer_csv_schema`).
    """
    if isinstance(rows, DataFrame):
        lines = rows.select(col_(rows.columns[0]).cast("string").alias("line"))
    else:
        lines = spark.createDataFrame([(str(r),) for r in rows], "line string")
    lines = lines.where(F.trim("line") != "")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    if isinstance(header, (list, tuple)):
        names = list(header)
    else:
        cells = next(csv.reader([first[0]]))
        names = [x.strip() or f"_c{i}" for i, x in enumerate(cells)] if header else [f"_c{i}" for i in range(len(cells))]
    if header is True:
        lines = lines.where(F.col("line") != first[0])
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # one parse; an empty cell is null whatever its type
    parsed = lines.select(F.from_csv("line", plain.simpleString()[len("struct<"):-1].replace(":", " "), {"mode": "PERMISSIVE", "escape": '"', "nullValue": ""}).alias("r"))
    texts = parsed.select(*[F.nullif(F.col(f"r.c{i}"), F.lit("")).alias(c) for i, c in enumerate(names)])
    if not infer_schema:
        return texts
    schema = infer_csv_schema(texts)
    return texts.select(*[F.trim(col_(f.name)).cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else col_(f.name) for f in schema])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write rows (cleaned, non-anomalous, labelled, ...) to files, in parallel."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
