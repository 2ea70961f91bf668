"""Sources, sinks and the per-micro-batch helper."""

from __future__ import annotations

import os
import tempfile

from tabulyst.operators import profile as P
from tabulyst.sources.io import read_csv_rows
from tabulyst.sources import io as IO
from tabulyst.sources import schema as S
from tabulyst.streaming import foreach_batch_tables


def test_inline_csv_and_roundtrip(spark):
    df = IO.read_table(spark, "a,b,c\n1,x,2.5\n2,,3.5\n3,z,")
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert P.missing_by_column(df).count() == 2
    out = os.path.join(tempfile.mkdtemp(prefix="tabulyst-io-"), "t")
    IO.write_table(df, out, fmt="csv")
    back = IO.read_table(spark, out, fmt="csv")
    assert back.count() == 3
    IO.write_table(df, out + "_pq")
    assert IO.read_table(spark, out + "_pq").count() == 3


def test_normalize_and_select(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x")], "v double, s string")
    n = S.normalize_missing(df, text=True).collect()
    assert n[0]["v"] is None and n[0]["s"] is None and n[1]["s"] == "x"
    used, ignored = S.select_columns(df, "v, nope")
    assert used == ["v"] and ignored == ["nope"]


def test_profile_per_micro_batch(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    base = tempfile.mkdtemp(prefix="tabulyst-stream-")
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(os.path.dirname(src)))
    q = foreach_batch_tables(stream, P.profile, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                             tables=["shape", "statistics"], kind="full")
    q.awaitTermination(120)
    shape = spark.read.parquet(os.path.join(base, "out", "shape"))
    assert shape.groupBy().sum("rows").first()[0] == spark.read.parquet(src).count()
    assert spark.read.parquet(os.path.join(base, "out", "statistics")).count() >= 3


def test_csv_lines_types_gaps_and_quotes(spark):
    lines = ["id,name,x.y,day,ok,big,mixed", '1,"a, ""b""",1.5,2024-01-02,true,5000000000,1', "", "2,,nan,2024-02-03 04:05:06,FALSE,7,z", "  ", "id,name,x.y,day,ok,big,mixed", "3,short"]
    want = [("id", "int"), ("name", "string"), ("x.y", "double"), ("day", "timestamp"), ("ok", "boolean"), ("big", "bigint"), ("mixed", "string")]
    for rows in (lines, spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)):
        got = read_csv_rows(spark, rows)
        assert got.dtypes == want
        out = {r["id"]: r for r in got.collect()}
        assert out[1]["name"] == 'a, "b"' and out[1]["big"] == 5_000_000_000 and out[1]["ok"] is True
        assert out[2]["name"] is None and out[2]["x.y"] != out[2]["x.y"] and out[2]["mixed"] == "z"
        assert tuple(out[3])[1:] == ("short", None, None, None, None, None)
    assert read_csv_rows(spark, ["1,2", "3,4"], header=False).columns == ["_c0", "_c1"]
    assert read_csv_rows(spark, ["7,x"], header=["a", "b"], infer_schema=False).first() == ("7", "x")
    assert read_csv_rows(spark, []).count() == 0
