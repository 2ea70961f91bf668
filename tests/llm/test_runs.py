"""Sorted runs read back by ranges of keys."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tabulyst.llm import runs
from tabulyst.llm.common import new_folder
from tabulyst.llm.files import remove
from tabulyst.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_ranges_hold_all_rows_once(spark):
    rng = random.Random(1)
    folder, rows, made = new_folder(spark, "runs-test"), [], []
    for k in range(5):
        mine = [(rng.choice([b"", b"a", bytes(rng.choices(range(256), k=rng.randrange(9)))]), "é" * rng.randrange(3000), k) for _ in range(300)]
        rows += mine
        table = pa.table([pa.array([x for x, _, _ in mine], pa.binary()), pa.array([x for _, x, _ in mine]), pa.array([x for _, _, x in mine])], ["key", "text", "run"])
        made += runs.save(table, np.array([2 * len(x) + 8 for _, x, _ in mine]), folder).to_pylist()
    manifest = spark.createDataFrame(made, runs.MANIFEST)
    for bounds in ([b""], [b"", b"a"], [b"", b"\x20", b"a", b"a\0", b"\xf0"]):
        spans = runs.spans(manifest, bounds).collect()
        got = []
        for part in {r.part for r in spans}:
            batch = pa.RecordBatch.from_pylist([r.asDict() for r in spans if r.part == part])
            table = runs.load([batch], bounds, part)
            if table is not None:
                keys = table.column("key").to_pylist()
                assert min(keys) >= bounds[part] and (part + 1 == len(bounds) or max(keys) < bounds[part + 1])
                got += [tuple(r.values()) for r in table.to_pylist()]
        assert sorted(got) == sorted(rows)
    remove(folder)
    remove(folder)  # nothing there


def test_samples_of_like_runs_split_evenly(spark):
    """Forty runs with the same distribution of keys: ranges cut at their samples hold about equally many bytes."""
    rng = np.random.default_rng(3)
    folder, samples, keys = new_folder(spark, "runs-test"), [], []
    for _ in range(40):
        mine = [bytes(x) for x in rng.integers(0, 256, (400, 8), np.uint8)]
        keys += mine
        table = pa.table([pa.array(mine, pa.binary())], ["key"])
        samples += runs.save(table, np.full(400, 10_000), folder).to_pylist()[0]["samples"]
    assert len(samples) == 160
    cut = np.searchsorted(np.array(sorted(samples)[::16]), np.array(keys), side="right")
    assert np.bincount(cut)[1:].max() < 3 * len(keys) / 10
    remove(folder)
