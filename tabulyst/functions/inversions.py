"""Weighted discordant pairs of two ranked columns by distributed inversion counting.

Points are sorted by (X, Y), so a pair is discordant exactly when the earlier point has the larger
Y: ties in X never are, as their Y ascend. The order is cut into ``B`` blocks of about equal rows and Y into ``B`` cells. Every inverted pair is

* inside one block: counted there by merge levels;
* in two blocks but one cell: the cell's points, collapsed to (block, Y), are counted the same way;
* in two blocks and two cells: a discordant pair of the coarse table (block, cell, weight), which has
  at most a quarter of the points and is counted by the same three steps.

A level shuffles the points twice, and a group holds about ``BLOCK_POINTS`` points. A block is a
share of the rows' order: a value of X that holds a third of all rows is cut along the ranks of Y. Several column pairs are
counted together, ``pair`` being part of every key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct points of one group.
BLOCK_POINTS = 1_000_000


def inversions(y: np.ndarray, weight: np.ndarray) -> float:
    """Sum of ``weight[i] * weight[j]`` over i < j with ``y[i] > y[j]``, one bit of the ranks after the other."""
    if len(y) < 2:
        return 0.0
    rank = np.unique(y, return_inverse=True)[1]
    weight = weight.astype(np.float64)
    total = 0.0
    for bit in range(max(0, int(rank.max()).bit_length() - 1), -1, -1):
        # groups share the higher bits; inside one, points with the bit set are larger than those without
        one = (rank >> bit) & 1 == 1
        ahead = np.cumsum(np.where(one, weight, 0.0))
        group = rank >> (bit + 1)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.append(0.0, ahead)[starts]
        ahead -= np.repeat(base, np.diff(np.append(starts, len(rank))))
        total += float(np.dot(ahead[~one], weight[~one]))
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def _counted(points: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """``pair, d`` per group: inversions of ``second`` in the order of (``first``, ``second``)."""
    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in (first, second, "c")) for b in batches]
        x, y, c = (np.concatenate([r[i] for r in rows]) for i in range(3))
        order = np.lexsort((y, x))
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([inversions(y[order], c[order])])], ["pair", "d"])

    return points.select("pair", group, first, second, "c").groupBy("pair", group).applyInArrow(count, "pair int, d double")


def discordant(points: DataFrame, distinct: int, block_points: int | None = None) -> dict[int, float]:
    """Discordant weight of each pair.

    ``points``: ``pair, X, Y, c`` (distinct X, Y within a pair; c their rows) and ``at, yat``: the shares of rows before
    the point in the order of (X, Y) and of Y, both rising in that order and below 1. ``distinct``: most points of a pair.
    """
    limit = block_points or BLOCK_POINTS
    blocks = 1 if distinct <= limit else max(2, min(math.ceil(distinct / limit), int(math.sqrt(distinct) / 2)))
    share = lambda c: F.least(F.floor(F.col(c) * blocks), F.lit(blocks - 1)).cast("long")
    points = points.withColumns({"block": share("at"), "cell": share("yat")})
    found = _counted(points, "block", "X", "Y")
    if blocks > 1:
        found = found.unionByName(_counted(points.groupBy("pair", "cell", "block", "Y").agg(F.sum("c").alias("c")), "cell", "block", "Y"))
    out = {r["pair"]: r["d"] for r in found.groupBy("pair").agg(F.sum("d").alias("d")).collect()}
    if blocks > 1:
        coarse = points.groupBy("pair", F.col("block").alias("X"), F.col("cell").alias("Y")).agg(F.sum("c").alias("c")).withColumns({
            "yat": (F.col("Y") + 0.5) / blocks, "at": (F.col("X") + (F.col("Y") + 0.5) / blocks) / blocks}).persist()
        most = coarse.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
        for pair, d in discordant(coarse, most, limit).items():
            out[pair] = out.get(pair, 0.0) + d
        coarse.unpersist()
    return out
