"""Sharding: minimax contiguous partition over ordered atomic groups.

Rows with equal ``key`` are one atomic group, and groups are ordered by ``key``.
The operator finds the smallest capacity C such that the ordered groups can be
cut into ``n_shards`` contiguous runs of at most C each (a binary search whose
check cuts greedily), and cuts greedily at that capacity.

No step holds all group sizes in one place. The ordered groups are summarised
by key prefixes (a trie over hexadecimal digits). Whether a capacity is
feasible is bracketed from a summary: treating each prefix as indivisible gives
a capacity that certainly works, treating it as freely divisible one below
which nothing works. Only prefixes that some greedy cut can fall into are split
further, so each round reads the group table once and brings a bounded summary
(``max_nodes`` sums) to the driver. When every open prefix is one group, the
bracket is exact.

Defined cases: an empty table gives an empty result; rows with a null key form
one group before all others; a null size counts as 0; more shards than groups
leaves the last shards empty; repeated rows are separate rows of one group.
Columns named like the outputs are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabulyst.llm.common import checked_broadcast, written

#: Rows per bucket of the slot numbering; the number of buckets follows the table.
SLOT_ROWS = 20_000


def _hex_key(df: DataFrame, key: Column) -> Column:
    """Upper-case hexadecimal of the key's bytes (a text's UTF-8); a null key sorts first."""
    binary = isinstance(df.select(key.alias("k")).schema["k"].dataType, T.BinaryType)
    return F.coalesce(F.hex(key if binary else key.cast("string").cast("binary")), F.lit(""))


class _Node:
    """Summary of the groups below one prefix, in order."""

    __slots__ = ("prefix", "size", "groups")

    def __init__(self, prefix: str, size: int, groups: int):
        self.prefix, self.size, self.groups = prefix, size, groups


def _sums(groups: DataFrame, open_prefixes: list[str], length: int) -> list[_Node]:
    """Group sizes summed by the first ``length`` digits, below the open prefixes."""
    cut = F.substring("__key", 1, length)
    rows = groups
    if open_prefixes != [""]:
        known = len(open_prefixes[0])
        wanted = groups.sparkSession.createDataFrame(pa.table({"__p": pa.array(open_prefixes, pa.string())}))  # as Arrow, so no Python worker starts
        rows = groups.withColumn("__p", F.substring("__key", 1, known)).join(F.broadcast(wanted), "__p", "left_semi")
    got = rows.groupBy(cut.alias("p")).agg(F.sum("__size").alias("s"), F.count("*").alias("n")).collect()
    return [_Node(r["p"], int(r["s"]), int(r["n"])) for r in sorted(got, key=lambda r: r["p"])]


def _greedy(ends: list[int], capacity: int, n_shards: int) -> list[int] | None:
    """Greedy cut positions (as sums) over indivisible nodes, or None if more than ``n_shards`` are needed."""
    cuts, at = [], 0
    for _ in range(n_shards):
        if at >= ends[-1]:
            break
        i = bisect_right(ends, at + capacity) - 1
        reached = ends[i] if i >= 0 else 0
        if reached <= at:
            return None
        at = reached
        cuts.append(at)
    return cuts if at >= ends[-1] else None


def minimax_cuts(groups: DataFrame, n_shards: int, max_nodes: int = 16_384) -> tuple[int, list[str]]:
    """Smallest capacity and the hexadecimal keys at which shards 1, 2, ... begin.

    ``groups`` has one row per group: ``__key`` (hexadecimal, unique) and
    ``__size``. The driver holds at most about ``max_nodes`` prefix sums a round.
    """
    longest = groups.agg(F.max(F.length("__key"))).first()[0]
    if longest is None:
        return 0, []
    length, nodes = min(longest, 3), None
    fresh = _sums(groups, [""], length)
    done: list[_Node] = []
    while True:
        nodes = sorted(done + fresh, key=lambda x: x.prefix)
        ends, total = [], 0
        for x in nodes:
            total += x.size
            ends.append(total)
        starts = [e - x.size for e, x in zip(ends, nodes)]
        atomic_max = max((x.size for x in nodes if x.groups == 1), default=0)
        high = _search(lambda c: _greedy(ends, c, n_shards) is not None, max(x.size for x in nodes), total)
        low = _search(lambda c: _fluid(nodes, starts, ends, c, n_shards) is not None, max(atomic_max, -(-total // n_shards)), high)
        early, late = _earliest(nodes, starts, ends, low, n_shards), _fluid(nodes, starts, ends, high, n_shards)
        late += [total] * (n_shards - len(late))
        touched = set()
        for a, b in zip(early, late):
            i = max(0, bisect_right(starts, a) - 1)
            while i < len(nodes) and starts[i] < b:
                if nodes[i].groups > 1:
                    touched.add(i)
                i += 1
        if low < high:
            biggest = max((x.size for x in nodes if x.groups > 1), default=0)
            if biggest > low:  # the largest undivided prefix may hold a group larger than the bracket
                touched |= {i for i, x in enumerate(nodes) if x.groups > 1 and x.size > low}
        if not touched:
            cuts = _greedy(ends, high, n_shards) or []
            at = {e: i for i, e in reversed(list(enumerate(ends)))}
            return high, [nodes[at[c] + 1].prefix for c in cuts[:-1]]
        opened = [nodes[i].prefix for i in sorted(touched)]
        done = [x for i, x in enumerate(nodes) if i not in touched]
        digits = 1
        while len(opened) * 16 ** (digits + 1) <= max_nodes:
            digits += 1
        fresh, known = [], sorted({len(p) for p in opened})
        for n in known:  # all fresh prefixes of a round have one length, so this is one pass but for mixed rounds
            fresh += _sums(groups, [p for p in opened if len(p) == n], n + digits)


def _search(works, low: int, high: int) -> int:
    """Smallest value in [low, high] that works; ``high`` works."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if works(mid) else (mid + 1, high)
    return low


def _fluid(nodes, starts, ends, capacity: int, n_shards: int) -> list[int] | None:
    """Latest greedy positions: prefixes of several groups count as freely divisible."""
    at, cuts = 0, []
    for _ in range(n_shards):
        if at >= ends[-1]:
            break
        to = at + capacity
        i = bisect_right(ends, to)
        if i < len(nodes) and nodes[i].groups == 1:
            to = starts[i]
        elif i == len(nodes):
            to = ends[-1]
        if to <= at:
            return None
        at = to
        cuts.append(at)
    return cuts if at >= ends[-1] else None


def _earliest(nodes, starts, ends, capacity: int, n_shards: int) -> list[int]:
    """Earliest greedy positions: a cut inside a prefix of several groups may fall as early as its start."""
    at, cuts = 0, []
    for _ in range(n_shards):
        i = bisect_right(ends, at + capacity)
        at = max(at, starts[i]) if i < len(nodes) else ends[-1]
        cuts.append(at)
    return cuts


def shard(df: DataFrame, key: Column, size: Column, n_shards: int, max_nodes: int = 16_384,
          slot_order: Column | None = None) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shards are contiguous runs of the groups ordered by ``key``, balanced by
    ``size``. Slots follow a seeded hash order within the shard, then
    ``slot_order`` (default: the key); rows that are equal in both take their
    slots in any order. Scaling: one shuffle of (key, size) with map-side sums,
    bounded summaries on the driver, a literal comparison per row (no join), and
    one shuffle for the slots, over buckets whose number follows the row count.
    """
    rows = df.drop("shard", "slot").withColumn("__key", _hex_key(df, key)).withColumn("__rows", F.lit(1))
    groups = written(
        rows.groupBy("__key").agg(F.sum(F.coalesce(size.cast("long"), F.lit(0))).alias("__size")), "shard-groups")
    # a group of size 0 still needs a place of its own in the order
    _, begins = minimax_cuts(groups, n_shards, max_nodes)
    number = F.lit(0)
    for b in begins:
        number = number + (F.col("__key") >= F.lit(b)).cast("int")
    placed = rows.withColumn("shard", number.cast("int"))
    order = F.col("__key") if slot_order is None else slot_order
    n_rows = df.count()
    buckets = max(8, n_rows // SLOT_ROWS)
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64(F.col("__key"), order), F.lit(buckets)))
    counts = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(counts.select("shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__before")), "shard-offsets")
    inside = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy(order, "__key")) - 1
    return (
        placed.join(checked_broadcast(offsets), ["shard", "__bucket"])
        .withColumn("slot", (F.col("__before") + inside).cast("long"))
        .drop("__key", "__rows", "__bucket", "__before")
    )
