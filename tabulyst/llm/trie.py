"""Prefix tries of conversations: subtree totals by time-forward processing.

A node is a sequence of first turns (role, text); the root is the empty sequence. A conversation is a
member of the nodes it starts with. Each node has its members, children, leaves below it and the
words that sharing saves below it.

**Nodes.** A task reads the turns of its conversations in order and chains digests, so equal sequences have equal
16-byte keys; one grouping by key makes the table of nodes.

**Shards.** The turns that lie at or below a node, counted once per member, bound the nodes of its
subtree. The bound falls from parent to child, so a limit cuts the trie: nodes within the limit hang together below
shard roots, whose parents exceed it. Limits grow by ``GROWTH`` until the root is within the last; level j has
the nodes between two limits. At one depth at most ``GROWTH`` nodes of a shard can exceed the lower limit, so shards of
all levels stay small, whatever a start that a third of all conversations share.

**Time-forward processing.** The nodes of a level are sorted by shard in reverse level order (deepest first), by
Spark's external sort. Reading them in this order, a task takes the messages that were addressed to a node from a priority
queue, adds them up and sends its own total to its parent's place in the order (:class:`SpillingQueue` writes sorted runs to the
task's scratch file when it holds more than its limit). A shard root's total leaves the shard; totals for the
same parent are summed by Spark and start the next level.

**Ends.** The ids that end at a node are packed into texts by range partitions of (node, id) and then
read in order by a running SHA-256, so that a node where a third of all conversations end sends packed texts, not rows.

Defined cases: null roles and texts count as empty; turns are ordered by turn (null first), then role, then text; rows
with a null id belong to no conversation; repeated rows are turns of their own; an empty table gives an
empty result; a conversation without turns is a member of the root alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.llm.common import WORD, per_key, written

ROOT = hashlib.sha256(b"").digest()[:16]
#: Turns below the shard roots of the first level, and the growth of the limit from level to level.
SHARD_TURNS, GROWTH = 50_000, 64
#: Messages that a queue holds in memory.
QUEUE_MESSAGES = 200_000
_PACKED = 1 << 16


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place`` (from 1), ``role, text``: the turns of each conversation in order."""
    clean = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return clean.select("conv_id", place.cast("long").alias("place"), "role", "text")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and parent keys of the turns, conversation by conversation; each begins with its row of place 0."""
    node, depth = ROOT, 0
    for b in batches:
        nodes, parents, depths = [], [], []
        for place, role, text in zip(b.column("place").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if place == 0:
                node, depth, parent = ROOT, 0, None
            else:
                role, parent = role.encode(), node
                node = hashlib.sha256(b"%b%d:%b%b" % (node, len(role), role, text.encode())).digest()[:16]
                depth += 1
            nodes.append(node)
            parents.append(parent)
            depths.append(depth)
        yield pa.record_batch([b.column("conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column("words")],
                              ["conv_id", "depth", "node", "parent", "words"])


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, words, length``: one row per conversation and node it starts with.

    ``turns``: ``conv_id, place`` (from 1, ascending), ``role, text``; ``convs``: all ``conv_id``, also those without turns.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    heads = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("words"))
    rows = turns.select("conv_id", "place", "role", "text", words.alias("words")).unionByName(heads)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    out = rows.mapInArrow(_chained, "conv_id long, depth long, node binary, parent binary, words long")
    return out.withColumn("length", F.max("depth").over(Window.partitionBy("conv_id")))


class SpillingQueue:
    """A priority queue of tuples: the least come out first; beyond ``most`` in memory, sorted runs go to a scratch file."""

    def __init__(self, most: int | None = None):
        self.most = most or QUEUE_MESSAGES
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.file = None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # gone with the task
        self.heap.sort()
        places = []
        for lo in range(0, len(self.heap), 4096):
            places.append(self.file.seek(0, 2))
            pickle.dump(self.heap[lo: lo + 4096], self.file)
        self.heap = []
        self._next(self._run(places), len(self.runs))

    def _run(self, places: list[int]) -> Iterator[tuple]:
        for at in places:
            self.file.seek(at)
            yield from pickle.load(self.file)

    def _next(self, run: Iterator[tuple], number: int) -> None:
        for item in run:
            heapq.heappush(self.runs, (item, number, run))
            return

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = heapq.heappop(self.runs)
            self._next(run, number)
            return item
        return heapq.heappop(self.heap)


_TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the nodes, which come shard by shard in reverse level order."""
    queue, shard = SpillingQueue(), None
    for b in batches:
        out: list[list[int]] = [[], [], []]
        for row in zip(*(b.column(c).to_pylist() for c in ("shard", "depth", "node", "parent", "n_convs", "words", *_TOTALS))):
            own, depth, node, parent, n_convs, words, children, leaves, saved = row
            if own != shard:
                if queue.least() is not None:
                    raise RuntimeError("a shard ended before all its totals were taken")
                shard = own
            place = (-depth, node)
            while (message := queue.least()) is not None and message[:2] <= place:
                if message[:2] < place:
                    raise RuntimeError("a total passed its node by")
                queue.pop()
                children, leaves, saved = children + 1, leaves + message[2], saved + message[3]
            leaves = leaves if children else 1
            saved += (n_convs - 1) * words
            if node != own:
                queue.push((1 - depth, parent, leaves, saved))
            for column, value in zip(out, (children, leaves, saved)):
                column.append(value)
        keep = [c for c in b.schema.names if c not in _TOTALS]
        yield pa.record_batch([*[b.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in out]], [*keep, *_TOTALS])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node as texts of bounded length."""
    node, first, ids, size = None, None, [], 0
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])
        rows.clear()
        return out

    for b in batches:
        for at, i in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (at != node or size > _PACKED):
                rows.append((node, first, ",".join(ids)))
                ids, size = [], 0
                if len(rows) >= 1000:
                    yield flush()
            if not ids:
                node, first = at, i
            ids.append(str(i))
            size += len(ids[-1]) + 1
    if ids:
        rows.append((node, first, ",".join(ids)))
    if rows:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, running = None, None
    for b in batches:
        done: list[tuple] = []
        for at, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
            if at != node:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = at, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the members (:func:`members`) that end at a node: their ids ascending, comma-joined."""
    ending = rows.where("depth = length").select("node", "conv_id")
    packed = ending.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_packed, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per node: ``node, parent`` (keys), ``conv_id`` (least member), ``depth, parent_conv_id, n_convs, words``
    (of its last turn), ``n_children, n_leaves, saved_tokens, ends_sha256``; arguments as in :func:`members`."""
    convs = turns.select("conv_id").distinct() if convs is None else convs
    rows = written(members(turns, convs), "trie-members")
    room = F.col("length") - F.col("depth") + 1
    total = rows.agg(F.coalesce(F.sum(F.when(F.col("depth") == 0, room)), F.lit(0))).first()[0]
    limits = [SHARD_TURNS]
    while limits[-1] < total:
        limits.append(limits[-1] * GROWTH)
    known = per_key(rows.withColumn("room", room), ["node"], F.col("conv_id"), {"b": F.sum("room"), "g": F.min("conv_id")},
                    {"bound": F.sum("b"), "least": F.min("g")}, salts=256)
    level = sum((F.col("bound") > x).cast("int") for x in limits)
    in_conv = Window.partitionBy("conv_id")
    known = known.withColumn("level", level).withColumns({
        "parent_conv_id": F.lag("least").over(in_conv.orderBy("depth")),
        "shard": F.min(F.struct("depth", "node")).over(Window.partitionBy("conv_id", "level"))["node"]})
    whole = ("depth", "parent", "parent_conv_id", "words", "level", "shard")
    nodes = written(known.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in whole]), "trie-nodes")
    done: list[DataFrame] = []
    for j in range(len(limits)):
        mine = nodes.where(F.col("level") == j)
        if done:
            sums = done[-1].where((F.col("node") == F.col("shard")) & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            if j > 1:  # parents can lie more than one level up
                sums = sums.unionByName(waiting).groupBy("node").agg(*[F.sum(c).alias(c) for c in _TOTALS])
            waiting = written(sums, "trie-totals")
            mine = mine.join(waiting, "node", "left")
            waiting = waiting.join(mine.select("node"), "node", "left_anti")
        else:
            mine = mine.withColumns({c: F.lit(None).cast("long") for c in _TOTALS})
        mine = mine.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in _TOTALS}).drop("level")
        mine = mine.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
        done.append(written(mine.mapInArrow(_forward, mine.schema), "trie-level"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(ends(rows), "node", "left").select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "words", *_TOTALS,
                                                       F.coalesce("ends_sha256", empty).alias("ends_sha256"))
