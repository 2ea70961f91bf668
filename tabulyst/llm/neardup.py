"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Equal texts are one node. A node's shingles (windows of five words) weigh
``(1 + ln tf) * idf``. Improved consistent weighted sampling draws, for each of
``bands * rows`` seeds, one (shingle, level) such that two nodes draw the same one
with a probability equal to their weighted Jaccard similarity. Nodes that agree
on all draws of a band share a bucket; pairs are verified by the exact weighted Jaccard
similarity of their shingles, and the linked nodes' components are the groups.

**idf.** Document frequencies are counted over all documents, in 2**18 cells by
shingle hash (a table of fixed size; what an average cell holds is
subtracted). Shingles in fewer than ``rare`` of all documents count as rare and weigh 1; a shingle
that all hold weighs ``1 - strength``. The range is narrow on purpose: a large family of near
copies raises the document frequency of its own shingles, and a steep idf would
then tear it apart.

**Buckets.** Nothing pairs all members of a bucket. The first round verifies a bucket's
members against one pivot, the member with the most company in its buckets. Members
within the distance ``1 - threshold`` of the pivot are linked to it. The others stay,
together with the linked members that the triangle inequality (the
weighted Jaccard distance is a metric) still allows to be near one of them. Then, round by round, a member
leaves when the shingles that it shares with any other remaining node weigh too little for
a similarity of the threshold, and a bucket leaves when all that stays lies in one component.
What is left is verified against one in 64, then one in 8, then all of the nodes, each pair once, between
different components and where the bound allows it. So no link between different components is lost
inside a bucket and no partner is capped, while few nodes reach the last round.

Scaling: no task gets a whole bucket (:func:`_by_bucket`). Texts are read twice for counts and draws and once for the candidates'
shingles; shuffles carry draws, candidates and links only. A hot pivot's shingles are
copied to 64 sub-keys. Components come from alternating star
contraction over written tables; nothing but counts and the fixed cell table reaches the driver.

Defined cases: null texts count as empty; texts of fewer than five words have no shingles and
group with equal texts alone; an empty table gives an empty result; rows with a null
id get groups as others do, ids being compared null last; repeated rows share class and group;
other columns are ignored here and kept by :func:`remove_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyst.llm.common import BROADCAST_ROWS, checked_broadcast, per_key, written
from tabulyst.llm.hashing import mix64, window_hashes, word_hashes

SHINGLE = 5
CELL_BITS = 18
#: Values of the tables that the sampling's random variables are drawn from.
_DRAWS = 1 << 16


def node_of(text: Column) -> Column:
    """The node of a text: 16 bytes of its SHA-256 (null: empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def shingle_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text: (text, hash, tf), ordered by text and hash."""
    h, doc = window_hashes(*word_hashes(texts), SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a worker's hashes and sorts take many times a run's bytes."""
    sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def shingle_idf(docs: DataFrame, text: str, rare: float, strength: float) -> np.ndarray:
    """Weight by cell (see the module): counted over all rows of ``docs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << CELL_BITS, np.int64), 0
        for whole in batches:
            n += whole.num_rows
            for batch in slices(whole, "text"):
                _, h, _ = shingle_counts(batch.column("text"))
                cells += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(cells[some], n), pa.int64())], ["cell", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell int, n long")
    got = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2**18 + 1 rows
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    total = float(n[cell == -1].sum())
    counts = np.zeros(1 << CELL_BITS)
    counts[cell[cell >= 0]] = n[cell >= 0]
    share = (counts - np.median(counts)) / max(1.0, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = np.clip(1 - np.log(np.clip(share, 1e-12, 1)) / np.log(rare), 0, 1)
    return (1 - strength * np.where(share > rare, common, 0)).astype(np.float32)


def _tables():
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
    return r, np.log(rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32), rng.random(_DRAWS, dtype=np.float32)


def draws(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, seeds: int) -> np.ndarray:
    """Consistent weighted samples, (n_docs, seeds): the drawn (shingle, level) as one number; 0 for no shingles.

    For shingle weight w and the shingle's own random r, c ~ Gamma(2, 1) and
    b ~ U(0, 1): level t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r); the least a wins.
    """
    table_r, table_c, table_b = _tables()
    out = np.zeros((n_docs, seeds), np.uint64)
    if not len(h):
        return out
    log_w = np.log(weight)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    lengths = np.diff(np.append(starts, len(doc)))
    which = np.repeat(np.arange(len(starts)), lengths)
    low = np.uint64(0xFFFF)
    for k in range(seeds):
        g = mix64(h + np.uint64((k * 0xA0761D6478BD642F + 0x1234567) % (1 << 64)))
        r, c, b = (table_r[(g & low).astype(np.int32)], table_c[((g >> np.uint64(16)) & low).astype(np.int32)], table_b[((g >> np.uint64(32)) & low).astype(np.int32)])
        t = np.floor(log_w / r + b)
        a = c - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[which])
        _, first = np.unique(which[hit], return_index=True)
        pos = hit[first]
        out[doc[pos], k] = mix64(h[pos] ^ (t[pos].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def signatures(docs: DataFrame, text: str, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """``node, keys`` (one long per band) of each row of five or more words."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(idf)  # 2**18 floats

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, h, tf = shingle_counts(batch.column("text"))
                w = (1 + np.log(tf)) * table.value[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                got = draws(doc, h, w.astype(np.float32), batch.num_rows, bands * rows)
                some = np.unique(doc)
                keys = np.zeros((len(some), bands), np.uint64)
                for j in range(rows):
                    keys = mix64(keys * np.uint64(31) + got[some, j::rows] + np.uint64(j + 1))
                flat = pa.array(keys.astype(np.int64).ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), flat)
                yield pa.record_batch([batch.column("node").take(pa.array(some)), lists], ["node", "keys"])

    rows_ = docs.select(node_of(F.col(text)).alias("node"), F.col(text).cast("string").alias("text"))
    return rows_.mapInArrow(draw, "node binary, keys array<long>")


def shingle_sets(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """``node, set`` for the wanted nodes: all shingle hashes in order with repeats, cut to 48 bits."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, doc = window_hashes(*word_hashes(batch.column("text")), SHINGLE)
                order = np.lexsort((h, doc))
                h, at = h[order], np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
                high, lowest = (h >> np.uint64(32)).astype("<u4"), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2")
                sets = [high[a:b].tobytes() + lowest[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    rows = docs.select(node_of(F.col(text)).alias("node"), F.col(text).cast("string").alias("text"))
    kept = rows.join(checked_broadcast(nodes), "node", "left_semi")
    # equal texts of a hot class are cut to one per task before the shuffle
    return kept.mapInArrow(pack, "node binary, set binary").groupBy("node").agg(F.first("set").alias("set"))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (48 bits) and their counts."""
    n = len(packed) // 6
    high, low = np.frombuffer(packed, "<u4", n), np.frombuffer(packed, "<u2", n, 4 * n)
    h = (high.astype(np.uint64) << np.uint64(16)) | low.astype(np.uint64)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if n else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, n))


def weighted_jaccard(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger weights; 0 if both are empty."""
    (ha, ta), (hb, tb) = unpack(a), unpack(b)
    wa, wb = ((1 + np.log(t)) * idf[(h >> np.uint64(48 - CELL_BITS)).astype(np.int64)] for h, t in ((ha, ta), (hb, tb)))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[ia], wb[ib]).sum()
    total = wa.sum() + wb.sum() - shared
    return float(shared / total) if total > 0 else 0.0


def similarities(pairs: DataFrame, sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """``pivot, node, sim`` for distinct pairs; a hot pivot is spread over 64 sub-keys."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [weighted_jaccard(x.as_py(), y.as_py(), table.value) for x, y in zip(b.column("a"), b.column("b"))]
            yield pa.record_batch([b.column("pivot"), b.column("node"), pa.array(sims, pa.float64())], ["pivot", "node", "sim"])

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    pivots = checked_broadcast(written(salted.select("pivot", "salt").distinct(), "pivots")).join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("a")), "pivot")
    members = checked_broadcast(salted).join(sets.withColumnRenamed("set", "b"), "node")
    both = members.join(pivots, ["pivot", "salt"]).select("pivot", "node", "a", "b")
    return both.mapInArrow(score, "pivot binary, node binary, sim double")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node; root is the least node of its component.

    Alternating star contraction: each step points a node's neighbours at its
    least neighbour; steps repeat until the links no longer change.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hint = F.broadcast if edges.count() <= BROADCAST_ROWS // 2 else (lambda x: x)
        large = both.join(hint(both.groupBy("u").agg(F.min("v").alias("m"))), "u")
        large = written(large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v"), "links")
        small = large.join(hint(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        edges = written(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                        .select("e.*").where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _by_bucket(members: DataFrame, first: dict[str, Column], then: dict[str, Column], keep: str = "true") -> DataFrame:
    """``members`` with aggregates of their bucket (``first`` and ``then`` as in :func:`per_key`), of the buckets that ``keep`` holds for.

    No task gets a whole bucket: a bucket's rows are summed up where they are, and its one row is broadcast to them, or past the
    broadcast bound meets them in 32 sub-keys.
    """
    part = members.groupBy("band", "key").agg(*[c.alias(n) for n, c in first.items()])
    total = written(part.groupBy("band", "key").agg(*[c.alias(n) for n, c in then.items()]).where(keep), "buckets")
    if total.count() <= BROADCAST_ROWS:
        return members.join(F.broadcast(total), ["band", "key"])
    return per_key(members, ["band", "key"], F.col("node"), first, then).where(keep).drop("__salt")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold nodes of two or more components."""
    ends = {"lo": F.min("root"), "hi": F.max("root")}
    return _by_bucket(members, ends, {"lo": F.min("lo"), "hi": F.max("hi")}, "lo <> hi").drop("lo", "hi")


def _choose(both: DataFrame, mine: DataFrame, salts: int) -> DataFrame:
    """Each member beside the chosen ones of its bucket; past the broadcast bound a bucket's members meet them in ``salts`` sub-keys."""
    if mine.count() <= BROADCAST_ROWS:
        return both.join(F.broadcast(mine), ["band", "key"])
    salted = both.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    copies = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["band", "key", "salt"]).drop("salt")


def overlap_bounds(sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """``node, total, most``: a node's whole weight, and the weight of its shingles that any other of these nodes has.

    No similarity with another of these nodes can rest on more than ``most``.
    """
    table = sets.sparkSession.sparkContext.broadcast(idf)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, packed in zip(b.column("node"), b.column("set")):
                h, t = unpack(packed.as_py())
                w = (1 + np.log(t)) * table.value[(h >> np.uint64(48 - CELL_BITS)).astype(np.int64)]
                yield pa.record_batch([pa.array([node.as_py()] * len(h), pa.binary()), pa.array(h.astype(np.int64)), pa.array(w, pa.float64())], ["node", "shingle", "w"])

    rows = sets.mapInArrow(spread, "node binary, shingle long, w double")
    holders = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("own"), F.first("w").alias("own_w"))
    alone = holders.where("n = 1").groupBy(F.col("own").alias("node")).agg(F.sum("own_w").alias("alone"))
    total = rows.groupBy("node").agg(F.sum("w").alias("total"))
    return written(total.join(alone, "node", "left").select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("most")), "overlap-bounds")


def _possible(members: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Members (with their bounds) whose bound leaves room for a partner in their bucket.

    A similarity t of weights x and y takes a shared weight of t / (1 + t) * (x + y),
    and y is at least t * x and at least the bucket's least weight.
    """
    known = members.join(bounds, "node")
    known = _by_bucket(known, {"least": F.min("total")}, {"least": F.min("least")})
    partner = F.greatest(F.col("total") * threshold, F.col("least"))
    need = threshold / (1 + threshold) * (F.col("total") + partner)
    return known.where(F.col("most") >= need * (1 - 1e-6)).drop("least")


def _linked(roots: DataFrame, sims: DataFrame, threshold: float) -> DataFrame:
    """Components after adding the pairs of at least the threshold."""
    new = sims.where(F.col("sim") >= threshold).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    if new.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "components")


def _no_roots(spark: SparkSession) -> DataFrame:
    """No ``node, root`` at all; rows from a Python list, even none, would start Python workers of their own beside those of the Arrow tasks."""
    return spark.range(0).select(*[F.lit(None).cast("binary").alias(c) for c in ("node", "root")])


def rooted(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 10, rows: int = 3,
           rare: float = 0.002, strength: float = 0.2) -> DataFrame:
    """One row per row of ``docs``: ``id, node, root``, the root being the same in a near-duplicate group.

    With 10 bands of 3 draws a pair at 0.8 shares a bucket with probability 0.999.
    """
    spark = docs.sparkSession
    idf = shingle_idf(docs, text, rare, strength)
    sig = written(signatures(docs, text, idf, bands, rows).groupBy("node").agg(F.first("keys").alias("keys")), "signatures")
    members = sig.select("node", "keys", F.posexplode("keys").alias("band", "key"))
    members = written(_by_bucket(members, {"company": F.count("*")}, {"company": F.sum("company")}, "company > 1"), "bucket-members")
    central = members.groupBy("node").agg(F.sum("company").alias("central"))
    members = members.drop("company").join(central, "node")
    sets = written(shingle_sets(docs, text, central.select("node")), "shingle-sets")
    roots = _no_roots(spark)
    # the first round: one pivot per bucket
    paired = _by_bucket(members, {"p": F.max(F.struct("central", "node"))}, {"pivot": F.max("p")["node"]})
    paired = written(paired.where("node <> pivot"), "bucket-pairs")
    pairs = written(paired.select("pivot", "node").distinct(), "pairs")
    sims = written(similarities(pairs, sets, idf), "similarities")
    roots = _linked(roots, sims, threshold)
    # what stays: members away from the pivot, and linked ones that may be near those
    seen = paired.join(sims, ["pivot", "node"])
    seen = _by_bucket(seen, {"far": F.max(F.when(F.col("sim") < threshold, F.col("sim")))}, {"nearest": F.max("far")}, "nearest IS NOT NULL")
    members = seen.where((F.col("sim") < threshold) | (F.col("sim") <= F.col("nearest") + 1 - threshold))
    for every in (64, 8, 1):
        members = members.select("band", "key", "node", "keys").join(checked_broadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        members = written(_mixed(members), "bucket-members")
        if members.isEmpty():
            break
        bounds = overlap_bounds(sets.join(members.select("node").distinct(), "node", "left_semi"), idf)
        members = _mixed(_possible(members, bounds, threshold))
        both = written(members.withColumn("chosen", F.pmod(F.xxhash64("node"), F.lit(every)) == 0), "bucket-members")
        mine = both.where("chosen").select("band", "key", *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "keys", "total", "most")])
        # a pair that shares several buckets comes from the first
        band = F.array_position(F.zip_with("keys", "p_keys", lambda x, y: x == y), True) - 1
        members = both.where(~F.col("chosen"))
        pairs = _choose(both, mine, 32 if every == 64 else 8).where(
            (F.col("root") != F.col("p_root")) & (~F.col("chosen") | (F.col("p_node") < F.col("node"))) & (band == F.col("band"))
            & (F.least("most", "p_most") >= threshold / (1 + threshold) * (F.col("total") + F.col("p_total")) * (1 - 1e-6)))
        pairs = written(pairs.select(F.col("p_node").alias("pivot"), "node"), "pairs")
        if pairs.isEmpty():
            continue
        sims = written(similarities(pairs, sets, idf), "similarities")
        roots = _linked(roots, sims, threshold)
    ids = docs.select(F.col(row_id).alias("id"), node_of(F.col(text)).alias("node"))
    return written(ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("id", "node", "root"), "document-nodes")


def groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``row_id, class_id, group_id, kept``.

    ``class_id``: least id of the rows with the same text; ``group_id``: least id
    of the near-duplicate group; ``kept``: whether the row has its group's id. ``options`` as in :func:`rooted`.
    """
    ids = rooted(docs, row_id, text, **options)
    ids = per_key(ids, ["root"], F.xxhash64("id", "node"), {"g": F.min("id")}, {"group_id": F.min("g")})
    ids = per_key(ids, ["node"], F.col("id"), {"c": F.min("id")}, {"class_id": F.min("c")})
    return ids.select(F.col("id").alias(row_id), "class_id", "group_id", F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


def remove_near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, the one with the least id (null last), then the least node; all columns stay as they are.
    Of rows that share id and text one stays; texts that only share an id or have none are told apart."""
    same = rooted(docs, row_id, text, **options).groupBy("root", "id", "node").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "n")).alias("least")
    keep = written(same.groupBy("root").agg(least).select(F.col("least.id").alias("__kept"), F.col("least.node").alias("__node"), F.col("least.n").alias("__n")), "kept-rows")
    rows = docs.withColumn("__text_node", node_of(F.col(text)))
    own = rows[row_id].eqNullSafe(keep["__kept"]) & (rows["__text_node"] == keep["__node"])
    out = rows.join(checked_broadcast(keep.select("__kept", "__node")), own, "left_semi")
    return (out if keep.where("__n > 1").isEmpty() else out.dropDuplicates([row_id, "__text_node"])).drop("__text_node")
