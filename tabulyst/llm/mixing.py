"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

``fill_targets`` shares a total among sources in proportion to their weights,
clamps every source at ``max_epochs`` times its size, and shares the excess
among the others by weight until no source is above its clamp. Each round is one
aggregate over the table of sources; only two sums reach the driver.

``take`` gives every row of a source the whole repetitions
``floor(target / source size)`` and one more to a seeded part of its rows: rows
in the order of a seeded hash, for as long as their sizes fill the fraction. Rows larger than what is
left are then passed over and the order goes on, round by round until no row fits. So a source's taken size is
below its target by less than the smallest row with a size left out, and reruns agree. Each round but the first
starts with less left than the row that ended the one before, so rounds are few in a random order.

Scaling: a source may hold any share of the rows. Its hash order is cut into
buckets, about the square root of the row count many, so neither the prefix sums
over buckets nor those inside a bucket grow faster than that.

Defined cases: an empty table gives an empty result; null sources are one source;
null sizes and null or negative weights count as 0 (negative sizes are not allowed); if the clamps cannot hold
the total, all sources with a weight are taken ``max_epochs`` times; rows equal in source, id and size are taken alike.
Columns named like the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulyst.llm.common import written


def fill_targets(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (``source, weight, source_size``) with ``target`` (double).

    Rounds: the free sources share what the clamped ones leave; those above
    their clamp join the clamped. The loop ends when a round clamps none, after at most as
    many rounds as there are sources (in practice a few).
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rows = sources.withColumn("__w", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    level, clamped = 0.0, -1
    # A source is clamped once level * weight >= its clamp; the level only rises.
    while True:
        above = (F.col("__w") * F.lit(level) >= cap) if clamped >= 0 else F.lit(False)
        got = rows.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("used"),
                       F.sum(F.when(above, 0.0).otherwise(F.col("__w"))).alias("free"),
                       F.sum(above.cast("long")).alias("n")).first()
        if got["n"] is None or got["n"] == clamped or not got["free"]:
            break
        clamped = got["n"]
        level = (float(total) - got["used"]) / got["free"]
    if got["n"] is not None and not got["free"]:  # every source with a weight is clamped
        target = F.when(F.col("__w") > 0, cap).otherwise(0.0)
    else:
        target = F.least(cap, F.col("__w") * F.lit(level))
    return rows.withColumn("target", target).drop("__w")


def source_sizes(df: DataFrame, source: str, size: str, salt: Column) -> DataFrame:
    """``source, source_size`` in two steps, so a hot source is summed in parts."""
    part = df.groupBy(F.col(source).alias("source"), F.pmod(F.xxhash64(salt), F.lit(32)).alias("__salt")).agg(F.sum(size).alias("s"))
    return part.groupBy("source").agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("source_size"))


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (those that fit alone) with ``again``: whether the row and all before it in its source's hash order fit into ``rest``."""
    buckets = rows.groupBy("name", "none", "bucket").agg(F.sum("words").alias("s"))
    before = F.sum("s").over(W.partitionBy("name", "none").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    buckets = buckets.withColumn("before", F.coalesce(before, F.lit(0))).drop("s")
    upto = F.sum("words").over(W.partitionBy("name", "none", "bucket").orderBy("h", "id").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(buckets, ["name", "none", "bucket"]).withColumn("again", F.col("before") + upto <= F.col("rest") + 1e-9).drop("before")


def _decide(units: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``units`` (``source, id, size, words``) with the target's columns and ``repeats``."""
    bits = max(4, (max(1, units.count()) - 1).bit_length() // 2)
    h = F.xxhash64(F.lit(seed), "id", "size")
    rows = units.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits)).withColumn("salt", F.pmod("h", F.lit(32)))
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    t = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "target")
    # a source's rows meet its numbers in 32 parts, so a hot one does not meet in one task
    t = rows.groupBy("name", "none", "salt").agg(F.lit(1).alias("one")).drop("one").join(t, ["name", "none"])
    rows = rows.join(t, ["name", "none", "salt"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("rest", (ratio - F.col("whole")) * F.col("source_size"))
    rows = written(rows, "mix-units")
    fits = (F.col("rest") > 1e-9) & (F.col("words") <= F.col("rest") + 1e-9)
    no, columns, done = F.lit(False).alias("again"), rows.columns, []
    while True:
        done.append(rows.where(~fits).select("*", no))
        rows = written(_in_order(rows.where(fits)).select(*columns, "again"), "mix-round")
        done.append(rows.where("again"))
        parts = rows.groupBy("name", "none", "salt").agg(F.sum(F.when(F.col("again"), F.col("words")).otherwise(0)).alias("s"))
        got = parts.select("name", "none", "salt").join(parts.groupBy("name", "none").agg(F.sum("s").alias("got")), ["name", "none"])
        left = rows.where(~F.col("again")).drop("again").join(got, ["name", "none", "salt"]).withColumn("rest", F.col("rest") - F.col("got"))
        left = written(left.select(*columns), "mix-left")
        done.append(left.where("words = 0").select("*", no))
        rows = left.where("words > 0")
        if rows.where(fits).isEmpty():
            break
    done.append(rows.select("*", no))
    rows = reduce(DataFrame.unionByName, done)
    return rows.withColumn("repeats", (F.col("whole") + F.col("again").cast("long")).cast("int")).select("source", "id", "size", "source_size", "target", "repeats")


def take(df: DataFrame, targets: DataFrame, row_id: str, source: str = "source", size: str = "size", seed: int = 0) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``repeats`` (int, how often the row is taken).

    ``targets``: ``source, source_size, target`` with one row per source. Decisions
    are made on narrow units (rows equal in source, id and size), then joined to the rows.
    """
    units = df.groupBy(F.col(source).alias("source"), F.col(row_id).alias("id"), F.col(size).alias("size")).agg((F.coalesce(F.col(size), F.lit(0)) * F.count("*")).alias("words"))
    got = _decide(written(units.where("words >= 0"), "mix-units"), targets, seed).select(
        F.col("source").alias("__source"), F.col("id").alias("__id"), F.col("size").alias("__size"), "source_size", "target", "repeats")
    got = written(got, "mix-decisions")
    rows = df.drop("source_size", "target", "repeats")
    both = rows[source].eqNullSafe(got["__source"]) & rows[row_id].eqNullSafe(got["__id"]) & rows[size].eqNullSafe(got["__size"])
    # always a merge: few decisions would be broadcast, and the step's disk would then jump where they become many
    return rows.join(got.hint("merge"), both).drop("__source", "__id", "__size")


def mix(df: DataFrame, weights: DataFrame, share: float, max_epochs: float, row_id: str, seed: int = 0) -> DataFrame:
    """``df`` (``source``, ``size``, ...) mixed to ``weights`` (``source, weight``): see the module.

    ``share``: the mix's size as a multiple of all sizes.
    """
    sizes = source_sizes(df, "source", "size", F.col(row_id))  # null sizes add nothing
    both = written(sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left").select(sizes["source"], "weight", "source_size"),
                   "mix-sources")
    total = both.agg(F.sum("source_size")).first()[0] or 0
    return take(df, written(fill_targets(both, share * total, max_epochs), "mix-targets"), row_id, seed=seed)


def cyclic_weights(df: DataFrame, cycle: list[float]) -> DataFrame:
    """``source, weight``: the distinct sources by code point, null last, get ``cycle`` repeating.

    The order is a window over the distinct sources alone (not over rows).
    """
    names = df.select("source").distinct()
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return names.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(place, F.lit(len(cycle))) + 1))


