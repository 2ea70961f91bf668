"""Exact quantiles (linear interpolation) in three passes, without a one-task merge.

Spark's exact ``percentile``/``median`` keeps a value->count map per group and
merges all partial maps of a global aggregate in one task: fine for a few million
distinct values, not for a column of a 100 TB table. ``exact_quantiles`` reads the rows at most three times, whatever their values:

1. one aggregate gives ``n, min, max, mean, std`` and a mergeable quantile sketch per (group, column); the sketch's rank
   error is at most ``n / accuracy``, so two of its quantiles bracket each target;
2. one aggregate counts the rows below and inside each bracket, with the least and greatest value inside and the nearest outside. A
   bracket of one value, as inside a value that holds a third of all rows, resolves at once; so do targets at a bracket's edge;
3. the rows inside the other brackets (a share of about ``6 / accuracy`` of a column, and ties) are counted by value and finished by one window.

Passes 1 and 2 are wide: one row of the table stays one row. Infinite values are values like others. A target outside its bracket, which
the sketch's guarantee rules out, would be narrowed in rounds of bucket counts.

Only bounds and counts reach the driver. :func:`group_quantiles` is the way for any number of groups: small groups never reach the driver.
The result equals
``quantile_cont`` / numpy's linear percentile: ``v[k] + (v[k+1] - v[k]) * frac``
with ``pos = (n - 1) * p``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyst.functions.expressions import col_

DEFAULT_MAX_EXACT_ROWS = 50_000  # intervals above this are narrowed by a bucket count first
DEFAULT_BINS = 1024
ACCURACY = 20_000  # of the sketch: its ranks are off by at most n / ACCURACY
INTERVALS = 1000  # intervals narrowed or finished by one job; more take further jobs


def long_values(df: DataFrame, cols: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """``(by..., column, v)`` with v as double; null and NaN dropped."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), col_(c).cast("double").alias("v")) for c in cols])
    return (df.select(*[col_(b) for b in by], F.inline(arr))
            .where(F.col("v").isNotNull() & ~F.isnan(F.col("v"))))


@dataclass
class _Target:
    key: tuple  # group values + column
    rank: int
    lo: float
    hi: float
    base: int  # rows of the key below lo
    cnt: int  # rows inside [lo, hi]
    value: float | None = None
    done: bool = False
    by_exponent: bool = False  # how the next round cuts the interval

    def settle(self) -> None:
        """Done if the interval holds one value; a width without an end is cut by exponent."""
        if self.lo == self.hi:
            self.value, self.done = self.lo, True
        elif not math.isfinite(self.hi - self.lo):
            self.by_exponent = True


def _bracketed(df: DataFrame, cols: list[str], by: list[str], brackets: list[dict]) -> dict[tuple, dict]:
    """Pass 2: ``below, inside, least, most, before, after`` of each bracket ``{key, lo, hi}``, key = group values and column."""
    at = {c: i for i, c in enumerate(cols)}
    slots: dict[tuple, list[dict]] = {}
    for b in brackets:
        slots.setdefault(b["key"][:-1], []).append(b)
    width = max(len(x) for x in slots.values())
    cells: list[tuple] = []  # one row per group: which column, lo and hi of each slot
    for group, few in slots.items():
        few = few + [few[0]] * (width - len(few))
        cells.append(group + tuple(v for b in few for v in (at[b["key"][-1]], b["lo"], b["hi"])))
    values = F.array(*[col_(c).cast("double") for c in cols])
    if by:
        schema = T.StructType([T.StructField(f"__g{i}", df.schema[b].dataType) for i, b in enumerate(by)] + [
            T.StructField(f"__{n}{k}", t) for k in range(width) for n, t in (("c", T.IntegerType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()))])
        bounds = F.broadcast(df.sparkSession.createDataFrame(cells, schema))  # one row per group of the driver's list
        same = functools.reduce(lambda a, b: a & b, [col_(b).eqNullSafe(F.col(f"__g{i}")) for i, b in enumerate(by)])
        rows = df.select(*[col_(b) for b in by], values.alias("__v")).join(bounds, same)
        slot = [(F.get("__v", F.col(f"__c{k}")), F.col(f"__lo{k}"), F.col(f"__hi{k}")) for k in range(width)]
    else:
        rows = df.select(*[col_(c).cast("double").alias(f"__v{i}") for i, c in enumerate(cols)])
        slot = [(F.col(f"__v{cells[0][3 * k]}"), F.lit(cells[0][3 * k + 1]), F.lit(cells[0][3 * k + 2])) for k in range(width)]
    aggs = []
    for k, (v, lo, hi) in enumerate(slot):
        v = F.when(~F.isnan(v), v)
        inside = (v >= lo) & (v <= hi)
        aggs.append(F.struct(F.count_if(v < lo), F.count_if(inside), F.min(F.when(inside, v)), F.max(F.when(inside, v)), F.max(F.when(v < lo, v)),
                             F.min(F.when(v > hi, v))).alias(f"s{k}"))
    got = rows.groupBy(*[F.col(f"__g{i}") for i in range(len(by))]).agg(*aggs).collect()
    found = {}
    for r in got:
        for k, b in enumerate(slots[tuple(r[f"__g{i}"] for i in range(len(by)))]):
            found[b["key"] + (b["lo"], b["hi"])] = dict(zip(("below", "inside", "least", "most", "before", "after"), r[f"s{k}"]))
    return found


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | tuple = (),
                    max_exact_rows: int = DEFAULT_MAX_EXACT_ROWS, bins: int = DEFAULT_BINS, accuracy: int = ACCURACY,
                    passes: list[str] | None = None) -> list[dict]:
    """Exact linear-interpolation quantiles of ``cols`` (per ``by`` group).

    Returns one dict per (group, column, p): ``{**group, column, p, value, n, mean,
    std, min, max}`` (the moments come free with the first aggregate). A
    group/column without any non-null value has no entry. ``passes`` gets the name of each pass over the rows.
    """
    by, passes = list(by), [] if passes is None else passes
    if not cols:
        return []
    spark = df.sparkSession
    step = 2.0 / accuracy
    near = [min(1.0, max(0.0, float(p) + d)) for p in probs for d in (-step, step)]
    passes.append("sketch")
    aggs = []
    for i, c in enumerate(cols):
        v = col_(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs.append(F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                             F.percentile_approx(v, near, accuracy).alias("near")).alias(f"__s{i}"))
    groups = df.groupBy(*[col_(b).alias(f"__g{i}") for i, b in enumerate(by)]).agg(*aggs).collect()

    targets: dict[tuple, _Target] = {}
    brackets: dict[tuple, dict] = {}
    plan = []  # (key, p, n, rank0, rank1, frac)
    moments = {}
    for row in groups:
        for i, c in enumerate(cols):
            r = row[f"__s{i}"]
            if not r["n"]:
                continue
            key, n = tuple(row[f"__g{j}"] for j in range(len(by))) + (c,), int(r["n"])
            moments[key] = (r["mean"], r["std"], r["lo"], r["hi"])
            for k, p in enumerate(probs):
                pos = (n - 1) * float(p)
                k0 = int(math.floor(pos))
                k1 = min(k0 + 1, n - 1)
                plan.append((key, p, n, k0, k1, pos - k0))
                lo, hi = float(r["near"][2 * k]), float(r["near"][2 * k + 1])
                for rank in (k0, k1):
                    if (key, rank) not in targets:
                        t = targets[(key, rank)] = _Target(key, rank, lo, hi, 0, n)
                        if r["lo"] == r["hi"]:
                            t.value, t.done = float(r["lo"]), True
                        elif rank in (0, n - 1):
                            t.value, t.done = float(r["lo"] if rank == 0 else r["hi"]), True
                        else:
                            brackets[key + (lo, hi)] = {"key": key, "lo": lo, "hi": hi}
    if brackets:
        passes.append("count")
        counted = _bracketed(df, cols, by, list(brackets.values()))
        for t in targets.values():
            if not t.done:
                _locate(t, counted[t.key + (t.lo, t.hi)], moments[t.key])

    key_cols = by + ["column"]
    wide = [t for t in targets.values() if not t.done and t.cnt < 0]  # outside their brackets
    for t in wide:
        t.cnt = -t.cnt
        t.settle()
    long = long_values(df, cols, by)
    while open_t := [t for t in wide if not t.done and t.cnt > max_exact_rows]:
        passes.append("refine")
        for few in _by_interval(open_t):
            _refine(spark, long, key_cols, few, bins)
    if open_t := [t for t in targets.values() if not t.done]:
        passes.append("finish")
        for few in _by_interval(open_t):
            _finish(spark, long, key_cols, few)

    out = []
    for key, p, n, k0, k1, frac in plan:
        v0, v1 = targets[(key, k0)].value, targets[(key, k1)].value
        value = v0 + (v1 - v0) * frac if frac and v0 != v1 else v0
        d = {c: key[i] for i, c in enumerate(by)}
        mean, std, lo, hi = moments[key]
        d.update(column=key[-1], p=float(p), value=float(value), n=n, mean=mean, std=std, min=lo, max=hi)
        out.append(d)
    # (group, column) pairs without any value have no entry; callers treat them as None
    return out


def _locate(t: _Target, found: dict, moments: tuple) -> None:
    """Settle a target by its bracket's counts, or give it the rows that are left to look at."""
    below, inside = int(found["below"]), int(found["inside"])
    t.base, place = below, t.rank - below
    if place == -1:
        t.value = found["before"]
    elif place == inside:
        t.value = found["after"]
    elif 0 <= place < inside:
        if place == 0 or found["least"] == found["most"]:
            t.value = found["least"]
        elif place == inside - 1:
            t.value = found["most"]
        else:
            t.lo, t.hi, t.cnt = found["least"], found["most"], inside
    elif place < 0:
        t.lo, t.hi, t.base, t.cnt = float(moments[2]), found["before"], 0, -below
    else:
        n_above = t.cnt - below - inside
        t.lo, t.hi, t.base, t.cnt = found["after"], float(moments[3]), below + inside, -n_above
    if t.value is not None:
        t.value, t.done = float(t.value), True


def _by_interval(ts: list[_Target]) -> Iterator[list[_Target]]:
    """Targets in lots of at most INTERVALS intervals, targets of one interval together."""
    per: dict[tuple, list[_Target]] = {}
    for t in ts:
        per.setdefault(t.key + (t.lo, t.hi), []).append(t)
    lots = list(per.values())
    for lo in range(0, len(lots), INTERVALS):
        yield [t for some in lots[lo: lo + INTERVALS] for t in some]


def group_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str],
                    max_exact_rows: int = DEFAULT_MAX_EXACT_ROWS, **kw) -> DataFrame:
    """``(by..., column, p, value)`` for any number of groups.

    Groups of at most ``max_exact_rows`` values take Spark's ``percentile``, each within that
    bound; the driver gets only the larger ones, of which there is at most one per ``max_exact_rows`` rows.
    """
    spark, key = df.sparkSession, [*by, "column"]
    long = long_values(df, cols, by)
    sizes = long.groupBy(*[col_(c) for c in key]).agg(F.count(F.lit(1)).alias("n"))
    large = spark.createDataFrame(sizes.where(F.col("n") > max_exact_rows).select(*[col_(c) for c in key]).collect(), sizes.select(*[col_(c) for c in key]).schema)
    hot = large.select(*[col_(c).alias(f"__g_{c}") for c in key])
    same = functools.reduce(lambda a, b: a & b, [col_(c).eqNullSafe(col_(f"__g_{c}")) for c in key])
    small = long.join(hot, same, "left_anti").groupBy(*[col_(c) for c in key]).agg(F.percentile("v", [float(p) for p in probs]).alias("q"))
    small = small.select(*[col_(c) for c in key], F.posexplode("q").alias("__i", "value"))
    out = small.select(*[col_(c) for c in key], F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1).alias("p"), "value")
    if large.isEmpty():
        return out
    few = large.select(*[col_(c) for c in by]).distinct().select(*[col_(c).alias(f"__g_{c}") for c in by])
    mine = functools.reduce(lambda a, b: a & b, [col_(c).eqNullSafe(col_(f"__g_{c}")) for c in by])
    wanted = {tuple(r) for r in large.collect()}
    found = exact_quantiles(df.join(few, mine, "left_semi"), cols, probs, by, max_exact_rows, **kw)
    rows = [tuple(r[c] for c in [*key, "p", "value"]) for r in found if tuple(r[c] for c in key) in wanted]
    return out.unionByName(spark.createDataFrame(rows, out.schema))


def _interval_frame(spark, long: DataFrame, key_cols, ts: list[_Target]):
    """Rows of ``long`` inside each distinct target interval, tagged with an interval id."""
    ivs: dict[tuple, int] = {}
    for t in ts:
        ivs.setdefault(t.key + (t.lo, t.hi), (len(ivs), t.by_exponent))
    schema = T.StructType([long.schema[c] for c in key_cols] + [
        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("iid", T.IntegerType()),
        T.StructField("by_exponent", T.BooleanType())])
    idf = spark.createDataFrame([k + i for k, i in ivs.items()], schema).select(
        *[col_(c).alias(f"__g_{c}") for c in key_cols], "lo", "hi", "iid", "by_exponent")
    ivs = {k: i for k, (i, _) in ivs.items()}
    # at most INTERVALS rows, so the broadcast is bounded;
    # null-safe equality keeps groups whose key is null
    cond = None
    for c in key_cols:
        eq = col_(c).eqNullSafe(col_(f"__g_{c}"))
        cond = eq if cond is None else cond & eq
    joined = (long.join(F.broadcast(idf), on=cond, how="inner")
              .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
              .drop(*[f"__g_{c}" for c in key_cols]))
    return ivs, joined


def _refine(spark, long, key_cols, ts: list[_Target], bins: int) -> None:
    ivs, joined = _interval_frame(spark, long, key_cols, ts)
    v, lo = F.col("v"), F.col("lo")
    even = F.least(F.floor((v - lo) / (F.col("hi") - lo) * bins), F.lit(bins - 1))
    # zero in the middle, then by exponent (-1074 to 1024) away from it, infinity last
    side = max(3, bins // 2)
    place = F.when(F.abs(v) == float("inf"), F.lit(side)).otherwise(F.floor((F.log2(F.abs(v)) + 1075) / 2100 * (side - 2)) + 1)
    exponent = F.when(v == 0, F.lit(0)).when(v > 0, place).otherwise(-place)
    b = F.when(F.col("by_exponent"), exponent).otherwise(even).cast("int")
    rows = (joined.withColumn("b", b).groupBy("iid", "b")
            .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
            .collect())
    per: dict[int, list] = {}
    for r in rows:
        per.setdefault(r["iid"], []).append((r["b"], int(r["c"]), float(r["bmin"]), float(r["bmax"])))
    for t in ts:
        buckets = sorted(per[ivs[t.key + (t.lo, t.hi)]])
        want = t.rank - t.base
        cum = 0
        for _, c, bmin, bmax in buckets:
            if cum + c > want:
                t.base += cum
                # equal width always parts least from greatest, so it follows every round by exponent
                t.by_exponent = not t.by_exponent and c * 4 > t.cnt
                t.lo, t.hi, t.cnt = bmin, bmax, c
                t.settle()
                break
            cum += c


def _finish(spark, long, key_cols, ts: list[_Target]) -> None:
    ivs, joined = _interval_frame(spark, long, key_cols, ts)
    w = Window.partitionBy("iid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (joined.groupBy("iid", "v").agg(F.count(F.lit(1)).alias("c"))
               .withColumn("cum", F.sum("c").over(w)))
    want_rows = [(ivs[t.key + (t.lo, t.hi)], t.rank - t.base, i) for i, t in enumerate(ts)]
    want = spark.createDataFrame(want_rows, T.StructType([
        T.StructField("iid", T.IntegerType()), T.StructField("r", T.LongType()), T.StructField("tid", T.IntegerType())]))
    hit = (counted.join(F.broadcast(want), "iid")
           .where((F.col("cum") - F.col("c") <= F.col("r")) & (F.col("r") < F.col("cum")))
           .select("tid", "v").collect())
    for r in hit:
        t = ts[r["tid"]]
        t.value, t.done = float(r["v"]), True
    for t in ts:  # defensive: a target with no hit would loop forever
        if not t.done:
            raise RuntimeError(f"quantile target not found for {t.key} rank {t.rank}")


def quantile_map(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict[tuple, float | None]:
    """``{(column, p): value}`` for a global (ungrouped) quantile request."""
    res = exact_quantiles(df, cols, probs, **kw)
    out: dict[tuple, float | None] = {(c, float(p)): None for c in cols for p in probs}
    for r in res:
        out[(r["column"], r["p"])] = r["value"]
    return out


def medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    qm = quantile_map(df, cols, [0.5], **kw)
    return {c: qm[(c, 0.5)] for c in cols}
