"""Benchmark decontamination by spaced-seed hashing.

A seed mask selects some token positions of a window and ignores the others, so
a window still hashes equally if words at ignored positions were substituted.
Windows of the benchmark items and of the documents are hashed under each mask
and joined. A hit gives an alignment (document, item, offset); it is verified by
comparing the tokens of item and document along that alignment, substitutions
counting as mismatches. An item leaks into a document if any run of the
alignment holds at least ``min_match`` equal tokens (or the whole of a shorter item's),
with at least ``min_share`` of the run equal. Reported is the best-scoring run if it does,
else the run with the most equal tokens that does.

Tokens are the words of the lower-cased text without punctuation.

Built-in functions only. Texts are told by a digest, whatever their ids. Documents' windows are one ``explode`` over hash arrays
and one join against the benchmark's hashes. That side is broadcast only after
it was counted (``BROADCAST_ROWS``, and ``BROADCAST_TOKENS`` where it carries token arrays), else the join shuffles. Hits are
summed up per text and item where they arise, as the set of their offsets. Only texts with a hit are read
again, equal ones once, and each (text, item) is verified by one row.

Defined cases: null texts count as empty; an item shorter than a mask is not searched under it. An item shorter than the narrowest mask (6 tokens)
is compared exactly: it leaks into a text of which it is a whole line, or all of it. An item without tokens matches nothing; an empty benchmark or table
gives an empty result; each of repeated rows of documents, also of rows of one id (null too) with different texts, has its own results; repeated items are one item; other columns of
either table are ignored here and kept by :func:`remove_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import checked_broadcast, let, written
from tabulyst.llm.neardup import node_of
from tabulyst.llm.quality import words

#: 1: the position counts, 0: it is ignored. Each has 6 counting positions; one substitution
#: per 4 or more words leaves some window of a 15-word passage whole under some mask.
MASKS = ("111111", "1101100101", "110010001011")
#: Characters that do not count: they are taken out of every text.
PUNCTUATION = ".,;:!?\"'`()[]{}<>*#$%&|=+~^_/\\-…“”„‘’«»–—¡¿"

#: Most tokens of items that a forced broadcast may hold (8 bytes each).
BROADCAST_TOKENS = 4_000_000


def tokens(text: Column) -> Column:
    """Hashes of the words of the lower-cased text without punctuation, in order."""
    return let(words(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")),
               lambda ws: F.transform(ws, lambda w: F.xxhash64(w)))


def window_rows(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` (with ``tokens``) exploded to window starts ``at`` and struct ``w`` of the next ``span`` tokens (null past the end)."""
    shifted = [F.slice("tokens", k + 1, F.greatest(F.size("tokens") - k, F.lit(0))).alias(f"t{k}") for k in range(span)]
    keep = [c for c in rows.columns if c != "tokens"]
    return rows.where(F.size("tokens") > 0).select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))


def seeds(masks: tuple[str, ...]) -> Column:
    """One struct (mask, hash) per mask whose window lies inside the text."""
    made = []
    for m, mask in enumerate(masks):
        on = [k for k, bit in enumerate(mask) if bit == "1"]
        made.append(F.when(F.col(f"w.t{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w.t{k}") for k in on])))
    return F.array(*made)


def best_run(doc: Column, item: Column, offset: Column) -> Column:
    """Of the alignment ``doc[i + offset] = item[i]``: struct (matched, length, start) of the run with the highest score.

    A match scores 1, a mismatch -2, so a run tolerates one substitution in three words and drops unlike ends; of equal scores the later end counts.
    """
    first = F.greatest(F.lit(0), -offset)
    last = F.least(F.size(item), F.size(doc) - offset) - 1
    state = F.struct(*[F.lit(0).alias(x) for x in ("score", "hit", "len", "begin", "best", "matched", "length", "start")])

    def step(s: Column, i: Column) -> Column:
        same = F.get(doc, i + offset) == F.get(item, i)
        fresh = s["score"] <= 0
        return let(F.struct(
            (F.when(fresh, 0).otherwise(s["score"]) + F.when(same, 1).otherwise(-2)).alias("score"),
            (F.when(fresh, 0).otherwise(s["hit"]) + same.cast("int")).alias("hit"),
            (F.when(fresh, 0).otherwise(s["len"]) + 1).alias("len"),
            F.when(fresh, i).otherwise(s["begin"]).alias("begin")),
            lambda n: F.struct(
                n["score"].alias("score"), n["hit"].alias("hit"), n["len"].alias("len"), n["begin"].alias("begin"),
                F.greatest(s["best"], n["score"]).alias("best"),
                F.when(n["score"] >= F.greatest(s["best"], F.lit(1)), n["hit"]).otherwise(s["matched"]).alias("matched"),
                F.when(n["score"] >= F.greatest(s["best"], F.lit(1)), n["len"]).otherwise(s["length"]).alias("length"),
                F.when(n["score"] >= F.greatest(s["best"], F.lit(1)), n["begin"]).otherwise(s["start"]).alias("start")))

    return F.when(last >= first, F.aggregate(F.sequence(first, last), state, step)).otherwise(state)


def widest_run(doc: Column, item: Column, offset: Column, min_share: float) -> Column:
    """Of the alignment: struct (matched, length, start) of the run with the most equal tokens among all with at least ``min_share`` equal.

    With equal tokens at h[0], h[1], ..., the run from the a-th to the b-th has the share if
    ``b + 1 - min_share (h[b] + 1) >= a - min_share h[a]``. Sorted by these values, an end meets all starts that it
    can have before it, and the least of them gives its widest run.
    """
    first = F.greatest(F.lit(0), -offset)
    last = F.least(F.size(item), F.size(doc) - offset) - 1
    share = F.lit(float(min_share))

    def mark(value: Column, end: int, k: Column, h: Column) -> Column:
        return F.struct(value.alias("value"), F.lit(end).alias("end"), k.alias("k"), h.alias("h"))

    def step(s: Column, x: Column) -> Column:
        wider = (x["end"] == 1) & (x["k"] - s["k"] + 1 > s["matched"])
        earlier = (x["end"] == 0) & (x["k"] < s["k"])
        return F.struct(
            F.when(earlier, x["k"]).otherwise(s["k"]).alias("k"), F.when(earlier, x["h"]).otherwise(s["h"]).alias("h"),
            F.when(wider, x["k"] - s["k"] + 1).otherwise(s["matched"]).alias("matched"),
            F.when(wider, x["h"] - s["h"] + 1).otherwise(s["length"]).alias("length"),
            F.when(wider, s["h"]).otherwise(s["start"]).alias("start"))

    def search(hits: Column) -> Column:
        starts = F.transform(hits, lambda h, k: mark(k - share * h, 0, k, h))
        ends = F.transform(hits, lambda h, k: mark(k + 1 - share * (h + 1) + 1e-9, 1, k, h))
        state = F.struct(F.lit(2**31 - 1).alias("k"), *[F.lit(0).alias(x) for x in ("h", "matched", "length", "start")])
        return let(F.sort_array(F.concat(starts, ends)), lambda marks: F.aggregate(marks, state, step))

    hits = F.when(last >= first, F.filter(F.sequence(first, last), lambda i: F.get(doc, i + offset) == F.get(item, i))).otherwise(F.array().cast("array<int>"))
    return let(let(hits, search), lambda s: F.struct(*[s[x].alias(x) for x in ("matched", "length", "start")]))


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``hash, key, item_at`` of every window of every item under every mask."""
    span = max(map(len, masks))
    got = window_rows(items.select("key", "tokens"), span).select("key", F.col("at").alias("item_at"), F.explode(seeds(masks)).alias("hash"))
    return got.where(F.col("hash").isNotNull())


def best_alignment(doc: Column, item: Column, offsets: Column, min_match: int, min_share: float) -> Column:
    """Of all ``offsets``: struct (matched, neg_length, neg_start) of the best run that holds the share; null if none does."""
    need = F.least(F.lit(min_match), F.size(item))

    def holds(run: Column) -> Column:
        return (run["matched"] >= need) & (run["matched"] >= F.lit(min_share) * run["length"] - 1e-9)

    def verify(offset: Column) -> Column:
        run = let(best_run(doc, item, offset), lambda r: F.when(holds(r), F.struct(*[r[x].alias(x) for x in ("matched", "length", "start")]))
                  .when(r["matched"] > 0, widest_run(doc, item, offset, min_share)))
        return let(run, lambda r: F.when(holds(r), F.struct(
            r["matched"].alias("matched"), (-r["length"]).alias("neg_length"), (-(r["start"] + offset)).alias("neg_start"))))

    return F.array_max(F.transform(offsets, verify))


def short_leaks(texts: DataFrame, short: DataFrame, longest: int) -> DataFrame:
    """``node, item, best`` where an item of ``short`` (``item, tokens``, at most ``longest`` each) is a whole line of a text or all of it."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), tokens)
    parts = F.filter(F.array_distinct(F.concat(lines, F.array(tokens(F.col("text"))))), lambda x: (F.size(x) > 0) & (F.size(x) <= longest))
    found = texts.select("node", "text", F.explode(parts).alias("tokens")).join(checked_broadcast(short), "tokens")
    n = F.size("tokens")
    first = let(tokens(F.col("text")), lambda all_: F.array_min(F.filter(
        F.sequence(F.lit(0), F.size(all_) - n), lambda i: F.slice(all_, i + 1, n) == F.col("tokens"))))
    best = F.struct(n.alias("matched"), (-n).alias("neg_length"), (-first).alias("neg_start"))
    return found.select("node", "item", n.alias("n_item"), best.alias("best"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  masks: tuple[str, ...] = MASKS, min_match: int = 10, min_share: float = 0.8) -> DataFrame:
    """Per text (``node``) and item: ``node, item, matched, run_length, item_tokens, doc_start`` of the best alignment that leaks."""
    span, narrow = max(map(len, masks)), min(map(len, masks))
    items = benchmark.select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("tokens")).dropDuplicates()
    items = written(items.withColumn("key", F.xxhash64("item", "tokens")), "benchmark-items")
    facts = items.agg(F.sum(F.size("tokens")).alias("n"), F.count_if((F.size("tokens") > 0) & (F.size("tokens") < narrow)).alias("short")).first()
    probes = written(benchmark_seeds(items, masks).distinct(), "benchmark-seeds")
    texts = docs.select(node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    rows = texts.select("node", tokens(F.col("text")).alias("tokens"))
    found = window_rows(rows, span).select("node", "at", F.explode(seeds(masks)).alias("hash")).where(F.col("hash").isNotNull())
    hits = written(found.join(checked_broadcast(probes), "hash").groupBy("node", "key").agg(
        F.collect_set(F.col("at") - F.col("item_at")).alias("offsets")), "benchmark-hits")
    nodes = written(hits.select("node").distinct(), "benchmark-hit-texts")
    again = rows.join(checked_broadcast(nodes), "node", "left_semi").dropDuplicates(["node"])
    side = items.select("key", "item", F.col("tokens").alias("item_tokens"))
    pairs = hits.join(checked_broadcast(side) if (facts["n"] or 0) <= BROADCAST_TOKENS else side, "key")
    best = best_alignment(F.col("tokens"), F.col("item_tokens"), F.col("offsets"), min_match, min_share)
    good = again.join(pairs, "node").select("node", "item", F.size("item_tokens").alias("n_item"), best.alias("best"))
    if facts["short"]:
        short = items.where((F.size("tokens") > 0) & (F.size("tokens") < narrow)).select("item", "tokens")
        good = good.unionByName(short_leaks(texts, written(short, "benchmark-short-items"), narrow - 1))
    # repeated texts give a short item's leak once each, and an id may name several items
    good = good.where(F.col("best").isNotNull()).groupBy("node", "item").agg(F.max(F.struct("best", "n_item")).alias("b"))
    return good.select("node", "item", F.col("b.best.matched").cast("long").alias("matched"), (-F.col("b.best.neg_length")).cast("long").alias("run_length"),
                       F.col("b.n_item").cast("long").alias("item_tokens"), (-F.col("b.best.neg_start")).cast("long").alias("doc_start"))


def leaks(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", **options) -> DataFrame:
    """``row_id, item_id, matched, run_length, item_tokens, doc_start`` of each verified leak: one row per row of ``docs`` and item."""
    found = written(leaking_texts(docs, benchmark, text, item_id, **options), "benchmark-leaks")
    rows = docs.select(F.col(row_id).alias("id"), node_of(F.col(text)).alias("node"))
    return rows.join(checked_broadcast(found), "node").select(
        F.col("id").alias(row_id), F.col("item").alias(item_id), "matched", "run_length", "item_tokens", "doc_start")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows into which an item leaks; all columns stay as they are. Rows are told by their text, whatever their ids."""
    found = written(leaking_texts(docs, benchmark, text, **options).select(F.col("node").alias("__leaked")).distinct(), "leaked-texts")
    return docs.join(checked_broadcast(found), node_of(docs[text]) == found["__leaked"], "left_anti")
