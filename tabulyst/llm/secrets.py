"""Secret scans: patterns, and character Markov models for what no pattern names.

Base patterns find assignments of named secrets, access key ids and long
hexadecimal runs. Beyond them, two first-order character Markov models, one
of random strings and one of ordinary identifiers, are trained from labelled
samples (:func:`train`); a token is a secret if its log-likelihood ratio per
transition, random against ordinary, exceeds a threshold that is chosen on the
ordinary samples (:func:`scan`).

All of it is built-in functions. Offsets come from the pieces between matches:
``split`` and ``regexp_extract_all`` by one pattern alternate, so running sums of
their lengths (code points) are the spans. The model is one array literal over
pairs of 7-bit characters, bounded by the alphabet, so scoring a token needs no
join. Work is one narrow pass over the texts.

Defined cases: a null text counts as empty and has no spans; an empty table
gives an empty result; without samples of one label the model finds nothing;
repeated rows are scanned each; columns named like the outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import let, written

# The base patterns. A match of `assign` counts if its value has 6 or more characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of a candidate token for the model.
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
SPAN = "array<struct<start:int,end:int,kind:int>>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, kind), in code points.

    ``keep``: from a match's text to a boolean; others are dropped.
    """
    def pair(found: Column, gaps: Column) -> Column:
        walk = F.aggregate(
            F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g)).alias("g")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(
                acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")))
        placed = F.arrays_zip(found.alias("text"), walk["out"].alias("span"))
        chosen = placed if keep is None else F.filter(placed, lambda x: keep(x["text"]))
        return F.transform(chosen, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), F.lit(kind).alias("kind")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(~text.rlike(pattern), F.array().cast(SPAN)).otherwise(
        let(F.struct(found.alias("f"), F.split(text, pattern, -1).alias("g")), lambda x: pair(x["f"], x["g"])))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, unordered."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return F.concat(spans(text, ASSIGN, 0, value), spans(text, ACCESS, 1), spans(text, HEX, 2))


def transitions(token: Column) -> Column:
    """Neighbouring character pairs of a token as numbers: first * 128 + second."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.ascii(F.substring(token, i, F.lit(1))) * 128 + F.ascii(F.substring(token, i + 1, F.lit(1))))


class Model:
    """Log-likelihood ratios per character pair (16,384 numbers) and the threshold per transition."""

    def __init__(self, ratios: list[float], threshold: float, trained: bool):
        self.ratios, self.threshold, self.trained = ratios, threshold, trained

    def table(self) -> Column:
        """The ratios as an array, folded to one literal by the optimizer."""
        return F.split(F.lit(",".join(f"{x:.4g}" for x in self.ratios)), ",").cast("array<double>")

    def per_transition(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a token of two or more characters."""
        table = self.table()
        total = F.aggregate(transitions(token), F.lit(0.0), lambda a, p: a + F.get(table, p))
        return total / (F.length(token) - 1)


def train(samples: DataFrame, false_rate: float = 1e-3, smoothing: float = 0.5, margin: float = 0.25) -> Model:
    """Models from ``samples`` (``token`` string, ``random`` boolean).

    Transition counts are summed by Spark; at most 68 x 68 x 2 sums come back.
    The threshold is the ``1 - false_rate`` quantile of the ordinary samples'
    scores, at least ``margin``. Tokens of fewer than two characters and null labels are left out.
    """
    rows = samples.where((F.length("token") >= 2) & F.col("random").isNotNull() & ~F.col("token").rlike(r"[^A-Za-z0-9+/_=-]"))
    got = rows.select("random", F.explode(transitions(F.col("token"))).alias("p")).groupBy("random", "p").count().collect()
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in got:
        counts[r["random"]][r["p"]] = r["count"]
    ratios = [0.0] * (128 * 128)
    if not counts[True] or not counts[False]:
        return Model(ratios, math.inf, False)
    codes = [ord(c) for c in TOKEN_CHARS]
    for a in codes:
        sums = {k: sum(v.get(a * 128 + b, 0) for b in codes) for k, v in counts.items()}
        for b in codes:
            p = {k: (v.get(a * 128 + b, 0) + smoothing) / (sums[k] + smoothing * len(codes)) for k, v in counts.items()}
            ratios[a * 128 + b] = math.log(p[True] / p[False])
    model = Model(ratios, 0.0, True)
    score = rows.where(~F.col("random")).select(model.per_transition(F.col("token")).alias("s"))
    model.threshold = max(margin, score.agg(F.percentile_approx("s", 1.0 - false_rate, 10_000)).first()[0])
    return model


def model_spans(text: Column, model: Model, min_chars: int = 20) -> Column:
    """Spans of tokens that the model takes for random strings.

    A candidate needs a digit and ``min_chars`` characters; a longer token tells the models apart better.
    """
    if not model.trained:
        return F.array().cast(SPAN)
    pattern = TOKEN % min_chars
    return spans(text, pattern, 3, lambda t: t.rlike("[0-9]") & (model.per_transition(t) > F.lit(model.threshold)))


def scan(df: DataFrame, model: Model, text: str = "text", min_chars: int = 20) -> DataFrame:
    """``df`` with ``found`` (base spans) and ``extra`` (model spans that overlap no base span), each sorted by start, end, kind.

    Structs: ``start``, ``end`` (code points, end exclusive) and ``kind`` (index into KINDS).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.drop("found", "extra").withColumn("__scan", let(body, lambda t: F.struct(base_spans(t).alias("base"), model_spans(t, model, min_chars).alias("more"))))
    out = out.withColumn("found", by_place(F.col("__scan.base")))
    alone = F.filter(F.col("__scan.more"), lambda m: ~F.exists(F.col("__scan.base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn("extra", by_place(alone)).drop("__scan")


def by_place(found: Column) -> Column:
    """By start, then kind, as listed in KINDS."""
    ordered = F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def joined(found: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def labelled_samples(df: DataFrame, text: str = "text", row_id: str = "doc_id", sample_docs: int = 2_000) -> DataFrame:
    """Labelled tokens from ``df``: the values of assignments, key ids and hexadecimal runs as random
    strings; the words of letters, digits and joiners outside them as ordinary identifiers.

    Both come from the ``sample_docs`` documents of smallest seeded id hash that
    hold a base pattern and as many of all documents: the bound on the labelled rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(row_id).alias("id"), body.alias("body"))
    some = rows.select("id", F.xxhash64(F.lit(7), "id").alias("h"),
                       (F.col("body").rlike(ASSIGN) | F.col("body").rlike(ACCESS) | F.col("body").rlike(HEX)).alias("hit"))
    some = written(some, "secret-sample-ids")
    pick = some.where("hit").orderBy("h", "id").limit(sample_docs).select("id").union(some.orderBy("h", "id").limit(sample_docs).select("id"))
    chosen = rows.join(F.broadcast(pick.distinct()), "id", "left_semi")
    hits = F.flatten(F.array(
        F.transform(F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(0)), lambda m: F.regexp_extract(m, ASSIGN, 2)),
        F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("body", F.lit(HEX), F.lit(0))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    secret = chosen.select(F.explode(hits).alias("token")).where(F.length("token") >= 16).distinct().withColumn("random", F.lit(True))
    usual = chosen.select(F.explode(plain).alias("token")).distinct().withColumn("random", F.lit(False))
    return written(secret.unionByName(usual), "secret-samples")
