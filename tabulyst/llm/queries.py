"""Registered queries of the corpus operators, with DuckDB SQL where it can express them.

Each ``opN_<name>`` applies operator N with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyst.llm import chat, decontaminate, lm, mixing, neardup, phrases, quality, secrets, sharding, suffix, tokenfile, trie, warc
from tabulyst.llm.common import WORD, written
from tabulyst.session import ship_package

#: Weights of the sources in code point order, repeating; the mix's size as a share of all; most repetitions.
MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = [3.0, 1.0, 2.0], 1.5, 2.0
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The text of a public tokenizer's file, read on the driver and broadcast by the operators."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts stay together."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = written(table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), neardup.node_of(F.col("text")).alias("node")), "shard-documents")
    out = sharding.shard(docs, F.col("node"), F.col("size"), SHARDS, slot_order=F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans, and the Markov models' spans beyond them."""
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(docs))
    found = secrets.scan(docs.select("doc_id", "text"), model)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("found")), 256).alias("base_sha256"),
        secrets.joined(secrets.by_place(F.concat("found", "extra"))).alias("spans"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal texts and its near-duplicate group."""
    ship_package(spark)
    return neardup.groups(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages and read back by ranges."""
    ship_package(spark)
    back = warc.read_packages(warc.write_packages(table(spark, sf_dir, "pages")), payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' weights, in words."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-documents")
    out = mixing.mix(docs, mixing.cyclic_weights(docs, MIX_WEIGHTS), MIX_SHARE, MIX_EPOCHS, "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted as prefix trees and read back."""
    ship_package(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    # (rows of a Python list would start a second set of Python workers)
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(tricky).alias("text"))
    definition = tokenizer_json()
    return chat.read_conversations(chat.format_conversations(rows.unionByName(own), definition), definition)


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the line rules' result, the text's measures, ``base_failed`` and ``kept``."""
    out = quality.clean(docs).withColumns({f"m_{k}": v for k, v in quality.measures(F.col("text")).items()})
    out = out.withColumn("base_failed", (F.col("m_n_words") < 10) | (100 * F.col("m_n_repeat_words") > 20 * F.col("m_n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("lines_kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", *[F.col(f"m_{c}").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "lost_words")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in patched frame-of-reference files, read back."""
    ship_package(spark)
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_json())
    return tokenfile.read_tokens(manifest, with_ids=False)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of all n-grams of the documents that are not held out."""
    ship_package(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = lm.score(table(spark, sf_dir, "documents"), ~held_out, least=1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into which benchmark items leak: one row per document and item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of two to four words."""
    ship_package(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))


def shared_starts(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first h turns of their group's first one, and all conversation ids.

    ``turns`` as :func:`trie.ordered_turns` gives them; h = crc32(id) % ``most``.
    """
    convs = turns.select("conv_id").distinct().withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where(F.col("place") <= F.col("h")).select("conv_id", "place", "role", "text")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    return heads.unionByName(turns.where(F.col("place") > own)), convs.select("conv_id")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared starts, with subtree totals."""
    ship_package(spark)
    turns, convs = shared_starts(trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that a document of a smaller id also holds."""
    ship_package(spark)
    out = suffix.remove_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_secrets, op3_neardup, op4_warc, op5_mixing, op6_chat, op7_quality, op8_tokens, op9_lm, op10_decontaminate,
                                   op11_phrases, op12_trie, op13_passages)}

_ESC = r"regexp_replace({}, '([\\<\[\]])', '\\\1', 'g')"
_FORMATTED = f"""CASE r WHEN 'system' THEN '<<SYS>>' || {_ESC.format('x')} || '<</SYS>>' WHEN 'user' THEN '[INST] ' || {_ESC.format('x')} || ' [/INST]'
 WHEN 'assistant' THEN '<s> ' || {_ESC.format('x')} || ' </s>' ELSE '[ROLE ' || {_ESC.format('r')} || '] ' || {_ESC.format('x')} || ' [/ROLE]' END"""

_CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_FORMATTED})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i + 1, 1)) - 1), 4, '0')), '') AS bits,
  min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * CAST(pow(2, 4 - j) AS INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM b"""

_SPACES = r"[\x20\x09-\x0D]+"
_QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACES}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACES}', '', 'g') <> '') AS lines FROM d),
win AS (SELECT k, i, ws[i:i+4] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY k),
ln AS (SELECT k, line, list_filter(string_split_regex(line, '{_SPACES}'), lambda x: x <> '') AS lw
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT k, len(lw) AS n, (len(lw) > 0 AND (
   ((length(line) - length(regexp_replace(line, '[|•·»›→]', '', 'g'))) * 3 >= len(lw) AND line SIMILAR TO '(.|\n|\r)*[|•·»›→](.|\n|\r)*')
   OR ((length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 2 >= len(lw) AND length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 1)
   OR (len(lw) <= 12 AND regexp_matches(line, '{quality.NAVIGATION}'))
   OR (len(lw) < 25 AND regexp_matches(line, '{quality.BOILERPLATE}'))
   OR (len(lw) >= 25 AND NOT regexp_matches(line, '{quality.SENTENCE_END}'))
   OR (len(lw) >= 25 AND len(list_distinct(lw)) * 3 < len(lw)))) AS bad FROM ln),
lost AS (SELECT k, coalesce(sum(n) FILTER (bad), 0) AS lost FROM judged GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  (len(ws) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(ws)) AS base_failed,
  NOT (len(ws) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(ws)) AND lost <= 0.3 * len(ws) AND len(ws) - lost >= 10 AS kept,
  CAST(lost AS BIGINT) AS lost_words
FROM w LEFT JOIN cov USING (k) LEFT JOIN lost USING (k)"""

_TRIE_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 20 AS b, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)),
   lambda a, y: list_reduce([xor(a, y)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda q, z: xor(q >> 1, 3988292384 * (q & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
rb AS (SELECT cs.c, 0 AS p, i, r, x FROM cs JOIN t ON t.c = cs.b AND i <= h UNION ALL SELECT cs.c, 1, i, r, x FROM cs JOIN t ON t.c = cs.c AND i > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p, i) AS d, sha256(length(r) || ':' || r || x) AS k,
  len(list_filter(string_split_regex(x, '{_SPACES}'), lambda y: y <> '')) AS w FROM rb),
m AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, w FROM s UNION ALL SELECT c, 0, '', 0 FROM cs),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM m JOIN (SELECT c, max(d) AS n FROM m GROUP BY c) USING (c) WHERE d = n GROUP BY path),
nodes AS (SELECT path, d, min(c) AS g, count(*) AS n, max(w) AS w FROM m GROUP BY path, d),
kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
up AS (SELECT left(path, 64 * y) AS path, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT path, n, w, k, unnest(range(0, d + 1)) AS y FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT a.g AS conv_id, CAST(a.d AS BIGINT) AS depth, q.g AS parent_conv_id, a.n AS n_convs, coalesce(k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes a LEFT JOIN nodes q ON a.d > 0 AND q.path = left(a.path, 64 * (a.d - 1)) LEFT JOIN kids ON kids.path = a.path JOIN up ON up.path = a.path LEFT JOIN e ON e.path = a.path"""

_PHRASES_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
inside AS (SELECT lang, ws[i:i + j - 1] AS ws, max(f) AS longer FROM (SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, ws) WHERE longer IS NULL OR 100 * longer < 80 * f),
cut AS (SELECT a.lang, a.ws, a.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * a.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) a JOIN f l ON l.lang = a.lang AND l.ws = a.ws[1:j] JOIN f r ON r.lang = a.lang AND r.ws = a.ws[j + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
s AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN tot USING (lang)
QUALIFY rank <= 2000"""

ORACLES = {"op11_phrases": _PHRASES_SQL, "op12_trie": _TRIE_SQL, "op4_warc": _WARC_SQL, "op6_chat": _CHAT_SQL, "op7_quality": _QUALITY_SQL}
