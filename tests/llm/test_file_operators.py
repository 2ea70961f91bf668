"""WARC packages, chat trees, token files, LM scores and near duplicates against brute force and round trips."""

from __future__ import annotations

import hashlib
import io
import math
import os
import random
import re
import sys
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulyst.llm import chat, hashing, lm, neardup, queries, tokenfile, warc
from tabulyst.session import checkpoint_dir, ship_package

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, text string")


# ---- hashing ----------------------------------------------------------------------------------------


def test_words_and_windows_equal_a_plain_split(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hashing, "_RANGE", 16)  # many byte ranges
    texts = ["a b c a b c", None, "", " x\ty\x0bz ", "a" * 5000 + " tail", "été é x", "b", "a", "  ", "A a"]
    h, first = hashing.word_hashes(pa.array(texts + ["skipped"]).slice(0, len(texts)))
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert len(h) == len(words) and list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    low, _ = hashing.word_hashes(pa.array(["A a É é"]), lower=True)
    assert low[0] == low[1] and low[2] != low[3]
    win, doc = hashing.window_hashes(h, first, 3)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [max(0, len(WORD.findall(t or "")) - 2) for t in texts]
    assert win[0] == win[3]


# ---- near duplicates --------------------------------------------------------------------------------


def prose(rng, n):
    return ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n)]


def edited(rng, ws, k):
    ws = list(ws)
    for i in rng.sample(range(len(ws)), k):
        ws[i] = "changed" + str(rng.randrange(10_000))
    return ws


def brute_groups(texts, limit=0.8):
    sets = []
    for t in texts:
        ws = WORD.findall(t or "")
        sets.append({tuple(ws[i: i + 5]) for i in range(len(ws) - 4)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, rng.randrange(60, 300))) for _ in range(60)]
    for t in list(texts[:20]):
        texts += [" ".join(edited(rng, t.split(), 1)) for _ in range(rng.randrange(1, 4))]
    for t in texts[20:25]:
        texts += [" ".join(edited(rng, t.split(), len(t.split()) // 5))]  # too far
    texts += [texts[0]] * 5 + [None, "", "", "too few words", "too few words", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    out = {r["doc_id"]: r for r in neardup.groups(docs_of(spark, texts)).collect()}
    want = brute_groups(texts)
    assert [out[i]["group_id"] for i in range(len(texts))] == want
    first = {}
    assert [out[i]["class_id"] for i in range(len(texts))] == [first.setdefault(t or "", i) for i, t in enumerate(texts)]
    assert [out[i]["kept"] for i in range(len(texts))] == [want[i] == i for i in range(len(texts))]


def test_a_large_family_of_near_copies_is_one_group(spark):
    """Copies are nearer to the original than to each other, so pivots alone would not link them."""
    rng = random.Random(6)
    original = prose(rng, 200)
    texts = [" ".join(edited(rng, original, 4)) for _ in range(120)] + [" ".join(original)] + [" ".join(prose(rng, 100)) for _ in range(120)]
    out = {r["doc_id"]: r["group_id"] for r in neardup.groups(docs_of(spark, texts)).collect()}
    assert {out[i] for i in range(121)} == {0}
    assert [out[i] for i in range(121, 241)] == list(range(121, 241))


def test_a_very_common_passage_links_nothing(spark):
    rng = random.Random(8)
    common = prose(rng, 60)
    texts = [" ".join(prose(rng, 30) + common + prose(rng, 30)) for _ in range(200)]
    out = neardup.groups(docs_of(spark, texts)).collect()
    assert all(r["doc_id"] == r["group_id"] for r in out)


def test_near_duplicate_edges(spark):
    none = docs_of(spark, [])
    assert neardup.groups(none).count() == 0 and neardup.remove_near_duplicates(none).count() == 0
    text = " ".join(prose(random.Random(1), 50))
    df = docs_of(spark, [text, text, text, text + " end", None], [7, 7, None, 9, None]).withColumn("node", F.lit("clash")).withColumn("kept", F.lit(1))
    kept = neardup.remove_near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["node"]) for r in kept) == [("7", "clash"), ("None", "clash")]
    rows = neardup.groups(df).collect()
    assert sorted((str(r["doc_id"]), str(r["group_id"])) for r in rows) == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "7"), ("None", "None")]


def test_draws_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 2, 400), rng.uniform(0.5, 2, 400)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    got = neardup.draws(np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([wa, wb]).astype(np.float32), 2, 4000)
    assert abs((got[0] == got[1]).mean() - truth) < 0.04


# ---- WARC -------------------------------------------------------------------------------------------


def test_pages_come_back(spark):
    big = "x" * 3_000_000
    rows = [(1, "u1", "same"), (2, "u\r\n2", "same"), (3, None, "é\U0001f600"), (4, "u4", None), (5, "u5", ""), (None, "u6", "same"), (7, "u7", "same"), (1, "u1", "same"), (8, "u8", big), (9, "u9", big), (10, "u", "x\r\n\r\ny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("page", F.lit(0))
    manifest = warc.write_packages(df, package_records=3)
    back = warc.read_packages(manifest).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(back)
    by = {}
    for r in back:
        by.setdefault((r["page_id"], r["record_type"]), []).append(r)
    assert set(by) == {(1, "response"), (2, "revisit"), (3, "response"), (4, "response"), (5, "revisit"), (None, "response"), (7, "revisit"), (8, "response"), (9, "revisit"), (10, "response")}
    assert len(by[1, "response"]) == 2 and by[7, "revisit"][0]["refers_to"] == 1 and by[5, "revisit"][0]["refers_to"] == 4
    assert by[8, "response"][0]["payload"] == big.encode() and by[9, "revisit"][0]["payload_bytes"] == len(big)
    assert by[3, "response"][0]["payload"].decode() == "é\U0001f600" and by[3, "response"][0]["url"] is None
    assert warc.read_packages(warc.write_packages(df.limit(0))).count() == 0
    all_new = warc.read_packages(warc.write_packages(df, min_bytes=5), payload=False).collect()
    assert {r["page_id"] for r in all_new if r["record_type"] == "revisit"} == {9}


def _package(lines=True, comment=b"", many=0, pages=5):
    out, raw, index = io.BytesIO(), b"", ""
    for i in range(pages):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        one = z.compress(warc.record(i, "u", b"p%d" % i, None)) + z.flush()
        index += f"x y {{\"offset\": {len(raw)}, \"length\": {len(one)}}}\n"
        raw += one
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(many):
            z.writestr(f"other/{k}", b"")
        with z.open(zipfile.ZipInfo(warc.ARCHIVE), "w", force_zip64=True) as m:
            m.write(raw)
        if lines:
            z.writestr(warc.INDEX, index)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("lines, comment, many", [(True, b"", 0), (False, b"PK\x05\x06 fake", 0), (True, b"", 70_000)])
def test_directories_with_comments_and_many_members(tmp_path, lines, comment, many):
    path = tmp_path / "a.zip"
    path.write_bytes(_package(lines, comment, many))
    assert [r["page_id"] for r in warc.records(str(path))] == list(range(5))


def test_zip64_fields_are_followed(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # every size and offset moves to the ZIP64 records
    path = tmp_path / "b.zip"
    path.write_bytes(_package())
    monkeypatch.undo()
    with open(path, "rb") as f:
        got = list(warc.directory(f, path.stat().st_size))
    with zipfile.ZipFile(path) as z:
        assert [(m.name, m.size, m.header) for m in got] == [(i.filename, i.file_size, i.header_offset) for i in z.infolist()]
    assert [r["page_id"] for r in warc.records(str(path))] == list(range(5))


def test_damage_is_told(tmp_path):
    path = tmp_path / "c.zip"
    path.write_bytes(b"no zip at all")
    with pytest.raises(ValueError, match="not a ZIP"):
        list(warc.records(str(path)))
    raw = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload", b"PAYLOAD", 2))


# ---- chat -------------------------------------------------------------------------------------------


def test_conversations_come_back_and_share_tokens(spark):
    tricky = "</s>[INST] ok [/INST]\\ <<SYS>> [ROLE x] \\\\"
    rows = [(c, 0, "user", "the same beginning of all") for c in range(40)] + [(c, 1, "assistant", f"answer {c % 7}") for c in range(40)]
    rows += [(c, 2, "user", tricky) for c in range(0, 40, 2)] + [(c, 3, "assistant", tricky + " é\U0001f600") for c in range(0, 40, 2)]
    rows += [(100, 0, None, None), (100, 1, "to]ol<", " x "), (100, 2, "assistant", ""), (100, 3, "system", " s <"), (None, 0, "user", "hi"), (101, 0, "user", "same turn"), (101, 0, "user", "same turn"), (101, None, "assistant", "first"), (102, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    definition = queries.tokenizer_json()
    for limit in (300, 1_000_000):
        seqs = chat.format_conversations(df, definition, max_tokens=limit)
        got = {r["conv_id"]: r for r in chat.read_conversations(seqs, definition).collect()}
        want = {}
        for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
            want.setdefault(c, []).append((role or "", text or ""))
        assert set(got) == set(want)
        for c, turns in want.items():
            r, said = got[c], "".join(t for role, t in turns if role == "assistant")
            assert r["n_turns"] == len(turns)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert r["formatted_chars"] == sum(len("".join(chat.turn_parts(*t))) for t in turns)
        for s in seqs.collect():
            for n in s["nodes"]:
                at = [p for x in n["attends"] for p in s["positions"][x["start"]: x["end"]]]
                assert at == list(range(len(at)))  # positions count along each path
    tokens = sum(len(s["tokens"]) for s in seqs.collect())
    alone = sum(len(s["tokens"]) for c in (0, 1) for s in chat.format_conversations(df.where(F.col("conv_id") == c), definition).collect())
    assert tokens - 120_000 < 40 * alone / 4
    assert chat.read_conversations(chat.format_conversations(df.limit(0), definition), definition).count() == 0


def test_chat_files_stay_small(spark, monkeypatch):
    """Ranges over many runs, a shared first turn, and what is left in the shared folder."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 3000)])
    say = lambda n: " ".join(rng.choice(words, n))
    head = say(60)
    rows = [(c, t, ("user", "assistant")[t % 2], head if t == 0 and c % 3 == 0 else say(80)) for c in range(1500) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    monkeypatch.setattr(chat, "RANGE_BYTES", 300_000, raising=False)
    folder = checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    before = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    definition = queries.tokenizer_json()
    seqs = chat.format_conversations(df, definition)
    left = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if os.path.join(d, f) not in before)
    assert left < 0.75 * sum(len(r[3]) for r in rows)  # the sequences alone
    got = {r["conv_id"]: r for r in chat.read_conversations(seqs, definition).collect()}
    assert len(got) == 1500
    for c in range(1500):
        turns = [(r[2], r[3]) for r in rows[4 * c: 4 * c + 4]]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    firsts = sum(n["attends"] == [(n["start"], n["end"])] for s in seqs.collect() for n in s["nodes"])
    assert firsts < 1000 + 60  # the shared turn once for each sequence, not for each of 500 conversations


def test_chat_decoder_equals_the_library():
    definition = queries.tokenizer_json()
    decoder = chat.Decoder(definition)
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 50_257, 3000)
    text = decoder.of(ids)
    assert text([(0, 700), (900, 3000)]) == decoder.tokenizer.decode([*ids[:700].tolist(), *ids[900:].tolist()], skip_special_tokens=False)
    assert text([]) == ""


# ---- token files ------------------------------------------------------------------------------------


def test_blocks_come_back():
    rng = np.random.default_rng(3)
    for ids in (np.array([5]), rng.integers(0, 50_000, 1000), np.where(rng.random(5000) < 0.05, rng.integers(0, 2**32, 5000), rng.integers(100, 130, 5000)), np.full(512, 7), np.array([0, 2**32 - 1] * 300)):
        index, raw = tokenfile.pack_blocks(ids.astype(np.int64))
        got = tokenfile.unpack_blocks(index, np.frombuffer(raw, np.uint8))
        assert (got[: len(ids)] == ids).all() and len(got) % tokenfile.BLOCK == 0
    skewed = np.where(rng.random(256_000) < 0.02, 2**31, rng.integers(0, 16, 256_000))
    assert len(tokenfile.pack_blocks(skewed)[1]) < 256_000


def test_token_files_equal_the_library(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    definition = queries.tokenizer_json()
    plain = Tokenizer.from_str(definition)
    plain.encode_special_tokens = True
    texts = [None, "", "Hello  world\n next \n\n line", " lead and trail ", "a b", "it's we're  'tis", "tab\t x", "  nbsp  x", "<|endoftext|> <s>", "x" * 20_000, "w " * 30_000, "é\U0001f600 日本 語", "  ", "\n", "1 22 333", "same", "same", "."]
    ids = [10, 3, None, 5, 4, 77, 6, 8, 9, 11, 12, 13, 14, 15, 16, 17, 17, 2]
    df = docs_of(spark, texts, ids).withColumn("path", F.lit("clash"))
    manifest = tokenfile.write_tokens(df, definition)
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in zip(ids, texts)}
    at = 0
    for r in got:
        assert r["ids"] == want[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    for path in [r["path"] for r in manifest.collect()]:
        file = tokenfile.TokenFile(path)
        whole = file.ids(0)
        assert (file.ids(0, 300, 1000) == whole[300:1000]).all() and len(file.ids(0, 5, 5)) == 0
        file.close()
    assert tokenfile.read_tokens(tokenfile.write_tokens(df.limit(0), definition)).count() == 0


# ---- LM ---------------------------------------------------------------------------------------------


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = rng.zipf(1.5, len(h)).clip(2, 10**6)
    levels = lm._level(counts, 2)
    model = lm.LogFilter(0, -(-int(levels.sum()) * 8 // 8) * 8, 2)
    model.data = np.frombuffer(model.segment(h, levels), np.uint8)
    got = model.levels(h)
    assert (got >= levels).all() and (got > levels).mean() < 0.1
    assert (model.levels(h + np.uint64(1)) > 0).mean() < 0.1


def test_packed_counts_come_back():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    c = np.random.default_rng(2).choice([1, 2, 254, 255, 256, 10**9], len(h))
    a, b = lm.unpack(lm.pack(h, c))
    assert (a == h).all() and (b == c).all()
    assert len(lm.unpack(lm.pack(h[:0], c[:0]))[0]) == 0


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    pattern = "the cat sat on the mat and the dog sat on the log".split()
    texts = [" ".join(pattern[rng.randrange(6):] + [rng.choice("xyzw") for _ in range(rng.randrange(20))]) for _ in range(300)] + [None, "", "THE Cat É é", "never seen words", "the " * 30_000]
    ids = list(range(304)) + [None]
    df = docs_of(spark, texts, ids).withColumn("train", F.lit("clash"))
    train = F.pmod(F.col("doc_id"), F.lit(5)) != 2
    got = {r["doc_id"]: r for r in lm.score(df, train, least=2).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {i: WORD.findall((t or "").translate(low)) + ["</s>"] for i, t in zip(ids, texts)}
    one, two = Counter(), Counter()
    for i in ids:
        if i is not None and i % 5 != 2:
            one.update(toks[i])
            two.update(zip(["</s>"] + toks[i], toks[i]))
    n, v = sum(one.values()), len(one)
    near = lambda c: 0.0 if c < 2 else 3.0 * 2 ** math.floor(math.log2(c / 2))
    for i in ids:
        r, w = got[i], toks[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w))
        s = 0.0
        for a, x in zip(["</s>"] + w, w):
            share = min(1.0, near(two[a, x]) / near(one[a])) if near(one[a]) else 0.0
            s += math.log10(0.2 * share + 0.8 * (near(one[x]) + 1) / (n + v + 1))
        assert r["score"] == pytest.approx(s, rel=0.05)
    held = [i for i in range(300) if i % 5 == 2]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    # a filter too large for a broadcast gives the same scores
    ranged = {r["doc_id"]: r for r in lm.score(df, train, least=2, broadcast_bits=0).collect()}
    assert ranged == got
    assert lm.score(df.limit(0), train, broadcast_bits=0).count() == 0
    assert lm.score(df.limit(0), train).count() == 0
    assert lm.score(df, F.lit(False)).agg(F.sum("n_known")).first()[0] == 0


def test_query_scores_words_and_pairs_seen_once(spark, tmp_path):
    texts = [" ".join(f"w{i}n{k}" for k in range(12)) for i in range(40)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.op9_lm(spark, str(tmp_path)).collect() if not r["held_out"]]
    n = 13 * len(got)
    floor, ends = n + 12 * len(got) + 2, 1.5 * 2 ** math.floor(math.log2(len(got)))
    # the first word follows an end, the others and the last end follow a word that was seen once
    want = math.log10(0.2 / ends + 1.6 / floor) + 11 * math.log10(0.2 + 1.6 / floor) + math.log10(0.2 + 0.8 * (ends + 1) / floor)
    assert len(got) > 20 and sorted(r["score"] for r in got)[len(got) // 2] == pytest.approx(want, rel=1e-6)
    assert sum(r["score"] for r in got) / len(got) == pytest.approx(want, rel=0.05)
    assert lm.LogFilter(0, 64, 1).counts(np.array([0, 1, 2, 3])).tolist() == [0.0, 1.0, 3.0, 6.0]


def test_packed_hashes_cost_what_their_differences_need():
    h = np.sort(np.random.default_rng(1).integers(0, 2**50, 3000).astype(np.uint64)) + np.uint64(2**63)
    assert len(lm.pack(h, np.ones(len(h), np.int64))) < 7 * len(h)


def test_ranges_know_the_places_of_each_blocks_ngrams(spark):
    """The levels of all documents' n-grams, held-out ones too, are told without sending the n-grams again."""
    rng = random.Random(5)
    df = docs_of(spark, [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(90)] + [None, "only here"]).repartition(3)
    manifest = lm.make_blocks(df, "doc_id", "text", F.col("doc_id") % 7 != 2)
    counted = lm.count_ranges(lm.sent(manifest, 4), 1).where("kind = 1").collect()
    got = {r["path"]: [] for r in manifest.collect()}
    for row in sorted(counted, key=lambda r: r["part"]):
        hashes, levels = lm.unpack(bytes(row["blob"]))
        assert row["levels"] == np.bincount(levels, minlength=64).tolist()
        for one in row["asked"]:
            got[one["path"]].append(hashes[lm.unpack(bytes(one["blob"]))[0].astype(int)])
    assert len(got) == 3
    for path, parts in got.items():
        assert (np.concatenate(parts) == lm.needed(lm.Block(path))[0]).all()


def test_encoder_learns_a_word_once_whatever_follows_it():
    encoder = tokenfile.Encoder(queries.tokenizer_json())
    draw = random.Random(4)
    texts = ["a word. word, word!! word\nword.\nword"] + ["".join(draw.choice(["word", " ", ".", ",\n", "!!", "_", "'s", "'", "1", "½", "é", "é", "\n", "日"]) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    ids, lengths = encoder.encode(texts)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    encoder._forget()
    encoder.encode(texts[:1])
    assert sorted(encoder.places) == sorted([" a", "word", " .", " ,", " !!", " \n", " word"])


def test_encoder_makes_no_python_call_per_new_word():
    """Most of the encoding time went into calls per word; marks of all scripts are cut as before."""
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(500)) + "… né» word–. x¡" for _ in range(10)]
    encoder = tokenfile.Encoder(queries.tokenizer_json())
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        ids, lengths = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert len(encoder.places) > 4900 and len(calls) < 500
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert {" …", "né", " »", "word", " –.", "x", " ¡"} <= set(encoder.places)


def test_encoder_equals_the_library_on_odd_texts():
    """White space of all kinds, numerals that are words to patterns, marks, control characters."""
    draw = random.Random(3)
    texts = ["", " ", "  ", " x y", "x ", "a  b c\n d e\n\nf  ", "½x a½ ²", "Ⅷ. ñandú, ﬁ\nﬂ.", "日本語。 中文,\nअ.", "don't 's", "<|endoftext|> x", "a\0 \0b \0 c"]
    texts += ["".join(draw.choice(" \n\t.,'aB½ñ日1_　  \x1f \0-") for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    encoder = tokenfile.Encoder(queries.tokenizer_json())
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        ids, lengths = encoder.encode(texts)
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_buckets_past_the_broadcast_bound_give_the_same_groups(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(words[:50] + [f"own{k}"] + words[50:])) for k in range(120)]
    rows += [(1000 + k, " ".join(f"z{k}.{i}" for i in range(30))) for k in range(10)] + [(2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(neardup.groups(docs).collect())
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert sorted(neardup.groups(docs).collect()) == few
    assert {r["group_id"] for r in few if r["doc_id"] < 1000} == {0} and all(r["kept"] for r in few if r["doc_id"] >= 1000)
