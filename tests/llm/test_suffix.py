"""Suffix arrays, common prefixes and removed passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tabulyst.llm import queries, suffix
from tabulyst.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.mark.parametrize("wide,few", [(2, 1), (5, 1), (2048, 1), (2, 4), (2048, 1 << 18)])
def test_suffix_array_and_prefixes_equal_sorting(monkeypatch, wide, few):
    monkeypatch.setattr(suffix, "WIDE", wide)
    monkeypatch.setattr(suffix, "FEW_NAMES", few)
    rng = random.Random(wide)
    for _ in range(150):
        k = rng.choice([2, 3, 6, 40])
        t = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        sa = suffix.suffix_array(np.array(t), k + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffix.common_prefixes(np.array(t), sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while i + n < len(t) and j + n < len(t) and t[i + n] == t[j + n] >= 2:
                n += 1
            assert shared[i] == n


def test_string_hashes_depend_on_content_alone():
    raw = np.frombuffer(b"abcdeabcdeabcdefgh" * 3, np.uint8)
    for size in (1, 2, 3, 5, 7, 16):
        h, seen = suffix.string_hashes(raw, size), {}
        assert len(h) == len(raw) - size + 1
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(raw[i: i + size].tobytes(), x) == x
        assert len(set(seen.values())) == len(seen)


def brute(rows, size):
    """(id, kept bytes, spans) per row."""
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), float("inf") if i is None else i
        for s in range(len(b) - size + 1):
            w = b[s: s + size]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), float("inf") if i is None else i
        gone = [False] * len(b)
        for s in range(len(b) - size + 1):
            if least[b[s: s + size]] < k:
                gone[s: s + size] = [True] * size
        spans, s = [], 0
        while s < len(b):
            e = s
            while e < len(b) and gone[e]:
                e += 1
            if e > s:
                spans.append((s, e))
            s = max(e, s + 1)
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def corpus(rng, n):
    passage = "".join(rng.choices("abcdefgh é", k=90))
    rows = [(5, None), (6, ""), (None, passage), (None, "x" + passage), (7, "a" * 700), (8, "b" + "a" * 900), (3, "aé" * 40), (3, "aé" * 40), (9, "aé" * 41)]
    texts = []
    for i in range(10, n):
        t = "".join(rng.choices("abcdefgh é", k=rng.randrange(0, 300)))
        if i % 3 == 0:
            t = t[: rng.randrange(len(t) + 1)] + passage[rng.randrange(30):] + t
        if i % 7 == 0 and texts:
            t = rng.choice(texts)
        if i % 5 == 0 and texts:
            t += rng.choice(texts)[rng.randrange(40):]
        texts.append(t)
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,hot,longest,segment", [(50, 20_000, 256, 1 << 17), (50, 8, 4, 100), (20, 5, 256, 64), (3, 20_000, 256, 1 << 17)])
def test_removed_passages_equal_brute_force(spark, monkeypatch, size, hot, longest, segment):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1 << 12)
    rng = random.Random(size + hot)
    rows = corpus(rng, 80)
    # in one process, as settings do not reach the workers
    for name, value in (("HOT_RUNS", hot), ("LONGEST", longest), ("_SEGMENT", segment)):
        monkeypatch.setattr(suffix, name, value)
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    at = np.append(0, np.cumsum([len((t or "").encode()) for _, t in rows]))
    start, count, _ = suffix.runs(raw, at, size)
    covered = sorted(s + i for s, c in zip(start.tolist(), count.tolist()) for i in range(c))
    assert covered == [p for a, b in zip(at[:-1].tolist(), at[1:].tolist()) for p in range(a, b - size + 1)]
    assert count.max() <= longest
    got = suffix.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size).collect()
    assert sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr) == brute(rows, size)


def test_hot_anchors_are_dealt_string_by_string(spark, monkeypatch):
    rng = random.Random(4)
    rows = corpus(rng, 60)
    whole = suffix.Fragments.__init__
    blocks = []

    def kept(self, path, told, size, bits):
        hot = [suffix.pack(h, np.full(len(h), 2)) for h, _ in map(suffix.unpack, told)]
        whole(self, path, hot, size, bits)
        blocks.append(self)

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = suffix.make_blocks(docs, "doc_id", "text")
    path = manifest.first().path
    told = [r for r in suffix.repeated(suffix.anchors(manifest, 50, 1)).collect()]
    kept(block := object.__new__(suffix.Fragments), path, [bytes(r.blob) for r in told], 50, 1)
    assert all(len(x) == 50 for x in block.distinct) and (block.count == 1).all()
    raw = block.raw.tobytes()
    assert all(block.distinct[w] == raw[s: s + 50] for s, w in zip(block.start.tolist(), block.which.tolist()))
    answers = []
    for part, index in block.shards():
        found = suffix.least_documents([block.distinct[i] for i in index.tolist()], block.document[index], 50)
        answers.append((1, part, suffix._zip(np.concatenate(found).astype("<i8"))))
    monkeypatch.setattr(suffix, "Fragments", lambda *a: block)
    got = [r for b in suffix._cut(path, answers, 50, 1) for r in b.to_pylist()]
    assert sorted(((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept"]) for r in got), key=repr) == brute(rows, 50)


def test_lone_fragments_share_no_string_with_others():
    rng = random.Random(11)
    raw = "".join(t or "" for _, t in corpus(rng, 60)).encode()
    start, count, _ = suffix.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 50)
    fragments = sorted({raw[s: s + c + 49] for s, c in zip(start.tolist(), count.tolist())})
    lone = suffix._lone(fragments, 50)
    holders = {}
    for k, f in enumerate(fragments):
        for i in range(len(f) - 49):
            holders.setdefault(f[i: i + 50], set()).add(k)
    shared = {k for ks in holders.values() if len(ks) > 1 for k in ks}
    assert lone.any() and not any(lone[k] for k in shared)


def test_fragments_without_repeated_context_are_not_sent(spark):
    """Anchors that many different texts have by chance are no reason to send their fragments, however many texts have them."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=16)) for _ in range(40)]  # runs of an anchor's length that repeat everywhere
    texts = ["".join(rng.choice(words) + "".join(rng.choices("rstuvwxyz", k=24)) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, texts[3][200:420])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = suffix.make_blocks(docs, "doc_id", "text")
    told = [bytes(r.blob) for r in suffix.repeated(suffix.anchors(manifest, 50, 2)).collect()]
    block = suffix.Fragments(manifest.first().path, told, 50, 2)
    assert 171 <= block.count.sum() / 2 < 171 + 200  # the copied strings, in both texts, and little else of 96,000
    got = suffix.remove_passages(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr) == brute(rows, 50)


@pytest.mark.parametrize("size,longest", [(50, 256), (20, 256), (20, 3), (3, 256), (17, 5)])
def test_parts_shared_by_fragments_have_their_least_document(monkeypatch, size, longest):
    monkeypatch.setattr(suffix, "LONGEST", longest)
    rng = random.Random(size)
    texts = sorted({t for _, t in corpus(rng, 70) if t})
    texts += [t[:k] + "#" + t[k + 1:] for t in texts for k in (len(t) // 3, len(t) // 2)]
    raw = "".join(texts).encode()
    at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    start, count, _ = suffix.runs(np.frombuffer(raw, np.uint8), at, size)
    fragments = sorted({raw[s: s + c + size - 1] for s, c in zip(start.tolist(), count.tolist())})
    documents = np.array([rng.randrange(1000) for _ in fragments])
    assert (suffix._common(fragments, documents, size) == suffix._least_values(fragments, documents, size)).all()


def test_passages_query_of_sample_and_empty_table(spark, tmp_path):
    rows = corpus(random.Random(9), 40)
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_passages(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(((i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(k).hexdigest()) for i, n, spans, k in brute(rows, 50)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_passages(empty).count() == 0
