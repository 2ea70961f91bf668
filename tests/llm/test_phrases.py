"""Collocations, the de Bruijn graph's flows and its paths against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tabulyst.llm import phrases, queries
from tabulyst.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, least, absorbed=80, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, 5):
                f[lang].update(tuple(p[i: i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i: i + k]] = max(inside[g[i: i + k]], a)
        found = []
        for g, a in cand.items():
            if 100 * inside[g] >= absorbed * a:
                continue
            score, _, x, y = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            found.append((score, a, " ".join(g), x, y))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def corpus(rng, n):
    words = ["The", "cat", "sat", "on", "mat", "é", "straße", "A", "b", "x"]
    rows = [(None, "en"), ("", None), ("ha " * 60, "en"), ("one two three one two three one two three one two three", "loop"), ("no lang here no lang here", None), (" . , ;", "en"), ("a\x0bb a\tb\x0ca b", "de\nx")]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            text += " once upon a time there was a very long fixed passage that repeats. "
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows


def test_words_and_piece_ends():
    texts = ["A b. C\n\nd e", None, "", "f", " g!h\t i"]
    words, last = phrases.split_words(pa.array(texts, pa.string()))
    want = [(w, i == len(p) - 1) for t in texts for p in pieces(t) for i, w in enumerate(p)]
    assert [(w.decode(), bool(e)) for w, e in zip(words.to_pylist(), last)] == want


def test_unary_paths_hold_each_edge_once(spark):
    rng = random.Random(2)
    edges = set()
    for _ in range(12):
        at = [rng.randrange(1, 5) for _ in range(rng.randrange(4, 12))]
        edges |= {tuple(at[i: i + 4]) for i in range(len(at) - 3)}
    long = list(range(100, 170))
    edges |= {tuple(long[i: i + 4]) for i in range(len(long) - 3)} | {(9, 9, 9, 9)}
    ring = [201, 202, 203, 204, 205] * 2
    edges |= {tuple(ring[i: i + 4]) for i in range(5)}
    weight = {e: rng.randrange(30, 90) for e in sorted(edges)}
    rows = spark.createDataFrame([(*e, f) for e, f in weight.items()], "w1 long, w2 long, w3 long, w4 long, f long")
    paths = phrases.unary_paths(rows).collect()
    got = [(tuple(p.ids[i: i + 4]), f) for p in paths for i, f in enumerate(p.weights)]
    assert sorted(got) == sorted(weight.items())
    inner = lambda x: sum(e[:3] == x for e in edges) == 1 == sum(e[1:] == x for e in edges)
    for p in paths:
        nodes = [tuple(p.ids[i: i + 3]) for i in range(len(p.ids) - 2)]
        assert all(inner(x) for x in nodes[1:-1])
        cycle = nodes[0] == nodes[-1]
        assert cycle or not (inner(nodes[0]) or inner(nodes[-1]))


@pytest.mark.parametrize("least,large,size", [(3, 300, 2_000_000), (2, 1, 200)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, large, size):
    monkeypatch.setattr(phrases, "LARGE", large)
    monkeypatch.setattr(phrases, "RANGE_PHRASES", size)
    rows = corpus(random.Random(least), 120)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, word int").repartition(3)
    got = phrases.collocations(docs, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least)


def test_phrase_query_and_empty_table(spark, tmp_path):
    rows = [(t, g) for _ in range(6) for t, g in corpus(random.Random(5), 40)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in queries.op11_phrases(spark, str(tmp_path)).collect()) == brute(rows, 30)
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
