"""Prefix tries against brute force; the spilling queue; hot starts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tabulyst.llm import queries, trie
from tabulyst.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_queue_gives_the_least_first_with_and_without_spilling():
    rng = random.Random(3)
    for most in (1, 7, 10_000):
        queue, held, out = trie.SpillingQueue(most), [], []
        for _ in range(3000):
            if held and rng.random() < 0.4:
                held.sort()
                assert queue.least() == held[0]
                out.append(queue.pop())
                assert out[-1] == held.pop(0)
            else:
                item = (rng.randrange(50), bytes([rng.randrange(256)]), rng.randrange(10 ** 15))
                queue.push(item)
                held.append(item)
        while queue.least() is not None:
            out.append(queue.pop())
        assert len(out) == len(held) + len(out) - len(held) and out[-len(held):] == sorted(held)


def brute_nodes(convs):
    """convs: id -> list of (role, text)."""
    of, ending = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            of[tuple(turns[:d])].append(c)
        ending[tuple(turns)].append(c)
    words = lambda x: len(re.findall("[^\x20\x09-\x0d]+", x))
    rows = []
    for path, inside in of.items():
        below = [p for p in of if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        parents = {p[:-1] for p in of if p}
        rows.append((min(inside), len(path), min(of[path[:-1]]) if path else None, len(inside), len(kids), sum(p not in parents for p in below),
                     sum((len(of[p]) - 1) * words(p[-1][1]) for p in below if p),
                     hashlib.sha256(",".join(map(str, sorted(ending[path]))).encode()).hexdigest()))
    return sorted(rows, key=repr)


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def talk(rng, n):
    rows = [(None, 0, "user", "lost"), (45, None, "user", "null turn"), (45, 0, None, None), (45, 0, None, None), (61, 0, "user", "alone"),
            (7, 0, "a", "bc"), (8, 0, "ab", "c")]
    for c in range(0, n):
        if c in (40, 60):  # groups without a first conversation
            continue
        turns = rng.randrange(0, 6) if c % 3 else 4
        for t in range(turns):
            same = c % 3 == 0 or rng.random() < 0.5
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same words here" if same else f"other {rng.randrange(3)}"))
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(501, t, "user", f"long {t}") for t in range(290)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns,growth,queue", [(50_000, 64, 200_000), (40, 4, 200_000), (3, 2, 1)])
def test_trie_query_equals_brute_force(spark, tmp_path, monkeypatch, turns, growth, queue):
    for name, value in (("SHARD_TURNS", turns), ("GROWTH", growth), ("QUEUE_MESSAGES", queue)):
        monkeypatch.setattr(trie, name, value)
    rows = talk(random.Random(turns), 90)
    spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_nodes(rebuilt(rows))


def test_trie_of_one_hot_conversation_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(trie, "_PACKED", 50)
    convs = {c: [("user", "hi there"), ("assistant", "yes")] + ([("user", f"x {c}")] if c % 3 else []) for c in range(200)}
    rows = [(c, i, r, x) for c, turns in convs.items() for i, (r, x) in enumerate(turns)]
    out = trie.prefix_trie(trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_nodes(convs)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.ordered_turns(none)).count() == 0
