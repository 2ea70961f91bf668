"""Collocations from a weighted de Bruijn graph of word n-grams.

Nodes are three-word sequences; an edge is a four-word phrase that joins two overlapping nodes, weighted
by its occurrences. Only edges, and the shorter rests at the ends of pieces, are counted in texts. All
shorter counts follow from flow: whatever enters a node leaves it by an edge or ends there with its piece, so
``f(three words) = sum of their edges + pieces ending with them``, and in the same way down to pairs and words.
Edges of ``least`` or more occurrences are compacted: nodes with one such edge in and one out are inside a path, and
every path (:func:`unary_paths`) is one row of words and weights.

Flow, every step proportional to the input:

1. Each task turns its documents into blocks in the shared folder: distinct words by language, and the texts as indexes
   of them, with the ends of pieces.
2. Words get dense ids: each block sends its distinct words by hash range, and is answered with ids. Words are compared whole,
   so ids are exact; phrases are tuples of ids.
3. Each block sends its distinct edges and rests, packed, by the hash of their first two words, so that a range holds whole
   nodes. First pairs that hold a large share (judged on ``SAMPLE`` places per block, which affects the
   dealing alone) are dealt by the whole phrase instead, and their flows are summed in Spark.
4. A range adds up its edges and passes on the flows that matter: phrases of ``least`` or more, partial flows of dealt-out pairs, and
   the flow of each word.

Collocations are scored at their weakest cut; a phrase is dropped when a longer candidate accounts for most of its
occurrences, which paths tell for their inner nodes. Sums and products are integers and decimals, never floats.

Defined cases: null texts are empty; a null language is ``und``; an empty table gives an empty result; repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyst.llm.common import checked_broadcast, new_folder, written
from tabulyst.llm.files import create, own_name, reader
from tabulyst.llm.hashing import mix64, text_bytes
from tabulyst.llm.neardup import slices
from tabulyst.result import Tables

#: Text bytes per block, phrases per range, sampled places per block and the sampled places that make a pair large.
BLOCK_BYTES, RANGE_PHRASES, SAMPLE, LARGE = 8 << 20, 1_000_000, 1000, 600
LONGEST = 4
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _ENDS.copy()
_GAP[[0x20, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _zip(x: np.ndarray) -> bytes:
    """Integers by byte planes: high bytes, mostly equal, compress to nothing."""
    x = np.ascontiguousarray(x, "<u8")
    data = np.ascontiguousarray(x.view("u1").reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    data = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, n).T).view("<u8").ravel()


def _join(parts: list[bytes]) -> bytes:
    return json.dumps([len(p) for p in parts]).encode() + b"\n" + b"".join(parts)


def _split(blob: bytes) -> list[bytes]:
    head, _, body = blob.partition(b"\n")
    out, lo = [], 0
    for n in json.loads(head):
        out.append(body[lo: lo + n])
        lo += n
    return out


# ---- blocks -----------------------------------------------------------------------------------------


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (A-Z lower-cased) as bytes, and for each whether it is the last of its piece."""
    raw, at = text_bytes(texts)
    raw = _LOWER[raw]
    inside = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    begin = np.flatnonzero(begins)
    if not len(begin):
        return pa.array([], pa.large_binary()), np.zeros(0, bool)
    offsets = np.append(0, np.cumsum(inside))[np.append(begin, len(raw))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    piece = np.cumsum(_ENDS[raw]) + np.cumsum(edge[:-1])
    last = np.ones(len(begin), bool)
    last[:-1] = piece[begin[1:]] != piece[begin[:-1]]
    return words, last


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _save_block(folder: str, held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
    texts, langs = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    kinds = langs.dictionary_encode()
    index, last, vocabulary, counts = [], [], [], []
    for k, lang in enumerate(kinds.dictionary.to_pylist()):
        words, ends = split_words(texts.filter(pa.compute.equal(kinds.indices, k)))
        coded = words.dictionary_encode()
        index.append(coded.indices.to_numpy().astype(np.int64) + len(vocabulary))
        last.append(ends)
        # a word has no line feed, so the first one parts it from its language
        vocabulary += [w + b"\n" + lang.encode() for w in coded.dictionary.to_pylist()]
        counts.append((lang, len(words)))
    places, ends = np.concatenate(index), np.concatenate(last)
    hashes = np.array([_word_hash(w) for w in vocabulary], np.uint64)
    path = own_name(folder, ".block")
    text = pa.compress(b"".join(vocabulary), codec="zstd", asbytes=True)
    lengths = np.array([len(w) for w in vocabulary], np.int64)
    with create(path) as out:
        out.write(_join([_zip(places), np.packbits(ends).tobytes(), hashes.astype("<u8").tobytes(), _zip(lengths), text]))
    chosen = np.random.default_rng(len(places)).integers(0, max(1, len(places)), SAMPLE)[: len(places)]
    following = np.where(ends, 0, np.append(hashes[places[1:]], np.uint64(0)) if len(places) else np.zeros(0, np.uint64))
    pairs = mix64(hashes[places[chosen]] * _PAIR + following[chosen]) if len(places) else np.zeros(0, np.uint64)
    return pa.record_batch([pa.array([path]), pa.array([len(places)], pa.int64()), pa.array([len(vocabulary)], pa.int64()),
                            pa.array([[{"lang": x, "n": n} for x, n in counts]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))),
                            pa.array([pairs.astype(np.int64).tolist()], pa.list_(pa.int64()))], ["path", "words", "distinct", "langs", "sample"])


class Block:
    """A block read back: ``places`` (indexes of words), ``ends`` (last of a piece), ``hashes`` of the distinct words."""

    def __init__(self, path: str):
        with reader(path) as file:
            self.parts = _split(file.read())
        self.places = _unzip(self.parts[0]).astype(np.int64)
        self.ends = np.unpackbits(np.frombuffer(self.parts[1], "u1"), count=len(self.places)).astype(bool)
        self.hashes = np.frombuffer(self.parts[2], "<u8")

    def words(self) -> pa.Array:
        lengths = _unzip(self.parts[3]).astype(np.int64)
        offsets = np.append(0, np.cumsum(lengths))
        data = pa.decompress(self.parts[4], decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def make_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Manifest ``path, words, distinct, langs, sample`` of the blocks of all texts."""
    folder = new_folder(docs.sparkSession, "phrase-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                held.append((b.column("text").cast(pa.large_string()), b.column("lang")))
                size += b.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield _save_block(folder, held)
                    held, size = [], 0
        if held:
            yield _save_block(folder, held)

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return written(rows.mapInArrow(save, "path string, words long, distinct long, langs array<struct<lang: string, n: long>>, sample array<long>"), "phrase-manifest")


# ---- word ids ---------------------------------------------------------------------------------------


def _part(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(part) else np.zeros(0, np.int64)
    return [(int(part[x[0]]), x) for x in np.split(order, cut[1:]) if len(x)]


def _arrow_bytes(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([words], ["w"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def word_ids(manifest: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(``path, part, blob``: each block's word ids by range, and ``id, word, lang``). Ids of range p are p + 1, p + 1 + 2**bits, ..."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                block = Block(path)
                words, found = block.words(), _by_part(_part(block.hashes, bits))
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array([p for p, _ in found], pa.int32()),
                                       pa.array([_arrow_bytes(words.take(pa.array(ix))) for _, ix in found], pa.binary())], ["path", "part", "blob"])

    def number(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, paths, lists = key[0].as_py(), [], []
        for b in batches:
            paths += b.column("path").to_pylist()
            lists += [pa.ipc.open_stream(x.as_py()).read_all().column("w").combine_chunks() for x in b.column("blob")]
        coded = pa.concat_arrays([x.cast(pa.large_binary()) for x in lists]).dictionary_encode()
        ids = (coded.indices.to_numpy().astype(np.int64) << bits) + part + 1
        cut = np.cumsum([len(x) for x in lists])[:-1]
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array([part] * len(paths), pa.int32()), pa.array([_zip(x) for x in np.split(ids, cut)], pa.binary()),
                               pa.nulls(len(paths), pa.int64()), pa.nulls(len(paths), pa.binary())], ["path", "part", "blob", "id", "word"])
        words = coded.dictionary.cast(pa.binary())
        own = (np.arange(len(words)) << bits) + part + 1
        for lo in range(0, len(words), 50_000):
            some = words.slice(lo, 50_000)
            yield pa.record_batch([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()),
                                   pa.array(own[lo: lo + 50_000], pa.int64()), some], ["path", "part", "blob", "id", "word"])

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    sent = files.mapInArrow(send, "path string, part int, blob binary")
    both = written(sent.groupBy("part").applyInArrow(number, "path string, part int, blob binary, id long, word binary"), "phrase-words")
    text = F.col("word").cast("string")
    at = F.instr(text, "\n")
    words = both.where("id is not null").select("id", F.substring(text, F.lit(1), at - 1).alias("word"), F.substring(text, at + 1, F.length(text)).alias("lang"))
    return both.where("path is not null").select("path", "part", "blob"), words


# ---- edges and flows --------------------------------------------------------------------------------


def block_edges(block: Block, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges and rests: first pair of ids and second pair (32 bits each, 0: none), count, and the first pair's hash."""
    n = len(block.places)
    w = ids[block.places].astype(np.uint64)
    h = block.hashes[block.places]
    columns, alive, second = [w], np.ones(n, bool), np.zeros(n, np.uint64)
    for k in range(1, LONGEST):
        alive = alive.copy()
        alive[max(0, n - k):] = False
        alive[: n - k] &= ~block.ends[k - 1: n - 1]
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = w[k:]
        columns.append(np.where(alive, shifted, np.uint64(0)))
        if k == 1:
            second[: n - 1] = h[1:]
            second = np.where(alive, second, np.uint64(0))
    first, rest = (columns[i] << np.uint64(32) | columns[i + 1] for i in (0, 2))
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    at = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1]))) if n else np.zeros(0, np.int64)
    return first[at], rest[at], np.diff(np.append(at, n)), mix64(h[order[at]] * _PAIR + second[order[at]])


def edges_sent(manifest: DataFrame, ids: DataFrame, large: DataFrame, bits: int, word_bits: int) -> DataFrame:
    """``part, blob`` of each block's edges; ``spread`` tells edges of large pairs, which are dealt by the whole phrase."""
    hot = np.array([r[0] for r in large.collect()], np.int64).astype(np.uint64)  # at most SAMPLE / LARGE a block
    hot = manifest.sparkSession.sparkContext.broadcast(np.sort(hot))

    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(key[0].as_py())
        got = {p: _unzip(x.as_py()) for b in batches for p, x in zip(b.column("part").to_pylist(), b.column("blob"))}
        own = np.zeros(len(block.hashes), np.int64)
        for p, index in _by_part(_part(block.hashes, word_bits)):
            own[index] = got[p]
        if len(own) and own.max() >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        first, rest, count, pair = block_edges(block, own)
        spread = np.isin(pair, hot.value)
        part = _part(np.where(spread, mix64(first * _PAIR + mix64(rest)), pair), bits)
        for flag in (False, True):
            mine = np.flatnonzero(spread == flag)
            for p, ix in _by_part(part[mine]):
                ix = np.sort(mine[ix])
                blob = _join([_zip(np.diff(first[ix], prepend=np.uint64(0))), _zip(rest[ix]), _zip(count[ix])])
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([flag]), pa.array([blob], pa.binary())], ["part", "spread", "blob"])

    return ids.groupBy("path").applyInArrow(send, "part int, spread boolean, blob binary")


def _sums(key: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and the sum of the weights of each."""
    new = np.zeros(len(weight), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.add.reduceat(weight, at) if len(at) else weight[:0]


def flows(sent: DataFrame, least: int) -> DataFrame:
    """``first, rest, f``: phrases as two pairs of ids (0: none), whole or partial counts, from the edges of each range."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[bool, list] = {False: [], True: []}
        for b in batches:
            for spread, blob in zip(b.column("spread").to_pylist(), b.column("blob")):
                steps, rest, count = (_unzip(p) for p in _split(blob.as_py()))
                lists[spread].append((np.cumsum(steps, dtype=np.uint64), rest, count.astype(np.int64)))
        low = np.uint64(0xFFFFFFFF)
        found = []
        for spread, got in lists.items():
            if not got:
                continue
            first, rest, count = (np.concatenate([g[i] for g in got]) for i in range(3))
            order = np.lexsort((rest, first))
            first, rest, count = first[order], rest[order], count[order]
            at, count = _sums([first, rest], count)
            first, rest = first[at], rest[at]
            edge = (rest & low > 0) & (count >= least)
            found.append((first[edge], rest[edge], count[edge]))
            # what leaves a node, and what ends there, is its flow; so down to pairs and words
            for keys, has in (([first, rest >> np.uint64(32)], rest >> np.uint64(32) > 0), ([first], first & low > 0), ([first >> np.uint64(32)], None)):
                at, total = _sums(keys, count)
                f, r = first[at], rest[at] >> np.uint64(32) << np.uint64(32)
                if len(keys) == 1:
                    r = np.zeros(len(at), np.uint64)
                    f = f if has is not None else f >> np.uint64(32) << np.uint64(32)
                use = np.ones(len(at), bool) if has is None else has[at] & ((total >= least) | spread)
                found.append((f[use], r[use], total[use]))
        first, rest, f = (np.concatenate([x[i] for x in found]) for i in range(3))
        for lo in range(0, len(f), 100_000):
            yield pa.record_batch([pa.array(x[lo: lo + 100_000].astype(np.int64)) for x in (first, rest, f)], ["first", "rest", "f"])

    rows = sent.groupBy("part").applyInArrow(add, "first long, rest long, f long")
    return rows.groupBy("first", "rest").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _high(x: str) -> Column:
    return F.shiftrightunsigned(F.col(x), 32)


def _low(x: str) -> Column:
    return F.col(x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


# ---- paths ------------------------------------------------------------------------------------------


def unary_paths(edges: DataFrame) -> DataFrame:
    """``ids, weights``: the compacted paths of the edges ``w1, w2, w3, w4, f``; m weights join m + 1 nodes of m + 3 ids.

    A node with one edge in and one out is inside a path. Inner nodes point at their predecessor; pointers double until they
    reach the path's first inner node. On a cycle of inner nodes alone they never do, which shows when a
    round ends no more of them; such a cycle is opened at its least node.
    """
    tail, head = F.struct(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("w3").alias("z")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y"), F.col("w4").alias("z"))
    edges = written(edges.select(tail.alias("u"), head.alias("v"), "f"), "path-edges")
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("come"), F.lit(1).alias("go"), F.lit(None).cast(edges.schema["u"].dataType).alias("before")),
                                          F.struct(F.col("v").alias("node"), F.lit(1).alias("come"), F.lit(0).alias("go"), F.col("u").alias("before")))).alias("e")).select("e.*")
    inner = ends.groupBy("node").agg(F.sum("come").alias("come"), F.sum("go").alias("go"), F.min("before").alias("before")).where("come = 1 and go = 1").select("node", "before")
    inner = written(inner, "path-inner")
    known = inner.select(F.col("node").alias("before"), F.lit(True).alias("inside"))
    state = inner.join(known, "before", "left").select("node", F.when(F.col("inside"), F.col("before")).otherwise(F.col("node")).alias("to"),
                                                       F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("steps"), F.col("inside").isNull().alias("done"),
                                                       F.least("node", F.when(F.col("inside"), F.col("before")).otherwise(F.col("node"))).alias("least"))
    state, open_ = written(state, "path-state"), -1
    while True:
        now = state.where("not done").count()
        if now == 0:
            break
        if now == open_:  # cycles alone are left: each starts at its least node
            cut = state.where("not done").where(F.col("node") == F.col("least")).select("node")
            again = inner.join(state.where("not done").select("node"), "node", "left_semi").join(cut.withColumn("cut", F.lit(True)), "node", "left")
            again = again.select("node", F.when(F.col("cut"), F.col("node")).otherwise(F.col("before")).alias("to"), F.when(F.col("cut"), 0).otherwise(1).cast("long").alias("steps"),
                                 F.coalesce("cut", F.lit(False)).alias("done"), F.col("node").alias("least"))
            state, open_ = written(state.where("done").unionByName(again), "path-state"), -1
            continue
        open_ = now
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"), F.col("done").alias("ready"), F.col("least").alias("least2"))
        moved = state.where("not done").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ready").alias("done"),
                                                                 F.least("least", "least2").alias("least"))
        state = written(state.where("done").unionByName(moved), "path-state")
    place = state.select("node", F.col("to").alias("path"), "steps")
    first = place.where("steps = 0").select(F.col("node").alias("v"), F.col("path").alias("v_path"))
    at = edges.join(place.select(F.col("node").alias("u"), "path", "steps"), "u", "left").join(first, "v", "left")
    single = F.struct(F.col("u.x").alias("x"), F.col("u.y").alias("y"), F.col("u.z").alias("z"), F.col("v.z").alias("t"))
    whole = lambda c: F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y"), F.col(f"{c}.z").alias("z"), F.lit(None).cast("long").alias("t"))
    keyed = at.select(F.when(F.col("path").isNotNull(), whole("path")).when(F.col("v_path").isNotNull(), whole("v_path")).otherwise(single).alias("path"),
                      F.coalesce(F.col("steps") + 1, F.lit(0)).alias("at"), "u", "v", "f")
    # a path is no longer than the longest repeated passage
    rows = keyed.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", F.col("v.z").alias("next"), "f", "u"))).alias("e"))
    start = F.col("e")[0]["u"]
    return rows.select(F.concat(F.array(start["x"], start["y"], start["z"]), F.transform("e", lambda x: x["next"])).alias("ids"), F.transform("e", lambda x: x["f"]).alias("weights"))


# ---- collocations -----------------------------------------------------------------------------------


def phrase_graph(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> Tables:
    """``totals`` (lang, n), ``words`` (id, word, lang, f) and ``phrases`` (n_words, w1..w4, f) of ``least`` or more, and ``paths`` (ids, weights)."""
    manifest = make_blocks(docs, text, lang)
    row = manifest.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    bits, word_bits = (max(0, int(np.ceil(np.log2(max(1, x) / RANGE_PHRASES)))) for x in row)
    totals = manifest.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
    large = manifest.select(F.explode("sample").alias("pair")).groupBy("pair").count().where(F.col("count") >= LARGE).select("pair")
    ids, words = word_ids(manifest, word_bits)
    counted = written(flows(edges_sent(manifest, ids, large, bits, word_bits), least), "phrase-flows")
    counted = counted.select(_high("first").alias("w1"), _low("first").alias("w2"), _high("rest").alias("w3"), _low("rest").alias("w4"), "f")
    frequent = counted.where("w2 = 0").select(F.col("w1").alias("id"), "f")
    frequent = written(words.join(frequent, "id"), "phrase-vocabulary")
    n = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    phrases = counted.where("w2 > 0").select(n.alias("n_words"), "w1", "w2", "w3", "w4", "f")
    paths = written(unary_paths(phrases.where("n_words = 4")), "phrase-paths")
    return Tables(totals=totals, words=frequent, phrases=phrases, paths=paths)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, scale: int = 2_000_000, absorbed: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to four words.

    score: floor(scale * a / (l + r)) at the cut where it is least (ties: the first). A phrase is dropped when a longer candidate
    that contains it has at least ``absorbed`` percent of its occurrences.
    """
    graph = phrase_graph(docs, text, lang, least)
    words = checked_broadcast(graph.words.select("id", "word", "lang", F.col("f").alias("one")))
    by = {k: graph.phrases.where(F.col("n_words") == k) for k in (2, 3, 4)}
    # the heaviest longer phrase around each node and pair; paths hold a node's edges side by side
    weights = F.col("weights")
    beside = F.greatest(F.coalesce(F.get(weights, F.col("i")), F.lit(0)), F.coalesce(F.get(weights, F.col("i") - 1), F.lit(0)))
    nodes = graph.paths.select("ids", "weights", F.explode(F.sequence(F.lit(0), F.size("weights"))).alias("i"))
    nodes = nodes.select(*[F.get("ids", F.col("i") + k).alias(f"w{k + 1}") for k in range(3)], beside.alias("longer")).groupBy("w1", "w2", "w3").agg(F.max("longer").alias("longer"))
    pairs = by[3].select(F.explode(F.array(F.struct("w1", "w2", "f"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))).alias("p")).groupBy("p.w1", "p.w2").agg(F.max("p.f").alias("longer"))

    def counts(k: int, *columns: str, name: str) -> DataFrame:
        return by[k].select(*[F.col(f"w{i + 1}").alias(c) for i, c in enumerate(columns)], F.col("f").alias(name))

    keep = F.coalesce(100 * F.col("longer").cast("decimal(28,0)") < absorbed * F.col("f").cast("decimal(28,0)"), F.lit(True))
    kept = {2: by[2].join(pairs, ["w1", "w2"], "left").where(keep), 3: by[3].join(nodes, ["w1", "w2", "w3"], "left").where(keep), 4: by[4].withColumn("longer", F.lit(None).cast("long"))}
    kept[3] = kept[3].join(counts(2, "w1", "w2", name="f12"), ["w1", "w2"]).join(counts(2, "w2", "w3", name="f23"), ["w2", "w3"])
    kept[4] = (kept[4].join(counts(3, "w1", "w2", "w3", name="f123"), ["w1", "w2", "w3"]).join(counts(3, "w2", "w3", "w4", name="f234"), ["w2", "w3", "w4"])
               .join(counts(2, "w1", "w2", name="f12"), ["w1", "w2"]).join(counts(2, "w3", "w4", name="f34"), ["w3", "w4"]))
    cuts = {2: [("f1", "f2")], 3: [("f1", "f23"), ("f12", "f3")], 4: [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]}
    found = None
    for k, rows in kept.items():
        for i in range(1, k + 1):
            own = words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("one").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
            rows = rows.join(own, f"w{i}")
        scored = F.array(*[F.struct(F.expr(f"cast((cast(f as decimal(28,0)) * {scale}) div (cast({x} as decimal(28,0)) + cast({y} as decimal(28,0))) as long)").alias("score"),
                                    F.lit(c).alias("cut"), F.col(x).alias("l"), F.col(y).alias("r")) for c, (x, y) in enumerate(cuts[k], 1)])
        rows = rows.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(1, k + 1)]).alias("phrase"), F.col("f").alias("a"), F.array_min(scored).alias("s"))
        found = rows if found is None else found.unionByName(rows)
    found = found.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = found.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(graph.totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
