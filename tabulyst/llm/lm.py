"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised n-gram counts: an n-gram of count c has level
``q = 1 + floor(log2(c / least))`` and is entered once for each level 1..q. A
reader probes levels 1, 2, ... until one is missing; that gives the level
back, never too low, and too high with a probability that falls geometrically. Probabilities are
interpolated from those counts: ``p(w | v) = (1 - back) c(v w) / c(v) + back (c(w) + 1) / (N + V + 1)``.

Flow, with every step proportional to the input:

1. Each task turns its documents into blocks: the block's distinct words and
   its word sequence as indexes. A block is one file in the shared folder and one manifest row.
2. Counts: each block sends its distinct words and word pairs, with their counts in training
   documents, sorted and packed by hash range. A range's task adds up what all
   blocks sent, answers each block with the exact counts of its words, and keeps
   the n-grams with their levels, and where those of each block stand among them. The number of ranges follows
   the number of words, so a task's share stays bounded. A frequent word comes once per block, so
   there is no hot key.
3. The filter: one segment per range, built where the range's n-grams are. It grows with the corpus,
   ``bits_per_entry`` for each entry, and holds every n-gram that was kept. Up to ``broadcast_bits`` it is
   broadcast and each task probes it. A larger one stays in its segments: each range answers
   the blocks with the levels of the n-grams that they sent for the counts, so n-grams are sent once, and no worker holds more than a segment.
   Both ways probe the same bits, so scores do not depend on the way.
4. Each block's file is read again and its documents are scored.

A block file is written under a name of its own and counts once its manifest
row is committed, so tasks can be repeated anywhere.

Defined cases: a null text counts as empty and holds the end token alone; rows
with a null ``train`` do not train; an empty table gives an empty result; no training
rows make all counts 0; repeated rows are scored each; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import new_folder, written
from tabulyst.llm.files import create, own_name, reader
from tabulyst.llm.hashing import mix64, word_hashes
from tabulyst.llm.neardup import slices

#: The end token's hash, and the multiplier that joins two words' hashes.
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: Text bytes per block, and n-grams per range.
BLOCK_BYTES = 12 << 20
RANGE_NGRAMS = 2_000_000
#: Probes per filter entry.
PROBES = 4


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _PAIR + second)


# ---- blocks -----------------------------------------------------------------------------------------


def _save_block(folder: str, ids: pa.Array, train: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[str, int, int]:
    """Write one block; (path, tokens, training tokens). Tokens are the words and one end per document."""
    n = len(ids)
    tokens = np.full(len(words) + n, END, np.uint64)
    ends = first[1:] + np.arange(n)
    place = np.ones(len(tokens), bool)
    place[ends] = False
    tokens[place] = words
    vocabulary, index = np.unique(tokens, return_inverse=True)
    lengths = np.diff(first) + 1
    counts = np.bincount(index[np.repeat(train, lengths)], minlength=len(vocabulary))
    parts = [zlib.compress(x.tobytes(), 1) for x in (lengths.astype("<i8"), train.astype("u1"), vocabulary.astype("<u8"), counts.astype("<i8"))]
    # indexes by byte planes: the high bytes compress well
    planes = index.astype("<u4").view("u1").reshape(-1, 4).T
    parts += [zlib.compress(np.ascontiguousarray(p).tobytes(), 1) for p in planes]
    parts.append(_ids_bytes(ids))
    path = own_name(folder, ".block")
    with create(path) as out:
        out.write(json.dumps([len(p) for p in parts]).encode() + b"\n" + b"".join(parts))
    return path, len(tokens), int(lengths[train].sum())


def _ids_bytes(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Block:
    """A block read back: ids, lengths (with ends), train flags, vocabulary hashes, training counts, indexes."""

    def __init__(self, path: str, sequence: bool = True):
        with reader(path) as file:
            raw = file.read()
        head, _, body = raw.partition(b"\n")
        parts, at = [], 0
        for n in json.loads(head):
            parts.append(body[at: at + n])
            at += n
        self.lengths = np.frombuffer(zlib.decompress(parts[0]), "<i8")
        self.train = np.frombuffer(zlib.decompress(parts[1]), "u1").astype(bool)
        self.vocabulary = np.frombuffer(zlib.decompress(parts[2]), "<u8")
        self.counts = np.frombuffer(zlib.decompress(parts[3]), "<i8")
        self.ids = pa.ipc.open_stream(parts[8]).read_all().column("id").combine_chunks()
        if sequence:
            planes = np.stack([np.frombuffer(zlib.decompress(p), "u1") for p in parts[4:8]], axis=1)
            self.index = np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


def make_blocks(docs: DataFrame, row_id: str, text: str, train: Column) -> DataFrame:
    """Manifest ``path, docs, tokens, train_tokens, train_docs`` of the blocks of all rows."""
    folder = new_folder(docs.sparkSession, "lm-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            flags = np.concatenate([h[1] for h in held])
            words = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([np.diff(h[3]) for h in held])
            path, n, n_train = _save_block(folder, ids, flags, words, np.append(0, np.cumsum(lengths)))
            return pa.record_batch([pa.array([path]), *[pa.array([x], pa.int64()) for x in (len(ids), n, n_train, int(flags.sum()))]],
                                   ["path", "docs", "tokens", "train_tokens", "train_docs"])

        for whole in batches:
            for b in slices(whole, "text"):
                words, first = word_hashes(b.column("text"), lower=True)
                held.append((b.column("id"), b.column("train").to_numpy(zero_copy_only=False).astype(bool), words, first))
                size += b.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    return written(rows.mapInArrow(save, "path string, docs long, tokens long, train_tokens long, train_docs long"), "lm-manifest")


# ---- counts -----------------------------------------------------------------------------------------


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as the first one and differences of the fewest bytes, and counts (1 byte, larger ones in a list)."""
    gaps = np.diff(hashes, prepend=hashes[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    raw = np.ascontiguousarray(gaps.astype("<u8").view("u1").reshape(-1, 8)[:, :width])
    big = np.flatnonzero(counts >= 255)
    small = zlib.compress(np.minimum(counts, 255).astype("u1").tobytes(), 1)
    first = int(hashes[0]) if len(hashes) else 0
    return (np.array([len(hashes), width, len(small), len(big)], "<i8").tobytes() + first.to_bytes(8, "little") + raw.tobytes() + small
            + big.astype("<i8").tobytes() + counts[big].astype("<i8").tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, small, big = (int(x) for x in np.frombuffer(blob, "<i8", 4))
    first, at = np.frombuffer(blob, "<u8", 1, 32), 40
    raw = np.zeros((n, 8), "u1")
    raw[:, :width] = np.frombuffer(blob, "u1", n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(zlib.decompress(blob[at: at + small]), "u1").astype(np.int64)
    at += small
    counts[np.frombuffer(blob, "<i8", big, at)] = np.frombuffer(blob, "<i8", big, at + 8 * big)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64) + first, counts


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits hash ranges begins in sorted hashes."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def sent(manifest: DataFrame, bits: int) -> DataFrame:
    """``part, path, kind, blob``: each block's words (kind 0) and word pairs (kind 1) by hash range, with their training counts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                block = Block(path)
                h = block.vocabulary[block.index]
                before = np.roll(h, 1)
                before[np.append(0, np.cumsum(block.lengths)[:-1])] = END
                inside = np.repeat(block.train, block.lengths)
                pairs, index = np.unique(pair_hash(before, h), return_inverse=True)
                n = np.bincount(index[inside], minlength=len(pairs))
                for kind, hashes, counts in ((0, block.vocabulary, block.counts), (1, pairs, n)):
                    at = _ranges(hashes, bits)
                    some = [p for p in range(1 << bits) if at[p] < at[p + 1]]
                    blobs = [pack(hashes[at[p]: at[p + 1]], counts[at[p]: at[p + 1]]) for p in some]
                    yield pa.record_batch([pa.array(some, pa.int32()), pa.array([path] * len(some), pa.string()), pa.array([kind] * len(some), pa.int32()),
                                           pa.array(blobs, pa.binary())], ["part", "path", "kind", "blob"])

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(send, "part int, path string, kind int, blob binary")


def _level(counts: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log2(counts / least) + 1e-9).astype(np.int64)


def count_ranges(messages: DataFrame, least: int) -> DataFrame:
    """Per range: rows (kind 0, path, blob: counts of that block's words), one row (kind 1: n-grams and levels, 0 below ``least``),
    and ``levels`` (how many n-grams have each level), ``known`` (distinct training words), ``asked`` (the places of each block's n-grams)."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {0: [], 1: []}
        paths: dict[int, list] = {0: [], 1: []}
        for b in batches:
            for path, kind, blob in zip(b.column("path").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
                got[kind].append(unpack(blob.as_py()))
                paths[kind].append(path)
        found, known, size = [], 0, 0
        own: dict[str, list] = {}  # each block's n-grams, as places among those found
        for kind, lists in got.items():
            if not lists:
                continue
            every = np.concatenate([x[0] for x in lists])
            hashes, index = np.unique(every, return_inverse=True)
            totals = np.bincount(index, weights=np.concatenate([x[1] for x in lists]).astype(float), minlength=len(hashes)).astype(np.int64)
            edges = np.cumsum([len(x[0]) for x in lists])[:-1]
            for path, places in zip(paths[kind], np.split(index + size, edges)):
                own.setdefault(path, []).append(places)
            found.append((hashes, totals))
            size += len(hashes)
            if kind == 0:
                known = int((totals > 0).sum())
                for path, a in zip(paths[kind], np.split(totals[index], edges)):
                    yield _answer(key[0].as_py(), 0, path, zlib.compress(a.astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), 1), None, None, None)
        hashes, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        totals = np.concatenate([f[1] for f in found])
        levels = np.zeros(len(hashes), np.int64)
        kept = np.flatnonzero(totals >= least)
        np.maximum.at(levels, place[kept], _level(totals[kept], least))
        asked = []
        for path, places in own.items():
            places = np.unique(place[np.concatenate(places)])
            asked.append({"path": path, "blob": pack(places.astype(np.uint64), np.zeros(len(places), np.int64))})
        yield _answer(key[0].as_py(), 1, None, pack(hashes, levels), np.bincount(levels, minlength=64)[:64], known, asked)

    schema = "part int, kind int, path string, blob binary, levels array<long>, known long, asked array<struct<path: string, blob: binary>>"
    return messages.groupBy("part").applyInArrow(add, schema)


def _answer(part, kind, path, blob, levels, known, asked) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([path], pa.string()), pa.array([blob], pa.binary()),
                            pa.array([None if levels is None else levels.tolist()], pa.list_(pa.int64())), pa.array([known], pa.int64()),
                            pa.array([asked], pa.list_(pa.struct([("path", pa.string()), ("blob", pa.binary())])))],
                           ["part", "kind", "path", "blob", "levels", "known", "asked"])


# ---- the filter -------------------------------------------------------------------------------------


class LogFilter:
    """A Bloom filter of 2**bits segments of ``segment_bits`` each, over (n-gram, level) entries.

    ``data`` holds all segments, or that of range ``only`` alone.
    """

    def __init__(self, bits: int, segment_bits: int, least: int, data: np.ndarray | None = None, only: bool = False):
        self.bits, self.segment_bits, self.least, self.data, self.only = bits, segment_bits, least, data, only

    def place(self, h: np.ndarray, level: int, probe: int) -> np.ndarray:
        """Bit numbers of one probe inside the n-grams' segments."""
        g = mix64(h ^ np.uint64(level * 0xFF51AFD7ED558CCD % (1 << 64)))
        return (g + (mix64(g + np.uint64(1)) | np.uint64(1)) * np.uint64(probe)) % np.uint64(self.segment_bits)

    def segment(self, h: np.ndarray, levels: np.ndarray) -> bytes:
        """One segment's bytes from its n-grams."""
        bits = np.zeros(self.segment_bits, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            some = h[levels >= q]
            for i in range(PROBES):
                bits[self.place(some, q, i).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram by repeated probes; 0 if it is not held."""
        out = np.zeros(len(h), np.int64)
        if self.data is None or not len(self.data):
            return out
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits and not self.only else np.zeros(len(h), np.int64)
        base = part * (self.segment_bits // 8)
        at, q = np.arange(len(h)), 1
        while len(at) and q < 64:
            for i in range(PROBES):
                p = self.place(h[at], q, i).astype(np.int64)
                at = at[(self.data[base[at] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            out[at] = q
            q += 1
        return out

    def counts(self, levels: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the level's octave, 0 if not held. The octave from 1 holds the count 1 alone."""
        low = self.least * np.exp2(levels - 1.0)
        return np.where(levels > 0, np.where(low > 1, 1.5 * low, low), 0.0)


def filter_size(counted: DataFrame, bits: int, least: int, bits_per_entry: int) -> LogFilter:
    """The filter for all counted n-grams, still without its bits. The driver gets one sum."""
    levels = counted.where("kind = 1").select(F.posexplode("levels").alias("level", "n"))
    entries = int(levels.agg(F.sum(F.col("level") * F.col("n"))).first()[0] or 0)  # a level q n-gram is entered q times
    return LogFilter(bits, (-(-entries * bits_per_entry >> bits) // 8) * 8 + 64, least)


def whole_filter(counted: DataFrame, model: LogFilter) -> LogFilter:
    """The filter with its bits, for a broadcast: each range builds its segment, the driver joins them."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = [model.segment(*unpack(x.as_py())) for x in b.column("blob")]
            yield pa.record_batch([b.column("part"), pa.array(segments, pa.binary())], ["part", "segment"])

    got = counted.where("kind = 1").select("part", "blob").mapInArrow(build, "part int, segment binary").toArrow()
    size = model.segment_bits // 8
    data = np.zeros(size << model.bits, "u1")
    for part, segment in zip(got.column("part").to_pylist(), got.column("segment")):
        data[part * size: (part + 1) * size] = np.frombuffer(segment.as_py(), "u1")
    return LogFilter(model.bits, model.segment_bits, model.least, data)


def needed(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct n-gram hashes in order, and where its vocabulary and each token's pair stand among them."""
    before = np.roll(block.index, 1)
    before[np.append(0, np.cumsum(block.lengths)[:-1])] = np.searchsorted(block.vocabulary, END)
    size = len(block.vocabulary)
    pairs, which = np.unique(before * size + block.index, return_inverse=True)
    both = np.concatenate([block.vocabulary, pair_hash(block.vocabulary[pairs // size], block.vocabulary[pairs % size])])
    hashes, at = np.unique(both, return_inverse=True)
    return hashes, at[:size], at[size:][which]


def answered_levels(counted: DataFrame, model: LogFilter) -> DataFrame:
    """``path, part, kind (2), blob``: levels of each block's n-grams, found in the range's own segment."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob, asked in zip(b.column("part").to_pylist(), b.column("blob"), b.column("asked")):
                hashes, levels = unpack(blob.as_py())
                own = LogFilter(model.bits, model.segment_bits, model.least, np.frombuffer(model.segment(hashes, levels), "u1"), only=True)
                got = own.levels(hashes).astype("u1")
                for one in asked:
                    path, places = one["path"].as_py(), unpack(one["blob"].as_py())[0].astype(np.int64)
                    yield pa.record_batch([pa.array([path]), pa.array([part], pa.int32()), pa.array([2], pa.int32()),
                                           pa.array([zlib.compress(got[places].tobytes(), 1)], pa.binary())], ["path", "part", "kind", "blob"])

    return counted.where("kind = 1").select("part", "blob", "asked").mapInArrow(tell, "path string, part int, kind int, blob binary")


# ---- scores -----------------------------------------------------------------------------------------


def score(docs: DataFrame, train: Column, row_id: str = "doc_id", text: str = "text", back: float = 0.8, least: int = 1,
          bits_per_entry: int = 8, broadcast_bits: int = 1 << 28) -> DataFrame:
    """``row_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``base_score``: sum of log10((c + 1) / (N + V + 1)) with exact counts; ``score``: the model's log10 probability.
    A filter of more than ``broadcast_bits`` is not broadcast but asked range by range, with equal scores.
    N-grams of fewer than ``least`` occurrences score as never seen; with ``least=1`` the filter holds all.
    """
    spark = docs.sparkSession
    manifest = make_blocks(docs, row_id, text, train)
    sums = manifest.agg(F.sum("tokens").alias("t"), F.sum("train_tokens").alias("n")).first()
    total = int(sums["n"] or 0)
    bits = max(4, (int((sums["t"] or 0)) // RANGE_NGRAMS).bit_length())
    counted = written(count_ranges(sent(manifest, bits), least), "lm-counts")
    known = int(counted.where("kind = 1").agg(F.sum("known")).first()[0] or 0)
    model = filter_size(counted, bits, least, bits_per_entry)
    floor = total + known + 1
    answers = counted.where("kind = 0").select("path", "part", "kind", "blob")
    if model.segment_bits << bits <= broadcast_bits:
        shared = spark.sparkContext.broadcast(whole_filter(counted, model))
    else:
        shared = spark.sparkContext.broadcast(model)
        answers = answers.unionByName(answered_levels(counted, model))

    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, bytes]] = {0: {}, 2: {}}
        for b in batches:
            for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
                parts[kind][part] = blob.as_py()
        told = {kind: [zlib.decompress(blobs[p]) for p in sorted(blobs)] for kind, blobs in parts.items()}
        exact = np.concatenate([np.ascontiguousarray(np.frombuffer(x, "u1").reshape(8, -1).T).view("<i8").ravel() for x in told[0]])
        block = Block(key[0].as_py())
        at = np.append(0, np.cumsum(block.lengths)[:-1])
        base = np.log10((exact + 1) / floor)[block.index]
        hashes, one, two = needed(block)
        levels = np.frombuffer(b"".join(told[2]), "u1").astype(np.int64) if told[2] else shared.value.levels(hashes)
        counts = shared.value.counts(levels)
        words = counts[one]
        unigram = (words + 1) / floor
        joint = counts[two]
        given = np.roll(words[block.index], 1)
        given[at] = words[np.searchsorted(block.vocabulary, END)]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(given > 0, np.minimum(1.0, joint / given), 0.0)
        p = (1 - back) * share + back * unigram[block.index]
        n = len(block.lengths)
        yield pa.record_batch(
            [block.ids, pa.array(block.train), pa.array(block.lengths, pa.int64()), pa.array(np.add.reduceat((exact > 0)[block.index].astype(np.int64), at)),
             pa.array(np.full(n, total), pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
            [row_id, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[row_id].dataType.simpleString()
    return answers.groupBy("path").applyInArrow(judge, f"`{row_id}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
