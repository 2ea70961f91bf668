"""Token-id files of patched frame-of-reference blocks.

Documents are encoded, each followed by an end id, and written in ascending id
order. A file holds sections of about SECTION ids; a section has its documents'
ids and lengths, an index of its blocks and the blocks. A block of 256 ids
subtracts its minimum and packs the differences at the width (bits) that a
chosen percentile of them needs; wider ones go to the block's exception list
(position and whole difference). The block index holds each block's start, so ids
in the middle are read without the rest (:meth:`TokenFile.ids`).

Layout: ``PFOR1`` magic; sections; a JSON footer (sections' offsets, documents, ids); its length in 8 bytes.
Section: JSON header line (sizes), document ids (Arrow stream), lengths, block minima (u4), widths (u1),
exception counts (u2), block starts (u8), block bytes.

Scaling: one range shuffle of the texts; each partition streams into its own file; the manifest has one
row per file, and a running sum over it gives each file's start.

Defined cases: a null text counts as empty (its end id alone); a null id sorts first; rows with equal ids are
ordered by the text's hash; an empty table gives no files and an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulyst.llm.common import new_folder, written
from tabulyst.llm.files import create, own_name, reader

BLOCK = 256
SECTION = 1 << 20
#: Words, and characters in them, that an encoder remembers before it starts anew.
MEMO, MEMO_CHARS = 1_000_000, 1 << 25
#: Texts that are encoded together.
TEXTS = 1024
MAGIC = b"PFOR1\n"
_UNSAFE = re.compile(r"\s | \s")
#: A space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters, a sentence mark, and perhaps a line break and the same again: byte-level BPE never merges over these edges.
_LETTERS = re.compile(r"([^\W\d_]+)([.,]?)(?:(\n)([^\W\d_]+)([.,]?))?")
#: In texts whose spaces are null characters: a single line break between visible characters, and marks that end a word.
_BREAK = re.compile(r"\n(?<=[^\s\0]\n)(?=[^\s\0])")
#: (first a set of code points, which is quicker to search for than ``[^\w\s\0]`` and finds the same in printable texts)
_MARKS = re.compile(r"[!-/:-@\[-^`{-~\x80-\U0010ffff](?<!\w)(?<=[^\W_].)[^\w\s\0]*(?=\0|\Z)")
# Fixed values of byte-level BPE: printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = dict(zip([b for b in range(256) if b not in _PRINTABLE], map(chr, range(256, 512))))
#: One encoder per Python worker, so that what it remembers serves its next tasks.
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with a ``tokenizers`` file; repeated words are encoded once.

    Byte-level BPE never merges over a single space between two characters that are no
    white space, so texts are cut there; the space goes with the piece after it. Printable texts are also cut
    around the marks that end a word and around line breaks, so that a word is learned once, whatever follows it.
    """

    def __init__(self, definition: str, memo: int = MEMO, memo_chars: int = MEMO_CHARS):
        self.memo, self.memo_chars = memo, memo_chars
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        rules = json.loads(definition)
        before = rules.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: The library's merges alone, for runs of letters, which its pattern never cuts; None for other kinds of tokenizers.
        self.model = self.tokenizer.model if plain and not rules.get("normalizer") else None
        self._forget()

    def _forget(self):
        self.places: dict[str, int] = defaultdict(count().__next__)  # numbers pieces in the order of their first look-up
        self.chars = 0
        self.ids = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def _whole(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(parts), 4096) for e in self.tokenizer.encode_batch_fast(parts[lo: lo + 4096], add_special_tokens=False)]

    def _letters(self, word: str, space: bool) -> list[int]:
        """Ids of one run of letters, perhaps after a space."""
        if not word.isalpha():  # numerals such as fractions are words to `re`
            return self._whole([" " + word if space else word])[0]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return [t.id for t in self.model.tokenize(_ALPHABET[32] + word if space else word)]

    def _learn(self, fresh: list[str]):
        """Encode new pieces, by their letters and the sentence marks and line breaks between them."""
        got: list[list[int]] = []
        other = []
        mark = dict(zip(".,\n", self._whole([".", ",", "\n"]))) | {"": []}
        after_space = _ALPHABET[32]
        for piece in fresh:
            if self.model is not None and piece.isascii() and piece.isalpha():  # most pieces
                got.append([t.id for t in self.model.tokenize(after_space + piece)])
                continue
            space = piece[:1] != " "
            word = piece if space else piece[1:]
            if self.model is None:
                m = None
            elif word.isalpha():
                got.append(self._letters(word, space))
                continue
            else:
                m = _LETTERS.fullmatch(word)
            if m is None:
                other.append((len(got), " " + word if space else word))
                got.append([])
                continue
            first, stop, line, second, end = m.groups()
            ids = self._letters(first, space) + mark[stop]
            if line:
                ids += mark[line] + self._letters(second, False) + mark[end]
            got.append(ids)
        for (place, _), ids in zip(other, self._whole([piece for _, piece in other])):
            got[place] = ids
        self.chars += sum(map(len, fresh))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got))))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.int64))

    def _pieces(self, texts: list[str]) -> pa.Array:
        """Each text's pieces (none: null); all lost the space before them, and those that had none get one as their mark."""
        cut: list[str | None] = []  # pieces with a null character between
        lists: list[list[str]] | None = [] if any("\0" in text for text in texts) else None
        for text in texts:
            # the first tests are quicker; together they find every text that the pattern finds
            doubtful = "  " in text or "\n " in text or " \n" in text or not text.replace("\n", "").isprintable()
            if lists is not None or doubtful or self.model is None:
                parts = _CUT.split(text) if doubtful and _UNSAFE.search(text) else text.split(" ")
                if parts[0]:
                    parts[0] = " " + parts[0]
                else:
                    del parts[0]
                if lists is not None:
                    lists.append(parts)
                else:
                    cut.append("\0".join(parts) if parts else None)
                continue
            text = text.replace(" ", "\0")
            if "\n" in text:
                text = _BREAK.sub("\0 \n\0 ", text)
            text = _MARKS.sub("\0 \\g<0>", text)
            cut.append((text[1:] if text[0] == "\0" else " " + text) if text else None)
        if lists is not None:
            return pa.array(lists, pa.large_list(pa.large_string()))
        return pc.split_pattern(pa.array(cut, pa.large_string()), "\0")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.places) > self.memo or self.chars > self.memo_chars:
            self._forget()
        pieces = self._pieces(texts)
        lengths = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        # a piece that comes several times is looked up once
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)  # strings made in one go, to_pylist makes an object of Arrow's for each
        known = len(self.places)
        # the collector would walk all remembered pieces again and again; there are no cycles among them
        gc.disable()
        try:
            which = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
            if len(self.places) > known:
                self._learn(list(islice(reversed(self.places), len(self.places) - known))[::-1])
        finally:
            gc.enable()
        which = which[coded.indices.to_numpy(zero_copy_only=False)]
        begin, size = self.starts[which], self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(size)
        out = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        edges = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
        return out, np.diff(edges)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other: 64 values fill ``width`` words of 64 bits."""
    v = np.ascontiguousarray((values.reshape(-1, 64) & np.uint32((1 << width) - 1)).T, np.uint64)
    words = np.zeros((width, v.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """Values back from :func:`_pack_bits`."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).reshape(-1, 8 * width).view("<u8").T)
    out = np.zeros((64, words.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & np.uint64((1 << width) - 1)).T)


def pack_blocks(ids: np.ndarray, percentile: float = 90.0) -> tuple[dict[str, np.ndarray], bytes]:
    """Blocks of ids: (index arrays ``low, width, exceptions, start``, bytes)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return {"low": np.zeros(0, "<u4"), "width": np.zeros(0, "u1"), "exceptions": np.zeros(0, "<u2"), "start": np.zeros(0, "<u8")}, b""
    padded = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], ids.dtype)]).astype(np.int64).reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    rest = (padded - low[:, None]).astype(np.uint32)
    # bits of each difference: the exponent of its float
    needs = np.maximum((rest.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)
    place = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = np.partition(needs, place, axis=1)[:, place].astype(np.int64)
    out = needs > width[:, None]
    exceptions = out.sum(axis=1)
    sizes = width * (BLOCK // 8) + 5 * exceptions
    start = np.append(0, np.cumsum(sizes))
    raw = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        for part in np.array_split(some, max(1, len(some) // 1024)):
            if w:
                raw[start[part][:, None] + np.arange(w * BLOCK // 8)] = _pack_bits(rest[part], int(w)).reshape(len(part), -1)
    block, place = np.nonzero(out)
    rank = np.arange(len(block)) - np.repeat(np.append(0, np.cumsum(exceptions)[:-1]), exceptions)
    at = start[block] + width[block] * (BLOCK // 8)
    raw[at + rank] = place
    values = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    raw[(at + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return {"low": low.astype("<u4"), "width": width.astype("u1"), "exceptions": exceptions.astype("<u2"), "start": start[:-1].astype("<u8")}, raw.tobytes()


def unpack_blocks(index: dict[str, np.ndarray], raw: np.ndarray, base: int = 0) -> np.ndarray:
    """Ids of whole blocks; ``base`` is where ``raw`` begins among the section's block bytes."""
    width, exceptions = index["width"].astype(np.int64), index["exceptions"].astype(np.int64)
    start = index["start"].astype(np.int64) - base
    rest = np.zeros((len(width), BLOCK), np.int64)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        for part in np.array_split(some, max(1, len(some) // 1024)):
            if w:
                packed = raw[start[part][:, None] + np.arange(w * BLOCK // 8)]
                rest[part] = _unpack_bits(packed, int(w)).reshape(-1, BLOCK)
    block = np.repeat(np.arange(len(width)), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.append(0, np.cumsum(exceptions)[:-1]), exceptions)
    at = start[block] + width[block] * (BLOCK // 8)
    values = raw[(at + exceptions[block] + 4 * rank)[:, None] + np.arange(4)]
    rest[block, raw[at + rank]] = np.ascontiguousarray(values).view("<u4").ravel()
    return (rest + index["low"].astype(np.int64)[:, None]).ravel()


def _column_bytes(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Writer:
    """Writes one token file section by section."""

    def __init__(self, path: str, percentile: float):
        self.out, self.percentile, self.at = create(path), percentile, len(MAGIC)
        self.sections: list[dict] = []
        self.out.write(MAGIC)

    def section(self, ids: pa.Array, lengths: np.ndarray, tokens: np.ndarray):
        index, raw = pack_blocks(tokens, self.percentile)
        parts = [_column_bytes(ids), lengths.astype("<i8").tobytes(), *[index[k].tobytes() for k in ("low", "width", "exceptions", "start")], raw]
        head = json.dumps([len(p) for p in parts]).encode() + b"\n"
        self.sections.append({"at": self.at, "head": len(head), "documents": len(ids), "ids": int(lengths.sum())})
        for p in (head, *parts):
            self.out.write(p)
            self.at += len(p)

    def close(self):
        foot = json.dumps(self.sections).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little"))
        self.out.close()


class TokenFile:
    """Reads a token file by ranges."""

    def __init__(self, path: str):
        self.file = reader(path)
        size = self.file.size()
        self.file.seek(0)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.file.seek(size - 8)
        foot = int.from_bytes(self.file.read(8), "little")
        self.file.seek(size - 8 - foot)
        self.sections = json.loads(self.file.read(foot))

    def _parts(self, k: int) -> list[tuple[int, int]]:
        s = self.sections[k]
        self.file.seek(s["at"])
        at, out = s["at"] + s["head"], []
        for n in json.loads(self.file.read(s["head"])):
            out.append((at, n))
            at += n
        return out

    def _read(self, part: tuple[int, int]) -> bytes:
        self.file.seek(part[0])
        return self.file.read(part[1])

    def documents(self, k: int) -> tuple[pa.Array, np.ndarray]:
        parts = self._parts(k)
        column = pa.ipc.open_stream(self._read(parts[0])).read_all().column("id").combine_chunks()
        return column, np.frombuffer(self._read(parts[1]), "<i8")

    def ids(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of section ``k``; only the blocks that hold them are read."""
        parts, total = self._parts(k), self.sections[k]["ids"]
        hi = total if hi is None else min(hi, total)
        if hi <= lo:
            return np.zeros(0, np.int64)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        index = {name: np.frombuffer(self._read(p), kind) for name, kind, p in zip(("low", "width", "exceptions", "start"), ("<u4", "u1", "<u2", "<u8"), parts[2:6])}
        begin = int(index["start"][a])
        end = int(index["start"][b]) if b < len(index["start"]) else parts[6][1]
        raw = np.frombuffer(self._read((parts[6][0] + begin, end - begin)), np.uint8)
        got = unpack_blocks({n: v[a:b] for n, v in index.items()}, raw, begin)
        return got[lo - a * BLOCK: hi - a * BLOCK]

    def close(self):
        self.file.close()


def write_tokens(docs: DataFrame, definition: str, row_id: str = "doc_id", text: str = "text", end_id: int = 2, percentile: float = 90.0) -> DataFrame:
    """Write the token files of ``docs``; manifest ``path, part, documents, ids, start`` in file order.

    ``definition``: the tokenizer's JSON text (a few MB, broadcast).
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    shared = spark.sparkContext.broadcast(definition)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, path = None, own_name(folder, ".pfor")
        key = str(hash(shared.value))
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        encoder = _ENCODERS[key]
        held: list[tuple] = []

        def flush():
            file.section(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            held.clear()

        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                if file is None:
                    file = Writer(path, percentile)
                ids, lengths = encoder.encode(batch.column("text").to_pylist())
                tokens = np.full(len(ids) + len(lengths), end_id, np.int64)
                place = np.ones(len(tokens), bool)
                place[np.cumsum(lengths + 1) - 1] = False
                tokens[place] = ids
                held.append((batch.column("id"), lengths + 1, tokens))
                if sum(len(h[2]) for h in held) >= SECTION:
                    flush()
        if file is not None:
            if held:
                flush()
            file.close()
            sums = [sum(s[k] for s in file.sections) for k in ("documents", "ids")]
            yield pa.record_batch([pa.array([path]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums[0]], pa.int64()), pa.array([sums[1]], pa.int64())],
                                  ["path", "part", "documents", "ids"])

    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
    manifest = written(rows.mapInArrow(save, "path string, part int, documents long, ids long"), "token-manifest")
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # over files, not rows
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame, id_type: str = "bigint", row_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document, decoded from the files: ``row_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(path)
                for k in range(len(file.sections)):
                    ids, lengths = file.documents(k)
                    tokens = file.ids(k).astype("<u4")
                    edges = np.append(0, np.cumsum(lengths))
                    crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                    columns = {row_id: ids, "start": pa.array(at + edges[:-1], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens.astype(np.int32)))
                    yield pa.record_batch(list(columns.values()), list(columns))
                    at += int(edges[-1])
                file.close()

    # one file a task, so that reading spreads as writing did
    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(load, f"`{row_id}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
