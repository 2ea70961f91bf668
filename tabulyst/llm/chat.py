"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns' tokens. They
are ordered by their paths (chained digests of the turns), which is a
depth-first order of the prefix tree: each conversation adds the turns that it
does not share with the one before. A sequence holds the tokens of such a run once, with position ids
that count along each conversation's own path, and for each node (turn) the
intervals of the sequence that it may attend to: its ancestors and itself. A sequence has about ``max_tokens``
tokens; a tree that does not fit goes on in the next one, which begins with that conversation's whole path.

**Template.** system ``<<SYS>>text<</SYS>>``, user ``[INST] text [/INST]``,
assistant ``<s> text </s>``, others ``[ROLE name] text [/ROLE]``. Inside texts
and names ``\\``, ``<``, ``[`` and ``]`` get a backslash before them, so no text can hold a
control string and unescaping is exact. The loss mask covers the assistants' texts.

Scaling: two passes through sorted runs (:mod:`tabulyst.llm.runs`), by conversation and by (path, id), the second of which splits a conversation or first turn
shared by any number of conversations; runs are deleted once they are read. A task holds one range of either; texts are encoded together, for a range at a time, and
sequences are decoded by a table of the tokens' bytes. One conversation must fit a task, as one training sample. A sequence's position ids are kept as the first one
of each node and written out when they are read.

Defined cases: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, and repeated rows
are turns of their own; rows with a null conversation id are one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.llm import runs
from tabulyst.llm.common import new_folder, written
from tabulyst.llm.files import remove
from tabulyst.llm.tokenfile import _ALPHABET, _PRINTABLE, Encoder

TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
_ESCAPED = re.compile(r"[\\<\[\]]")
_PLAIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(
    r"(?:(?P<system><<SYS>>)|(?P<user>\[INST\] )|(?P<assistant><s> )|\[ROLE (?P<role>(?:[^\\\[\]<]|\\.)*)\] )"
    r"(?P<text>[^\\\[\]<]*(?:\\.[^\\\[\]<]*)*)"
    r"(?(system)<</SYS>>|(?(user)\[/INST\]|(?(assistant)</s>|\[/ROLE\])))", re.S)

SEQUENCE = ("tokens array<int>, positions array<int>, loss array<struct<start:int,end:int>>, "
            "nodes array<struct<start:int,end:int,attends:array<struct<start:int,end:int>>>>, conversations array<struct<id:%s,turns:int,node:int>>")
#: As written: ``firsts`` has the position of each node's first token.
_STORED = SEQUENCE.replace("positions array<int>", "firsts array<int>")
#: Plain numbers under zstd are smaller than packed dictionary codes; small row groups keep readers small.
_PARQUET = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}
#: Bytes of roles and texts in a run and in a range, and characters that are encoded together.
RUN_BYTES, RANGE_BYTES, _TOGETHER = 24 << 20, 16 << 20, 1 << 20
#: Words, and characters in them, that a task's encoder remembers.
MEMO, MEMO_CHARS = 200_000, 1 << 22


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text) if "\\" in text else text


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Opening, escaped text and closing of one turn."""
    head, tail = TEMPLATE.get(role) or (f"[ROLE {escape(role)}] ", " [/ROLE]")
    return head, escape(text), tail


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = next((r for r in TEMPLATE if m[r] is not None), None)
        text = m["text"]
        # the closing of all but system begins with a space, which the text's pattern took
        out.append((unescape(m["role"]) if role is None else role, unescape(text if role == "system" else text[:-1])))
        at = m.end()
    return out


def chain(turns: list[tuple[str, str]]) -> bytes:
    """16 bytes per turn; equal up to a turn exactly if all turns up to it are equal."""
    out, last = [], b""
    for role, text in turns:
        r, t = role.encode(), text.encode()
        last = hashlib.blake2b(last + len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()
        out.append(last)
    return b"".join(out)


def _lists(offsets, fields: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of structs from flat fields."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


class Sequence:
    """One sequence under construction."""

    def __init__(self):
        self.tokens, self.firsts, self.loss, self.nodes, self.conversations = [], [], [], [], []
        self.size = 0
        self.path: list[tuple[bytes, int, int]] = []  # digest, node, position after it

    def add(self, conv, digests: list[bytes], shared: int, parts: list[tuple[str, list[np.ndarray]]]):
        """Append a conversation's own turns; ``parts``: (role, ids of opening, text, closing)."""
        del self.path[shared:]
        for digest, (role, ids) in zip(digests[shared:], parts):
            start, position = self.size, self.path[-1][2] if self.path else 0
            for k, piece in enumerate(ids):
                if k == 1 and role == "assistant" and len(piece):
                    self.loss.append((self.size, self.size + len(piece)))
                self.tokens.append(piece)
                self.size += len(piece)
            end = self.size
            self.firsts.append(position)
            attends = list(self.nodes[self.path[-1][1]][2]) if self.path else []
            if attends and attends[-1][1] == start:
                attends[-1] = (attends[-1][0], end)
            else:
                attends.append((start, end))
            self.nodes.append((start, end, attends))
            self.path.append((digest, len(self.nodes) - 1, position + end - start))
        self.conversations.append((conv, len(digests), self.path[-1][1] if self.path else -1))

    def row(self, id_type: pa.DataType) -> pa.RecordBatch:
        def column(values) -> pa.Array:
            return pa.array(np.fromiter(values, np.int32), pa.int32())

        tokens = np.concatenate(self.tokens).astype(np.int32) if self.tokens else np.zeros(0, np.int32)
        some = [x for _, _, attends in self.nodes for x in attends]
        attends = _lists(np.append(0, np.cumsum([len(x) for _, _, x in self.nodes], dtype=np.int64)),
                         {"start": column(x for x, _ in some), "end": column(x for _, x in some)})
        nodes = {"start": column(x for x, _, _ in self.nodes), "end": column(x for _, x, _ in self.nodes), "attends": attends}
        ids, turns, ends = zip(*self.conversations)
        return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens)),
                                pa.ListArray.from_arrays(pa.array([0, len(self.firsts)], pa.int32()), column(self.firsts)),
                                _lists([0, len(self.loss)], {"start": column(x for x, _ in self.loss), "end": column(x for _, x in self.loss)}),
                                _lists([0, len(self.nodes)], nodes),
                                _lists([0, len(ids)], {"id": pa.array(ids, id_type), "turns": column(turns), "node": column(ends)})],
                               ["tokens", "firsts", "loss", "nodes", "conversations"])


def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    return t


class Decoder:
    """Bytes of ids. A byte-level tokenizer's tokens have the same bytes wherever they stand, so that a table of them serves."""

    def __init__(self, definition: str):
        self.tokenizer, self.table = _tokenizer(definition), None
        if (json.loads(definition).get("decoder") or {}).get("type") != "ByteLevel":
            return
        code = {c: b for b, c in _ALPHABET.items()} | {chr(b): b for b in _PRINTABLE}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            known = [code.get(c) for c in token]
            pieces[i] = token.encode() if None in known else bytes(known)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def of(self, tokens: np.ndarray) -> Callable[[list[tuple[int, int]]], str]:
        """What gives the text of intervals of ``tokens``, decoded together."""
        if self.table is None:
            return lambda some: self.tokenizer.decode([t for a, z in some for t in tokens[a:z].tolist()], skip_special_tokens=False)
        n = self.lengths[tokens]
        at = np.append(0, np.cumsum(n))
        raw = self.table[np.repeat(self.starts[tokens] - at[:-1], n) + np.arange(at[-1])].tobytes()
        at = at.tolist()
        return lambda some: b"".join([raw[at[a]: at[z]] for a, z in some]).decode("utf-8", "replace")


def format_conversations(rows: DataFrame, definition: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         max_tokens: int = 65_536, max_conversations: int = 4_096) -> DataFrame:
    """Write the sequences of all conversations and return them read back (columns: SEQUENCE)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a few MB
    kind = rows.schema[conv_id].dataType.simpleString()
    turn_folder, path_folder = new_folder(spark, "chat-turns"), new_folder(spark, "chat-paths")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of turns by a hash of their conversation."""
        held: list[pa.Table] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            return runs.save(pa.concat_tables(held), np.concatenate(lengths), turn_folder)

        for whole in batches:
            sizes = sum(pc.binary_length(whole.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text")) + 32
            for part in np.array_split(np.arange(whole.num_rows), max(1, -(-int(sizes.sum()) // (RUN_BYTES // 4)))):
                if not len(part):
                    continue
                b = whole.slice(int(part[0]), len(part))
                raw = b.column("hash").to_numpy(zero_copy_only=False).astype(">i8").tobytes()
                key = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, len(raw) + 8, 8, dtype=np.int32)), pa.py_buffer(raw)])
                held.append(pa.table([key, *(b.column(c) for c in ("id", "turn", "role", "text"))], ["key", "id", "turn", "role", "text"]))
                lengths.append(sizes[part])
                if sum(int(x.sum()) for x in lengths) >= RUN_BYTES:
                    yield flush()
                    held, lengths = [], []
        if held:
            yield flush()

    def parts_of(total: int) -> int:
        """Ranges for ``total`` bytes: of RANGE_BYTES, or less where few would leave cores idle."""
        return max(1, ceil(total / RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))

    columns = [F.xxhash64(F.col(conv_id)).alias("hash"), F.col(conv_id).alias("id"), F.col(turn).alias("turn"),
               F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    turns = written(rows.select(*columns).mapInArrow(keyed, runs.MANIFEST), "chat-turn-runs")
    total = turns.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = parts_of(total)
    # hashes are signed: the ranges are those of all 64 bits, in the order of bytes
    turn_bounds = [b""] + [((k << 64) // n).to_bytes(8, "big") for k in range(1, n)]

    def chained(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run of conversations by path (half of each digest, to be ordered by) and, among equal ones, by the hash."""
        table = runs.load(batches, turn_bounds, key[0].as_py())
        if table is None:
            return
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("id", "turn", "role", "text")], null_placement="at_start")).combine_chunks()
        ids = table.column("id").to_pylist()
        first = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        roles, texts = (table.column(c).to_pylist() for c in ("role", "text"))
        edges = [*first, len(ids)]
        paths = [chain(list(zip(roles[a:b], texts[a:b]))) for a, b in zip(edges[:-1], edges[1:])]
        hashes = table.column("key").take(pa.array(first)).to_pylist()
        lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), table.column(c).combine_chunks()) for c in ("role", "text")]
        out = pa.table([pa.array([b"".join(p[i: i + 8] for i in range(0, len(p), 16)) + h for p, h in zip(paths, hashes)], pa.binary()), table.column("id").take(pa.array(first)), *lists], ["key", "id", "roles", "texts"])
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 64
        yield runs.save(out, np.add.reduceat(sizes, first), path_folder)

    paths = written(runs.spans(turns, turn_bounds).groupBy("part").applyInArrow(chained, runs.MANIFEST), "chat-path-runs")
    remove(turn_folder)
    samples = sorted(r[0] for r in paths.select(F.explode("samples")).collect())  # one for each MB
    n = min(parts_of(total), max(1, len(samples)))
    bounds = [b"", *sorted({samples[k * len(samples) // n] for k in range(1, n)} - {b""})]

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.load(batches, bounds, key[0].as_py())
        if table is None:
            return
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")])).combine_chunks()
        encoder = _encoder(shared.value)
        seq, id_type = Sequence(), table.schema.field("id").type
        heads: dict[str, np.ndarray] = {}
        before: list[bytes] = []  # the digests of the conversation before, and the parts of its turns
        path: list[tuple[str, list[np.ndarray]]] = []

        def ids(piece: str) -> np.ndarray:
            if piece not in heads:
                if len(heads) > 1_000:
                    heads.clear()
                heads[piece] = np.array(encoder.tokenizer.encode(piece, add_special_tokens=False).ids, np.int64)
            return heads[piece]

        def conversations(lo: int, hi: int) -> Iterator[pa.RecordBatch]:
            nonlocal seq, before
            some = table.slice(lo, hi - lo)
            own = []
            for conv, roles, texts in zip(*(some.column(c).to_pylist() for c in ("id", "roles", "texts"))):
                raw = chain(list(zip(roles, texts)))
                digests = [raw[i: i + 16] for i in range(0, len(raw), 16)]
                n = 0
                for one, other in zip(before, digests):
                    if one != other:
                        break
                    n += 1
                own.append((conv, digests, n, [(r, *turn_parts(r, t)) for r, t in zip(roles[n:], texts[n:])]))
                before = digests
            tokens, lengths = encoder.encode([x[2] for _, _, _, turns in own for x in turns])
            pieces = iter(np.split(tokens, np.cumsum(lengths)[:-1])) if len(lengths) else iter(())
            for conv, digests, n, turns in own:
                del path[n:]
                path.extend((r, [ids(head), next(pieces), ids(tail)]) for r, head, _, tail in turns)
                size = sum(len(x) for _, p in path[n:] for x in p)
                if seq.conversations and (seq.size + size > max_tokens or len(seq.conversations) >= max_conversations):
                    yield seq.row(id_type)
                    seq, n = Sequence(), 0
                seq.add(conv, digests, n, path[n:])

        texts = table.column("texts").combine_chunks()  # every conversation has turns
        sizes = np.add.reduceat(pc.binary_length(texts.values).to_numpy(), texts.offsets.to_numpy()[:-1])
        cut = np.flatnonzero(np.diff(np.cumsum(sizes + 64) // _TOGETHER, prepend=-1)).tolist()
        for lo, hi in zip([0, *cut[1:]], [*cut[1:], table.num_rows]):
            yield from conversations(lo, hi)
        if seq.conversations:
            yield seq.row(id_type)

    out = written(runs.spans(paths, bounds).groupBy("part").applyInArrow(build, _STORED % kind), "chat-sequences", **_PARQUET)
    remove(path_folder)
    positions = F.flatten(F.zip_with("firsts", "nodes", lambda first, x: F.when(
        x["end"] > x["start"], F.sequence(first, first + x["end"] - x["start"] - 1)).otherwise(F.array().cast("array<int>"))))
    return out.select("tokens", positions.alias("positions"), "loss", "nodes", "conversations")


#: One encoder and decoder per Python worker.
_KNOWN: dict[tuple, object] = {}


def _once(make, definition: str, *more):
    key = (make, hash(definition))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = make(definition, *more)
    return _KNOWN[key]


def _encoder(definition: str) -> Encoder:
    return _once(Encoder, definition, MEMO, MEMO_CHARS)


def within(intervals: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Of ascending, disjoint intervals those inside ``[start, end)``."""
    first = bisect_left(intervals, (start,))
    last = bisect_left(intervals, (end,), lo=first)
    return [x for x in intervals[first:last] if x[1] <= end]


def read_conversations(sequences: DataFrame, definition: str, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation, decoded from its sequence: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A conversation's tokens are those its last node attends to.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(definition)
    kind = sequences.schema["conversations"].dataType.elementType["id"].dataType.simpleString()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, shared.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            kinds = [b.schema.field("conversations").type.value_type.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            for k in range(b.num_rows):
                tokens, loss, nodes, convs = (b.column(c).slice(k, 1).flatten() for c in ("tokens", "loss", "nodes", "conversations"))
                loss = list(zip(loss.field("start").to_pylist(), loss.field("end").to_pylist()))  # ascending and disjoint, as nodes are appended
                last = convs.field("node").to_pylist()
                known = sorted(set(last) - {-1})
                attends = nodes.field("attends").take(pa.array(known, pa.int64()))
                edges, flat = attends.offsets.to_pylist(), attends.values
                some = list(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist()))
                spans = [some[a:z] for a, z in zip(edges[:-1], edges[1:])]
                text, result = decoder.of(tokens.to_numpy()), {}
                for node, own in zip(known, spans):
                    formatted = text(own)
                    lost = "".join([unescape(text([x])) for a, z in own for x in within(loss, a, z)])
                    turns = parse_turns(formatted)
                    result[node] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost), len(formatted))
                if -1 in last:
                    result[-1] = (0, sha(""), 0, sha(""), 0)
                out = [result[node] for node in last]
                yield pa.record_batch([convs.field("id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds[1:]))], names)

    # positions are not read
    return sequences.select("tokens", "loss", "nodes", "conversations").mapInArrow(
        load, f"`{conv_id}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
