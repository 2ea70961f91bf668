"""Repeated passages by suffix arrays: bytes of a string that an earlier document also holds are removed.

Every string of ``size`` bytes that also starts in a document of a smaller id is
removed, overlaps included. The strings are judged on the input.

**Shards.** Equal strings must meet in one shard. The anchor of a string is the least hash of its runs of
``ANCHOR`` bytes, the first one if it comes twice, so equal strings have equal anchors in equal places. Neighbouring strings with the same anchor in the same place form one fragment; a
shard is a range of anchors and holds the distinct fragments of its range.

**Contexts.** Short runs of bytes repeat by chance, the more so the larger the corpus; whole strings do not. A string holds, before or after its anchor, half of its other
bytes at least. So two fragments that share a string share the anchor with that many bytes to its left, or to its right: their left or their right context.
Contexts that occur once in the corpus cannot belong to a repeated string, so fragments without another context are not sent. Nor do fragments whose contexts no different fragment
of the shard has go into its array: only copies of the same fragment hold their strings. (Contexts meet as hashes, by which a fragment may be sent for nothing, but never
left out.) An anchor that more than ``HOT_RUNS`` such fragments have, as at the edge of a passage that
a third of all documents share, would fill one shard with different fragments: its strings are dealt one by one, by
their own hash.

**Shard arrays** (:func:`suffix_array`): suffixes are classified as smaller or larger than their successor, the
leftmost-smaller substrings are sorted by induction and named, their order is found recursively on the names,
and the array is induced from it in two linear scans, a first-byte bucket at a time. Names beyond ``WIDE`` become two digits, so
that the scans never meet more buckets than that. Permuted common prefixes (:func:`common_prefixes`) are computed directly where the
preceding symbols of a suffix and its predecessor differ, and fall by one from there on. Neighbours in the array that share
``size`` bytes form a group; the group's least document id decides for all its strings.

Flow: texts become blocks of about ``BLOCK_BYTES`` in the shared folder, each with a manifest row; blocks send
their contexts by range of anchors and are told which fragments have one that occurs again; they send the distinct fragments of those (once per block, however many of
its documents hold them) and get the least document of each string; at last each block cuts its texts.
The number of shards grows with the corpus. Blocks and shards of 8 MB and more keep the messages between them, which grow with its square, few;
a shard's array is built in pieces of about ``ARRAY_BYTES``, between different anchors.

Defined cases: a null text counts as empty; texts shorter than ``size`` lose nothing; rows that share an id
do not remove each other's bytes; a null id counts as later than all others; an empty table gives an empty
result; the id column must be an integer; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import new_folder, written
from tabulyst.llm.files import create, own_name, reader
from tabulyst.llm.hashing import mix64, text_bytes
from tabulyst.llm.lm import pack, unpack
from tabulyst.llm.neardup import slices

ANCHOR = 16
#: Text bytes per block, and text bytes for each shard; bytes of fragments in an array.
BLOCK_BYTES, SHARD_BYTES, ARRAY_BYTES = 8 << 20, 16 << 20, 2 << 20
#: Strings of one fragment at most; fragments of one anchor from which its strings are dealt one by one.
LONGEST, HOT_RUNS = 256, 20_000
#: Most buckets of an induction scan, and names that need no further recursion.
WIDE, FEW_NAMES = 2048, 1 << 18
_SEGMENT = 1 << 17
#: Fragments or strings that are looked at together.
_FEW = 20_000
_NO_ID = np.iinfo(np.int64).max
_ZERO = np.zeros(1, np.int64)


# ---- suffix arrays ----------------------------------------------------------------------------------


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last: yes)."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    sign[-1] = 1
    decided = np.where(sign != 0, np.arange(n), n - 1)
    return sign[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _place(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol; where each symbol's run begins in it; the symbols met and how often."""
    order = chars.argsort(kind="stable")
    c = chars[order]
    starts = np.concatenate((_ZERO, np.flatnonzero(c[1:] != c[:-1]) + 1))
    return order, starts, c[starts], np.concatenate((starts[1:], [len(c)])) - starts


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The array of all suffixes from the leftmost-smaller ones in order."""
    n = len(t)
    sizes = np.bincount(t, minlength=symbols)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    larger = np.bincount(t[~smaller], minlength=symbols)
    sa = np.full(n, -1, np.int64)
    order, starts, met, counts = _place(t[lms])
    held = np.zeros(symbols, np.int64)
    held[met] = counts
    sa[np.repeat(ends[met] - counts - starts, counts) + np.arange(len(lms))] = lms[order]

    numbers = np.arange(n)
    head = begins.copy()

    # the symbol before each suffix, or none if the scan does not induce that suffix
    none = np.iinfo(t.dtype).max
    before = np.full(n, none, t.dtype)
    before[1:][~smaller[:-1]] = t[:-1][~smaller[:-1]]

    def forward(batch: np.ndarray) -> None:
        c = before[batch]
        some = c != none
        p = batch[some] - 1
        if len(p):
            order, starts, met, counts = _place(c[some])
            sa[np.repeat(head[met] - starts, counts) + numbers[:len(p)]] = p[order]
            head[met] += counts

    for c in np.flatnonzero(sizes).tolist():
        at = begins[c]
        while at < head[c]:
            at, upto = head[c], at
            forward(sa[upto:at])
        if held[c]:
            forward(sa[ends[c] - held[c]: ends[c]])

    tail = ends.copy()
    tail[0] = 0  # the end mark stays first

    before[:] = none
    before[1:][smaller[:-1]] = t[:-1][smaller[:-1]]

    def backward(batch: np.ndarray) -> None:
        c = before[batch]
        some = c != none
        p = batch[some] - 1
        if len(p):
            order, starts, met, counts = _place(c[some])
            sa[np.repeat(tail[met] - 1 + starts, counts) - numbers[:len(p)]] = p[order]
            tail[met] -= counts

    for c in np.flatnonzero(sizes)[::-1].tolist():
        at = ends[c]
        while tail[c] < at:
            at, upto = tail[c], at
            backward(sa[at:upto][::-1])
        if larger[c]:
            backward(sa[begins[c]: begins[c] + larger[c]][::-1])
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names (from 0, in text order) of the leftmost-smaller substrings, given in ``ordered`` by their content; how many differ."""
    place = np.empty(len(t), np.int32)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, lms[-1])) + 1
    index = place[ordered]
    a, b = ordered[:-1], ordered[1:]
    differ = length[index[:-1]] != length[index[1:]]
    active, upto = np.flatnonzero(~differ), length[index[:-1]]
    step = 0
    while len(active):
        unequal = t[a[active] + step] != t[b[active] + step]
        differ[active[unequal]] = True
        step += 1
        active = active[~unequal & (upto[active] > step)]
    name = np.append(0, np.cumsum(differ))
    out = np.empty(len(lms), np.int64)
    out[index] = name
    return out, int(name[-1]) + 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a short string by doubling ranks: where the recursion ends."""
    n, have = len(names), 1
    rank = names.astype(np.int64)
    while True:
        key = rank * np.int64(n + 1)
        key[:-have or n] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.append(False, key[1:] != key[:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        have *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Start of each suffix of ``t`` in order; ``t`` holds 0..symbols-1 and ends with its only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.uint16 if symbols < 1 << 16 else np.int64)
    smaller = _smaller(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    flag = np.zeros(len(t), bool)
    flag[lms] = True
    first = _induce(t, smaller, lms, symbols)
    names, kinds = _names(t, lms, first[flag[first]])
    del first
    if kinds == len(lms):
        order = np.empty(kinds, np.int64)
        order[names] = np.arange(kinds)
    else:
        # a name that occurs once ends every comparison: of such names in a row only the first stays
        single = np.bincount(names)[names] == 1
        drop = single.copy()
        drop[1:] &= single[:-1]
        drop[-1] = False
        kept = np.flatnonzero(~drop)
        short = names[kept]
        used = np.bincount(short, minlength=kinds) > 0
        short, kinds = (np.cumsum(used) - 1)[short], int(used.sum())
        if len(short) <= FEW_NAMES:
            deep = _doubled(short)
        elif kinds > WIDE and 2 * len(short) + 1 < 0.9 * len(t):
            base = int(np.ceil(np.sqrt(kinds)))
            digits = np.zeros(2 * len(short) + 1, np.int64)
            digits[:-1:2], digits[1::2] = short // base + 1, short % base + 1
            deep = suffix_array(digits, base + 2)
            deep = deep[(deep % 2 == 0) & (deep < 2 * len(short))] // 2
        else:
            deep = suffix_array(short, kinds)
        order = np.concatenate([kept[deep], np.flatnonzero(drop)])
        order = order[np.argsort(names[order], kind="stable")]
    return _induce(t, smaller, lms[order], symbols)


def common_prefixes(t: np.ndarray, sa: np.ndarray, marks: int = 2) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in the array, by position in the text.

    Symbols below ``marks`` (end and separators) match nothing.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    direct = np.ones(n, bool)
    j = before[1:]
    direct[1:] = (j <= 0) | (t[:-1] != t[np.maximum(j, 1) - 1]) | (t[:-1] < marks)
    at = np.flatnonzero(direct)
    value = np.zeros(n, np.int64)
    active = at[before[at] >= 0]
    step = 0
    while len(active):
        symbol = t[active + step]
        active = active[(symbol >= marks) & (symbol == t[before[active] + step])]
        step += 1
        value[active] = step
    last = np.maximum.accumulate(np.where(direct, np.arange(n), 0))
    return np.maximum(value[last] - (np.arange(n) - last), 0)


def least_documents(fragments: list[bytes], documents: np.ndarray, size: int) -> list[np.ndarray]:
    """For each fragment, the least document that holds its string, at each start of a string of ``size`` bytes."""
    strings = np.array([len(f) for f in fragments], np.int64) - size + 1
    return np.split(_least_values(fragments, documents, size), np.cumsum(strings)[:-1])


def _least_values(fragments: list[bytes], documents: np.ndarray, size: int) -> np.ndarray:
    """:func:`least_documents`, one fragment after the other."""
    lengths = np.array([len(f) for f in fragments], np.int64)
    raw = np.frombuffer(b"\0".join(fragments) + b"\0\0", np.uint8)
    t = raw.astype(np.uint16) + 2
    ends = np.cumsum(lengths + 1) - 1
    t[ends], t[-1] = 1, 0
    sa = suffix_array(t, 258)
    owner = np.repeat(np.arange(len(fragments) + 1), np.append(lengths + 1, 1))
    same = common_prefixes(t, sa)[sa] >= size
    left = np.append(ends, len(t))[owner] - np.arange(len(t))
    document = np.append(documents, _NO_ID)[owner]
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(document[sa], starts)
    value = np.empty(len(t), np.int64)
    value[sa] = np.repeat(least, np.diff(np.append(starts, len(t))))
    return value[(left >= size) & (owner < len(fragments))]


# ---- strings and their anchors ----------------------------------------------------------------------

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93


def _spread(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by doubling."""
    out, have = values, 1
    for bit in bin(size)[3:]:
        out = out[:-have] * np.uint64(pow(_STEP, have, 1 << 64)) + out[have:] if len(out) > have else out[:0]
        have *= 2
        if bit == "1":
            out = out[:len(values) - have] * np.uint64(_STEP) + values[have:] if len(values) > have else out[:0]
            have += 1
    return out


def string_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes."""
    return mix64(_spread(_VALUE[raw], size))


def _places(size: int) -> tuple[int, int, int, np.uint64]:
    """Bytes of an anchor, other bytes of a string, half of them, and the bits of a hash that hold a place instead."""
    anchor = min(ANCHOR, size)
    return anchor, size - anchor, (size - anchor + 1) // 2, np.uint64((1 << max(18, (size + _SEGMENT).bit_length())) - 1)


def _ranked(hashes: np.ndarray, low: np.uint64) -> np.ndarray:
    """Hashes by whose order the least is taken, with room for a place."""
    return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(_STEP)) & ~low


def _anchors_of(least: np.ndarray, low: np.uint64) -> np.ndarray:
    return mix64((least | low) ^ np.uint64(_STEP))  # least hashes are small: spread them over the shards


def contexts(raw: np.ndarray, at: np.ndarray, size: int, sides: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`runs`, and the hash of each fragment's left and right context (0: too short for one, or not ``sides``)."""
    anchor, free, half, low = _places(size)
    found = []
    ends = at[1:]
    for lo in range(0, len(raw), _SEGMENT):
        piece = raw[lo: lo + _SEGMENT + size - 1]
        if len(piece) < size:
            break
        values = _VALUE[piece]  # (a few arrays of this size stay in a core's cache)
        least, have = _ranked(_spread(values, anchor), low), 1
        least |= np.arange(len(least), dtype=np.uint64)
        while have < free + 1:
            more = min(have, free + 1 - have)
            least = np.minimum(least[:-more], least[more:], out=least[:-more])
            have += more
        n = len(least)
        fresh = np.ones(n, bool)
        fresh[1:] = least[1:] != least[:-1]
        edge = ends[np.searchsorted(ends, lo, side="right"): np.searchsorted(ends, lo + n + size, side="right")] - lo
        fresh[edge[edge < n]] = True
        whole = np.ones(n + size, bool)  # strings that cross the end of a text do not count
        for e in edge.tolist():
            whole[max(0, e - size + 1): e] = False
        whole = whole[:n]
        fresh[1:] |= whole[1:] != whole[:-1]
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, n))
        keep = whole[start]
        start, count, key = start[keep], count[keep], least[start[keep]]
        if len(count) and count.max() > LONGEST:
            parts = -(-count // LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, key, total = np.repeat(start, parts) + nth * LONGEST, np.repeat(key, parts), np.repeat(count, parts)
            count = np.minimum(LONGEST, total - nth * LONGEST)
        place = (key & low).astype(np.int64)
        left, right = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
        around = _spread(values, anchor + half) if sides else None
        for side, some, begin in ((left, place - start >= half, place - half), (right, start + count - 1 + free - place >= half, place)) if sides else ():
            side[some] = (mix64(around[begin[some]]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        found.append((start + lo, count, _anchors_of(key, low), left, right))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, strings, anchor`` of the fragments: runs of at most ``LONGEST`` strings of one text with one anchor."""
    return contexts(raw, at, size, False)[:3]


# ---- blocks -----------------------------------------------------------------------------------------


def _zip(x: np.ndarray | bytes) -> bytes:
    data = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def make_blocks(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """Manifest ``path, bytes`` of the block files that hold all ids and texts."""
    folder = new_folder(docs.sparkSession, "passage-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = np.concatenate([h[0] for h in held])
            parts = [_zip(raw), *[_zip(np.concatenate([h[i] for h in held]).astype("<i8")) for i in (1, 2)]]
            path = own_name(folder, ".block")
            with create(path) as out:
                out.write(json.dumps([len(p) for p in parts]).encode() + b"\n" + b"".join(parts))
            return pa.record_batch([pa.array([path]), pa.array([len(raw)], pa.int64())], ["path", "bytes"])

        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                raw, at = text_bytes(b.column("text"))
                held.append((raw, np.diff(at), b.column("id").to_numpy(zero_copy_only=False)))
                size += len(raw)
                if size >= BLOCK_BYTES or sum(len(h[1]) for h in held) >= BLOCK_BYTES >> 4:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col(row_id).cast("long"), F.lit(int(_NO_ID))).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(save, "path string, bytes long"), "passage-manifest")


def read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block, the offsets of its texts (n + 1), and their ids."""
    with reader(path) as file:
        head, _, body = file.read().partition(b"\n")
    parts, lo = [], 0
    for n in json.loads(head):
        parts.append(_unzip(body[lo: lo + n]))
        lo += n
    lengths, ids = (np.frombuffer(p, "<i8") for p in parts[1:])
    return np.frombuffer(parts[0], np.uint8), np.append(0, np.cumsum(lengths)), ids


def _per_path(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(path, rows)`` for each block: ``rows`` are its ``kind, part, blob``, a few for each shard."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("blob").to_pylist())]
        yield from work(key[0].as_py(), got)

    return rows.groupBy("path").applyInArrow(run, schema)


_MESSAGE = "path string, kind int, part int, blob binary"


def _messages(path: str, kind: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(found)
    return pa.record_batch([pa.array([path] * n, pa.string()), pa.array([kind] * n, pa.int32()), pa.array([p for p, _ in found], pa.int32()),
                            pa.array([b for _, b in found], pa.binary())], ["path", "kind", "part", "blob"])


def _parts(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def anchors(manifest: DataFrame, size: int, bits: int) -> DataFrame:
    """The contexts of each block's fragments, and 16 bits of their anchors, by range of anchors."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                raw, at, _ = read_block(path)
                _, _, anchor, left, right = contexts(raw, at, size)
                order, cut = _by_part(anchor, bits)
                tag = anchor.astype("<u2")
                yield _messages(path, 0, [(p, a.to_bytes(8, "little") + _zip(b"".join(x[order[a:b]].tobytes() for x in (left, right, tag))))
                                          for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b])

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(send, _MESSAGE)


def _by_part(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """A block's fragments shard by shard, and where each shard's begin."""
    part = _parts(anchor, bits).astype(np.uint16 if bits <= 16 else np.uint32)  # (16 bits are sorted by radix)
    return part.argsort(kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=1 << bits))).tolist()


def _again(values: np.ndarray) -> np.ndarray:
    """Whether each value but 0 occurs again."""
    order = values.argsort()
    same = np.diff(values[order]) == 0
    out = np.zeros(len(values), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out & (values != 0)


def repeated(sent: DataFrame) -> DataFrame:
    """To each block, those of its fragments (by their place in the order of :func:`_by_part`) with a context that occurs again anywhere: 1, or 2 if their anchor is hot."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, begins, lists = [], [], []
        for b in batches:
            paths += b.column("path").to_pylist()
            for blob in b.column("blob"):
                blob = blob.as_py()
                data = _unzip(blob[8:])
                n = len(data) // 10
                begins.append(int.from_bytes(blob[:8], "little"))
                lists.append((np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u4", n, 4 * n), np.frombuffer(data, "<u2", n, 8 * n)))
        left, right, tag = (np.concatenate(x) for x in zip(*lists))
        kind = (_again(left) | _again(right)).astype(np.int64)
        many = np.bincount(tag[kind > 0], minlength=1 << 16) > HOT_RUNS
        if many.any():
            kind += (kind > 0) & many[tag]
        lo = 0
        for path, begin, (own, _, _) in zip(paths, begins, lists):
            mine = kind[lo: lo + len(own)]
            lo += len(own)
            some = np.flatnonzero(mine)
            if len(some):
                yield _messages(path, 0, [(key[0].as_py(), pack((some + begin).astype(np.uint64), mine[some]))])

    return sent.groupBy("part").applyInArrow(add, _MESSAGE)


class Fragments:
    """A block's fragments that can hold repeated strings: where they are, and the distinct ones by shard."""

    def __init__(self, path: str, told: list[bytes], size: int, bits: int):
        self.raw, self.at, self.ids = read_block(path)
        start, count, anchor = runs(self.raw, self.at, size)
        order, _ = _by_part(anchor, bits)
        kinds = np.zeros(len(anchor), np.int64)
        for blob in told:
            places, kind = unpack(blob)
            kinds[order[places.astype(np.int64)]] = kind
        one, hot = kinds == 1, kinds == 2
        # strings of hot anchors one by one, by their own hash
        n = count[hot]
        single = np.repeat(start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.zeros(len(single), np.uint64)
        for lo in range(0, len(single), _FEW):
            own[lo: lo + _FEW] = mix64(_spread(_VALUE[self.raw[single[lo: lo + _FEW, None] + np.arange(size)]].T, size)[0])
        self.start = np.append(start[one], single)
        self.count = np.append(count[one], np.ones(len(single), np.int64))
        part = np.append(_parts(anchor[one], bits), _parts(own, bits))
        owner = self.ids[np.searchsorted(self.at, self.start, side="right") - 1]
        text, index = self.raw.tobytes(), {}
        self.which = np.fromiter((index.setdefault(text[s: s + c + size - 1], len(index)) for s, c in zip(self.start.tolist(), self.count.tolist())), np.int64, len(self.start))
        self.distinct = list(index)
        self.document = np.full(len(index), _NO_ID, np.int64)
        np.minimum.at(self.document, self.which, owner)
        self.part = np.zeros(len(index), np.int64)
        self.part[self.which] = part
        #: Whether a fragment is one string of a hot anchor.
        self.hot = np.zeros(len(index), bool)
        self.hot[self.which[len(self.which) - len(single):]] = True
        self.order = np.argsort(self.part, kind="stable")  # shard by shard, in order of first occurrence

    def shards(self) -> list[tuple[int, np.ndarray]]:
        cut = np.flatnonzero(np.append(True, np.diff(self.part[self.order]) != 0)) if len(self.order) else np.zeros(0, np.int64)
        return [(int(self.part[ix[0]]), ix) for ix in np.split(self.order, cut[1:]) if len(ix)]


def fragments(told: DataFrame, size: int, bits: int) -> DataFrame:
    """Each block's distinct fragments by shard, with the least document of each."""
    def send(path: str, rows: list) -> Iterator[pa.RecordBatch]:
        block = Fragments(path, [r[2] for r in rows], size, bits)
        for part, index in block.shards():
            texts = [block.distinct[i] for i in index.tolist()]
            head = np.concatenate([block.document[index], np.array([len(x) for x in texts], np.int64) + (block.hot[index].astype(np.int64) << 32)]).astype("<i8")
            yield _messages(path, 1, [(part, len(index).to_bytes(8, "little") + _zip(head.tobytes() + b"".join(texts)))])

    return _per_path(told, send, _MESSAGE)


def _unpack_fragments(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Least documents, whether a fragment is one string of a hot anchor, and the fragments."""
    n = int.from_bytes(blob[:8], "little")
    data = _unzip(blob[8:])
    documents, lengths = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
    hot, lengths = lengths >> 32 > 0, lengths & 0xFFFFFFFF
    ends = (16 * n + np.cumsum(lengths)).tolist()
    return documents, hot, [data[e - x: e] for e, x in zip(ends, lengths.tolist())]


def _anchored(fragments: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, left and right context (as hashes, 0: too short for one) of fragments."""
    anchor, free, half, low = _places(size)
    lengths = np.array([len(f) for f in fragments], np.int64)
    text, start = np.frombuffer(b"".join(fragments), np.uint8), np.cumsum(lengths) - lengths
    out = np.zeros((3, len(fragments)), np.uint64)
    for lo in range(0, len(fragments), _FEW):
        begin = start[lo: lo + _FEW]
        least = _ranked(_spread(_VALUE[text[begin + np.arange(size)[:, None]]], anchor), low)
        least = (least | np.arange(free + 1, dtype=np.uint64)[:, None]).min(axis=0)
        out[0, lo: lo + _FEW] = _anchors_of(least, low)
        place = (least & low).astype(np.int64)
        for side, some, at in ((1, place >= half, begin + place - half), (2, lengths[lo: lo + _FEW] - anchor - place >= half, begin + place)):
            some = np.flatnonzero(some)
            if len(some):
                out[side, lo + some] = mix64(_spread(_VALUE[text[at[some] + np.arange(anchor + half)[:, None]]], anchor + half)[0]) | np.uint64(1)
    return out[0], out[1], out[2]


def _lone(fragments: list[bytes], size: int) -> np.ndarray:
    """Whether no other of these distinct fragments has the left or the right context of a fragment; they then hold none of its strings."""
    _, left, right = _anchored(fragments, size)
    return ~(_again(left) | _again(right))


def _shared(fragments: list[bytes], strings: np.ndarray, size: int) -> np.ndarray:
    """For each string of the fragments, one after the other, whether its hash occurs again among them."""
    raw = np.frombuffer(b"".join(fragments), np.uint8)
    start = np.cumsum(strings + size - 1) - (strings + size - 1)
    return _again(string_hashes(raw, size)[_flat(start, strings)] | np.uint64(1))


def _flat(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at ``start`` and have ``count`` numbers."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _common(fragments: list[bytes], least: np.ndarray, size: int) -> np.ndarray:
    """:func:`_least_values` of distinct fragments, with an array of those parts of them whose strings other parts hold too.

    Fragments are cut to the runs of strings that occur again. Equal runs become one; of these only runs that still hold a string of another
    one, or one twice, go into the array.
    """
    strings = np.array([len(f) for f in fragments], np.int64) - size + 1
    at = np.cumsum(strings) - strings
    found, again = np.repeat(least, strings), _shared(fragments, strings, size)
    first = np.zeros(len(again), bool)
    first[at] = True
    begin = np.flatnonzero(again & (first | ~np.append(False, again[:-1])))
    if not len(begin):
        return found
    end = np.flatnonzero(again & np.append(first[1:] | ~again[1:], True)) + 1
    owner = np.searchsorted(at, begin, side="right") - 1
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(fragments[f][a: a + n + size - 1], len(index)) for f, a, n in zip(owner.tolist(), (begin - at[owner]).tolist(), (end - begin).tolist())),
                        np.int64, len(begin))
    parts, document = list(index), np.full(len(index), _NO_ID, np.int64)
    np.minimum.at(document, which, least[owner])
    count = np.array([len(p) for p in parts], np.int64) - size + 1
    place = np.cumsum(count) - count
    value = np.repeat(document, count)
    contested = np.flatnonzero(np.logical_or.reduceat(_shared(parts, count, size), place))
    if len(contested):
        value[_flat(place[contested], count[contested])] = _least_values([parts[i] for i in contested.tolist()], document[contested], size)
    found[_flat(begin, end - begin)] = value[_flat(place[which], count[which])]
    return found


def shard_arrays(sent: DataFrame, size: int) -> DataFrame:
    """To each block, the least document of each string of its fragments: one suffix array per shard, or more between different anchors.

    The arrays hold what fragments with a context that another distinct one has too share with others (:func:`_common`). The strings of the others are in copies of their fragment
    alone, whose least document is theirs; so are single strings, of hot anchors.
    """
    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        paths, lists, documents, single = [], [], [], []
        for b in batches:
            paths += b.column("path").to_pylist()
            for blob in b.column("blob"):
                document, hot, texts = _unpack_fragments(blob.as_py())
                which = np.fromiter((index.setdefault(x, len(index)) for x in texts), np.int64, len(texts))
                lists.append(which)
                documents.append(document)
                single.append(which[hot])
        least, alone = np.full(len(index), _NO_ID, np.int64), np.zeros(len(index), bool)
        for which, document in zip(lists, documents):
            np.minimum.at(least, which, document)
        alone[np.concatenate(single)] = True
        texts = list(index)
        del index
        strings = np.array([len(x) for x in texts], np.int64) - size + 1
        at = np.cumsum(strings) - strings
        found, several = np.repeat(least, strings), np.flatnonzero(~alone)
        if len(several):
            anchor, left, right = _anchored([texts[i] for i in several.tolist()], size)
            crowded = _again(left) | _again(right)
            order = np.argsort(anchor[crowded], kind="stable")
            several, anchor = several[crowded][order], anchor[crowded][order]
            cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))  # where an anchor's fragments begin
            total = np.cumsum(strings[several] + size)
            cut = cut[np.diff(total[cut] // ARRAY_BYTES, prepend=-1) > 0] if len(several) else cut
            for some in np.split(several, cut[1:]) if len(several) else ():
                found[_flat(at[some], strings[some])] = _common([texts[i] for i in some.tolist()], least[some], size)
        for path, which in zip(paths, lists):
            yield _messages(path, 1, [(key[0].as_py(), _zip(found[_flat(at[which], strings[which])].astype("<i8")))])

    return sent.groupBy("part").applyInArrow(work, _MESSAGE)


def _cut(path: str, rows: list, size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The texts of a block without the repeated bytes."""
    block = Fragments(path, [r[2] for r in rows if r[0] == 0], size, bits)
    found = {part: np.frombuffer(_unzip(blob), "<i8") for kind, part, blob in rows if kind == 1}
    repeats = np.zeros(len(block.raw), bool)
    if len(block.start):
        # the answers, fragment by fragment in the order in which they were asked
        answer = np.concatenate([found[part] for part, _ in block.shards()])
        strings = np.array([len(x) for x in block.distinct], np.int64) - size + 1
        at = np.empty(len(strings), np.int64)
        at[block.order] = np.cumsum(strings[block.order]) - strings[block.order]
        for lo in range(0, len(block.start), _FEW):
            start, count, which = block.start[lo: lo + _FEW], block.count[lo: lo + _FEW], block.which[lo: lo + _FEW]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(block.ids[np.searchsorted(block.at, start, side="right") - 1], count)
            repeats[np.repeat(start, count) + nth] = answer[np.repeat(at[which], count) + nth] < owner
    # a byte goes if a repeated string starts at it or less than ``size`` before it
    begun = np.cumsum(repeats, dtype=np.int32)
    gone = begun > 0
    gone[size:] = begun[size:] > begun[:-size]
    del begun
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    inner = np.unique(block.at[(block.at > 0) & (block.at < len(gone))])
    edge[inner] = 0  # a span ends with its text
    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner[gone[inner]]]))
    stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner[gone[inner - 1]]]))
    text, kept = block.raw.tobytes(), ~gone
    for lo in range(0, len(block.ids), 1024):
        ids, ks, spans = [], [], []
        for i in range(lo, min(lo + 1024, len(block.ids))):
            a, b = int(block.at[i]), int(block.at[i + 1])
            x, y = np.searchsorted(begin, a), np.searchsorted(begin, b)
            ks.append(text[a:b] if x == y else block.raw[a:b][kept[a:b]].tobytes())
            spans.append([{"start": int(s) - a, "end": int(e) - a} for s, e in zip(begin[x:y], stop[x:y])])
            ids.append(None if block.ids[i] == _NO_ID else int(block.ids[i]))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(block.at[lo: lo + len(ids) + 1]), pa.int64()),
                               pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ks, pa.binary())],
                              ["id", "n_bytes", "spans", "kept"])


def remove_passages(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``row_id, n_bytes, spans`` (removed runs, ends exclusive, in bytes) and ``kept`` (what remains, as bytes)."""
    manifest = make_blocks(docs, row_id, text)
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, total) / SHARD_BYTES))))
    again = repeated(anchors(manifest, size, bits))
    blocks = manifest.select("path", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("blob"))
    told = written(again, "passage-anchors")
    answers = shard_arrays(fragments(told, size, bits), size)
    out = _per_path(blocks.unionByName(told).unionByName(answers), lambda path, rows: _cut(path, rows, size, bits),
                    "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", row_id)
