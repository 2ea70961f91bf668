"""Sorted runs: rows sorted by a binary key, in files of the shared folder, read back by key ranges.

A task sorts the rows that it holds and writes them as one run: blocks of about ``BLOCK`` bytes (Arrow streams,
compressed together) and a manifest row with each block's first key and place. Once all runs are
written, a range of keys is read from the blocks of each run that can hold it. So rows are written once,
compressed in blocks, and the ranges are chosen when the number of bytes is known; the folder can be deleted when they are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.files import create, own_name, reader

#: Bytes of a block, and of rows between two sampled keys, before compression.
BLOCK, SAMPLED = 64 << 10, 1 << 20
#: Of zstd: 4 % smaller than 3, for twice the time.
LEVEL = 5
MANIFEST = "path string, bytes long, keys array<binary>, places array<long>, samples array<binary>"
_SPANS = "part int, path string, begin long, bytes long"
_PLACES = pa.list_(pa.int64())
_KEYS = pa.list_(pa.binary())


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    data = sink.getvalue()
    return data.size.to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _unpack(blob: bytes) -> pa.Table:
    data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd")
    return pa.ipc.open_stream(data).read_all()


def save(table: pa.Table, sizes: np.ndarray, folder: str) -> pa.RecordBatch:
    """Write ``table``, sorted here by its column ``key``, as one run; its manifest row. ``sizes``: about the bytes of each row."""
    order = pc.sort_indices(table, sort_keys=[("key", "ascending")])
    table, total = table.take(order).combine_chunks(), np.cumsum(sizes[order.to_numpy()])
    blocks = np.append(np.flatnonzero(np.diff((total - 1) // BLOCK, prepend=-1)), table.num_rows)
    path, places = own_name(folder, ".run"), [0]
    with create(path) as out:
        for a, b in zip(blocks[:-1].tolist(), blocks[1:].tolist()):
            raw = _pack(table.slice(a, b - a))
            raw = len(raw).to_bytes(8, "little") + raw
            out.write(raw)
            places.append(places[-1] + len(raw))
    key = table.column("key")
    # runs of like rows have like quantiles: each samples its own, lest all samples of all runs fall together
    many = -(-int(total[-1]) // SAMPLED)
    sampled = np.searchsorted(total, (np.arange(many) + zlib.crc32(key[0].as_py()) / 2**32) * (int(total[-1]) / many), side="right")
    taken = lambda at: pa.array([key.take(pa.array(at)).to_pylist()], _KEYS)
    return pa.record_batch([pa.array([path]), pa.array([int(total[-1])], pa.int64()), taken(blocks[:-1]), pa.array([places], _PLACES), taken(np.minimum(sampled, table.num_rows - 1))],
                           ["path", "bytes", "keys", "places", "samples"])


def spans(manifest: DataFrame, bounds: list[bytes]) -> DataFrame:
    """``part, path, begin, bytes``: where the rows of each range of keys (from one bound to the next) can be; a part in one partition, and grouped by part without a shuffle."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, keys, places in zip(*(batch.column(c).to_pylist() for c in ("path", "keys", "places"))):
                parts, begins, sizes = [], [], []
                for part, low in enumerate(bounds):
                    a = max(0, bisect_left(keys, low) - 1)
                    b = bisect_left(keys, bounds[part + 1]) if part + 1 < len(bounds) else len(keys)
                    if a < b:
                        parts.append(part)
                        begins.append(places[a])
                        sizes.append(places[b] - places[a])
                yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([path] * len(parts), pa.string()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())],
                                      ["part", "path", "begin", "bytes"])

    found = manifest.select("path", "keys", "places").mapInArrow(find, _SPANS)
    return found.repartition(len(bounds), "part")


def load(batches: Iterator[pa.RecordBatch], bounds: list[bytes], part: int) -> pa.Table | None:
    """All rows of one range, given by its rows of :func:`spans`."""
    low, high = bounds[part], bounds[part + 1] if part + 1 < len(bounds) else None
    found = []
    for batch in batches:
        for path, begin, n in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "bytes"))):
            with reader(path) as file:
                file.seek(begin)
                raw = file.read(n)
            at = 0
            while at < n:
                size = int.from_bytes(raw[at: at + 8], "little")
                table, at = _unpack(raw[at + 8: at + 8 + size]), at + 8 + size
                keep = pc.greater_equal(table.column("key"), pa.scalar(low, pa.binary()))
                if high is not None:
                    keep = pc.and_(keep, pc.less(table.column("key"), pa.scalar(high, pa.binary())))
                table = table.filter(keep)
                if table.num_rows:
                    found.append(table)
    return pa.concat_tables(found).combine_chunks() if found else None
