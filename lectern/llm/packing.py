"""Packing of documents into sequences by best-fit decreasing.

A document's ids end with id 1. What fills whole windows is cut off first; the rest of each document is placed,
longest first, in the open window that it leaves the least room in. A segment tree over room 0 to 2047 counts
the open windows with each room, and finds the tightest that fits in a few steps.

Pieces are dealt at random into groups of about PER_GROUP (the number of groups follows the data), and each
group is packed on its own: a group leaves a few windows that are not full, among thousands.

A very long text is cut into whole windows and a rest. Nulls: a null text is empty, so it is id 1 alone; null and repeated ids are packed as they are. Empty tables
give an empty result. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, columns_of, slices, tidy, written
from lectern.llm.tokens import encoder

WINDOW = 2048
END = 1
PER_GROUP = 8192

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, slot bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Rooms:
    """Open windows by the room left in them."""

    def __init__(self, window: int):
        self.base = 1 << (window - 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def _add(self, room: int, by: int) -> None:
        i = self.base + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, which: int) -> None:
        if room:
            self.open[room].append(which)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least size, and this room; it is no longer open."""
        i = self.base + size
        if size >= self.base:
            return None
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until there is something on the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset in it of each piece; no piece is longer than the window."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    rooms, n = Rooms(window), 0
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        if found := rooms.take(size):
            which, room = found
        else:
            which, room, n = n, window, n + 1
        sequence[i], offset[i] = which, window - room
        rooms.put(room - size, which)
    return sequence, offset


def cut(batches: Iterator[pa.RecordBatch], window: int, end: int, keep_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """Pieces of documents: whole windows, then the rest. slot: a number that deals the pieces out evenly."""
    from pyspark import TaskContext

    context = TaskContext.get()
    at, e = (context.partitionId() if context else 0) << 33, encoder()
    for batch in slices(batches):
        ids, first = e.encode(as_text(batch.column("text")))
        ids = np.insert(ids, first[1:], end).astype("<u4")
        first = first + np.arange(len(first))
        total = np.diff(first)
        n = -(-total // window)
        doc = np.repeat(np.arange(len(total)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
        length = np.minimum(window, total[doc] - start)
        begin = first[:-1][doc] + start
        crc = np.fromiter((zlib.crc32(ids[b : b + k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
        with np.errstate(over="ignore"):
            slot = (((np.arange(at, at + len(doc)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        at += len(doc)
        columns = [batch.column("doc_id").take(pa.array(doc)), start, length, crc, total[doc], slot]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(length) - length, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def pieces(docs: DataFrame, window: int = WINDOW, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids if asked."""
    rows = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(tidy(lambda it: cut(it, window, end, keep_ids)), PIECES + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, per_group: int = PER_GROUP, keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with the sequence that holds it and its offset there; keep_ids adds the ids."""
    table = written(pieces(docs, window, end, keep_ids), "pieces")
    groups = max(1, -(-table.count() // per_group))

    def packed(group: pa.Table) -> pa.Table:
        sequence, offset = best_fit_decreasing(np.asarray(group.column("length"), dtype=np.int64), window)
        base = int(group.column("_group")[0].as_py()) << 32
        out = group.drop_columns(["slot", "_group"])
        more = [c for c in out.column_names if c == "ids"]
        out = out.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
        return out.select([c for c in out.column_names if c not in more] + more)

    return table.withColumn("_group", F.col("slot") % groups).groupBy("_group").applyInArrow(packed, PACKED + ", ids array<int>" * keep_ids)
