"""What the operators share: tables written to the shared folder, folds, hot keys, Arrow words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import shared_dir

#: White space of every word rule here: blank, and tab to carriage return.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2_500_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where recording() notes the tables that are written.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, survives lost executors, cuts lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile."""
    token = _noted.set([])
    try:
        yield _noted.get()
    finally:
        _noted.reset(token)


def removed(spark: SparkSession, paths: list[str], reader: DataFrame) -> list[str]:
    """Removes tables, but those that reader reads; returns these. Where reader doesn't say what it reads, all stay."""
    files = reader.inputFiles()
    stay = [p for p in paths if not files or any(p.rpartition("/")[2] in f for f in files)]
    for p in set(paths) - set(stay):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return stay


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands: that of the exact name, or else the first whose name differs in case alone."""
    have = df.columns
    return have.index(name) if name in have else [c.lower() for c in have].index(name.lower())


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name first, so that further columns (also `TEXT` beside `text`) can't clash."""
    have = df.columns
    at = [place_of(df, n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "left", most_hot: int = 4096) -> DataFrame:
    """left joined to right, which has one row for each key at most, without a hot key meeting in one task.

    counts (key, n) has left's rows by key. A key is hot from n0 = 1 + sum(n) // most_hot rows on, so there are
    fewer than most_hot hot keys whatever the data: right's rows of these are broadcast. The others, each below
    n0 rows, are joined by a shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1000, 1 + total // most_hot)
    keys = [r[0] for r in counts.where((F.col("n") >= least) & F.col(key).isNotNull()).select(key).collect()]
    if not keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


# ---------------------------------------------------------------- Arrow


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed `most` bytes; one long text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back to the system at its end: a worker waits for its next task, perhaps of another stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def as_text(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts, in one fresh buffer without an offset."""
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_table(space: Callable[[int], bool], lower: bool) -> bytes:
    """A table for bytes.translate: separators become blanks, A-Z lower case if asked."""
    return bytes(32 if space(b) else (_LOWER[b] if lower else b) for b in range(256))


class Words:
    """All words of a slice, as spans of one byte buffer.

    buf: the translated bytes; start, end: of each word; first: index of each text's first word, and the end.
    """

    def __init__(self, texts: pa.Array, table: bytes):
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        raw = memoryview(raw)[off[0] : off[-1]].tobytes() if raw is not None and len(texts) else b""
        self.buf = raw.translate(table)
        off = off - off[0] if len(off) else np.zeros(1, np.int64)
        inside = np.frombuffer(self.buf, dtype=np.uint8) != 32
        # a word also ends where its text ends
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        cuts = off[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)
        self.off = off

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.Array:
        """The words as an Arrow string array."""
        n = len(self.start)
        length = self.end - self.start
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        src = np.frombuffer(self.buf, dtype=np.uint8)
        keep = src[ragged(self.start, length)] if n else src[:0]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(keep)])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
