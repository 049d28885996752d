"""Runs of repeated words, found by catching squares while words are appended.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word
extends. Every completed block of L = 2^k words is a catcher: it waits for the suffix of L words that ends at an appended
word to equal it, between 2L and 4L words behind its own start (from 1 on for single words). A square of period p in
that range holds such a block whole in its first half, so no square is missed. An appended word therefore costs two
comparisons of fingerprints for each power of two. A caught pair is extended to both sides by fingerprints of falling
powers of two; what is as long as a square is kept, and squares of one period that overlap are one run. A stretch that
reaches the last word is extended when more are appended. Fingerprints only propose: a run's words themselves are compared.

Words are appended many at once (STEP), which numpy compares together; the result is that of single words.

Texts are cut to slices, so memory is that of a slice (common.SLICE_BYTES) or of one longer text: about 4 bytes for each word and
power of two up to its length. Nulls: a null text has no words; ids may be null and repeat. Empty tables give empty results.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rules import bind
from lectern.llm.common import Words, as_text, byte_table, columns_of, ragged, slices, tidy

#: Words that are appended at once.
STEP = 1 << 20
#: A run that is reported has this many words and this many periods.
LEAST, PERIODS = 24, 3

TABLE = byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=False)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of windows from those of their halves."""
    x = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


class Catchers:
    """Squares of a growing row of numbers, merged to runs.

    room: how many numbers will come; longest: no square is longer (a text's length where texts are apart).
    """

    def __init__(self, room: int, longest: int | None = None):
        longest = room if longest is None else longest
        self.n = 0
        # names[k][i]: the fingerprint of the 2^k numbers from i on; the numbers themselves for k = 0
        self.names = [np.zeros(room, np.uint32) for _ in range(max(1, int(longest).bit_length()))]
        self.catching = [k for k in range(len(self.names)) if k == 0 or 4 << k <= longest]
        self.known: dict[tuple[int, int], int] = {}  # (start, period): end of the pairs, which is that of the run less its period
        # of the run that reaches farthest from a place: its end and period
        self.reach, self.period = np.zeros(room, np.int64), np.ones(room, np.int64)

    def append(self, numbers: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(numbers)
        self.names[0][old : self.n] = numbers
        for k in range(1, len(self.names)):
            lo, hi, half = max(0, old - (1 << k) + 1), self.n - (1 << k) + 1, 1 << (k - 1)
            if hi > lo:
                self.names[k][lo:hi] = _joined(self.names[k - 1][lo:hi], self.names[k - 1][lo + half : hi + half])
        self._prolong(old)
        for k in self.catching:
            for lag in (1, 2, 3) if k == 0 else (2, 3):
                self._catch(k, lag, old)

    def _catch(self, k: int, lag: int, old: int) -> None:
        """Suffixes of 2^k numbers that end at new ones, against the block that began `lag` blocks before theirs."""
        size, names = 1 << k, self.names[k]
        lo, hi = max(lag * size, old - size + 1), self.n - size + 1
        if hi <= lo:
            return
        first = lo // size
        heads = names[(first - lag) * size : ((hi - 1) // size - lag) * size + 1 : size]
        at = np.flatnonzero(names[lo:hi] == np.repeat(heads, size)[lo - first * size : hi - first * size]) + lo
        block = (at // size - lag) * size
        p = at - block
        inside = (self.reach[block] >= at + size) & (p % self.period[block] == 0)  # it says what a known run says
        block, p = block[~inside], p[~inside]
        for i in range(0, len(block), STEP):
            self._keep(block[i : i + STEP], p[i : i + STEP])

    def _keep(self, x: np.ndarray, p: np.ndarray) -> None:
        start, stop = self._back(x, p), self._on(x, p)
        good = (stop - start >= p) | (stop + p == self.n)
        for u, q, v in set(zip(start[good].tolist(), p[good].tolist(), stop[good].tolist(), strict=True)):
            self._add(u, q, v)

    def _add(self, u: int, q: int, v: int) -> None:
        """Notes that numbers q apart are equal from u to v, as far as they are; what is too short for a square and ended is not kept."""
        same = self.names[0][u:v] == self.names[0][u + q : v + q]
        if not same.all():
            edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0)) + u
            for a, b in edge.reshape(-1, 2).tolist():
                self._add(a, q, b)
            return
        if v - u < q and v + q < self.n:
            return
        self.known[u, q] = max(v, self.known.get((u, q), 0))
        if v - u >= q:
            e = v + q
            farther = self.reach[u:e] < e
            self.reach[u:e][farther] = e
            self.period[u:e][farther] = q

    def _prolong(self, old: int) -> None:
        """Stretches that ended with the last word before go on; those that stay too short are forgotten."""
        for (u, q), v in [x for x in self.known.items() if x[1] + x[0][1] == old]:
            del self.known[u, q]
            self._add(u, q, int(self._on(np.array([v]), np.array([q]))[0]))

    def _on(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How far from x on numbers p apart are equal."""
        x = x.copy()
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            fits = np.flatnonzero(x + p + size <= self.n)
            while len(fits):
                fits = fits[names[x[fits]] == names[x[fits] + p[fits]]]
                x[fits] += size
                fits = fits[x[fits] + p[fits] + size <= self.n]
        return x

    def _back(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            fits = np.flatnonzero(x >= size)
            while len(fits):
                fits = fits[names[x[fits] - size] == names[x[fits] - size + p[fits]]]
                x[fits] -= size
                fits = fits[x[fits] >= size]
        return x

    def runs(self, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
        """(start, end, period) of runs of that many numbers and periods, by start and then period."""
        best: dict[tuple[int, int], int] = {}
        for (u, q), v in self.known.items():
            if v + q - u >= max(least, periods * q):
                best[u, v + q] = min(q, best.get((u, v + q), q))  # of a stretch's periods the smallest
        return np.array(sorted((u, e, q) for (u, e), q in best.items()), np.int64).reshape(-1, 3)


def runs_of(words: Words, least: int = LEAST, periods: int = PERIODS, step: int | None = None) -> np.ndarray:
    """(text, start, end, period) of the runs of each text, start and end as numbers of its words."""
    n = words.counts()
    texts, total = len(n), len(words)
    if not total:
        return np.zeros((0, 4), np.int64)
    # a number for each word, and one of its own for each text's end, so that nothing goes on over it
    row = np.zeros(total + texts, np.uint32)
    begin = words.first[:-1] + np.arange(texts)
    row[begin + n] = (1 << 31) + np.arange(texts)
    coded = words.array().dictionary_encode().indices
    row[ragged(begin, n)] = np.asarray(coded).astype(np.uint32)
    c = Catchers(len(row), int(n.max()))
    step = step or STEP
    for i in range(0, len(row), step):
        c.append(row[i : i + step])
    found = c.runs(least, periods)
    text = np.searchsorted(begin, found[:, 0], "right") - 1
    return np.column_stack([text, found[:, 0] - begin[text], found[:, 1] - begin[text], found[:, 2]])


def collapsed(words: Words, runs: np.ndarray) -> pa.Array:
    """The texts with one period of each run: what lies in a run behind its first period goes; words joined by one blank."""
    keep = np.ones(len(words), bool)
    for text, start, end, q in runs.tolist():
        keep[words.first[text] + start + q : words.first[text] + end] = False
    size = np.where(keep, words.end - words.start + 1, 0)
    ends = np.cumsum(size)
    src = np.frombuffer(words.buf + b" ", np.uint8)
    out = src[ragged(words.start[keep], size[keep])]
    out[ends[keep] - 1] = 32
    upto = np.append(0, ends)[words.first]
    start, stop = upto[:-1], np.maximum(upto[:-1], upto[1:] - 1)  # without the last blank
    out = out[ragged(start, stop - start)]
    offsets = np.append(0, np.cumsum(stop - start))
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and then period) and collapsed, the text with one period of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(as_text(batch.column("text")), TABLE)
            found = runs_of(words, least, periods)
            offsets = pa.array(np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1)), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 1], found[:, 2] - found[:, 1], found[:, 3])], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts()), pa.ListArray.from_arrays(offsets, flat), collapsed(words, found).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    plain = columns_of(docs, "doc_id", "text")
    return plain.mapInArrow(tidy(run), plain.select("doc_id", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit("").alias("collapsed")).schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The texts of the report: where h = crc32(doc_id) is a multiple of ten, with g = h // 10, the words from a = g mod n
    on are the first p = 1 + (n - a) // (3 + g mod 8) of them again and again. A null id counts as the empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def loop(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        at = lambda i, p: F.when(i < a, i).otherwise(a + (i - a) % p)
        again = bind(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, at(i, p).cast("int"))), " "))
        return F.when(n > 0, again).otherwise(F.lit(""))

    return F.when(h % 10 == 0, bind(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), loop)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (the first of equals, null without runs), the digests of the runs and of
    the collapsed text, and n_words."""
    plain = columns_of(docs, "doc_id", "text")
    found = with_runs(plain.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(more(x, a), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    lines = F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_b.start").alias("start"),
        F.col("_b.length").alias("length"),
        F.col("_b.period").alias("period"),
        F.floor(1000 * F.col("_b.length") / F.col("_b.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
