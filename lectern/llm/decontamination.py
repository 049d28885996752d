"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of letters, digits and all beyond ASCII, lower-cased in A-Z. The automaton holds every word
sequence of the items; a document's words are streamed through it, which gives the longest match that ends at
each word. Ten or more: the last ten words are a window of the items named at the state of that length. An item
of fewer words is one window. Words in windows are hit.

Words that cannot be part of a window are passed over first, on whole slices: a window needs as many words in a
row as the shortest window has, whose neighbours also follow each other in some item. What is left is compared
word for word.

The items are taken in blocks of at most BLOCK_WORDS words, so that an automaton's size is bounded however many items there
are. A block is read when its turn comes and broadcast; the documents pass it in one narrow step, and where there are more blocks
their hits are written before the next one is sent. So driver and workers hold one block and one automaton, and each worker builds a
block's automaton once. One block is all that most benchmarks have.

clean() cuts hit words until no window is left: a cut brings the words around it together, so a text that was cut is matched
again, with one block in the task that holds it, with more as a table of the texts that were cut. What was hit in all passes
together counts for the coverage, against the words of the text as it came.

Very long texts: all words are looked at. Nulls: null texts have no words; items with a null id hit words but are not listed. An item or document without
words does nothing. Repeated items count once by their id. Empty tables give empty results, or no hits. Further
columns are not read, except by clean(), which keeps them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, as_text, byte_table, columns_of, place_of, slices, tidy, written

WINDOW = 10
BLOCK_WORDS = 200_000
#: Documents with a larger part of their words hit are dropped by clean().
MAX_COVERAGE = 0.5

#: Of the words: all bytes but digits, letters and those beyond ASCII separate.
TABLE = byte_table(lambda b: b < 0x30 or 0x3A <= b <= 0x60 and not 0x41 <= b <= 0x5A or 0x7B <= b <= 0x7F, lower=True)


class Automaton:
    """A suffix automaton of several word sequences; each state knows the items that its sequences occur in."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.whole: dict[int, dict[int, set[int]]] = {}  # state: by length, the items below the window that are its sequence
        self.names: list[str | None] = []
        vocabulary, pairs, ends = set(), set(), []
        shortest = window
        for name, words in items:
            if not words:
                continue
            which = len(self.names)
            self.names.append(name)
            vocabulary.update(words)
            pairs.update(zip(words, words[1:], strict=False))
            shortest = min(shortest, len(words))
            state = 0
            for w in words:
                state = self._extend(state, w)
                self._mark(state, which)
            if len(words) < window:
                ends.append((words, which))
        self.shortest = shortest if self.names else 0
        for words, which in ends:
            state = 0
            for w in words:
                state = self.next[state][w]
            self.whole.setdefault(state, {}).setdefault(len(words), set()).add(which)
        self.vocabulary = vocabulary
        self.pairs = pairs

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.items.append(set() if like is None else set(self.items[like]))
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """q, cut so that it begins with the sequences that reach it from p."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        """The state after last and w, in the item that is being added."""
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, q, w)
        new, p = self._new(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, self.next[p][w], w)
        return new

    def _mark(self, state: int, which: int) -> None:
        while state > 0 and which not in self.items[state]:
            self.items[state].add(which)
            state = self.link[state]

    def stream(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        state = long = 0
        seen: set[int] = set()
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if w not in self.next[state]:
                continue
            state, long = self.next[state][w], long + 1
            s = state
            if long >= self.window:
                hit[i + 1 - self.window : i + 1] = True
                while self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                if s not in seen:
                    seen.add(s)
                    found |= self.items[s]
            while s > 0 and self.whole:
                for m, which in self.whole.get(s, {}).items():
                    if m <= long:
                        hit[i + 1 - m : i + 1] = True
                        found |= which
                s = self.link[s]
        return hit, found


class Matcher:
    """An automaton with what passes over words in bulk."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.auto = Automaton(items, window)
        number = {w: i + 1 for i, w in enumerate(sorted(self.auto.vocabulary))}
        keys = np.array([_hash(w) for w in number], np.uint64)
        order = np.argsort(keys)
        self.keys, self.codes = keys[order], np.array(list(number.values()), np.int64)[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.size = len(number) + 1
        self.pairs = np.unique(np.array([number[a] * self.size + number[b] for a, b in self.auto.pairs], np.int64))

    def runs(self, words: Words) -> Iterator[tuple[int, int]]:
        """Spans of words, within one text, that may hold windows."""
        n, least = len(words), self.auto.shortest
        if not n or not least:
            return
        h = hashes(words)
        codes = np.zeros(n, np.int64)
        may = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        codes[may] = np.where(self.keys[at] == h[may], self.codes[at], 0)
        ok = codes > 0
        follows = np.zeros(n, bool)  # word i may continue a window that holds word i - 1
        i = np.flatnonzero(ok[1:] & ok[:-1]) + 1
        if len(i) and len(self.pairs):
            p = codes[i - 1] * self.size + codes[i]
            follows[i] = self.pairs[np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)] == p
        begins = words.first[:-1]
        follows[begins[begins < n]] = False
        start = np.flatnonzero(ok & ~follows)
        stop = np.flatnonzero(ok & ~np.append(follows[1:], False)) + 1
        keep = stop - start >= least
        yield from zip(start[keep].tolist(), stop[keep].tolist(), strict=True)

    def match(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text that has hits: spans of hit words (numbers in the text), and the items."""
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for a, b in self.runs(words):
            hit, found = self.auto.stream([words.buf[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)])
            if not found:
                continue
            doc = int(np.searchsorted(words.first, a, "right")) - 1
            base = a - int(words.first[doc])
            edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0)) + base
            spans, items = out.setdefault(doc, ([], set()))
            spans += [(int(s), int(e)) for s, e in zip(edge[0::2], edge[1::2], strict=True)]
            items |= found
        return out


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _hash(word: bytes) -> int:
    h = 0
    for x in reversed(word):
        h = (h * _BASE + x + 1) & _MASK
    return (h * 0xD6E8FEB86659FD93) & _MASK


#: Bytes of text that a worker looks at together: hashing holds several numbers of 8 bytes for each, and another worker cuts beside it.
SLICE_BYTES = 1_000_000


def hashes(words: Words) -> np.ndarray:
    """_hash of each word: prefix sums of byte * base**place, shifted back by the inverse base."""
    n = len(words.buf)
    with np.errstate(over="ignore"):
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = np.uint64(_BASE)
        np.multiply.accumulate(power, out=power)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((np.frombuffer(words.buf, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        back = np.empty(n + 1, np.uint64)
        back[0] = 1
        back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        np.multiply.accumulate(back, out=back)
        return (sums[words.end] - sums[words.start]) * back[words.start] * np.uint64(0xD6E8FEB86659FD93)


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    w = Words(as_text(pa.array(texts, pa.string())), TABLE)
    return [[w.buf[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, read one Spark partition after another, in blocks of at most `most` words (an item is never cut)."""
    block, size = [], 0
    rows = columns_of(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    for row in rows.toLocalIterator():
        words = words_of([row[1]])[0]
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


SPANS = "array<struct<first:int,stop:int>>"


def _step(block, window: int, text: int, spans: int, found: int, words: int):
    """Adds the hits of one block (a broadcast list of items) to the columns _spans and _items, given by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, block.value, window)
        for batch in slices(batches, batch_text, SLICE_BYTES):
            w = Words(as_text(batch.column(text)), TABLE)
            hits = matcher.match(w)
            columns = list(batch.columns)
            columns[words] = pa.array(w.counts(), pa.int64())
            if hits:
                old, ids = columns[spans].to_pylist(), columns[found].to_pylist()
                for doc, (s, k) in hits.items():
                    old[doc] = old[doc] + [{"first": a, "stop": b} for a, b in s]
                    ids[doc] = sorted({*ids[doc], *(matcher.auto.names[i] for i in k if matcher.auto.names[i] is not None)})
                columns[spans], columns[found] = pa.array(old, columns[spans].type), pa.array(ids, columns[found].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    batch_text, key = f"c{text}", block.key
    return run


_built: dict[str, Matcher] = {}
#: How often this worker has built a matcher.
built = 0


def _matcher(key: str, items: list[tuple[str | None, list[bytes]]], window: int) -> Matcher:
    """Built once in a worker, which serves many tasks; the one before it is given up."""
    global built
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, window)
        built += 1
    return _built[key]


@dataclass
class Block:
    """A broadcast block of items, and a key for its matcher in a worker."""

    items: Broadcast
    key: str

    @property
    def value(self) -> list[tuple[str | None, list[bytes]]]:
        return self.items.value


def shared_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The blocks, one after another; the driver reads a block when it is asked for, and holds none. One empty block where there
    are no items."""
    context = benchmark.sparkSession.sparkContext
    none = True
    for b in blocks(benchmark, most):
        none = False
        yield Block(context.broadcast(b), uuid.uuid4().hex)
    if none:
        yield Block(context.broadcast([]), uuid.uuid4().hex)


def _ahead(some: Iterator[Block]) -> Iterator[tuple[Block, bool]]:
    """Each block, and whether it is the last."""
    held = next(some)
    for x in some:
        yield held, False
        held = x
    yield held, True


def _found_in(df: DataFrame, benchmark: DataFrame, window: int, most: int, text: int, k: int, then=None) -> tuple[DataFrame, Block | None]:
    """df with the hits of all blocks in its columns k to k + 2; and the block where there is one alone. A block's hits are written to
    the shared folder before the next one is sent, so that no more than one is held anywhere. then: of a block alone, what goes on
    with its hits in the same worker; columns _words and _hit are added for it."""
    alone = None
    for i, (block, last) in enumerate(_ahead(shared_blocks(benchmark, most))):
        alone = block if last and not i else None
        if alone is not None and then is not None:
            df = df.withColumns({c: F.lit(0).cast("bigint") for c in ("_words", "_hit")})
            find, go_on = _step(block, window, text, k + 1, k + 2, k), then(block)
            return df.mapInArrow(tidy(lambda batches: go_on(b.set_column(k + 3, "_words", b.column(k)) for b in find(batches))), df.schema), alone
        df = df.mapInArrow(tidy(_step(block, window, text, k + 1, k + 2, k)), df.schema)
        if not last or i:
            df = written(df, "block-hits")
            block.items.unpersist()
    return df, alone


def _with_hits(docs: DataFrame) -> DataFrame:
    df = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return df.select("*", F.lit(0).cast("bigint").alias("_n"), F.array().cast(SPANS).alias("_spans"), F.array().cast("array<string>").alias("_items"))


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """docs, columns renamed c0, c1, ..., with _n (words), _spans (of hit words, unmerged) and _items (ids as strings)."""
    return _found_in(_with_hits(docs), benchmark, window, most, place_of(docs, "text"), len(docs.columns))[0]


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted((s["first"], s["stop"]) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans of each document."""
    df = matched(columns_of(docs, "doc_id", "text"), benchmark, window, most)
    spans = F.sort_array("_spans")
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    n_hit = F.aggregate(spans, start, lambda a, x: F.struct(F.greatest(a["upto"], x["stop"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["upto"], x["first"]))).alias("n")), lambda a: a["n"])
    ids = F.sort_array(F.array_distinct("_items"))
    return df.select(F.col("c0").alias("doc_id"), F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"), spans.alias("hit_spans"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw, w = text.encode(), Words(as_text(pa.array([text])), TABLE)
    for a, b in reversed(spans):
        raw = raw[: w.start[a]] + raw[w.end[b - 1] :]
    return raw.decode()


def _removed(text: int, n_chars: int | None, block: Block | None, window: int, max_coverage: float):
    """Cuts the hit words out of the texts and drops documents beyond the coverage. With one block alone a text is looked at again
    until nothing is hit; else it keeps its hits, which say that it has to be."""

    def again(cut: str) -> list[tuple[int, int]]:
        w = Words(as_text(pa.array([cut])), TABLE)
        return _merged([{"first": a, "stop": b} for s, _ in _matcher(block.key, block.value, window).match(w).values() for a, b in s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("_spans").to_pylist()
            dirty = [i for i, s in enumerate(spans) if s]
            if not dirty:
                yield batch
                continue
            texts, keep = batch.column(text).to_pylist(), np.ones(batch.num_rows, bool)
            counts, hits = batch.column("_words").to_pylist(), batch.column("_hit").to_pylist()
            for i in dirty:
                found = _merged(spans[i])
                while found:
                    hits[i] += sum(b - a for a, b in found)
                    keep[i] = hits[i] <= max_coverage * counts[i]
                    if not keep[i]:
                        break
                    texts[i] = cut_out(texts[i], found)
                    found = again(texts[i]) if block else []
            columns = list(batch.columns)
            columns[text] = pa.array(texts, columns[text].type)
            columns[batch.schema.get_field_index("_hit")] = pa.array(hits, pa.int64())
            if n_chars is not None:
                old = columns[n_chars].to_pylist()
                columns[n_chars] = pa.array([len(t) if s else o for t, s, o in zip(texts, spans, old, strict=True)], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, most: int = BLOCK_WORDS) -> DataFrame:
    """The documents with all hit words cut out until none is hit (and n_chars, where there is one, set anew), without those of whose
    words more than max_coverage are hit. Where the items are more than one block, texts that were cut are looked at again as a
    table, which holds fewer each time."""
    names, k, text = docs.columns, len(docs.columns), place_of(docs, "text")
    n_chars = place_of(docs, "n_chars") if "n_chars" in {c.lower() for c in names} else None
    df, alone = _found_in(_with_hits(docs), benchmark, window, most, text, k, lambda block: _removed(text, n_chars, block, window, max_coverage))
    out = df if alone is not None else None
    while alone is None:
        first = out is None
        df = df.withColumn("_words", F.col("_n")).withColumn("_hit", F.lit(0).cast("bigint")) if first else df
        cut = written(df.mapInArrow(_removed(text, n_chars, None, window, max_coverage), df.schema), "cut")
        done = cut.where(F.size("_spans") == 0)
        out = done if first else out.unionByName(done)
        dirty = cut.where(F.size("_spans") > 0)
        if not dirty.limit(1).count():
            break
        plain = dirty.withColumns({"_spans": F.array().cast(SPANS), "_items": F.array().cast("array<string>")})
        df = _found_in(plain, benchmark, window, most, text, k)[0]
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _sql(window: int = WINDOW) -> str:
    """The report in DuckDB SQL: windows of items beside the same numbers of words of documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with items as (select cast(item_id as varchar) as item_id, {words} as w from benchmark),
windows as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as s from (select item_id, w, least(len(w), {window}) as m, unnest(range(1, len(w) - least(len(w), {window}) + 2)) as i from items where len(w) > 0)),
texts as (select row_number() over () as row, doc_id, {words} as w from documents),
places as (select row, m, i, array_to_string(w[i : i + m - 1], ' ') as s from (select row, w, m, unnest(range(1, len(w) - m + 2)) as i from texts, (select distinct m from windows))),
hits as (select p.row, p.i, p.m, x.item_id from places p join windows x on x.m = p.m and x.s = p.s),
covered as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + m)) as k from hits) group by row),
found as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct row, item_id from hits) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts t left join covered c on c.row = t.row left join found f on f.row = t.row
"""


SQL = _sql()
