"""Language-model scoring of whole texts.

Words are lower-cased in A-Z; each text ends with an end token. A word is spelled by its subword ids, the last of
which is marked, so no word's spelling begins another's, and the score is that of a distribution over texts: the sum of
the log probabilities of all symbols, given those before. There is no floor and no mass kept for unknown words.

The model is causal self-attention (lectern.llm.attention) down to the symbol. Its output mixes PARTS distributions over
all symbols; part 0, inside a word only, is what the word's last two symbols lead to (trigrams by Witten and Bell, of
the learning rows' words). The attention says how much of each part, from CONTEXT symbols and more before. Counts of all
learning rows give the trigrams and the sum of each symbol over the parts. The GRAMS most frequent trigrams, bigrams and contexts (a fixed
bound) are sent to all workers. Where there are more, the rest stays a table: what texts need of it is found by a join on the gram
and goes to the tasks beside each text, so every gram counts, at every size. Those of the rest are rare in learning rows, so none is hot.

The attention, and how a symbol falls to the parts, are learnt from all learning texts, each whole and once. They begin with
pieces of some: of PIECE words, one for each PER words of a text and one at least, closer where that makes fewer than LEAST, and of
so many texts that it is about CHUNK pieces. One task trains on these several times. From there tasks go on, WORKERS or one for
each SHARE words where that is more, each on its share of all texts; their weights are averaged and their sums added up. So
tasks grow with the corpus, none holds more than a slice of its texts, and the driver none.

Words of all rows are counted in a table. The HEAD most frequent (a fixed bound) are sent to all workers; the others meet
their counts for the base in a join by word, once for each document that holds them. Frequency is that in all rows,
held out or not, so no word outside the head is in more than one in HEAD of the tokens, and none is hot. Words beyond LONG
bytes meet by their digest.

Nulls: a null text is empty and has the end token alone; a null id counts as the empty text for the fold.
Very long texts and words are scored whole. Repeated rows are scored each. Without learning rows nothing is known: the
base is then log10(0.1 / 0.1) = 0 for each token. Empty tables give empty results. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import attention
from lectern.llm.attention import CONTEXT, STRIDE, Attention, Training
from lectern.llm.common import Words, as_text, byte_table, columns_of, fold, ragged, slices, tidy, written
from lectern.llm.decontamination import hashes
from lectern.llm.tokens import encoder

HEAD, GRAMS = 400_000, 1_000_000
PIECE, PER, LEAST, CHUNK, WORKERS, SHARE = 18, 2_000, 40_000, 40_000, 16, 4_000_000
#: Words of a task in small tables, which have fewer than WORKERS.
FEW = 200_000
#: Steps on the first chunk.
STEPS = 1_000
#: Of the rate there, for the tasks that go on from it.
LATER_RATE = 0.1
#: Frequent symbols that the attention sees by themselves; the others share SHARED inputs.
SEEN, SHARED = 4096, 64
#: Different words, and grams, that a task counts before it passes them on.
FLUSH = 200_000
#: Bytes of a word that is a key by itself.
LONG = 64

TABLE = byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=True)
COUNTS = "word string, n bigint, m bigint"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts with their number in learning rows (n) and in all (m); the word '' stands for the ends."""
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("m", "sum")]).rename_columns(["word", "n", "m"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = pa.table({"word": t.column("word").cast(pa.large_string()).cast(pa.string()), "n": t.column("n"), "m": t.column("m")})
        yield from t.to_batches(max_chunksize=50_000)

    for batch in slices(batches):
        for learns in (True, False):
            part = batch.filter(pc.equal(batch.column("learns"), learns))
            if not part.num_rows:
                continue
            found = pc.value_counts(Words(as_text(part.column("text")), TABLE).array())
            word = pa.concat_arrays([found.field(0), pa.array([b""], pa.large_binary())])
            m = np.append(np.asarray(found.field(1)), part.num_rows)
            held.append(pa.table({"word": word, "n": m * int(learns), "m": m}))
            size += len(m)
        if size > FLUSH:
            held = [summed()]
            size = held[0].num_rows
            if size > FLUSH // 2:
                yield from out(held[0])
                held, size = [], 0
    if held:
        yield from out(summed())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n and m of the texts of docs (doc_id, text), as a written table."""
    rows = docs.select("text", (fold("doc_id", 10) != 0).alias("learns"))
    return written(rows.mapInArrow(tidy(count_words), COUNTS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "word-counts")


def least_frequent(df: DataFrame, by: str, most: int) -> int:
    """From which `by` on df has at most `most` rows: whole classes of about equal size, so that ties stay together."""
    bins = df.groupBy(F.floor(F.log2(by) * 8).alias("bin")).agg(F.count("*").alias("k"), F.min(by).alias("least")).orderBy(F.desc("bin")).collect()
    least, room = 1 << 62, most
    for b in bins:
        room -= b["k"]
        if room < 0:
            break
        least = b["least"]
    return least


def frequent(df: DataFrame, by: str, most: int) -> pa.Table:
    """At most `most` rows of df, those with the largest `by`."""
    return df.where(F.col(by) >= least_frequent(df, by, most)).toArrow().combine_chunks()


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of different words, one after another, where each word's begin and how many: 2 * id, and 1 more on the last."""
    e = encoder()
    ids, start, length = e.segments(words.cast(pa.large_string()).to_pylist())
    symbols = ids.astype(np.int64) * 2
    symbols[(start + length)[length > 0] - 1] += 1
    return symbols, start, length


def symbols_in_all() -> int:
    """Marked and unmarked ids, and the end, which is the last symbol."""
    return 2 * len(encoder().size) + 1


# ---------------------------------------------------------------- what words are spelled like


def in_words(symbols: np.ndarray, begins: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each one in its word, and the one before that; the end where there is none."""
    end = kind - 1
    one, two = np.full(len(symbols), end), np.full(len(symbols), end)
    one[1:] = np.where(begins[1:], end, symbols[:-1])
    two[1:] = np.where(begins[1:], end, one[:-1])
    return two, one


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, gram (symbols as digits of one number) and n, of words with their numbers."""
    kind = symbols_in_all()
    held: list[dict[str, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        for size in (1, 2, 3):
            keys, at = np.unique(np.concatenate([h[size][0] for h in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([h[size][1] for h in held])).astype(np.int64)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size, np.int32)), pa.array(k), pa.array(n[i : i + 50_000])], ["size", "gram", "n"])

    for batch in batches:
        words, n = batch.column("word"), np.asarray(batch.column("n"))
        some = np.asarray(pc.not_equal(words, ""))
        pool, start, length = spelled(words.filter(pa.array(some)))
        x, weight = np.append(pool[ragged(start, length)], kind - 1), np.append(np.repeat(n[some], length), n[~some].sum())
        begins = np.zeros(len(x), bool)
        begins[np.append(np.cumsum(length) - length, len(x) - 1)] = True
        two, one = in_words(x, begins, kind)
        part = {}
        for size, key in ((1, x), (2, one * kind + x), (3, (two * kind + one) * kind + x)):
            keys, at = np.unique(key, return_inverse=True)
            part[size] = (keys, np.bincount(at, weight))
        held.append(part)
        if sum(len(h[3][0]) for h in held) > FLUSH:
            yield from out()
            held = []
    if held:
        yield from out()


#: Of a gram's size the number that stands for its contexts in the table of the rest.
AROUND = 2
REST = "what int, gram bigint, n bigint, kinds bigint"


class Spelling:
    """Probability of a symbol after the two before it in its word: trigrams interpolated with bigrams and those with
    single symbols, by the number of different symbols seen after a context (Witten and Bell).

    It holds the frequent grams and contexts; partial says of which sizes (plus AROUND for contexts) there are others, more has some of these."""

    def __init__(self, kind: int, single: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None, partial: tuple[int, ...] = ()):
        """single: count of each symbol; grams: keys and counts for sizes 2 and 3; contexts: keys, sums and numbers of different
        symbols after them, else those of the grams."""
        self.kind, self.single, self.total, self.kinds = kind, single, single.sum(), (single > 0).sum()
        self.partial, self.more, self.grams = partial, {}, {}
        for size, (keys, n) in grams.items():
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(float)
            if contexts is None:
                context = keys // kind
                edge = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
                around, sums, kinds = context[edge], np.add.reduceat(n, edge) if len(edge) else n, np.diff(np.append(edge, len(keys)))
            else:
                order = np.argsort(contexts[size][0])
                around, sums, kinds = (x[order] for x in contexts[size])
            # a last row that no key has, for what isn't found
            self.grams[size] = (np.append(keys, -1), np.append(n, 0), around, np.append(sums, 0).astype(float), np.append(kinds, 0))

    def with_more(self, rows: pa.StructArray | pa.Table) -> Spelling:
        """This with some rows of the rest."""
        out = copy(self)
        what, gram, n, kinds = (np.asarray(rows.field(c) if isinstance(rows, pa.StructArray) else rows.column(c)) for c in ("what", "gram", "n", "kinds"))
        out.more = {}
        for w in self.partial:
            at = np.flatnonzero(what == w)
            keys, first = np.unique(gram[at], return_index=True)
            out.more[w] = (np.append(keys, -1), np.append(n[at][first], 0), np.append(kinds[at][first], 0))
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(keys[:n], wanted)
        return np.where((at < n) & (keys[np.minimum(at, max(0, n - 1))] == wanted), at, n) if n else np.zeros(len(wanted), np.int64)

    def _seen(self, size: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often grams were seen, and their contexts, and how many different symbols after these."""
        keys, count, contexts, sums, kinds = self.grams[size]
        n, at = count[self._find(keys, key, len(keys) - 1)], self._find(contexts, key // self.kind, len(contexts))
        total, different = sums[at], kinds[at]
        if size in self.more:  # a gram is in one of the two
            keys, count, _ = self.more[size]
            n = n + count[self._find(keys, key, len(keys) - 1)]
        if size + AROUND in self.more:
            keys, sums, kinds = self.more[size + AROUND]
            at = self._find(keys, key // self.kind, len(keys) - 1)
            total, different = total + sums[at], different + kinds[at]
        return n, total, different

    def probability(self, two: np.ndarray, one: np.ndarray, x: np.ndarray, left_out: bool = False) -> np.ndarray:
        """left_out: as if this one place had not been counted."""
        less = 1 if left_out else 0
        n = np.maximum(0, self.single[x] - less)
        q = (n + self.kinds / self.kind) / (max(0, self.total - less) + self.kinds)
        for size, key in ((2, one * self.kind + x), (3, (two * self.kind + one) * self.kind + x)):
            n, total, different = self._seen(size, key)
            if left_out:
                total, different, n = total - (n > 0), different - (n == 1), np.maximum(0, n - 1)
            q = np.where(total + different > 0, (n + different * q) / np.maximum(1, total + different), q)
        return q

    def missing(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams and contexts of symbols that may be in the rest: the place, what and gram of each, by place. begins: as for inside."""
        starts = np.zeros(len(symbols), bool)
        starts[begins] = True
        two, one = in_words(symbols, starts, self.kind)
        rest = np.flatnonzero(~starts)
        two, one, x = two[rest].astype(np.int64), one[rest].astype(np.int64), symbols[rest].astype(np.int64)
        found = [(np.zeros(0, np.int64),) * 3]
        for size, key in ((2, one * self.kind + x), (3, (two * self.kind + one) * self.kind + x)):
            keys, _, contexts, _, _ = self.grams[size]
            for what, have, wanted in ((size, keys[:-1], key), (size + AROUND, contexts, key // self.kind)):
                if what in self.partial:
                    at = np.flatnonzero(self._find(have, wanted, len(have)) == len(have))
                    found.append((rest[at], np.full(len(at), what), wanted[at]))
        place, what, gram = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], what[order], gram[order]

    def inside(self, symbols: np.ndarray, begins: np.ndarray, left_out: bool = False) -> np.ndarray:
        """The probability of each symbol after those before it in its word; 0 where a word begins. begins: these places."""
        starts = np.zeros(len(symbols), bool)
        starts[begins] = True
        two, one = in_words(symbols, starts, self.kind)
        found, rest = np.zeros(len(symbols), np.float32), ~starts
        found[rest] = self.probability(two[rest], one[rest], symbols[rest].astype(np.int64), left_out)
        return found


# ---------------------------------------------------------------- the model


def hashed(words: pa.Array) -> np.ndarray:
    """A number for each word; different words may have the same."""
    plain = pa.concat_arrays([words.cast(pa.large_binary())])
    at = np.frombuffer(plain.buffers()[1], np.int64)[: len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    spans, raw = Words.__new__(Words), plain.buffers()[2] if len(plain) else None
    spans.buf = memoryview(raw)[: at[-1]].tobytes() if raw is not None else b""
    spans.start, spans.end = at[:-1], at[1:]
    return hashes(spans)


@dataclass
class Head:
    """Frequent words, their counts in learning rows, and how they are spelled."""

    words: pa.Array
    n: np.ndarray
    pool: np.ndarray  # their symbols, one word after another
    start: np.ndarray
    length: np.ndarray
    given: np.ndarray | None = None  # part 0 of each symbol of the pool

    def __post_init__(self):
        keys = hashed(self.words)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    @staticmethod
    def of(table: pa.Table) -> Head:
        words = table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.string())
        pool, start, length = spelled(words)
        return Head(words.cast(pa.large_binary()), table.column("n").to_numpy(), pool.astype(np.int32), start.astype(np.int32), length.astype(np.int32))

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where it is none of these."""
        out = np.full(len(words), -1)
        if not len(self.words) or not len(words):
            return out
        words = words.cast(pa.large_binary())
        keys = hashed(words)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        some = np.flatnonzero(self.keys[at] == keys)
        place = self.order[at[some]]
        same = np.asarray(pc.equal(self.words.take(pa.array(place)), words.take(pa.array(some))))
        out[some[same]] = place[same]
        return out


@dataclass
class Model:
    attention: Attention
    spelling: Spelling
    inputs: np.ndarray  # number that the attention sees for each symbol
    table: np.ndarray  # probability of each symbol in each part; part 0 is not used
    head: Head
    total: int  # learning tokens
    kinds: int  # different ones
    ends: int
    rest: DataFrame | None = None  # the grams and contexts that spelling doesn't hold; stays in the driver

    @property
    def norm(self) -> float:
        return self.total + 0.1 * (self.kinds + 1)

    def spell(self, x: Symbols, spelling: Spelling | None = None) -> np.ndarray:
        """The natural log probability of each token. spelling: with what the texts need of the rest."""
        lp = self.attention.log_probability(x.before(self.inputs), x.symbols, x.given(spelling or self.spelling), self.table, x.at[x.first])
        return np.add.reduceat(lp.astype(np.float64), x.at[:-1])


class Symbols:
    """The texts of a slice as symbols. different: its words; tokens: each token's number among them (one more: an end);
    known: their places in the head; at: where each token's symbols begin, and the end; first: which token each text
    begins with, and the end."""

    def __init__(self, words: Words, head: Head | None = None):
        coded = words.array().dictionary_encode()
        self.different, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        self.known = np.full(len(self.different), -1) if head is None else head.find(self.different)
        new = np.flatnonzero(self.known < 0)
        self.pool, start, length = np.zeros(0, np.int32), np.zeros(len(self.known), np.int64), np.zeros(len(self.known), np.int64)
        self.old, self.head = 0, head  # how many symbols of the pool are the head's
        if len(new) < len(self.known):
            self.pool, self.old, at = head.pool, len(head.pool), np.flatnonzero(self.known >= 0)
            start[at], length[at] = head.start[self.known[at]], head.length[self.known[at]]
        pool, start[new], length[new] = spelled(self.different.take(pa.array(new)))
        start[new] += self.old
        self.fresh = np.append(pool, symbols_in_all() - 1).astype(np.int32)  # the new words', then an end
        self.begins = np.append(start[new] - self.old, len(pool))
        self.pool = np.concatenate([self.pool, self.fresh])
        self.tokens = np.insert(codes, words.first[1:], len(start))  # each text's words, then an end
        self.first = words.first + np.arange(len(words.first))
        start, length = np.append(start, len(self.pool) - 1), np.append(length, 1)
        size = length[self.tokens]
        self.places = ragged(start[self.tokens], size)
        self.symbols = self.pool[self.places]
        self.at = np.concatenate([[0], np.cumsum(size)])

    def before(self, inputs: np.ndarray) -> np.ndarray:
        """What the attention sees before each symbol; a text follows an end."""
        out = np.empty(len(self.symbols), np.int32)
        out[1:] = inputs[self.symbols[:-1]]
        out[self.at[self.first[:-1]]] = inputs[-1]
        return out

    def teach(self, training: Training, inputs: np.ndarray, spelling: Spelling) -> None:
        training.on(self.before(inputs), self.symbols, self.given(spelling, left_out=True), *attention.windows(self.at[self.first]))

    def given(self, spelling: Spelling, left_out: bool = False) -> np.ndarray:
        """Part 0 of each symbol, worked out once for each different word. left_out: as in Spelling; the head's is as it has it."""
        new = spelling.inside(self.fresh, self.begins, left_out)
        return (np.concatenate([self.head.given, new]) if self.old else new)[self.places]


ASKED = "h bigint, what int, gram bigint"


def asked(h: np.ndarray, what: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(what.astype(np.int32)), pa.array(gram.astype(np.int64))], ["h", "what", "gram"])


def _asks(shared):
    """A task that says what texts need of the rest: h, and what and gram of each, once for each word of a text that the head lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, head = shared.value
        for batch in slices(batches, most=1_200_000):
            x = Symbols(Words(as_text(batch.column("text")), TABLE), head)
            place, what, gram = spelling.missing(x.fresh, x.begins)
            many = np.bincount(np.searchsorted(x.begins, place, "right") - 1, minlength=len(x.begins))  # by new word
            new = np.full(len(x.different) + 1, len(many) - 1)  # of each word its number among the new ones; the end is the last, which needs nothing
            new[np.flatnonzero(x.known < 0)] = np.arange(len(many) - 1)
            word, text = new[x.tokens], np.repeat(np.arange(batch.num_rows), np.diff(x.first))
            needs = (many[word] > 0) & (word < len(many) - 1)
            text, word = np.divmod(np.unique(text[needs] * len(many) + word[needs]), len(many))
            at = ragged((np.cumsum(many) - many)[word], many[word])
            yield asked(np.repeat(np.asarray(batch.column("h"))[text], many[word]), what[at], gram[at])

    return run


def _asks_pieces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = Chunk(pa.Table.from_batches([batch]))
                _, what, gram = shared.value.missing(c.symbols, np.flatnonzero(c.starts))
                yield asked(np.zeros(len(what)), what, gram)

    return run


def needed(asks: DataFrame, rest: DataFrame) -> pa.Table:
    """The rows of the rest that are asked for, whoever asks; bounded by the places of the head or the first chunk."""
    return rest.join(asks.select("what", "gram").distinct(), ["what", "gram"], "left_semi").select("what", "gram", "n", "kinds").toArrow().combine_chunks()


def needed_by_text(rows: DataFrame, model: Model) -> DataFrame:
    """h of texts (h, text) and `more`, the rows of the rest that they need, as a written table."""
    asks = rows.select("h", "text").mapInArrow(tidy(_asks(rows.sparkSession.sparkContext.broadcast((model.spelling, model.head)))), ASKED)
    found = asks.join(model.rest, ["what", "gram"]).groupBy("h").agg(F.collect_set(F.struct("what", "gram", "n", "kinds")).alias("more"))
    return written(found, "rest-by-text")


def spelling_for(spelling: Spelling, batch: pa.RecordBatch) -> Spelling:
    """spelling with what the texts of a batch need of the rest, if there is one."""
    return spelling.with_more(batch.column("more").flatten()) if batch.schema.get_field_index("more") >= 0 else spelling


PIECES = "h bigint, opens boolean, closes boolean, skip int, symbols array<int>"


def cut_pieces(batches: Iterator[pa.RecordBatch], per: int = PER) -> Iterator[pa.RecordBatch]:
    """Pieces of each text, one from each equal part of it, with words before it as context. skip: symbols of these."""
    for batch in slices(batches):
        words = Words(as_text(batch.column("text")), TABLE)
        n, h = words.counts(), np.asarray(batch.column("h")).view(np.uint64)
        many = 1 + n // per
        text = np.repeat(np.arange(len(n)), many)
        part = ragged(np.zeros(len(n), np.int64), many)
        with np.errstate(over="ignore"):
            h = (h[text] + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        low, high = part * n[text] // many[text], (part + 1) * n[text] // many[text]
        begin = low + ((h >> np.uint64(11)).astype(float) * 2.0**-53 * (high - low)).astype(np.int64)
        seen, end = np.maximum(0, begin - CONTEXT), np.minimum(n[text], begin + PIECE)
        at_word = ragged(words.first[:-1][text] + seen, end - seen)
        piece = Words.__new__(Words)
        piece.buf, piece.start, piece.end = words.buf, words.start[at_word], words.end[at_word]
        piece.first = np.concatenate([[0], np.cumsum(end - seen)])
        x = Symbols(piece)
        skip = x.at[x.first[:-1] + begin - seen] - x.at[x.first[:-1]]
        symbols = pa.ListArray.from_arrays(pa.array(x.at[x.first].astype(np.int32)), pa.array(x.symbols.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seen == 0), pa.array(end == n[text]), pa.array(skip.astype(np.int32)), symbols], [c.split()[0] for c in PIECES.split(", ")])


class Chunk:
    """Pieces as sequences of symbols: begin of each and the end, and where each one's scored part begins. A piece's end token
    stays only where its text ends."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("h").combine_chunks()
        flat = lambda c: rows.column(c).combine_chunks()
        ends, whole = np.cumsum(np.asarray(pc.list_value_length(flat("symbols")), np.int64)), flat("symbols").flatten().to_numpy()
        closes = flat("closes").to_numpy(zero_copy_only=False)
        self.skip = flat("skip").to_numpy().astype(np.int64)
        keep = np.ones(len(whole), bool)
        keep[ends[~closes] - 1] = False
        self.symbols = whole[keep]
        self.begin = np.concatenate([[0], ends - np.cumsum(~closes)])
        self.end = symbols_in_all() - 1
        self.starts = np.append(True, (self.symbols[:-1] % 2 == 1) | (self.symbols[:-1] == self.end)) if len(self.symbols) else np.zeros(0, bool)
        self.starts[self.begin[:-1][self.begin[:-1] < len(self.starts)]] = True

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As attention.windows, of the scored parts: what stands before one is seen as context."""
        scored = self.begin[:-1] + self.skip
        size = self.begin[1:] - scored
        begin, count, before = attention.windows(np.concatenate([[0], np.cumsum(size)]))
        of = np.repeat(np.arange(len(size)), -(-size // STRIDE))
        shift = scored - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else scored
        begin = begin + shift[of]
        return begin, count, np.minimum(CONTEXT, begin - self.begin[:-1][of])

    def seen(self, inputs: np.ndarray) -> np.ndarray:
        """What stands before each symbol; an end before a text's first."""
        before = np.empty(len(self.symbols), np.int64)
        before[1:] = inputs[self.symbols[:-1]]
        before[self.begin[:-1][self.begin[:-1] < len(before)]] = inputs[-1]
        return before

    def given(self, spelling: Spelling) -> np.ndarray:
        """As Symbols.given; each place is among the counts, so it is left out of them."""
        cuts = [*self.begin[:-1:5_000].tolist(), int(self.begin[-1])]  # some pieces at a time, as this takes room
        parts = [spelling.inside(self.symbols[a:b], np.flatnonzero(self.starts[a:b]), left_out=True) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def teach(self, training: Training, inputs: np.ndarray, spelling: Spelling) -> None:
        training.on(self.seen(inputs), self.symbols, self.given(spelling), *self.windows())


def first_parts(c: Chunk, common: np.ndarray, rounds: int = 15, words: int = 300, most: int = 10_000) -> np.ndarray:
    """Sums by symbol and part to begin with: pieces (`most` of them, in the order of a hash) are clustered by their frequent symbols
    (k-means), and the symbols that begin words counted by cluster."""
    pieces, k, kinds = min(most, len(c.begin) - 1), attention.PARTS - 1, len(common)
    symbols, starts = c.symbols[: c.begin[pieces]], c.starts[: c.begin[pieces]]
    often = np.argsort(-np.bincount(symbols, minlength=kinds)[:-1], kind="stable")[:words]
    place = np.full(kinds, -1)
    place[often] = np.arange(len(often))
    piece, seen = np.repeat(np.arange(pieces), np.diff(c.begin[: pieces + 1])), place[symbols] >= 0
    x = np.bincount(piece[seen] * len(often) + place[symbols[seen]], minlength=pieces * len(often)).reshape(pieces, -1).astype(np.float32)
    x = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
    middle, far = x[:1], np.full(pieces, np.inf)
    while len(middle) < k:  # begin with pieces far apart
        far = np.minimum(far, ((x - middle[-1]) ** 2).sum(1))
        middle = np.vstack([middle, x[far.argmax()]])
    for _ in range(rounds):
        to = ((middle**2).sum(1) - 2 * x @ middle.T).argmin(1)
        middle = np.array([x[to == j].mean(0) if (to == j).any() else middle[j] for j in range(k)])
    sums = np.repeat(5 * common[:, None], k + 1, axis=1)
    of = to[piece[starts]] + 1
    for j in range(1, k + 1):
        sums[:, j] += np.bincount(symbols[starts][of == j], minlength=kinds)
    return sums / sums.sum(0) * Training.BATCH * STRIDE


LEARNT = "symbol bigint, sums array<float>, weights binary"


def _learns(shared, begins: bool):
    """A task that trains: its weights, and its sums by symbol. One begins, on pieces that it takes several times; the others
    go on from there, each text of theirs once, and leave the table as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, common = shared.value
        net = pickle.loads(pickle.dumps(model.attention))
        if begins:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            c = Chunk(pa.Table.from_batches(held))
            steps = -(-len(c.windows()[0]) // Training.BATCH)
            rounds = max(1, -(-STEPS // max(1, steps)))
            training = Training(net, first_parts(c, common) if len(c.begin) > 2 * attention.PARTS else sums, common, rounds * steps + 1)
            for _ in range(rounds):
                c.teach(training, model.inputs, model.spelling)
            training.sums *= len(c.symbols) / training.sums.sum()
        else:
            training = Training(net, sums, common, 1 << 40, LATER_RATE * 0.01, fixed=True)
            for batch in slices(batches):
                Symbols(Words(as_text(batch.column("text")), TABLE), model.head).teach(training, model.inputs, spelling_for(model.spelling, batch))
        if not training.step:
            return
        at = np.flatnonzero(training.sums.any(axis=1))
        for i in range(0, len(at), 10_000):
            part = training.sums[at[i : i + 10_000]]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 10_000]), rows, pa.nulls(len(part), pa.binary())], ["symbol", "sums", "weights"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.float32())), pa.array([pickle.dumps(net.w)], pa.binary())], ["symbol", "sums", "weights"])

    return run


def _taken(out: DataFrame, model: Model, sums: np.ndarray) -> None:
    """The mean of the tasks' weights becomes the model's, and their sums are added up."""
    weights, n = None, 0
    for (w,) in out.where("weights is not null").select("weights").toLocalIterator():  # one for each task
        w, n = pickle.loads(bytes(w)), n + 1
        weights = w if weights is None else {k: v + w[k] for k, v in weights.items()}
    if n:
        model.attention.w = {k: (v / n).astype(np.float32) for k, v in weights.items()}
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(attention.PARTS)]
    found = out.where("symbol is not null").groupBy("symbol").agg(*parts).toArrow()  # at most one row for each symbol
    if found.num_rows:
        sums[found.column("symbol").to_numpy()] += np.column_stack([found.column(f"s{i}").to_numpy() for i in range(attention.PARTS)])


def _spelling(grams: DataFrame, kind: int, single: np.ndarray) -> tuple[Spelling, DataFrame | None]:
    """The spelling of grams (size, gram, n) with the GRAMS most frequent of each size, and contexts; and the rest, if there is one."""
    sizes = {s: grams.where(F.col("size") == s) for s in (2, 3)}
    many = {r[0]: r[1] for r in grams.groupBy("size").count().collect()}
    if all(many.get(s, 0) <= GRAMS for s in sizes):
        top = {s: df.toArrow() for s, df in sizes.items()}
        return Spelling(kind, single, {s: (t.column("gram").to_numpy(), t.column("n").to_numpy()) for s, t in top.items()}), None
    around = written(grams.where("size > 1").groupBy("size", F.expr(f"gram div {kind}").alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "contexts")
    sizes = {s: df.withColumn("kinds", F.lit(0).cast("bigint")) for s, df in sizes.items()} | {s + AROUND: around.where(F.col("size") == s) for s in sizes}
    top, rest = {}, None
    for what, df in sizes.items():
        least = least_frequent(df, "n", GRAMS)
        t = df.where(F.col("n") >= least).toArrow()
        top[what] = tuple(t.column(c).to_numpy() for c in ("gram", "n", "kinds"))
        others = df.where(F.col("n") < least).select(F.lit(what).alias("what"), "gram", "n", "kinds")
        rest = others if rest is None else rest.unionByName(others)
    return Spelling(kind, single, {s: top[s][:2] for s in (2, 3)}, {s: top[s + AROUND] for s in (2, 3)}, tuple(sizes)), written(rest, "rest")


def fit(counts: DataFrame, learn: DataFrame) -> Model:
    """counts: of word_counts; learn: doc_id and text of the learning rows."""
    spark, kind = counts.sparkSession, symbols_in_all()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    least = least_frequent(counts.where("word <> ''"), "m", HEAD)
    head = Head.of(counts.where("word <> ''").where(F.col("m") >= least).toArrow().combine_chunks())
    ends = (counts.where("word = ''").first() or ("", 0))[1]

    grams = written(counts.where("n > 0").select("word", "n").mapInArrow(tidy(gram_counts), "size int, gram bigint, n bigint").groupBy("size", "gram").agg(F.sum("n").alias("n")), "grams")
    by_size = grams.where("size = 1").toArrow()  # at most one row for each symbol
    single = np.zeros(kind)
    single[by_size.column("gram").to_numpy()] = by_size.column("n").to_numpy()
    spelling, rest = _spelling(grams, kind, single)

    order = np.argsort(-single[:-1], kind="stable")
    inputs = SEEN + np.arange(kind, dtype=np.int32) % SHARED
    inputs[order[:SEEN]] = np.arange(SEEN)
    inputs[-1] = SEEN + SHARED
    common = (single + 0.5) / (single + 0.5).sum()
    net = Attention(SEEN + SHARED + 1)
    model = Model(net, spelling, inputs, np.zeros(0), head, total, kinds, ends, rest)
    for_head = spelling
    if rest is not None:
        words = counts.where("word <> ''").where(F.col("m") >= least).select(F.lit(0).cast("bigint").alias("h"), F.col("word").alias("text"))
        for_head = spelling.with_more(needed(words.mapInArrow(tidy(_asks(spark.sparkContext.broadcast((spelling, None)))), ASKED), rest))
    head.given = for_head.inside(head.pool, head.start)
    sums = learnt(spark, model, learn, common, for_head)
    share = sums / sums.sum(1, keepdims=True)
    table = share * (single + 0.05)[:, None]
    model.table = (table / table.sum(0)).astype(np.float32)
    return model


def learnt(spark, model: Model, learn: DataFrame, common: np.ndarray, for_head: Spelling) -> np.ndarray:
    """Trains the model's attention; returns what each part had of each symbol. for_head: the spelling, with what the head needs of the rest."""
    rows = learn.select("text", F.xxhash64("doc_id", "text").alias("h"))
    sums = np.repeat(common[:, None], attention.PARTS, axis=1) * Training.BATCH * STRIDE
    per = max(PIECE, min(PER, model.total // LEAST))
    many = max(1, (model.ends + model.total // per) // CHUNK)
    some, wire = rows.where(F.pmod("h", F.lit(many)) == 0), spark.sparkContext.broadcast
    plain = some.mapInArrow(tidy(lambda batches: cut_pieces(batches, per)), PIECES)
    bare = Model(model.attention, model.spelling, model.inputs, np.zeros(0), None, 0, 0, 0)  # what training needs
    first = bare
    if model.rest is not None:
        plain = written(plain, "pieces")
        first = replace(bare, spelling=bare.spelling.with_more(needed(plain.mapInArrow(tidy(_asks_pieces(wire(bare.spelling))), ASKED), model.rest)))
    _taken(written(plain.repartition(1).mapInArrow(tidy(_learns(wire((first, sums, common)), True)), LEARNT), "learnt"), bare, found := np.zeros_like(sums))
    found = found if found.any() else sums
    bare.head = replace(model.head, given=for_head.inside(model.head.pool, model.head.start, left_out=True))
    tasks = max(min(WORKERS, 1 + model.total // FEW), model.total // SHARE)
    if model.rest is None:
        shares = rows.repartition(tasks, "h", "text")
    else:
        shares = rows.repartition(tasks, "h").join(needed_by_text(rows, model).repartition(tasks, "h"), "h", "left")
    shares = shares.sortWithinPartitions("h")
    _taken(written(shares.mapInArrow(tidy(_learns(wire((bare, found.astype(np.float32), common)), False)), LEARNT), "learnt"), bare, found)
    return found


# ---------------------------------------------------------------- scoring


def as_keys(words: pa.Array) -> pa.Array:
    """Words as they are, but those beyond LONG bytes as a blank and their digest."""
    out = words.cast(pa.large_binary())
    long = np.flatnonzero(np.asarray(pc.binary_length(out)) > LONG)
    if len(long):
        plain = out.to_pylist()
        for i in long.tolist():
            plain[i] = b" " + hashlib.sha256(plain[i]).hexdigest().encode()
        out = pa.array(plain, pa.large_binary())
    return out.cast(pa.large_string()).cast(pa.string())


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, words array<string>, times array<int>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, model = TaskContext.get().partitionId() << 33, shared.value
        for batch in slices(batches, most=1_200_000):
            x = Symbols(Words(as_text(batch.column("text")), TABLE), model.head)
            lp = model.spell(x, spelling_for(model.spelling, batch))
            each = np.append(model.head.n, [model.ends, -1])[np.append(x.known, len(model.head.n))]  # -1 where not in the head
            base = np.where(each >= 0, np.log10((np.maximum(each, 0) + 0.1) / model.norm), 0)[x.tokens]
            n = each[x.tokens]
            per = lambda v: np.add.reduceat(v, x.first[:-1])  # noqa: E731  every text has a token
            k, rare = batch.num_rows, np.flatnonzero(n < 0)
            of, times = np.unique((np.searchsorted(x.first, rare, "right") - 1) * (len(x.different) + 1) + x.tokens[rare], return_counts=True)
            offsets = pa.array(np.searchsorted(of // (len(x.different) + 1), np.arange(k + 1)).astype(np.int32))
            wanted, codes = np.unique(of % (len(x.different) + 1), return_inverse=True)
            names = as_keys(x.different.take(pa.array(wanted))).take(pa.array(codes))
            lists = [pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(x.first)), pa.array(per((n > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(lp) / np.log(10)), *lists], [c.split()[0] for c in SCORED.split(", ")])
            row += k

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold("doc_id", 10) == 0).alias("held_out"))
    if model.rest is not None:
        rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
        rows = rows.join(needed_by_text(rows, model), "h", "left")
    table = written(rows.mapInArrow(tidy(_score(spark.sparkContext.broadcast(replace(model, rest=None)))), SCORED), "scored")
    rare = table.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
    long = F.octet_length("word") > LONG
    keyed = counts.where("n > 0").select(F.when(long, F.concat(F.lit(" "), F.sha2(F.col("word").cast("binary"), 256))).otherwise(F.col("word")).alias("word"), "n")
    n = F.coalesce("n", F.lit(0))
    sums = rare.join(keyed, "word", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(model.norm))).alias("b"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = table.drop("words", "times").join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(model.total).cast("bigint").alias("train_tokens"), plus("base", "b").alias("base_score"), "score")


def scored(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out tenth and scores all."""
    plain = columns_of(docs, "doc_id", "text")
    learn = plain.where(fold("doc_id", 10) != 0).withColumn("text", F.coalesce("text", F.lit("")))
    counts = word_counts(plain)
    return score(docs, fit(counts, learn), counts)
