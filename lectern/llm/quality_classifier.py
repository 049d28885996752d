"""Quality classifier from weak labels.

LABELLERS are heuristics that overlap: each calls a text good (1), bad (-1) or neither (0), or has
nothing to go by (2). How often each
pattern of calls occurs in all documents (at most 4 to the power of 9 patterns) is all that expectation-
maximisation needs to estimate, for good and for bad texts, how likely each labeller makes each call, and with
that a posterior for each pattern. The posteriors of a bounded sample train a hashed linear scorer: logistic
regression on words and word shapes, hashed to BUCKETS places. The sample is the FIT_TEXTS different texts, of any
length, whose hashes are smallest, as far as their features, which are made in the tasks from whole texts, come
to FIT_FEATURES. Every document is scored on its whole text; below CUT it is rejected. Where no text could be
sampled the posterior is the score.

No true labels are used. Nulls: a null text is empty; texts without words get no calls but the prior's
posterior, a score from the intercept alone, and stay (short texts are no junk by themselves). Null ids are
scored like others. Repeated rows each count. Empty tables give empty results. Further columns are not read,
except by filtered(), which keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, as_text, byte_table, columns_of, place_of, release, slices, tidy, written
from lectern.llm.decontamination import hashes

FIT_TEXTS, FIT_FEATURES = 5_000, 6_000_000
BUCKETS = 1 << 16
CUT = 0.5
MISSING = 2

TABLE = byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=True)
RAW = byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=False)
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in a is that for it as was with be by on not he at from der die und das nicht ein eine zu mit sich des auf für ist im dem le la les de des et un une dans que qui est pour du en el los las y por con para una del se no".split()
#: Characters that junk is full of.
SYMBOLS = b"#*$%&|<>"

#: name: (bad from here, good up to here), or the other way round where the first is smaller.
LABELLERS = {
    "symbols": (0.30, 0.02),  # symbol characters to a word
    "capitals": (0.50, 0.20),  # of letters
    "shouts": (0.20, 0.02),  # exclamation marks to a word
    "stutter": (0.20, 0.02),  # words that repeat the word before
    "variety": (0.25, 0.40),  # different words, of texts with 50 words or more
    "function": (0.01, 0.08),  # function words, of texts with 20 words or more
    "length": (16.0, 9.0),  # bytes of a word
    "plain": (0.60, 0.90),  # words of letters with at most one mark at the end
    "stops": (0.01, 0.04),  # words that end in one full stop, of texts with 30 words or more
}


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _again(words: Words, lower: np.ndarray) -> np.ndarray:
    """Whether each word is the one before it in its text."""
    again = np.append(False, lower[1:] == lower[:-1]) if len(lower) else np.zeros(0, bool)
    again[words.first[:-1][words.first[:-1] < len(again)]] = False
    return again


def measures(words: Words, lower: np.ndarray, raw: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text; nan: nothing to go by. raw: bytes as they came."""
    n = words.counts()
    some = np.maximum(1, n).astype(float)
    of = lambda table: _per_text(table[raw], words.off)
    table = lambda chars: np.isin(np.arange(256), list(chars))
    upper, letters = of(table(range(65, 91))), of(table([*range(65, 91), *range(97, 123)]))
    again = _again(words, lower)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((lower, text))
    fresh = np.append(True, (lower[order][1:] != lower[order][:-1]) | (text[order][1:] != text[order][:-1])) if len(lower) else np.zeros(0, bool)
    different = np.bincount(text[order][fresh], minlength=len(n)) if len(lower) else np.zeros(len(n))
    known = np.isin(lower, _function_hashes())
    odd = np.concatenate([[0], np.cumsum(_ODD[raw])])
    plain = odd[np.maximum(words.start, words.end - 1)] == odd[words.start]  # the last byte may be a mark
    stops = (raw[words.end - 1] == ord(".")) & plain if len(lower) else plain
    out = {
        "symbols": of(table(SYMBOLS)) / some,
        "capitals": np.where(letters > 0, upper / np.maximum(1, letters), np.nan),
        "shouts": of(table(b"!")) / some,
        "stutter": np.where(n >= 5, _per_text(again, words.first) / some, np.nan),
        "variety": np.where(n >= 50, different / some * np.sqrt(np.maximum(1, n / 200)), np.nan),
        "function": np.where(n >= 20, _per_text(known, words.first) / some, np.nan),
        "length": _per_bytes(words) / some,
        "plain": _per_text(plain, words.first) / some,
        "stops": np.where(n >= 30, _per_text(stops, words.first) / some, np.nan),
    }
    return {k: np.where(n > 0, v, np.nan) for k, v in out.items()}


#: Neither letter nor beyond ASCII.
_ODD = np.array([not (65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def _per_bytes(words: Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


_function: list[np.ndarray] = []


def _function_hashes() -> np.ndarray:
    if not _function:
        _function.append(np.unique(hashes(Words(as_text(pa.array([" ".join(FUNCTION_WORDS)])), TABLE))))
    return _function[0]


def calls(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row of -1, 0 and 1 for each text; MISSING where a labeller has nothing to go by, which is no evidence."""
    out = []
    for k, (bad, good) in LABELLERS.items():
        sign = 1 if bad > good else -1
        out.append(np.where(np.isnan(m[k]), MISSING, np.where(sign * m[k] >= sign * bad, -1, np.where(sign * m[k] <= sign * good, 1, 0))))
    return np.array(out, np.int8).T


def features(words: Words, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, weights and ends of each text's hashed features: words, and shapes of words with what stands before.
    A text's weights have length 1."""
    shape = Words.__new__(Words)
    shape.buf = words.buf.translate(_SHAPES)
    shape.start, shape.end, shape.first, shape.off = np.maximum(words.start, words.end - 6), words.end, words.first, words.off
    h = hashes(shape)
    again = _again(words, lower)
    with np.errstate(over="ignore"):
        h = h * np.uint64(3) + again.astype(np.uint64)
        place = np.concatenate([lower >> np.uint64(48), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)]).astype(np.int64) % BUCKETS
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    code, count = np.unique(np.concatenate([text, text]) * BUCKETS + place, return_counts=True)
    text, place = code // BUCKETS, code % BUCKETS
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(text, weight * weight, len(words.first) - 1))
    return place, weight / norm[text], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words.first) - 1))])


#: Letters, digits and bytes beyond ASCII each become one; capitals and signs stay apart.
_SHAPES = bytes(ord("a") if 97 <= b < 123 or b >= 128 else ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else b for b in range(256))


class Texts:
    """A slice of texts, read once."""

    def __init__(self, texts: pa.Array):
        self.raw = np.frombuffer(Words(texts, RAW).buf, np.uint8)
        self.words = Words(texts, RAW)
        low = Words(texts, TABLE)
        self.lower = hashes(low)
        self.calls = calls(measures(self.words, self.lower, self.raw))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return features(self.words, self.lower)


@dataclass
class Model:
    prior: float
    likely: np.ndarray  # labeller, good or bad, call + 1
    weights: np.ndarray | None = None
    bias: float = 0.0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text with these calls is good."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(np.log(np.append(self.likely[j], [[1.0], [1.0]], axis=1)[:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(log[:, 0] - log[:, 1]))

    def score(self, texts: Texts) -> np.ndarray:
        place, weight, ends = texts.features()
        sums = np.concatenate([[0], np.cumsum(self.weights[place] * weight)])
        return 1 / (1 + np.exp(-(sums[ends[1:]] - sums[ends[:-1]] + self.bias)))


def pattern_counts(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How many of all documents get each pattern of calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            rows, n = np.unique(Texts(as_text(batch.column("text"))).calls, axis=0, return_counts=True)
            found.update(dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["calls", "n"])

    rows = columns_of(docs, "text").mapInArrow(tidy(run), "calls array<int>, n bigint").groupBy("calls").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["calls"]): r["n"] for r in rows}


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> Model:
    """Accuracies from agreement alone; labellers start out as mostly right, which names the classes."""
    k = len(LABELLERS)
    right = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])  # bad and good texts; calls bad, none, good
    model = Model(0.8, np.repeat(right[None], k, axis=0))
    if not patterns:
        return model
    votes, n = np.array(list(patterns), np.int64), np.array(list(patterns.values()), float)
    for _ in range(rounds):
        good = model.posterior(votes)
        prior = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
        likely = np.empty_like(model.likely)
        for j in range(k):
            for y, p in enumerate((1 - good, good)):
                likely[j, y] = np.bincount(votes[:, j] + 1, p * n, 4)[:3] + 1.0
        likely /= likely.sum(axis=2, keepdims=True)
        done = abs(prior - model.prior) < 1e-9 and np.abs(likely - model.likely).max() < 1e-7
        model = Model(prior, likely)
        if done:
            break
    return model


def train(model: Model, place: np.ndarray, weight: np.ndarray, size: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.5, ridge: float = 1e-6) -> Model:
    """The linear scorer, on posteriors y as soft labels, by full gradients with Adam. place, weight: features of the
    texts one after another; size: how many each has. Without texts there is no scorer."""
    if not len(y):
        return model
    n, ends = len(y), np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n), np.diff(ends))
    w, b = np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean() + 1e-12) + 1e-12))
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[place] * weight, n) + b)))
        r = (p - y) / n
        g = np.append(np.bincount(place, weight * r[row], BUCKETS) + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 - step / (rounds + 1))
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def sampled_features(docs: DataFrame) -> DataFrame:
    """h, calls, place and weight of the sample: one row for each of the different texts with the smallest hashes."""
    texts = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    # the smallest hashes are found without the texts, and their texts read then
    least = texts.select("h").distinct().orderBy("h").limit(FIT_TEXTS).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in a task are passed over
        for batch in slices(batches):
            fresh = [h not in seen and not seen.add(h) for h in batch.column("h").to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            if not batch.num_rows:
                continue
            part = Texts(as_text(batch.column("text")))
            place, weight, ends = part.features()
            ends = pa.array(ends.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(part.calls.tolist(), pa.list_(pa.int32())), *lists], ["h", "calls", "place", "weight"])

    found = texts.where(F.col("h") <= F.lit(least)).mapInArrow(tidy(run), "h bigint, calls array<int>, place array<int>, weight array<float>")
    return found.groupBy("h").agg(*[F.first(c).alias(c) for c in ("calls", "place", "weight")])


def fit(docs: DataFrame) -> Model:
    plain = columns_of(docs, "doc_id", "text")
    model = expectation_maximisation(pattern_counts(plain))
    sample = written(sampled_features(plain), "sampled-features")
    sizes = sample.select("h", F.size("place").alias("n")).orderBy("h").collect()
    room = np.cumsum([0, *[r["n"] for r in sizes]])[:-1] < FIT_FEATURES
    rows = sample.where(F.col("h") <= F.lit(sizes[int(room.sum()) - 1]["h"] if sizes else None)).orderBy("h").toArrow().combine_chunks()
    flat = lambda c, kind: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    if rows.num_rows:
        votes = flat("calls", np.int64).reshape(-1, len(LABELLERS))
        size = np.array([r["n"] for r in sizes[: rows.num_rows]])
        model = train(model, flat("place", np.int64), flat("weight", float), size, model.posterior(votes))
    release()
    return model


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """docs, columns renamed c0, c1, ..., with _posterior, _score and _kept."""
    text = f"c{place_of(docs, 'text')}"
    df = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = Texts(as_text(batch.column(text)))
            good = shared.value.posterior(texts.calls.astype(np.int64))
            score = good if shared.value.weights is None else shared.value.score(texts)
            kept = (score >= CUT) | (texts.words.counts() == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good), pa.array(score), pa.array(kept)], [*batch.schema.names, "_posterior", "_score", "_kept"])

    more = df.select("*", F.lit(0.0).alias("_posterior"), F.lit(0.0).alias("_score"), F.lit(True).alias("_kept"))
    return df.mapInArrow(tidy(run), more.schema)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior of the labellers, score of the linear model, and kept."""
    plain = columns_of(docs, "doc_id", "text")
    return judged(plain, fit(plain)).select(F.col("c0").alias("doc_id"), F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_kept").alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return judged(docs, fit(docs)).where("_kept").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
