"""Toxicity by compression distance.

Two zstandard dictionaries: ORDINARY_BYTES of windows of ordinary texts, and one trained on what sets toxic
texts apart: words that hold a 5- to 7-gram found in too many toxic texts for chance and RATIO times as dense
there as in ordinary ones. A window's gain is its compressed length under the ordinary
dictionary less that under both together, so what any text holds gains nothing. Of a text count the largest
gains and the windows at or above each of THRESHOLDS; a logistic model, fitted to labelled texts that the
dictionaries did not see, turns them into the score. Where labels are too few for any word to stand out, the dictionary is trained
on the windows of whole toxic texts.

Only the fit uses labels: at most FIT_TOXIC and FIT_ORDINARY labelled texts (smallest hash of doc_id first; equal texts once, one
text for each id), of rows outside the held-out fold. A text of more than FIT_CHARS characters is learnt from by FIT_PARTS parts that
lie evenly over it. Every whole text, however long, is scored. Labels, language, source and id are no inputs of a score.

Nulls: a null text is an empty one; a null id is scored and never learnt from; null labels are no labels.
Repeated labels of a document count as 1 if any is 1; of several texts of a labelled id that with the smallest hash is learnt
from. With fewer than three labels of either kind every score is the share of toxic ones (0 without any). Empty tables give empty
results. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, columns_of, fold, slices, tidy

FIT_TOXIC, FIT_ORDINARY, FIT_CHARS, FIT_PARTS = 3_000, 5_000, 20_000, 20
WINDOW, STEP = 64, 48
ORDINARY_BYTES, TOXIC_BYTES = 320_000, 16_384
GRAMS = (5, 6, 7)
#: Standard deviations beyond chance in the number of texts that hold an n-gram, and times its density in ordinary texts.
CHANCE, RATIO = 4.5, 25
THRESHOLDS = (2, 3, 4, 5, 6, 8)
CUT = 0.7

_GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal(text: str | bytes | None) -> bytes:
    """Lower-cased (A-Z) runs of letters, one blank before, between and after."""
    raw = text.encode() if isinstance(text, str) else (text or b"")
    return b" " + _GAP.sub(b" ", raw.translate(_LOWER)).strip() + b" "


def windows(b: bytes) -> list[bytes]:
    """Overlapping windows that cover all of b."""
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - WINDOW + STEP), STEP)]


def grams(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the different n-grams of b (n is at most 8), and how often each occurs."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(a) - n + 1), np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | a[i : i + len(code)]
    return np.unique(code, return_counts=True)


def telling(toxic: list[bytes], ordinary: list[bytes], n: int) -> set[int]:
    """n-grams that set toxic texts apart: more texts hold them than chance gives, and they are far denser there."""
    parts = [grams(b, n) for b in toxic]
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    held = np.bincount(at)
    often = np.bincount(at, np.concatenate([k for _, k in parts]))
    code, held, often = (x[held >= 4] for x in (code, held, often))
    held_o, often_o = np.zeros(len(code)), np.zeros(len(code))
    for b in ordinary:
        c, k = grams(b, n)
        if len(c) and len(code):
            i = np.minimum(np.searchsorted(c, code), len(c) - 1)
            hit = c[i] == code
            held_o += hit
            often_o += np.where(hit, k[i], 0)
    share = len(toxic) / (len(toxic) + len(ordinary))
    total = held + held_o
    chance = (held - share * total) / np.sqrt(total * share * (1 - share) + 1e-9)
    size, size_o = sum(map(len, toxic)), sum(map(len, ordinary))
    keep = (chance >= CHANCE) & (often / size >= RATIO * (often_o + 0.5) / size_o)
    return set(code[keep].tolist())


@dataclass
class Model:
    """Dictionaries and the logistic model; rate alone where there was nothing to learn from."""

    rate: float
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None


def _compressor(content: bytes):
    """zstandard without frame extras; three-byte matches, as words are short."""
    plain = zstandard.ZstdCompressionParameters(window_log=20, chain_log=18, hash_log=17, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=plain).compress


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.ordinary:
            self.alone, self.both = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)

    def gains(self, b: bytes) -> np.ndarray:
        return np.array([len(self.alone(w)) - len(self.both(w)) for w in windows(b)])

    def features(self, b: bytes) -> np.ndarray:
        g = self.gains(b)
        top = np.sort(g)[::-1]
        return np.array([top[0], top[:2].mean(), top[:4].mean(), g.mean(), np.log(len(g)), *np.log1p([(g >= t).sum() for t in THRESHOLDS])])

    def score(self, b: bytes) -> float:
        m = self.model
        if m.weights is None:
            return m.rate
        x = np.append(1.0, (self.features(b) - m.mean) / m.scale)
        return float(1 / (1 + np.exp(-np.clip(x @ m.weights, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[bytes], labels: list[int], seed: int = 0) -> Model:
    """texts: normal ones. Two thirds give the dictionaries, the rest the logistic model."""
    rate = float(np.mean(labels)) if labels else 0.0
    order = np.random.default_rng(seed).permutation(len(texts))
    toxic, ordinary = ([texts[i] for i in order if labels[i] == k] for k in (1, 0))
    if len(toxic) < 3 or len(ordinary) < 3:
        return Model(rate)
    learn = [toxic[: 2 * len(toxic) // 3], ordinary[: 2 * len(ordinary) // 3]]
    apart = {n: telling(*learn, n) for n in GRAMS}
    words = [b" %b " % w for b in learn[0] for w in b.split() if any(int.from_bytes((b" %b " % w)[i : i + n], "big") in apart[n] for n in GRAMS for i in range(len(w) + 3 - n))]
    words = words or [w for b in learn[0] for w in windows(b)]
    try:
        content = zstandard.train_dictionary(TOXIC_BYTES, words).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        content = b""
    if len(content) < 256:
        content = b"".join(sorted(set(words)))[:TOXIC_BYTES]
    pool = [w for b in learn[1] for w in windows(b)]
    pick = np.random.default_rng(seed).permutation(len(pool))[: ORDINARY_BYTES // WINDOW]
    model = Model(rate, b"".join(pool[i] for i in pick), content)
    scorer = Scorer(model)
    rest, y = [*toxic[len(learn[0]) :], *ordinary[len(learn[1]) :]], np.array([1] * (len(toxic) - len(learn[0])) + [0] * (len(ordinary) - len(learn[1])))
    x = np.array([scorer.features(b) for b in rest])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = logistic(np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale]), y)
    return model


def shortened(text: Column) -> Column:
    """A text of at most FIT_CHARS characters, or FIT_PARTS parts from all over it that have as many together."""
    size = FIT_CHARS // FIT_PARTS
    part = lambda i: F.substr(text, 1 + F.floor(i * (F.length(text) - size) / (FIT_PARTS - 1)).cast("int"), F.lit(size))
    return F.when(F.length(text) <= FIT_CHARS, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(FIT_PARTS - 1)), part), " "))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """Normal texts and labels to fit on, bounded, outside the held-out fold."""
    known = columns_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id", 3) != 1)
    ids = None
    for value, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    texts = columns_of(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    short = texts.select("doc_id", "toxic", shortened(F.col("text")).alias("text"), F.xxhash64("text").alias("_h"))
    rows = short.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct("_h", "text")).alias("text")).select("text", "toxic").toArrow()
    pairs = sorted({(normal(t), int(k)) for t, k in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True)})
    return [t for t, _ in pairs], [k for _, k in pairs]


OUT = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold("doc_id", 3) == 1).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            texts = as_text(batch.column("text")).cast(pa.large_binary())
            s = np.array([scorer.score(normal(t.as_py())) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidy(run), OUT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(*sample(docs, labels)))
