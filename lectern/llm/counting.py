"""Token counts that follow edits.

A document with edits keeps a segment tree over its segments (blank-separated, where the pre-tokenizer always
cuts): each node sums the characters and the tokens below it. An edit finds its segments by their characters,
takes one more on either side as context, and goes on to the right until the text is cut safely again; this
region alone is encoded anew, and the sums above it change. The root holds the count.

A slice's segments are counted together, each different one once, so documents without edits cost no tree.

Edits are (start, stop, replacement) in characters of the text before them, in any order; of two that overlap
the one that begins later is passed over. A very long text is a slice of its own. Nulls: a null text is empty, has no tokens and no edits; null and
repeated ids are counted as they are. Empty tables give an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, columns_of, slices, tidy
from lectern.llm.tokens import Encoder, encoder

Edit = tuple[int, int, str]

#: A cut: a blank after something that is no white space.
_CUT = re.compile(r"(?<=\S) ")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_SECRET = re.compile(r"\b[0-9a-f]{24,}\b")
_NUMBER = re.compile(r"\+?\d[\d ()-]{7,}\d")


def segments(text: str) -> list[str]:
    """The text, cut where the pre-tokenizer cuts whatever stands beside. (A cut after one of \\x1c to \\x1f, which
    libraries see differently, is left out.)"""
    cuts = [0, *(m.start() for m in _CUT.finditer(text) if text[m.start() - 1] not in "\x1c\x1d\x1e\x1f\x85"), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Tree:
    """Sums of characters and tokens over a document's segments."""

    def __init__(self, texts: list[str], tokens: list[int]):
        self.texts = list(texts)
        self.base = 1 << max(0, (len(texts) - 1).bit_length())
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + len(texts)] = np.array([[len(t) for t in texts], tokens], np.int64).T.reshape(-1, 2)
        level = self.base
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaf(self, place: int) -> tuple[int, int]:
        """The segment that holds the character at place (the last one beyond the end), and where it begins."""
        i, begin = 1, 0
        place = min(place, int(self.sums[1, 0]) - 1)
        while i < self.base:
            i *= 2
            if place - begin >= self.sums[i, 0]:
                begin += int(self.sums[i, 0])
                i += 1
        return i - self.base, begin

    def set(self, leaf: int, text: str, tokens: int) -> None:
        i = self.base + leaf
        change = np.array([len(text), tokens]) - self.sums[i]
        self.texts[leaf] = text
        while i:
            self.sums[i] += change
            i //= 2


class Counted:
    """A document whose count follows its edits; encoded: how many segments have been encoded anew."""

    def __init__(self, text: str, enc: Encoder, known: list[int] | None = None):
        parts = segments(text) or [""]
        self.enc, self.encoded = enc, 0
        self.tree = Tree(parts, known if known is not None else [len(enc.one(p)) for p in parts])

    def edit(self, edits: list[Edit]) -> int:
        """Applies the edits and returns the count."""
        tree = self.tree
        size = int(tree.sums[1, 0])
        todo: list[Edit] = []
        for start, stop, new in sorted(edits):
            if 0 <= start <= stop <= size and (not todo or start >= todo[-1][1]):
                todo.append((start, stop, new))
        regions: list[tuple[int, int, int, list[Edit]]] = []  # first and last segment, where the first begins, edits
        for e in todo:
            a, begin = self._step(*tree.leaf(max(0, e[0] - 1)), -1)
            b, _ = self._step(*tree.leaf(e[1]), 1)
            if regions and a <= regions[-1][1]:
                f, l, g, held = regions.pop()
                regions.append((f, max(l, b), g, [*held, e]))
            else:
                regions.append((a, b, begin, [e]))
        for k in range(len(regions) - 1, -1, -1):  # from the right, so that places stay true
            self._renew(*regions[k])
        return tree.tokens

    def _step(self, leaf: int, begin: int, way: int) -> tuple[int, int]:
        """The next segment with text on the left or right, or the same at the edge."""
        texts, i = self.tree.texts, leaf + way
        while 0 <= i < len(texts):
            if texts[i]:
                return i, begin - len(texts[i]) if way < 0 else begin + len(texts[leaf])
            i += way
        return leaf, begin

    def _renew(self, a: int, b: int, begin: int, edits: list[Edit]) -> None:
        texts = self.tree.texts
        old = "".join(texts[a : b + 1])
        new, at = [], 0
        for start, stop, put in edits:
            new += [old[at : start - begin], put]
            at = stop - begin
        text = "".join([*new, old[at:]])
        while b + 1 < len(texts) and (not texts[b + 1] or not text or text[-1].isspace() or not texts[b + 1].startswith(" ")):
            b += 1
            text += texts[b]
        while a > 0 and not (text.startswith(" ") and (before := self._before(a)) and not before.isspace()):
            a -= 1
            text = texts[a] + text
        self.encoded += sum(1 for t in texts[a : b + 1] if t)
        self.tree.set(a, text, len(self.enc.one(text)))
        for i in range(a + 1, b + 1):
            if texts[i]:
                self.tree.set(i, "", 0)

    def _before(self, a: int) -> str:
        """The last character before segment a."""
        for i in range(a - 1, -1, -1):
            if self.tree.texts[i]:
                return self.tree.texts[i][-1]
        return ""


def cleaning_edits(text: str) -> list[Edit]:
    """Addresses, long numbers and keys are masked; lines that repeat an earlier one go."""
    out = [(m.start(), m.end(), mark) for p, mark in ((_ADDRESS, "[email]"), (_SECRET, "[key]"), (_NUMBER, "[number]")) for m in p.finditer(text)]
    seen, at = set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((max(0, at - 1), at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    return out


OUT = "doc_id bigint, n_segments bigint, n_tokens bigint, n_edits bigint, n_encoded bigint, n_tokens_edited bigint"


def counted(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits) -> DataFrame:
    """Tokens of each document before and after its edits; n_encoded: segments that were encoded anew for them."""
    rows = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in slices(batches):
            texts = as_text(batch.column("text"))
            _, _, length, first = enc.pieces(texts)
            sums = np.concatenate([[0], np.cumsum(length)])
            tokens = sums[first[1:]] - sums[first[:-1]]
            n = len(tokens)
            parts, edits, encoded, after = np.diff(first), np.zeros(n, np.int64), np.zeros(n, np.int64), tokens.copy()
            for i, text in enumerate(texts.to_pylist()):
                if todo := edits_of(text):
                    of = length[first[i] : first[i + 1]].tolist()
                    doc = Counted(text, enc, of if len(of) == len(segments(text)) else None)
                    edits[i], after[i], encoded[i] = len(todo), doc.edit(todo), doc.encoded
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (parts, tokens, edits, encoded, after))], [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(tidy(run), OUT)
