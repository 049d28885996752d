"""Token ids of whole texts with a public byte-level BPE, and packing's and counting's common ground.

Before a blank that follows no white space, the pre-tokenizer always cuts, so a text's ids are those of its
blank-separated segments. A slice of texts is cut there, each different segment is encoded once, and the ids
are put together with numpy. Texts with runs of white space are encoded whole; texts that hold the string of a
special token go through the tokenizers library, which defines the ids.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.common import ragged

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Two neighbouring characters of white space, in the widest sense of any library here.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"


def vocabulary_paths() -> tuple[str, str]:
    """The vocabulary as the tokenizers and tiktoken libraries read it."""
    return public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken")


@lru_cache(maxsize=2)
def encoder(paths: tuple[str, str] | None = None) -> Encoder:
    return Encoder(*(paths or vocabulary_paths()))


class Encoder:
    """Ids of texts; json and ranks are two files of one vocabulary."""

    def __init__(self, json: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.json = json
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            self.size[i] = len(piece)
        self.blank = table[b" "]

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json)

    def one(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if text else np.zeros(0, np.uint32)

    def segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ' ' + word for each different word, one after another; where each begins, and how many."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        empty = next((i for i, w in enumerate(words) if not w), None)
        full = words if empty is None else words[:empty] + words[empty + 1 :]
        ids = self.plain(" " + " ".join(full)) if full else np.zeros(0, np.uint32)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in full), np.int64, len(full)) + 1)
        stop = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        length = stop - start
        if empty is not None:
            start, length = np.insert(start, empty, len(ids)), np.insert(length, empty, 1)
            ids = np.append(ids, np.uint32(self.blank))
        return ids, start, length

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids; where each piece begins in it and its length; and which piece each text begins with, and the end.

        texts: large strings without nulls. The pieces of a text are its blank-separated segments, or the text.
        """
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, _RUN), pc.match_substring(texts, SPECIAL)), dtype=bool)
        even = np.flatnonzero(~odd)
        split = pc.split_pattern(texts if len(even) == len(texts) else texts.take(pa.array(even)), " ")
        words = split.flatten()
        at = np.asarray(split.offsets, dtype=np.int64)
        at = at - at[0] if len(at) else np.zeros(1, np.int64)
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices, dtype=np.int64)
        pool, start, length = self.segments(coded.dictionary.to_pylist())
        start, length = start[codes], length[codes]
        firsts = [self.plain(x) for x in words.take(pa.array(at[:-1])).to_pylist()]
        whole = [self.one(x) for x in texts.take(pa.array(np.flatnonzero(odd))).to_pylist()]
        extra = np.array([len(x) for x in [*firsts, *whole]], np.int64)
        begin = len(pool) + np.cumsum(extra) - extra
        start[at[:-1]], length[at[:-1]] = begin[: len(firsts)], extra[: len(firsts)]
        pool = np.concatenate([pool, *firsts, *whole]).astype(np.uint32)
        n = np.ones(len(texts), np.int64)
        n[even] = np.diff(at)
        first = np.concatenate([[0], np.cumsum(n)])
        if not odd.any():
            return pool, start, length, first
        all_start, all_length = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        to = ragged(first[:-1][even], n[even])
        all_start[to], all_length[to] = start, length
        to = first[:-1][odd]
        all_start[to], all_length[to] = begin[len(firsts) :], extra[len(firsts) :]
        return pool, all_start, all_length, first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, and the end."""
        pool, start, length, first = self.pieces(texts)
        ends = np.concatenate([[0], np.cumsum(length)])
        return pool[ragged(start, length)], ends[first]
