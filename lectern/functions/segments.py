"""Segmentation: a text to pieces, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rules import bind
from lectern.functions.text import cut_up, normalize_eol

#: A sentence, with the blanks behind it. It begins where the one before ended or behind a sign: what can't end is tried once, not again
#: from each of its characters, and nothing is given back, so the search is linear in the text.
SENTENCE = r"(?:\G|(?<=[.!?]))[^.!?]++(?:[.!?]++(?:\s+|$)|$)"


def smart_split(c: Column, target: int = 4900) -> Column:
    """Chunks of the text, in order, none longer than target; joined they are the text with normal line ends. An empty text has
    none. A cut looks back up to a fifth of target: after the last blank line, else the last sentence end, line end or blank, else
    hard."""
    w = int(min(2000, 0.2 * target))
    at = lambda x, p: F.nullif(F.length(F.regexp_extract(x, p, 1)), F.lit(0))
    back = lambda x: F.coalesce(at(x, r"^([\s\S]*\n\n)"), at(x, r"^([\s\S]*[.!?])\s"), at(x, r"^([\s\S]*\n)"), at(x, r"^([\s\S]* )"), F.lit(w))
    cut = lambda rest: F.lit(target - w) + bind(F.substring(rest, target - w + 1, w), back)
    few = lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= target, F.array(t))
    return bind(normalize_eol(c), lambda t: few(t).otherwise(cut_up(t, target, target - w, cut)))


def explode_numbered(df: DataFrame, pieces: Column, number: str, name: str, first: int = 1, keep_empty: bool = False) -> DataFrame:
    """df without its text, a row for each piece. keep_empty: a text without pieces has one row, with nulls."""
    keep = [c for c in df.columns if c != "text"]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*keep, explode(pieces).alias("_i", name)).select(*keep, (F.col("_i") + first).alias(number), name)


def explode_chunks(df: DataFrame, target: int = 4900, keep_empty: bool = False) -> DataFrame:
    return explode_numbered(df, smart_split(F.col("text"), target), "chunk_no", "chunk", keep_empty=keep_empty)


def explode_lines(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    return explode_numbered(df, F.split("text", "\n", -1), "line_no", "line", keep_empty=keep_empty)


def explode_paragraphs(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    return explode_numbered(df, F.split("text", r"\n{2,}", -1), "para_no", "paragraph", keep_empty=keep_empty)


def explode_sentences(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    pieces = F.when(F.size(found) > 0, found).when(F.col("text").isNotNull(), F.array("text"))
    return explode_numbered(df, pieces, "sentence_no", "sentence", keep_empty=keep_empty)


def slice_fixed(df: DataFrame, n: int = 2000) -> DataFrame:
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / n).cast("int") - 1)), lambda i: F.col("text").substr(i * n + 1, F.lit(n)))
    return explode_numbered(df.where(F.length("text") > 0), pieces, "slice_no", "slice")


def reassemble(pieces: DataFrame, number: str, name: str, separator: str = "", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and text, from pieces in the order of their number. keys must tell the texts apart (a row key beside doc_id
    where ids repeat). Pieces of one text whose number is null stand for a text without pieces, which is empty."""
    held = F.array_sort(F.collect_list(F.when(F.col(number).isNotNull(), F.struct(F.col(number).alias("n"), F.col(name).alias("t")))))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), separator).alias("text"))
