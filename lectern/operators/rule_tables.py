"""Lists of replacements of any length: one law, whatever their number.

Rules replace literal strings wherever they stand, ignoring case, one after another in order of rule_no, each in what the ones before
left. Few rules enter the plan as replacements. Of many, an automaton (Aho and Corasick) over the lower-cased text finds those that
occur at all, and these are applied in order; what a replacement makes is looked at around its place for later rules. So a text
costs one pass and the rules that act on it. Blocks of rules, bounded in characters, go over the texts one after another, which is
the same law: tasks hold one block.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lectern.functions.rules import folded
from lectern.functions.text import custom_replacements
from lectern.operators.running import running
from lectern.session import stored

#: Rules that a plan holds; it nests as deep.
FOLD = 100
#: Characters of the rules of a block.
BLOCK = 400_000


def load_rules(text: str) -> list[tuple[str, str]]:
    """Rules (search, replace) from a JSON list; what is no list has none."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    return [(r["search"], r.get("replace", "")) for r in rows if isinstance(r, dict) and r.get("search")] if isinstance(rows, list) else []


class Rules:
    """A block of rules, ready to be applied to texts."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        self.rules = [(folded(search), to) for search, to in rules]
        of: dict[str, list[int]] = {}
        for i, (search, _) in enumerate(self.rules):
            of.setdefault(search, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for search, numbers in of.items():
            self.automaton.add_word(search, numbers)
        self.automaton.make_automaton()
        self.reach = max(map(len, of)) - 1

    def apply(self, text: str) -> str:
        low = folded(text)
        known = {i for _, numbers in self.automaton.iter(low) for i in numbers}
        waiting = sorted(known)  # a sorted list is a heap
        while waiting:
            i = heapq.heappop(waiting)
            text, low, places = self._replaced(text, low, *self.rules[i])
            for start, stop in places:
                for _, numbers in self.automaton.iter(low[max(0, start - self.reach) : stop + self.reach]):
                    for j in numbers:
                        if j > i and j not in known:
                            known.add(j)
                            heapq.heappush(waiting, j)
        return text

    def _replaced(self, text: str, low: str, search: str, to: str) -> tuple[str, str, list[tuple[int, int]]]:
        """The text with each search replaced, without case, and where the replacements stand (places that touch are one)."""
        at = low.find(search)
        if at < 0:
            return text, low, []
        low_to, out, out_low, places, done, size = folded(to), [], [], [], 0, 0
        while at >= 0:
            out += [text[done:at], to]
            out_low += [low[done:at], low_to]
            size += at - done
            if places and places[-1][1] + 2 * self.reach >= size:
                places[-1] = (places[-1][0], size + len(to))
            else:
                places.append((size, size + len(to)))
            size += len(to)
            done = at + len(search)
            at = low.find(search, done)
        return "".join([*out, text[done:]]), "".join([*out_low, low[done:]]), places


def blocks(rules: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The rules in order, as many at a time as have `most` characters (one at least); the driver holds a block."""
    block, size = [], 0
    for r in rules.toLocalIterator():
        if block and size + len(r["search"]) + len(r["replace"]) > most:
            yield block
            block, size = [], 0
        block.append((r["search"], r["replace"]))
        size += len(r["search"]) + len(r["replace"])
    if block:
        yield block


def _replacer(spark, block: list[tuple[str, str]]):
    sent = spark.sparkContext.broadcast(block)
    ready: list[Rules] = []

    @pandas_udf(StringType())
    def replaced(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Rules(sent.value))
        return texts.map(ready[0].apply, na_action="ignore")

    return replaced.asNondeterministic()


def apply_rule_table(docs: DataFrame, rules: DataFrame, fold: int = FOLD, block: int = BLOCK) -> DataFrame:
    """docs with the rules of a table (rule_no, search, replace) applied to text, in order of rule_no (then search and replace).

    fold and block decide how, never what: the result is that of custom_replacements. Rules without a search are passed over, a
    null replacement is empty, rows without a text stay. Between blocks the texts are written to the shared folder.
    """
    used = rules.where("search is not null and search <> ''").select("rule_no", "search", F.coalesce("replace", F.lit("")).alias("replace"))
    order = ["rule_no", "search", "replace"]
    used = stored(used, "rules")  # rules may come from a corpus, which is read once
    few = used.orderBy(*order).limit(fold + 1).collect()
    if len(few) <= fold:
        return docs.withColumn("text", custom_replacements(F.col("text"), [(r["search"], r["replace"]) for r in few]))
    for i, some in enumerate(blocks(used.orderBy(*order), block)):
        docs = stored(docs, "replaced") if i else docs
        docs = docs.withColumn("text", _replacer(docs.sparkSession, some)(F.col("text")))
    return docs


#: Rules of a table that are joined with the texts at once; what is sent is bounded by their characters too.
JOINED = 1000
#: What makes a rule one that counts whole words: its literal is a word, between these in its pattern.
WORD = r"[\p{L}\p{N}_]"
WORD_BEGINS, WORD_ENDS = f"(?<!{WORD})", f"(?!{WORD})"


def _word_counter(spark, words: list[str]):
    """Of the words of each text those of a block, by their place there, with their number."""
    sent = spark.sparkContext.broadcast(words)
    ready: list[pa.Array] = []

    @arrow_udf("array<struct<_i: int, n: bigint>>")
    def counted(found: pa.Array) -> pa.Array:
        if not ready:
            ready.append(pa.array(sent.value, pa.string()))
        size = np.asarray(pc.fill_null(pc.list_value_length(found), 0), np.int64)
        at = pc.fill_null(pc.index_in(found.flatten().cast(pa.string()), value_set=ready[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key, n = np.unique((np.repeat(np.arange(len(found)), size) * len(ready[0]) + at)[at >= 0], return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(found) + 1) * len(ready[0])).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array((key % len(ready[0])).astype(np.int32)), pa.array(n.astype(np.int64))], ["_i", "n"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs)

    return counted.asNondeterministic()


def _word_hits(docs: DataFrame, rules: DataFrame, block: int) -> DataFrame | None:
    """rule_hits() of rules that count whole words, None without any: a text is cut into its words once, whatever the number of rules,
    and words meet the rules by being equal. A word of the pattern's own kind is hit where a whole word of the text is the literal."""
    spark, rest = docs.sparkSession, [c for c in docs.columns if c != "text"]
    tokens = F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0))
    out = None
    for some in blocks(rules.select(F.lit("").alias("search"), F.col("literal").alias("replace")).distinct().orderBy("replace"), block):
        words = [w for _, w in some]
        at = rules.join(F.broadcast(spark.createDataFrame(list(enumerate(words)), "_i int, literal string")), "literal").drop("literal")
        hit = docs.select(*rest, F.inline(_word_counter(spark, words)(tokens)))
        part = hit.join(F.broadcast(at), "_i").select(*rest, "rule_no", "label", "replacement", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(spark, block: list[tuple[int, str]]):
    """Of each text the numbers of the strings of a block that it holds, case ignored."""
    sent = spark.sparkContext.broadcast(block)
    ready: list = []

    @pandas_udf(ArrayType(IntegerType()))
    def found(texts: pd.Series) -> pd.Series:
        if not ready:
            import ahocorasick

            of: dict[str, list[int]] = {}
            for number, literal in sent.value:
                of.setdefault(folded(literal), []).append(number)
            ready.append(ahocorasick.Automaton())
            for literal, numbers in of.items():
                ready[0].add_word(literal, numbers)
            ready[0].make_automaton()
        return texts.map(lambda t: sorted({n for _, numbers in ready[0].iter(folded(t)) for n in numbers}), na_action="ignore")

    return found.asNondeterministic()


def rule_hits(docs: DataFrame, rules: DataFrame, joined: int = JOINED, block: int = BLOCK) -> DataFrame:
    """rule_no, label, replacement and n of each rule in each document that holds it (columns of docs but text stay).

    rules: rule_no, label, replacement, literal (a string that every match holds, whatever its case) and pattern (Java). Rules that
    count a whole word (WORD_BEGINS, the literal, WORD_ENDS) are found by cutting a text into its words. Of the others a
    pattern is only tried on texts that hold its literal. Few rules meet the texts in a join on that, broadcast, without a shuffle; of
    many, automata over blocks of literals tell which rules a text holds, and the rules' rows join by number. The result is the same.
    """
    used = rules.where("literal is not null and literal <> '' and pattern is not null").select("rule_no", "label", "replacement", "literal", "pattern")
    is_word = F.col("literal").rlike(f"^{WORD}+\\z") & (F.col("pattern") == F.concat(F.lit(WORD_BEGINS), F.col("literal"), F.lit(WORD_ENDS)))
    used = stored(used.withColumn("_word", is_word), "rules")
    words, others = (used.where(x).drop("_word") for x in ("_word", "not _word"))
    found = _word_hits(docs, words.drop("pattern"), block)
    if found is None or others.limit(1).count():
        more = _pattern_hits(docs, others, joined, block)
        found = more if found is None else found.unionByName(more)
    return found


def _pattern_hits(docs: DataFrame, used: DataFrame, joined: int, block: int) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    n = F.regexp_count("text", F.col("pattern")).cast("bigint").alias("n")
    few = used.agg(F.count("*").alias("n"), F.sum(F.length("literal") + F.length("pattern")).alias("size")).first()
    if few["n"] <= joined and (few["size"] or 0) <= block:
        # both cases, as some letters are the same in one of them alone; once for each text and rule, not for each pair
        texts = docs.withColumns({"_low": F.lower("text"), "_up": F.upper("text")})
        sent = F.broadcast(used.withColumns({"_l": F.lower("literal"), "_u": F.upper("literal")}))
        pairs = texts.join(sent, F.contains("_low", F.col("_l")) | F.contains("_up", F.col("_u")))
        return pairs.select(*rest, "rule_no", "label", "replacement", n).where("n > 0")
    numbered = stored(used.withColumn("_no", F.monotonically_increasing_id()), "rules")
    places = stored(running(numbered, [], [F.col("_no")], {}, number="_i"), "numbered-rules")
    out = None
    for some in blocks(places.orderBy("_i").select(F.col("_i").cast("string").alias("search"), F.col("literal").alias("replace")), block):
        held = [(int(i), literal) for i, literal in some]
        hit = docs.withColumn("_f", _finder(docs.sparkSession, held)(F.col("text"))).select(*rest, "text", F.explode("_f").alias("_i"))
        part = places.where(F.col("_i").between(held[0][0], held[-1][0]))  # bounded as its block is
        counted = hit.join(F.broadcast(part), "_i").select(*rest, "rule_no", "label", "replacement", n).where("n > 0")
        out = counted if out is None else out.unionByName(counted)
    return out


def rule_inventory(docs: DataFrame, rules: DataFrame, joined: int = JOINED, block: int = BLOCK) -> DataFrame:
    """label, replacement, n and n_docs of a table's rules over the corpus; rules that hit nothing have no row."""
    return rule_hits(docs.select("text"), rules, joined, block).groupBy("label", "replacement").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
