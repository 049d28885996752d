"""Counts, profiles and estimates over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions.text import abbreviation_sign, trim
from lectern.operators.running import BLOCK, moving_average, running

PRICE_IN, PRICE_OUT = 0.075, 0.30  # $ for a million tokens
WORDS_PER_MINUTE = 150


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def abbreviation_pattern(label: str) -> str:
    """For Spark: the abbreviation itself first, which is quick to find, then what may not stand before it."""
    body = R.quoted(label) + (R.SP if label == "s." else "")
    return f"{'(?iu)' if label in R.ANY_CASE else ''}{body}(?<=(?<![\\p{{L}}\\p{{N}}_]){body})"


def _abbreviation_counts(c: Column) -> list[Column]:
    """How often each abbreviation occurs: looked for only where its string is, and this only where any is."""
    low = F.lower(c)
    one = lambda label: F.when(F.contains(c, F.lit(label)) if label not in R.ANY_CASE else F.contains(low, F.lit(label.lower())), _count(c, abbreviation_pattern(label))).otherwise(F.lit(0).cast("bigint"))
    return [one(label) for label, _ in R.abbreviations()]


def abbreviation_hits(docs: DataFrame) -> DataFrame:
    """doc_id, label and n for each abbreviation in each document that holds it: one column for each rule, then unpivoted."""
    table = R.abbreviations()
    counts = _abbreviation_counts(F.col("text"))
    wide = docs.where(F.col("text").rlike(abbreviation_sign())).select("doc_id", F.array(*[F.struct(F.lit(label).alias("label"), F.lit(to).alias("replacement"), c.alias("n")) for (label, to), c in zip(table, counts, strict=True)]).alias("_r"))
    return wide.select("doc_id", F.inline(F.filter("_r", lambda x: x["n"] > 0)))


def abbreviation_inventory(docs: DataFrame, top: int | None = None) -> DataFrame:
    """label, replacement, n and n_docs over the corpus; the top by n if asked."""
    df = abbreviation_hits(docs).groupBy("label", "replacement").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
    return df if top is None else df.orderBy(F.desc("n"), "label").limit(top)


#: What counts as an issue.
ISSUES = {
    "double_spaces": R.Rule(" {2,}", needs=("  ",)),
    "plenken": R.Rule(f"{R.SP}+([.,!?;:])", sign=f"[.,!?;:](?<={R.SP}.)"),
    "hyphenation": R.Rule(f"([a-zäöüß])-{R.SP}*\\n{R.SP}*([a-zäöüß])", "", "i", needs=("-",)),
    "urls": R.Rule(f"(https?://[^{R.SPACES}]+)|(www\\.[^{R.SPACES}]+)", "", "i", needs=("://",), sign="(?i)www\\."),
    "emails": R.Rule("[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}", needs=("@",)),
}


def issue_counts(c: Column) -> Column:
    """struct of a count of each issue, of abbreviations, and their total; c is a column of a table."""
    hits = F.when(c.rlike(abbreviation_sign()), sum(_abbreviation_counts(c), F.lit(0).cast("bigint"))).when(c.isNotNull(), F.lit(0).cast("bigint"))
    counts = F.struct(*[r.count(c).alias(k) for k, r in ISSUES.items()], hits.alias("abbreviations"))
    return R.bind(counts, lambda x: F.struct(*[x[k].alias(k) for k in ISSUES], x["abbreviations"].alias("abbreviations"), sum((x[k] for k in ISSUES), x["abbreviations"]).alias("total")))


def issue_profile(docs: DataFrame) -> DataFrame:
    """A count of each issue for each document, abbreviations, and their total."""
    return docs.select("doc_id", "lang", "source", issue_counts(F.col("text")).alias("_n")).select("doc_id", "lang", "source", "_n.*")


def issue_rollup(docs: DataFrame) -> DataFrame:
    names = [*ISSUES, "abbreviations", "total"]
    return issue_profile(docs).groupBy("lang", "source").agg(F.count("*").alias("n_docs"), *[F.sum(n).alias(n) for n in names])


def word_count(c: Column) -> Column:
    t = trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, R.SP + "+", -1))).cast("bigint")


def _cost(tokens: Column) -> Column:
    return (tokens * round(1000 * (PRICE_IN + PRICE_OUT))).cast("double") / F.lit(1e9)


def estimates(docs: DataFrame) -> DataFrame:
    """Tokens, cost in dollars and minutes to speak, for each document."""
    df = docs.select("doc_id", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"), word_count(F.col("text")).alias("words"))
    cost = _cost(F.col("tokens"))
    minutes = F.ceil(F.col("words") / WORDS_PER_MINUTE).cast("bigint")
    return df.withColumns({"cost": cost, "minutes": minutes}).withColumns({"hours": F.floor(F.col("minutes") / 60).cast("bigint"), "rest_minutes": (F.col("minutes") % 60).cast("bigint")})


def estimate_totals(docs: DataFrame) -> DataFrame:
    """Over the corpus: minutes of all words together, and of each document rounded up."""
    e = estimates(docs)
    return e.agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), F.ceil(F.sum("words") / WORDS_PER_MINUTE).cast("bigint").alias("minutes"), F.sum("minutes").alias("minutes_by_doc"), _cost(F.sum("tokens")).alias("cost"))


def cleaning_summary(docs: DataFrame, on: set[str] | None = None) -> DataFrame:
    """doc_id, category, action and n of what cleaning would change, counted on the original; on: options, None for all."""
    used = {k: v for k, v in R.COUNTERS.items() if v[2] is None or on is None or v[2] in on}
    wide = docs.select("doc_id", *[sum((r.count(F.col("text")) for r in rules), F.lit(0).cast("bigint")).alias(k) for k, (_, rules, _) in used.items()])
    category = F.create_map(*[F.lit(x) for k, v in used.items() for x in (k, v[0])])
    return wide.unpivot("doc_id", list(used), "action", "n").where("n > 0").select("doc_id", F.element_at(category, F.col("action")).alias("category"), "action", "n")


def summary_by_category(actions: DataFrame) -> DataFrame:
    c = F.coalesce("category", F.lit("Allgemein"))
    return actions.groupBy("doc_id", c.alias("category")).agg(F.count("*").alias("n_actions"), F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("action")), ", ").alias("actions"))


def summary_rollup(actions: DataFrame) -> DataFrame:
    return actions.rollup("category", "action").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, R.SP + "+", -1), "")


def token_diff(docs: DataFrame, before: str, after: str, key: str = "doc_id") -> DataFrame:
    """Words whose number in a document differs between two texts of its row (columns before and after): rows whose texts are
    equal are passed over, and the words of both meet in one aggregation."""
    side = lambda c, n: F.transform(_tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("token"), F.lit(n).alias("is_after")))
    # not a filter, which would be pushed below the column `after` and work it out twice
    both = F.when(~F.col(before).eqNullSafe(F.col(after)), F.concat(side(before, 0), side(after, 1)))
    rows = docs.select(key, F.inline(both))
    n = rows.groupBy(key, "token").agg((F.count("*") - F.sum("is_after")).alias("n_before"), F.sum("is_after").cast("bigint").alias("n_after"))
    return n.withColumn("delta", F.col("n_after") - F.col("n_before")).where("delta <> 0")


def usage_sums(log: DataFrame, key: str, prompt: str, output: str) -> DataFrame:
    """Sums of two token columns for each key."""
    return log.groupBy(key).agg(F.sum(prompt).alias("prompt_total"), F.sum(output).alias("output_total"))


def usage_totals(log: DataFrame, key: str, order: list[str], prompt: str, output: str) -> DataFrame:
    """Running sums of two token columns for each key, also where one key has most of the rows."""
    rows = running(log.select(key, *order, prompt, output), [key], order, {"prompt_total": F.col(prompt), "output_total": F.col(output)}, number="_n")
    return rows.select(key, *order, "prompt_total", "output_total")


def recent_chunk_avg(log: DataFrame, key: str, order: list[str], duration: str, n: int = 5, block: int = BLOCK) -> DataFrame:
    """Mean of the last n durations, and that times the chunks left; a large key is worked out in blocks."""
    numbered = running(log.select(key, *order, duration), [key], order, {}, number="_n", total="_all")
    rows = moving_average(numbered, [key], duration, n, "_recent", "_n", block)
    left = F.col("_all") - F.col("_n")
    return rows.select(key, *order, F.round("_recent", 6).alias("recent_avg"), left.cast("bigint").alias("remaining"), F.round(F.col("_recent") * left, 6).alias("eta"))


def preview(docs: DataFrame, n: int = 100_000) -> DataFrame:
    return docs.select("doc_id", F.substring("text", 1, n).alias("preview"), (F.length("text") > n).alias("truncated"))


def large_text_flag(docs: DataFrame, n: int = 500_000) -> DataFrame:
    return docs.select("doc_id", (F.length("text") > n).alias("is_large"))


def count_matches(c: Column, pattern: str) -> Column:
    return _count(c, pattern)
