"""Pause tags: how they are written, put in, found and summed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions.rules import apply, bind
from lectern.functions.segments import explode_lines
from lectern.functions.text import replace_by, trim

#: A complete tag this close to where one would go keeps it out.
NEAR = 20


@dataclass(frozen=True)
class PauseConfig:
    paragraphs: bool = True
    paragraph_s: float = 2.0
    sentences: bool = False
    sentence_s: float = 0.8
    guard: bool = True
    space_after: bool = True


def seconds_text(seconds: float) -> str:
    x = max(0.1, int(seconds * 10 + 0.5) / 10)
    return str(int(x)) if x == int(x) else str(x)


def pause_tag(seconds: Column) -> Column:
    """[PAUSE 2s], [PAUSE 0.8s]: one decimal at most, at least 0.1."""
    x = F.greatest(F.lit(0.1), F.floor(seconds * 10 + 0.5) / 10)
    return bind(x, lambda v: F.concat(F.lit("[PAUSE "), F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")), F.lit("s]")))


def _insert_after(t: Column, pattern: str, inserted: str) -> Column:
    """`inserted` after each match, unless a complete tag lies within NEAR characters of its end: one replacement.

    What lies near is looked at from the match's end, so nothing is cut up and no place is counted: a tag that begins near before it
    and ends there too, one that lies across it, or one behind it, whose end is bounded by where it begins. pattern never gives up
    what it has matched, so a match that is near a tag is not tried again with another end.
    """
    tag, any_sign = R.PAUSE_TAG.pattern, "[\\s\\S\U0001d11e]"  # the rare sign makes the engine count characters behind as such
    shortest = len("[PAUSE 1s]")
    before = f"(?<!(?=(?iu:{tag})){any_sign}{{{shortest},{NEAR}}})"
    ahead = "|".join(f"{any_sign}{{{k}}}(?=\\[[^\\]]{{0,{NEAR - k - 2}}}\\]){tag}" for k in range(NEAR - shortest + 1))
    after = f"(?!(?={any_sign}{{0,{NEAR - shortest}}}\\[)(?iu:{ahead}))"
    across = f"(?!(?=[^\\]]{{0,{NEAR - 1}}}\\])(?<=(?=(?iu:{tag}))[^\\]\U0001d11e]{{1,{NEAR}}}))"
    return F.regexp_replace(t, F.lit(f"({pattern}){before}{across}{after}"), F.lit("$1" + inserted))


def paragraph_pauses(c: Column, seconds: float = 2.0, space_after: bool = True) -> Column:
    return _insert_after(c, r"(?>\n\s*\n+)", f" [PAUSE {seconds_text(seconds)}s]" + " " * space_after)


def sentence_pauses(c: Column, seconds: float = 0.8, guard: bool = True) -> Column:
    short = "|".join(R.quoted(x) for x in R.GUARD)
    no_abbreviation = f"(?<!(?<![\\p{{L}}\\p{{N}}_])(?:{short})\\.)" if guard else ""
    return _insert_after(c, rf"[.!?]{no_abbreviation}\s++", f"[PAUSE {seconds_text(seconds)}s] ")


def inject_pauses(c: Column, cfg: PauseConfig = PauseConfig()) -> Column:
    if cfg.paragraphs and cfg.paragraph_s > 0:
        c = paragraph_pauses(c, cfg.paragraph_s, cfg.space_after)
    if cfg.sentences and cfg.sentence_s > 0:
        c = sentence_pauses(c, cfg.sentence_s, cfg.guard)
    return c


def remove_pause_tags(c: Column) -> Column:
    return apply(R.REMOVE_TAGS, c)


def count_pause_tags(c: Column) -> Column:
    return R.PAUSE_TAG.count(c)


def sum_pause_seconds(c: Column) -> Column:
    values = F.regexp_extract_all(c, F.lit("(?i)" + R.TAG_VALUE), F.lit(1))
    return F.aggregate(F.transform(values, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)


def config_problems(para_on: Column, para_s: Column, sent_on: Column, sent_s: Column) -> Column:
    """What is wrong with a row of a table of configurations."""
    return F.array_compact(F.array(
        F.when(para_on & (para_s <= 0), F.lit("error: paragraph pause must be positive")),
        F.when(sent_on & (sent_s <= 0), F.lit("error: sentence pause must be positive")),
        F.when(para_on & sent_on & (sent_s >= para_s), F.lit("warning: sentence pause is not shorter than paragraph pause")),
    ))


# ---------------------------------------------------------------- scripts


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).cast("double")


def normalize_shortcodes(c: Column) -> Column:
    """(10 Min), [1,5 Minuten], (Pause: 30 Sek) become tags in seconds; tags stay, and so do durations of 0."""
    pattern = "(?iu)(?!\\[PAUSE\\s[\\d.]+s\\])" + R.SHORTCODE

    def tag(m: Column) -> Column:
        unit = F.lower(F.regexp_extract(m, pattern, 2))
        times = F.when(unit.startswith("m"), 60.0).when(unit.startswith("st") | (unit == "h"), 3600.0).otherwise(1.0)
        value = _number(F.regexp_extract(m, pattern, 1))
        return F.when(value > 0, F.concat(F.lit(" [PAUSE "), F.floor(value * times + 0.5).cast("string"), F.lit("s] "))).otherwise(m)

    return replace_by(c, pattern, tag)


def pause_seconds(c: Column) -> Column:
    """Seconds that a direction asks for; 15 where it names none. Only lines with a digit, or a unit that words can count, are searched."""
    return bind(F.lower(c), lambda t: F.when(t.isNull() | t.rlike(r"\d") | F.contains(t, F.lit("minute")) | F.contains(t, F.lit("sekunde")), _asked(t)).otherwise(F.lit(15.0)))


def _asked(t: Column) -> Column:
    """pause_seconds() of a lower-cased line that is bound."""
    number = r"(\d+(?:[.,]\d+)?)\s*(?:reale?\s+)?"
    found = [F.when(v > 0, F.floor(v * times + 0.5).cast("double")) for p, times in R.NUMBER_UNITS for v in [_number(F.nullif(F.regexp_extract(t, number + p, 1), F.lit("")))]]
    edge, end = r"(?<![\p{L}\p{N}_])", r"\s+(?:reale?\s+)?"
    found += [F.when(t.rlike(f"{edge}(?:{w}){end}{unit}"), F.lit(float(s))) for table, unit in ((R.WORD_MINUTES, "minuten?"), (R.WORD_SECONDS, "sekunden?")) for w, s in table]
    bare = _number(F.nullif(F.regexp_extract(t, edge + r"(\d+(?:[.,]\d+)?)(?![\p{L}\p{N}_])", 1), F.lit("")))
    found.append(F.when((bare > 0) & (bare <= 300), F.floor(bare + 0.5).cast("double")))
    return F.coalesce(*found, F.lit(15.0))


def line_seconds(line: Column) -> Column:
    """Seconds that a trimmed line asks for; null where it asks for no pause."""
    tagged = F.regexp_extract(line, "(?i)" + R.TAG_VALUE, 1).cast("double")
    return F.when(line.rlike(R.KEYWORD.java()), pause_seconds(line)).when(line.rlike("(?i)" + R.TAG_VALUE), F.when(tagged == 0, F.lit(15.0)).otherwise(tagged)).when(line.rlike(R.DIRECTION.java()), pause_seconds(line))


def scan_pauses(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, original_text, duration and instruction of each line that asks for a pause."""
    lines = explode_lines(docs.select("doc_id", "text")).withColumnRenamed("line", "original_text").withColumn("line", trim(F.col("original_text")))
    part = lambda i: F.regexp_extract("line", "(?iu)" + R.KEYWORD_PARTS, i)
    is_key = F.col("line").rlike(R.KEYWORD.java())
    rest = F.regexp_replace(part(3), r"^[\s,:–\-]+", "")
    title = F.concat(F.when(part(1) != "", F.concat(part(1), F.lit(" "))).otherwise(F.lit("")), part(2))
    said = F.when(is_key, F.when(rest == "", title).otherwise(F.concat(title, F.lit(" – "), rest))).otherwise(F.concat(F.lit("PAUSE – "), F.col("line")))
    found = lines.withColumn("duration", line_seconds(F.col("line"))).where("duration is not null")
    return found.select("doc_id", "line_no", "original_text", "duration", said.alias("instruction"))


def has_pause(c: Column) -> Column:
    """Whether scan_pauses() finds something in the text."""
    return F.exists(F.split(c, "\n", -1), lambda x: bind(trim(x), lambda y: y.rlike(R.KEYWORD.java()) | y.rlike("(?i)" + R.TAG_VALUE) | y.rlike(R.DIRECTION.java())))


def tagged_line(line: Column, seconds: Column, allow_double: bool = False) -> Column:
    """The line with a tag at its end, if seconds are not null; a tag that it has is set instead, unless allow_double."""
    added = F.concat(line, F.lit(" "), pause_tag(seconds))
    if not allow_double:
        added = F.when(line.rlike("(?i)" + R.TAG_VALUE), F.regexp_replace(line, F.lit("(?i)" + R.TAG_VALUE), pause_tag(seconds))).otherwise(added)
    return F.when(seconds.isNull(), line).otherwise(added)


def tag_pauses(c: Column, edits: Column | None = None) -> Column:
    """The text with a tag on each line that asks for a pause: apply_pauses() of scan_pauses() without leaving the row. edits: a
    map from line to a reviewer's duration, which counts on lines that ask for a pause."""
    of = lambda x, i: line_seconds(trim(x)) if edits is None else F.when(line_seconds(trim(x)).isNotNull(), F.coalesce(F.element_at(edits, i + 1), line_seconds(trim(x))))
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x, i: bind(of(x, i), lambda s: tagged_line(x, s))), "\n")


def by_line(pauses: DataFrame, order: str | None = None) -> DataFrame:
    """doc_id and a map _at from line to duration."""
    of_line = _last(pauses.where("doc_id is not null"), order)
    return of_line.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "duration"))).alias("_at"))


def _last(pauses: DataFrame, order: str | None) -> DataFrame:
    """One row (doc_id, line_no, duration) for each line: the last by `order`, of equals (or without an order) the longest."""
    by = F.struct(F.col(order) if order else F.lit(0), F.col("duration"))
    return pauses.where("duration is not null").groupBy("doc_id", "line_no").agg(F.max_by("duration", by).alias("duration"))


def override_durations(pauses: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """A reviewer's durations (doc_id, line_no, duration) where there are any; of several for a line the last by `order`."""
    new = _last(edits, order).withColumnRenamed("duration", "_new")
    return pauses.join(new, ["doc_id", "line_no"], "left").withColumn("duration", F.coalesce("_new", "duration")).drop("_new").select(*pauses.columns)


def set_all(pauses: DataFrame, seconds: float) -> DataFrame:
    return pauses.withColumn("duration", F.lit(float(seconds)))


def apply_pauses(docs: DataFrame, pauses: DataFrame, allow_double: bool = False, order: str | None = None) -> DataFrame:
    """docs (all columns and rows, whatever their ids) with each pause's tag at the end of its line; of several for a line the last
    by the column `order` of pauses wins. A tag that the line already has is set to the duration instead, unless allow_double.

    A document's pauses meet its text once, as a map from line to duration; its lines never leave the row."""
    done = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: bind(F.element_at("_at", i + 1), lambda s: tagged_line(x, s, allow_double))), "\n")
    joined = docs.join(by_line(pauses, order), "doc_id", "left").withColumn("text", F.when(F.col("_at").isNull(), F.col("text")).otherwise(done))
    return joined.select(*docs.columns)


def pause_warnings(docs: DataFrame, pauses: DataFrame) -> DataFrame:
    """doc_id, n_pauses, n_short (below 2 s), n_long (above 1800 s) and the warnings, for every document."""
    n = pauses.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("duration") < 2).alias("s"), F.count_if(F.col("duration") > 1800).alias("l"))
    of = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    df = docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", of("n").alias("n_pauses"), of("s").alias("n_short"), of("l").alias("n_long"))
    text = F.array_compact(F.array(F.when(F.col("n_pauses") == 0, F.lit("none found")), F.when(F.col("n_short") > 0, F.concat(F.col("n_short").cast("string"), F.lit(" below 2 s"))), F.when(F.col("n_long") > 0, F.concat(F.col("n_long").cast("string"), F.lit(" above 1800 s")))))
    return df.withColumn("warnings", F.array_join(text, "; "))


def pause_summary(pauses: DataFrame) -> DataFrame:
    return pauses.groupBy("doc_id").agg(F.count("*").alias("n_pauses"), (F.floor(F.avg("duration") * 10 + 0.5) / 10).alias("mean_s"), F.sum("duration").alias("total_s"))


def is_script(c: Column) -> Column:
    """Whether any line is or begins with a direction; shortcodes count unless in hours."""
    code = "(?iu)" + R.SHORTCODE.replace("|Stunden?|Std\\.?|s|m|h)", "|s|m)")
    return F.exists(F.split(c, "\n", -1), lambda x: x.rlike(R.KEYWORD_BEGINS.java()) | x.rlike("(?i)" + R.TAG_VALUE) | x.rlike(code) | x.rlike(R.DIRECTION_BEGINS.java()))


def route(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with script lines, and those without (null texts are among these)."""
    script = F.coalesce(is_script(F.col("text")), F.lit(False))
    return docs.where(script), docs.where(~script)
