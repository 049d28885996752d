"""Whole chains: rule cleaning, and texts made ready for speech."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import pauses as P
from lectern.functions import text as T
from lectern.functions.rules import bind


@dataclass(frozen=True)
class CleaningOptions:
    """What the plan holds; a rule that is off never enters it."""

    chapters: bool = True
    lists: bool = True
    hyphens: bool = True
    contents: bool = True
    urls: bool = True
    emails: bool = True
    references: bool = True
    typography: bool = True
    phonetic: bool = True
    boilerplate: bool = False
    script: bool = False
    replacements: tuple[tuple[str, str], ...] = ()
    words: dict[str, str] | None = None
    pauses: P.PauseConfig = field(default_factory=P.PauseConfig)


def clean(c: Column, o: CleaningOptions = CleaningOptions()) -> Column:
    standard = not o.script
    steps = [
        (bool(o.replacements), lambda x: T.custom_replacements(x, o.replacements)),
        (True, T.expand_abbreviations),
        (True, T.normalize_eol),
        (True, T.drop_page_numbers),
        (True, T.drop_rules),
        (standard and o.contents, T.drop_toc),
        (standard and o.chapters, T.drop_chapter_markers),
        (o.lists, T.lists_to_prose),
        (o.hyphens, T.join_hyphenation),
        (standard and o.urls, T.drop_urls),
        (standard and o.emails, T.drop_emails),
        (standard and o.references, T.drop_references),
        (o.typography, T.fix_typography),
        (True, T.speak_decimals),
        (o.boilerplate, T.strip_assistant_boilerplate),
        (o.phonetic, lambda x: T.phonetic(x, o.words)),
    ]
    for on, step in steps:
        # each step's input is bound, as a step may use it more than once
        c = bind(c, step) if on else c
    return c


def prepare_standard(docs: DataFrame, o: CleaningOptions = CleaningOptions()) -> DataFrame:
    """docs with texts cleaned, sanitized and given pauses: one narrow stage, in which only texts that may not be in NFC go
    to Python between cleaning and sanitizing."""
    cleaned = docs.withColumn("text", clean(F.col("text"), o))
    return cleaned.withColumn("text", bind(T.nfc(F.col("text")), lambda t: P.inject_pauses(T.sanitize_composed(t), o.pauses)))


def prepare_script(docs: DataFrame, edits: DataFrame | None = None, o: CleaningOptions = CleaningOptions(script=True)) -> DataFrame:
    """docs with script texts cleaned, sanitized and tagged on their pause lines, and has_pause. Stage lines are cleaned by no rule, but
    are spelled as they are spoken like the rest. One narrow stage; a reviewer's edits (doc_id, line_no, duration) join as a map for
    each document."""
    written, spoken = replace(o, phonetic=False), (lambda x: T.phonetic(x, o.words)) if o.phonetic else (lambda x: x)
    restored = lambda p: bind(clean(p["text"], written), lambda x: T.restore_lines(x, p["saved"]))
    step = lambda c: bind(bind(bind(P.normalize_shortcodes(c), T.protect_lines), restored), spoken)
    df = docs if edits is None else docs.join(P.by_line(edits), "doc_id", "left")
    df = df.withColumn("text", step(F.col("text")))
    at = None if edits is None else F.col("_at")
    done = df.withColumn("_done", bind(T.nfc(F.col("text")), lambda t: bind(T.sanitize_composed(t), lambda x: F.struct(P.tag_pauses(x, at).alias("text"), F.coalesce(P.has_pause(x), F.lit(False)).alias("has")))))
    return done.withColumn("text", F.col("_done.text")).withColumn("has_pause", F.col("_done.has")).select(*docs.columns, "has_pause")
