"""Text operators as columns: cleaning and sanitizing. No shuffle, and no Python worker but for nfc().

A rule that looks at its text before it searches it uses it more than once, so rules take a column of a table or a bound
variable; apply() binds between rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lectern.functions import rules as R
from lectern.functions.rules import apply, bind


def replace_by(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Each match m of the pattern (which never matches nothing) becomes f(m)."""
    p = F.lit(pattern)
    parts = F.zip_with(F.split(c, pattern, -1), F.transform(F.regexp_extract_all(c, p, 0), lambda m: f(m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(parts, "")


def custom_replacements(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal, case-insensitive replacements, one after another; empty searches are skipped."""
    for search, replacement in pairs:
        if search:
            c = F.regexp_replace(c, F.lit("(?iu)" + R.any_case(search)), F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))
    return c


def expand_abbreviations(c: Column) -> Column:
    """All abbreviations in one pass, longest first, behind one guard that most texts don't pass."""
    table = R.abbreviations()
    alternatives = "|".join(("(?iu:%s)" if label in R.ANY_CASE else "%s") % (R.quoted(label) + (R.SP if label == "s." else "")) for label, _ in sorted(table, key=lambda x: -len(x[0])))
    pattern = f"(?<![a-z])(?<![\\p{{L}}\\p{{N}}_])(?:{alternatives})"  # small letters first, which are quick to rule out
    spoken = F.create_map(*[F.lit(x) for label, to in table for x in ((label.lower() if label in R.ANY_CASE else label), to)])
    any_case = F.array(*[F.lit(x.lower()) for x in R.ANY_CASE])
    of = lambda m: F.when(m.startswith("s.") & (F.length(m) == 3) & ~m.isin("s.u", "s.o"), F.lit("siehe ")).otherwise(F.coalesce(F.element_at(spoken, m), F.when(F.array_contains(any_case, F.lower(m)), F.element_at(spoken, F.lower(m))), m))
    return F.when(c.rlike(abbreviation_sign()), replace_by(c, pattern, of)).otherwise(c)


def abbreviation_sign() -> str:
    """A pattern that every text with an abbreviation matches: a first full stop behind first letters. Full stops are few, so it
    is a cheap look."""
    stems = sorted({(label.split(".")[0], label in R.ANY_CASE) for label, _ in R.abbreviations()}, key=lambda x: (-len(x[0]), x))
    stem = "|".join(("(?iu:%s)" if any_case else "%s") % R.quoted(x) for x, any_case in stems)
    return f"\\.(?<=(?<![a-z])(?<![\\p{{L}}\\p{{N}}_])(?:{stem})\\.)"


def phonetic(c: Column, words: dict[str, str] | None = None) -> Column:
    """Whole words, ignoring case; a capital first letter stays. Pause tags and protected marks match first and stay."""
    words = R.PHONETIC if words is None else words
    if not words:
        return c
    known = "|".join(R.quoted(w) for w in sorted(words, key=lambda w: -len(w)))
    first = "".join(sorted({R.any_case(w[0])[1:-1] for w in words}))
    whole = f"(?<![\\p{{L}}\\p{{N}}_])(?:{known})(?![\\p{{L}}\\p{{N}}_])"
    # a look at the first letter is quick
    pattern = f"(?=[{first}\\[])(?iu:\\[PAUSE\\s+[\\d.]+s\\]|\\[\\[PROTECTED_[^\\]]*\\]\\]|{whole})"
    table = F.create_map(*[F.lit(x) for w, to in words.items() for x in (w.lower(), to)])

    def spoken(m: Column) -> Column:
        to = F.element_at(table, F.lower(m))
        first = F.substring(m, 1, 1)
        return F.when(to.isNull(), m).when(first == F.upper(first), F.concat(F.upper(F.substring(to, 1, 1)), to.substr(F.lit(2), F.length(to)))).otherwise(F.lower(to))

    return F.when(c.rlike(f"(?=[{first}])(?iu:{whole})"), replace_by(c, pattern, spoken)).otherwise(c)


def normalize_eol(c: Column) -> Column:
    return apply(R.END_OF_LINES, c)


def drop_page_numbers(c: Column) -> Column:
    return apply(R.PAGE_NUMBERS, c)


def drop_rules(c: Column) -> Column:
    return apply(R.RULE_LINES, c)


def drop_toc(c: Column) -> Column:
    return apply(R.CONTENTS, c)


def drop_chapter_markers(c: Column) -> Column:
    return apply(R.CHAPTERS, c)


def lists_to_prose(c: Column) -> Column:
    return apply(R.LISTS, c)


def join_hyphenation(c: Column) -> Column:
    return apply(R.HYPHENS, c)


def drop_urls(c: Column) -> Column:
    return apply(R.URLS, c)


def drop_emails(c: Column) -> Column:
    return apply(R.EMAILS, c)


def drop_references(c: Column) -> Column:
    return apply(R.REFERENCES, c)


def fix_typography(c: Column) -> Column:
    return apply(R.TYPOGRAPHY, c)


def speak_decimals(c: Column) -> Column:
    return apply(R.DECIMALS, c)


def strip_assistant_boilerplate(c: Column) -> Column:
    return apply(R.BOILERPLATE, c)


def trim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(R.BLANKS))


def is_stage(line: Column) -> Column:
    """Whether a line is a stage direction."""
    return trim(line).rlike(R.KEYWORD.java()) | line.rlike("(?i)" + R.TAG_VALUE) | line.rlike(R.DIRECTION_IN.java())


def protect_lines(c: Column) -> Column:
    """struct(text, saved): stage lines become marks [[PROTECTED_i]], and are saved in order."""
    lines = F.split(c, "\n", -1)
    flagged = F.transform(lines, lambda x: F.struct(x.alias("line"), is_stage(x).alias("stage")))
    step = lambda a, x: F.struct(F.concat(a["n"], F.when(x["stage"], F.array(F.concat(F.lit("[[PROTECTED_"), F.size(a["s"]).cast("string"), F.lit("]]")))).otherwise(F.array(x["line"]))).alias("n"), F.when(x["stage"], F.array_append(a["s"], x["line"])).otherwise(a["s"]).alias("s"))
    none = F.array().cast("array<string>")
    return F.aggregate(flagged, F.struct(none.alias("n"), none.alias("s")), step, lambda a: F.struct(F.array_join(a["n"], "\n").alias("text"), a["s"].alias("saved")))


def restore_lines(c: Column, saved: Column) -> Column:
    """The saved lines in place of their marks."""
    return replace_by(c, r"\[\[PROTECTED_\d+\]\]", lambda m: F.coalesce(F.get(saved, F.regexp_extract(m, r"(\d+)", 1).cast("int")), m))


def search_replace(c: Column, search: str, replacement: str, regex: bool = False) -> Column:
    """struct(text, n_hits), ignoring case. A pattern that is none for the JVM, or nothing to search, has no hits. In the
    replacement of a pattern $1, $<name> and $& stand for what was found, $$ for a sign; what names no group is text."""
    pattern = "(?iu)" + (search if regex else R.quoted(search))
    if not search or (regex and not _is_pattern(pattern)):
        return F.struct(c.alias("text"), F.lit(0).cast("bigint").alias("n_hits"))
    to = _groups_put(search, replacement) if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.struct(F.regexp_replace(c, F.lit(pattern), F.lit(to)).alias("text"), F.regexp_count(c, F.lit(pattern)).cast("bigint").alias("n_hits"))


def _is_pattern(pattern: str) -> bool:
    """Whether the engine that will run it takes the pattern: it is tried on no text, in a plan of one row."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active().range(1).select(F.regexp_count(F.lit(""), F.lit(pattern))).collect()
    except PySparkException:
        return False
    return True


def _groups_put(search: str, replacement: str) -> str:
    """The replacement in the JVM's terms."""
    groups = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|(\((?!\?)|\(\?<(?![=!])([A-Za-z][A-Za-z0-9]*)>)", search, re.S)
    count, names = sum(bool(g) for g, _ in groups), {n for _, n in groups if n}

    def put(m: re.Match) -> str:
        x = m[0]
        if x == "$$":
            return "\\$"
        if x == "$&":
            return "$0"
        if m[1]:
            for k in (len(m[1]), 1):
                if 1 <= int(m[1][:k]) <= count:
                    return f"${int(m[1][:k])}" + "".join("\\" + d for d in m[1][k:])
        if m[2] and m[2] in names:
            return f"${{{m[2]}}}"
        return "".join("\\" + ch if ch in "\\$" else ch for ch in x)

    return re.sub(r"\$\$|\$&|\$(\d{1,2})|\$<([A-Za-z][A-Za-z0-9]*)>|[\\$]", put, replacement)


# ---------------------------------------------------------------- sanitizing

_HIGH = r"[^\x{00}-\x{2FF}]"
LETTERS = {"german": "[a-zA-Z0-9äöüÄÖÜß]", "unicode": r"[\p{L}\p{N}]"}


@pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: Said to be nondeterministic, so that no filter is pushed below it and it is never worked out twice.
_composed = _composed.asNondeterministic()


def nfc(c: Column) -> Column:
    """c, a column of a table, in Unicode NFC. Below U+0300 nothing changes, so only other texts go to Python."""
    return F.coalesce(_composed(F.when(c.rlike(_HIGH), c)), c)


def invisible_to_space(c: Column) -> Column:
    return apply(R.INVISIBLE, c)


def join_hyphenation_strict(c: Column) -> Column:
    return apply(R.HYPHENS_STRICT, c)


def drop_ghost_lines(c: Column, letters: str = "german") -> Column:
    """Without page lines, and without lines that are not blank but hold no letter or digit."""
    page = f"(?iu)^{R.SP}*(?:Seite|Page){R.SP}*\\d+{R.SP}*\\z"
    keep = lambda x: F.when(x.rlike(LETTERS[letters]), ~x.rlike(page)).otherwise(~x.rlike(f"[^{R.SPACES}]"))
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: keep(x)), "\n")


def drop_control(c: Column) -> Column:
    return apply(R.CONTROL, c)


def collapse_space(c: Column) -> Column:
    return apply(R.COLLAPSE, c)


def paragraphs(c: Column, letters: str = "german") -> Column:
    """Trimmed paragraphs that hold a letter or digit."""
    return F.filter(F.transform(F.split(c, r"\n{2,}", -1), lambda p: trim(p)), lambda p: p.rlike(LETTERS[letters]))


def paragraph_filter(c: Column, letters: str = "german") -> Column:
    return F.array_join(paragraphs(c, letters), "\n\n")


#: What a strip takes off at the ends of pieces.
_BLANK = " \t\n\x0b\f\r"
#: Steps of a fold within which its pieces are held apart.
_STEPS = 64


def cut_up(t: Column, most: int, least: int, cut: Callable[[Column], Column], strip: bool = False) -> Column:
    """Pieces of t: while what is left has more than `most` characters, its first cut(it), more than `least`, are one. cut looks at
    the first `most` alone. strip: without blanks at both ends of each piece, where t itself has none at its own.

    The text is dealt out once, by patterns, in parts of `least` characters; a fold adds one part to what is left and then has
    one piece to cut at most. No step looks at more than most + least characters, so the work is in proportion to the text.
    """
    size, blank = max(1, least), F.lit(_BLANK)
    none = F.array().cast("array<string>")
    parts = lambda x, n: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))

    def one(rest: Column, pieces: Column) -> Column:
        piece, after = (lambda k: F.left(rest, k)), (lambda k: F.substr(rest, k + 1))
        cut_one = lambda k: F.struct((F.ltrim(after(k), blank) if strip else after(k)).alias("r"), F.array_append(pieces, F.btrim(piece(k), blank) if strip else piece(k)).alias("o"))
        return F.when(F.length(rest) > most, bind(cut(rest), cut_one)).otherwise(F.struct(rest.alias("r"), pieces.alias("o")))

    def add(a: Column, part: Column) -> Column:
        longer = F.concat(a["r"], part)
        return bind(F.ltrim(longer, blank) if strip else longer, lambda rest: one(rest, a["o"]))

    def some(a: Column, block: Column) -> Column:
        done = F.aggregate(parts(block, size), F.struct(a["r"].alias("r"), none.alias("o")), add)
        return bind(done, lambda x: F.struct(x["r"].alias("r"), F.array_append(a["o"], x["o"]).alias("o")))

    start = F.struct(F.lit("").alias("r"), F.array().cast("array<array<string>>").alias("o"))
    return F.aggregate(parts(t, size * _STEPS), start, some, lambda a: F.flatten(F.array_append(a["o"], F.when(F.length(a["r"]) > 0, F.array(a["r"])).otherwise(none))))


def split_long_paragraph(p: Column, most: int = 1000, window: int = 300) -> Column:
    """Pieces of a paragraph: cut at the first sentence end in the last `window` characters allowed, else the first
    clause end, else the last blank, else hard."""
    least = most - window

    def cut(r: Column) -> Column:
        return bind(F.substring(r, least + 1, window), lambda w: F.when(F.regexp_instr(w, F.lit(r"[.!?]\s")) > 0, least + F.regexp_instr(w, F.lit(r"[.!?]\s"))).when(F.regexp_instr(w, F.lit(r"[;:]\s")) > 0, least + F.regexp_instr(w, F.lit(r"[;:]\s"))).when(F.contains(w, F.lit(" ")), least + F.length(F.regexp_extract(w, r"^([\s\S]*) ", 1))).otherwise(F.lit(most)))

    strip = lambda x: F.btrim(x, F.lit(_BLANK))
    # what follows the first cut has no blanks at its ends
    many = lambda k: F.concat(F.array(strip(F.left(p, k))), bind(strip(F.substr(p, k + 1)), lambda rest: cut_up(rest, most, least, cut, strip=True)))
    return F.when(F.length(p) <= most, F.filter(F.array(p), lambda x: F.length(x) > 0)).otherwise(bind(cut(p), many))


def sanitize_composed(c: Column, letters: str = "german") -> Column:
    """sanitize() of a text that is in NFC."""
    c = drop_ghost_lines(join_hyphenation_strict(normalize_eol(invisible_to_space(c))), letters)
    c = paragraphs(collapse_space(drop_control(c)), letters)
    return F.array_join(F.flatten(F.transform(c, lambda p: split_long_paragraph(p))), "\n\n")


def sanitize(c: Column, letters: str = "german") -> Column:
    """All of this part in order. c: a column of a table."""
    return bind(nfc(c), lambda t: sanitize_composed(t, letters))
