"""Rules as data. Each can be rendered for Spark (Java patterns) and for SQL engines with RE2 patterns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers have it, for classes of both pattern languages.
SPACES = r"\s\x0B\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SP = f"[{SPACES}]"


def quoted(text: str) -> str:
    """A pattern for the text itself, in both pattern languages."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-/&~#])", r"\\\1", text)


@cache
def folds() -> dict[int, str]:
    """Characters whose case is ignored, and what they are compared as: the lower case of their upper case, one for one, which is how
    the JVM's patterns compare."""
    out = {}
    for i in range(0x20000):
        if not 0xD800 <= i < 0xE000:
            up = chr(i).upper()
            low = (up if len(up) == 1 else chr(i)).lower()[0]
            if low != chr(i):
                out[i] = low
    return out


def folded(text: str) -> str:
    """As many characters, without case."""
    return text.lower() if text.isascii() else text.translate(folds())


def any_case(text: str) -> str:
    """A Java pattern, with (?iu), for the text itself. The engine treats single characters otherwise than those in words, so these are
    listed with all that are the same without case."""
    if len(text) != 1:
        return quoted(text)
    low = folded(text)
    return "[" + "".join(quoted(x) for x in sorted({low, *(chr(i) for i, to in folds().items() if to == low)})) + "]"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Rule:
    """One replacement. flags: i ignores case (also beyond ASCII), m lets ^ and $ match at lines (ended by \\n alone).

    needs: a text without any of these strings can't match, so it is passed over without a search. sign: the same as a Java
    pattern, cheaper than the rule's own.
    """

    pattern: str
    replacement: str = ""
    flags: str = ""
    needs: tuple[str, ...] = ()
    sign: str = ""

    def java(self) -> str:
        f = ("iu" if "i" in self.flags else "") + ("dm" if "m" in self.flags else "")
        return (f"(?{f})" if f else "") + self.pattern

    def re2(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + self.pattern

    def may_match(self, c: Column) -> Column | None:
        found = [F.contains(c, F.lit(x)) for x in self.needs] + ([c.rlike(self.sign)] if self.sign else [])
        return reduce(lambda a, b: a | b, found) if found else None

    def on(self, c: Column) -> Column:
        """The replacement in c, which is used more than once: a bound variable or a column of a table."""
        done, may = F.regexp_replace(c, F.lit(self.java()), F.lit(self.replacement)), self.may_match(c)
        return done if may is None else F.when(may, done).otherwise(c)

    def sql(self, e: str) -> str:
        return f"regexp_replace({e}, {sql_text(self.re2())}, {sql_text(re.sub(r'[$]([0-9])', r'\\\1', self.replacement))}, 'g')"

    def count(self, c: Column) -> Column:
        n, may = F.regexp_count(c, F.lit(self.java())).cast("bigint"), self.may_match(c)
        return n if may is None else F.when(may, n).when(c.isNotNull(), F.lit(0).cast("bigint"))

    def count_sql(self, e: str) -> str:
        return f"CAST(len(regexp_extract_all({e}, {sql_text(self.re2())})) AS BIGINT)"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def apply(rules: list[Rule], c: Column) -> Column:
    for r in rules:
        c = bind(c, r.on) if r.needs or r.sign else r.on(c)
    return c


def apply_sql(rules: list[Rule], e: str) -> str:
    for r in rules:
        e = r.sql(e)
    return e


# ---------------------------------------------------------------- cleaning
#: Fixed values, from here to TRIM: what each rule matches and puts in its place.

END_OF_LINES = [Rule("\\r\\n?", "\n", needs=("\r",))]
PAGE_NUMBERS = [Rule(f"^{SP}*\\d+{SP}*$", "", "m", sign="\\d")]
RULE_LINES = [Rule(f"^{SP}*[-_]{{3,}}{SP}*$", "", "m", sign="[-_]{3}")]
CONTENTS = [Rule(f"^.*\\.{{3,}}.*\\d+{SP}*$", "", "m", needs=("...",))]
CHAPTERS = [Rule(f"^(Kapitel|Chapter|Teil|Part|Abschnitt|Section){SP}+\\d+.*$", "", "im", sign="\\d")]
LISTS = [Rule(f"^[\\-*•]{SP}+(.*)$", "$1, ", "m", needs=("-", "*", "•"))]
HYPHENS = [Rule(f"([a-zäöüß])-{SP}*\\n{SP}*([a-zäöüß])", "$1$2", "i", needs=("-",))]
HYPHENS_STRICT = [Rule(f"([a-zA-ZäöüÄÖÜß])-{SP}*\\n{SP}*([a-zA-ZäöüÄÖÜß])", "$1$2", needs=("-",))]
URLS = [Rule(f"{SP}*((https?://|www\\.)[^{SPACES}]*[^.,?!:;\"'›»{SPACES})\\]}}>])", "", "i", needs=("://",), sign="(?i)www\\.")]
EMAILS = [Rule(f"{SP}*([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}})", needs=("@",))]
REFERENCES = [
    Rule(f"\\[\\d+(?:[\\-,{SPACES}]+\\d+)*\\]", needs=("[",)),
    Rule(f"\\([A-Za-z\\x{{C0}}-\\x{{17F}}.&{SPACES}]+,?{SP}+(?:19|20)\\d{{2}}(?::{SP}?\\d+)?\\)", needs=("(",)),
    Rule(f"\\((?:vgl\\.|siehe|see){SP}+[^\\n)]*\\)", "", "i", needs=("(",)),
]
TYPOGRAPHY = [
    Rule(" {2,}", " ", needs=("  ",)),
    Rule("\\n{3,}", "\n\n", needs=("\n\n\n",)),
    Rule(f"{SP}+([.,!?;:])", "$1", sign=f"[.,!?;:](?<={SP}.)"),
    Rule(f"\\({SP}+", "(", sign=f"\\({SP}"),
    Rule(f"{SP}+\\)", ")", sign=f"\\)(?<={SP}.)"),
]
DECIMALS = [Rule("(\\d+)\\.(\\d+)", "$1 Punkt $2", sign="\\d\\.\\d")]
PAUSE_TAG = Rule(f"\\[PAUSE{SP}+[\\d.]+s\\]", "", "i")
REMOVE_TAGS = [Rule(f"{SP}*\\[PAUSE{SP}+[\\d.]+s\\]{SP}*", " ", "i"), Rule(f"{SP}{{2,}}", " ")]
CONTROL = [Rule("[\\x00-\\x09\\x0B-\\x1F\\x7F]")]
_UNSEEN = "[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{FFFD}\\x0B\\x0C\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
INVISIBLE = [Rule(_UNSEEN, " ", sign=f"[^\\x00-\\x0A\\x0D-\\x7F](?<={_UNSEEN})")]
COLLAPSE = [Rule("[ \\t]+", " ", needs=("  ", "\t")), Rule(" +$", "", "m", sign=" (?=\\n|\\z)")]
#: Code fences, quotes around all, preambles, closing remarks, emphasis.
BOILERPLATE = [
    Rule(f"```(?:json|text|markdown|plaintext|xml|html)?{SP}*", "", "i", needs=("```",)),
    Rule(f"{SP}*```", needs=("```",)),
    Rule("^[\"']([\\x{0}-\\x{10FFFF}]*)[\"']$", "$1", "m"),
    Rule(f"\\A(?:Hier ist|Here is)[^:\\n]*:?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Der bereinigte Text|The cleaned text)[^:\\n]*:?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Gerne|Sure|Of course|Certainly)[^.:\\n]*[.:]?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Hier|Here)[^:\\n]*(?:der|the)[^:\\n]*:?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Natürlich|Selbstverständlich)[^.:\\n]*[.:]?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Okay|OK)[,.]?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Ich habe|I have)[^:\\n]*:?{SP}*\\n*", "", "i"),
    Rule(f"\\A(?:Der Text|The text)[^:\\n]*:?{SP}*\\n*", "", "i"),
    Rule(f"\\n*(?:Hinweis|Note|Anmerkung)[:{SPACES}][^\\n]*\\z", "", "i"),
    Rule(f"\\n*(?:Ich habe|I have)[^.]*\\.?{SP}*\\z", "", "i"),
    Rule("\\*\\*([^*]+)\\*\\*", "$1", needs=("**",)),
    Rule("__([^_]+)__", "$1", needs=("__",)),
    Rule(f"(?<={SP})\\*([^*\\n]+)\\*(?={SP}|\\z)", "$1", needs=("*",)),  # Java alone: RE2 can't look around
    Rule(f"\\A{SP}+|{SP}+\\z"),
]
TRIM = [Rule(f"\\A{SP}+|{SP}+\\z")]
#: The characters of SP.
BLANKS = " \t\n\x0b\x0c\r\xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Abbreviations and what they stand for, in order.
ABBREVIATIONS = [
    ("z.B.", "zum Beispiel"),
    ("d.h.", "das heißt"),
    ("ggf.", "gegebenenfalls"),
    ("bzw.", "beziehungsweise"),
    ("etc.", "et cetera"),
    ("ca.", "circa"),
    ("u.a.", "unter anderem"),
    ("u.U.", "unter Umständen"),
    ("o.Ä.", "oder Ähnliches"),
    ("usw.", "und so weiter"),
    ("i.d.R.", "in der Regel"),
    ("i.d.S.", "in diesem Sinne"),
    ("i.S.v.", "im Sinne von"),
    ("z.T.", "zum Teil"),
    ("v.a.", "vor allem"),
    ("sog.", "sogenannt"),
    ("bzgl.", "bezüglich"),
    ("evtl.", "eventuell"),
    ("inkl.", "inklusive"),
    ("exkl.", "exklusive"),
    ("Nr.", "Nummer"),
    ("Art.", "Artikel"),
    ("Abs.", "Absatz"),
    ("Kap.", "Kapitel"),
    ("Abb.", "Abbildung"),
    ("vgl.", "vergleiche"),
    ("s.", "siehe"),
    ("ff.", "fortfolgende"),
    ("Dr.", "Doktor"),
    ("Prof.", "Professor"),
    ("Hr.", "Herr"),
    ("Fr.", "Frau"),
    ("min.", "Minute"),
    ("max.", "maximal"),
    ("Std.", "Stunde"),
    ("tgl.", "täglich"),
    ("mtl.", "monatlich"),
    ("zzgl.", "zuzüglich"),
    ("abzgl.", "abzüglich"),
    ("gem.", "gemäß"),
    ("lt.", "laut"),
    ("b.A.", "bei Bedarf"),
    ("o.g.", "oben genannt"),
    ("s.u.", "siehe unten"),
    ("s.o.", "siehe oben"),
    ("dgl.", "dergleichen"),
    ("o.J.", "ohne Jahr"),
    ("n.Chr.", "nach Christus"),
    ("v.Chr.", "vor Christus"),
    ("bspw.", "beispielsweise"),
    ("Fa.", "Firma"),
    ("Str.", "Straße"),
    ("Tel.", "Telefon"),
    ("Stk.", "Stück"),
]
#: Abbreviations whose case doesn't matter.
ANY_CASE = ("o.Ä.", "Kap.", "vgl.")
#: Words spelled as they are spoken.
PHONETIC = {"Chakra": "Tschakra", "Chakren": "Tschakren", "Chakras": "Tschakras", "Regisseur": "Reschissör", "Regisseure": "Reschissöre", "Regime": "Reschim", "Regie": "Reschi", "Manche": "Mannche"}
#: No sentence ends after these.
GUARD = ("Dr", "Prof", "Jr", "Sr", "Ph.D", "M.D", "B.Sc", "M.Sc", "z.B", "d.h", "u.a", "u.U", "usw", "etc", "ca", "bzw", "vgl", "Abb", "Nr", "Kap", "S", "St", "Str", "Mr", "Mrs", "Ms", "Co", "Inc", "Ltd", "Corp")


def abbreviations() -> list[tuple[str, str]]:
    return ABBREVIATIONS


def abbreviation_rule(label: str, spoken: str) -> Rule:
    """For SQL: what stands before is captured, as RE2 has no look-behind."""
    tail, after = (SP, "siehe ") if label == "s." else ("", spoken)
    return Rule(f"(^|[^\\p{{L}}\\p{{N}}_]){quoted(label)}{tail}", f"$1{after}", "i" if label in ANY_CASE else "")


# ---------------------------------------------------------------- scripts and pauses
#: How scripts write directions and durations.

KEYWORD = Rule("^(?:(?:KURZE|LANGE|KLEINE|GROSSE)[\\s]+)?(?:PAUSE|STILLE|NACHSPÜREN)(?:[^\\p{L}\\p{N}_].*)?$", "", "i")
KEYWORD_BEGINS = Rule(f"^{SP}*(?:(?:KURZE|LANGE|KLEINE|GROSSE){SP}+)?(?:PAUSE|STILLE|NACHSPÜREN)(?![\\p{{L}}\\p{{N}}_])", "", "i")
KEYWORD_PARTS = "^(?:(KURZE|LANGE|KLEINE|GROSSE)[\\s]+)?(PAUSE|STILLE|NACHSPÜREN)((?:[^\\p{L}\\p{N}_].*)?)$"
TAG_VALUE = "\\[PAUSE\\s+(\\d+(?:\\.\\d+)?)s\\]"
DIRECTION = Rule("^\\s*[(\\[]\\s*(?:pause|stille|nachspüren)[^)\\]]*[)\\]]\\s*$", "", "i")
DIRECTION_BEGINS = Rule("^\\s*[(\\[]\\s*(?:pause|stille|nachspüren)", "", "i")
DIRECTION_IN = Rule("[(\\[]\\s*(?:pause|stille|nachspüren)[^)\\]]*[)\\]]", "", "i")
SHORTCODE = "[(\\[]\\s*(?:Pause:?\\s*)?(\\d+(?:[.,]\\d+)?)\\s*(Minuten?|Min\\.?|Sekunden?|Sek\\.?|Stunden?|Std\\.?|s|m|h)\\s*[)\\]]"
#: Spelled-out minutes and seconds.
WORD_MINUTES = [("eine?|eins", 60), ("zwei", 120), ("drei", 180), ("vier", 240), ("fünf", 300), ("zehn", 600), ("fünfzehn", 900), ("zwanzig", 1200), ("dreißig", 1800)]
WORD_SECONDS = [("eine?|eins", 1), ("zwei", 2), ("drei", 3), ("fünf", 5), ("zehn", 10), ("zwanzig", 20), ("dreißig", 30)]
#: Unit patterns and their seconds, first hit wins.
NUMBER_UNITS = [("(?:minuten?|min\\.?)", 60.0), ("(?:sekunden?|sek\\.?|s(?:[^\\p{L}\\p{N}_]|$))", 1.0), ("(?:stunden?|std\\.?|h(?:[^\\p{L}\\p{N}_]|$))", 3600.0)]

#: counter: (category, rules, option that must be on, or None)
COUNTERS = {
    "page numbers": ("Strukturentfernung", PAGE_NUMBERS, None),
    "rule lines": ("Strukturentfernung", RULE_LINES, None),
    "contents": ("Strukturentfernung", CONTENTS, "contents"),
    "chapters": ("Strukturentfernung", CHAPTERS, "chapters"),
    "urls": ("Inhaltsentfernung", URLS, "urls"),
    "emails": ("Inhaltsentfernung", EMAILS, "emails"),
    "references": ("Inhaltsentfernung", REFERENCES, "references"),
    "hyphenation": ("Typografie", HYPHENS, "hyphens"),
    "typography": ("Typografie", [TYPOGRAPHY[0], TYPOGRAPHY[2], TYPOGRAPHY[3], TYPOGRAPHY[4]], "typography"),
    "blank lines": ("Formatkorrektur", [TYPOGRAPHY[1]], "typography"),
    "list items": ("Inhaltsumwandlung", LISTS, "lists"),
}
