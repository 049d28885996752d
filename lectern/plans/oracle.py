"""SQL of the text operators. Patterns that are long and alike in Java and RE2 come from the catalogue of rules; those of scripts,
issues, sanitizing and boilerplate, where a wrong pattern would otherwise pass unseen, are written out here."""

from __future__ import annotations

from lectern.functions import rules as R
from lectern.functions.rules import apply_sql, sql_text
from lectern.operators.analytics import PRICE_IN, PRICE_OUT, WORDS_PER_MINUTE
from lectern.plans.corpus import DRESSED

EDGE = "[^\\p{L}\\p{N}_]"
LETTERS = "[a-zA-Z0-9äöüÄÖÜß]"


#: Written out, not taken from the rules.
KEY = "(?i)^(?:(?:KURZE|LANGE|KLEINE|GROSSE)\\s+)?(?:PAUSE|STILLE|NACHSPÜREN)(?:[^\\p{L}\\p{N}_].*)?$"
KEY_PARTS = "(?i)^(?:(KURZE|LANGE|KLEINE|GROSSE)\\s+)?(PAUSE|STILLE|NACHSPÜREN)((?:[^\\p{L}\\p{N}_].*)?)$"
KEY_BEGINS = f"(?i)^{R.SP}*(?:(?:KURZE|LANGE|KLEINE|GROSSE){R.SP}+)?(?:PAUSE|STILLE|NACHSPÜREN)(?:[^\\p{{L}}\\p{{N}}_]|$)"
TAG = "(?i)\\[PAUSE\\s+(\\d+(?:\\.\\d+)?)s\\]"
WHOLE_DIRECTION = "(?i)^\\s*[(\\[]\\s*(?:pause|stille|nachspüren)[^)\\]]*[)\\]]\\s*$"
DIRECTION_BEGINS = "(?i)^\\s*[(\\[]\\s*(?:pause|stille|nachspüren)"
CODE = "(?i)[(\\[]\\s*(?:Pause:?\\s*)?(\\d+(?:[.,]\\d+)?)\\s*(Minuten?|Min\\.?|Sekunden?|Sek\\.?|Stunden?|Std\\.?|s|m|h)\\s*[)\\]]"
CODE_BUT_HOURS = "(?i)[(\\[]\\s*(?:Pause:?\\s*)?\\d+(?:[.,]\\d+)?\\s*(?:Minuten?|Min\\.?|Sekunden?|Sek\\.?|s|m)\\s*[)\\]]"
UNITS = [("(?:minuten?|min\\.?)", 60.0), ("(?:sekunden?|sek\\.?|s(?:[^\\p{L}\\p{N}_]|$))", 1.0), ("(?:stunden?|std\\.?|h(?:[^\\p{L}\\p{N}_]|$))", 3600.0)]
MINUTES = {"eine?|eins": 60, "zwei": 120, "drei": 180, "vier": 240, "fünf": 300, "zehn": 600, "fünfzehn": 900, "zwanzig": 1200, "dreißig": 1800}
SECONDS = {"eine?|eins": 1, "zwei": 2, "drei": 3, "fünf": 5, "zehn": 10, "zwanzig": 20, "dreißig": 30}
ISSUES = {
    "double_spaces": " {2,}",
    "plenken": f"{R.SP}+[.,!?;:]",
    "hyphenation": f"(?i)[a-zäöüß]-{R.SP}*\\n{R.SP}*[a-zäöüß]",
    "urls": f"(?i)https?://[^{R.SPACES}]+|www\\.[^{R.SPACES}]+",
    "emails": "[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}",
}
GERMAN = "und der die das ist nicht ein eine zu in".split()


def base(select: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}dressed AS ({DRESSED}){more} {select}"


def column(expression: str) -> str:
    return base(f"SELECT doc_id, {expression} AS text FROM dressed")


def trim(e: str) -> str:
    return apply_sql(R.TRIM, e)


def expand_abbreviations(e: str) -> str:
    return apply_sql([R.abbreviation_rule(*x) for x in R.abbreviations()], e)


def phonetic(e: str) -> str:
    for word in sorted(R.PHONETIC, key=lambda w: -len(w)):
        to = R.PHONETIC[word]
        for first, out in ((word[0].upper(), to[0].upper() + to[1:]), (word[0].lower(), to.lower())):
            e = f"regexp_replace({e}, '(^|{EDGE}){first}(?i:{word[1:]})($|{EDGE})', '\\1{out}\\2', 'g')"
    return e


def clean(e: str, script: bool = False, spoken: bool = True) -> str:
    e = expand_abbreviations(e)
    for rules in (R.END_OF_LINES, R.PAGE_NUMBERS, R.RULE_LINES):
        e = apply_sql(rules, e)
    for rules in () if script else (R.CONTENTS, R.CHAPTERS):
        e = apply_sql(rules, e)
    for rules in (R.LISTS, R.HYPHENS):
        e = apply_sql(rules, e)
    for rules in () if script else (R.URLS, R.EMAILS, R.REFERENCES):
        e = apply_sql(rules, e)
    e = apply_sql(R.DECIMALS, apply_sql(R.TYPOGRAPHY, e))
    return phonetic(e) if spoken else e


def ghost(e: str) -> str:
    return f"array_to_string(list_filter(string_split({e}, chr(10)), lambda x: {trim('x')} = '' OR (regexp_matches(x, '{LETTERS}') AND NOT regexp_matches({trim('x')}, '(?i)^(Seite|Page)\\s*\\d+$'))), chr(10))"


def paragraph_list(e: str) -> str:
    return f"list_filter(list_transform(string_split_regex({e}, '\\n{{2,}}'), lambda p: {trim('p')}), lambda p: regexp_matches(p, '{LETTERS}'))"


def before_paragraphs(e: str) -> str:
    e = apply_sql(R.HYPHENS_STRICT, apply_sql(R.END_OF_LINES, apply_sql(R.INVISIBLE, f"nfc_normalize({e})")))
    return collapse(apply_sql(R.CONTROL, ghost(e)))


def collapse(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '[ \\t]+', ' ', 'g'), '(?m)[ \\t]+$', '', 'g')"


def remove_tags(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '(?i){R.SP}*\\[PAUSE{R.SP}+[\\d.]+s\\]{R.SP}*', ' ', 'g'), '{R.SP}{{2,}}', ' ', 'g')"


def boilerplate(e: str) -> str:
    """Emphasis by single stars twice over, as one match takes the blank that the next one begins with."""
    for pattern in ("(?i)```(?:json|text|markdown|plaintext|xml|html)?S*", "S*```"):
        e = f"regexp_replace({e}, '{pattern.replace('S', R.SP)}', '', 'g')"
    e = f"regexp_replace({e}, '(?m)^[\"'']([\\x{{0}}-\\x{{10FFFF}}]*)[\"'']$', '\\1')"
    for pattern in ("(?:Hier ist|Here is)[^:\\n]*:?", "(?:Der bereinigte Text|The cleaned text)[^:\\n]*:?", "(?:Gerne|Sure|Of course|Certainly)[^.:\\n]*[.:]?", "(?:Hier|Here)[^:\\n]*(?:der|the)[^:\\n]*:?", "(?:Natürlich|Selbstverständlich)[^.:\\n]*[.:]?", "(?:Okay|OK)[,.]?", "(?:Ich habe|I have)[^:\\n]*:?", "(?:Der Text|The text)[^:\\n]*:?"):
        e = f"regexp_replace({e}, '(?i)^{pattern}{R.SP}*\\n*', '')"
    e = f"regexp_replace({e}, '(?i)\\n*(?:Hinweis|Note|Anmerkung)[:{R.SPACES}][^\\n]*$', '')"
    e = f"regexp_replace({e}, '(?i)\\n*(?:Ich habe|I have)[^.]*\\.?{R.SP}*$', '')"
    e = f"regexp_replace(regexp_replace({e}, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '__([^_]+)__', '\\1', 'g')"
    for _ in range(2):
        e = f"regexp_replace({e}, '({R.SP})\\*([^*\\n]+)\\*({R.SP}|$)', '\\1\\2\\3', 'g')"
    return trim(e)


def cut_tables(source: str, listed: str) -> str:
    """Tables that end in `sane` (doc_id, text): paragraphs of `source`, cut to 1000 characters, joined by blank lines."""
    w = "substring(rest, 701, 300)"
    lazy = lambda marks: f"length(regexp_extract({w}, '(?s)^(.*?[{marks}])\\s', 1))"
    cut = f"CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN {lazy('.!?')} > 0 THEN 700 + {lazy('.!?')} WHEN {lazy(';:')} > 0 THEN 700 + {lazy(';:')} WHEN contains({w}, ' ') THEN 700 + length(regexp_extract({w}, '(?s)^(.*) ', 1)) ELSE 1000 END"
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    more = f""", listed AS (SELECT doc_id, {listed} AS l FROM {source}),
para AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM listed),
rec AS (SELECT doc_id, i, 0 AS k, CAST(NULL AS VARCHAR) AS piece, p AS rest FROM para WHERE length(p) > 0
UNION ALL SELECT doc_id, i, k + 1, CASE WHEN length(rest) <= 1000 THEN rest ELSE {strip('substring(rest, 1, cut)')} END, CASE WHEN length(rest) <= 1000 THEN '' ELSE {strip('substring(rest, cut + 1)')} END
FROM (SELECT *, {cut} AS cut FROM rec WHERE length(rest) > 0))"""
    return more + f""", sane AS (SELECT d.doc_id, coalesce(string_agg(r.piece, chr(10) || chr(10) ORDER BY r.i, r.k), '') AS text FROM {source} d LEFT JOIN rec r ON r.doc_id = d.doc_id AND r.piece IS NOT NULL GROUP BY d.doc_id)"""


def pieces(source: str, listed: str) -> str:
    return base("SELECT doc_id, text FROM sane", True, cut_tables(source, listed))


def sanitized(source: str) -> str:
    return cut_tables(source, paragraph_list(before_paragraphs("text")))


def smart_split(target: int) -> str:
    w = int(min(2000, 0.2 * target))
    back = f"substring(t, pos + {target - w} + 1, {w})"
    last = lambda p: f"nullif(length(regexp_extract({back}, '(?s)^({p})', 1)), 0)"
    sentence = f"nullif(length(regexp_extract({back}, '(?s)^(.*[.!?])\\s', 1)), 0)"
    k = f"coalesce({last('.*\\n\\n')}, {sentence}, {last('.*\\n')}, {last('.* ')}, {w})"
    more = f""", rec AS (SELECT doc_id, {apply_sql(R.END_OF_LINES, 'text')} AS t, 0 AS n, 0 AS pos, CAST(NULL AS VARCHAR) AS chunk FROM dressed
UNION ALL SELECT doc_id, t, n + 1, pos + size, substring(t, pos + 1, size) FROM (SELECT *, CASE WHEN length(t) - pos <= {target} THEN length(t) - pos ELSE {target - w} + {k} END AS size FROM rec WHERE pos < length(t)))"""
    return base("SELECT doc_id, CAST(n AS INTEGER) AS chunk_no, chunk FROM rec WHERE chunk IS NOT NULL", True, more)


def insert_after(source: str, pattern: str, inserted: str, skip: str = "false") -> str:
    """A chain of tables that ends in one named `tagged` (doc_id, text)."""
    tag = sql_text(R.PAUSE_TAG.re2())
    return f""", parts AS (SELECT doc_id, text AS t, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM {source}),
rows AS (SELECT doc_id, t, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, ms FROM parts),
placed AS (SELECT doc_id, t, p, i, coalesce(ms[i], '') AS m, sum(length(p) + length(coalesce(ms[i], ''))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM rows),
tagged AS (SELECT doc_id, string_agg(p || m || CASE WHEN m = '' OR regexp_matches(substring(t, CAST(greatest(0, e - 20) AS BIGINT) + 1, CAST(e + 20 - greatest(0, e - 20) AS BIGINT)), {tag}) OR {skip} THEN '' ELSE {sql_text(inserted)} END, '' ORDER BY i) AS text FROM placed GROUP BY doc_id)"""


def guard() -> str:
    short = "|".join(R.quoted(x) for x in R.GUARD)
    return f"(m[1] = '.' AND regexp_matches(right(p, 10), {sql_text(f'(^|{EDGE})({short})$')}))"


def lines(source: str = "dressed") -> str:
    return f"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {source})"


def number(e: str) -> str:
    return f"CAST(replace({e}, ',', '.') AS DOUBLE)"


def pause_seconds(e: str) -> str:
    t = f"lower({e})"
    num = "(\\d+(?:[.,]\\d+)?)\\s*(?:reale?\\s+)?"
    cases = []
    for p, times in UNITS:
        v = number(f"nullif(regexp_extract({t}, {sql_text(num + p)}, 1), '')")
        cases.append(f"CASE WHEN {v} > 0 THEN floor({v} * {times} + 0.5) END")
    for table, unit in ((MINUTES, "minuten?"), (SECONDS, "sekunden?")):
        for w, s in table.items():
            cases.append(f"CASE WHEN regexp_matches({t}, {sql_text(f'(^|{EDGE})(?:{w})' + chr(92) + 's+(?:reale?' + chr(92) + f's+)?{unit}')}) THEN {float(s)} END")
    bare = number(f"nullif(regexp_extract({t}, '(?:^|{EDGE})(\\d+(?:[.,]\\d+)?)(?:{EDGE}|$)', 1), '')")
    cases.append(f"CASE WHEN {bare} > 0 AND {bare} <= 300 THEN floor({bare} + 0.5) END")
    return f"CAST(coalesce({', '.join(cases)}, 15.0) AS DOUBLE)"


def pauses(source: str = "dressed") -> str:
    """Tables up to `pauses` (doc_id, line_no, original_text, duration, instruction)."""
    key, tag, whole = (sql_text(x) for x in (KEY, TAG, WHOLE_DIRECTION))
    part = lambda i: f"regexp_extract(line, {sql_text(KEY_PARTS)}, {i})"
    rest = f"regexp_replace({part(3)}, '^[\\s,:–\\-]+', '')"
    title = f"(CASE WHEN {part(1)} <> '' THEN {part(1)} || ' ' ELSE '' END || {part(2)})"
    return f""", trimmed AS (SELECT doc_id, line_no, line AS original_text, {trim('line')} AS line FROM {lines(source)}),
pauses AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, original_text,
CASE WHEN regexp_matches(line, {key}) THEN {pause_seconds('line')} WHEN regexp_matches(line, {tag}) THEN coalesce(nullif(CAST(regexp_extract(line, {tag}, 1) AS DOUBLE), 0), 15.0) ELSE {pause_seconds('line')} END AS duration,
CASE WHEN regexp_matches(line, {key}) THEN CASE WHEN {rest} = '' THEN {title} ELSE {title} || ' – ' || {rest} END ELSE 'PAUSE – ' || line END AS instruction
FROM trimmed WHERE regexp_matches(line, {key}) OR regexp_matches(line, {tag}) OR regexp_matches(line, {whole}))"""


def tagged(source: str = "dressed") -> str:
    """doc_id, text with tags, and whether there are any, from `source` and the tables of pauses(source)."""
    line = f"CASE WHEN duration IS NULL THEN line WHEN regexp_matches(line, {sql_text(TAG)}) THEN regexp_replace(line, {sql_text(TAG)}, {tag('duration')}, 'g') ELSE line || ' ' || {tag('duration')} END"
    return f"SELECT doc_id, string_agg({line}, chr(10) ORDER BY line_no) AS text, count(duration) > 0 AS has FROM (SELECT l.doc_id, l.line_no, l.line, p.duration FROM {lines(source)} l LEFT JOIN (SELECT doc_id, line_no, max(duration) AS duration FROM pauses GROUP BY ALL) p ON p.doc_id = l.doc_id AND p.line_no = l.line_no) GROUP BY doc_id"


def tag(e: str) -> str:
    x = f"greatest(0.1, floor(({e}) * 10 + 0.5) / 10)"
    return f"('[PAUSE ' || CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END || 's]')"


def coded(source: str = "dressed") -> str:
    """doc_id and text, shortcodes turned into tags."""
    p = sql_text(CODE)
    unit = f"lower(regexp_extract(m, {p}, 2))"
    times = f"(CASE WHEN {unit} LIKE 'm%' THEN 60.0 WHEN {unit} LIKE 'st%' OR {unit} = 'h' THEN 3600.0 ELSE 1.0 END)"
    value = number(f"regexp_extract(m, {p}, 1)")
    return f"""SELECT doc_id, string_agg(p || CASE WHEN m = '' OR {value} <= 0 OR regexp_matches(m, '(?i)^\\[PAUSE\\s[\\d.]+s\\]$') THEN m ELSE ' [PAUSE ' || CAST(CAST(floor({value} * {times} + 0.5) AS BIGINT) AS VARCHAR) || 's] ' END, '' ORDER BY i) AS text
FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, coalesce(ms[generate_subscripts(ps, 1)], '') AS m FROM (SELECT doc_id, string_split_regex(text, {p}) AS ps, regexp_extract_all(text, {p}) AS ms FROM {source})) GROUP BY doc_id"""


def shortcodes() -> str:
    return base(coded())


def is_stage(line: str) -> str:
    return f"(regexp_matches({trim(line)}, {sql_text(KEY)}) OR regexp_matches({line}, {sql_text(TAG)}) OR regexp_matches({line}, '(?i)[(\\[]\\s*(?:pause|stille|nachspüren)[^)\\]]*[)\\]]'))"


def is_script(e: str) -> str:
    one = " OR ".join(f"regexp_matches(x, {sql_text(p)})" for p in (KEY_BEGINS, TAG, CODE_BUT_HOURS, DIRECTION_BEGINS))
    return f"(len(list_filter(string_split({e}, chr(10)), lambda x: {one})) > 0)"


def sentences() -> str:
    p = sql_text("[^.!?]+[.!?]+(?:\\s+|$)|[^.!?]+$")
    found = f"(CASE WHEN len(regexp_extract_all(text, {p})) > 0 THEN regexp_extract_all(text, {p}) ELSE [text] END)"
    return base(f"SELECT doc_id, lang, source, CAST(i AS INTEGER) AS sentence_no, sentence FROM (SELECT doc_id, lang, source, unnest({found}) AS sentence, generate_subscripts({found}, 1) AS i FROM dressed)")


def exploded(split: str, number_name: str, name: str) -> str:
    return base(f"SELECT doc_id, lang, source, CAST(i AS INTEGER) AS {number_name}, x AS {name} FROM (SELECT doc_id, lang, source, unnest({split}) AS x, generate_subscripts({split}, 1) AS i FROM dressed)")


def abbreviation_count(label: str) -> str:
    return R.abbreviation_rule(label, "").count_sql("text")


def issues() -> str:
    n = lambda p: f"CAST(len(regexp_extract_all(text, {sql_text(p)})) AS BIGINT)"
    hits = " + ".join(abbreviation_count(label) for label, _ in R.abbreviations())
    names = [*ISSUES, "abbreviations"]
    return f"SELECT *, {' + '.join(names)} AS total FROM (SELECT doc_id, lang, source, {', '.join(f'{n(p)} AS {k}' for k, p in ISSUES.items())}, {hits} AS abbreviations FROM dressed)"


def inventory() -> str:
    counts = ", ".join(f"{abbreviation_count(label)} AS c{i}" for i, (label, _) in enumerate(R.abbreviations()))
    rows = " UNION ALL ".join(f"SELECT {sql_text(label)} AS label, {sql_text(to)} AS replacement, CAST(sum(c{i}) AS BIGINT) AS n, count(*) AS n_docs FROM counted WHERE c{i} > 0 HAVING count(*) > 0" for i, (label, to) in enumerate(R.abbreviations()))
    return base(rows, more=f", counted AS (SELECT {counts} FROM dressed)")


def words(e: str) -> str:
    return f"CAST(CASE WHEN {trim(e)} = '' THEN 0 ELSE len(string_split_regex({trim(e)}, {sql_text(R.SP + '+')})) END AS BIGINT)"


def estimates() -> str:
    return f"SELECT *, CAST(floor(minutes / 60) AS BIGINT) AS hours, minutes % 60 AS rest_minutes FROM (SELECT *, CAST(tokens * {round(1000 * (PRICE_IN + PRICE_OUT))} AS DOUBLE) / CAST(1000000000 AS DOUBLE) AS cost, CAST(ceil(words / {WORDS_PER_MINUTE}.0) AS BIGINT) AS minutes FROM (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, {words('text')} AS words FROM dressed))"


def actions() -> str:
    """A table `actions` (doc_id, category, action, n)."""
    rows = " UNION ALL ".join(f"SELECT doc_id, {sql_text(cat)} AS category, {sql_text(k)} AS action, {' + '.join(r.count_sql('text') for r in rules)} AS n FROM dressed" for k, (cat, rules, _) in R.COUNTERS.items())
    return f", actions AS (SELECT * FROM ({rows}) WHERE n > 0)"


def german_words() -> str:
    return "(" + ", ".join(sql_text(w) for w in GERMAN) + ")"


def score_german(e: str) -> str:
    n = lambda p: f"len(regexp_extract_all({e}, {sql_text(p)}))"
    return f"CAST(10 * {n('[äöüÄÖÜß]')} + 2 * len(list_filter(string_split_regex(lower({e}), '{EDGE}+'), lambda w: w IN {german_words()})) - 50 * {n('�')} - 20 * {n('Ã[¼¶¤¦©]')} AS BIGINT)"


def prepared_standard() -> str:
    cleaned = f", cleaned AS (SELECT doc_id, {clean('text')} AS text FROM dressed)"
    return base("SELECT doc_id, text FROM tagged", True, cleaned + sanitized("cleaned") + insert_after("sane", r"\n\s*\n+", " [PAUSE 2s] "))


def cleaned_and_sanitized() -> str:
    return base("SELECT doc_id, text FROM sane", True, f", cleaned AS (SELECT doc_id, {clean('text')} AS text FROM dressed)" + sanitized("cleaned"))


def prepared_script() -> str:
    """Stage lines give way to marks while the rest is cleaned, and come back before all is spelled as spoken and sanitized."""
    mark = r"\[\[PROTECTED_\d+\]\]"
    more = f""", coded AS ({coded()}),
flagged AS (SELECT doc_id, line_no, line, {is_stage('line')} AS st FROM {lines('coded')}),
counted AS (SELECT *, sum(CAST(st AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k FROM flagged),
marked AS (SELECT doc_id, string_agg(CASE WHEN st THEN '[[PROTECTED_' || CAST(k AS VARCHAR) || ']]' ELSE line END, chr(10) ORDER BY line_no) AS t, coalesce(list(line ORDER BY line_no) FILTER (WHERE st), []) AS saved FROM counted GROUP BY doc_id),
done AS (SELECT doc_id, saved, {clean('t', script=True, spoken=False)} AS t FROM marked),
cut AS (SELECT doc_id, saved, unnest(string_split_regex(t, '{mark}')) AS p, generate_subscripts(string_split_regex(t, '{mark}'), 1) AS i, regexp_extract_all(t, '{mark}') AS ms FROM done),
whole AS (SELECT doc_id, string_agg(p || CASE WHEN ms[i] IS NULL THEN '' ELSE saved[CAST(regexp_extract(ms[i], '([0-9]+)', 1) AS BIGINT) + 1] END, '' ORDER BY i) AS t FROM cut GROUP BY doc_id),
restored AS (SELECT doc_id, {phonetic('t')} AS text FROM whole)"""
    return base(f"SELECT doc_id, text, CASE WHEN has THEN 'script' ELSE 'no pause' END AS kind FROM ({tagged('sane')})", True, more + sanitized("restored") + pauses("sane"))
