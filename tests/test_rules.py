"""Each text rule on rows of its own: what it changes, and what it must leave."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import pauses as P
from lectern.functions import segments as S
from lectern.functions import text as T

CASES = [
    (T.expand_abbreviations, "Das ist z.B. so, ca. 3 km.", "Das ist zum Beispiel so, circa 3 km."),
    (T.expand_abbreviations, "Er erhält. Cafés. Dann", "Er erhält. Cafés. Dann"),
    (T.expand_abbreviations, "s. oben, s.o. und s.u.", "siehe oben, siehe oben und siehe unten"),
    (T.expand_abbreviations, "VGL. kap. o.ä.", "vergleiche Kapitel oder Ähnliches"),
    (T.normalize_eol, "a\r\nb\rc\n", "a\nb\nc\n"),
    (T.drop_page_numbers, "a\n12\nb", "a\n\nb"),
    (T.drop_page_numbers, "a 12\nb", "a 12\nb"),
    (T.drop_rules, "a\n-----\nb--", "a\n\nb--"),
    (T.drop_toc, "Inhalt ........ 7\nText.", "\nText."),
    (T.drop_chapter_markers, "kapitel 3 Der Anfang\nIm Kapitel 3", "\nIm Kapitel 3"),
    (T.lists_to_prose, "- Apfel\n* Birne\nx - y", "Apfel, \nBirne, \nx - y"),
    (T.join_hyphenation, "Ver-\n  bindung", "Verbindung"),
    (T.join_hyphenation, "A-\n1", "A-\n1"),
    (T.drop_urls, "Mehr auf https://x.org/a. Ende", "Mehr auf. Ende"),
    (T.drop_emails, "Post an a.b@c.de bitte", "Post an bitte"),
    (T.drop_references, "belegt [1, 2] hier", "belegt  hier"),
    (T.drop_references, "so (Müller 2020: 15) und (vgl. dort)", "so  und "),
    (T.drop_references, "so (2020) und [a]", "so (2020) und [a]"),
    (T.fix_typography, "Hallo ! ( Text )", "Hallo! (Text)"),
    (T.speak_decimals, "3.5 und 1.2.3", "3 Punkt 5 und 1 Punkt 2.3"),
    (T.phonetic, "Chakra [PAUSE 2s] chakra CHAKRA", "Tschakra [PAUSE 2s] tschakra Tschakra"),
    (T.phonetic, "Chakrabarti", "Chakrabarti"),
    (T.strip_assistant_boilerplate, "Hier ist der Text:\n\n**Eins** zwei.", "Eins zwei."),
    (T.drop_ghost_lines, "a\nSeite 12\n***\n\nb", "a\n\nb"),
    (T.drop_control, "a\tb\x07c\n", "abc\n"),
    (T.invisible_to_space, "a​b­c d", "a b c d"),
    (T.collapse_space, " a \t b \n c", " a b\n c"),
    (T.collapse_space, "  eingerückt  ", " eingerückt"),
    (T.drop_ghost_lines, "Seite12\nseite  3\nSeite x\n  \nPage 4 a", "Seite x\n  \nPage 4 a"),
    (T.strip_assistant_boilerplate, "ein *wort*spiel, *so* *und* so *", "ein *wort*spiel, so und so *"),
    (T.strip_assistant_boilerplate, "a ```JSON b``` c", "a bc"),
    (T.sanitize, "Cafe\u0301 mu\u0308de", "Café müde"),
    (T.trim, "\u00a0 a b\u2003\n", "a b"),
    (P.remove_pause_tags, "Text [PAUSE 2 s] mehr", "Text [PAUSE 2 s] mehr"),
    (P.normalize_shortcodes, "(0 Min) und [0,0 s]", "(0 Min) und [0,0 s]"),
    (lambda c: P.is_script(c).cast("string"), "Text\n(Pause hier) dann weiter", "true"),
    (lambda c: P.is_script(c).cast("string"), "Text\nein (Pause hier) dann (2 Std)", "false"),
    (lambda c: P.tag_pauses(c), "Eins\nPAUSE 30\n[PAUSE 0s]", "Eins\nPAUSE 30 [PAUSE 30s]\n[PAUSE 15s]"),
    (T.paragraph_filter, "a\n\n---\n\n\n b ", "a\n\nb"),
    (lambda c: T.custom_replacements(c, [("A.b", "$1\\"), ("", "x")]), "a.B axb", "$1\\ axb"),
    (lambda c: T.search_replace(c, "a", "x")["text"], "aAbA", "xxbx"),
    (lambda c: T.search_replace(c, "a", "x")["n_hits"].cast("string"), "aAbA", "3"),
    (lambda c: T.search_replace(c, "(", "x", regex=True)["n_hits"].cast("string"), "((", "0"),
    (lambda c: P.paragraph_pauses(c, 2, space_after=False), "A.\n\nB.", "A.\n\n [PAUSE 2s]B."),
    (P.paragraph_pauses, "A.\n\n[PAUSE 1s] B.", "A.\n\n[PAUSE 1s] B."),
    (P.sentence_pauses, "Eins. Zwei.", "Eins. [PAUSE 0.8s] Zwei."),
    (P.sentence_pauses, "Prof. Weber kam.", "Prof. Weber kam."),
    (lambda c: P.sentence_pauses(c, guard=False), "Prof. Weber", "Prof. [PAUSE 0.8s] Weber"),
    (P.remove_pause_tags, "Text [PAUSE 2s] mehr", "Text mehr"),
    (P.normalize_shortcodes, "(10 Min) [1,5 Minuten]", " [PAUSE 600s]   [PAUSE 90s] "),
    (P.normalize_shortcodes, "[PAUSE 0.8s] (2 Std)", "[PAUSE 0.8s]  [PAUSE 7200s] "),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(spark, i):
    f, given, expected = CASES[i]
    df = spark.createDataFrame([(given,), (None,), ("",)], "text string").coalesce(1)
    rows = df.select(f(F.col("text")).alias("out")).collect()
    assert rows[0].out == expected
    assert rows[1].out is None or "n_hits" not in str(f)


PAUSES = [
    ("Pause für 14 reale Minuten", 840.0), ("STILLE: fünf Minuten genießen", 300.0), ("(Pause: 10 Sekunden)", 10.0), ("PAUSE 30", 30.0), ("PAUSE, um tief einzuatmen", 15.0),
    ("Langer Text [PAUSE 7.5s] weiter", 7.5), ("PAUSE 1,5 Minuten", 90.0), ("STILLE 2.5 Stunden", 9000.0), ("PAUSE 1 Stunde 5 Minuten", 300.0),
    ("Mache eine PAUSE", None), ("SEHR LANGE PAUSE", None), ("PAUSEN machen", None),
    ("PAUSE Teil2", 15.0), ("PAUSE 3x tief", 15.0), ("PAUSE 12.5, dann", 13.0), ("[PAUSE 0s]", 15.0), ("PAUSE 0,3 Sekunden", 0.0),
]


def test_scan_and_apply_pauses(spark):
    docs = spark.createDataFrame([(i, f"Erste Zeile\n{line}\nEnde") for i, (line, _) in enumerate(PAUSES)], "doc_id long, text string")
    found = {r.doc_id: r for r in P.scan_pauses(docs).collect()}
    assert {i: found[i].duration if i in found else None for i in range(len(PAUSES))} == {i: s for i, (_, s) in enumerate(PAUSES)}
    assert found[4].instruction == "PAUSE – um tief einzuatmen"
    done = {r.doc_id: r.text for r in P.apply_pauses(docs, P.scan_pauses(docs)).collect()}
    assert done[3] == "Erste Zeile\nPAUSE 30 [PAUSE 30s]\nEnde"
    assert done[5] == "Erste Zeile\nLanger Text [PAUSE 7.5s] weiter\nEnde"
    assert done[9] == "Erste Zeile\nMache eine PAUSE\nEnde"
    warned = {r.doc_id: r.warnings for r in P.pause_warnings(docs, P.scan_pauses(docs)).collect()}
    assert warned[9] == "none found" and warned[7] == "1 above 1800 s" and warned[3] == ""


def test_pause_tag(spark):
    df = spark.createDataFrame([(2.0,), (0.84,), (0.0,), (840.0,)], "s double")
    assert [r[0] for r in df.select(P.pause_tag(F.col("s"))).collect()] == ["[PAUSE 2s]", "[PAUSE 0.8s]", "[PAUSE 0.1s]", "[PAUSE 840s]"]


def test_protect_and_restore(spark):
    text = "KURZE PAUSE\nnormal\nx [PAUSE 2s]\n(Stille)"
    df = spark.createDataFrame([(text,)], "text string").select(T.protect_lines(F.col("text")).alias("p"))
    row = df.select("p.text", "p.saved", T.restore_lines(F.col("p.text"), F.col("p.saved")).alias("back")).first()
    assert row.text == "[[PROTECTED_0]]\nnormal\n[[PROTECTED_1]]\n[[PROTECTED_2]]" and row.back == text


SPLITS = [("", []), ("kurz", ["kurz"]), ("x" * 20, ["x" * 20]), ("x" * 25, ["x" * 20, "x" * 5]), ("aaaa aaaa aaaa aaaa bbb", ["aaaa aaaa aaaa aaaa ", "bbb"]), ("aaaa aaaa aaaa aa.\n\nbbbbbbb", ["aaaa aaaa aaaa aa.\n\n", "bbbbbbb"]), ("a\r\nb", ["a\nb"])]


@pytest.mark.parametrize(("given", "expected"), SPLITS)
def test_smart_split(spark, given, expected):
    df = spark.createDataFrame([(given,)], "text string")
    assert df.select(S.smart_split(F.col("text"), 20)).first()[0] == expected


def test_split_and_sanitize_properties(spark, tiny):
    from lectern.plans.corpus import dressed

    docs = dressed(spark, tiny)
    chunks = S.explode_chunks(docs.select("doc_id", "text"), 700)
    assert chunks.where(F.length("chunk") > 700).count() == 0
    back = S.reassemble(chunks, "chunk_no", "chunk").join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where("text <> t").count() == 0 and back.count() == docs.count()
    once = docs.select("doc_id", T.sanitize(F.col("text")).alias("text"))
    twice = once.select("doc_id", "text", T.sanitize(F.col("text")).alias("again"))
    assert twice.where("text <> again").count() == 0
    assert once.select(F.explode(F.split("text", "\n\n")).alias("p")).where(F.length("p") > 1000).count() == 0
    tagged = once.select(P.remove_pause_tags(P.inject_pauses(F.col("text"))).alias("text"))
    assert tagged.where(P.count_pause_tags(F.col("text")) > 0).count() == 0


def test_scan_keeps_lines_and_case(spark):
    docs = spark.createDataFrame([(1, "x\n  Kurze Pause: Atmen \nende")], "doc_id long, text string")
    row = P.scan_pauses(docs).first()
    assert (row.original_text, row.instruction, row.duration, row.line_no) == ("  Kurze Pause: Atmen ", "Kurze Pause – Atmen", 15.0, 2)


def test_rows_stay_whatever_their_ids(spark):
    docs = spark.createDataFrame([(1, "a\nPAUSE"), (1, "PAUSE\nb"), (None, "PAUSE"), (2, None), (3, "")], "doc_id long, text string")
    pauses = spark.createDataFrame([(1, 2, 3.0, 1), (1, 2, 1.0, 2), (3, 7, 1.0, 1)], "doc_id long, line_no int, duration double, n int")
    got = sorted(((r.doc_id, r.text) for r in P.apply_pauses(docs, pauses, order="n").collect()), key=str)
    assert got == sorted([(1, "a\nPAUSE [PAUSE 1s]"), (1, "PAUSE\nb [PAUSE 1s]"), (None, "PAUSE"), (2, None), (3, "")], key=str)
    edits = spark.createDataFrame([(1, 2, 5.0), (1, 2, 9.0)], "doc_id long, line_no int, duration double")
    assert [r.duration for r in P.override_durations(pauses.where("n = 1 and doc_id = 1"), edits).collect()] == [9.0]
    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    back = S.reassemble(S.explode_chunks(keyed, 3, keep_empty=True), "chunk_no", "chunk", keys=("doc_id", "key"))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    script, other = P.route(docs)
    assert (script.count(), other.count()) == (3, 2)


def test_pauses_near_tags(spark):
    """Beside a plain search of the 20 characters to either side of each place."""
    import random
    import re

    rng = random.Random(4)
    bits = ["a", "bc", " ", ". ", "! ", "\n", "\n\n", "  \n\n", " \n \n\n ", "x" * 9, "𝒳😀", "[PAUSE 2s]", "[pause 0.8s]", "[PAUSE  12.5s]", "[PAUSE \n\n2s]", "[PAUSE \n\n\n\n\n\n\n\n\n\n2s]", "[", "]"]
    texts = ["A. [PAUSE 1s] B. " + "x" * k + ". C! [PAUSE 2.5s]  D? E. F. G. H." for k in range(0, 30, 3)] + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(P.sentence_pauses(F.col("t"), guard=False), P.paragraph_pauses(F.col("t"))).collect()
    for t, out in zip(texts, got, strict=True):
        near = lambda e: re.search(r"(?i)\[PAUSE\s+[\d.]+s\]", t[max(0, e - 20) : e + 20])  # noqa: B023, E731
        assert out[0] == re.sub(r"[.!?]\s+", lambda m: m[0] + ("" if near(m.end()) else "[PAUSE 0.8s] "), t)
        assert out[1] == re.sub(r"\n\s*\n+", lambda m: m[0] + ("" if near(m.end()) else " [PAUSE 2s] "), t)


def test_rule_inventory(spark, tiny):
    """The same counts joined and by automata; the built-in abbreviations as a table."""
    from lectern.functions import rules as R
    from lectern.operators import analytics as A
    from lectern.operators import rule_tables
    from lectern.plans.corpus import dressed

    docs = dressed(spark, tiny)
    rows = [(i, label, to, label, A.abbreviation_pattern(label)) for i, (label, to) in enumerate(R.abbreviations())] + [(900, "none", "", "qqq", "qqq"), (901, "null", "", None, "x"), (902, "Ä", "", "ä", "(?iu)Ä")]
    rules = spark.createDataFrame(rows, "rule_no int, label string, replacement string, literal string, pattern string")
    out = lambda *how: {tuple(r) for r in rule_tables.rule_inventory(docs, rules, *how).collect()}
    joined = out()
    assert {r for r in joined if r[0] != "Ä"} == {tuple(r) for r in A.abbreviation_inventory(docs).collect()}
    assert out(5) == joined and out(5, 60) == joined
    plan = rule_tables.rule_hits(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan and "hashpartitioning" not in plan


def test_sentences_are_linear(spark):
    """The sentences of the plain pattern, on texts of signs and blanks, and in a long run that no blank ends."""
    import random

    from lectern.functions import segments

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.!? \n\t\u2028\u0085ä\U0001d11e") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    plain = r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$"
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(segments.SENTENCE), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b"))
    assert df.where("a <> b").count() == 0 and df.where("size(a) > 2").count() > 200
    long = spark.createDataFrame([(1, "wort " * 100_000 + "x.y ende")], "doc_id long, text string")
    begun = time.monotonic()
    assert segments.explode_sentences(long).collect()[0].sentence == "y ende"
    assert time.monotonic() - begun < 30


def test_lines_without_a_duration_are_not_searched(spark):
    """The guard of pause_seconds() changes no result."""
    lines = ["PAUSE", "Fünf Minuten", "zehn SEKUNDEN Ruhe", "3 Std", "2 h", "1,5 min.", "٣ Minuten", "eine Minute", "KURZE PAUSE 12.5", "minutenlang", "301", "300", "drei reale Sekunden", "", None, "7x", "(0 Min) zwei Minuten"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert df.select(P.pause_seconds(F.col("t"))).collect() == df.select(P._asked(F.lower("t"))).collect()
    plan = df.select(P.pause_seconds(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" in plan and plan.index("Contains(") < plan.index("regexp_extract")


def test_rules_from_a_corpus_are_made_once(spark):
    """A rule table of any size is evaluated once, however often it is looked at."""
    from lectern.operators import rule_tables

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(x):
        seen.add(1)
        return f"wort{x}"

    docs = spark.createDataFrame([(1, "wort3 wort140 x")], "doc_id long, text string")
    rules = spark.range(150).select(F.col("id").alias("rule_no"), made.asNondeterministic()("id").alias("search"), F.lit("y").alias("replace"))
    out = rule_tables.apply_rule_table(docs, rules).collect()
    assert out[0].text in ("y y x", "y y40 x") and seen.value == 150


def test_rules_of_whole_words(spark, tiny):
    """Words are counted by cutting texts into words, without a pattern for each rule; the counts are those of the patterns."""
    from lectern.operators import rule_tables
    from lectern.plans.corpus import dressed

    docs = dressed(spark, tiny).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "der Der der_ der-der (der) d\u00e9r"), (None, "_x x1 x")], "doc_id long, text string"))
    both = lambda w: f"{rule_tables.WORD_BEGINS}{w}{rule_tables.WORD_ENDS}"
    rows = [(i, w, w.upper(), w, both(w)) for i, w in enumerate(["der", "the", "Ende", "x", "_x", "x1", "dér", "Weiter", "the", "in", "qq"])]
    rules = spark.createDataFrame(rows, "rule_no int, label string, replacement string, literal string, pattern string")
    words, by_pattern = rule_tables.rule_hits(docs, rules), rule_tables._pattern_hits(docs, rules, 1000, 1000)
    want = sorted(by_pattern.collect(), key=str)
    assert sorted(words.collect(), key=str) == want and len(want) > 100 and words.columns == by_pattern.columns
    assert sorted(rule_tables.rule_hits(docs, rules, block=8).collect(), key=str) == want  # several blocks
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "regexp_count" not in plan
    mixed = rules.union(spark.createDataFrame([(50, "e.", "", "e.", "e\\.")], rules.schema))
    assert {r.rule_no for r in rule_tables.rule_hits(docs, mixed).collect()} == {r.rule_no for r in want} | {50}


def test_rule_tables(spark):
    """The same texts however many rules enter the plan, and however the others are cut into blocks."""
    import random

    from lectern.operators import rule_tables

    docs = spark.createDataFrame([(1, "Der Hund, der Hof; derb"), (1, None), (None, "hof"), (2, ""), (3, "Das ist m.E. gut. G0tt sei Dank. x5x K ſ ẞ ß ΣςΣ"), (4, "der" * 20_000)], "doc_id long, text string")
    rules = [(2, "DER", "x"), (1, "der", "dé"), (3, "Hof", "$1"), (4, "", "y"), (5, None, "z"), (6, "m.E.", "meines Erachtens"), (7, "g0tt SEI", "Gott sei"), (8, "5", None), (9, "k", "\\1"), (9, "S", "ſ"), (10, "ß", "ss"), (11, "σ", "s"), (12, "ss", "[ss]"), (13, "[", "(")]
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcÄß .") for _ in range(n))
    rules += [(20 + i, some(rng.randint(1, 4)), some(rng.randint(0, 3))) for i in range(300)]
    docs = docs.union(spark.createDataFrame([(10 + i, some(200)) for i in range(40)], docs.schema))
    table = spark.createDataFrame(rules, "rule_no int, search string, replace string")
    given = sorted((no, search, to or "") for no, search, to in rules if search)

    def one_by_one(pairs):
        """By patterns in plans, some rules at a time."""
        df = docs
        for i in range(0, len(pairs), 50):
            df = spark.createDataFrame(df.withColumn("text", T.custom_replacements(F.col("text"), pairs[i : i + 50])).collect(), docs.schema)
        return sorted(str(r.text) for r in df.collect())

    for n in (11, rule_tables.FOLD, rule_tables.FOLD + 1, len(given)):
        used = table.where(F.col("rule_no") <= given[n - 1][0])
        out = lambda *how: sorted(str(r.text) for r in rule_tables.apply_rule_table(docs, used, *how).collect())  # noqa: B023, E731
        want = one_by_one([x[1:] for x in given[:n]])
        assert out() == want and out(0) == want and out(0, 300 if n < 50 else 500) == want
    plan = rule_tables.apply_rule_table(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_case_is_ignored_as_in_patterns(spark):
    """Each character beside its folded form and the other cases, in the JVM's patterns and here."""
    from lectern.functions.rules import any_case, folded

    every = [chr(i) for i in [*range(32, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x2100, 0x2190)] if chr(i).isalpha()]
    pairs = sorted({(a, b) for a in every for b in (a.upper(), a.lower(), a.upper().lower(), a.lower().upper(), "s", "k", "i", "ß") if len(b) == 1})
    df = spark.createDataFrame([(a, b, any_case(a), any_case("x" + a), "x" + b) for a, b in pairs], "a string, b string, p string, q string, xb string")
    hits = {(r.a, r.b) for r in df.where("regexp_like(b, concat('(?iu)', p))").collect()}
    assert hits == {(r.a, r.b) for r in df.where("regexp_like(xb, concat('(?iu)', q))").collect()}
    assert hits == {(a, b) for a, b in pairs if folded(a) == folded(b)}


def test_search_patterns(spark):
    df = spark.createDataFrame([("Anna und Otto",)], "t string")
    run = lambda *x: tuple(df.select(T.search_replace(F.col("t"), *x, regex=True).alias("r")).select("r.text", "r.n_hits").first())
    same = "Anna und Otto"
    for bad in ("(?P<n>a)", "(", "a{2,1}", "[a", "(?<=a*)b", "\\"):
        assert run(bad, "x") == (same, 0)
    assert run("(?<n>[nt])[nt]", "<$<n>>") == ("A<n>a und O<t>o", 2)
    assert run("a", "$1") == ("$1nn$1 und Otto", 2)
    assert run("(a)(n)?", "$2$1$3$&$$") == ("nA$3An$na$3a$ und Otto", 2)
    assert run("\\(|[(]|(o)", "$10\\$<x>") == ("Anna und " + "O0\\$<x>tto0\\$<x>"[0:0] + "O0\\$<x>tt" + "o0\\$<x>", 2)


def test_long_texts_in_one_pass(spark):
    """A million characters cost about what a text of the same length costs that is cut rarely, and pieces are all there."""
    import time

    base = "Dies ist ein langer Satz mit Wörtern, der weiter geht; und noch einer. "
    took = {}
    for n in (500_000, 2_000_000):
        one = spark.createDataFrame([((base * (n // len(base) + 1))[:n],)], "t string").cache()
        for _ in range(2):
            t = time.time()
            row = one.select(T.split_long_paragraph(F.col("t")).alias("p"), S.smart_split(F.col("t"), 1000).alias("c"), F.col("t")).first()
            took[n] = time.time() - t
        assert " ".join(row.p).split() == row.t.split() and "".join(row.c) == row.t and max(map(len, row.p)) <= 1000
    assert took[2_000_000] < 5 * took[500_000] + 1


def test_null_texts_keep_their_row(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a. b")], "doc_id long, text string")
    for f in (S.explode_lines, S.explode_paragraphs, S.explode_sentences, S.explode_chunks):
        kept = f(df, keep_empty=True)
        assert {r.doc_id for r in kept.collect()} == {1, 2, 3}
        assert 1 not in {r.doc_id for r in f(df).collect()}


def test_stage_lines_are_spelled_as_spoken(spark):
    from lectern.plans.prepare import CleaningOptions, prepare_script

    df = spark.createDataFrame([(1, "PAUSE: atme ins Chakra\nDas Chakra")], "doc_id long, text string")
    assert prepare_script(df).first().text == "PAUSE: atme ins Tschakra [PAUSE 15s]\nDas Tschakra"
    assert "ins Chakra" in prepare_script(df, o=CleaningOptions(script=True, phonetic=False)).first().text


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_running_sums_of_a_hot_key(spark, block):
    import random

    from lectern.operators import analytics as A
    from lectern.operators import running as N

    rng = random.Random(3)
    rows = [(None if rng.random() < 0.03 else "hot" if rng.random() < 0.9 else rng.choice("abc"), rng.randint(0, 300), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i long, v int")
    got = {r.i: r for r in A.usage_totals(df.selectExpr("k", "t", "i", "v as p", "v * 2 as o"), "k", ["t", "i"], "p", "o").collect()}
    mean = {r.i: r for r in A.recent_chunk_avg(df, "k", ["t", "i"], "v", block=block).collect()}
    assert len(got) == len(mean) == 2000
    for key in (None, "hot", "a", "b", "c"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = 0
        for n, r in enumerate(own):
            total += r[3]
            last = [x[3] for x in own[max(0, n - 4) : n + 1]]
            assert got[r[2]].prompt_total == total and got[r[2]].output_total == 2 * total
            assert abs(mean[r[2]].recent_avg - sum(last) / len(last)) < 1e-5 and mean[r[2]].remaining == len(own) - n - 1
    parts = N.running(df, ["k"], ["t", "i"], {}, parts=8)
    assert parts.count() == 2000 and N.running(df.limit(0), ["k"], ["t"], {}).count() == 0


def test_one_narrow_stage_and_each_step_once(spark, tiny):
    from lectern.functions import rules as R
    from lectern.plans.corpus import documents
    from lectern.plans.prepare import prepare_script, prepare_standard

    for df in (prepare_standard(documents(spark, tiny)), prepare_script(documents(spark, tiny))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1
        assert plan.count(R.DECIMALS[0].replacement) == 1


def test_quick_looks_change_nothing(spark):
    """Rules behind a quick look, beside their patterns alone, on texts made of what they look at; unseen signs have a look too."""
    import random

    from lectern.functions import rules as R

    rng = random.Random(4)
    bits = ["manche", "Manche", "manchen", "CHAKRA", "regie", "Übermanche", "äz.B.", "z.B.", "vgl.", "VGL.", "s. ", "[PAUSE 2s]", "[[PROTECTED_regie]]", "(", ")", " ", " ", "​", "\x0b", "\x0c", "　", "ä", "x", "\n", "_", "ſ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    word = r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(R.PHONETIC, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])"
    plain = lambda rules: F.expr("t") if not rules else F.regexp_replace(plain(rules[:-1]), F.lit(rules[-1].java()), F.lit(rules[-1].replacement))
    same = df.select((T.invisible_to_space(F.col("t")).eqNullSafe(plain(R.INVISIBLE))).alias("a"), (T.fix_typography(F.col("t")).eqNullSafe(plain(R.TYPOGRAPHY))).alias("b"), (F.col("t").rlike("(?iu)" + word) | T.phonetic(F.col("t")).eqNullSafe(F.col("t"))).alias("c"))
    assert same.where("a and b and c").count() == len(texts) + 1
    got = {r.t: r.p for r in spark.createDataFrame([("MANCHE manchen regie",), ("Übermanche [[PROTECTED_regie]] Chakra",)], "t string").select("t", T.phonetic(F.col("t")).alias("p")).collect()}
    assert got == {"MANCHE manchen regie": "Mannche manchen reschi", "Übermanche [[PROTECTED_regie]] Chakra": "Übermanche [[PROTECTED_regie]] Tschakra"}
    assert all(r.sign for r in R.INVISIBLE) and all(r.sign for r in R.TYPOGRAPHY[3:])
