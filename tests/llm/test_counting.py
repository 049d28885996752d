"""Counts after edits, beside encoding the edited text as a whole."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import counting
from lectern.llm.tokens import encoder

TEXT = st.text(alphabet="ab Z.1é\n\t\x1c ", max_size=60)


def brute(text, edits):
    done, at, out = 0, 0, []
    for a, b, new in sorted(edits):
        if 0 <= a <= b <= len(text) and (not out or a >= done):
            out += [text[at:a], new]
            at = done = b
    return "".join([*out, text[at:]])


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), st.sampled_from(["", " ", "x", " x ", "\n", "[mail]", "  "])), max_size=4))
def test_edit_equals_whole(text, raw):
    e = encoder()
    edits = [(a, a + k, new) for a, k, new in raw]
    doc = counting.Counted(text, e)
    assert doc.tree.tokens == len(e.one(text))
    assert doc.edit(edits) == len(e.one(brute(text, edits)))
    assert doc.tree.text == brute(text, edits)


def test_edits_in_turn():
    e, rng = encoder(), random.Random(3)
    text = " ".join(rng.choice(["the", "of,", "naïve", "12", "x.y", "end\n"]) for _ in range(400))
    doc = counting.Counted(text, e)
    for _ in range(40):
        a = rng.randrange(len(text))
        edit = [(a, min(len(text), a + rng.randrange(6)), rng.choice(["", " ", "new", " a b "]))]
        text = brute(text, edit)
        assert doc.edit(edit) == len(e.one(text)) and doc.tree.text == text
    assert doc.encoded < 40 * 20


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    more = spark.createDataFrame([(9001, None, None), (None, "", "x"), (9002, "a a@b.de\nl\nl", "y")], "doc_id long, text string, TEXT2 string")
    docs = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    texts, e = {r.doc_id: r.text or "" for r in docs.collect()}, encoder()
    rows = counting.counted(docs).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        t = texts[r.doc_id]
        edits = counting.cleaning_edits(t)
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited) == (len(e.one(t)), len(edits), len(e.one(brute(t, edits))))
    assert counting.counted(docs.limit(0)).count() == 0
