"""Every operator on a table with clashing names, nulls, repeated rows, an empty and a very long text; and on an empty one."""

import pytest

from lectern.llm import counting, decontamination, lm, near_copies, packing, quality_classifier, quality_rules, runs, sharding, simhash, toxicity, warc

WORDS = "the quick brown fox jumps over a lazy dog and then it sleeps for long hours in its warm den".split()
TEXT = " ".join(WORDS[i % len(WORDS)] + (str(i % 7) if i % 3 else ".") for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f" {i}", "en", f"src{i % 2}") for i in range(12)]
    rows += [rows[0]] * 3 + [(20, None, None, None), (None, "", "en", "src0"), (None, None, None, None), (21, "long " * 60_000 + "x" * 50_000, "en", "src1"), (22, TEXT, "en", None)]
    return spark.createDataFrame([(*r, "other", 1, "w", 2, 3) for r in rows], "doc_id long, text string, lang string, source string, TEXT string, n long, word string, h long, c0 long")


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    return {"labels": labels, "benchmark": spark.createDataFrame([("a", " ".join(TEXT.split()[3:15])), ("b", None), (None, "lazy")], "item_id string, text string")}


WHOLE = {
    "op1": lambda d, t: lm.scored(d),
    "op2": lambda d, t: counting.counted(d),
    "op3": lambda d, t: simhash.near_duplicates(d),
    "op4": lambda d, t: toxicity.classify(d, t["labels"]),
    "op5": lambda d, t: decontamination.report(d, t["benchmark"]),
    "op6": lambda d, t: quality_classifier.classify(d),
    "op7": lambda d, t: sharding.shard(d),
    "op8": lambda d, t: quality_rules.judge(d),
    "op10": lambda d, t: packing.pack(d),
    "op13": lambda d, t: runs.report(d),
}
STAGES = {
    "rules": lambda d, t: quality_rules.filtered(d),
    "classifier": lambda d, t: quality_classifier.filtered(d),
    "near copies": lambda d, t: near_copies.deduplicated(d),
    "equal fingerprints": lambda d, t: simhash.deduplicated(d),
    "benchmark": lambda d, t: decontamination.clean(d, t["benchmark"]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_for_each(spark, docs, tables, name, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = WHOLE[name](docs, tables).collect()
    ids = sorted(str(r.doc_id) for r in rows if name != "op10" or r.start == 0)
    assert ids == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert WHOLE[name](docs.limit(0), tables).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, docs, tables, name):
    out = STAGES[name](docs, tables)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[4:] == ("other", 1, "w", 2, 3) for r in rows)
    if name in ("near copies", "equal fingerprints"):
        assert len({r.text for r in rows}) == len(rows)
    other = docs.toDF("DOC_ID", "Text", "lang", "SOURCE", "x", "n", "word", "h", "c0")
    assert STAGES[name](other, tables).columns == other.columns
    assert STAGES[name](docs.limit(0), tables).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<p>" + "x" * 100_000), (1, "u", "<p>" + "x" * 100_000), (None, None, None), (2, "a\nb", ""), (None, "v", "y" * 200)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, HTML string, digest long")
    got = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted((str(i), len(h or "")) for i, _, h in rows)
    assert all(r.error is None for r in got) and warc.round_trip(pages.limit(0)).count() == 0
