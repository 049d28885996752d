import collections
import hashlib
import random
import re

import pytest

from lectern.llm import decontamination as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def brute(docs, items, window=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if k := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= k
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def same(spark, docs, items, **more):
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    bb = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in D.report(dd, bb, **more).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))
    return sum(r[5] for r in got)


def test_tables(spark, tiny, **more):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    assert same(spark, docs, items, **more) > 0


@pytest.mark.parametrize("seed", range(3))
def test_few_words_and_short_items(spark, seed):
    rng = random.Random(seed)
    make = lambda kinds, n: " ".join(rng.choices("ab c1 é d".split()[:kinds], k=n))
    items = [(i % 7, make(2 + seed, rng.choice([0, 3, 7, 9, 10, 11, 12, 20, 30]))) for i in range(10)] + [(99, None), (None, make(2, 10))]
    docs = [(i, make(2 + seed, rng.randint(0, 80))) for i in range(60)] + [(100, None), (None, ""), (5, make(2, 400))]
    same(spark, docs, items)


def test_blocks(spark, tiny):
    """More than eight blocks, one after another; none is built again for a text that was hit."""
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    size = sum(len(words(r.text)) for r in bench.collect()) // 8
    assert len([*D.blocks(bench, size)]) >= 8
    test_tables(spark, tiny, most=size)
    whole, cut = (sorted(map(tuple, D.clean(docs, bench, most=most).collect()), key=repr) for most in (D.BLOCK_WORDS, size))
    assert whole == cut


def test_an_automaton_is_built_once(spark, tiny):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("text").toArrow().column(0).to_pylist()
    held = D._with_hits(spark.createDataFrame([(t,) for t in rows], "text string")).toArrow()
    before, hit = D.built, 0
    for i, items in enumerate(D.blocks(bench, 300)):
        block = type("Held", (), {"value": items, "key": f"key{i}"})
        for out in D._step(block, D.WINDOW, 0, 2, 3, 1)(iter(held.to_batches(max_chunksize=20))):
            hit += sum(map(bool, out.column("_spans").to_pylist()))
        assert D.built == before + i + 1 and len(D._built) == 1
    assert hit > 0


def test_empty(spark):
    same(spark, [], [(1, "a b")])
    same(spark, [(1, "a b")], [])


def test_clean(spark, tiny):
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    text = bench.first().text
    docs = docs.unionByName(spark.createDataFrame([(9001, text, "en", "s", len(text)), (9002, f"Some words before. {text} And {'more ' * 90}after.", "en", "s", 0), (9003, None, None, None, None)], docs.schema))
    before = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id for r in D.report(docs, bench).where("contaminated").collect()}
    done = D.clean(docs, bench)
    assert done.columns == docs.columns and D.report(done, bench).where("contaminated").count() == 0
    rows = {r.doc_id: r for r in done.collect()}
    assert 9001 not in rows and rows[9002].text.startswith("Some words before.") and rows[9002].n_chars == len(rows[9002].text)
    assert all(rows[i] == r for i, r in before.items() if i not in found)


def test_clean_until_nothing_is_hit(spark):
    """Passages inside passages, and cuts that bring new windows together."""
    item = [f"w{i}" for i in range(10)]
    inner = " ".join(item)
    text = "start " + " ".join(item[:5]) + " " + " ".join(item[:3]) + f" {inner} " + " ".join(item[3:]) + " " + " ".join(item[5:]) + " end of it " + "filler " * 40
    rows = [(1, text), (2, "a a a b b b " + "clean " * 20), (3, None), (4, ""), (5, "nothing " * 30), (5, "nothing " * 30), (6, inner + " " + inner[:20])]
    docs = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id long, Text string, source string, more string")
    bench = spark.createDataFrame([("i", inner), ("j", "a b"), (None, None)], "item_id string, text string")
    done = D.clean(docs, bench)
    assert done.columns == docs.columns
    got = sorted((r.doc_id, r.Text) for r in done.collect())
    assert [i for i, _ in got] == [1, 2, 3, 4, 5, 5]
    assert dict(got)[1].split() == "start end of it".split() + ["filler"] * 40 and dict(got)[2].split() == ["clean"] * 20
    assert D.report(done, bench).where("contaminated").count() == 0


def test_one_block_is_found_and_cut_in_one_worker(spark, tiny):
    """One pass to Python and back, so a task holds one worker and one set of batches."""
    docs, benchmark = (spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("documents", "benchmark"))
    out = D.clean(docs, benchmark)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    several = {tuple(r) for r in D.clean(docs, benchmark, most=300).collect()}
    assert {tuple(r) for r in out.collect()} == several
