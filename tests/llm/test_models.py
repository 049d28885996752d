"""What learns: language model, toxicity, quality classifier; and the pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import attention, lm, quality_classifier, toxicity
from lectern.llm.common import as_text

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _net(kinds=50):
    m = attention.Attention(kinds, 5)
    rng = np.random.default_rng(0)
    table = rng.random((kinds, 5)).astype(np.float32)
    return m, rng, table / table.sum(0)


def test_gradient():
    m, rng, table = _net()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    first = np.array([0, 5, 5, 70, 133])
    x, c, given = rng.integers(0, 50, 133), rng.integers(0, 50, 133), rng.random(133) * (rng.random(133) < 0.5)
    at = attention.windows(first)
    _, grad, symbols, share = m.gradient(x, c, given, lambda s: table[s].astype(float), *at)
    rows, of = grad.pop("embed")
    grad["embed"] = np.zeros_like(m.w["embed"])
    grad["embed"][rows] = of
    assert sorted(symbols) == sorted(c) and np.allclose(share.sum(1), 1)
    for k, v in m.w.items():
        i = (x[3], 2) if k == "embed" else tuple(rng.integers(0, n) for n in v.shape)
        old, e = v[i], 1e-4
        v[i] = old + e
        up = m.gradient(x, c, given, lambda s: table[s].astype(float), *at)[0]
        v[i] = old - e
        down = m.gradient(x, c, given, lambda s: table[s].astype(float), *at)[0]
        v[i] = old
        assert abs((up - down) / (2 * e) - grad[k][i]) < 1e-4 + 0.01 * abs(grad[k][i])


def test_each_symbol_once_and_causal():
    m, rng, table = _net()
    first = np.array([0, 1, 40, 140, 140, 300])
    x, c, given = rng.integers(0, 50, 300), rng.integers(0, 50, 300), np.zeros(300, np.float32)
    lp = m.log_probability(x, c, given, table, first)
    b, s, _ = attention.windows(first)
    assert sorted(j for a, n in zip(b, s, strict=True) for j in range(a, a + n)) == list(range(300))
    later = x.copy()
    later[200:] = (later[200:] + 1) % 50
    changed = m.log_probability(later, c, given, table, first)
    assert np.allclose(lp[:200], changed[:200], atol=1e-5) and not np.allclose(lp[200:], changed[200:], atol=1e-5)
    other = rng.random(50)
    other /= other.sum()
    for part0 in (np.zeros(50), other):  # a distribution over all symbols, with part 0 and without
        total = sum(np.exp(m.log_probability(x, np.full(300, k), np.full(300, part0[k], np.float32), table, first)) for k in range(50))
        assert np.allclose(total, 1, atol=1e-4)


def test_spelling_is_a_distribution():
    kind = 9
    words, n = [[0, 1], [0, 3, 1], [2, 2, 5], [7]], [3, 1, 2, 4]
    count = {size: collections.Counter() for size in (1, 2, 3)}
    for w, k in zip(words, n, strict=True):
        p = [8, 8, *w]
        for i in range(2, len(p)):
            count[1][p[i]] += k
            count[2][p[i - 1] * 9 + p[i]] += k
            count[3][(p[i - 2] * 9 + p[i - 1]) * 9 + p[i]] += k
    single = np.array([float(count[1][i]) for i in range(kind)])
    s = lm.Spelling(kind, single, {k: (np.array(list(count[k])), np.array(list(count[k].values()))) for k in (2, 3)})
    for two in range(kind):
        for one in range(kind):
            assert abs(s.probability(np.full(kind, two), np.full(kind, one), np.arange(kind)).sum() - 1) < 1e-9
    less = lm.Spelling(kind, single - (np.arange(kind) == 3), {k: (np.array([g for g in count[k] if g not in gone]), np.array([v for g, v in count[k].items() if g not in gone])) for k, gone in ((2, {0 * 9 + 3}), (3, {8 * 81 + 3}))})
    three = [np.array([x]) for x in (8, 0, 3)]
    assert abs(s.probability(*three, left_out=True)[0] - less.probability(*three)[0]) < 0.05


def _direct(model, text):
    """Log10 probability of a text, a symbol at a time."""
    from lectern.llm.tokens import encoder

    net, e = model.attention, encoder()
    sequence, given, bounds = [], [], []
    for w in [*re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(LOW)), None]:
        ids = e.segments([w.decode()])[0].astype(int) * 2 if w is not None else [len(model.inputs) - 1]
        ids = [*ids[:-1], ids[-1] + (w is not None)]
        end = len(model.inputs) - 1
        before = [end, end]
        for j, s in enumerate(ids):
            given.append(float(model.spelling.probability(*[np.array([k]) for k in (before[-2], before[-1], s)])[0]) if j else 0.0)
            before.append(s)
        bounds.append(len(sequence))
        sequence += ids
    total = 0.0
    for t, s in enumerate(sequence):
        start = t // attention.STRIDE * attention.STRIDE
        low = max(0, start - attention.CONTEXT)
        seen = [model.inputs[sequence[k - 1]] if k else model.inputs[-1] for k in range(low, t + 1)]
        h = net.w["embed"][seen].astype(float) + net.w["place"][[k - start + attention.CONTEXT for k in range(low, t + 1)]]
        a = np.exp((h[-1] @ net.w["q"]) @ (h @ net.w["k"]).T * attention.WIDTH**-0.5)
        z = (a / a.sum()) @ (h @ net.w["v"]) @ net.w["o"] + h[-1]
        u = z + np.maximum(z @ net.w["up"], 0) @ net.w["down"]
        p = u @ net.w["out"] + net.w["bias"]
        p = np.exp(p - p.max()) * np.append(given[t] > 0, np.ones(attention.PARTS - 1))
        total += math.log10(p @ np.append(given[t], model.table[s][1:].astype(float)) / p.sum())
    return total


@pytest.mark.parametrize(("head", "chunk"), [(lm.HEAD, lm.CHUNK), (300, 60)])
def test_scores(spark, tiny, monkeypatch, head, chunk):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "LEAST", 400)
    monkeypatch.setattr(lm, "STEPS", 60)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    letters = lambda n: "".join(chr(97 + x) for x in np.random.default_rng(n).integers(0, 26, n))
    long = [(7002, letters(2_400)), (7003, letters(9_600)), (7004, "only here " * 50)]
    docs = docs.unionByName(spark.createDataFrame([(5001, None), (None, "the cat"), (7000, " \n"), (7001, "Zzz the\tthe"), (7001, "Zzz the\tthe"), *long], docs.schema))
    given = docs.collect()
    tokens = [(r.doc_id, [*re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(LOW)), b""]) for r in given]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    plain = lm.columns_of(docs, "doc_id", "text")
    counts = lm.word_counts(plain)
    model = lm.fit(counts, plain.where(lm.fold("doc_id", 10) != 0).withColumn("text", lm.F.coalesce("text", lm.F.lit(""))))
    rows = lm.score(docs.withColumn("TEXT_", lm.F.lit(1)).withColumnRenamed("TEXT_", "TEXT"), model, counts).collect()
    assert len(rows) == len(tokens)
    texts, by_id = dict((r.doc_id, r.text or "") for r in given), dict(tokens)
    for r in rows:
        t = by_id[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    by = {r.doc_id: r.score for r in rows}
    for i in [5001, None, 7000, 7001, 7002, 7003, *[r.doc_id for r in rows if r.n_tokens < 120][:8]]:
        assert abs(by[i] - _direct(model, texts[i])) < 1e-3 * max(1, abs(by[i])), i
    assert by[7003] < by[7002] < -300  # no floor
    assert lm.scored(docs.limit(0)).count() == 0


def test_held_out_rows_are_scored_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.scored(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert got.s > got.b + 0.02


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    syllables = "th er on an re nd ti es or en at ed".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.integers(20, 300))]
        toxic = int(i % 3 == 0)
        for _ in range(4 * toxic):
            w.insert(rng.integers(0, len(w)), str(rng.choice(["nastygram", "dimwitted", "blockhead"])))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (9000, None), (None, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (9000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, known).collect()}
    truth = dict(labels)
    held = [got[i] for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and len(got) == len(rows) + 2
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    none = toxicity.classify(docs, known.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.classify(docs.limit(0), known).count() == 0


def test_toxicity_by_hand():
    """Gains, features and score beside plain compression of each window."""
    import zstandard

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice("th er on an re nd ti es".split(), rng.integers(1, 5)))
    texts = [toxicity.normal(" ".join([word() for _ in range(rng.integers(20, 120))] + ["blockhead dimwitted"] * (3 * (i % 2)))) for i in range(80)]
    model = toxicity.fit(texts, [i % 2 for i in range(80)])
    z = zstandard.ZstdCompressionParameters(window_log=20, chain_log=18, hash_log=17, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    size = lambda w, d: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=z).compress(w))
    scorer = toxicity.Scorer(model)
    for b in texts[:12]:
        gains = [size(w, model.ordinary) - size(w, model.toxic + model.ordinary) for w in toxicity.windows(b)]
        assert scorer.gains(b).tolist() == gains
        top = sorted(gains, reverse=True)
        x = [top[0], np.mean(top[:2]), np.mean(top[:4]), np.mean(gains), np.log(len(gains)), *[np.log1p(sum(g >= t for g in gains)) for t in toxicity.THRESHOLDS]]
        assert np.allclose(scorer.features(b), x)
        scaled = model.weights[0] + ((np.array(x) - model.mean) / model.scale) @ model.weights[1:]
        assert abs(scorer.score(b) - 1 / (1 + np.exp(-np.clip(scaled, -40, 40)))) < 1e-12


def test_toxicity_learns_from_long_texts_and_few(spark):
    """Sixty texts that are all long, the same cut short, and ids that repeat with other texts."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice("th er on an re nd ti es or en at ed".split(), rng.integers(1, 5)))
    make = lambda toxic, n: " ".join(word() if not toxic or rng.random() > 0.05 else str(rng.choice(["nastygram", "dimwitted", "blockhead"])) for _ in range(n))
    for words in (4_500, 2_000, 60):
        rows = [(i, make(i % 2, words)) for i in range(60)]
        docs = spark.createDataFrame(rows + [(0, f"another text {i}") for i in range(50)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
        assert len(toxicity.sample(docs, labels)[0]) <= 60
        got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).where("length(string(doc_id)) > 0 and doc_id > 0").collect()}
        assert len(set(got.values())) > 10
        assert np.mean([got[i] for i in got if i % 2]) > np.mean([got[i] for i in got if not i % 2]) + 0.2, words
    long = "abcdefghij" * 4_000
    assert spark.createDataFrame([(long,)], "t string").select(toxicity.F.length(toxicity.shortened(toxicity.F.col("t")))).first()[0] == toxicity.FIT_CHARS + toxicity.FIT_PARTS - 1


def test_windows_cover():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        b = bytes(i % 251 for i in range(n))
        w = toxicity.windows(b)
        assert w[0] == b[:64] and sum(len(x) for x in w) >= n and (n == 0 or w[-1].endswith(b[-1:]))


def test_quality_classifier(spark):
    from pyspark.sql import functions as F

    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(spark.createDataFrame([(9000, None, None, None, None), (9001, "", "x", "y", 0)], docs.schema))
    got = quality_classifier.classify(docs)
    truth = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    share = {r.quality: r.k for r in truth}
    assert share[1] > 0.97 and share[0] < 0.5
    assert {r.kept for r in got.where("doc_id >= 9000").collect()} == {True}
    kept = quality_classifier.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_classifier.classify(docs.limit(0)).count() == 0


def test_quality_score_by_hand(spark, tiny):
    """Posterior and score of each text, beside plain Python on the same model."""
    from lectern.llm.decontamination import _hash

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(7000, "the"), (7001, "The the THE!! fox"), (7001, "The the THE!! fox"), (7002, None)], docs.schema))
    model = quality_classifier.fit(docs)

    def features(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        out, before = collections.Counter(), None
        for w in words:
            low = w.translate(LOW)
            out[_hash(low) >> 48] += 1
            shape = (_hash(w[-6:].translate(quality_classifier._SHAPES)) * 3 + (low == before)) % (1 << 64)
            out[(shape * 0x9E3779B97F4A7C15) % (1 << 64) >> 48] += 1
            before = low
        return {k: math.sqrt(n) for k, n in out.items()}

    texts = dict((r.doc_id, r.text) for r in docs.collect())
    for r in quality_classifier.judged(docs, model).collect():
        f = features(texts[r.c0])
        norm = math.sqrt(sum(v * v for v in f.values())) or 1
        score = 1 / (1 + math.exp(-(sum(model.weights[k] * v for k, v in f.items()) / norm + model.bias)))
        votes = quality_classifier.Texts(as_text(pa.array([texts[r.c0] or ""]))).calls[0].astype(int)
        odds = [math.prod(model.likely[j, y, v + 1] for j, v in enumerate(votes) if v != quality_classifier.MISSING) * p for y, p in ((0, 1 - model.prior), (1, model.prior))]
        assert abs(r._score - score) < 1e-6 and abs(r._posterior - odds[1] / sum(odds)) < 1e-6
        assert r._kept == (score >= quality_classifier.CUT or not f)


def test_expectation_maximisation():
    rng = np.random.default_rng(0)
    k = len(quality_classifier.LABELLERS)
    good = rng.random(4000) < 0.8
    right = rng.random((4000, k)) < 0.85
    votes = np.where(right == good[:, None], 1, -1)
    votes[rng.random((4000, k)) < 0.2] = 0
    rows, n = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.expectation_maximisation(dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True)))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.likely[:, 1, 2] / (model.likely[:, 1, 0] + model.likely[:, 1, 2]) - 0.85).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


def test_measures():
    texts = quality_classifier.Texts(as_text(pa.array(["the cat sat. the dog ran.", "A!! B!! C!!", "", "x x x x x x x x"])))
    assert texts.calls.shape == (4, len(quality_classifier.LABELLERS)) and (texts.calls[2] == quality_classifier.MISSING).all()
    names = list(quality_classifier.LABELLERS)
    assert texts.calls[1][names.index("shouts")] == -1 and texts.calls[3][names.index("stutter")] == -1 and texts.calls[0][names.index("plain")] == 1


def test_pipeline(spark, tiny):
    import corpus_pipeline
    from lectern.llm import decontamination, near_copies, quality_rules

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], tiny)
        assert i == 4 or out.columns == docs.columns
        frames.append(out.cache())
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[1] == {r.doc_id for r in quality_rules.judge(frames[0]).where("kept").collect()}
    assert ids[2] <= ids[1] and len(ids[2]) > 0.9 * len(ids[1])
    assert ids[3] == {r.doc_id for r in near_copies.deduplicated(frames[2]).collect()} and len(ids[3]) < len(ids[2])
    packed = frames[5].collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
    assert decontamination.report(frames[4], spark.read.parquet(f"{tiny}/benchmark.parquet")).where("contaminated").count() == 0
    assert ids[5] == ids[4] and sum(r.length for r in frames[5].collect()) == sum(r.doc_tokens for r in frames[5].where("start = 0").collect())
    assert corpus_pipeline.run(spark, tiny).count() == frames[5].count()


def test_stages_remove_what_others_left(spark, tiny):
    """Tables that a stage writes for itself go when the next begins, unless they are still read."""
    import glob

    import corpus_pipeline
    from lectern.session import shared_dir

    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    (_, rules), (_, classifier), *_ = corpus_pipeline.STAGES
    there = lambda: set(glob.glob(f"{shared_dir(spark)}/*"))
    one = rules(spark, docs, tiny)
    counted = {p for p in there() if "/counted-" in p and any(p in f for f in one.inputFiles())}
    assert counted
    classifier(spark, one, tiny)  # not written in between
    assert counted <= there()
    kept = corpus_pipeline.written(rules(spark, docs, tiny), "one")
    own = set(corpus_pipeline._left[spark.sparkContext.applicationId])
    classifier(spark, kept, tiny)
    assert own and not {p.rpartition("/")[2] for p in own} & {p.rpartition("/")[2] for p in there()}
    assert kept.count() > 0


def test_quality_sample_has_long_and_different_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("lang = 'en'").limit(300).collect()
    prose = " ".join(r.text for r in docs)
    junk = "BUY NOW!!! $$$ #### click click click *** FREE!!! %%% "
    rows = [(i, prose[i * 500 : i * 500 + 25_000]) for i in range(30)] + [(100 + i, junk * (500 + i)) for i in range(10)]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows) > 20_000
    got = {r.doc_id: r for r in quality_classifier.classify(long).collect()}
    assert all(got[i].kept for i in range(30)) and not any(got[100 + i].kept for i in range(10))
    copies = spark.createDataFrame([(1000 + i, "one row many times") for i in range(400)], "doc_id long, text string")
    sample = quality_classifier.sampled_features(long.unionByName(copies).repartition(5)).collect()
    assert len(sample) == 41 and len({r.h for r in sample}) == 41
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert {(r.kept, r.score == r.posterior) for r in quality_classifier.classify(nothing).collect()} == {(True, True)}


def test_pieces_are_of_every_text(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("lang = 'en'").limit(400).collect()
    prose = " ".join(r.text for r in docs)
    rows = [(i, prose[i * 9_000 : i * 9_000 + 21_000]) for i in range(20)] + [(100, "")]
    long = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = long.select("text", lm.F.xxhash64("doc_id", "text").alias("h")).mapInArrow(lm.cut_pieces, lm.PIECES).collect()
    assert len(found) == sum(1 + len(t.split()) // lm.PER for _, t in rows)


def test_pieces_are_of_the_text(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 3)
    texts = ["", "a b", " ".join(f"w{i}" for i in range(5000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 2, 3])], ["text", "h"])
    (out,) = lm.cut_pieces(iter([batch]))
    rows = out.to_pylist()
    assert len(rows) == 5 and rows[0] == rows[0] | {"opens": True, "closes": True, "skip": 0} and len(rows[0]["symbols"]) == 1
    c = lm.Chunk(pa.Table.from_batches([out]))
    begin, size, before = c.windows()
    assert (c.symbols == c.end).sum() == sum(r["closes"] for r in rows)
    size_of = np.diff(c.begin) - c.skip
    assert size.sum() == size_of.sum() and (before == np.minimum(attention.CONTEXT, begin - np.repeat(c.begin[:-1], -(-size_of // attention.STRIDE)))).all()


def test_lm_learns_from_every_symbol(spark, monkeypatch):
    """What the parts had of all symbols is what the learning texts hold, beside the pieces that training begins with; also where
    several tasks learn, and of texts far longer than a piece."""
    for name, value in {"LEAST": 40, "CHUNK": 20, "STEPS": 5, "FEW": 2_000}.items():
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"{'abc'[k % 3] * 4}{k}" for k in rng.integers(0, 90, [3, 50, 900][i % 3]).tolist())) for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    counts, seen = lm.word_counts(docs), []
    taken = lm._taken
    monkeypatch.setattr(lm, "_taken", lambda out, model, sums: (seen.append(sums.sum()), taken(out, model, sums), seen.append(sums.sum())))
    learn = docs.where(lm.fold("doc_id", 10) != 0).withColumn("text", lm.F.coalesce("text", lm.F.lit("")))
    lm.fit(counts, learn)
    words = lm.Words(as_text(pa.array([r.text for r in learn.collect()])), lm.TABLE)
    assert len(seen) == 4 and abs(seen[3] - seen[2] - len(lm.Symbols(words).symbols)) < 1
