"""What keeps learning from all texts cheap, beside plain computations."""

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import attention, lm
from lectern.llm.common import Words, as_text


def head_of(words):
    return lm.Head.of(pa.table({"word": pa.array(words, pa.string()), "n": pa.array(range(len(words)), pa.int64())}))


@pytest.mark.parametrize("collide", [False, True])
def test_head_is_found_by_hash(monkeypatch, collide):
    """A word with another's hash is not taken for it."""
    if collide:
        plain = lm.hashed
        monkeypatch.setattr(lm, "hashed", lambda words: plain(words) % np.uint64(3))
    words = ["ab", "b", "é", "abc", "x" * 200, "ba"]
    asked = ["b", "zz", "ab", "é", "e", "x" * 200, "x" * 199, "abc", "cba"]
    found = head_of(words).find(pa.array([w.encode() for w in asked], pa.large_binary())).tolist()
    right = [words.index(w) if w in words else -1 for w in asked]
    assert found == right if not collide else all(f in (r, -1) for f, r in zip(found, right, strict=True)) and max(found) >= 0
    assert head_of([]).find(pa.array([b"a"], pa.large_binary())).tolist() == [-1]
    assert head_of(words).find(pa.array([], pa.large_binary())).tolist() == []


def test_learning_spells_no_word_of_the_head_again(monkeypatch):
    """The tasks that learn from all texts get the head; symbols and part 0 are as without it."""
    texts = common_texts()
    rng, kind = np.random.default_rng(1), lm.symbols_in_all()
    plain = lm.Symbols(Words(as_text(pa.array(texts)), lm.TABLE))
    single = np.bincount(plain.symbols, minlength=kind).astype(float)
    two, one = lm.in_words(plain.symbols.astype(np.int64), np.append(True, plain.symbols[:-1] % 2 == 1), kind)
    x = plain.symbols.astype(np.int64)
    spelling = lm.Spelling(kind, single, {2: np.unique(one * kind + x, return_counts=True), 3: np.unique((two * kind + one) * kind + x, return_counts=True)})
    head = head_of(sorted({w for t in texts[:20] for w in t.lower().split()}))
    head.given = spelling.inside(head.pool, head.start, left_out=True)
    common, net = (single + 0.5) / (single + 0.5).sum(), attention.Attention(lm.SEEN + lm.SHARED + 1)
    inputs = (np.arange(kind) % (lm.SEEN + lm.SHARED)).astype(np.int32)
    sums = (common[:, None] * rng.random((1, attention.PARTS)) * 1e4).astype(np.float32)
    out, spelt = [], []
    real = lm.spelled
    monkeypatch.setattr(lm, "spelled", lambda words: spelt.append(len(words)) or real(words))

    class Sent:
        pass

    for h in (None, head):
        Sent.value = (lm.Model(net, spelling, inputs, np.zeros(0), h, 0, 0, 0), sums, common)
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20])], ["text"]) for i in range(0, len(texts), 20)]
        rows = pa.Table.from_batches(list(lm._learns(Sent, False)(iter(batches))))
        out.append(rows.to_pylist())
    half = len(spelt) // 2
    assert sum(spelt[half:]) < 0.8 * sum(spelt[:half]) and spelt[half] == 0
    assert len(out[0]) == len(out[1])
    for a, b in zip(*out, strict=True):
        assert a["symbol"] == b["symbol"] and (a["sums"] is None or np.allclose(a["sums"], b["sums"], rtol=1e-4, atol=1e-4))


def common_texts():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("mor", "ta", "Quin", "él", "x") for b in ("na", "dor", "7", "ßt", "")]
    return [" ".join(rng.choice(words, rng.integers(0, 80))) for _ in range(60)] + ["only here", "", "tonight nowhere else"]


def test_sums_of_rows_by_key():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 15, 1 << 16, 1 << 17, 1 << 33):
        keys, rows = rng.integers(0, most, 5000), rng.random((5000, 4))
        at, found = attention.summed(keys, rows)
        right, of = np.unique(keys, return_inverse=True)
        total = np.zeros((len(right), 4))
        np.add.at(total, of, rows)
        assert (at == right).all() and np.allclose(found, total)


def test_steps_of_a_fixed_table_sort_nothing(monkeypatch):
    """Shares and inputs are summed by key without a sort, and all weights take a step at once, as one by one."""
    rng, kinds, seen = np.random.default_rng(3), 50, []
    net, first = attention.Attention(kinds, 5), np.array([0, 5, 5, 70, 700])
    x, c, given = rng.integers(0, kinds, 700), rng.integers(0, kinds, 700), (rng.random(700) * (rng.random(700) < 0.5)).astype(np.float32)
    plain = attention.Attention.gradient

    def noted(self, *rest):
        loss, grad, symbols, share = out = plain(self, *rest)
        whole = np.zeros_like(self.w["embed"])
        whole[grad["embed"][0]] = grad["embed"][1]
        seen.append(({k: g.copy() for k, g in grad.items() if k != "embed"} | {"embed": whole}, symbols.copy(), share.copy()))
        return out

    def sort(*_):
        raise AssertionError("rows are sorted")

    monkeypatch.setattr(attention.Attention, "gradient", noted)
    monkeypatch.setattr(attention, "summed", sort)
    monkeypatch.setattr(attention.Training, "BATCH", 4)
    monkeypatch.setattr(attention.Training, "HELD", 2)
    want = {k: v.astype(float) for k, v in net.w.items()}
    training = attention.Training(net, rng.random((kinds, 5)), np.full(kinds, 1 / kinds), 100, fixed=True)
    training.on(x, c, given, *attention.windows(first))
    m, s = ({k: np.zeros_like(v) for k, v in want.items()} for _ in range(2))
    sums = np.zeros((kinds, 5))
    assert len(seen) > 3
    for step, (grad, symbols, share) in enumerate(seen, 1):
        np.add.at(sums, symbols, share)
        rate = 0.01 * min(1, step / 20) * max(0.05, 1 - 0.95 * step / 100)
        for k, g in grad.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g.astype(float) ** 2
            want[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    assert np.allclose(training.sums, sums, rtol=1e-5) and abs(training.sums.sum() - 700) < 1e-2
    assert all(np.allclose(net.w[k], want[k], atol=1e-5) for k in want)


def test_every_gram_counts(spark, tiny, monkeypatch):
    """Grams and contexts beyond those that are sent to all workers come beside the texts: scores are the same whatever the bound."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(1000, None), (None, "Zzyzx zzyzx qwrtplk"), (1001, "Zzyzx zzyzxqwrt " * 40), (1002, "")], "doc_id bigint, text string"))
    scores = {}
    for bound in (lm.GRAMS, 1500, 0):
        monkeypatch.setattr(lm, "GRAMS", bound)
        scores[bound] = {r.doc_id: (r.score, r.base_score, r.n_known, r.n_tokens) for r in lm.scored(docs).collect()}
    whole = scores.pop(1_000_000)
    for found in scores.values():
        assert found.keys() == whole.keys() and len(found) == 64
        for k, x in found.items():
            np.testing.assert_allclose(x, whole[k], rtol=1e-4)
