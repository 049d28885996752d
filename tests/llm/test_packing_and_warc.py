import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing, tokens, warc

TEXTS = ["", " ", "  ", "a ", " a", "a\n", "a\n ", "\n\nb  c", "x <|endoftext|> y", "don't  stop", "é  b", "a b c", "\x1c a b", "12 34.5\t x", "a \nb", "a\r\n b", "\n", "z\n\n z", "😀 😀a", "word " * 3000]


def test_ids_are_the_tokenizers(spark, tiny):
    exact = Tokenizer.from_file(tokens.vocabulary_paths()[0])
    texts = TEXTS * 2 + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    ids, first = tokens.encoder().encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    length = rng.integers(1, [2049, 600, 100, 1100][seed], 800)
    sequence, offset = packing.best_fit_decreasing(length)
    rooms = []
    for size in sorted(length.tolist(), reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms[rooms.index(min(fits))] -= size
        else:
            rooms.append(2048 - size)
    fill = np.bincount(sequence, length).astype(int)
    assert sorted(2048 - fill) == sorted(rooms)
    for s in range(len(fill)):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(length[at]) - length[at]).all()


def test_pack(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate([None, *TEXTS])] + [(None, "a b"), (1, "again")], docs.schema))
    exact = Tokenizer.from_file(tokens.vocabulary_paths()[0])
    wanted = collections.Counter()
    for r in docs.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            wanted[r.doc_id, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = packing.pack(docs, per_group=50).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == wanted
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.pack(docs).collect()
    assert sum(r.length for r in whole) / 2048 / len({r.sequence_id for r in whole}) > 0.97
    assert packing.pack(docs.limit(0)).count() == 0
    assert all(len(r.ids) == r.length for r in packing.pack(docs.limit(9), keep_ids=True).collect())


def test_chunks():
    for payload in (b"", b"a", b"x" * 10000, b"\r\n0\r\n\r\n" * 999):
        assert warc.unchunked(warc.chunked(payload)) == payload
    for bad in (b"", b"5\r\nab", b"2\r\nabXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_segments():
    parts = warc.segments("response", "1", b"x" * 25, 10)
    heads = [h for h, _ in warc.records(b"".join(p + warc.END for p in parts))]
    assert [h["warc-segment-number"] for h in heads] == ["1", "2", "3"]
    assert [h["warc-type"] for h in heads] == ["response", "continuation", "continuation"]
    assert heads[2]["warc-segment-total-length"] == "25" and heads[1]["warc-segment-origin-id"] == heads[0]["warc-record-id"]


def test_round_trip(spark, tiny, tmp_path):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html")
    more = [(5000, None, None), (5001, "a b\nc", "x"), (5005, "v", "x"), (None, "u", "y" * 200), (5003, "u", "y" * 200), (5002, "w", "y" * 200), (5004, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (5006, "", "é" * 49), (5007, "", "é" * 49), (5008, "", "é" * 50), (5009, "", "é" * 50)]
    pages = pages.unionByName(spark.createDataFrame(more, pages.schema))
    rows, least = pages.collect(), {}
    for r in rows:
        if r.page_id is not None:
            least[r.html] = min(least.get(r.html, r.page_id), r.page_id)
    wanted = set()
    for r in rows:
        payload = (r.html or "").encode()
        again = len(payload) >= 100 and r.page_id != least[r.html]
        wanted.add((r.page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", least[r.html] if again else None, None))
    path = str(tmp_path / "warc")
    got = warc.round_trip(pages, path).collect()
    assert len(got) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in got} == wanted
    assert max(r.segments for r in got) > 5
    full = {r.page_id: r.payload for r in warc.read(spark, path, keep_payload=True).where("record_type = 'response'").collect()}
    assert full[5004].decode() == more[6][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lost_segment(spark, tmp_path):
    parts = warc.segments("response", "1", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 50, 20, Payload_Digest="sha256:0")
    (tmp_path / "a.warc").write_bytes(b"".join(p + warc.END for p in [parts[0], *parts[2:]]))
    assert warc.read(spark, str(tmp_path)).first().error == "segments missing"


def test_archives_of_several_runs_are_read_together(spark, tmp_path):
    page = lambda i, html: (i, f"http://a/{i}", html)
    long = "<p>" + "lorem " * 9000 + "</p>"
    runs = [[page(1, long), page(2, long), page(3, "x" * 200), page(3, "x" * 200), page(4, "x" * 200)], [page(11, long), page(12, long)]]
    for k, rows in enumerate(runs):
        warc.write(spark.createDataFrame(rows, "page_id long, URL string, html string").coalesce(1), str(tmp_path / f"run{k}"))
    got = warc.read(spark, str(tmp_path / "*")).collect()
    assert all(r.error is None for r in got)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == sorted([(1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "response", None), (4, "revisit", 3), (11, "response", None), (12, "revisit", 11)], key=lambda x: (x[0], x[1]))
    heads = [h for f in tmp_path.glob("run*/part*") for h, _ in warc.records(__import__("gzip").decompress(f.read_bytes()))]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(heads) and all(h["content-type"] == warc.HTTP for h in heads if h["warc-type"] != "continuation")
    for h in heads:
        if h["warc-type"] == "revisit" and h["warc-refers-to-page-id"] != "3":
            assert ids[h["warc-refers-to"]]["warc-page-id"] == h["warc-refers-to-page-id"]
        elif h["warc-type"] == "revisit":
            assert "warc-refers-to" not in h  # page 3 has two records, so none of them is named
