"""Files, charsets, archives, sinks and streams."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators.rule_tables import load_rules
from lectern.sources import files, folders, text_files
from lectern.streaming import session_table, streams


def archive(name, text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, text)
    return b.getvalue()


DOCX = archive("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Eins</w:t></w:r></w:p><w:p><w:r><w:t>Zwei</w:t></w:r></w:p></w:body></w:document>')
ODT = archive("content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p>Eins</text:p><text:p>Zwei</text:p></o>')


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, content in {"utf.txt": "Grüße".encode(), "bom.txt": b"\xef\xbb\xbfGr\xc3\xbc\xc3\x9fe", "old.txt": "Grüße für die Bäume und das Öl".encode("cp1252"), "empty.txt": b"", "a.docx": DOCX, "bad.docx": b"nothing", "word.docx": b"\xd0\xcf\x11\xe0x", "a.odt": ODT, "x.doc": b"x", "big.txt": b"x" * 5000, "p.pdf": b"%PDF"}.items():
        (d / name).write_bytes(content)
    return str(d)


def test_admit(spark, folder):
    good, bad = files.admit(files.scan_files(spark, folder), 4000)
    name = lambda df: {r.path.rpartition("/")[2] for r in df.collect()}
    assert name(good) == {"utf.txt", "bom.txt", "old.txt", "a.docx", "bad.docx", "word.docx", "a.odt"}
    assert {r.path.rpartition("/")[2]: r.reason for r in bad.collect()} == {"x.doc": "old Word format: save as .docx", "big.txt": "too large", "p.pdf": "no reader for this kind"}


def test_admit_query_on_odd_rows(spark, tmp_path):
    """Rows without characters are judged by kind as SQL does; ids below zero, null and large, and sizes that are null, too."""
    import duckdb

    from lectern.plans import catalogue

    rows = [(i, n) for i in (*range(-8, 15), None, 2**63 - 1, -(2**63), 10**12 + 1) for n in (0, 3, 5000, 5001, None)]
    spark.createDataFrame(rows, "doc_id bigint, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: (str(r[0]), r[1])
    theirs = con.execute(catalogue.ORACLE_SQL["a02_admit"]).fetchall()
    assert sorted((tuple(r) for r in catalogue.QUERIES["a02_admit"](spark, str(tmp_path)).collect()), key=key) == sorted(theirs, key=key)


def test_decode(spark, folder):
    rows = files.decode_text(files.scan_files(spark, folder, "*.txt").where("length between 1 and 4000")).collect()
    assert {r.path.rpartition("/")[2]: (r.charset, r.text) for r in rows} == {"utf.txt": ("utf-8", "Grüße"), "bom.txt": ("utf-8", "Grüße"), "old.txt": ("cp1252", "Grüße für die Bäume und das Öl")}


def test_decode_as_browsers_do(spark):
    """Bytes that cp1252 leaves open are control characters; what a torn umlaut looks like decides; no Python worker."""
    rows = [("a", "Er sagte „ja“ für die Bäume".encode("cp1252") + b"\x81"), ("b", b"\xc3\xbc und \xe4"), ("c", "5 €".encode("cp1252")), ("d", "\ufeffé".encode())]
    df = files.decode_text(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: (r.charset, r.text) for r in df.collect()} == {"a": ("cp1252", "Er sagte „ja“ für die Bäume\x81"), "b": ("iso8859_15", "ÃŒ und ä"), "c": ("cp1252", "5 €"), "d": ("utf-8", "é")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    every = bytes(range(128, 256))
    one = spark.createDataFrame([(every,)], "c binary").select(files.single_bytes(F.col("c"), "cp1252"), files.single_bytes(F.col("c"), "iso8859_15")).first()
    left_open = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
    assert one[0] == "".join(chr(b) if b in left_open else bytes([b]).decode("cp1252") for b in every) and one[1] == every.decode("iso8859_15")


def test_read_files(spark, folder, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"sub/a.TXT": b"A", "blank.txt": " \u00a0\n".encode(), "long.txt": b"x" * 900, "a.docx": DOCX, "bad.odt": b"PK..", "n.pdf": b"%"}.items():
        (tmp_path / name).write_bytes(content)
    df = files.read_files(spark, str(tmp_path), 800)
    assert {r.path.rpartition("/")[2]: (r.text, r.status.split(":")[0]) for r in df.collect()} == {"a.TXT": ("A", "ok"), "blank.txt": (None, "no text"), "long.txt": (None, "too large"), "a.docx": ("Eins\n\nZwei", "ok"), "bad.odt": (None, "unreadable"), "n.pdf": (None, "no reader for this kind")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:]]
    assert sum("content" in x.split("ReadSchema")[1][:120] for x in scans) == 3 and sum("LessThanOrEqual(length,800)" in x for x in scans) >= 3


def test_many_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Beyond a number of files the driver holds no names: no file source in the plan, and the same rows."""
    for d in ("a/b c", "_staging/x", ".hidden", "part=1"):
        (tmp_path / d).mkdir(parents=True)
    for name, content in {"a/b c/ä%20.TXT": "Grün".encode("cp1252"), "a/x.txt": b"X", "part=1/_no.txt": b"no", "_staging/x/y.txt": b"no", ".hidden/z.txt": b"no", "empty.txt": b"", "blank.txt": b" \n", "long.txt": b"x" * 900, "a.docx": DOCX, "bad.odt": b"PK..", "n.pdf": b"%", "v.exe": b"1"}.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(folders, "ROWS", 2)
    few, many = files.read_files(spark, str(tmp_path), 800), files.read_files(spark, str(tmp_path), 800, few=3)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(few) == rows(many) and len(rows(many)) == 8
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "BinaryFile" not in plan and "mapInArrow" in plan.replace("MapInArrow", "mapInArrow")
    by_source = files.scan_files(spark, str(tmp_path)).select("path", "modificationTime", "length", "content")
    listed = folders.listed(spark, str(tmp_path))
    assert rows(folders.read(listed, 9).selectExpr("path", "date_trunc('second', modificationTime) t", "length", "content")) == rows(by_source.selectExpr("path", "date_trunc('second', modificationTime) t", "length", "content"))
    assert rows(text_files.read_back(spark, str(tmp_path / "a"))) == rows(text_files.read_back(spark, str(tmp_path / "a"), few=0)) != []
    assert rows(files.read_files(spark, str(tmp_path / "part=1"), 800, few=-1)) == [] and folders.listed(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception, match="none"):
        files.read_files(spark, str(tmp_path / "none"))


def test_extract(spark, folder):
    rows = {r.path.rpartition("/")[2]: (r.text, r.status) for r in files.extract_docx(files.scan_files(spark, folder, "*.docx")).collect()}
    assert rows == {"a.docx": ("Eins\n\nZwei", "ok"), "bad.docx": (None, "no archive"), "word.docx": (None, "old Word format")}
    assert files.extract_odt(files.scan_files(spark, folder, "*.odt")).first().text == "Eins\nZwei"


def test_extraction_holds_few_texts(monkeypatch, spark):
    """A batch of archives is passed on in parts, bounded in characters, in order."""
    got = {}

    class Rows:
        columns = ["path", "content"]
        schema = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            got["run"] = run

    monkeypatch.setattr(files, "HELD", 100)
    files._extract(Rows(), lambda c: c.decode() * 30)
    rows = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(20)], "content": [b"x"] * 18 + [None, b"\xff"], "status": [None] * 18 + ["no content", None]})
    parts = list(got["run"](iter([rows, rows.slice(0, 0)])))
    assert len(parts) >= 5 and all(p.num_rows <= 4 for p in parts)
    assert [x for p in parts for x in p.column("path").to_pylist()] == rows.column("path").to_pylist()
    states = [x for p in parts for x in p.column("status").to_pylist()]
    assert states == ["ok"] * 18 + ["no content", "unreadable: UnicodeDecodeError"]


def test_bad_archives(spark):
    broken, locked = bytearray(archive("content.xml", "x" * 500)), bytearray(ODT)
    with zipfile.ZipFile(b := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", "text " * 500)
    torn = bytearray(b.getvalue())
    torn[41:49] = b"\xff" * 8
    locked[6] |= 1
    locked[locked.rindex(b"PK\x01\x02") + 8] |= 1
    rows = [("xml", bytes(broken)), ("torn", bytes(torn)), ("locked", bytes(locked)), ("other", archive("x", "y")), ("cut", ODT[:60]), ("none", None), ("good", ODT)]
    got = {r.path: r.status for r in files.extract_odt(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: v.split(":")[0] for k, v in got.items()} == {"xml": "unreadable", "torn": "unreadable", "locked": "unreadable", "other": "unreadable", "cut": "unreadable", "none": "no content", "good": "ok"}


def test_members_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(files, "MAX_UNPACKED", 100)
    with pytest.raises(ValueError, match="unpacked"):
        files._odt(ODT)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
BODIES = [
    ("<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>A</w:t><w:tab/><w:t>B</w:t><w:br/><w:t>C</w:t></w:r></w:p>", "A\tB\nC"),
    ("<w:p><w:r><w:t>Out</w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>In</w:t></w:r></w:p></w:txbxContent></w:r><w:r><w:t>side</w:t></w:r></w:p><w:p/>", "Outside\n\nIn"),
    ("<w:p><w:r><mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>Box</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:p><w:r><w:t>Box</w:t></w:r></w:p></mc:Fallback></mc:AlternateContent></w:r></w:p>", "Box"),
    ("<w:p><w:r><mc:AlternateContent><mc:Choice/><mc:Fallback><w:t>old</w:t></mc:Fallback></mc:AlternateContent></w:r></w:p>", "old"),
    ("<w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>", "1\n\n2"),
    ("<w:r><w:t>no</w:t></w:r><w:r><w:t>paragraph</w:t></w:r>", "no paragraph"),
    ("<w:p><w:r><w:delText>gone</w:delText><w:t xml:space='preserve'> kept &amp; ü </w:t></w:r></w:p>", " kept & ü "),
]


@pytest.mark.parametrize(("body", "text"), BODIES)
def test_docx_text(body, text):
    assert files._docx(archive("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")) == text


def test_docx_is_read_piece_by_piece():
    import tracemalloc

    many = f"<w:document {W}><w:body>" + "<w:p><w:pPr><w:rPr><w:b/><w:i/></w:rPr></w:pPr><w:r><w:t>x</w:t></w:r></w:p>" * 200_000 + "</w:body></w:document>"
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", many)
    tracemalloc.start()
    text = files._docx(content.getvalue())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) == 200_000 * 3 - 2 and peak < 2 * len(many)
    with pytest.raises(ValueError, match="entities"):
        files._docx(archive("word/document.xml", '<!DOCTYPE a [<!ENTITY b "cc">]><a>&b;</a>'))


def test_decode_keeps_rows_without_content(spark):
    rows = files.decode_text(spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")).collect()
    assert {(r.path, r.charset, r.text) for r in rows} == {("a", None, None), ("b", "utf-8", "")}


def test_write_corpus(spark, tmp_path):
    df = spark.createDataFrame([("a/b:c.txt", "Ein Text.")], "name string, text string")
    files.write_corpus(df, str(tmp_path / "rows"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    row = spark.read.parquet(str(tmp_path / "rows")).first()
    assert (row.file, row.value) == ("a_b_c_bereinigt_2024-01-02T03-04-05", "\ufeffEin Text.")
    more = df.union(spark.createDataFrame([("A_b_c.md", "Zwei."), ("a/b:c.txt", "Drei."), ("x", None)], df.schema))
    for _ in range(2):  # the second time in place of the first
        files.write_corpus(more, str(tmp_path / "out"), F.lit("2024-01-02 03:04:05").cast("timestamp"), as_files=True)
    found = {f.name: f.read_bytes().decode() for f in (tmp_path / "out").rglob("*.txt")}
    end = "_bereinigt_2024-01-02T03-04-05"
    assert set(found) == {f"A_b_c{end}.txt", f"a_b_c{end}_2.txt", f"a_b_c{end}_3.txt", f"x{end}.txt"} and set(found.values()) == {"\ufeffEin Text.", "\ufeffZwei.", "\ufeffDrei.", "\ufeff"}
    assert {(r.file, r.value) for r in text_files.read_back(spark, str(tmp_path / "out")).collect()} == set(found.items())
    assert not list((tmp_path / "out").glob("_staging*"))


def test_texts_are_made_once_before_they_are_numbered(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(x):
        seen.add(1)
        return f"Text {x}."

    df = spark.range(40, numPartitions=2).select(F.lit("a").alias("name"), made.asNondeterministic()("id").alias("text"))
    files.write_corpus(df, str(tmp_path / "out"), F.lit("2024-01-02 03:04:05").cast("timestamp"), as_files=True)
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 40 and seen.value == 40


def test_nothing_is_seen_of_a_failed_write(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).select(F.concat("id", F.lit(".txt")).alias("file"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="no"):
        text_files.write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*")) and text_files.read_back(spark, str(tmp_path / "out")).count() == 0


def test_load_rules():
    assert load_rules('[{"search": "a", "replace": "b"}, {"search": ""}, 3]') == [("a", "b")]
    assert load_rules("{}") == [] and load_rules("no json") == []


def test_streams(spark, tiny, tmp_path):
    from lectern.functions.rules import bind
    from lectern.functions.text import sanitize
    from lectern.plans.corpus import dressed
    from lectern.plans.prepare import clean

    docs = dressed(spark, tiny).select("doc_id", "text")
    home = str(tmp_path)
    docs.where("doc_id < 100").write.parquet(f"{home}/in")
    run = lambda: streams.clean_stream(spark, f"{home}/in", f"{home}/out", f"{home}/state", docs.schema).awaitTermination()
    run()
    docs.where("doc_id >= 100").write.mode("append").parquet(f"{home}/in")
    run()  # from its checkpoint: only what is new
    batch = docs.withColumn("text", bind(F.col("text"), clean)).withColumn("text", sanitize(F.col("text")))
    streamed = spark.read.parquet(f"{home}/out")
    assert streamed.count() == docs.count() and streamed.exceptAll(batch).count() == 0


def test_file_stream_has_few_tasks(spark, tmp_path):
    """However many small files arrive, a batch writes no more files than the session has shuffle partitions."""
    (tmp_path / "in").mkdir()
    for i in range(300):
        (tmp_path / "in" / f"{i}.txt").write_text(f"Text {i}.")
    query = streams.file_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(query.runId) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism  # also of those that look at the files
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_file_stream_driver_holds_no_names(spark, tmp_path):
    """Files are listed and opened by tasks: the stream's own source sees a few files of a table, however many texts arrive. Each
    text comes once, also in later batches; folders may be nested, other kinds, blank and large files stay out."""
    home, seen = tmp_path / "in", []
    (home / "sub").mkdir(parents=True)

    def arrive() -> set:
        query = streams.file_stream(spark, str(home), str(tmp_path / "out"), str(tmp_path / "state"), max_bytes=5000)
        query.awaitTermination()
        assert query.exception() is None
        seen.extend(p.numInputRows for p in query.recentProgress)
        return sorted((r.path.rpartition("/")[2], r.charset, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i in range(300):
        (home / ("sub" if i % 2 else "") / f"{i} ä%.TXT").write_bytes(f"Größe {i}.".encode("utf-8" if i % 3 else "cp1252"))
    for name, content in (("big.txt", b"x" * 6000), ("none.txt", b""), ("blank.txt", b" \n"), ("a.md", b"a"), (".hid.txt", b"b"), ("b.txt.gz", b"c")):
        (home / name).write_bytes(content)
    first = [(f"{i} ä%.TXT", "utf-8" if i % 3 else "cp1252", f"Größe {i}.") for i in range(300)]
    assert arrive() == sorted(first)
    assert arrive() == sorted(first)
    (home / "sub" / "later.txt").write_text("Später.")
    assert arrive() == sorted([*first, ("later.txt", "utf-8", "Später.")])
    entries = [x for f in (tmp_path / "state" / "sources" / "0").iterdir() if f.name.isdigit() for x in f.read_text().splitlines() if x.startswith("{")]
    assert 0 < len(entries) <= 2 * spark.sparkContext.defaultParallelism


def test_file_stream_goes_on_from_a_former_checkpoint(spark, tmp_path, monkeypatch):
    """A checkpoint begun with Spark's file source goes on with it, so no text comes twice."""
    (tmp_path / "in").mkdir()
    run = lambda: streams.file_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in" / "a.txt").write_text("Eins.")
    with monkeypatch.context() as m:
        m.setattr(streams, "_arrived", lambda *_: None)
        run()
    (tmp_path / "in" / "b.txt").write_text("Zwei.")
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Eins.", "Zwei."]


def test_session_stream(spark, tmp_path):
    home, schema = str(tmp_path), "key string, text string, saved_at timestamp"
    row = lambda k, t, h: spark.sql(f"select '{k}' key, '{t}' text, timestamp'2024-01-01 0{h}:00:00' saved_at")
    for batch in (row("a", "old", 1).union(row("b", "b", 1)), row("a", "new", 2)):
        batch.coalesce(1).write.mode("append").parquet(f"{home}/in")
        streams.session_stream(spark.readStream.schema(schema).parquet(f"{home}/in"), f"{home}/t", f"{home}/s").awaitTermination()
    assert {(r.key, r.text) for r in streams.latest(spark, f"{home}/t").collect()} == {("a", "new"), ("b", "b")}
    assert streams.latest(spark, f"{home}/nothing") is None


def test_session_table_is_whole_at_any_time(spark, tmp_path, monkeypatch):
    """A writer that stops between its files and its manifest leaves the table as it was; the batch, run again, is the table."""
    schema = "key string, text string, saved_at int"
    table = session_table.SessionTable(spark, str(tmp_path / "t"), buckets=4)
    batch = lambda n, t: spark.createDataFrame([(f"k{i}", f"{t}{i}", t) for i in range(n)], schema)
    state = lambda: {(r.key, r.text) for r in table.rows().collect()}
    table.merge(batch(20, 1), 0)
    first = state()
    with monkeypatch.context() as m:
        m.setattr(session_table.SessionTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            table.merge(batch(10, 2), 1)
    assert state() == first
    table.merge(batch(10, 2), 1)
    second = state()
    assert second == {(f"k{i}", f"{2 if i < 10 else 1}{i}") for i in range(20)}
    table.merge(batch(10, 2), 1)
    assert state() == second
    old = table.rows()
    table.merge(batch(1, 3), 2)
    assert {r.text for r in old.collect()} == {t for _, t in second}  # a reader that began before
    for k in range(3, 8):
        table.merge(batch(20, k + 1), k)
    assert len(list((tmp_path / "t" / "_manifests").glob("*.json"))) == session_table.KEPT and len(list((tmp_path / "t" / "data").glob("*"))) <= session_table.KEPT
    assert state() == {(f"k{i}", f"8{i}") for i in range(20)}
    assert session_table.SessionTable(spark, str(tmp_path / "none")).rows() is None


def test_sessions_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, "a", 1), ("9x", "b", 1), ("8x", "c", 1)], "key string, text string, saved_at int")
    assert {r.text for r in files.upsert_sessions(rows, rows.limit(0), "9").collect()} == {"a", "c"}
