"""Reading documents and files of several kinds, and writing texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.rules import bind
from lectern.functions.text import sanitize, trim
from lectern.session import stored
from lectern.sources import folders

MAX_BYTES = 50 * 1024 * 1024
KINDS = ("pdf", "docx", "odt", "txt", "rtf")
#: Charsets that are tried in this order where a text is not UTF-8. Bytes that one leaves open are control characters.
CHARSETS = ("cp1252", "iso8859_15")
#: Words that a German text has.
GERMAN = r"(?iu)(?<![\p{L}\p{N}_])(?:und|der|die|das|ist|nicht|ein|eine|zu|in)(?![\p{L}\p{N}_])"
#: Characters of texts that a task holds before it passes them on.
HELD = 2 << 20
#: An archive member may unpack to this many bytes.
MAX_UNPACKED = 4 * MAX_BYTES


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length and content of the files; the source itself passes over empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def admit(files: DataFrame, max_bytes: int = MAX_BYTES, empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files that can be read, and the others with a reason; decided before any content is read. empty: whether files without
    content are judged by their kind, like others."""
    e = extension(F.col("path"))
    reason = F.when(F.col("length") > max_bytes, "too large").when((F.col("length") == 0) & F.lit(not empty), "empty").when(e == "doc", "old Word format: save as .docx").when(e == "odtx", "not a format: save as .odt").when(~e.isin(*KINDS), "unknown kind").when(e.isin("pdf", "rtf"), "no reader for this kind")
    return files.where(reason.isNull()), files.where(reason.isNotNull()).select("path", "length", reason.alias("reason"))


#: Kinds that are read here.
READ = ("txt", "docx", "odt")


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, few: int = folders.FEW) -> DataFrame:
    """path, length, text and status of all files in a folder: `ok`, or why there is no text (also where it is blank).

    Sizes and kinds are decided by the source: the scan that reads content opens the files of one kind, by its glob, and asks for
    sizes that can be read (pushed to the source); the others are only listed. Of a folder with more files than `few` the names are a
    table and tasks open the files, with the same result, so the driver never holds more names than that.
    """
    of_kind = {"txt": lambda df: df.select("path", "length", F.regexp_replace(decoded(F.col("content"))["text"], r"\A\x{FEFF}", "").alias("text"), F.lit("ok").alias("status"))}
    of_kind |= {kind: (lambda df, read=read: _extract(df, read, "length").select("path", "length", "text", "status")) for kind, read in (("docx", _docx), ("odt", _odt))}
    table = folders.listed(spark, path)
    by_source = table is None or table.count() <= few
    good, bad = admit(scan_files(spark, path).select("path", "length") if by_source else table, max_bytes)
    if by_source:
        rows = [of_kind[kind](scan_files(spark, path, any_case(kind)).where((F.col("length") > 0) & (F.col("length") <= max_bytes))) for kind in READ]
    else:
        number = {r[0]: r[1] for r in good.groupBy(extension(F.col("path"))).count().collect()}
        rows = [of_kind[kind](folders.read(good.where(extension(F.col("path")) == kind), number[kind])) for kind in READ if kind in number]
        rows = rows or [good.select("path", "length", F.lit(None).cast("string").alias("text"), F.lit("ok").alias("status"))]
    text = reduce(DataFrame.unionByName, rows)
    blank = (F.col("status") == "ok") & (trim(F.col("text")) == "")
    text = text.select("path", "length", F.when(~blank, F.col("text")).alias("text"), F.when(blank, "no text").otherwise(F.col("status")).alias("status"))
    return text.unionByName(bad.select("path", "length", F.lit(None).cast("string").alias("text"), F.col("reason").alias("status")))


def any_case(kind: str) -> str:
    """A glob for the files of a kind, whatever the case of their extension."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in kind)


def score_german(c: Column) -> Column:
    """How much a decoded text looks like German that was decoded rightly."""
    n = lambda p: F.regexp_count(c, F.lit(p)).cast("bigint")
    return 10 * n("[äöüÄÖÜß]") + 2 * n(GERMAN) - 50 * n(r"\x{FFFD}") - 20 * n("Ã[¼¶¤¦©]")


def best_candidate(found: Column) -> Column:
    """Of an array of struct(cand_no, charset, text) the one whose text has the highest score, the first of equals, with its score."""
    scored = F.transform(found, lambda x: F.struct(score_german(x["text"]).alias("score"), (-x["cand_no"]).alias("order"), x["charset"].alias("charset"), x["text"].alias("text")))
    return bind(F.array_max(scored), lambda x: F.struct((-x["order"]).alias("cand_no"), x["charset"].alias("charset"), x["text"].alias("text"), x["score"].alias("score")))


def single_bytes(content: Column, charset: str) -> Column:
    """Bytes decoded in a charset of one byte a character, as browsers do: a byte that it leaves open is the character of its number."""
    of = {chr(i): bytes([i]).decode(charset, errors="ignore") or chr(i) for i in range(128, 256)}
    other = {x: to for x, to in of.items() if x != to}
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(other), "".join(other.values()))


def decoded(content: Column) -> Column:
    """struct(charset, text) of a file's bytes, in the JVM. What is no UTF-8 is decoded in each charset, and the best kept; without
    content both are null."""
    candidates = F.array(*[F.struct(F.lit(i).alias("cand_no"), F.lit(c).alias("charset"), single_bytes(content, c).alias("text")) for i, c in enumerate(CHARSETS)])
    pair = lambda charset, text: F.struct(charset.alias("charset"), text.alias("text"))
    best = bind(best_candidate(candidates), lambda x: pair(x["charset"], x["text"]))
    whole = content.cast("string")
    none = F.lit(None).cast("string")
    return F.when(content.isNull(), pair(none, none)).when(F.is_valid_utf8(whole), pair(F.lit("utf-8"), whole)).otherwise(best)


def decode_text(files: DataFrame) -> DataFrame:
    """path, charset and text, each file read once."""
    at = files.select("path", decoded(F.col("content")).alias("_x"))
    return at.select("path", F.col("_x.charset").alias("charset"), F.regexp_replace("_x.text", r"\A\x{FEFF}", "").alias("text"))


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
_OTHER = "http://schemas.openxmlformats.org/markup-compatibility/2006 "
_ODT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0 "
#: What stands for signs inside a run.
_SIGNS = {_WORD + "tab": "\t", _WORD + "br": "\n", _WORD + "cr": "\n", _WORD + "noBreakHyphen": "-"}


class _Paragraphs:
    """The paragraphs of an XML text that is fed piece by piece: of each the text, then those that lie in it (text boxes), once.

    text: the element whose characters count, None for all of a paragraph's; signs: elements that stand for text, in `run`. Of
    alternatives the second is passed over where the first had text.
    """

    def __init__(self, paragraph: str, text: str | None = None, run: str | None = None):
        self.paragraph, self.text, self.run = paragraph, text, run
        self.path: list[str] = []
        self.open: list[tuple[list[str], list[str]]] = []
        self.done: list[str] = []
        self.outside: list[str] = []
        self.inside = self.skipped = 0
        self.chosen: list[bool] = []
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.characters
        self.parser.EntityDeclHandler = self.entity

    def entity(self, *_) -> None:
        raise ValueError("declares entities")

    def start(self, name: str, _) -> None:
        parent = self.path[-1] if self.path else ""
        self.path.append(name)
        if name == _OTHER + "AlternateContent":
            self.chosen.append(False)
        elif self.skipped or (name == _OTHER + "Fallback" and self.chosen and self.chosen[-1]):
            self.skipped += 1
        elif name == self.paragraph:
            self.open.append(([], []))
        elif name == self.text:
            self.inside += 1
            self.outside += [] if self.open else [""]
        elif parent == self.run and name in _SIGNS:
            self.add(_SIGNS[name])

    def end(self, name: str) -> None:
        self.path.pop()
        if name == _OTHER + "AlternateContent":
            self.chosen.pop()
        elif self.skipped:
            self.skipped -= 1
        elif name == self.paragraph:
            own, within = self.open.pop()
            (self.open[-1][1] if self.open else self.done).extend(["".join(own), *within])
        elif name == self.text:
            self.inside -= 1

    def characters(self, data: str) -> None:
        if not self.skipped and (self.inside or self.text is None):
            self.add(data)

    def add(self, data: str) -> None:
        if self.open:
            self.open[-1][0].append(data)
        elif self.inside:
            self.outside[-1] += data
        if self.chosen:
            self.chosen = [True] * len(self.chosen)


def _paragraphs(content: bytes, member: str, found: _Paragraphs) -> _Paragraphs:
    """A member of an archive, read to found, unless it is larger than a document can be; it is never held whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
        size = 0
        while data := f.read(1 << 16):
            size += len(data)
            if size > MAX_UNPACKED:
                raise ValueError("too large unpacked")
            found.parser.Parse(data)
        found.parser.Parse(b"", True)
    return found


def _docx(content: bytes) -> str:
    """Paragraphs that hold something, or else all texts outside of any, joined by blanks."""
    found = _paragraphs(content, "word/document.xml", _Paragraphs(_WORD + "p", _WORD + "t", _WORD + "r"))
    return "\n\n".join(x for x in found.done if x) or " ".join(found.outside)


def _odt(content: bytes) -> str:
    return "\n".join(_paragraphs(content, "content.xml", _Paragraphs(_ODT + "p")).done)


def _extract(files: DataFrame, read, *keep: str) -> DataFrame:
    """path, further columns to keep, text and status, a row for each file: what can't be read, whatever is wrong with it, has a status that says so
    and no text. The first bytes are looked at before Python sees a file."""
    head = F.hex(F.substring("content", 1, 4))
    status = F.when(F.col("content").isNull(), "no content").when(head == "D0CF11E0", "old Word format").when(~head.startswith("504B"), "no archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, states, size = 0, [], [], 0
            for i in range(batch.num_rows):
                known = batch.column("status")[i].as_py()
                try:
                    texts.append(None if known else read(batch.column("content")[i].as_py()))
                    states.append(known or "ok")
                except Exception as e:  # noqa: BLE001  damaged, encrypted, missing or malformed: one file must not end the job
                    texts.append(None)
                    states.append(f"unreadable: {type(e).__name__}")
                size += len(texts[-1] or "")
                if size >= HELD or i == batch.num_rows - 1:
                    b = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("path", *keep)], pa.array(texts, pa.string()), pa.array(states, pa.string())], ["path", *keep, "text", "status"])
                    begin, texts, states, size = i + 1, [], [], 0

    rows = files.select("path", *keep, F.when(status.isNull(), F.col("content")).alias("content"), status.alias("status"))
    return rows.mapInArrow(run, rows.select("path", *keep, F.lit(None).cast("string").alias("text"), "status").schema)


def extract_docx(files: DataFrame) -> DataFrame:
    return _extract(files, _docx)


def extract_odt(files: DataFrame) -> DataFrame:
    return _extract(files, _odt)


def safe_file_name(c: Column) -> Column:
    name = F.trim(F.regexp_replace(F.regexp_replace(c, r"\.[^/.]+\z", ""), r'[<>:"/\\|?*]', "_"))
    return F.when(name == "", "output").otherwise(F.substring(name, 1, 200))


def write_corpus(df: DataFrame, path: str, stamp: Column | None = None, as_files: bool = False) -> None:
    """Sanitized texts (value) with a byte order mark, beside the file name (safe, with the time) that each has: as Parquet, or
    as_files as a text file for each row, where equal names are numbered."""
    from lectern.sources.text_files import file_name, numbered_names, write_files

    named = file_name(F.col("name"), F.current_timestamp() if stamp is None else stamp)
    out = df.select(named.alias("file"), F.concat(F.lit("\ufeff"), sanitize(F.coalesce("text", F.lit("")) if as_files else F.col("text"))).alias("value"))
    if as_files:
        # numbering looks at its rows for ranges before it deals them out, so they are made once before
        write_files(numbered_names(stored(out, "sanitized")), path, overwrite=True)
    else:
        out.withColumn("file", F.regexp_replace("file", r"\.txt\z", "")).write.mode("overwrite").parquet(path)


def upsert_sessions(new: DataFrame, existing: DataFrame, drop_prefix: str | None = None) -> DataFrame:
    """The latest row of each key, without keys of a prefix; of rows saved at one time the new one. A null key is one key, without
    prefix. No sort: the latest is an aggregate, taken where the rows are before they are shuffled."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    if drop_prefix:
        both = both.where(~F.coalesce(F.col("key").startswith(drop_prefix), F.lit(False)))
    rest = [c for c in new.columns if c != "key"]
    latest = F.max_by(F.struct(*rest), F.struct("saved_at", "_new", "text"))
    return both.groupBy("key").agg(latest.alias("_r")).select(*[F.col(c) if c == "key" else F.col(f"_r.{c}").alias(c) for c in new.columns])
