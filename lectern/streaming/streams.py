"""The same operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.functions.text import sanitize, trim
from lectern.plans.prepare import CleaningOptions, clean
from lectern.sources import folders
from lectern.sources.files import MAX_BYTES, any_case, decode_text
from lectern.streaming.session_table import BUCKETS, SessionTable


def clean_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType, options: CleaningOptions = CleaningOptions()) -> StreamingQuery:
    """Cleans what arrives as Parquet in a folder, to another; without state, so it needs no watermark."""
    docs = spark.readStream.schema(schema).parquet(in_dir)
    cleaned = docs.withColumn("text", clean(F.col("text"), options)).withColumn("text", sanitize(F.col("text")))
    return cleaned.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _listing(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, but that looks at a batch's files in few tasks: the source takes each new file for a
    folder, and there would be a task for each."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    return own


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _arrived(spark: SparkSession, in_dir: str, table_dir: str) -> int | None:
    """Adds path, modificationTime and length of the text files in a folder that aren't in the table yet; how many these are. Tasks list
    the folder. None where they can't."""
    found = folders.listed(spark, in_dir)
    if found is None:
        return None
    found = found.where(F.col("path").rlike(r"\.[tT][xX][tT]\z"))
    exists = _exists(spark, table_dir)
    new = found.join(spark.read.schema(found.schema).parquet(table_dir).select("path"), "path", "left_anti") if exists else found
    many = new.count()
    if many or not exists:
        new.select(*found.columns).coalesce(spark.sparkContext.defaultParallelism).write.mode("append").parquet(table_dir)
    return many


def file_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, options: CleaningOptions = CleaningOptions(), max_bytes: int = MAX_BYTES) -> StreamingQuery:
    """Text files as they arrive in a folder: decoded, cleaned and sanitized (path, charset, text), blank ones left out. Files of other
    kinds are not listed, those beyond the size not opened.

    Tasks list the folder and add what is new to a table beside the checkpoint; the stream is over that table, and tasks open the
    files, some thousand each. So the driver holds no names, and a batch has few tasks and writes few files. In stores that tasks don't
    reach, and where a checkpoint was begun so, Spark's file source finds the files: it holds a batch's names in the driver and makes a
    task of some thirty small files; a task here takes many of these one after another."""
    arrivals = f"{checkpoint.rstrip('/')}/arrivals"
    many = None if _exists(spark, f"{checkpoint.rstrip('/')}/offsets") and not _exists(spark, arrivals) else _arrived(spark, in_dir, arrivals)
    readable = (F.col("length") > 0) & (F.col("length") <= max_bytes)
    if many is None:
        kind = _listing(spark).readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        found = kind.option("pathGlobFilter", any_case("txt")).option("recursiveFileLookup", "true").load(in_dir)
        found = found.where(readable).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        found = spark.readStream.schema("path string, modificationTime timestamp, length bigint").parquet(arrivals)
        found = folders.read(found.where(readable), many)
    texts = decode_text(found)
    texts = texts.where(trim(F.col("text")) != "").withColumn("text", clean(F.col("text"), options)).withColumn("text", sanitize(F.col("text")))
    return texts.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def session_stream(sessions: DataFrame, table_dir: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the latest row of each key in a SessionTable. A batch that is run again leaves the same table."""
    table = SessionTable(sessions.sparkSession, table_dir, buckets)
    return sessions.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The table as it is, None if there is none."""
    return SessionTable(spark, table_dir).rows()
