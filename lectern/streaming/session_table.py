"""A table of sessions in buckets by key, that is replaced whole or not at all.

A version of a bucket is a folder that is written once. The manifest of a batch names the folder of every bucket and is put in place by
one rename, last; readers go by the newest manifest, so they see all of a batch or nothing of it, whenever a writer stops. A
folder that none of the manifests kept names is removed after that. One stream writes to a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import upsert_sessions

BUCKETS = 64
#: Manifests that stay, with what they name, for readers that began before the last one.
KEPT = 3


class SessionTable:
    def __init__(self, spark: SparkSession, home: str, buckets: int = BUCKETS):
        self.spark, self.home, self.buckets = spark, home.rstrip("/"), buckets
        self.java = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.system = self.java.Path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path = self.java.Path(f"{self.home}/{folder}")
        return sorted(x.getPath().getName() for x in self.system.listStatus(path)) if self.system.exists(path) else []

    def _manifests(self) -> list[str]:
        return [x for x in self._listed("_manifests") if x.endswith(".json")]

    def _read(self, name: str) -> dict:
        stream = self.system.open(self.java.Path(f"{self.home}/_manifests/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """The newest: batch, schema, and the folder of each bucket that has rows."""
        names = self._manifests()
        return self._read(names[-1]) if names else None

    def rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as the newest manifest has it, or some of its buckets; None where there is none."""
        m = self.manifest()
        if m is None:
            return None
        paths = [f"{self.home}/{folder}" for b, folder in m["buckets"].items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(m["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], m["schema"])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Puts the latest row of each key of a batch into the table; the buckets that it touches get new folders. A batch that comes
        again finds its rows already there and changes nothing but the folders' names."""
        names = batch.columns
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
        old, before = self.rows(touched), self.manifest() or {"buckets": {}}
        rows = upsert_sessions(batch, old.select(*names) if old is not None else batch.limit(0))
        version = f"data/{number:010d}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")).repartition("bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.home}/{version}")
        written = {x.removeprefix("bucket="): f"{version}/{x}" for x in self._listed(version) if x.startswith("bucket=")}
        self._commit(number, {"batch": number, "schema": _ddl(batch), "buckets": {**before["buckets"], **written}})
        self._clear()

    def _commit(self, number: int, manifest: dict) -> None:
        text = json.dumps(manifest)
        part = self.java.Path(f"{self.home}/_manifests/.{uuid.uuid4().hex}")
        out = self.system.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        earlier = [x for x in self._manifests() if int(x.split("-")[0]) <= number]
        step = int(earlier[-1].split("-")[1].split(".")[0]) + 1 if earlier and int(earlier[-1].split("-")[0]) == number else 0
        if not self.system.rename(part, self.java.Path(f"{self.home}/_manifests/{number:010d}-{step:06d}.json")):
            raise OSError(f"the manifest of batch {number} could not be put in place")

    def _clear(self) -> None:
        """Removes manifests but the newest, and the folders of buckets that these do not name."""
        names = self._manifests()
        for x in names[:-KEPT]:
            self.system.delete(self.java.Path(f"{self.home}/_manifests/{x}"), False)
        named = {folder for x in names[-KEPT:] for folder in self._read(x)["buckets"].values()}
        for version in self._listed("data"):
            own = [f"data/{version}/{x}" for x in self._listed(f"data/{version}") if x.startswith("bucket=")]
            for folder in own:
                if folder not in named:
                    self.system.delete(self.java.Path(f"{self.home}/{folder}"), True)
            if not any(folder in named for folder in own):
                self.system.delete(self.java.Path(f"{self.home}/data/{version}"), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
