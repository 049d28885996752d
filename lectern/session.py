"""What a session needs before queries run in it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, as they may have no path to it."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(target))
    context._lectern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where none is named a temporary one does for a
    session in one process, as in tests; on a cluster executors would not see it, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context = spark.sparkContext
        named = context._lectern_dir = getattr(context, "_lectern_dir", None) or tempfile.mkdtemp(prefix="lectern-")
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(f):
    """f(spark, ...), with the package sent first."""

    @wraps(f)
    def run(spark, *args, **more):
        ship(spark)
        return f(spark, *args, **more)

    return run
