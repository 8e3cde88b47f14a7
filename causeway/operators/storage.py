"""Tables in the folder that driver and executors share: they cut lineage, are read by several consumers and survive lost
executors. ``free`` removes those that nothing reads any more; the rest goes when the driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session or its context names. Only a local session that names none gets one of its own: on a
    cluster that would be a folder of the driver alone."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before the driver does
            pass

    atexit.register(remove)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df``, written once and read again. Its size is then known, so small sides of joins are sent around."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Removes kept tables that nothing reads any more; whatever was not kept is left alone."""
    for df in tables:
        path = getattr(df, "_folder", None) if df is not None else None
        if path:
            delete(df.sparkSession, path)
            df._folder = None


#: Spark's limit on what one Arrow batch holds; without it a batch is 10,000 rows, however long these are.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes; a bound that is set already stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), str((1 << 63) - 1)):
        conf.set(BATCH_BYTES, str(4 << 20))
    return df
