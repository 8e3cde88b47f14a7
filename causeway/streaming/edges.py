"""Edges as a stream: each micro-batch is merged into a table, the last row of a (src, dst) pair wins.

An addition of this engine; batch reading gives the same table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.graph import last_wins
from causeway.sources import kg


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of JSON-lines files as they arrive."""
    return spark.readStream.schema(T.StructType([*kg.RAW.fields, T.StructField("ord", T.LongType())])).json(path)


def _folders(spark: SparkSession, table: str) -> list[str]:
    """Names of the whole versions of a table, the oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
    done = lambda n: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith("v") and done(n))


def latest(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest whole version of a table that ``merge_into`` keeps."""
    names = _folders(spark, table)
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


def merge_into(raw: DataFrame, table: str, checkpoint: str, keep_versions: int = 2):
    """Starts a query that keeps ``table`` (a folder of Parquet versions) up to date; returns the query.

    Every batch writes a new version beside the newest whole one, whatever checkpoint that came from, so readers and
    restarts find a whole table; a batch that is run again after a failure is known by its name and written once. Versions
    beyond the last ``keep_versions`` are removed."""
    spark, mark = raw.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def merge(batch: DataFrame, batch_id: int) -> None:
        names = _folders(spark, table)
        if any(n.endswith(f"-{mark}-{batch_id}") for n in names):
            return
        new = kg.normalise(batch)
        if names:
            new = last_wins(spark.read.parquet(f"{table}/{names[-1]}").unionByName(new))
        number = int(names[-1][1:].split("-")[0]) + 1 if names else 0
        new.write.mode("overwrite").parquet(f"{table}/v{number:012}-{mark}-{batch_id}")
        for old in names[: max(0, len(names) + 1 - keep_versions)]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts of a stream ``events(ts, event_type, value)`` with late rows dropped after ``delay``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
