"""What the operators of this subpackage share: the shared folder, written tables, text batches and hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Spark's limit on what one Arrow batch holds; without it a batch is 10,000 rows, however long these are.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` of the session names it.

    Only where that is unset and the session is local (as in tests) a temporary folder is made and set; on a cluster
    that would be a folder of the driver alone, so there an unset one is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


#: Schemes of Hadoop's file systems, and how pyarrow calls the same store.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def for_workers(spark: SparkSession, path: str) -> str:
    """``path`` as a URI that workers can open without Spark (``open_store``): the scheme that Hadoop takes for it,
    under pyarrow's name. A store that pyarrow does not know is refused here, before any task runs."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    scheme, _, rest = whole.partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"workers cannot write to {whole}: its scheme is none of {sorted(SCHEMES)}")
    return f"{SCHEMES[scheme]}://" + rest.removeprefix("//")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI made by ``for_workers``."""
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended before the driver does
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, is read again by several consumers, and
    survives lost executors. ``free`` removes it; else it goes when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


class Folder:
    """Files of workers in the shared folder, for ``free``."""

    def __init__(self, spark: SparkSession, path: str):
        self.sparkSession, self._folder = spark, path


def free(*tables: DataFrame | Folder) -> None:
    """Removes ``written`` tables and folders that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes; a bound that is set already stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), str((1 << 63) - 1)):
        conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return df


def slices(batch: pa.RecordBatch, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``slice_bytes``, one row at least."""
    step = max(1, int(batch.num_rows * min(1.0, slice_bytes / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def map_batches(
    df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``function`` over the Arrow batches of ``df``, cut so that a slice holds about ``slice_bytes`` (one row at
    least): the memory of a task is then bounded by the longest row, not by the rows of a batch."""
    bounded(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_bytes):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit murmur hash, on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def remainder_of_id(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n: the fold of a row. Null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    extra: str,
    compute: Callable[[list[bytes | None]], list[pa.Array]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``df`` as c0, c1, ... and the columns ``extra`` (a DDL string) that ``compute`` makes
    of the UTF-8 texts of a slice. Numbered names cannot clash with whatever ``df`` calls its columns."""
    numbered = [quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]
    within = f"c{keep.index(text_col)}" if text_col in keep else "text"
    wide = df.select(*numbered, *([] if text_col in keep else [quoted(text_col).cast("binary").alias("text")]))
    kept = [f for f in wide.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), extra])
    names = [f.name for f in kept]

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = compute(batch.column(batch.schema.get_field_index(within)).cast(pa.binary()).to_pylist())
        columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name in names]
        return pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *extra_names])

    extra_names = [x.strip().split()[0] for x in _top_level(extra)]
    return map_batches(wide, schema, batch_of, slice_bytes)


def _top_level(ddl: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(ddl[last:i])
            last = i + 1
    return [*parts, ddl[last:]]


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns c0, c1, ... under their own names again; whatever else is there goes."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
