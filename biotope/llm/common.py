"""What the operators of this subpackage share: the shared folder, written tables, module shipping, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, so that a batch of long texts or sets stays small; set where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Broadcast bound, in rows, of tables with rows of a few dozen bytes. Beyond it the operators shuffle instead.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, below /tmp/checkpoints, in local mode only: there all tasks share a disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or 'file:///tmp/checkpoints'}/{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "t", freed: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and executors may be lost after. freed: the shuffle
    files that the writing made go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(FILE_CLEANUP, "false")
    if freed:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that they import it wherever they run; bound Arrow batches."""
    sc, batch = spark.sparkContext, "spark.sql.execution.arrow.max{}PerBatch"
    for name, default, ours in (("Records", 10_000, BATCH_ROWS), ("Bytes", (1 << 63) - 1, BATCH_BYTES)):
        if spark.conf.get(batch.format(name), None) in (None, str(default), f"{default}b"):
            spark.conf.set(batch.format(name), ours)
    if getattr(sc, "_biotope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="biotope-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)  # the driver serves it to the executors
    sc._biotope_shipped = True


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text, with null as empty; other columns are left out, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def most_frequent(df: DataFrame, freq: str, most: int) -> DataFrame:
    """Rows of the largest values of freq, `most` at most: all of a value or none, from a cutoff that a histogram of a few hundred
    bins gives. Unlike a top-k it sends no partition's candidates to the driver."""
    step = F.floor(F.log2(F.col(freq).cast("double")) * 8)
    bins = sorted((tuple(r) for r in df.where(F.col(freq) > 0).groupBy(step.alias("b")).count().collect()), reverse=True)
    total, least = 0, None
    for b, n in bins:
        total += n
        if total > most:
            break
        least = b
    return df.where(F.lit(False)) if least is None else df.where((F.col(freq) > 0) & (step >= least))


def tidy() -> None:
    """Give freed memory back, at the end of a pass that held much: workers are used again, and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def chunks(batches, size: int = 1 << 20, text: str = "text"):
    """The same rows in batches of up to 1,024 rows and about `size` bytes of text (one row at least)."""
    for b in sliced(batches, 1024):
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size)))
            yield b.slice(at, upto - at)
            at = upto


def sliced(batches, rows: int = 256):
    """The same rows in batches of few rows, to bound what one step of a Python operator holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
