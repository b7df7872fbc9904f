"""What the training-data operators share: tables, scratch storage, splits."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, for rows that are small enough.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A word, as Java and Python regular expressions both read it.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows and bytes of an Arrow batch, for texts of any length: what a worker and its JVM hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker outlives its tasks.

    From the first call on, arrays of over 1 MB have pages of their own, which go as the array does, Arrow's too.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives freed memory back before its first batch and after its last."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return thin


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "xylem")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The copy outlives any executor. It stays until the folder is cleared.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as empty text (remainder 0)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
