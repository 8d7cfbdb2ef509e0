"""What the corpus operators share: the shared folder, stage tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` where the cluster names one; a temporary folder is set only
    where that is unset and all runs in this one machine, as in local tests. It is an error otherwise.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Stages:
    """Tables that one run writes below the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        self.paths.append(path)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables so far but these; nothing may read the others any more."""
        kept = {t._quire_path for t in tables}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            if path not in kept:
                place = hadoop(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows in one Arrow batch on its way to a Python worker. Spark's 64 MB take a whole task's texts at once.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by their bytes, unless it has a bound of its own.

    An executor holds a batch while it grows, while it is sent and while a worker reads it, for each of its tasks. Rows
    are the same with any bound, and one above it is a batch of its own. Spark looks it up when a plan runs, so it stays set.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def frugal(run: Callable) -> Callable:
    """A map over Arrow batches that gives its memory back when its task ends.

    Python workers live on between tasks; what their allocators keep would add up beside the JVM.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def crc32_mod(column: str, n: int):
    """crc32 of an id as decimal text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def packed(docs: DataFrame, text_column: str) -> tuple[DataFrame, str, int]:
    """Whole rows in one struct column ``row``, its type, and the place of the text in it.

    No name of a source column can clash with what an operator adds, and the text goes to Python once.
    """
    docs = docs.withColumn(text_column, F.col(text_column).cast("string"))
    out = docs.select(F.struct("*").alias("row"))
    return out, out.schema["row"].dataType.simpleString(), docs.columns.index(text_column)


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``most`` bytes; a longer text is a run of its own.

    Yields (first row, row after the last, offsets from 0, bytes).
    """
    offsets, data = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def list_array(flat: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values; starts has one more entry than there are rows."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat, kind))
