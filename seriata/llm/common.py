"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII upper to lower case, for bytes.translate.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Rows of one Arrow batch, unless the session has a number of its own: texts are long, and workers hold two batches at a time.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader, so any store works."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's. Only where all run in one process is one made if it has none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not there and jsc.getCheckpointDir().isDefined():
        there = jsc.getCheckpointDir().get()
    if not there and not jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not there:
        there = tempfile.mkdtemp(prefix="seriata-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a written folder when the driver ends, if its session still runs."""
    if spark.sparkContext._jsc is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def trim_driver(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system, and says if it could.

    Compiling a plan takes such memory and frees it, but the C library keeps it
    for each thread, beside the heap and the more plans there were. JVMs that do
    not know the command are left alone.
    """
    with contextlib.suppress(Exception):
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        # By reflection: the class of the platform's server is not open to others, its interface is.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.Object, 0), array(jvm.String, 0)
        return "Trim native heap" in invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    return False


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with their lineage cut: a lost executor costs no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    trim_driver(spark)
    return out


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: columns are pruned on later reads."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/seriata-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.partitionBy(*partition_by).parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def ranges(spark: SparkSession, times: int = 1) -> int:
    """How many ranges a hash space is cut into: it follows the cluster's shuffle partitions, not the data's values."""
    return times * max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


try:
    _trim_heap = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim_heap = None


def trim() -> None:
    """Gives memory that is free back to the system: a worker lives on through many stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim_heap:
        _trim_heap(0)


def lean(work: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back after each batch and at its end."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            trim()

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(trimmed(batches))
        trim()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: int | str = 1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of the text column, so work space does not follow Arrow's batch size."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size)))
            yield batch.slice(a, b - a)
            a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (shift, xor and odd multiplication)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for counts[i] of them, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
