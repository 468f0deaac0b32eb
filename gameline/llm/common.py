"""What the operators share: reading tables, cutting lineage, packing arrays into rows, and batching texts by size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: Bytes of text that a task takes at once; larger texts make a batch of their own.
BATCH_BYTES = 6 << 20


def arrow_bounds(spark: SparkSession) -> None:
    """Arrow batches of texts are bounded by bytes, as two tasks of an executor hold some copies of theirs; a smaller
    bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_bounds(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder of this session does on one machine;
    executors elsewhere would not see it, so on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gameline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder and read again: later steps neither compute it anew nor depend
    on the executors that made it."""
    spark = df.sparkSession
    arrow_bounds(spark)
    path = f"{shared_dir(spark)}/gameline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles():
            folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if folder.getName().startswith("gameline-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
                break


def trim() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers outlive their tasks, and what one stage
    leaves in their heaps would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about limit bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    trim()


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts(total: int, each: int, least: int = 1) -> int:
    """Number of parts of about each bytes."""
    return max(least, -(-total // each))


def array_of(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=kind)
