"""What the operators of this package share: tables on shared storage and Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_ROWS, ARROW_MB = 400, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset (tests, notebooks on one
    machine) a temporary folder is made once per application; a cluster has to set it."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut
    and the rows survive the loss of any executor. large_rows: a page ends when it is full
    by any row, and not after 100 of them first, as readers and writers hold whole pages."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    checks = {f"parquet.{x}.size.row.check.min": "1" for x in ("page", "block")} if large_rows else {}
    df.write.options(**checks).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: it is set for the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of docs in ranges of ascending doc_id, each sorted.
    Rows of one doc_id, null ones too, may be dealt to several ranges: by the hash of their
    text, and equal rows by their place in the input."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    return own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")


def small_batches(spark: SparkSession) -> None:
    """Whole texts, and sets of their shingles, go to Python ARROW_ROWS or ARROW_MB at a time,
    unless the session asks for fewer rows: a batch of the default 10,000 rows or 64 MB can take
    more memory than the work on it."""
    if int(spark.conf.get(_ARROW)) > ARROW_ROWS or int(spark.conf.get(_ARROW)) <= 0:
        spark.conf.set(_ARROW, str(ARROW_ROWS))
        spark.conf.set(_ARROW_BYTES, f"{ARROW_MB}m")


def light_batches(spark: SparkSession) -> None:
    """Rows go to Python ARROW_MB at a time, many short ones or a few long ones, where the session
    has Spark's default of 64 MB: the JVM keeps what it has once allocated for a batch."""
    if spark.conf.get(_ARROW_BYTES) == f"{64 << 20}b":
        spark.conf.set(_ARROW_BYTES, f"{ARROW_MB}m")


def filesystem(uri: str):
    """(filesystem, path) of a URI that Spark writes to, for use inside tasks."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write: Callable) -> None:
    """write(stream) into a name of its own, then move into place: a task that is tried
    again, or runs twice, leaves one whole file with the same content."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own, compression=None) as out:
        write(out)
    store.move(own, path)


def batched(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in column take about limit bytes at most (or
    one row), so that long texts do not multiply memory. After the last of them a worker
    that stays for other tasks gives freed memory back to the system."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        give_back(0)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and plans of steps whose results are stored by now. It
    does so when the driver's JVM finds that nothing refers to them: what Python held is let go of
    first, of which py4j tells the JVM within a second, then what the JVM held through it. One full
    collection, as each lets the JVM's heap grow in the collections after it. What Python has
    freed goes back to the system. Then the executors' heaps are collected too, so that a step
    does not begin on what those before it left."""
    import gc
    import time

    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    trim()
    lighten(spark)


def lighten(spark: SparkSession) -> None:
    """Let the executors' JVMs collect what earlier steps left behind and give the memory back
    to the system, which they do in a full collection only: beside Python workers a heap that
    has grown step by step takes more than any one step needs. A task for each core, so that
    every executor has one."""
    n = spark.sparkContext.defaultParallelism
    collected = spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    collected.write.format("noop").mode("overwrite").save()
