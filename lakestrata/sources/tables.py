"""Files and tables: readers, lineage, appends, snapshots. A table's state is a folder of
snapshots, one Parquet folder each, and the log of those that are published."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import UTC, date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE = ("_ingestion_timestamp", "_source_file", "_batch_id")
_OWN: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, in a
    temporary folder of this machine (local mode). A cluster has to name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        base = _OWN[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partition_path(root: str, layer: str, source: str, day: date, hour: int | None = None) -> str:
    path = f"{root.rstrip('/')}/{layer}/{source}/year={day:%Y}/month={day:%m}/day={day:%d}"
    return path if hour is None else f"{path}/hour={hour:02d}"


def layer_root(root: str, layer: str, source: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{source}"


def checkpoint_path(root: str, layer: str, source: str) -> str:
    return f"{root.rstrip('/')}/_checkpoints/{layer}/{source}"


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
    """All files under path: Parquet, JSON lines, or CSV with a header."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema else reader
    reader = reader.option("header", "true") if fmt == "csv" else reader
    return (reader.option("mergeSchema", "true") if merge else reader).load(path)


def coerce(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Cast columns; what cannot be cast becomes null, or fails the job if strict. Range
    rules let nulls pass, so a coerced column needs a not-null rule as well."""
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()})


def with_lineage(df: DataFrame, batch_id: str, source_file: Column | str | None = "_metadata.file_path", at: datetime | None = None) -> DataFrame:
    """df with LINEAGE: time of ingestion, file (null if None) and batch."""
    file = F.lit(None).cast("string") if source_file is None else F.col(source_file) if isinstance(source_file, str) else source_file
    return df.select("*", (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias(LINEAGE[0]), file.alias(LINEAGE[1]), F.lit(batch_id).alias(LINEAGE[2]))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def batch_slice(df: DataFrame, batch_id: str) -> DataFrame:
    return df.filter(F.col("_batch_id") == batch_id)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that only one has are null in the other, none is dropped."""
    return old.unionByName(new, allowMissingColumns=True)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_projection(df: DataFrame, types: dict[str, str], batch_id: str, on_error: str = "continue") -> DataFrame:
    """The typed columns, tagged with the batch. "continue": rows in which a given value
    cannot be cast are left out; "abort": they fail the job."""
    if on_error == "abort":
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], F.lit(batch_id).alias("_source_batch_id"))
    bad = [F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in types.items()]
    kept = df.filter(~F.array_contains(F.array(*bad), F.lit(True)))
    return kept.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()], F.lit(batch_id).alias("_source_batch_id"))


LOG = "version long, path string, source string, published timestamp"
REMOVED = "path string"
#: Fixed value: hours for which a version that has been replaced can still be read.
RETAIN_HOURS = 168


def missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of small Parquet files; empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not missing_path(error):  # a log that cannot be read is no empty one
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, table: str) -> DataFrame:
    """The log: a row for each snapshot that is still there, with its version, folder and
    source. Empty for a table that has none yet."""
    return read_log(spark, f"{table}/_log", LOG).join(read_log(spark, f"{table}/_removed", REMOVED), "path", "left_anti").select("version", "path", "source", "published")


def publish(df: DataFrame, table: str, version: int | None = None, source: str = "") -> int:
    """Write a new snapshot in full into a folder of its own, then name it in the log: readers
    see the old one until then, even where a version is published again. By default the
    version follows the latest. source tells what made it. One writer per table."""
    spark = df.sparkSession
    if version is None:
        version = (published(spark, table).agg(F.max("version")).first()[0] or 0) + 1
    path = f"{table}/snapshot={version}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(path).alias("path"), F.lit(source).alias("source"), F.current_timestamp().alias("published"))
    row.coalesce(1).write.mode("append").parquet(f"{table}/_log")
    return version


def read_snapshot(spark: SparkSession, table: str, as_of: datetime | None = None, version: int | None = None) -> DataFrame:
    """The current snapshot, or the one at a time, or a version."""
    log = published(spark, table)
    log = log.filter(F.col("published") <= F.lit(as_of)) if as_of else log
    log = log.filter(F.col("version") == version) if version is not None else log
    found = log.orderBy(F.desc("version"), F.desc("published")).select("path").first()
    if found is None:
        raise ValueError(f"{table} has no snapshot {'at ' + str(as_of) if as_of else '' if version is None else version}")
    return spark.read.parquet(found["path"])


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType) -> bool:
    """An empty first snapshot, unless the table has one; whether it was made."""
    if not published(spark, table).isEmpty():
        return False
    publish(empty(spark, schema), table)
    return True


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Publish the current rows of a table as the next version of another, columns and all."""
    return publish(read_snapshot(spark, source), target, source=f"copy of {source}")


def remove_folders(spark: SparkSession, table: str, folders: list[str], prefix: str, named: set[str], before: datetime) -> list[str]:
    """Note folders of a table as removed, so that no reader asks for them, then delete them and
    those with prefix that no log names and that were last written before a time: leftovers of
    writes, or of removals, that broke off. Returns what was deleted."""
    from pyarrow import fs

    if folders:
        spark.createDataFrame([(f,) for f in folders], REMOVED).coalesce(1).write.mode("append").parquet(f"{table}/_removed")
    store, root = fs.FileSystem.from_uri(table if "://" in table else f"file://{table.removeprefix('file:')}")
    gone, last = [], {f.rpartition("/")[2] for f in named}
    drop = {f.rpartition("/")[2] for f in folders}
    for found in store.get_file_info(fs.FileSelector(root)):
        old = found.mtime is None or found.mtime <= before
        if found.type == fs.FileType.Directory and found.base_name.startswith(prefix) and (found.base_name in drop or (found.base_name not in last and old)):
            store.delete_dir(found.path)
            gone.append(found.base_name)
    return sorted(gone)


def vacuum(spark: SparkSession, table: str, hours: float = RETAIN_HOURS, now: datetime | None = None) -> list[str]:
    """Delete the folders of versions that were replaced more than hours ago; the current one
    stays whatever its age. Returns the names of what was deleted: a row of the log for each
    version comes to the driver."""
    before = (now or datetime.now(UTC)) - timedelta(hours=hours)
    log = published(spark, table).orderBy("version", "published").select("path", F.unix_micros("published").alias("at")).collect()
    replaced = [a["path"] for a, b in zip(log, log[1:]) if b["at"] <= before.timestamp() * 1e6]
    return remove_folders(spark, table, replaced, "snapshot=", {r["path"] for r in log} - set(replaced), before)
