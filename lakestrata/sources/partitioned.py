"""Tables in parts by a hash of their keys. A version names, for each part, the folder that it
lies in; a merge writes and reads only the parts that its rows touch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.state import latest_by_max, merge_newer
from .tables import REMOVED, RETAIN_HOURS, read_log, remove_folders

LOG = "version long, part int, path string, source string, published timestamp"
PART = "_part"


class KeysNotUnique(ValueError):
    pass


def log(spark: SparkSession, table: str) -> DataFrame:
    """A row for each part of each version that wrote it, of those that are still there."""
    gone = read_log(spark, f"{table}/_removed", REMOVED)
    folder = F.regexp_replace("path", f"/{PART}=[0-9]+$", "")
    return read_log(spark, f"{table}/_parts", LOG).withColumn("_folder", folder).join(gone.withColumnRenamed("path", "_folder"), "_folder", "left_anti").drop("_folder")


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def current_paths(spark: SparkSession, table: str, version: int | None = None) -> dict[int, str]:
    """Folder of each part in force: a row for each part comes to the driver."""
    rows = log(spark, table)
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    return {r["part"]: r["path"] for r in rows.groupBy("part").agg(F.max_by("path", F.struct("version", "published")).alias("path")).collect()}


def read_parts(spark: SparkSession, table: str, parts: list[int] | None = None, version: int | None = None) -> DataFrame | None:
    """The rows of parts, or of all, now or in a version; None if there are none."""
    paths = [p for n, p in sorted(current_paths(spark, table, version).items()) if parts is None or n in parts]
    return spark.read.parquet(*paths) if paths else None


def write_parts(df: DataFrame, table: str, keys: list[str], parts: int, touched: list[int], source: str = "") -> int:
    """Write df, the whole of the touched parts, as a new version. What the log says of the
    other parts holds on. One row of the log for each touched part, in one file, publishes."""
    spark = df.sparkSession
    version = (log(spark, table).agg(F.max("version")).first()[0] or 0) + 1
    path = f"{table}/version={version}-{uuid.uuid4().hex[:8]}"
    df.withColumn(PART, part_of(keys, parts)).repartition(PART).write.partitionBy(PART).parquet(path)
    rows = [(version, n, f"{path}/{PART}={n}", source) for n in touched]
    named = spark.createDataFrame(rows, "version long, part int, path string, source string").withColumn("published", F.current_timestamp())
    named.coalesce(1).write.mode("append").parquet(f"{table}/_parts")
    return version


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise if a key stands twice, or is null: merges by it would go wrong."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    row = df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null).first()
    if row is not None:
        raise KeysNotUnique(str(row.asDict()))


def merge_parts(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], ts: list[str], parts: int = 64, source: str = "") -> list[int]:
    """Newer rows win, as in merge_newer(); the parts that were written. rows has each key once
    at most; neither side may have null keys. parts stays as it was for a table."""
    require_unique(rows, keys)
    touched = sorted(r[0] for r in rows.select(part_of(keys, parts)).distinct().collect())
    if not touched:
        return []
    known = read_parts(spark, table, touched)
    if known is not None:
        require_unique(known, keys)
    write_parts(rows if known is None else merge_newer(known, rows, keys, ts), table, keys, parts, touched, source)
    return touched


def merge_stream(table: str, keys: list[str], ts: list[str], parts: int = 64, enrich: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over merge_parts(); a batch that the log has is not taken again."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        source = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/{epoch}"
        if log(spark, table).filter(F.col("source") == source).isEmpty():
            rows = enrich(batch) if enrich else batch
            merge_parts(spark, table, latest_by_max(rows, keys, ts), keys, ts, parts, source)

    return run


def vacuum(spark: SparkSession, table: str, hours: float = RETAIN_HOURS, now: datetime | None = None) -> list[str]:
    """Delete the folders of versions of which every part was replaced more than hours ago.
    Returns the names of what was deleted."""
    before = (now or datetime.now(UTC)) - timedelta(hours=hours)
    line = Window.partitionBy("part").orderBy("version", "published")
    ends = log(spark, table).withColumn("_until", F.unix_micros(F.lead("published").over(line)))
    folder = F.regexp_replace("path", f"/{PART}=[0-9]+$", "").alias("folder")
    found = ends.groupBy(folder).agg(F.max(F.coalesce("_until", F.lit(2**62))).alias("until")).collect()  # a row for each version
    replaced = [r["folder"] for r in found if r["until"] <= before.timestamp() * 1e6]
    return remove_folders(spark, table, replaced, "version=", {r["folder"] for r in found} - set(replaced), before)
