"""Loads that take each file once: a ledger of files, each with its size and time, what was
loaded of it and what was rejected. Rows lie in a folder for each load; readers see the
folders that the ledger names, so a load that breaks off is as if it had not been."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_log

LEDGER = "path string, size long, modified timestamp, batch_id string, folder string, n_loaded long, n_rejected long, status string, loaded_at timestamp"
FILE = "_source_file"


class LoadAborted(RuntimeError):
    pass


def ledger(spark: SparkSession, table: str) -> DataFrame:
    return read_log(spark, f"{table}/_ledger", LEDGER)


def new_files(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """path, size, modified of the files of folder that no load has taken in as they are: one
    that has been written anew counts as new."""
    listed = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed.join(ledger(spark, table).select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def load(spark: SparkSession, table: str, folder: str, types: dict[str, str], batch_id: str, fmt: str = "csv", on_error: str = "continue") -> DataFrame:
    """Load the new files of folder into table: columns cast to types, with the file and batch
    of each row. A row with a value that cannot be cast is rejected: under "continue" it goes
    to the load's rejected rows and is counted for its file; under "abort" nothing of the
    load is kept, the ledger included. Returns the ledger's rows of this load."""
    if on_error not in ("continue", "abort"):
        raise ValueError(f"on_error: {on_error}")
    files = new_files(spark, table, folder)
    paths = [r["path"] for r in files.select("path").collect()]  # of one load; the reader asks for them
    own = f"{table}/load={batch_id}-{uuid.uuid4().hex[:8]}"
    if paths:
        reader = spark.read.format(fmt).schema(", ".join(f"`{c}` string" for c in types))
        raw = (reader.option("header", "true").option("enforceSchema", "false") if fmt == "csv" else reader).load(paths) if fmt != "parquet" else spark.read.parquet(*paths)
        bad = [F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull() for c, t in types.items()]
        judged = raw.select(*[F.col(f"`{c}`") for c in types], F.col("_metadata.file_path").alias(FILE), F.array_contains(F.array(*bad), F.lit(True)).alias("_bad"))
        judged.write.partitionBy("_bad").parquet(f"{own}/judged")
        kept = spark.read.parquet(f"{own}/judged")
        counts = kept.groupBy(FILE).agg(F.count_if(~F.col("_bad").cast("boolean")).alias("n_loaded"), F.count_if(F.col("_bad").cast("boolean")).alias("n_rejected"))
        if on_error == "abort" and not kept.filter(F.col("_bad").cast("boolean")).isEmpty():
            raise LoadAborted(f"{batch_id}: {counts.filter('n_rejected > 0').count()} files have rows that do not fit")
        cast = kept.filter(~F.col("_bad").cast("boolean")).select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in types.items()], FILE, F.lit(batch_id).alias("_source_batch_id"))
        cast.write.parquet(f"{own}/rows")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:///")  # noqa: E731, Spark names local files in two ways
        done = files.join(counts.select(plain(FILE).alias("_plain"), "n_loaded", "n_rejected"), plain("path") == F.col("_plain"), "left")
        n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        status = F.when(F.coalesce("n_rejected", F.lit(0)) == 0, "loaded").when(F.col("n_loaded") == 0, "rejected").otherwise("partly_loaded")
        done.select("path", "size", "modified", F.lit(batch_id).alias("batch_id"), F.lit(own).alias("folder"), n("n_loaded"), n("n_rejected"), status.alias("status"), F.current_timestamp().alias("loaded_at")).coalesce(1).write.mode("append").parquet(f"{table}/_ledger")
    return ledger(spark, table).filter(F.col("batch_id") == batch_id)


def _folders(rows: DataFrame) -> list[str]:
    return [r["folder"] for r in rows.select("folder").distinct().collect()]  # a row for each load


def loaded(spark: SparkSession, table: str) -> DataFrame:
    """All rows that loads have taken in."""
    return spark.read.parquet(*[f"{f}/rows" for f in _folders(ledger(spark, table))])


def rejected(spark: SparkSession, table: str) -> DataFrame | None:
    """All rows that they have not, as they were read, with their files; None if there are none."""
    folders = _folders(ledger(spark, table).filter("n_rejected > 0"))
    return spark.read.parquet(*[f"{f}/judged/_bad=true" for f in folders]) if folders else None
