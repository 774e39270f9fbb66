"""A schema store for a folder whose files change shape: each version of the schema is a row of
a log, with what it added and what types differed."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import missing_path, read_log

STORE = "version long, schema string, recorded timestamp, changes array<struct<column:string,change:string,known:string,found:string>>"


class SchemaChanged(RuntimeError):
    """Files have columns that the schema in use lacks; the store has them by now."""


def merged(known: T.StructType | None, found: T.StructType) -> tuple[T.StructType, list[tuple[str, str, str | None, str]]]:
    """known with the columns that only found has behind it, and the changes: (column, added
    or type_differs, known type, found type). A known column keeps its type: its readers rely
    on it, and what does not fit is null. No column is ever taken out."""
    fields = {f.name: f for f in known} if known else {}
    changes = []
    for f in found:
        if f.name not in fields:
            fields[f.name] = T.StructField(f.name, f.dataType, True)
            changes.append((f.name, "added", None, f.dataType.simpleString()))
        elif fields[f.name].dataType != f.dataType:
            changes.append((f.name, "type_differs", fields[f.name].dataType.simpleString(), f.dataType.simpleString()))
    return T.StructType(list(fields.values())), changes


def versions(spark: SparkSession, store: str) -> DataFrame:
    """The log of a store; see STORE. Empty before the first version."""
    return read_log(spark, store, STORE)


def changes(spark: SparkSession, store: str) -> DataFrame:
    """version, column, change, known and found type of all changes."""
    return versions(spark, store).select("version", F.explode("changes").alias("c")).select("version", "c.*")


def latest(spark: SparkSession, store: str) -> T.StructType | None:
    row = versions(spark, store).orderBy(F.desc("version")).select("schema").first()
    return T.StructType.fromJson(json.loads(row["schema"])) if row else None


def inferred(spark: SparkSession, paths: str | list[str], fmt: str) -> T.StructType:
    """Types of files by Spark's readers, all rows looked at; no columns if there are none."""
    options = {"csv": {"header": "true", "inferSchema": "true"}, "parquet": {"mergeSchema": "true"}, "json": {"dropFieldIfAllNull": "true"}}[fmt]
    try:
        return spark.read.options(recursiveFileLookup="true", **options).format(fmt).load(paths).schema
    except AnalysisException as error:
        if missing_path(error) or error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return T.StructType()
        raise


def record(spark: SparkSession, store: str, found: T.StructType) -> tuple[T.StructType | None, bool]:
    """The schema in force once found has been merged into it, and whether it has grown. A new
    version is written where it has, or where types differ."""
    known = latest(spark, store)
    schema, differing = merged(known, found)
    if differing:
        row = [(versions(spark, store).count() + 1, schema.json(), datetime.now(UTC), differing)]
        spark.createDataFrame(row, STORE).coalesce(1).write.mode("append").parquet(store)
    return (schema if schema.fields else None), any(kind == "added" for _, kind, _, _ in differing)
