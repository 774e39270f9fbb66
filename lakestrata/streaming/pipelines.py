"""Structured Streaming: file-once ingestion, session windows, merges in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import latest_by_max, merge_newer
from ..sources import schemas
from ..sources.partitioned import merge_stream
from ..sources.tables import publish, published, read_snapshot, with_lineage


def open_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, max_files: int | None = None) -> DataFrame:
    """Files of a folder as they arrive; a schema is required."""
    reader = spark.readStream.schema(schema).format(fmt).option("recursiveFileLookup", "true")
    reader = reader.option("header", "true") if fmt == "csv" else reader
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def ingest(spark: SparkSession, raw: str, bronze: str, checkpoint: str, schema: T.StructType, fmt: str, batch_id: str) -> int:
    """Append the files that no earlier run took in, with lineage; returns their rows. A
    run without new files is a no-op."""
    rows = with_lineage(open_stream(spark, raw, schema, fmt), batch_id)
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(bronze)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ingest_evolving(spark: SparkSession, raw: str, bronze: str, checkpoint: str, store: str, fmt: str, batch_id: str, max_files: int | None = None) -> int:
    """ingest() without a given schema. The types of each micro-batch's files are inferred and
    merged into the schema store; where a file has a column that the stream lacks, the stream
    stops before the batch is written and starts anew with the column. Each batch is a folder
    of its own, which a batch that runs again replaces. Returns the rows that came in."""
    if schemas.latest(spark, store) is None and schemas.record(spark, store, schemas.inferred(spark, raw, fmt))[0] is None:
        return 0
    taken: dict[int, int] = {}

    def write(batch: DataFrame, epoch: int) -> None:
        files = [r[0] for r in batch.select("_source_file").distinct().collect()]  # of one trigger
        if not files:
            return
        _, grown = schemas.record(spark, store, schemas.inferred(spark, files, fmt))
        if grown:
            raise schemas.SchemaChanged(store)
        path = f"{bronze}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        taken[epoch] = spark.read.parquet(path).count()

    while True:
        before = schemas.latest(spark, store)
        rows = with_lineage(open_stream(spark, raw, before, fmt, max_files), batch_id)
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return sum(taken.values())
        except StreamingQueryException:
            if schemas.latest(spark, store).fieldNames() == before.fieldNames():  # it stopped for another reason
                raise


def read_evolved(spark: SparkSession, bronze: str) -> DataFrame:
    """What ingest_evolving() has written; null in columns that came after a row."""
    return spark.read.option("mergeSchema", "true").parquet(bronze).drop("epoch")


def session_windows(events: DataFrame, cookie: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by session_window with a watermark; whole seconds, as in the batch operator.
    In append mode a session is given out once the watermark has passed its end."""
    second = events.withColumn("_at", F.date_trunc("second", ts)).withWatermark("_at", late)
    return second.groupBy(F.session_window("_at", gap), cookie).agg(F.count("*").alias("event_count"), F.min("_at").alias("session_start"), F.max("_at").alias("session_end"))


def drop_replays(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def merge_into(table: str, keys: list[str], ts: list[str], enrich: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: newer rows win over the latest snapshot, whichever stream made
    it; the result is the next version. The log names the stream and batch, so a batch that
    runs again is not taken in twice, and a new checkpoint starts from the table as it is."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        source = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/{epoch}"
        log = published(spark, table)
        if not log.filter(F.col("source") == source).isEmpty():
            return
        rows = latest_by_max(enrich(batch) if enrich else batch, keys, ts)
        publish(rows if log.isEmpty() else merge_newer(read_snapshot(spark, table), rows, keys, ts), table, source=source)

    return run


def run_merge(stream: DataFrame, table: str, checkpoint: str, keys: list[str], ts: list[str], enrich: Callable[[DataFrame], DataFrame] | None = None, parts: int | None = None) -> None:
    """Merge what has come in: into snapshots, each written whole, or, with parts, into a table in
    so many parts (sources/partitioned.py), of which a batch reads and writes those it touches."""
    merge = merge_stream(table, keys, ts, parts, enrich) if parts else merge_into(table, keys, ts, enrich)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
