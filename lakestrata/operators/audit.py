"""Contract audit of raw files: one row per file, with the first thing that is wrong."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 30
# Formats and required columns of the sources.
CONTRACTS = {
    "orders": ("parquet", ("order_id", "customer_id", "product_id", "quantity", "price", "status", "created_at", "updated_at")),
    "customers": ("parquet", ("customer_id", "name", "email", "address", "signup_date", "updated_at")),
    "products": ("csv", ("product_id", "product_name", "category", "price", "sku", "updated_at")),
    "clickstream": ("jsonl", ("event_id", "session_id", "customer_id", "event_type", "page_url", "event_ts", "device", "user_agent")),
    "currency_rates": ("csv", ("rate_date", "base_currency", "target_currency", "rate", "_source")),
    "wishlist": ("jsonl", ("wishlist_event_id", "customer_id", "product_id", "added_at", "source")),
}
SHAPE = "path string, columns array<string>, n_rows long, error string"


def _source(path: Column | str, base: str) -> Column:
    """The folder just below base that a path lies in."""
    return F.split_part(F.split_part(path, F.lit(base), F.lit(2)), F.lit("/"), F.lit(1))


def _of_source(source: Column, part: int) -> Column:
    """Format (0) or required columns (1) of a source, null for an unknown one."""
    plain = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))
    return F.coalesce(*[F.when(source == name, plain(contract[part])) for name, contract in CONTRACTS.items()])


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns and rows of Parquet files by their footers; see SHAPE."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for frame in frames:
        rows = []
        for path in frame["path"]:
            try:
                store, name = fs.FileSystem.from_uri(path)
                meta = pq.read_metadata(name, filesystem=store)
                rows.append((path, meta.schema.to_arrow_schema().names, meta.num_rows, None))
            except (OSError, ValueError) as error:  # pyarrow's errors are among them
                rows.append((path, None, None, type(error).__name__))
        yield pd.DataFrame(rows, columns=["path", "columns", "n_rows", "error"]).astype({"n_rows": "Int64"})


AUDIT = "path string, source string, status string, reason string, n_rows long, n_bytes long, warnings string"


def audit_files(spark: SparkSession, root: str, partitions: int = 32) -> DataFrame:
    """Audit of all files under root/<source>/...; see AUDIT. Checks in order: source,
    size, readability, rows, required columns; unexpected columns only warn. Lines are
    counted by Spark's readers, large files in splits; CSV rows by its CSV reader, so that
    a quoted line break ends none. Blank lines are no rows; a JSON Lines file whose first
    row is no object is unreadable. Only Parquet footers are read in Python."""
    base = quote(root.removeprefix("file://").removeprefix("file:").rstrip("/"), safe="/:=@+$,;&!'()*~") + "/"
    local = lambda name: F.regexp_replace(name, "^file:/+", "file:///")  # noqa: E731, Spark names local files in two ways
    path, size = local("_metadata.file_path"), F.col("_metadata.file_size")
    source = _source(path, base)
    reader = lambda: spark.read.option("recursiveFileLookup", "true")
    fits = size.between(1, MAX_BYTES)

    # the reader yields no row for a file without bytes; the names that Spark has listed hold it
    binary = reader().format("binaryFile").load(root)
    named = spark.createDataFrame([(name,) for name in binary.inputFiles()], "path string")
    sized = binary.select(path.alias("path"), size.alias("n_bytes"))
    files = named.select(local("path").alias("path")).join(sized, "path", "left").select("path", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), _source("path", base).alias("source"))
    files = files.withColumn("format", _of_source(F.col("source"), 0)).withColumn("required", _of_source(F.col("source"), 1))

    lines = reader().text(root).filter(_of_source(source, 0).isin("csv", "jsonl") & fits & F.col("value").rlike(r"\S"))
    lines = lines.select(path.alias("path"), _of_source(source, 0).alias("format"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    heads = lines.groupBy("path", "format").agg(F.min_by("value", "place").alias("head"), F.count("*").alias("n"))
    records = reader().schema("first string").option("multiLine", "true").option("escape", '"').csv(root).filter((_of_source(source, 0) == "csv") & fits)
    records = records.groupBy(path.alias("path")).agg((F.count("*") - 1).alias("n_rows"))
    cells = F.regexp_extract_all("head", F.lit(r'(?:^|,)(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    names = F.transform(cells, lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"[\r\x{FEFF}]", "")), r'^"|"$', ""))
    csv = heads.filter("format = 'csv'").join(records, "path").select("path", names.alias("columns"), "n_rows", F.lit(None).cast("string").alias("error"))
    keys = F.json_object_keys("head")
    jsonl = heads.filter("format = 'jsonl'").select("path", keys.alias("columns"), F.col("n").alias("n_rows"), F.when(keys.isNull(), "no_object").alias("error"))
    parquet = files.filter((F.col("format") == "parquet") & F.col("n_bytes").between(1, MAX_BYTES)).select("path").repartition(partitions).mapInPandas(_footers, SHAPE)

    found = files.join(csv.unionByName(jsonl).unionByName(parquet), "path", "left")
    missing = F.concat_ws(",", F.array_sort(F.array_except("required", "columns")))
    more = F.concat_ws(",", F.array_sort(F.array_except("columns", "required")))
    wrong = (
        F.when(F.col("format").isNull(), "unknown_source")
        .when(F.col("n_bytes") < 1, "empty_file")
        .when(F.col("n_bytes") > MAX_BYTES, "file_too_large")
        .when(F.col("error").isNotNull(), F.concat(F.lit("unreadable_"), "format", F.lit(": "), "error"))
        .when(F.coalesce("n_rows", F.lit(0)) < 1, "zero_rows")
        .when(missing != "", F.concat(F.lit("missing_columns: "), missing))
    )
    warned = wrong.isNull() & (more != "")
    return found.select(
        "path",
        F.when(F.col("format").isNull(), "unknown").otherwise(F.col("source")).alias("source"),
        F.when(wrong.isNotNull(), "quarantine").when(warned, "warn").otherwise("validated").alias("status"),
        F.coalesce(wrong, F.when(warned, "passed_with_warnings"), F.lit("ok")).alias("reason"),
        F.when(wrong == "zero_rows", F.lit(0)).otherwise(F.col("n_rows")).cast("long").alias("n_rows"),
        "n_bytes",
        F.when(warned, F.concat(F.lit("unexpected_columns: "), more)).otherwise("").alias("warnings"),
    )


def outcomes(audit: DataFrame, *by: str) -> DataFrame:
    """Files by source and outcome (and by other columns, such as a manifest's run_date)."""
    return audit.groupBy(*by, "source", "status").agg(F.count("*").alias("n_files"))


def append_manifest(audit: DataFrame, root: str, at: datetime | None = None) -> str:
    """Append the audit's rows to the manifest below root, in the folder of the run's date,
    which is when the audit ran and not the date of the files; returns the manifest's path."""
    now = at or datetime.now(UTC)
    path = f"{root.rstrip('/')}/_manifests"
    rows = audit.select(F.lit(now).cast("timestamp").alias("audited_at"), "*", F.lit(now.date()).alias("run_date"))
    rows.write.mode("append").partitionBy("run_date").parquet(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("date"))
