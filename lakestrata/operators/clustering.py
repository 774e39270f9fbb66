"""How rows lie in files: layouts of a table by ranges or by a Z-order of several columns, and
the report of how many files a value lies in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import publish, published, read_snapshot

#: Bits of a column's rank in a Z-order: 2^BITS ranges of about equal numbers of rows.
BITS = 8


# The columns that each served table is laid out by.
LAYOUTS = {
    "dim_customer": ("customer_id",),
    "dim_product": ("product_id",),
    "fact_orders": ("order_id",),
    "fact_order_lifecycle": ("order_id",),
    "fact_sessions": ("silver_session_key",),
    "fact_customer_wishlist_product": ("customer_sk", "product_sk"),
    "customer_ltv": ("customer_sk",),
}


@dataclass(frozen=True)
class Clustering:
    """Choice for one table: columns, "range" (rows sorted by the first column, then the
    next) or "zorder" (all columns alike), and the number of files."""

    columns: tuple[str, ...]
    method: str = "zorder"
    files: int = 16

    def __post_init__(self):
        if self.method not in ("range", "zorder") or not self.columns:
            raise ValueError(f"not a clustering: {self}")


def layout(table: str, files: int = 16) -> Clustering:
    """The layout of a served table; of one column it is the plain order of that column."""
    columns = LAYOUTS[table]
    return Clustering(columns, "zorder" if len(columns) > 1 else "range", files)


def ordinal(df: DataFrame, column: str) -> Column:
    """A number in the order of a column: numbers and times as they are, texts by their first
    seven bytes, so that longer common heads are one value. Null stays null."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double")


def cells(value: Column, bits: int = BITS) -> Column:
    """Aggregate: the values that cut a column into 2^bits ranges of about equal size."""
    n = 1 << bits
    return F.percentile_approx(value, [i / n for i in range(1, n)], 20 * n)


def cell_of(value: Column, bounds: Column, bits: int = BITS) -> Column:
    """How many of the sorted bounds lie below a value, by halving; 0 for null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(value > F.get(bounds, at + step - 1), at + step).otherwise(at))


def morton(ranks: list[Column], bits: int = BITS) -> Column:
    """Bits of several ranks in turn, highest first, as one number."""
    if len(ranks) * bits > 62:
        raise ValueError(f"{len(ranks)} columns of {bits} bits do not fit a long")
    spread = [F.shiftleft(F.shiftright(r, i).bitwiseAND(1).cast("long"), i * len(ranks) + len(ranks) - 1 - j) for j, r in enumerate(ranks) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), spread)


def with_zorder(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """df with _zorder, the Morton number of the columns' quantile ranks. The bounds of the
    ranks are one row, made by one pass and broadcast: they do not grow with the data."""
    bounds = df.agg(*[cells(ordinal(df, c), bits).alias(f"_bounds{i}") for i, c in enumerate(columns)])
    ranks = [cell_of(ordinal(df, c), F.col(f"_bounds{i}"), bits) for i, c in enumerate(columns)]
    return df.crossJoin(F.broadcast(bounds)).withColumn("_zorder", morton(ranks, bits)).select(*df.columns, "_zorder")


def clustered(df: DataFrame, choice: Clustering) -> DataFrame:
    """df's rows, dealt to files and sorted as the choice says."""
    if choice.method == "range":
        return df.repartitionByRange(choice.files, *choice.columns).sortWithinPartitions(*choice.columns)
    keyed = with_zorder(df, list(choice.columns))
    return keyed.repartitionByRange(choice.files, "_zorder").sortWithinPartitions("_zorder").drop("_zorder")


def rewrite(spark: SparkSession, table: str, choice: Clustering) -> bool:
    """Publish a table's current rows anew in the layout of choice; whether there were any."""
    if published(spark, table).isEmpty():
        return False
    publish(clustered(read_snapshot(spark, table), choice), table, source=f"{choice.method} by {','.join(choice.columns)}")
    return True


# --- the report -------------------------------------------------------------------------------
def file_ranges(df: DataFrame, column: str) -> DataFrame:
    """file, lo, hi of each file that df reads, by a scan of the column alone; files without
    values are left out."""
    value = ordinal(df, column)
    return df.select(F.col("_metadata.file_path").alias("file"), value.alias("_v")).groupBy("file").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter("lo is not null")


def footer_ranges(df: DataFrame, column: str, partitions: int = 32) -> DataFrame:
    """The same from the statistics in the files' footers, without reading a value: for
    Parquet columns of numbers, dates and times. A file without statistics is reported with
    null lo and hi: ask file_ranges() then."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import datetime as dt

        import pyarrow.parquet as pq
        from pyarrow import fs

        def number(v) -> float:
            if isinstance(v, dt.datetime):
                return (v.replace(tzinfo=v.tzinfo or dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)
            return float((v - dt.date(1970, 1, 1)).days if isinstance(v, dt.date) else v)

        for frame in frames:
            rows = []
            for path in frame["file"]:
                store, name = fs.FileSystem.from_uri(path)
                meta = pq.read_metadata(name, filesystem=store)
                if not meta.num_rows:
                    continue
                at = meta.schema.names.index(column)
                stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
                stats = [s for s in stats if not (s and s.null_count == s.num_values and not s.has_min_max and s.num_values == 0)]
                whole = all(s is not None and s.has_min_max for s in stats)
                rows.append((path, min(number(s.min) for s in stats) if whole and stats else None, max(number(s.max) for s in stats) if whole and stats else None))
            yield pd.DataFrame(rows, columns=["file", "lo", "hi"]).astype({"lo": float, "hi": float})

    files = df.select(F.col("_metadata.file_path").alias("file")).distinct()
    return files.repartition(partitions).mapInPandas(read, "file string, lo double, hi double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("lo", "hi")})


def depth(ranges: DataFrame, bits: int = 6, limit: float = 4.0) -> DataFrame:
    """Average and largest number of files that lie over the lower end of a file's range
    (lo, hi, both ends count). Openings and closings are dealt to 2^bits ranges of values; sums
    of the ranges before are carried into each, so no task sees them all."""
    marks = ranges.select(F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))))
    bounds = marks.agg(cells(F.col("at"), bits).alias("_bounds"))
    marks = marks.crossJoin(F.broadcast(bounds)).withColumn("_cell", cell_of(F.col("at"), F.col("_bounds"), bits)).drop("_bounds")
    sums = marks.groupBy("_cell").agg(F.sum("step").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("_cell", before.alias("_before"))  # 2^bits rows
    line = Window.partitionBy("_cell").orderBy("at", "kind")  # up to all that open at one value
    opened = marks.join(F.broadcast(carried), "_cell").withColumn("depth", F.col("_before") + F.sum("step").over(line)).filter("kind = 0")
    found = opened.agg(F.count("*").alias("n_files"), F.round(F.avg("depth"), 4).alias("avg_depth"), F.max("depth").alias("max_depth"))
    return found.withColumn("needs_rewrite", F.coalesce(F.col("avg_depth") > limit, F.lit(False)))
