"""Exact quantiles by group in two passes, without gathering a group's values in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], cells: int = CELLS) -> DataFrame:
    """by, and a column for each wanted fraction: the value at that share of the group's values
    in order, between two of them in proportion, as `percentile` has it; null and NaN values
    are left out, groups without others have no row. First equal values are counted and the
    counts put into cells of equal width, whose sums tell in which cells the wanted values
    lie; then only those cells are put in order, each by itself."""
    v = F.col(value).cast("double")
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    counted = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    ranges = counted.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    on = lambda x, y, *more: reduce(and_, [*(F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names), *more], F.lit(True))
    width = (F.col("_hi") - F.col("_lo")) / cells
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(cells - 1))).otherwise(0).cast("int")
    placed = counted.alias("a").join(ranges.alias("b"), on("a", "b")).select("a.*", cell.alias("_cell"))
    sums = placed.groupBy(*names, "_cell").agg(F.sum("_n").alias("_in"))
    line = Window.partitionBy(*names).orderBy("_cell")
    group = Window.partitionBy(*names)
    totals = sums.select(*names, "_cell", F.sum("_in").over(group).alias("_all"), (F.sum("_in").over(line) - F.col("_in")).alias("_before"), "_in")
    places = [F.struct(F.lit(name).alias("name"), (F.floor((F.col("_all") - 1) * p) if low else F.ceil((F.col("_all") - 1) * p)).alias("at"), ((F.col("_all") - 1) * p - F.floor((F.col("_all") - 1) * p)).alias("part"), F.lit(low).alias("low")) for name, p in wanted.items() for low in (True, False)]
    asked = totals.select(*names, "_cell", "_before", "_in", F.explode(F.array(*places)).alias("_q")).filter("_q.at >= _before and _q.at < _before + _in")
    cells_of = asked.groupBy(*names, "_cell").agg(F.first("_before").alias("_before"), F.collect_set("_q").alias("_asked"))
    inside = placed.alias("a").join(cells_of.alias("b"), on("a", "b", F.col("a._cell") == F.col("b._cell"))).select("a.*", "_before", "_asked")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_cell").orderBy("_v"))
    found = inside.withColumn("_upto", upto).select(*names, "_v", "_n", "_upto", F.explode("_asked").alias("_q")).filter("_q.at < _upto and _q.at >= _upto - _n")
    low, high = (F.max(F.when((F.col("_q.low") == side) & (F.col("_q.name") == F.col("_name")), F.col("_v"))) for side in (True, False))
    per = found.withColumn("_name", F.col("_q.name")).groupBy(*names, "_name").agg(low.alias("_x"), high.alias("_y"), F.first("_q.part").alias("_part"))
    per = per.withColumn("_at", F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((1 - F.col("_part")) * F.col("_x") + F.col("_part") * F.col("_y")))
    out = per.groupBy(*names).agg(*[F.max(F.when(F.col("_name") == name, F.col("_at"))).alias(name) for name in wanted])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *wanted)
