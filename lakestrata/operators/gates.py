"""Data-quality gates and operational reports, as frames. A gate is one row with passed;
a check is the frame of its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def orphan_rate(df: DataFrame, keys: list[str], limit: float = 1.0) -> DataFrame:
    """Share of rows, in percent, in which any key is null; 0 for no rows."""
    orphan = F.lit(False)
    for k in keys:
        orphan = orphan | F.col(k).isNull()
    rate = F.round(F.coalesce(F.avg(F.when(orphan, 100.0).otherwise(0.0)), F.lit(0.0)), 4)
    return df.agg(F.count("*").alias("n"), F.count_if(orphan).alias("n_orphans"), rate.alias("orphan_pct")).withColumn("passed", F.col("orphan_pct") <= limit)


def row_count_drop(before: DataFrame, now: DataFrame, limit: float = 20.0) -> DataFrame:
    """Drop in percent against an earlier state; no rows before: passed."""
    both = before.agg(F.count("*").alias("n_before")).crossJoin(now.agg(F.count("*").alias("n_now")))
    drop = F.coalesce(F.greatest(F.lit(0.0), F.try_divide((F.col("n_before") - F.col("n_now")) * 100.0, F.col("n_before"))), F.lit(0.0))
    return both.withColumn("drop_pct", F.round(drop, 4)).withColumn("passed", F.col("drop_pct") <= limit)


def shrunk(before: DataFrame, now: DataFrame) -> DataFrame:
    """A row if there are fewer rows than before."""
    return before.agg(F.count("*").alias("n_before")).crossJoin(now.agg(F.count("*").alias("n_now"))).filter("n_now < n_before")


def currency_freshness(rates: DataFrame, today: Column, limit: float = 50.0) -> DataFrame:
    """Today's rates: some must exist, at most limit percent of them simulated."""
    found = rates.filter(F.col("rate_date") == today).agg(F.count("*").alias("n"), F.count_if(F.col("source") == "simulated").alias("n_simulated"))
    pct = F.round(F.coalesce(F.try_divide(F.col("n_simulated") * 100.0, F.col("n")), F.lit(0.0)), 4)
    return found.withColumn("simulated_pct", pct).withColumn("passed", (F.col("n") > 0) & (F.col("simulated_pct") <= limit))


def api_only(rates: DataFrame) -> DataFrame:
    return rates.filter(F.col("source") == "api")


def simulated_by_hour(rates: DataFrame, ts: str, end: Column, hours: int = 24) -> DataFrame:
    """Share of simulated rates in each of the last hours."""
    recent = rates.filter((F.col(ts) > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= end))
    return recent.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("source") == "simulated", 100.0).otherwise(0.0)), 6).alias("simulated_pct"))


def gauge(pct: Column) -> Column:
    return F.when(pct < 10, "good").when(pct < 30, "warning").otherwise("bad")


def reconcile(view: DataFrame, facts: DataFrame, view_amount: str, fact_amount: str, tolerance: float = 0.01) -> DataFrame:
    """Sums of a view and its facts side by side."""
    both = view.agg(F.sum(view_amount).alias("view_sum")).crossJoin(facts.agg(F.sum(fact_amount).alias("fact_sum")))
    return both.withColumn("matches", F.abs(F.coalesce("view_sum", F.lit(0)) - F.coalesce("fact_sum", F.lit(0))) <= tolerance)


def missing_parents(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys), keys, "left_anti")


def outside_domain(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*values))


class GateFailed(RuntimeError):
    pass


def require(gate: DataFrame) -> None:
    """Raise if the one row of a gate has not passed."""
    row = gate.first()
    if not row["passed"]:
        raise GateFailed(str(row.asDict()))


def freshness(tables: dict[str, tuple[DataFrame, str, float]], now: Column) -> DataFrame:
    """Per table (frame, time column, hours allowed): latest load, age in hours, state."""
    parts = [df.agg(F.max(ts).cast("timestamp").alias("latest")).select(F.lit(name).alias("table_name"), "latest", F.lit(float(sla)).alias("sla_hours")) for name, (df, ts, sla) in tables.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    age = F.timestamp_diff("HOUR", F.col("latest"), now)
    state = F.when(F.col("age_hours") < F.col("sla_hours") * 0.5, "fresh").when(F.col("age_hours") < F.col("sla_hours"), "warning").otherwise("stale")
    return found.withColumn("age_hours", age).withColumn("state", state)


def usage(df: DataFrame, by: list[Column], amount: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def trailing_usage(df: DataFrame, by: list[Column], amount: str, ts: str, end: Column, days: int) -> DataFrame:
    """Usage over the last days up to end, largest first."""
    recent = df.filter((F.col(ts) > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= end))
    found = usage(recent, by, amount)
    return found.orderBy(F.desc("total"), *found.columns[: len(by)])


def run_kpis(runs: DataFrame, start: str, end: Column, hours: int = 24) -> DataFrame:
    """Per pipeline over the trailing hours: runs, success rate, median duration. runs has
    pipeline, state, duration_s; a null state counts as unknown, not as success."""
    recent = runs.filter((F.col(start) > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(start) <= end))
    ok = F.when(F.coalesce("state", F.lit("unknown")) == "success", 100.0).otherwise(0.0)
    counted = recent.groupBy("pipeline").agg(F.count("*").alias("runs"), F.round(F.avg(ok), 6).alias("success_pct"))
    medians = exact_quantiles(recent, ["pipeline"], "duration_s", {"median_s": 0.5}).select(F.col("pipeline").alias("_of"), "median_s")
    return counted.join(medians, F.col("pipeline").eqNullSafe(F.col("_of")), "left").select("pipeline", "runs", "success_pct", F.round("median_s", 6).alias("median_s"))


def runs_by_state(runs: DataFrame) -> DataFrame:
    """Runs by pipeline and state; a null state is unknown."""
    return runs.groupBy("pipeline", F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


def latest_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
