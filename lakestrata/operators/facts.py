"""Sessions, facts and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import days_between, hashed_key
from .history import as_of_join


def sessionize(events: DataFrame, cookie: str, ts: str, tie: str, gap_minutes: int = 30) -> DataFrame:
    """events with session_seq and session_key. A session ends where the next event comes
    more than gap_minutes later, in whole seconds. Give all events of a cookie: numbering
    runs over its history. Both windows share one shuffle."""
    line = Window.partitionBy(cookie).orderBy(ts, tie)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    apart = second - F.lag(second).over(line) > gap_minutes * 60
    seq = F.sum(F.when(F.coalesce("_apart", F.lit(True)), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_apart", apart).withColumn("session_seq", seq).drop("_apart").withColumn("session_key", hashed_key(cookie, "session_seq"))


def sessionize_in_parts(events: DataFrame, cookie: str, ts: str, tie: str, gap_minutes: int = 30, part: str = "hour") -> DataFrame:
    """The same where a few cookies, or null, hold most events: sessions are first counted
    within the parts of time of a cookie, which are dealt to tasks each for itself; one row
    for each part then says how many came before and whether its first goes on from there."""
    line = Window.partitionBy(cookie, "_part").orderBy(ts, tie)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    apart = F.coalesce(second - F.lag(second).over(line) > gap_minutes * 60, F.lit(True))
    own = events.withColumn("_part", F.date_trunc(part, F.col(ts).cast("timestamp"))).withColumn("_apart", F.when(apart, 1).otherwise(0))
    own = own.withColumn("_seq", F.sum("_apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    row = own.groupBy(F.col(cookie).alias("_cookie"), F.col("_part").alias("_of")).agg(F.min(second).alias("_from"), F.max(second).alias("_to"), F.sum("_apart").alias("_n"))
    of_cookie = Window.partitionBy("_cookie").orderBy("_of")
    row = row.withColumn("_goes_on", F.when(F.col("_from") - F.lag("_to").over(of_cookie) <= gap_minutes * 60, 1).otherwise(0))
    before = F.coalesce(F.sum("_n").over(of_cookie.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_goes_on").over(of_cookie.rowsBetween(Window.unboundedPreceding, 0))
    row = row.select("_cookie", "_of", before.alias("_before"))
    met = own.join(row, F.col(cookie).eqNullSafe(F.col("_cookie")) & F.col("_part").eqNullSafe(F.col("_of")))
    return met.withColumn("session_seq", F.col("_before") + F.col("_seq")).select(*events.columns, "session_seq").withColumn("session_key", hashed_key(cookie, "session_seq"))


def refresh_sessions(known: DataFrame, touched: DataFrame, cookie: str) -> DataFrame:
    """Sessions after late events: all sessions of touched cookies are replaced."""
    return known.join(touched.select(cookie).distinct(), cookie, "left_anti").unionByName(touched)


def session_fact(events: DataFrame, ts: str, tie: str, purchase: str = "purchase") -> DataFrame:
    """A row per session_key from sessionized events with columns event_id, customer_id,
    event_type, page_url, device. Names are fixed values. What stood first and last in a
    session is one smallest and one greatest row; the customer is the last that is known."""
    click = F.struct(ts, tie, "page_url", "device")
    known = F.when(F.col("customer_id").isNotNull(), F.struct(ts, tie, "customer_id"))
    per = events.groupBy("session_key").agg(
        F.min(click).alias("_first"), F.max(click).alias("_last"), F.max(known).alias("_known"), F.min("event_id").alias("first_event_id"),
        F.count("*").alias("event_count"), F.count_distinct("event_type").alias("distinct_event_types"), F.bool_or(F.col("event_type") == purchase).alias("converted"),
    )
    return per.select(
        "session_key", "first_event_id", F.col(f"_first.{ts}").alias("session_start"), F.col(f"_last.{ts}").alias("session_end"), "event_count", "distinct_event_types", F.col("_known.customer_id").alias("attributed_customer_id"),
        "converted", F.col("_first.page_url").alias("first_page_url"), F.col("_last.page_url").alias("last_page_url"), F.col("_first.device").alias("device"),
    )


def order_fact(orders: DataFrame, dim_customer: DataFrame | None, dim_product: DataFrame) -> DataFrame:
    """One row per order: key, total, versions in force when it was placed, category."""
    fact = orders.withColumn("order_sk", hashed_key("order_id")).withColumn("total_amount", (F.col("quantity") * F.col("price")).cast("decimal(18,2)"))
    if dim_customer is not None:
        fact = as_of_join(fact, dim_customer, "customer_id", "customer_sk")
    return as_of_join(fact, dim_product, "product_id", "product_sk", extra=["category"])


# Names of the milestones and of the days between them.
MILESTONES = ("created_at", "paid_at", "shipped_at", "delivered_at")
SPANS = {
    "days_placed_to_paid": ("created_at", "paid_at"),
    "days_paid_to_shipped": ("paid_at", "shipped_at"),
    "days_shipped_to_delivered": ("shipped_at", "delivered_at"),
    "days_placed_to_delivered": ("created_at", "delivered_at"),
}


def lifecycle(orders: DataFrame) -> DataFrame:
    """Accumulating snapshot: milestones and days between them."""
    days = [days_between(start, end).alias(name) for name, (start, end) in SPANS.items()]
    return orders.select(hashed_key("order_id").alias("order_sk"), "order_id", "status", *MILESTONES, "cancelled_at", "updated_at", *days)


def wishlist_fact(wishes: DataFrame, dim_customer: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Factless fact: key, versions in force, date; no measures."""
    fact = wishes.withColumn("wishlist_event_sk", hashed_key("wishlist_event_id"))
    fact = as_of_join(as_of_join(fact, dim_customer, "customer_id", "customer_sk", "added_at"), dim_product, "product_id", "product_sk", "added_at")
    return fact.select("wishlist_event_sk", "customer_sk", "product_sk", "wishlist_event_id", "customer_id", "product_id", F.to_date("added_at").alias("added_date"), "added_at", "source", F.col("added_at").alias("updated_at"))


def not_bought(wishes: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    return wishes.select(*keys).distinct().join(orders.select(*keys), keys, "left_anti")


def customer_ltv(orders: DataFrame, key: str = "customer_sk", as_of: Column | None = None, churn_days: int = 90) -> DataFrame:
    """Value per customer over orders (key, created_at, total_amount, status) that are not
    cancelled. as_of: by default the latest such order."""
    live = orders.filter("status != 'cancelled'")
    # gaps between orders in time add up to the time from the first to the last
    gaps = F.count("created_at") - 1
    per = live.groupBy(key).agg(
        F.sum("total_amount").alias("total_revenue"), F.count("*").alias("order_count"), F.min("created_at").alias("first_order_at"), F.max("created_at").alias("last_order_at"),
        F.try_divide(days_between(F.min("created_at"), F.max("created_at")), gaps).alias("avg_days_between"),
    )
    end = per.agg(F.max("last_order_at").alias("_as_of")) if as_of is None else per.sparkSession.range(1).select(as_of.cast("timestamp").alias("_as_of"))
    churned = (F.col("order_count") > 1) & (F.datediff("_as_of", "last_order_at") > churn_days)
    return per.crossJoin(F.broadcast(end)).withColumn("is_churned", churned).drop("_as_of")


def daily_revenue(facts: DataFrame) -> DataFrame:
    """Per day and category; revenue holds cancelled orders too."""
    cancelled = F.col("status") == "cancelled"
    return facts.groupBy(F.to_date("created_at").alias("day"), "category").agg(
        F.count("*").alias("order_count"), F.sum("total_amount").alias("revenue"), F.avg("total_amount").alias("avg_order"),
        F.sum(F.when(cancelled, F.col("total_amount")).otherwise(0)).alias("cancelled_revenue"), F.count_if(cancelled).alias("cancelled_count"),
    )


def refresh_days(mart: DataFrame, touched: DataFrame, day: str = "day") -> DataFrame:
    """The mart with the rows of touched days replaced."""
    return mart.join(touched.select(day).distinct(), day, "left_anti").unionByName(touched)


def convert(facts: DataFrame, rates: DataFrame, amount: str = "total_amount", ts: str = "created_at") -> DataFrame:
    """Revenue by currency and day at the day's rate (rates: rate_date, target_currency, rate)."""
    days = facts.groupBy(F.to_date(ts).alias("rate_date")).agg(F.sum(amount).alias("_sum"))
    return days.join(rates, "rate_date").select("rate_date", "target_currency", (F.col("_sum") * F.col("rate")).alias("revenue"))
