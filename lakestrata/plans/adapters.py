"""The supplied tables seen as orders, dimensions, clicks, rates and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.rules import Rule, split_quarantine
from ..operators.state import latest_per_key

UPDATED_RULE = [Rule("updated_at_not_before_created", "updated_at >= created_at")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its timestamps, which carry no zone, are taken for UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").when(F.col("o_orderstatus") == "F", "delivered").otherwise("placed")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"), "l_suppkey", "l_extendedprice", "l_returnflag",
    )


def good_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_quarantine(order_lines(spark, sf_dir), UPDATED_RULE)[0]


def dedup(lines: DataFrame) -> DataFrame:
    return latest_per_key(lines, ["order_id"], [F.desc("updated_at"), F.desc("product_id"), F.desc("l_suppkey"), F.desc("l_extendedprice")])


def product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by product at once: a product has hardly two lines of a day, and its history lies by product
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag").repartition("l_partkey")
    return lines.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("updated_at")).agg(F.max("l_returnflag").alias("category"))


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(product_changes(spark, sf_dir), "product_id", ["category"], [], "product_sk")


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("updated_at")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(customer_changes(spark, sf_dir), "customer_id", ["priority"], [], "customer_sk")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cookie"), customer.alias("customer_id"), "event_type", F.col("props").alias("page_url"), F.col("event_type").alias("device"), F.col("ts").alias("event_ts"))


def ltv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("delivered")
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_sk"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"), status.alias("status"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("rate_date")).distinct()
    nations = load(spark, sf_dir, "nation").filter("n_nationkey < 5").select("n_nationkey")
    source = F.when((F.dayofmonth("rate_date") + F.col("n_nationkey")) % 3 == 0, "simulated").otherwise("api")
    return days.crossJoin(F.broadcast(nations)).select("rate_date", F.col("n_nationkey").cast("int").alias("target_currency"), (1 + F.col("n_nationkey") * F.lit(0.01)).cast("decimal(18,6)").alias("rate"), source.alias("source"))


def milestone_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose milestones follow each other after days taken from the key; a remainder
    of 0 leaves a milestone, and those after it, open."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    after = lambda ts, n: F.when(n != 0, F.timestamp_add("HOUR", (n * 7).cast("int"), ts))
    df = load(spark, sf_dir, "orders").select(k.cast("string").alias("order_id"), at.alias("created_at"), F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("placed").alias("status"), k.alias("k"))
    df = df.withColumn("paid_at", after(F.col("created_at"), F.col("k") % 5))
    df = df.withColumn("shipped_at", after(F.col("paid_at"), F.col("k") % 7)).withColumn("delivered_at", after(F.col("shipped_at"), F.col("k") % 3))
    return df.withColumn("cancelled_at", F.when(F.col("status") == "cancelled", F.col("created_at"))).withColumn("updated_at", F.greatest("created_at", "paid_at", "shipped_at", "delivered_at")).drop("k")


def wishes(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """Events of a kind on product k of props, as wishes or purchases."""
    product = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(F.col("event_id").cast("string").alias("wishlist_event_id"), F.col("user_id").alias("customer_id"), product.alias("product_id"), F.col("ts").alias("added_at"), F.lit("/products").alias("source"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("pipeline"), state.alias("state"), F.col("ts").alias("start_time"), F.col("value").alias("duration_s"), "event_type")


