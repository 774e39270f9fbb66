"""Queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import STAMP
from ..operators import audit, facts, gates, rules, state
from ..operators import history as H
from ..operators.quantiles import exact_quantiles
from ..sources import partitioned, tables
from ..streaming import pipelines
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- SQL views that the oracles share ------------------------------------------------
LINES = """lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS order_id, o_custkey AS customer_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'delivered' ELSE 'placed' END AS status,
  o_orderdate AS created_at, l_shipdate AS updated_at, l_suppkey, l_extendedprice, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DEDUP = f"""{LINES}, good AS (SELECT * FROM lines WHERE updated_at >= created_at),
dedup AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, product_id DESC, l_suppkey DESC, l_extendedprice DESC) = 1)"""


def _dim(name: str, nk: str, sk: str, attr: str, changes: str) -> str:
    return f"""{name}_c AS ({changes}),
{name}_s AS (SELECT * FROM (SELECT *, lag({attr}) OVER w AS b, row_number() OVER w AS n FROM {name}_c WINDOW w AS (PARTITION BY {nk} ORDER BY updated_at)) WHERE n = 1 OR b IS DISTINCT FROM {attr}),
{name} AS (SELECT sha256(concat_ws('|', CAST({nk} AS VARCHAR), strftime(updated_at, '%Y-%m-%d %H:%M:%S'))) AS {sk}, {nk}, {attr}, updated_at AS effective_from,
  coalesce(lead(updated_at) OVER w, TIMESTAMP '9999-12-31 23:59:59') AS effective_to, lead(updated_at) OVER w IS NULL AS is_current FROM {name}_s WINDOW w AS (PARTITION BY {nk} ORDER BY updated_at))"""


PRODUCT = _dim("dim_product", "product_id", "product_sk", "category", "SELECT l_partkey AS product_id, l_shipdate AS updated_at, max(l_returnflag) AS category FROM lineitem GROUP BY ALL")
CUSTOMER_CHANGES = "SELECT o_custkey AS customer_id, o_orderdate AS updated_at, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL"
CUSTOMER = _dim("dim_customer", "customer_id", "customer_sk", "priority", CUSTOMER_CHANGES)
FACT = f"""{DEDUP}, {PRODUCT}, fact AS (SELECT d.*, CAST(quantity * price AS DECIMAL(18,2)) AS total_amount, p.product_sk, p.category FROM dedup d
  LEFT JOIN dim_product p ON p.product_id = d.product_id AND created_at >= effective_from AND created_at < effective_to)"""
RATES = """rates AS (SELECT d.rate_date, CAST(n_nationkey AS INT) AS target_currency, CAST(1 + n_nationkey * 0.01 AS DECIMAL(18,6)) AS rate,
  CASE WHEN (extract(day FROM d.rate_date) + n_nationkey) % 3 = 0 THEN 'simulated' ELSE 'api' END AS source
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS rate_date FROM orders) d CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 5))"""
SESSIONS = """clicks AS (SELECT event_id, user_id AS cookie, CASE WHEN event_id % 3 <> 0 THEN user_id END AS customer_id, event_type, props, ts FROM events),
marked AS (SELECT *, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 1800, TRUE) AS apart FROM clicks WINDOW w AS (PARTITION BY cookie ORDER BY ts, event_id)),
sess AS (SELECT *, sha256(concat_ws('|', CAST(cookie AS VARCHAR), CAST(CAST(seq AS BIGINT) AS VARCHAR))) AS session_key FROM
  (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY cookie ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM marked))"""
FACT_SESSION = f"""{SESSIONS}, fs AS (SELECT session_key, min(event_id) AS first_event_id, min(ts) AS s0, max(ts) AS s1, count(*) AS event_count, count(DISTINCT event_type) AS distinct_event_types,
  last(customer_id ORDER BY ts, event_id) FILTER (customer_id IS NOT NULL) AS attributed_customer_id, bool_or(event_type = 'purchase') AS converted,
  first(props ORDER BY ts, event_id) AS first_page_url, last(props ORDER BY ts, event_id) AS last_page_url, first(event_type ORDER BY ts, event_id) AS device FROM sess GROUP BY session_key)"""


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def text_time(c: str):
    return F.date_format(c, STAMP).alias(c)


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def line_columns() -> list:
    return ["order_id", "customer_id", "product_id", "quantity", F.col("price").cast("double").alias("price"), "status", text_time("created_at"), text_time("updated_at")]


SQL_LINE = f"order_id, customer_id, product_id, quantity, CAST(price AS DOUBLE) AS price, status, {_stamp('created_at')} AS created_at, {_stamp('updated_at')} AS updated_at"


# --- rules ------------------------------------------------------------------------------
@query("rules_good", f"WITH {LINES} SELECT {SQL_LINE} FROM lines WHERE updated_at >= created_at")
def rules_good(spark, sf):
    return A.good_lines(spark, sf).select(line_columns())


LINE_RULES = [rules.Rule("quantity_small", "quantity <= 45"), *A.UPDATED_RULE]
SQL_REASON = "concat_ws(',', CASE WHEN NOT quantity <= 45 THEN 'quantity_small' END, CASE WHEN NOT updated_at >= created_at THEN 'updated_at_not_before_created' END)"


@query("rules_bad", f"WITH {LINES} SELECT {SQL_LINE}, {SQL_REASON} AS _quarantine_reason FROM lines WHERE {SQL_REASON} <> ''")
def rules_bad(spark, sf):
    return rules.split_quarantine(A.order_lines(spark, sf), LINE_RULES)[1].select(*line_columns(), rules.REASON)


@query("rules_breakdown", f"WITH {LINES}, bad AS (SELECT {SQL_REASON} AS reason FROM lines) SELECT reason, count(*) AS n FROM bad WHERE reason <> '' GROUP BY reason")
def rules_breakdown(spark, sf):
    return rules.breakdown(rules.split_quarantine(A.order_lines(spark, sf), LINE_RULES)[1])


@query("rules_null_policy", """SELECT policy, count(*) AS n FROM (SELECT 'pass' AS policy FROM lineitem WHERE l_orderkey % 5 = 0 OR l_quantity > 20
  UNION ALL SELECT 'fail' FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_quantity > 20) GROUP BY policy""")
def rules_null_policy(spark, sf):
    lines = A.load(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("quantity"))
    rule = [rules.Rule("enough", "quantity > 20")]
    both = [rules.split_quarantine(lines, rule, p)[0].select(F.lit(p).alias("policy")) for p in ("pass", "fail")]
    return both[0].unionByName(both[1]).groupBy("policy").agg(F.count("*").alias("n"))


@query("quarantine_disposition", f"""WITH {LINES}, q AS (SELECT order_id, CAST(split_part(order_id, '-', 1) AS BIGINT) % 4 AS m FROM lines WHERE {SQL_REASON} <> '' GROUP BY order_id)
SELECT 'waiting' AS part, order_id FROM q WHERE m = 3 UNION ALL SELECT 'audit', order_id FROM q WHERE m < 3 UNION ALL SELECT 'released', order_id FROM q WHERE m = 2 UNION ALL SELECT 'still_bad', order_id FROM q WHERE m = 1""")
def quarantine_disposition(spark, sf):
    bad = rules.split_quarantine(A.order_lines(spark, sf), LINE_RULES)[1]
    keyed = bad.dropDuplicates(["order_id"])
    m = F.split_part("order_id", F.lit("-"), F.lit(1)).cast("long") % 4
    action = F.when(m == 0, "discard").when(m == 1, "replay").when(m == 2, "fix")
    decisions = keyed.select("order_id", action.alias("action"), F.lit("op").alias("operator"), F.lit("reviewed").alias("reason"), F.current_timestamp().alias("at")).filter("action is not null")
    fixed = keyed.drop(rules.REASON).withColumn("quantity", F.lit(1)).withColumn("updated_at", F.col("created_at"))
    found = rules.dispose(keyed, decisions, fixed, "order_id", LINE_RULES)
    parts = [df.select(F.lit(name).alias("part"), "order_id") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- current state ------------------------------------------------------------------------
@query("watermark_orders", f"SELECT o_orderkey, {_stamp('o_orderdate')} AS o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 10 DAY")
def watermark_orders(spark, sf):
    return state.watermark(A.load(spark, sf, "orders"), "o_orderdate", 10).select("o_orderkey", text_time("o_orderdate"))


@query("dedup_lines", f"WITH {DEDUP} SELECT {SQL_LINE} FROM dedup")
def dedup_lines(spark, sf):
    return A.dedup(A.good_lines(spark, sf)).select(line_columns())


def _merge_sides(spark, sf):
    base = A.dedup(A.good_lines(spark, sf)).select("order_id", "product_id", "status", F.col("price").cast("double").alias("price"), "updated_at")
    shifted = base.filter("product_id % 3 != 1").withColumn("updated_at", F.timestamp_add("DAY", (F.col("product_id") % 5 - 2).cast("int"), F.col("updated_at"))).withColumn("status", F.lit("changed")).withColumn("price", -F.col("price"))
    return base.filter("product_id % 3 != 0"), shifted


SQL_SIDES = f"""{DEDUP}, base AS (SELECT order_id, product_id, status, CAST(price AS DOUBLE) AS price, updated_at FROM dedup), t AS (SELECT * FROM base WHERE product_id % 3 <> 0),
s AS (SELECT order_id, product_id, 'changed' AS status, -price AS price, updated_at + CAST(product_id % 5 - 2 AS INT) * INTERVAL 1 DAY AS updated_at FROM base WHERE product_id % 3 <> 1)"""


def state_columns() -> list:
    return ["order_id", "product_id", "status", "price", text_time("updated_at")]




def _sql_state(pick: str) -> str:
    return f"""WITH {SQL_SIDES} SELECT coalesce(t.order_id, s.order_id) AS order_id, {', '.join(f"{pick.format(c=c)} AS {c}" for c in ('product_id', 'status', 'price'))},
{_stamp(pick.format(c='updated_at'))} AS updated_at FROM t FULL JOIN s ON t.order_id = s.order_id"""


@query("merge_newer_wins", _sql_state("CASE WHEN t.order_id IS NULL OR s.updated_at > t.updated_at THEN s.{c} ELSE t.{c} END"))
def merge_newer_wins(spark, sf):
    return state.merge_newer(*_merge_sides(spark, sf), ["order_id"]).select(state_columns())


@query("merge_insert_only", _sql_state("CASE WHEN t.order_id IS NULL THEN s.{c} ELSE t.{c} END"))
def merge_insert_only(spark, sf):
    return state.merge_insert_only(*_merge_sides(spark, sf), ["order_id"]).select(state_columns())


@query("merge_mutable", f"""WITH {SQL_SIDES} SELECT coalesce(t.order_id, s.order_id) AS order_id, coalesce(t.product_id, s.product_id) AS product_id, coalesce(s.status, t.status) AS status,
coalesce(t.price, s.price) AS price, {_stamp('coalesce(t.updated_at, s.updated_at)')} AS updated_at FROM t FULL JOIN s ON t.order_id = s.order_id""")
def merge_mutable(spark, sf):
    return state.merge_mutable(*_merge_sides(spark, sf), ["order_id"], ["status"]).select(state_columns())


@query("schema_evolution", """SELECT event_type, count(*) AS n, count(value) AS n_value FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events) GROUP BY event_type""")
def schema_evolution(spark, sf):
    events = A.load(spark, sf, "events")
    old, new = events.filter("event_id % 2 = 1").select("event_id", "event_type"), events.filter("event_id % 2 = 0").select("event_id", "event_type", "value")
    return tables.evolve(old, new).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"))


@query("typed_load", """SELECT CAST(event_id AS BIGINT) AS event_id, CAST(round(value, 2) AS DOUBLE) AS value, 'b1' AS _source_batch_id FROM events WHERE event_id % 7 <> 0""")
def typed_load(spark, sf):
    raw = A.load(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.col("event_id").cast("string")).alias("event_id"), F.round("value", 2).cast("string").alias("value"))
    return tables.load_projection(raw, {"event_id": "long", "value": "double"}, "b1")


@query("batch_slice", "SELECT event_id, event_type, 'b1' AS _batch_id FROM events WHERE event_id % 2 = 1")
def batch_slice(spark, sf):
    events = A.load(spark, sf, "events").select("event_id", "event_type")
    parts = [tables.with_lineage(events.filter(F.col("event_id") % 2 == i), f"b{i}", None) for i in (0, 1)]
    return tables.batch_slice(parts[0].unionByName(parts[1]), "b1").select("event_id", "event_type", "_batch_id")


@query("snapshots", "SELECT 0 AS version, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, count(*) FROM orders")
def snapshots(spark, sf):
    orders = A.load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    table = tables.work_path(spark, "snapshots")
    tables.publish(orders.filter("o_orderkey % 2 = 0"), table, 0)
    tables.publish(orders, table, 1)
    old, now = tables.read_snapshot(spark, table, version=0), tables.read_snapshot(spark, table)
    return old.agg(F.lit(0).alias("version"), F.count("*").alias("n")).unionByName(now.agg(F.lit(1).alias("version"), F.count("*").alias("n")))


# --- history ------------------------------------------------------------------------------
def _versions(df, sk, nk, attr):
    return df.select(sk, nk, attr, text_time("effective_from"), text_time("effective_to"), "is_current")


def _sql_versions(name, sk, nk, attr):
    return f"SELECT {sk}, {nk}, {attr}, {_stamp('effective_from')} AS effective_from, {_stamp('effective_to')} AS effective_to, is_current FROM {name}"


@query("scd2_history", f"WITH {CUSTOMER} {_sql_versions('dim_customer', 'customer_sk', 'customer_id', 'priority')}")
def scd2_history(spark, sf):
    return _versions(A.customer_dim(spark, sf), "customer_sk", "customer_id", "priority")


CUT = "1997-01-01 00:00:00"


@query("scd2_merge_step", f"""WITH {_dim('dim_customer', 'customer_id', 'customer_sk', 'priority', f"SELECT * FROM ({CUSTOMER_CHANGES}) WHERE updated_at < TIMESTAMP '{CUT}'")},
src AS (SELECT * FROM ({CUSTOMER_CHANGES}) WHERE updated_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC) = 1),
ins AS (SELECT sha256(concat_ws('|', CAST(s.customer_id AS VARCHAR), {_stamp('updated_at')})) AS customer_sk, s.customer_id, s.priority, updated_at AS effective_from, TIMESTAMP '9999-12-31 23:59:59' AS effective_to, TRUE AS is_current
  FROM src s LEFT JOIN dim_customer d ON d.customer_id = s.customer_id AND d.is_current WHERE d.customer_id IS NULL OR d.priority <> s.priority),
old AS (SELECT d.customer_sk, d.customer_id, d.priority, d.effective_from, CASE WHEN d.is_current AND i.customer_id IS NOT NULL THEN i.effective_from ELSE d.effective_to END AS effective_to, d.is_current AND i.customer_id IS NULL AS is_current
  FROM dim_customer d LEFT JOIN ins i ON i.customer_id = d.customer_id), dim AS (SELECT * FROM old UNION ALL SELECT * FROM ins) {_sql_versions('dim', 'customer_sk', 'customer_id', 'priority')}""")
def scd2_merge_step(spark, sf):
    changes = A.customer_changes(spark, sf)
    before = H.history(changes.filter(F.col("updated_at") < F.lit(CUT).cast("timestamp")), "customer_id", ["priority"], [], "customer_sk")
    source = state.latest_by_max(changes.filter(F.col("updated_at") >= F.lit(CUT).cast("timestamp")), ["customer_id"], ["updated_at"])
    return _versions(H.merge_snapshot(before, source, "customer_id", ["priority"], [], "customer_sk"), "customer_sk", "customer_id", "priority")


@query("scd2_invariants", f"""WITH {CUSTOMER} SELECT 'overlaps' AS what, count(*) AS n FROM dim_customer a JOIN dim_customer b ON a.customer_id = b.customer_id AND a.effective_from < b.effective_from AND a.effective_to > b.effective_from
UNION ALL SELECT 'several_current', count(*) FROM (SELECT customer_id FROM dim_customer WHERE is_current GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'current', count(*) FROM dim_customer WHERE is_current""")
def scd2_invariants(spark, sf):
    dim = A.customer_dim(spark, sf)
    parts = {"overlaps": H.overlaps(dim, "customer_id", "customer_sk"), "several_current": H.several_current(dim, "customer_id"), "current": H.current(dim)}
    frames = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("overlapping_versions", f"""WITH {CUSTOMER}, d AS (SELECT customer_sk, customer_id, effective_from AS a, CASE WHEN customer_id % 3 = 0 AND NOT is_current THEN effective_to + CAST(customer_id % 5 AS INT) * INTERVAL 200 DAY ELSE effective_to END AS b FROM dim_customer)
SELECT x.customer_id, x.customer_sk, y.customer_sk AS other_sk FROM d x JOIN d y ON x.customer_id = y.customer_id AND (x.a, x.customer_sk) < (y.a, y.customer_sk) AND y.a < x.b AND x.a < y.b""")
def overlapping_versions(spark, sf):
    """A third of the customers have versions that end up to 800 days too late."""
    late = F.timestamp_add("DAY", (F.col("customer_id") % 5 * 200).cast("int"), F.col("effective_to"))
    dim = A.customer_dim(spark, sf).withColumn("effective_to", F.when((F.col("customer_id") % 3 == 0) & ~F.col("is_current"), late).otherwise(F.col("effective_to")))
    return H.overlaps(dim, "customer_id", "customer_sk")


SQL_PIT = "SELECT d.order_id, d.l_suppkey, {stamp} AS created_at, x.{sk}{extra} FROM lines d LEFT JOIN {dim} x ON x.{nk} = d.{nk} AND created_at >= effective_from AND created_at < effective_to"


@query("pit_product", f"WITH {LINES}, {PRODUCT} " + SQL_PIT.format(stamp=_stamp("created_at"), sk="product_sk", extra=", x.category", dim="dim_product", nk="product_id"))
def pit_product(spark, sf):
    return H.as_of_join(A.order_lines(spark, sf), A.product_dim(spark, sf), "product_id", "product_sk", extra=["category"]).select("order_id", "l_suppkey", text_time("created_at"), "product_sk", "category")


@query("pit_customer", f"WITH {LINES}, {CUSTOMER} " + SQL_PIT.format(stamp=_stamp("created_at"), sk="customer_sk", extra="", dim="dim_customer", nk="customer_id"))
def pit_customer(spark, sf):
    return H.as_of_union(A.order_lines(spark, sf), A.customer_dim(spark, sf), "customer_id", "customer_sk").select("order_id", "l_suppkey", text_time("created_at"), "customer_sk")


@query("pit_orphan_rate", f"WITH {FACT} SELECT count(*) AS n, count(*) FILTER (product_sk IS NULL) AS n_orphans, round(count(*) FILTER (product_sk IS NULL) * 100.0 / count(*), 4) AS orphan_pct, n_orphans * 100.0 / n <= 1.0 AS passed FROM fact")
def pit_orphan_rate(spark, sf):
    return gates.orphan_rate(_fact(spark, sf), ["product_sk"])


# --- facts and marts -------------------------------------------------------------------------
def _fact(spark, sf):
    return facts.order_fact(A.dedup(A.good_lines(spark, sf)), None, A.product_dim(spark, sf))


@query("fact_orders", f"WITH {FACT} SELECT sha256(order_id) AS order_sk, order_id, CAST(total_amount AS DOUBLE) AS total_amount, product_sk, category, status FROM fact")
def fact_orders(spark, sf):
    return _fact(spark, sf).select("order_sk", "order_id", F.col("total_amount").cast("double").alias("total_amount"), "product_sk", "category", "status")


@query("fact_orders_two_dims", f"""WITH {FACT}, {CUSTOMER} SELECT f.order_id, f.product_sk, f.category, c.customer_sk FROM fact f
  LEFT JOIN dim_customer c ON c.customer_id = f.customer_id AND f.created_at >= c.effective_from AND f.created_at < c.effective_to""")
def fact_orders_two_dims(spark, sf):
    return facts.order_fact(A.dedup(A.good_lines(spark, sf)), A.customer_dim(spark, sf), A.product_dim(spark, sf)).select("order_id", "product_sk", "category", "customer_sk")


@query("daily_revenue", f"""WITH {FACT} SELECT strftime(created_at, '%Y-%m-%d') AS day, category, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS revenue, round(CAST(sum(total_amount) AS DOUBLE) / count(*), 4) AS avg_order,
CAST(sum(CASE WHEN status = 'cancelled' THEN total_amount ELSE 0 END) AS DOUBLE) AS cancelled_revenue, count(*) FILTER (status = 'cancelled') AS cancelled_count FROM fact GROUP BY 1, 2""")
def daily_revenue(spark, sf):
    mart = facts.daily_revenue(_fact(spark, sf))
    return mart.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "category", "order_count", F.col("revenue").cast("double").alias("revenue"), F.round(F.col("revenue").cast("double") / F.col("order_count"), 4).alias("avg_order"), F.col("cancelled_revenue").cast("double").alias("cancelled_revenue"), "cancelled_count")


@query("revenue_reconcile", f"WITH {FACT} SELECT CAST(sum(total_amount) AS DOUBLE) AS view_sum, CAST(sum(total_amount) AS DOUBLE) AS fact_sum, TRUE AS matches FROM fact")
def revenue_reconcile(spark, sf):
    fact = _fact(spark, sf)
    return gates.reconcile(facts.daily_revenue(fact), fact, "revenue", "total_amount").select(F.col("view_sum").cast("double").alias("view_sum"), F.col("fact_sum").cast("double").alias("fact_sum"), "matches")


@query("lifecycle", """WITH m AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + CAST(o_orderkey % 5 * 7 AS INT) * INTERVAL 1 HOUR END AS paid FROM orders),
n AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN paid + CAST(o_orderkey % 7 * 7 AS INT) * INTERVAL 1 HOUR END AS shipped FROM m), l AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN shipped + CAST(o_orderkey % 3 * 7 AS INT) * INTERVAL 1 HOUR END AS delivered FROM n)
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, round((epoch(paid) - epoch(o_orderdate)) / 86400.0, 6) AS days_placed_to_paid, round((epoch(shipped) - epoch(paid)) / 86400.0, 6) AS days_paid_to_shipped,
round((epoch(delivered) - epoch(shipped)) / 86400.0, 6) AS days_shipped_to_delivered, round((epoch(delivered) - epoch(o_orderdate)) / 86400.0, 6) AS days_placed_to_delivered FROM l""")
def lifecycle(spark, sf):
    return facts.lifecycle(A.milestone_orders(spark, sf)).select("order_id", *[F.round(c, 6).alias(c) for c in facts.SPANS])


@query("cycle_percentiles", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 5) * 7 / 24.0 END AS d FROM orders) SELECT month, round(quantile_cont(d, 0.5), 6) AS p50_days, round(quantile_cont(d, 0.95), 6) AS p95_days FROM m WHERE d IS NOT NULL GROUP BY month""")
def cycle_percentiles(spark, sf):
    life = facts.lifecycle(A.milestone_orders(spark, sf))
    months = life.select(F.date_format("created_at", "yyyy-MM").alias("month"), "days_placed_to_paid")
    return exact_quantiles(months, ["month"], "days_placed_to_paid", {"p50_days": 0.5, "p95_days": 0.95}).withColumns({c: F.round(c, 6) for c in ("p50_days", "p95_days")})


@query("lifecycle_merge", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS n_paid, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) AS n_shipped FROM orders")
def lifecycle_merge(spark, sf):
    full = facts.lifecycle(A.milestone_orders(spark, sf))
    early = full.withColumn("shipped_at", F.lit(None).cast("timestamp")).withColumn("delivered_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    late = full.withColumn("paid_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.timestamp_add("DAY", F.lit(30), F.col("created_at")))
    merged = state.merge_milestones(early, late, ["order_sk"], ["paid_at", "shipped_at", "delivered_at"])
    return merged.agg(F.count("*").alias("n"), F.count("paid_at").alias("n_paid"), F.count("shipped_at").alias("n_shipped"))


@query("customer_ltv", """WITH live AS (SELECT o_custkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, (epoch(o_orderdate) - epoch(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400.0 AS gap FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey AS customer_sk, CAST(sum(amount) AS DOUBLE) AS total_revenue, count(*) AS order_count, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_order_at, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_order_at, round(avg(gap), 4) AS avg_days_between,
count(*) > 1 AND date_diff('day', CAST(max(o_orderdate) AS DATE), CAST((SELECT max(o_orderdate) FROM live) AS DATE)) > 90 AS is_churned FROM live GROUP BY 1""")
def customer_ltv(spark, sf):
    ltv = facts.customer_ltv(A.ltv_orders(spark, sf))
    return ltv.select("customer_sk", F.col("total_revenue").cast("double").alias("total_revenue"), "order_count", text_time("first_order_at"), text_time("last_order_at"), F.round("avg_days_between", 4).alias("avg_days_between"), "is_churned")


# --- sessions ------------------------------------------------------------------------------
def _sessions(spark, sf):
    return facts.sessionize(A.clicks(spark, sf), "cookie", "event_ts", "event_id")


@query("sessions", f"WITH {SESSIONS} SELECT event_id, cookie, CAST(seq AS BIGINT) AS session_seq, session_key FROM sess")
def sessions(spark, sf):
    return _sessions(spark, sf).select("event_id", "cookie", "session_seq", "session_key")


@query("session_fact", f"WITH {FACT_SESSION} SELECT session_key, first_event_id, {_stamp('s0')} AS session_start, {_stamp('s1')} AS session_end, event_count, distinct_event_types, attributed_customer_id, converted, first_page_url, last_page_url, device FROM fs")
def session_fact(spark, sf):
    return facts.session_fact(_sessions(spark, sf), "event_ts", "event_id").withColumns({c: F.date_format(c, STAMP) for c in ("session_start", "session_end")})


@query("session_conversion", f"WITH {FACT_SESSION} SELECT strftime(s0, '%Y-%m-%d') AS day, count(*) AS n, round(avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END), 6) AS converted_share FROM fs GROUP BY 1")
def session_conversion(spark, sf):
    fact = facts.session_fact(_sessions(spark, sf), "event_ts", "event_id")
    return fact.groupBy(F.date_format("session_start", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("converted"), 1.0).otherwise(0.0)), 6).alias("converted_share"))


@query("session_orphan", f"""WITH {FACT_SESSION}, c AS (SELECT * FROM fs WHERE attributed_customer_id IS NOT NULL), x AS (SELECT c.*, k.c_custkey FROM c LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) k ON c_custkey = attributed_customer_id)
SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS n_orphans, round(count(*) FILTER (c_custkey IS NULL) * 100.0 / count(*), 4) AS orphan_pct, n_orphans * 100.0 / n <= 1.0 AS passed FROM x""")
def session_orphan(spark, sf):
    fact = facts.session_fact(_sessions(spark, sf), "event_ts", "event_id").filter("attributed_customer_id is not null")
    known = A.load(spark, sf, "customer").filter("c_custkey % 10 != 0").select("c_custkey")
    return gates.orphan_rate(fact.join(known, F.col("attributed_customer_id") == F.col("c_custkey"), "left"), ["c_custkey"])


@query("wishlist_fact", f"""WITH {CUSTOMER}, {PRODUCT}, w AS (SELECT CAST(event_id AS VARCHAR) AS id, user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, ts AS added FROM events WHERE event_type = 'click')
SELECT sha256(id) AS wishlist_event_sk, id AS wishlist_event_id, w.customer_id, w.product_id, customer_sk, product_sk, strftime(added, '%Y-%m-%d') AS added_date FROM w
LEFT JOIN dim_customer c ON c.customer_id = w.customer_id AND added >= c.effective_from AND added < c.effective_to LEFT JOIN dim_product p ON p.product_id = w.product_id AND added >= p.effective_from AND added < p.effective_to""")
def wishlist_fact(spark, sf):
    fact = facts.wishlist_fact(A.wishes(spark, sf), A.customer_dim(spark, sf), A.product_dim(spark, sf))
    return fact.select("wishlist_event_sk", "wishlist_event_id", "customer_id", "product_id", "customer_sk", "product_sk", F.date_format("added_date", "yyyy-MM-dd").alias("added_date"))


@query("wishlist_not_bought", """WITH e AS (SELECT user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, event_type FROM events)
SELECT DISTINCT customer_id, product_id FROM e WHERE event_type = 'click' AND (customer_id, product_id) NOT IN (SELECT (customer_id, product_id) FROM e WHERE event_type = 'purchase')""")
def wishlist_not_bought(spark, sf):
    return facts.not_bought(A.wishes(spark, sf), A.wishes(spark, sf, "purchase"), ["customer_id", "product_id"])


# --- currency ------------------------------------------------------------------------------
@query("currency_convert", f"WITH {RATES}, d AS (SELECT CAST(o_orderdate AS DATE) AS rate_date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, target_currency, round(CAST(s AS DOUBLE) * CAST(rate AS DOUBLE), 4) AS revenue FROM d JOIN rates USING (rate_date)")
def currency_convert(spark, sf):
    orders = A.ltv_orders(spark, sf).withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    rates = A.rates(spark, sf)
    days = orders.groupBy(F.to_date("created_at").alias("rate_date")).agg(F.sum("total_amount").cast("double").alias("total_amount"))
    found = facts.convert(days.withColumn("created_at", F.col("rate_date").cast("timestamp")), rates.withColumn("rate", F.col("rate").cast("double")))
    return found.select(F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "target_currency", F.round("revenue", 4).alias("revenue"))


RATE_DAY = "1996-06-15"


@query("currency_gate", f"WITH {RATES}, r AS (SELECT * FROM rates WHERE rate_date = DATE '{RATE_DAY}') SELECT count(*) AS n, count(*) FILTER (source = 'simulated') AS n_simulated, round(coalesce(count(*) FILTER (source = 'simulated') * 100.0 / nullif(count(*), 0), 0), 4) AS simulated_pct, count(*) > 0 AND coalesce(count(*) FILTER (source = 'simulated') * 100.0 / nullif(count(*), 0), 0) <= 50 AS passed FROM r")
def currency_gate(spark, sf):
    return gates.currency_freshness(A.rates(spark, sf), F.lit(RATE_DAY).cast("date"))


@query("currency_hourly", """WITH r AS (SELECT ts, CASE WHEN event_id % 4 = 0 THEN 'simulated' ELSE 'api' END AS source FROM events), e AS (SELECT max(ts) AS m FROM r)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(avg(CASE WHEN source = 'simulated' THEN 100.0 ELSE 0.0 END), 6) AS simulated_pct FROM r, e WHERE ts > m - INTERVAL 24 HOUR AND ts <= m GROUP BY 1""")
def currency_hourly(spark, sf):
    rates = A.load(spark, sf, "events").select("ts", F.when(F.col("event_id") % 4 == 0, "simulated").otherwise("api").alias("source"))
    end = rates.agg(F.max("ts").alias("_end"))
    return gates.simulated_by_hour(rates.crossJoin(F.broadcast(end)), "ts", F.col("_end")).withColumn("hour", F.date_format("hour", STAMP))


# --- checks and reports --------------------------------------------------------------------------
@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf):
    return state.duplicate_keys(A.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("referential", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def referential(spark, sf):
    parent = A.load(spark, sf, "customer").filter("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return gates.missing_parents(A.load(spark, sf, "orders"), parent, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("domain_checks", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')")
def domain_checks(spark, sf):
    return gates.outside_domain(A.load(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("row_count_gate", "WITH c AS (SELECT count(*) AS n_before, count(*) FILTER (o_orderkey % 4 <> 0) AS n_now FROM orders) SELECT n_before, n_now, round(greatest(0, (n_before - n_now) * 100.0 / n_before), 4) AS drop_pct, greatest(0, (n_before - n_now) * 100.0 / n_before) <= 20 AS passed FROM c")
def row_count_gate(spark, sf):
    orders = A.load(spark, sf, "orders")
    return gates.row_count_drop(orders, orders.filter("o_orderkey % 4 != 0"))


@query("non_decreasing", "SELECT count(*) AS n_before, count(*) FILTER (o_orderkey % 4 <> 0) AS n_now FROM orders HAVING count(*) FILTER (o_orderkey % 4 <> 0) < count(*)")
def non_decreasing(spark, sf):
    orders = A.load(spark, sf, "orders")
    return gates.shrunk(orders, orders.filter("o_orderkey % 4 != 0"))


NOW = "2024-02-01 00:00:00"


@query("freshness", f"""WITH x AS (SELECT 'events' AS table_name, max(ts) AS latest, 800.0 AS sla_hours FROM events UNION ALL SELECT 'orders', max(o_orderdate), 24.0 FROM orders),
y AS (SELECT *, CAST(trunc((epoch(TIMESTAMP '{NOW}') - epoch(latest)) / 3600) AS BIGINT) AS age_hours FROM x)
SELECT table_name, {_stamp('latest')} AS latest, CAST(sla_hours AS DOUBLE) AS sla_hours, age_hours, CASE WHEN age_hours < sla_hours * 0.5 THEN 'fresh' WHEN age_hours < sla_hours THEN 'warning' ELSE 'stale' END AS state FROM y""")
def freshness(spark, sf):
    found = gates.freshness({"events": (A.load(spark, sf, "events"), "ts", 800), "orders": (A.load(spark, sf, "orders"), "o_orderdate", 24)}, F.lit(NOW).cast("timestamp"))
    return found.withColumn("latest", F.date_format("latest", STAMP))


@query("usage_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL")
def usage_rollup(spark, sf):
    events = A.load(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return gates.usage(events, [F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type")], "value").withColumn("total", F.col("total").cast("double"))


@query("run_kpis", """WITH r AS (SELECT user_id % 5 AS pipeline, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state, ts, value FROM events), e AS (SELECT max(ts) AS m FROM r)
SELECT pipeline, count(*) AS runs, round(avg(CASE WHEN state = 'success' THEN 100.0 ELSE 0.0 END), 6) AS success_pct, round(median(value), 6) AS median_s FROM r, e WHERE ts > m - INTERVAL 24 HOUR GROUP BY 1""")
def run_kpis(spark, sf):
    runs = A.runs(spark, sf)
    return gates.run_kpis(runs.crossJoin(F.broadcast(runs.agg(F.max("start_time").alias("_end")))), "start_time", F.col("_end"))


@query("latest_runs", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_time FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def latest_runs(spark, sf):
    return gates.latest_rows(A.runs(spark, sf), 15, F.desc("start_time"), F.desc("event_id")).select("event_id", text_time("start_time"))


@query("file_audit", f"""WITH {LINES}, {RATES} SELECT 'clickstream' AS source, 'validated' AS status, 'ok' AS reason, count(*) AS n_rows FROM events
UNION ALL SELECT 'orders', 'validated', 'ok', count(*) FROM lines
UNION ALL SELECT 'currency_rates', 'quarantine', 'missing_columns: _source,base_currency', count(*) FROM rates
UNION ALL SELECT 'unknown', 'quarantine', 'unknown_source', NULL""")
def file_audit(spark, sf):
    root = tables.work_path(spark, "raw")
    clicks = A.clicks(spark, sf).select("event_id", F.col("cookie").alias("session_id"), "customer_id", "event_type", "page_url", "event_ts", "device", F.lit("agent").alias("user_agent"))
    clicks.write.option("ignoreNullFields", "false").json(f"{root}/clickstream/day=1")
    A.order_lines(spark, sf).select("order_id", "customer_id", "product_id", "quantity", "price", "status", "created_at", "updated_at").write.parquet(f"{root}/orders/day=1")
    A.rates(spark, sf).select("rate_date", "target_currency", "rate").write.option("header", "true").csv(f"{root}/currency_rates/day=1")
    A.load(spark, sf, "nation").write.parquet(f"{root}/nation")
    found = audit.audit_files(spark, root).filter("reason NOT IN ('empty_file', 'zero_rows')")  # Spark may write files without rows
    return found.groupBy("source", "status", "reason").agg(F.sum("n_rows").alias("n_rows"))


# --- streams ------------------------------------------------------------------------------
@query("stream_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT event_id % 2) AS n_batches FROM events GROUP BY event_type")
def stream_ingest(spark, sf):
    events = A.load(spark, sf, "events").select("event_id", "event_type", "user_id")
    raw, bronze, checkpoint = (tables.work_path(spark, n) for n in ("raw", "bronze", "checkpoint"))
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").json(raw)
        pipelines.ingest(spark, raw, bronze, checkpoint, events.schema, "json", f"b{part}")
    pipelines.ingest(spark, raw, bronze, checkpoint, events.schema, "json", "b2")
    return spark.read.parquet(bronze).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("_batch_id").alias("n_batches"))


@query("stream_sessions", """WITH m AS (SELECT user_id, date_trunc('second', ts) AS t, coalesce(epoch(date_trunc('second', ts)) - epoch(lag(date_trunc('second', ts)) OVER w) > 1800, TRUE) AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seq FROM m), f AS (SELECT user_id AS cookie, count(*) AS event_count, min(t) AS s0, max(t) AS s1 FROM s GROUP BY user_id, seq)
SELECT cookie, event_count, strftime(s0, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(s1, '%Y-%m-%d %H:%M:%S') AS session_end FROM f WHERE s1 < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_sessions(spark, sf):
    events = A.clicks(spark, sf).select("cookie", "event_ts")
    raw, out, checkpoint = (tables.work_path(spark, n) for n in ("raw", "sessions", "checkpoint"))
    events.write.parquet(raw)
    found = pipelines.session_windows(pipelines.open_stream(spark, raw, events.schema, "parquet"), "cookie", "event_ts")
    found.select("cookie", "event_count", "session_start", "session_end").writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    latest = events.agg(F.max("event_ts").alias("m"))
    closed = spark.read.parquet(out).join(F.broadcast(latest), F.col("session_end") < F.col("m") - F.expr("INTERVAL 2 HOURS")).drop("m")
    return closed.withColumns({c: F.date_format(c, STAMP) for c in ("session_start", "session_end")})


@query("stream_merge", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def stream_merge(spark, sf):
    events = A.load(spark, sf, "events").select("user_id", "ts", "event_id")
    raw, table, checkpoint = (tables.work_path(spark, n) for n in ("raw", "state", "checkpoint"))
    events.repartition(3, "event_id").write.parquet(raw)
    pipelines.run_merge(pipelines.open_stream(spark, raw, events.schema, "parquet", 1), table, checkpoint, ["user_id"], ["ts", "event_id"])
    return tables.read_snapshot(spark, table).select("user_id", text_time("ts"), "event_id")


# --- named rule sets, over views that break each rule somewhere ------------------------------
RULES_NOW = "1998-01-01 00:00:00"
_OR_NULL = "CASE WHEN {key} % {n} <> 0 THEN {value} END AS {name}"
RULE_VIEWS = {
    "orders": (rules.ORDERS, "lineitem", [
        _OR_NULL.format(key="l_orderkey", n=11, value="l_orderkey", name="order_id"), _OR_NULL.format(key="l_partkey", n=13, value="l_suppkey", name="customer_id"), _OR_NULL.format(key="l_suppkey", n=7, value="l_partkey", name="product_id"),
        "l_linenumber - 1 AS quantity", "l_extendedprice - 5000 AS price", "CASE l_returnflag WHEN 'R' THEN 'lost' WHEN 'A' THEN 'paid' ELSE 'placed' END AS status", "l_shipdate AS created_at", "CASE WHEN l_linenumber = 2 THEN l_shipdate - INTERVAL 1 DAY ELSE l_shipdate END AS updated_at"]),
    "customers": (rules.CUSTOMERS, "customer", [
        _OR_NULL.format(key="c_custkey", n=11, value="c_custkey", name="customer_id"), _OR_NULL.format(key="c_custkey", n=7, value="c_name", name="name"),
        "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a@b.co' WHEN 2 THEN 'a b@c.de' WHEN 3 THEN 'none' ELSE 'x@y' END AS email",
        "CASE WHEN c_custkey % 3 = 0 THEN DATE '1999-01-01' ELSE DATE '1997-01-01' END AS signup_date", "CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '1999-06-01 00:00:00' END AS updated_at"]),
    "products": (rules.PRODUCTS, "part", [
        _OR_NULL.format(key="p_partkey", n=11, value="p_partkey", name="product_id"), _OR_NULL.format(key="p_partkey", n=7, value="p_name", name="product_name"), "p_partkey % 9 - 1 AS price",
        "CASE p_partkey % 4 WHEN 0 THEN 'books' WHEN 1 THEN 'office' WHEN 2 THEN 'weapons' END AS category", _OR_NULL.format(key="p_partkey", n=5, value="p_name", name="sku")]),
    "clickstream": (rules.CLICKSTREAM, "events", [
        _OR_NULL.format(key="event_id", n=11, value="event_id", name="event_id"), _OR_NULL.format(key="user_id", n=7, value="user_id", name="session_id"), "CASE WHEN event_id % 5 = 0 THEN 'page_view' ELSE event_type END AS event_type",
        _OR_NULL.format(key="event_id", n=13, value="props", name="page_url"), "ts - CAST(event_id % 3 AS INT) * INTERVAL 10000 DAY AS event_ts", "CASE event_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'fridge' END AS device"]),
    "currency": (rules.CURRENCY, "orders", [
        "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS rate_date", "CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS base_currency", _OR_NULL.format(key="o_custkey", n=5, value="o_custkey", name="target_currency"),
        "o_custkey % 6 - 1 AS rate", "CASE o_orderkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'simulated' ELSE 'rumour' END AS _source"]),
    "wishlist": (rules.WISHLIST, "events", [
        _OR_NULL.format(key="event_id", n=11, value="event_id", name="wishlist_event_id"), _OR_NULL.format(key="user_id", n=7, value="user_id", name="customer_id"), _OR_NULL.format(key="event_id", n=13, value="user_id", name="product_id"),
        "ts - CAST(event_id % 3 AS INT) * INTERVAL 10000 DAY AS added_at", "CASE event_id % 3 WHEN 0 THEN '/cart' WHEN 1 THEN '/attic' END AS source"]),
}


def _sql_rules(name: str) -> str:
    conditions, source, columns = RULE_VIEWS[name]
    failed = [f"CASE WHEN NOT ({r.condition}) THEN '{r.name}' END" for r in rules.as_of(conditions, RULES_NOW)]
    reason = re.sub(r"(\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", f"concat_ws(',', {', '.join(failed)})").replace("\\\\", "\\")
    return f"SELECT reason, count(*) AS n FROM (SELECT {reason} AS reason FROM (SELECT {', '.join(columns)} FROM {source})) WHERE reason <> '' GROUP BY reason"


def _rule_query(name: str) -> None:
    @query(f"ruleset_{name}", _sql_rules(name))
    def ruleset(spark, sf):
        conditions, source, columns = RULE_VIEWS[name]
        return rules.breakdown(rules.split_quarantine(A.load(spark, sf, source).selectExpr(*columns), rules.as_of(conditions, RULES_NOW))[1])


for _name in RULE_VIEWS:
    _rule_query(_name)


@query("rules_per_rule", f"WITH {LINES}, bad AS (SELECT {SQL_REASON} AS r FROM lines) SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(r, ',')) AS reason FROM bad WHERE r <> '') GROUP BY reason")
def rules_per_rule(spark, sf):
    return rules.breakdown(rules.split_quarantine(A.order_lines(spark, sf), LINE_RULES)[1], per_rule=True)


@query("run_metrics", f"WITH {LINES}, j AS (SELECT {SQL_REASON} AS r FROM lines) SELECT count(*) AS n_input, count(*) FILTER (r = '') AS n_good, count(*) FILTER (r <> '') AS n_bad FROM j")
def run_metrics(spark, sf):
    judged, seen = rules.observed_split(A.order_lines(spark, sf), LINE_RULES)
    tables.append(judged.filter(F.col(rules.REASON) != ""), tables.work_path(spark, "quarantine"))
    return spark.createDataFrame([seen.get], "n_input long, n_good long, n_bad long")


# --- reads, appends, late data -------------------------------------------------------------------
@query("file_reads", "SELECT format, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY format")
def file_reads(spark, sf):
    orders, found = A.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), []
    for fmt in ("csv", "json", "parquet"):
        root = tables.work_path(spark, "raw")
        for part in (0, 1):
            path = tables.partition_path(root, "raw", "orders", date(2026, 5, 1 + part), part)
            writer = orders.filter(F.col("o_orderkey") % 2 == part).write.format(fmt)
            (writer.option("header", "true") if fmt == "csv" else writer).save(path)
        read = tables.read_files(spark, tables.layer_root(root, "raw", "orders"), fmt, orders.schema if fmt == "json" else None, merge=fmt == "parquet")
        found.append(tables.coerce(read, {"o_orderkey": "long"}).agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("append_lineage", "SELECT 'b' || CAST(event_id % 2 AS VARCHAR) AS _batch_id, event_type, '2026-05-01 00:00:00' AS _ingestion_timestamp, count(*) AS n FROM events GROUP BY ALL")
def append_lineage(spark, sf):
    events, path = A.load(spark, sf, "events").select("event_id", "event_type"), tables.work_path(spark, "bronze")
    for part in (0, 1):
        tables.append(tables.with_lineage(events.filter(F.col("event_id") % 2 == part), f"b{part}", None, datetime(2026, 5, 1, tzinfo=UTC)), path, ["_batch_id"])
    return spark.read.parquet(path).groupBy("_batch_id", "event_type", F.date_format("_ingestion_timestamp", STAMP).alias("_ingestion_timestamp")).agg(F.count("*").alias("n"))


@query("sessions_late", f"WITH {SESSIONS} SELECT event_id, cookie, CAST(seq AS BIGINT) AS session_seq, session_key FROM sess")
def sessions_late(spark, sf):
    """Sessions of the events that came in time, then those of cookies with late ones anew."""
    clicks = A.clicks(spark, sf)
    known = facts.sessionize(clicks.filter("event_id % 10 != 3"), "cookie", "event_ts", "event_id")
    late = clicks.filter("event_id % 10 = 3").select("cookie").distinct()
    touched = facts.sessionize(clicks.join(late, "cookie", "left_semi"), "cookie", "event_ts", "event_id")
    return facts.refresh_sessions(known, touched, "cookie").select("event_id", "cookie", "session_seq", "session_key")


@query("scd2_stage", f"""WITH {_dim('dim_customer', 'customer_id', 'customer_sk', 'priority', f"SELECT * FROM ({CUSTOMER_CHANGES}) WHERE updated_at < TIMESTAMP '{CUT}'")},
src AS (SELECT * FROM ({CUSTOMER_CHANGES}) WHERE updated_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC) = 1)
SELECT s.customer_id, CASE WHEN d.customer_id IS NULL THEN 'new' WHEN d.priority = s.priority THEN 'unchanged' ELSE 'changed' END AS action FROM src s LEFT JOIN dim_customer d ON d.customer_id = s.customer_id AND d.is_current""")
def scd2_stage(spark, sf):
    changes = A.customer_changes(spark, sf)
    before = H.history(changes.filter(F.col("updated_at") < F.lit(CUT).cast("timestamp")), "customer_id", ["priority"], [], "customer_sk")
    source = state.latest_by_max(changes.filter(F.col("updated_at") >= F.lit(CUT).cast("timestamp")), ["customer_id"], ["updated_at"])
    return H.stage_changes(before, source, "customer_id", ["priority"]).select("customer_id", "action")


@query("scd2_at", f"WITH {CUSTOMER} SELECT customer_sk, customer_id, priority FROM dim_customer WHERE customer_id = 1 AND effective_from <= TIMESTAMP '{CUT}' AND effective_to > TIMESTAMP '{CUT}'")
def scd2_at(spark, sf):
    return H.at(A.customer_dim(spark, sf), "customer_id", 1, datetime(1997, 1, 1, tzinfo=UTC)).select("customer_sk", "customer_id", "priority")


@query("currency_api", f"WITH {RATES} SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, target_currency FROM rates WHERE source = 'api'")
def currency_api(spark, sf):
    return gates.api_only(A.rates(spark, sf)).select(F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "target_currency")


@query("usage_trailing", """WITH e AS (SELECT max(ts) AS m FROM events) SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM events, e WHERE ts > m - INTERVAL 7 DAY GROUP BY 1""")
def usage_trailing(spark, sf):
    events = A.load(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    end = F.broadcast(events.agg(F.max("ts").alias("_end")))
    return gates.trailing_usage(events.crossJoin(end), [F.col("event_type")], "value", "ts", F.col("_end"), 7).withColumn("total", F.col("total").cast("double"))


@query("stream_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf):
    events = A.load(spark, sf, "events").select("event_id", "event_type", "ts")
    raw, out, checkpoint = (tables.work_path(spark, n) for n in ("raw", "events", "checkpoint"))
    events.unionByName(events.filter("event_id % 3 = 0")).write.parquet(raw)  # a third comes twice
    found = pipelines.drop_replays(pipelines.open_stream(spark, raw, events.schema, "parquet"), "event_id", "ts")
    found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_enrich_merge", f"""WITH {CUSTOMER}, f AS (SELECT o_custkey AS customer_id, o_orderkey, o_orderdate AS at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT f.customer_id, f.o_orderkey, d.customer_sk FROM f LEFT JOIN dim_customer d ON d.customer_id = f.customer_id AND f.at >= d.effective_from AND f.at < d.effective_to""")
def stream_enrich_merge(spark, sf):
    """A change feed, joined as of its time to the dimension, merged; the second half comes in
    by another checkpoint."""
    feed = A.load(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey", F.col("o_orderdate").alias("at"))
    dim, table = A.customer_dim(spark, sf), tables.work_path(spark, "state")
    enrich = lambda batch: H.as_of_join(batch, dim, "customer_id", "customer_sk", "at")
    for part in (0, 1):
        raw, checkpoint = tables.work_path(spark, "raw"), tables.work_path(spark, "checkpoint")
        feed.filter(F.col("o_orderkey") % 2 == part).write.parquet(raw)
        pipelines.run_merge(pipelines.open_stream(spark, raw, feed.schema, "parquet"), table, checkpoint, ["customer_id"], ["at", "o_orderkey"], enrich, parts=8)
    return partitioned.read_parts(spark, table).select("customer_id", "o_orderkey", "customer_sk")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, deduplication, history, as-of join and daily revenue in one plan."""
    return daily_revenue(spark, sf_dir)


