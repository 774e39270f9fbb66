"""Queries on what keeps tables in order: layouts, schema versions, loads, merges of parts, their
figures, manifests and the skew-safe joins and sessions; each with its SQL, as in catalog."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions.keys import STAMP, batch_time
from ..operators import audit, clustering, facts, gates, rules, state
from ..operators import history as H
from ..sources import loads, partitioned, schemas, tables
from ..streaming import pipelines
from . import adapters as A
from .catalog import CUSTOMER, CUSTOMER_CHANGES, CUT, LINE_RULES, LINES, ORACLES, RATES, SESSIONS, SQL_REASON, SQL_SIDES, _dim, _merge_sides, query, text_time


# --- layouts --------------------------------------------------------------------------------
@query("zorder_depth", """SELECT m AS method, c AS column_name, 16 AS n_files, m = 'zorder' OR c = 'o_orderdate' AS clustered, (SELECT count(*) FROM orders) AS n_rows
FROM (VALUES ('range'), ('zorder')) a(m), (VALUES ('o_orderdate'), ('o_custkey')) b(c)""")
def zorder_depth(spark, sf):
    """Orders as 16 files by a range sort and by a Z-order of two columns: in a sort the second
    column's values lie in nearly all files, in a Z-order in half of them or fewer."""
    orders, found = A.load(spark, sf, "orders"), []
    for method in ("range", "zorder"):
        table = tables.work_path(spark, method)
        tables.publish(orders.repartition(16, "o_orderkey"), table)
        clustering.rewrite(spark, table, clustering.Clustering(("o_orderdate", "o_custkey"), method, 16))
        now = tables.read_snapshot(spark, table)
        for column in ("o_orderdate", "o_custkey"):
            depth = clustering.depth(clustering.file_ranges(now, column))
            found.append(depth.crossJoin(now.agg(F.count("*").alias("n_rows"))).select(F.lit(method).alias("method"), F.lit(column).alias("column_name"), F.col("n_files").cast("int").alias("n_files"), (F.col("avg_depth") <= F.col("n_files") / 2).alias("clustered"), "n_rows"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


FILE_OF = "o_custkey % 5 * 10 + extract(year FROM o_orderdate) - 1992"


@query("depth_report", f"""WITH o AS (SELECT {FILE_OF} AS f, o_orderdate, o_orderkey FROM orders), r AS (SELECT 'o_orderdate' AS column_name, f, epoch(min(o_orderdate)) AS lo, epoch(max(o_orderdate)) AS hi FROM o GROUP BY f UNION ALL SELECT 'o_orderkey', f, min(o_orderkey), max(o_orderkey) FROM o GROUP BY f),
d AS (SELECT a.column_name, a.f, count(*) AS depth FROM r a JOIN r b ON a.column_name = b.column_name AND b.lo <= a.lo AND b.hi >= a.lo GROUP BY ALL)
SELECT column_name, count(*) AS n_files, round(avg(depth), 4) AS avg_depth, max(depth) AS max_depth, avg(depth) > 4 AS needs_rewrite FROM d GROUP BY column_name""")
def depth_report(spark, sf):
    """Files with known ranges: by a scan of one column, and of another by the footers alone."""
    path = tables.work_path(spark, "files")
    orders = A.load(spark, sf, "orders").withColumn("f", (F.col("o_custkey") % 5 * 10 + F.year("o_orderdate") - 1992).cast("int"))
    orders.repartition("f").write.partitionBy("f").parquet(path)
    files = spark.read.parquet(path)
    parts = [clustering.depth(ranges).withColumn("column_name", F.lit(c)) for c, ranges in (("o_orderdate", clustering.file_ranges(files, "o_orderdate")), ("o_orderkey", clustering.footer_ranges(files, "o_orderkey")))]
    return parts[0].unionByName(parts[1])


@query("compacted", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def compacted(spark, sf):
    table = tables.work_path(spark, "compacted")
    tables.publish(A.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(16), table)
    clustering.rewrite(spark, table, clustering.Clustering(("o_custkey", "o_orderstatus"), files=4))
    return tables.read_snapshot(spark, table)


@query("layout_choice", f"""WITH {CUSTOMER}, w AS (SELECT event_id FROM events WHERE event_type = 'click')
SELECT 'dim_customer' AS table_name, 'range by customer_id' AS layout, (SELECT count(*) FROM dim_customer) AS n_rows, (SELECT count(*) FROM dim_customer) AS n_before UNION ALL SELECT 'fact_customer_wishlist_product', 'zorder by customer_sk,product_sk', (SELECT count(*) FROM w), (SELECT count(*) FROM w)""")
def layout_choice(spark, sf):
    """Each served table rewritten in the layout that is fixed for it, which its log tells."""
    dim = A.customer_dim(spark, sf)
    served = {"dim_customer": dim, "fact_customer_wishlist_product": facts.wishlist_fact(A.wishes(spark, sf), dim, A.product_dim(spark, sf))}
    found = []
    for name, df in served.items():
        table = tables.work_path(spark, name)
        tables.publish(df, table)
        clustering.rewrite(spark, table, clustering.layout(name, 4))
        told = tables.published(spark, table).agg(F.max_by("source", "version").alias("layout"))
        counts = [tables.read_snapshot(spark, table, version=v).agg(F.count("*").alias(c)) for v, c in ((2, "n_rows"), (1, "n_before"))]
        found.append(told.crossJoin(counts[0]).crossJoin(counts[1]).withColumn("table_name", F.lit(name)))
    return found[0].unionByName(found[1])


@query("vacuumed", """SELECT 'snapshots' AS what, 2 AS n_removed, 1 AS n_versions, count(*) AS n_rows FROM orders UNION ALL SELECT 'parts', 1, 2, count(DISTINCT o_custkey) FROM orders""")
def vacuumed(spark, sf):
    """Folders of replaced versions go, once they are old enough; the current rows stay. Of a table
    in parts a folder goes when all its parts have been replaced."""
    orders, whole, parted = A.load(spark, sf, "orders"), tables.work_path(spark, "whole"), tables.work_path(spark, "parted")
    for n in (3, 2, 1):
        tables.publish(orders.filter(f"o_orderkey % {n} = 0"), whole)
    latest = state.latest_by_max(orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    later = lambda days: latest.withColumn("o_orderdate", F.timestamp_add("DAY", F.lit(days), F.col("o_orderdate")))
    partitioned.merge_parts(spark, parted, latest, ["o_custkey"], ["o_orderdate"], parts=4)
    partitioned.merge_parts(spark, parted, later(1), ["o_custkey"], ["o_orderdate"], parts=4)
    partitioned.merge_parts(spark, parted, later(2).filter(partitioned.part_of(["o_custkey"], 4) == 1), ["o_custkey"], ["o_orderdate"], parts=4)
    assert tables.vacuum(spark, whole) == [] and partitioned.vacuum(spark, parted) == []  # a week has not passed
    gone = len(tables.vacuum(spark, whole, hours=0)), len(partitioned.vacuum(spark, parted, hours=0))
    counts = lambda what, n, versions, rows: versions.agg(F.lit(what).alias("what"), F.lit(n).alias("n_removed"), F.count_distinct("version").cast("int").alias("n_versions")).crossJoin(rows.agg(F.count("*").alias("n_rows")))
    return counts("snapshots", gone[0], tables.published(spark, whole), tables.read_snapshot(spark, whole)).unionByName(counts("parts", gone[1], partitioned.log(spark, parted), partitioned.read_parts(spark, parted)))


# --- schemas, loads, tables --------------------------------------------------------------------
EVENT_RUNS = "SELECT *, CAST(event_id % 3 AS INT) AS run FROM events"


@query("schema_store", f"""SELECT run, count(*) AS n, count(value) FILTER (run > 0) AS n_value, count(user_id) FILTER (run < 2) AS n_user, 'value added in version 2; user_id type_differs in version 3' AS log FROM ({EVENT_RUNS}) GROUP BY run""")
def schema_store(spark, sf):
    """Three runs of a stream over JSON files: the second brings a column, the third another type
    of a known one. Old rows are null in the column, values of the other type too."""
    events = A.load(spark, sf, "events").withColumn("run", (F.col("event_id") % 3).cast("int"))
    root = tables.work_path(spark, "lake")
    raw, bronze, checkpoint, store = f"{root}/raw", tables.layer_root(root, "bronze", "events"), tables.checkpoint_path(root, "bronze", "events"), f"{root}/_schemas"
    for run, columns in enumerate((["event_id", "user_id", "run"], ["event_id", "user_id", "run", "value"], ["event_id", F.concat(F.lit("u"), "user_id").alias("user_id"), "run", "value"])):
        events.filter(F.col("run") == run).select(*columns).coalesce(2).write.json(f"{raw}/run{run}")
        pipelines.ingest_evolving(spark, raw, bronze, checkpoint, store, "json", f"b{run}")
    told = schemas.changes(spark, store).filter("version > 1").orderBy("version", "column")
    log = "; ".join(f"{r['column']} {r['change']} in version {r['version']}" for r in told.collect())  # a row for each change
    rows = pipelines.read_evolved(spark, bronze).withColumn("run", F.col("run").cast("int"))
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.count("user_id").alias("n_user"), F.lit(log).alias("log"))


@query("load_ledger", """WITH e AS (SELECT *, CAST(event_id % 4 AS INT) AS file FROM events)
SELECT 'f' || CAST(file AS VARCHAR) AS file, CASE WHEN file < 2 THEN 'b1' ELSE 'b2' END AS batch_id, count(*) FILTER (file <> 3 OR event_id % 7 <> 0) AS n_loaded, count(*) FILTER (file = 3 AND event_id % 7 = 0) AS n_rejected, CAST(sum(event_id) FILTER (file <> 3 OR event_id % 7 <> 0) AS BIGINT) AS keys FROM e GROUP BY file""")
def load_ledger(spark, sf):
    """Two loads of a folder: the second meets the files of the first again and takes the new ones;
    one has cells that are no numbers. A third load that must abort leaves no trace."""
    events = A.load(spark, sf, "events").withColumn("file", (F.col("event_id") % 4).cast("int"))
    key = F.when((F.col("file") == 3) & (F.col("event_id") % 7 == 0), "broken").otherwise(F.col("event_id").cast("string")).alias("event_id")
    raw, table, strict = (tables.work_path(spark, n) for n in ("raw", "loaded", "strict"))
    types = {"event_id": "long", "value": "double"}
    for batch, files in (("b1", (0, 1)), ("b2", (2, 3))):
        for n in files:
            events.filter(F.col("file") == n).select(key, "value").coalesce(1).write.option("header", "true").csv(f"{raw}/f{n}")
        loads.load(spark, table, raw, types, batch)
    loads.load(spark, table, raw, types, "b3")  # nothing new
    try:
        loads.load(spark, strict, raw, types, "b1", on_error="abort")
    except loads.LoadAborted:
        assert loads.ledger(spark, strict).isEmpty()
    file = F.regexp_extract("path", "/(f[0-9])/", 1).alias("file")
    keys = loads.loaded(spark, table).groupBy(F.regexp_extract(loads.FILE, "/(f[0-9])/", 1).alias("file")).agg(F.sum("event_id").alias("keys"))
    return loads.ledger(spark, table).select(file, "batch_id", "n_loaded", "n_rejected").filter("n_loaded + n_rejected > 0").join(keys, "file")


@query("reference_copy", f"WITH {RATES} SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, target_currency, CAST(rate AS DOUBLE) AS rate, source FROM rates")
def reference_copy(spark, sf):
    silver, gold = tables.work_path(spark, "silver"), tables.work_path(spark, "gold")
    for rates in (A.rates(spark, sf).drop("source"), A.rates(spark, sf)):  # the second has a column more
        tables.publish(rates, silver)
        tables.copy_table(spark, silver, gold)
    return tables.read_snapshot(spark, gold).select(F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "target_currency", F.col("rate").cast("double").alias("rate"), "source")


@query("dimension_created", """SELECT * FROM (VALUES ('customer_sk', 'string', FALSE), ('o_custkey', 'bigint', FALSE), ('o_orderpriority', 'string', TRUE), ('effective_from', 'timestamp', FALSE), ('effective_to', 'timestamp', FALSE), ('is_current', 'boolean', FALSE)) t(column_name, type, nullable),
  (SELECT count(*) AS n_later FROM orders), (SELECT 0 AS n_first)""")
def dimension_created(spark, sf):
    """The schema of a dimension; a table is made of it where there is none, and left as it is else."""
    orders = A.load(spark, sf, "orders")
    schema, table = H.dimension_schema(orders.schema, "o_custkey", ["o_orderpriority"], "customer_sk"), tables.work_path(spark, "dim")
    tables.create_if_missing(spark, table, schema)
    first = tables.read_snapshot(spark, table).count()
    filled = orders.select(F.col("o_orderkey").cast("string").alias("customer_sk"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("effective_from"), F.col("o_orderdate").alias("effective_to"), F.lit(True).alias("is_current"))
    tables.publish(tables.read_snapshot(spark, table).unionByName(filled), table)
    tables.create_if_missing(spark, table, schema)
    fields = spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in schema], "column_name string, type string, nullable boolean")
    return fields.crossJoin(tables.read_snapshot(spark, table).agg(F.count("*").alias("n_later"))).withColumn("n_first", F.lit(first))


@query("batch_times", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS loaded_at, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def batch_times(spark, sf):
    """Times read back from batch ids; a malformed one has none."""
    second = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    made = F.when(F.col("event_id") % 5 == 0, second).otherwise(F.concat(second, F.lit("Z-"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8)))
    batches = A.load(spark, sf, "events").select(made.alias("batch_id")).withColumn("at", batch_time("batch_id"))
    return batches.filter("at is not null").groupBy(F.date_format("at", STAMP).alias("loaded_at")).agg(F.count("*").alias("n"))


@query("empty_quarantine", "SELECT o_orderstatus, count(*) AS n_good, 0 AS n_bad FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'no rows', 0, 0")
def empty_quarantine(spark, sf):
    """Without rules all rows are good and the quarantine is an empty frame with its reason; a frame
    without rows goes through rules as well."""
    orders = A.load(spark, sf, "orders").select("o_orderstatus")
    good, bad = rules.split_quarantine(orders, [])
    nothing = rules.split_quarantine(tables.empty(spark, orders.schema), [rules.Rule("known", "o_orderstatus IS NOT NULL")])
    counts = good.select("o_orderstatus", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select("o_orderstatus", F.lit(0).alias("g"), F.lit(1).alias("b")))
    found = counts.groupBy("o_orderstatus").agg(F.sum("g").alias("n_good"), F.sum("b").cast("int").alias("n_bad"))
    none = nothing[0].agg(F.lit("no rows").alias("o_orderstatus"), F.count("*").alias("n_good")).crossJoin(nothing[1].filter(F.col(rules.REASON) != "").agg(F.count("*").cast("int").alias("n_bad")))
    return found.unionByName(none)


@query("quarantine_append", """SELECT CASE WHEN o_totalprice > 200000 THEN 'too_dear' ELSE 'not_open' END AS reason, count(*) AS n, count(*) FILTER (o_totalprice <= 200000) AS n_priority, CASE WHEN o_totalprice > 200000 THEN 'b1' ELSE 'b2' END AS batch
FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'O' GROUP BY ALL""")
def quarantine_append(spark, sf):
    """Two batches of quarantined rows in one place; the second has a column more, which is null in
    the first."""
    orders, path = A.load(spark, sf, "orders"), tables.work_path(spark, "quarantine")
    dear, rest = orders.filter("o_totalprice > 200000"), orders.filter("o_totalprice <= 200000")
    for batch, df, rule in (("b1", dear.drop("o_orderpriority"), rules.Rule("too_dear", "o_totalprice <= 200000")), ("b2", rest, rules.Rule("not_open", "o_orderstatus = 'O'"))):
        bad = rules.split_quarantine(df, [rule])[1]
        tables.append(tables.with_lineage(bad, batch, None), path, ["_batch_id"])
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found.groupBy(F.col(rules.REASON).alias("reason"), F.col("_batch_id").alias("batch")).agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority"))


@query("mart_refresh", ORACLES["daily_revenue"])
def mart_refresh(spark, sf):
    """The mart without its last year, whose days are then computed and put in anew."""
    fact = facts.order_fact(A.dedup(A.good_lines(spark, sf)), None, A.product_dim(spark, sf))
    late = F.year("created_at") >= 1996
    stale = facts.daily_revenue(fact.withColumn("total_amount", F.when(late, 0).otherwise(F.col("total_amount")).cast("decimal(18,2)")))
    mart = facts.refresh_days(stale, facts.daily_revenue(fact.filter(late)))
    euros = lambda c: F.col(c).cast("double").alias(c)
    return mart.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "category", "order_count", euros("revenue"), F.round(F.col("revenue").cast("double") / F.col("order_count"), 4).alias("avg_order"), euros("cancelled_revenue"), "cancelled_count")


# --- hot keys ------------------------------------------------------------------------------------
@query("pit_product_buckets", ORACLES["pit_product"])
def pit_product_buckets(spark, sf):
    found = H.as_of_buckets(A.order_lines(spark, sf), A.product_dim(spark, sf), "product_id", "product_sk", extra=["category"], bucket="month", told_by=["order_id", "l_suppkey"])
    return found.select("order_id", "l_suppkey", text_time("created_at"), "product_sk", "category")


HOT = "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN -1 ELSE user_id END"


@query("sessions_hot", f"WITH {SESSIONS.replace('user_id AS cookie', f'{HOT} AS cookie')} SELECT event_id, cookie, CAST(seq AS BIGINT) AS session_seq, session_key FROM sess")
def sessions_hot(spark, sf):
    """A third of the events have one cookie, and a third none."""
    third = F.col("event_id") % 3
    clicks = A.clicks(spark, sf).withColumn("cookie", F.when(third == 1, -1).when(third == 2, F.col("cookie")))
    return facts.sessionize_in_parts(clicks, "cookie", "event_ts", "event_id").select("event_id", "cookie", "session_seq", "session_key")


# --- merges and their figures ----------------------------------------------------------------------
@query("stream_merge_partitioned", ORACLES["stream_merge"])
def stream_merge_partitioned(spark, sf):
    events = A.load(spark, sf, "events").select("user_id", "ts", "event_id")
    raw, table, checkpoint = (tables.work_path(spark, n) for n in ("raw", "state", "checkpoint"))
    events.repartition(3, "event_id").write.parquet(raw)
    pipelines.run_merge(pipelines.open_stream(spark, raw, events.schema, "parquet", 1), table, checkpoint, ["user_id"], ["ts", "event_id"], parts=8)
    return partitioned.read_parts(spark, table).select("user_id", text_time("ts"), "event_id")


@query("merge_metrics", f"""WITH {SQL_SIDES}, j AS (SELECT t.order_id AS old, s.order_id AS new, s.updated_at > t.updated_at AS newer FROM t FULL JOIN s ON t.order_id = s.order_id)
SELECT count(*) FILTER (old IS NULL) AS n_inserted, count(*) FILTER (newer) AS n_updated, count(*) FILTER (NOT newer) AS n_ignored, count(*) FILTER (new IS NULL) AS n_kept, count(*) AS n_rows FROM j""")
def merge_metrics(spark, sf):
    """Figures of a merge, taken by the pass that publishes its result."""
    merged, seen = state.observed_merge(*_merge_sides(spark, sf), ["order_id"])
    table = tables.work_path(spark, "state")
    tables.publish(merged, table)
    counts = spark.createDataFrame([seen.get], "n_inserted long, n_updated long, n_ignored long, n_kept long")
    return counts.crossJoin(tables.read_snapshot(spark, table).agg(F.count("*").alias("n_rows")))


SQL_BEFORE = _dim("dim_customer", "customer_id", "customer_sk", "priority", f"SELECT * FROM ({CUSTOMER_CHANGES}) WHERE updated_at < TIMESTAMP '{CUT}'")


@query("snapshot_metrics", f"""WITH {SQL_BEFORE}, src AS (SELECT * REPLACE (CASE WHEN customer_id % 4 = 0 THEN TIMESTAMP '1990-01-01' ELSE updated_at END AS updated_at) FROM ({CUSTOMER_CHANGES}) WHERE updated_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC) = 1),
j AS (SELECT CASE WHEN d.customer_id IS NULL THEN 'new' WHEN s.updated_at <= d.effective_from THEN 'ignored' WHEN s.priority = d.priority THEN 'unchanged' ELSE 'changed' END AS fate FROM src s LEFT JOIN dim_customer d ON d.customer_id = s.customer_id AND d.is_current)
SELECT count(*) FILTER (fate = 'new') AS n_new, count(*) FILTER (fate = 'changed') AS n_changed, count(*) FILTER (fate = 'unchanged') AS n_unchanged, count(*) FILTER (fate = 'ignored') AS n_ignored FROM j""")
def snapshot_metrics(spark, sf):
    """A quarter of the customers come with an old time and are ignored."""
    changes = A.customer_changes(spark, sf)
    before = H.history(changes.filter(F.col("updated_at") < F.lit(CUT).cast("timestamp")), "customer_id", ["priority"], [], "customer_sk")
    source = state.latest_by_max(changes.filter(F.col("updated_at") >= F.lit(CUT).cast("timestamp")), ["customer_id"], ["updated_at"])
    source = source.withColumn("updated_at", F.when(F.col("customer_id") % 4 == 0, F.lit("1990-01-01").cast("timestamp")).otherwise(F.col("updated_at")))
    after, seen = H.observed_snapshot(before, source, "customer_id", ["priority"], [], "customer_sk")
    tables.publish(after, tables.work_path(spark, "dim"))
    return spark.createDataFrame([seen.get], "n_new long, n_changed long, n_unchanged long, n_ignored long")


# --- operations --------------------------------------------------------------------------------------
@query("runs_by_state", "SELECT user_id % 5 AS pipeline, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'unknown' ELSE 'success' END AS state, count(*) AS n FROM events GROUP BY ALL")
def runs_by_state(spark, sf):
    runs = A.runs(spark, sf).withColumn("state", F.when(F.col("event_type") != "signup", F.col("state")))
    return gates.runs_by_state(runs)


@query("audit_manifest", """SELECT '2026-05-0' || CAST(d AS VARCHAR) AS run_date, source, status, CAST(n AS BIGINT) AS n_files, CASE source WHEN 'clickstream' THEN (SELECT count(*) FROM events) WHEN 'currency_rates' THEN (SELECT count(*) FROM nation) END AS n_rows
FROM (VALUES (1, 'clickstream', 'validated', 3), (2, 'clickstream', 'validated', 3), (2, 'currency_rates', 'quarantine', 1), (2, 'unknown', 'quarantine', 1)) t(d, source, status, n)""")
def audit_manifest(spark, sf):
    """The audit of two days, appended to the manifest by the date of the run."""
    raw, root = tables.work_path(spark, "raw"), tables.work_path(spark, "processed")
    clicks = A.clicks(spark, sf).select("event_id", F.col("cookie").alias("session_id"), "customer_id", "event_type", "page_url", "event_ts", "device", F.lit("agent").alias("user_agent"))
    clicks.repartition(3).write.option("ignoreNullFields", "false").json(f"{raw}/clickstream/day=1")
    path = audit.append_manifest(audit.audit_files(spark, raw), root, datetime(2026, 5, 1, 4, tzinfo=UTC))
    A.load(spark, sf, "nation").coalesce(1).write.option("header", "true").csv(f"{raw}/currency_rates/day=1")
    A.load(spark, sf, "region").coalesce(1).write.parquet(f"{raw}/region")
    audit.append_manifest(audit.audit_files(spark, raw), root, datetime(2026, 5, 2, 4, tzinfo=UTC))
    manifest = audit.read_manifest(spark, path)
    rows = manifest.groupBy("run_date", "source").agg(F.sum("n_rows").alias("n_rows"))
    return audit.outcomes(manifest, "run_date").join(rows, ["run_date", "source"]).withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))


@query("disposition_files", f"""WITH {LINES}, j AS (SELECT *, CAST(customer_id % 4 AS INT) AS file, {SQL_REASON} AS r FROM lines), q AS (SELECT * FROM j WHERE r <> '')
SELECT 'waiting' AS part, file, order_id, l_suppkey, quantity FROM q WHERE file IN (2, 3) UNION ALL SELECT 'released', file, order_id, l_suppkey, 1 FROM q WHERE file = 1 UNION ALL SELECT 'still_bad', file, order_id, l_suppkey, quantity FROM q WHERE file = 0""")
def disposition_files(spark, sf):
    """Quarantined files: one is replayed as it is, one has a repaired form in its _fixed folder,
    one waits for it, and one has no decision."""
    raw = tables.work_path(spark, "quarantine")
    bad = rules.split_quarantine(A.order_lines(spark, sf), LINE_RULES)[1].withColumn("file", (F.col("customer_id") % 4).cast("int"))
    fixed = bad.filter("file = 1").drop(rules.REASON).withColumn("quantity", F.lit(1)).withColumn("updated_at", F.col("created_at"))
    name = F.concat(F.lit(f"{raw}/orders/f"), F.col("file"), F.lit(".parquet"))
    quarantine = tables.with_lineage(bad, "b1", name)
    repaired = tables.with_lineage(fixed, "b2", rules.repaired_path(name))
    decisions = spark.createDataFrame([(f"{raw}/orders/f{n}.parquet", action, "op") for n, action in ((0, "replay"), (1, "fix"), (2, "fix"))], "_source_file string, action string, operator string")
    parts = rules.dispose_files(quarantine, decisions, repaired, LINE_RULES)
    rows = [parts[n].select(F.lit(n).alias("part"), "file", "order_id", "l_suppkey", "quantity") for n in ("waiting", "released", "still_bad")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

