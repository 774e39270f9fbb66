"""Semantics that queries over the supplied tables do not reach."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lakestrata.functions.keys import batch_time, make_batch_id, parse_batch_id
from lakestrata.operators import audit, clustering, facts, gates, history, rules, state
from lakestrata.sources import tables
from lakestrata.streaming import pipelines


def ts(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_batch_ids():
    made = make_batch_id(datetime(2026, 5, 1, 2, 3, 4))
    assert made.startswith("20260501T020304Z-") and parse_batch_id(made)[0] == datetime(2026, 5, 1, 2, 3, 4, tzinfo=UTC)
    with pytest.raises(ValueError):
        parse_batch_id("20260501-xyz")


def test_split(spark):
    df = spark.sql("SELECT * FROM VALUES ('o1','c','p',1,2.0,'placed'), ('o2','c','p',1,2.0,'WAT'), ('o3','c','p',0,2.0,'paid'), ('o4',NULL,'p',1,-5.0,'paid') t(order_id,customer_id,product_id,quantity,price,status)").withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "updated_at": F.lit("2020-01-02").cast("timestamp")})
    good, bad = rules.split_quarantine(df, rules.ORDERS)
    assert good.count() == 1
    assert {r["order_id"]: r[rules.REASON] for r in bad.collect()} == {"o2": "status_known", "o3": "quantity_positive", "o4": "customer_id_not_null,price_positive"}
    for sets in (rules.CUSTOMERS, rules.PRODUCTS, rules.CLICKSTREAM, rules.CURRENCY, rules.WISHLIST):
        assert len(sets) in (5, 6)
    good, bad = rules.split_quarantine(df, [])
    assert good.count() == 4 and bad.count() == 0 and rules.REASON in bad.columns


def test_email_rule(spark):
    df = spark.sql("SELECT 'c' AS customer_id, 'n' AS name, e AS email, DATE '2020-01-01' AS signup_date, TIMESTAMP '2021-01-01' AS updated_at FROM VALUES ('a@b.co'), ('a b@c.d'), ('nope'), (NULL) t(e)")
    assert sorted(str(r["email"]) for r in rules.split_quarantine(df, rules.CUSTOMERS)[0].collect()) == ["None", "a@b.co"]


def test_watermark(spark):
    df = ts(spark.sql("SELECT * FROM VALUES ('2026-05-01'), ('2026-05-10'), ('2026-05-20'), (NULL) t(at)"), "at")
    assert [str(r["at"])[:10] for r in state.watermark(df, "at", 5).collect()] == ["2026-05-20"]
    assert state.watermark(df, "at", 0).count() == 4 and state.watermark(df.limit(0), "at", 5).count() == 0


def test_merge_newer(spark):
    t = ts(spark.sql("SELECT * FROM VALUES ('a','old','2026-01-01'), ('b','same','2026-01-01'), ('c','none',NULL), ('d','kept','2026-01-09') t(id,v,updated_at)"), "updated_at")
    s = ts(spark.sql("SELECT * FROM VALUES ('a','new','2026-01-02'), ('b','x','2026-01-01'), ('c','x','2026-01-02'), ('d','x','2026-01-01'), ('e','in','2026-01-01') t(id,v,updated_at)"), "updated_at")
    assert {r["id"]: r["v"] for r in state.merge_newer(t, s, ["id"]).collect()} == {"a": "new", "b": "same", "c": "none", "d": "kept", "e": "in"}


def test_snapshot_merge(spark):
    one = ts(spark.sql("SELECT 'c1' AS id, 'x' AS email, 'n' AS name, '2026-01-01' AS updated_at"), "updated_at")
    empty = history.merge_snapshot(spark.createDataFrame([], history.dimension_schema(one.schema, "id", ["email", "name"], "sk")), one, "id", ["email"], ["name"], "sk")
    assert empty.count() == 1
    again = history.merge_snapshot(empty, one.withColumn("name", F.lit("other")), "id", ["email"], ["name"], "sk")
    assert [r["name"] for r in again.collect()] == ["n"]
    later = ts(spark.sql("SELECT 'c1' AS id, CAST(NULL AS STRING) AS email, 'n' AS name, '2026-05-01' AS updated_at"), "updated_at")
    two = history.merge_snapshot(again, later, "id", ["email"], ["name"], "sk")
    rows = two.orderBy("effective_from").collect()
    assert len(rows) == 2 and rows[0]["effective_to"] == rows[1]["effective_from"] and [r["is_current"] for r in rows] == [False, True]
    same = ts(spark.sql("SELECT 'c1' AS id, CAST(NULL AS STRING) AS email, 'n' AS name, '2026-06-01' AS updated_at"), "updated_at")
    assert history.merge_snapshot(two, same, "id", ["email"], ["name"], "sk").count() == 2
    assert history.overlaps(two, "id", "sk").count() == 0


def test_session_boundary(spark):
    df = ts(spark.sql("SELECT * FROM VALUES (1,'a','2026-01-01 10:00:00'), (2,'a','2026-01-01 10:30:00'), (3,'a','2026-01-01 11:00:01'), (4,'b','2026-01-01 10:00:00') t(event_id,cookie,at)"), "at")
    assert {r["event_id"]: r["session_seq"] for r in facts.sessionize(df, "cookie", "at", "event_id").collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_as_of_forms_agree(spark):
    dim = ts(spark.sql("SELECT * FROM VALUES ('k','s1','2026-01-01','2026-06-01'), ('k','s2','2026-06-01','9999-12-31') t(id,sk,effective_from,effective_to)"), "effective_from", "effective_to")
    fact = ts(spark.sql("SELECT * FROM VALUES (1,'k','2025-12-31'), (2,'k','2026-03-15'), (3,'k','2026-06-01'), (4,'z','2026-06-01'), (5,NULL,'2026-06-01') t(n,id,created_at)"), "created_at")
    want = {1: None, 2: "s1", 3: "s2", 4: None, 5: None}
    for join in (history.as_of_join, history.as_of_union):
        assert {r["n"]: r["sk"] for r in join(fact, dim, "id", "sk").collect()} == want


def test_gates(spark):
    df = spark.sql("SELECT * FROM VALUES ('a','b'), (NULL,'b'), ('a',NULL), (NULL,NULL) t(x,y)")
    assert gates.orphan_rate(df, ["x", "y"]).first()["orphan_pct"] == 75.0
    assert gates.orphan_rate(df.limit(0), ["x"]).first()["passed"]
    with pytest.raises(gates.GateFailed):
        gates.require(gates.orphan_rate(df, ["x"]))
    assert gates.row_count_drop(df.limit(0), df).first()["passed"]


def test_streams_share_a_table(spark):
    """Batches of two checkpoints merge with the latest state; a batch that runs again does not."""
    table, raw, schema = tables.work_path(spark, "t"), tables.work_path(spark, "r"), "id long, at timestamp, v string"
    rows = ts(spark.sql("SELECT * FROM VALUES (1L,'2026-01-01','a'), (2L,'2026-01-02','b') t(id,at,v)"), "at")
    rows.write.parquet(f"{raw}/one")
    ts(spark.sql("SELECT 3L AS id, '2026-01-03' AS at, 'c' AS v"), "at").write.parquet(f"{raw}/two")
    schema = spark.read.parquet(f"{raw}/one").schema
    for part in ("one", "two", "one"):  # the third finds nothing new under its checkpoint
        pipelines.run_merge(pipelines.open_stream(spark, f"{raw}/{part}", schema, "parquet"), table, f"{raw}/checkpoint-{part}", ["id"], ["at"])
    assert sorted(r["id"] for r in tables.read_snapshot(spark, table).collect()) == [1, 2, 3]
    log = tables.published(spark, table).orderBy("version").collect()
    assert [r["version"] for r in log] == [1, 2] and len({r["source"].split("/")[0] for r in log}) == 2 and "None" not in log[0]["source"]
    assert sorted(r["id"] for r in tables.read_snapshot(spark, table, as_of=log[0]["published"]).collect()) == [1, 2]
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, table, version=9)


def test_tables(spark):
    table, schema = tables.work_path(spark, "t"), spark.range(1).schema
    assert not clustering.rewrite(spark, table, clustering.Clustering(("id",)))
    assert tables.create_if_missing(spark, table, schema) and not tables.create_if_missing(spark, table, schema)
    assert tables.read_snapshot(spark, table).count() == 0
    tables.publish(spark.range(5), table, 7)
    old = tables.read_snapshot(spark, table)
    tables.publish(spark.range(9), table, 7)  # readers of the version before keep their files
    assert old.count() == 5 and tables.read_snapshot(spark, table, version=7).count() == 9
    assert spark.sql("SELECT '20260501T020304Z-0a1b2c3d' AS b UNION ALL SELECT 'x'").select(batch_time("b").alias("t")).filter("t IS NOT NULL").count() == 1
    assert [r["g"] for r in spark.range(3).select(gates.gauge(F.col("id") * 15).alias("g")).orderBy("id").collect()] == ["good", "warning", "bad"]


def test_load_modes(spark):
    df = spark.sql("SELECT * FROM VALUES ('1'), ('x'), (NULL) t(n)")
    assert tables.load_projection(df, {"n": "int"}, "b").count() == 2
    with pytest.raises(Exception):
        tables.load_projection(df, {"n": "int"}, "b", "abort").collect()


def test_file_audit(spark, tmp_path):
    """Each outcome in turn; quoted line breaks, blank lines and odd names of folders."""
    import pandas as pd

    def put(name, text):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode())

    put("products/day=1 2/a.csv", 'product_id, "product_name",category,price,sku,updated_at\r\n1,"two\nlines",c,1,s,2024-01-01\r\n\r\n2,x,c,1,s,2024-01-01\r\n')
    put("products/b.csv", "product_id,product_name,category,price,sku,updated_at\n")
    put("products/c.csv", "product_id,extra\n1,2\n")
    put("wishlist/a.json", '\n{"wishlist_event_id": 1, "customer_id": 2, "product_id": 3, "added_at": null, "source": "s", "more": {"x": 1}}\n{}\n')
    put("wishlist/b.json", '{"wishlist_event_id": 1')
    put("wishlist/c.json", "")
    put("wishlist/d.json", " \n\n")
    put("else/a.csv", "a\n1\n")
    put("customers/a.parquet", "PAR1")
    (tmp_path / "orders").mkdir()
    pd.DataFrame({c: [1] for c in audit.CONTRACTS["orders"][1]}).to_parquet(tmp_path / "orders/a.parquet")
    got = {tuple(r["path"].split("/")[-1:]) + (r["source"],): (r["status"], r["reason"].split(": ")[0], r["n_rows"], r["warnings"]) for r in audit.audit_files(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.csv", "products"): ("validated", "ok", 2, ""),
        ("b.csv", "products"): ("quarantine", "zero_rows", 0, ""),
        ("c.csv", "products"): ("quarantine", "missing_columns", 1, ""),
        ("a.json", "wishlist"): ("warn", "passed_with_warnings", 2, "unexpected_columns: more"),
        ("b.json", "wishlist"): ("quarantine", "unreadable_jsonl", 1, ""),
        ("c.json", "wishlist"): ("quarantine", "empty_file", None, ""),
        ("d.json", "wishlist"): ("quarantine", "zero_rows", 0, ""),
        ("a.csv", "unknown"): ("quarantine", "unknown_source", None, ""),
        ("a.parquet", "customers"): ("quarantine", "unreadable_parquet", None, ""),
        ("a.parquet", "orders"): ("validated", "ok", 1, ""),
    }
