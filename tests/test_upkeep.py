"""Layouts, hot keys, loads, schemas, merges of parts and quantiles beyond what the queries reach."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lakestrata.operators import clustering as C
from lakestrata.operators import facts, history, rules, state
from lakestrata.operators.quantiles import exact_quantiles
from lakestrata.sources import loads, partitioned, schemas, tables
from lakestrata.streaming import pipelines

RNG = random.Random(4)


def stamp(second):
    return datetime.fromtimestamp(second, UTC)


def same_rows(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


# --- layouts -----------------------------------------------------------------------------------
def test_zorder_bits(spark):
    """Bits of two ranks in turn; ranks are quantile ranks of any kind of column."""
    df = spark.range(256).select(F.col("id").alias("a"), (255 - F.col("id")).alias("b"), F.format_string("k%03d", "id").alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.timestamp_seconds(F.col("id")).alias("t"), (F.col("id") > 200).alias("f"))
    for column in "asdt":
        got = [r["_zorder"] for r in C.with_zorder(df, [column], 4).orderBy("a").collect()]
        assert got == sorted(got) and got[0] == 0 and got[-1] == 15 and all(got.count(x) in (15, 16, 17) for x in range(16))
    both = {(r["a"], r["b"]): r["_zorder"] for r in C.with_zorder(df, ["a", "b"], 4).collect()}
    ranks = {r["a"]: r["_zorder"] for r in C.with_zorder(df, ["a"], 4).collect()}, {r["b"]: r["_zorder"] for r in C.with_zorder(df, ["b"], 4).collect()}
    for (a, b), z in both.items():
        assert z == int("".join(f"{ranks[0][a]:04b}"[i] + f"{ranks[1][b]:04b}"[i] for i in range(4)), 2)
    assert C.with_zorder(df.withColumn("a", F.lit(None).cast("long")), ["a"]).select("_zorder").distinct().first()[0] == 0
    assert C.with_zorder(df.limit(0), ["a", "s"]).count() == 0 and C.with_zorder(df, ["f", "a"]).count() == 256
    with pytest.raises(ValueError):
        C.with_zorder(df, ["a"] * 8)
    with pytest.raises(ValueError):
        C.Clustering(("a",), "hilbert")


def test_depth(spark):
    """Against counting for each range which others lie over its lower end; ties and points."""
    for n, span in ((1, 5), (40, 12), (200, 3), (300, 400)):
        ranges = [(lo := RNG.randrange(100), lo + RNG.randrange(span)) for _ in range(n)]
        depths = [sum(a <= lo <= b for a, b in ranges) for lo, _ in ranges]
        got = C.depth(spark.createDataFrame(ranges, "lo int, hi int")).first()
        assert (got["n_files"], got["avg_depth"], got["max_depth"], got["needs_rewrite"]) == (n, round(sum(depths) / n, 4), max(depths), sum(depths) / n > 4)
    assert C.depth(spark.createDataFrame([], "lo double, hi double")).first()["n_files"] == 0


def test_footer_ranges(spark):
    path = tables.work_path(spark, "f")
    df = spark.range(90).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("x"), F.col("id").cast("timestamp").alias("t"))
    df.repartition(3, "id").write.parquet(path)
    files = spark.read.parquet(path)
    for column in ("id", "d", "x"):
        same_rows(C.footer_ranges(files, column), C.file_ranges(files, column))
    assert {r["lo"] for r in C.footer_ranges(files, "t").collect()} == {None}  # Spark writes no statistics for such times


# --- history ------------------------------------------------------------------------------------
def test_all_overlaps(spark):
    rows = [("k", "A", "2026-01-01", "2026-10-01"), ("k", "B", "2026-02-01", "2026-03-01"), ("k", "C", "2026-05-01", "2026-06-01"), ("k", "D", "2026-10-01", "2026-12-01"), ("k", "E", "2026-05-05", "2026-05-05"), ("j", "F", "2026-01-01", "2026-02-01")]
    dim = spark.createDataFrame(rows, "nk string, sk string, effective_from string, effective_to string").withColumns({c: F.col(c).cast("timestamp") for c in ("effective_from", "effective_to")})
    assert sorted((r["sk"], r["other_sk"]) for r in history.overlaps(dim, "nk", "sk").collect()) == [("A", "B"), ("A", "C")]
    made = [(RNG.randrange(4), i, stamp(a := RNG.randrange(300)), stamp(a + RNG.randrange(40))) for i in range(160)] + [(9, 500, stamp(1), stamp(9)), (9, 500, stamp(1), stamp(9))]
    want = sorted((k, s, t) for x, (k, s, a, b) in enumerate(made) for y, (m, t, c, d) in enumerate(made) if k == m and ((a, s, x) < (c, t, y)) and a < b and c < d and c < b)
    got = history.overlaps(spark.createDataFrame(made, "nk int, sk int, effective_from timestamp, effective_to timestamp"), "nk", "sk")
    assert sorted((r["nk"], r["sk"], r["other_sk"]) for r in got.collect()) == want


def hot(n):
    """A key that a third of the rows have; null for some."""
    return 7 if n % 3 == 0 else None if n % 11 == 0 else n % 40


def test_as_of_hot_key(spark):
    """Buckets give what the join gives: with a key of a third of all facts, null keys and times,
    facts before the first version, gaps between versions, and versions over many buckets."""
    facts_rows = [(i, hot(i), stamp(RNG.randrange(4_000_000)) if i % 17 else None, {"a": 1}) for i in range(900)]
    dim_rows = []
    for key in range(40):
        cuts = sorted(RNG.sample(range(3_900_000), RNG.randrange(1, 9)))
        for j, at in enumerate(cuts):
            until = cuts[j + 1] if j + 1 < len(cuts) else 4_100_000
            dim_rows.append((key, f"{key}-{j}", stamp(at), stamp(until - (until - at) // 3 if j % 3 == 0 else until), j))
    fact = spark.createDataFrame(facts_rows, "id int, k int, created_at timestamp, more map<string,int>")
    dim = spark.createDataFrame(dim_rows, "k int, sk string, effective_from timestamp, effective_to timestamp, v int")
    want = history.as_of_join(fact, dim, "k", "sk", extra=["v"])
    for bucket, salts in (("day", 8), ("hour", 1), ("year", 3)):
        same_rows(history.as_of_buckets(fact, dim, "k", "sk", extra=["v"], bucket=bucket, salts=salts), want)
    assert history.as_of_buckets(fact, dim.limit(0), "k", "sk").filter("sk is not null").count() == 0
    assert history.as_of_buckets(fact.limit(0), dim, "k", "sk").count() == 0
    tasks = history.as_of_buckets(fact.filter("k = 7"), dim, "k", "sk")._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in tasks  # one key's facts are dealt by bucket and salt too


def shuffled_rows(spark, df):
    """Rows that the stages of a run of df write into shuffles."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = stages()
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in known)


def test_as_of_buckets_copies_little(spark):
    """Versions are copied for large buckets of hot keys alone: where there are none, each fact and
    version is shuffled about once; a hot key's facts still go to several salts."""
    fact = spark.range(4000).select("id", (F.col("id") % 400).alias("k"), F.timestamp_seconds(F.col("id") * 9000).alias("created_at"))
    starts = spark.range(4000).select((F.col("id") % 400).alias("k"), F.timestamp_seconds(F.col("id") * 9000 - 20_000).alias("updated_at"), F.col("id").cast("string").alias("v"))
    dim = history.history(starts, "k", ["v"], [], "sk")
    found = history.as_of_buckets(fact, dim, "k", "sk", extra=["v"])
    assert shuffled_rows(spark, found) < 3 * (4000 + 4000)
    same_rows(found, history.as_of_join(fact, dim, "k", "sk", extra=["v"]))
    lone = fact.withColumn("k", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("k"))).withColumn("created_at", F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(9_000_000))).otherwise(F.col("created_at")))
    for told_by in (None, ["id"]):
        same_rows(history.as_of_buckets(lone, dim, "k", "sk", extra=["v"], told_by=told_by), history.as_of_join(lone, dim, "k", "sk", extra=["v"]))


def test_sessions_hot_cookie(spark):
    rows = [(i, hot(i), stamp(RNG.randrange(400_000) + RNG.random()) if i % 50 else None, "c") for i in range(1500)]
    rows += [(2000 + i, 7, stamp(86_400 * 2 - 900 + 1800 * i), "c") for i in range(5)]  # goes on over hours and midnight
    clicks = spark.createDataFrame(rows, "event_id int, cookie int, event_ts timestamp, event_type string")
    want = facts.sessionize(clicks, "cookie", "event_ts", "event_id")
    for part in ("hour", "day", "minute"):
        same_rows(facts.sessionize_in_parts(clicks, "cookie", "event_ts", "event_id", part=part), want)
    assert facts.sessionize_in_parts(clicks.limit(0), "cookie", "event_ts", "event_id").count() == 0


# --- loads and schemas -----------------------------------------------------------------------------
def test_ledger(spark, tmp_path):
    raw, table, types = tmp_path / "raw", tables.work_path(spark, "t"), {"a": "int", "b": "double"}
    raw.mkdir()
    (raw / "one.csv").write_text("a,b\n1,2.5\nx,1\n,\n")
    first = loads.load(spark, table, str(raw), types, "b1").collect()
    assert [(r["n_loaded"], r["n_rejected"], r["status"]) for r in first] == [(2, 1, "partly_loaded")]
    assert loads.load(spark, table, str(raw), types, "b2").count() == 0  # once for each file
    (raw / "two.csv").write_text("a,b\nz,z\n")
    (raw / "empty.csv").write_text("a,b\n")
    assert {r["path"].split("/")[-1]: r["status"] for r in loads.load(spark, table, str(raw), types, "b3").collect()} == {"two.csv": "rejected", "empty.csv": "loaded"}
    (raw / "one.csv").write_text("a,b\n4,4\n5,5\n6,6\n7,7\n")  # written anew
    with pytest.raises(loads.LoadAborted):
        (raw / "bad.csv").write_text("a,b\n1,?\n")
        loads.load(spark, table, str(raw), types, "b4", on_error="abort")
    assert loads.loaded(spark, table).count() == 2  # nothing of the load that broke off
    (raw / "bad.csv").unlink()
    assert loads.load(spark, table, str(raw), types, "b5", on_error="abort").first()["n_loaded"] == 4
    assert loads.loaded(spark, table).count() == 6 and sorted(r["a"] for r in loads.rejected(spark, table).collect()) == ["x", "z"]
    with pytest.raises(ValueError):
        loads.load(spark, table, str(raw), types, "b6", on_error="stop")


def test_ledger_parquet(spark):
    raw, table = tables.work_path(spark, "raw"), tables.work_path(spark, "t")
    spark.range(9).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("more")).coalesce(1).write.parquet(raw)
    loads.load(spark, table, raw, {"id": "long"}, "b", "parquet")
    assert loads.loaded(spark, table).agg(F.sum("id")).first()[0] == 36


def test_schema_merge(spark):
    of = lambda text: spark.createDataFrame([], text).schema
    schema, changes = schemas.merged(of("a int, b string"), of("b double, c array<int>"))
    assert schema.simpleString() == "struct<a:int,b:string,c:array<int>>" and changes == [("b", "type_differs", "string", "double"), ("c", "added", None, "array<int>")]
    store = tables.work_path(spark, "s")
    assert schemas.latest(spark, store) is None and schemas.changes(spark, store).count() == 0
    assert schemas.record(spark, store, of("a int"))[1] and not schemas.record(spark, store, of("a int"))[1]
    assert not schemas.record(spark, store, of("a string"))[1] and schemas.latest(spark, store) == of("a int")
    assert schemas.versions(spark, store).count() == 2


def test_ingest_evolving(spark):
    """A column that comes in the middle of a run stops the stream, which starts anew; none of the
    rows is lost or taken twice, and other failures are not hidden."""
    raw, bronze, checkpoint, store = (tables.work_path(spark, n) for n in ("raw", "bronze", "checkpoint", "store"))
    assert pipelines.ingest_evolving(spark, raw, bronze, checkpoint, store, "parquet", "b0") == 0  # no folder yet
    spark.range(5).coalesce(1).write.parquet(f"{raw}/a")
    assert pipelines.ingest_evolving(spark, raw, bronze, checkpoint, store, "parquet", "b1", 1) == 5
    for n in range(3):
        spark.range(4).withColumn(f"c{n}", F.lit(n)).coalesce(1).write.parquet(f"{raw}/b{n}")
    assert pipelines.ingest_evolving(spark, raw, bronze, checkpoint, store, "parquet", "b2", 1) == 12
    assert pipelines.ingest_evolving(spark, raw, bronze, checkpoint, store, "parquet", "b3") == 0
    rows = pipelines.read_evolved(spark, bronze)
    assert rows.count() == 17 and [rows.filter(f"c{n} = {n}").count() for n in range(3)] == [4, 4, 4]
    assert {r["_batch_id"]: r["n"] for r in rows.groupBy("_batch_id").agg(F.count("*").alias("n")).collect()} == {"b1": 5, "b2": 12}


def test_logs_that_cannot_be_read(spark, tmp_path):
    """A log that is broken is no empty table: nothing is published over it."""
    (tmp_path / "_log").mkdir()
    (tmp_path / "_log" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.publish(spark.range(3), str(tmp_path))
    assert tables.published(spark, str(tmp_path / "none")).count() == 0


# --- merges ------------------------------------------------------------------------------------------
def test_parts(spark):
    table, keys = tables.work_path(spark, "t"), ["id"]
    rows = spark.range(60).select("id", F.lit("old").alias("v"), F.lit(1).alias("at"))
    assert partitioned.read_parts(spark, table) is None
    assert partitioned.merge_parts(spark, table, rows, keys, ["at"], 8) == list(range(8))
    before = partitioned.current_paths(spark, table)
    news = spark.createDataFrame([(3, "new", 2), (70, "in", 1), (5, "late", 0)], "id long, v string, at int")
    touched = partitioned.merge_parts(spark, table, news, keys, ["at"], 8, "s/0")
    after = partitioned.current_paths(spark, table)
    assert 1 <= len(touched) <= 3 and {n for n in after if after[n] != before[n]} == set(touched)  # the others lie where they lay
    read = partitioned.read_parts(spark, table, touched).inputFiles()
    assert read and all(any(f"_part={n}/" in f for n in touched) for f in read)
    now = {r["id"]: r["v"] for r in partitioned.read_parts(spark, table).collect()}
    assert len(now) == 61 and now[3] == "new" and now[70] == "in" and now[5] == "old"
    assert partitioned.read_parts(spark, table, version=1).count() == 60
    for bad in (news.unionByName(news), news.withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(partitioned.KeysNotUnique):
            partitioned.merge_parts(spark, table, bad, keys, ["at"], 8)
    assert partitioned.merge_parts(spark, table, news.limit(0), keys, ["at"], 8) == []
    partitioned.merge_stream(table, keys, ["at"], 8)(news.withColumn("at", F.lit(9)), 0)
    assert partitioned.read_parts(spark, table).filter("v = 'late'").count() == 1


def test_vacuum(spark):
    """Retention, leftovers that no log names, versions that are gone, and empty tables."""
    table = tables.work_path(spark, "t")
    tables.create_if_missing(spark, table, spark.range(1).schema)
    assert tables.vacuum(spark, table, hours=0) == []
    for n in (3, 4, 5):
        tables.publish(spark.range(n), table)
    first = tables.published(spark, table).filter("version = 2").first()["published"]
    spark.range(2).write.parquet(f"{table}/snapshot=9-leftover")
    at = first.replace(tzinfo=UTC) if first.tzinfo is None else first
    assert tables.vacuum(spark, table, hours=1, now=at) == []
    assert [f[:10] for f in tables.vacuum(spark, table, hours=0)] == ["snapshot=1", "snapshot=2", "snapshot=3", "snapshot=9"]
    assert tables.read_snapshot(spark, table).count() == 5 and tables.publish(spark.range(6), table) == 5
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, table, version=2)


def test_observed(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", None), (None, "n", 1)], "id int, v string, at int")
    s = spark.createDataFrame([(1, "x", 2), (2, "x", 4), (3, "x", 9), (4, "x", 1), (None, "m", 9)], "id int, v string, at int")
    merged, seen = state.observed_merge(t, s, ["id"], "at")
    same_rows(merged, state.merge_newer(t, s, ["id"], "at"))
    merged.count()
    merged, seen = state.observed_merge(t, s, ["id"], "at")
    merged.collect()
    assert seen.get == {"n_inserted": 2, "n_updated": 1, "n_ignored": 2, "n_kept": 1}
    changes = spark.createDataFrame([(1, "a", stamp(100)), (2, "b", stamp(100))], "id int, v string, updated_at timestamp")
    dim = history.history(changes, "id", ["v"], [], "sk")
    news = spark.createDataFrame([(1, "z", stamp(50)), (2, "c", stamp(200)), (3, "d", stamp(1))], "id int, v string, updated_at timestamp")
    after, seen = history.observed_snapshot(dim, news, "id", ["v"], [], "sk")
    assert len(after.collect()) == 4 and seen.get == {"n_new": 1, "n_changed": 1, "n_unchanged": 0, "n_ignored": 1}


# --- quantiles, disposition -----------------------------------------------------------------------------
def test_quantiles(spark):
    rows = [(k, n, float(v)) for k in ("a", "b", None) for n in (1, 2) for v in [RNG.gauss(0, 1) for _ in range(90)] + [3.5] * RNG.randrange(60) + [1e9]]
    rows += [("one", 1, 5.0), ("same", 1, 2.0), ("same", 1, 2.0), ("nan", 1, float("nan")), ("nan", 1, None), ("big", 1, -1e300), ("big", 1, 1e300), ("big", 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, _v int, x double")
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for cells in (1024, 1, 7):
        got = exact_quantiles(df, ["k", "_v"], "x", wanted, cells)
        plain = df.filter("x is not null and not isnan(x)").groupBy("k", "_v").agg(*[F.percentile("x", p).alias(name) for name, p in wanted.items()])
        key = lambda r: (str(r["k"]), r["_v"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
            assert tuple(a)[:2] == tuple(b)[:2] and all(x == pytest.approx(y, rel=1e-12) for x, y in zip(tuple(a)[2:], tuple(b)[2:], strict=True))
    assert exact_quantiles(df.limit(0), ["k"], "x", wanted).count() == 0


def test_dispose_files(spark):
    rule = [rules.Rule("positive", "n > 0")]
    bad = spark.createDataFrame([("q/a.csv", 1, -1), ("q/a.csv", 2, 5), ("q/b.csv", 3, -1), ("q/c.csv", 4, -1), ("q/d.csv", 5, -1)], "_source_file string, id int, n int").withColumn(rules.REASON, F.lit("positive"))
    fixed = spark.createDataFrame([("q/_fixed/b.csv", 3, 1), ("q/_fixed/b.csv", 30, 1), ("q/_fixed/b.csv", 31, -1), ("q/_fixed/d.csv", 5, 1)], "_source_file string, id int, n int")
    decisions = spark.createDataFrame([("q/a.csv", "replay"), ("q/b.csv", "fix"), ("q/c.csv", "fix"), ("q/zz.csv", "fix")], "_source_file string, action string")
    got = {name: sorted(r["id"] if name != "audit" else r["_source_file"] for r in df.collect()) for name, df in rules.dispose_files(bad, decisions, fixed, rule).items()}
    assert got == {"released": [2, 3, 30], "still_bad": [1, 31], "waiting": [4, 5], "audit": ["q/a.csv", "q/b.csv", "q/c.csv"]}


def test_dispose_large_file(spark):
    """Rows of a file are not gathered: no shuffle has them, whatever the size of the file."""
    rule = [rules.Rule("positive", "n > 0")]
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "q/a").when(F.col("id") < 2900, "q/b").otherwise("q/c").alias("_source_file"), "id", (F.col("id") % 3 - 1).alias("n"))
    bad, fixed = rows.withColumn(rules.REASON, F.lit("positive")), rows.filter("_source_file = 'q/b'").withColumns({"_source_file": F.lit("q/_fixed/b"), "n": F.lit(1).cast("long")})
    decisions = spark.createDataFrame([("q/a", "replay"), ("q/b", "fix")], "_source_file string, action string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parts = rules.dispose_files(bad, decisions, fixed, rule)
        for name, n in (("released", 666 + 900), ("still_bad", 1334), ("waiting", 100)):
            assert shuffled_rows(spark, parts[name]) < 100 and parts[name].count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
