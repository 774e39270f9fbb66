"""Slowly changing dimensions with full history, and joins as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import version_key

#: Fixed value: the end of the current version.
OPEN_END = "9999-12-31 23:59:59"
#: as_of_buckets: a key is hot with a share of the facts over one in this many for each shuffle partition.
HOT_SHARES = 4


def history(changes: DataFrame, nk: str, tracked: list[str], carried: list[str], sk: str, ts: str = "updated_at") -> DataFrame:
    """All versions from a full change log, one row per (nk, ts): a version starts where a
    tracked column changes and ends where the next starts. One shuffle, by nk."""
    line = Window.partitionBy(nk).orderBy(ts)
    before = F.lag(F.struct(*tracked)).over(line)
    starts = changes.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*tracked))).drop("_before")
    following = F.lead(ts).over(line)
    return starts.select(version_key(nk, ts).alias(sk), nk, *tracked, *carried, F.col(ts).alias("effective_from"), F.coalesce(following, F.lit(OPEN_END).cast("timestamp")).alias("effective_to"), following.isNull().alias("is_current"))


def dimension_schema(source: T.StructType, nk: str, attributes: list[str], sk: str) -> T.StructType:
    """Schema of a dimension: keys and times required, attributes nullable."""
    fields = [T.StructField(sk, T.StringType(), False), T.StructField(nk, source[nk].dataType, False)]
    fields += [T.StructField(c, source[c].dataType, True) for c in attributes]
    return T.StructType([*fields, T.StructField("effective_from", T.TimestampType(), False), T.StructField("effective_to", T.TimestampType(), False), T.StructField("is_current", T.BooleanType(), False)])


def _with_snapshot(dim: DataFrame, source: DataFrame, nk: str, tracked: list[str], carried: list[str], sk: str, ts: str) -> DataFrame:
    """Current versions beside the source's rows: _cur, _new, and _fate of the source row."""
    current = dim.filter("is_current").select(F.col(nk).alias("_nk"), F.struct(*dim.columns).alias("_cur"))
    new = source.select(F.col(nk).alias("_nk"), F.struct(version_key(nk, ts).alias(sk), nk, *tracked, *carried, F.col(ts).alias("effective_from"), F.lit(OPEN_END).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current")).alias("_new"))
    both = current.join(new, "_nk", "full_outer")
    changed = ~F.struct(*[F.col(f"_new.{c}") for c in tracked]).eqNullSafe(F.struct(*[F.col(f"_cur.{c}") for c in tracked]))
    newer = F.coalesce(F.col("_new.effective_from") > F.col("_cur.effective_from"), F.lit(False))
    fate = F.when(F.col("_new").isNull(), "none").when(F.col("_cur").isNull(), "new").when(~newer, "ignored").when(changed, "changed").otherwise("unchanged")
    return both.withColumn("_fate", fate)


def _versions_after(dim: DataFrame, both: DataFrame) -> DataFrame:
    version = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in dim.columns])
    closed = F.struct(*[(F.col("_new.effective_from") if c == "effective_to" else F.lit(False) if c == "is_current" else F.col(f"_cur.{c}")).alias(c) for c in dim.columns])
    rows = F.when(F.col("_fate") == "changed", F.array(closed, version("_new"))).when(F.col("_fate") == "new", F.array(version("_new"))).otherwise(F.array(version("_cur")))
    return dim.filter("not is_current").unionByName(both.select(F.inline(rows)))


def merge_snapshot(dim: DataFrame, source: DataFrame, nk: str, tracked: list[str], carried: list[str], sk: str, ts: str = "updated_at") -> DataFrame:
    """dim after a snapshot of the source, one row per nk: unknown keys come in; where a
    tracked column changed the current version closes and a new one opens; all else stays,
    changes of carried columns alone too. Source rows not newer than the current version
    are ignored. One join; a row of it yields one or two versions."""
    return _versions_after(dim, _with_snapshot(dim, source, nk, tracked, carried, sk, ts))


def observed_snapshot(dim: DataFrame, source: DataFrame, nk: str, tracked: list[str], carried: list[str], sk: str, ts: str = "updated_at", name: str = "snapshot") -> tuple[DataFrame, Observation]:
    """merge_snapshot(), and an observation of how many source rows were n_new, n_changed,
    n_unchanged and n_ignored (not newer than the current version)."""
    both, seen = _with_snapshot(dim, source, nk, tracked, carried, sk, ts), Observation(name)
    counted = both.observe(seen, *[F.count_if(F.col("_fate") == fate).alias(f"n_{fate}") for fate in ("new", "changed", "unchanged", "ignored")])
    return _versions_after(dim, counted), seen


def stage_changes(dim: DataFrame, source: DataFrame, nk: str, tracked: list[str]) -> DataFrame:
    """source with action: new, changed or unchanged against the current versions."""
    current = dim.filter("is_current").select(F.col(nk).alias("_nk"), F.struct(*tracked).alias("_t"))
    met = source.join(current, F.col(nk) == F.col("_nk"), "left")
    action = F.when(F.col("_nk").isNull(), "new").when(F.col("_t").eqNullSafe(F.struct(*tracked)), "unchanged").otherwise("changed")
    return met.withColumn("action", action).drop("_nk", "_t")


def as_of_join(fact: DataFrame, dim: DataFrame, nk: str, sk: str, ts: str = "created_at", extra: list[str] | None = None) -> DataFrame:
    """fact with sk and extra columns of the version in force at ts, half-open; null where
    there is none. An equi-join with a range condition: Spark broadcasts a small dimension
    and otherwise sorts, and splits hot keys at run time."""
    cols = [sk, *(extra or [])]
    d = dim.select(F.col(nk).alias("_nk"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *cols)
    met = fact.join(d, (fact[nk] == F.col("_nk")) & (fact[ts] >= F.col("_from")) & (fact[ts] < F.col("_to")), "left")
    return met.select(*[fact[c] for c in fact.columns], *cols)


def _sides(fact: DataFrame, dim: DataFrame, nk: str, ts: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, versions) as _in_force() takes them, by _nk; versions of no key are left out."""
    facts = fact.select(F.col(nk).alias("_nk"), F.col(ts).alias("_at"), *[F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(fact.columns)])
    version = F.struct(F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *[F.col(f"`{c}`") for c in cols])
    return facts, dim.filter(F.col(nk).isNotNull()).select(F.col(nk).alias("_nk"), version.alias("_dim"))


def _in_force(facts: DataFrame, versions: DataFrame, group: list[str], columns: list[str], cols: list[str]) -> DataFrame:
    """Facts (group, _at and a column _f0, _f1, ... for each of columns) with cols of the version
    (group, _dim) in force: both in one sorted run for each group. Facts have plain columns, not a
    struct of them, so that those that nobody asks for are not shuffled. Versions that lie by
    _nk already, as history() leaves them, are not shuffled anew where the group is _nk."""
    by = lambda df: df.repartition("_nk") if group == ["_nk"] else df
    known = by(versions).withColumn("_at", F.col("_dim._from")).withColumn("_kind", F.lit(0))
    rows = by(facts).withColumn("_kind", F.lit(1)).unionByName(known, allowMissingColumns=True)
    run = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_dim", F.last("_dim", True).over(run)).filter("_kind = 1")
    valid = (F.col("_at") >= F.col("_dim._from")) & (F.col("_at") < F.col("_dim._to"))
    return found.select(*[F.col(f"_f{i}").alias(c) for i, c in enumerate(columns)], *[F.when(valid, F.col(f"_dim.`{c}`")).alias(c) for c in cols])


def as_of_union(fact: DataFrame, dim: DataFrame, nk: str, sk: str, ts: str = "created_at", extra: list[str] | None = None) -> DataFrame:
    """The same for keys with very many versions: fact and dimension rows in one sorted run
    per key, so work is linear in both. Versions of a key must not overlap."""
    cols = [sk, *(extra or [])]
    facts, versions = _sides(fact, dim, nk, ts, cols)
    return _in_force(facts, versions, ["_nk"], fact.columns, cols)


def as_of_buckets(fact: DataFrame, dim: DataFrame, nk: str, sk: str, ts: str = "created_at", extra: list[str] | None = None, bucket: str = "day", salts: int = 8, told_by: list[str] | None = None) -> DataFrame:
    """The same where a few keys hold most facts: a hot key's facts are dealt to buckets of time
    and a large bucket's to salts, so that the key is spread over tasks. What reaches a bucket of
    the versions is those that start in it and the last one before it, which is carried over
    by a window of one row for each key and bucket. All other keys are one sorted run each, and
    neither their facts nor their versions are copied. Hot keys, and large buckets, are those
    of over 1 / (HOT_SHARES * shuffle partitions) of the facts, so there are no more than that
    many, and they are broadcast. told_by: columns that tell facts apart, by which they go to
    salts; all plain ones, if not given, which are then read and shuffled even where nobody
    else asks for them. Versions of a key must not overlap."""
    cols = [sk, *(extra or [])]
    of = lambda c: F.date_trunc(bucket, c)
    shares = HOT_SHARES * int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts, versions = _sides(fact.filter(F.col(nk).isNotNull()), dim, nk, ts, cols)
    counted = facts.groupBy("_nk").agg(F.count("*").alias("_n"))
    share = counted.agg((F.sum("_n") / shares).alias("_share"))
    hot = F.broadcast(counted.crossJoin(F.broadcast(share)).filter("_n > _share").select("_nk", "_share"))
    others = _in_force(facts.join(hot, "_nk", "left_anti"), versions.join(hot, "_nk", "left_anti"), ["_nk"], fact.columns, cols)

    placed = facts.withColumn("_bucket", of("_at"))
    asked = placed.filter("_bucket is not null").join(hot, "_nk").groupBy("_nk", "_bucket").agg(F.least(F.lit(salts), F.ceil(F.count("*") / F.max("_share"))).cast("long").alias("_salts"))
    started = versions.withColumn("_bucket", of("_dim._from")).join(hot, "_nk", "left_semi")
    ends = started.groupBy("_nk", "_bucket").agg(F.max_by("_dim", F.col("_dim._from")).alias("_last"))
    line = Window.partitionBy("_nk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = asked.join(ends, ["_nk", "_bucket"], "full_outer")
    carried = both.withColumn("_dim", F.last("_last", True).over(line)).filter("_salts is not null and _dim is not null").select("_nk", "_bucket", "_dim", "_salts")
    reach = started.join(asked, ["_nk", "_bucket"]).unionByName(carried).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    # facts of a hot key without a time meet nothing, but are many perhaps
    n = F.when(F.col("_bucket").isNull(), F.lit(salts)).otherwise(F.coalesce("_salts", F.lit(1)))
    deal = F.xxhash64(*[F.col(f"_f{i}") for i, c in enumerate(fact.columns) if (c in told_by if told_by else isinstance(fact.schema[c].dataType, T.AtomicType))])
    dealt = placed.join(hot, "_nk", "left_semi").join(F.broadcast(asked.filter("_salts > 1")), ["_nk", "_bucket"], "left").withColumn("_salt", F.pmod(deal, n)).drop("_salts")
    met = _in_force(dealt, reach, ["_nk", "_bucket", "_salt"], fact.columns, cols)
    # a key that is null meets nothing, and is not gathered either
    return others.unionByName(met).unionByName(fact.filter(F.col(nk).isNull()), allowMissingColumns=True)


def overlaps(dim: DataFrame, nk: str, sk: str) -> DataFrame:
    """All pairs of versions of a key that overlap: nk, sk of the earlier and other_sk of the
    later one, by (effective_from, sk). Versions that the latest end so far does not reach
    open a new chain; only versions of one chain are compared. Versions without any time
    between from and to overlap none."""
    line = Window.partitionBy(nk).orderBy("effective_from", sk)
    open_ones = dim.filter("effective_from < effective_to").select(nk, sk, "effective_from", "effective_to")
    reach = F.max("effective_to").over(line.rowsBetween(Window.unboundedPreceding, -1))
    placed = open_ones.withColumn("_place", F.row_number().over(line)).withColumn("_new", F.when(F.coalesce(reach <= F.col("effective_from"), F.lit(True)), 1).otherwise(0))
    chains = placed.withColumn("_chain", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the first of a chain that no other version joins has no pair
    several = chains.withColumn("_n", F.count("*").over(Window.partitionBy(nk, "_chain"))).filter("_n > 1").drop("_n", "_new")
    a = several.select(nk, "_chain", sk, F.col("effective_to").alias("_until"), F.col("_place").alias("_first"))
    b = several.select(nk, "_chain", F.col(sk).alias("other_sk"), F.col("effective_from").alias("_at"), "_place")
    return a.join(b, [nk, "_chain"]).filter("_first < _place and _at < _until").select(nk, sk, "other_sk")


def several_current(dim: DataFrame, nk: str) -> DataFrame:
    return dim.filter("is_current").groupBy(nk).agg(F.count("*").alias("n")).filter("n > 1")


def current(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current")


def at(dim: DataFrame, nk: str, key, when) -> DataFrame:
    """The version of a key in force at a time."""
    return dim.filter((F.col(nk) == key) & (F.col("effective_from") <= F.lit(when)) & (F.col("effective_to") > F.lit(when)))
