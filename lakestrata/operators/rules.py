"""Declarative data-quality rules and the quarantine split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REASON = "_quarantine_reason"


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str


def _rules(**conditions: str) -> list[Rule]:
    return [Rule(name, condition) for name, condition in conditions.items()]


# Rule names, accepted values and tolerances.
ORDERS = _rules(
    order_id_not_null="order_id IS NOT NULL",
    customer_id_not_null="customer_id IS NOT NULL",
    product_id_not_null="product_id IS NOT NULL",
    quantity_positive="quantity > 0",
    price_positive="price > 0",
    status_known="status IN ('placed', 'paid', 'shipped', 'delivered', 'cancelled')",
    created_at_not_future="created_at <= current_timestamp() + INTERVAL 1 HOUR",
    updated_at_not_before_created="updated_at >= created_at",
)
CUSTOMERS = _rules(
    customer_id_not_null="customer_id IS NOT NULL",
    name_not_null="name IS NOT NULL",
    email_well_formed=r"email IS NULL OR email RLIKE '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'",
    signup_date_not_future="signup_date <= current_date()",
    updated_at_not_before_signup="updated_at >= CAST(signup_date AS TIMESTAMP)",
)
CATEGORIES = ("electronics", "books", "clothing", "home_kitchen", "sports_outdoors", "toys_games", "beauty", "grocery", "automotive", "office")
PRODUCTS = _rules(
    product_id_not_null="product_id IS NOT NULL",
    product_name_not_null="product_name IS NOT NULL",
    price_positive="price > 0",
    category_known=f"category IN {CATEGORIES}",
    sku_not_null="sku IS NOT NULL",
)
CLICKSTREAM = _rules(
    event_id_not_null="event_id IS NOT NULL",
    session_id_not_null="session_id IS NOT NULL",
    event_type_known="event_type IN ('page_view', 'add_to_cart', 'checkout', 'purchase')",
    page_url_not_null="page_url IS NOT NULL",
    event_ts_not_future="event_ts <= current_timestamp() + INTERVAL 1 HOUR",
    device_known="device IS NULL OR device IN ('desktop', 'mobile', 'tablet')",
)
CURRENCY = _rules(
    rate_date_not_null="rate_date IS NOT NULL",
    rate_date_not_future="rate_date <= current_date() + INTERVAL 1 DAY",
    base_currency_known="base_currency = 'USD'",
    target_currency_not_null="target_currency IS NOT NULL",
    rate_positive="rate > 0",
    source_known="_source IN ('api', 'simulated')",
)
WISHLIST = _rules(
    wishlist_event_id_not_null="wishlist_event_id IS NOT NULL",
    customer_id_not_null="customer_id IS NOT NULL",
    product_id_not_null="product_id IS NOT NULL",
    added_at_not_future="added_at <= current_timestamp() + INTERVAL 1 HOUR",
    source_known="source IS NULL OR source IN ('/products', '/search', '/recommendations', '/cart', '/email-campaign')",
)


def as_of(rules: list[Rule], now: str) -> list[Rule]:
    """The rules with a given time (yyyy-MM-dd HH:mm:ss) in place of the clock."""
    clock = {"current_timestamp()": f"TIMESTAMP '{now}'", "current_date()": f"DATE '{now[:10]}'"}
    fixed = []
    for r in rules:
        condition = r.condition
        for name, value in clock.items():
            condition = condition.replace(name, value)
        fixed.append(Rule(r.name, condition))
    return fixed


def judged(df: DataFrame, rules: list[Rule], null_policy: str = "pass") -> DataFrame:
    """df with REASON: names of failed rules in their order, joined by commas; empty if
    none failed. A null condition passes, or fails under the policy "fail"."""
    failed = {"pass": "NOT ({})", "fail": "({}) IS NOT TRUE"}[null_policy]
    reasons = [F.when(F.expr(failed.format(r.condition)), F.lit(r.name)) for r in rules]
    return df.withColumn(REASON, F.concat_ws(",", *reasons) if reasons else F.lit(""))


def split_quarantine(df: DataFrame, rules: list[Rule], null_policy: str = "pass") -> tuple[DataFrame, DataFrame]:
    """(good, bad): good has df's columns, bad the reason as well. Persist df, or store the
    judged frame, if both are used: each is a filter over the same plan."""
    all_rows = judged(df, rules, null_policy)
    return all_rows.filter(F.col(REASON) == "").drop(REASON), all_rows.filter(F.col(REASON) != "")


def observed_split(df: DataFrame, rules: list[Rule], name: str = "split") -> tuple[DataFrame, Observation]:
    """The judged rows, and an observation of how many came in, were good and were bad: its
    figures are there once an action has run over the rows, without a pass of its own."""
    seen = Observation(name)
    bad = F.count_if(F.col(REASON) != "")
    return judged(df, rules).observe(seen, F.count("*").alias("n_input"), (F.count("*") - bad).alias("n_good"), bad.alias("n_bad")), seen


def breakdown(bad: DataFrame, per_rule: bool = False) -> DataFrame:
    """Rows by reason, most first; per_rule counts each of a row's rules."""
    reason = F.explode(F.split(REASON, ",")) if per_rule else F.col(REASON)
    return bad.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def dispose(quarantine: DataFrame, decisions: DataFrame, fixed: DataFrame, key: str, rules: list[Rule]) -> dict[str, DataFrame]:
    """What becomes of quarantined rows: decisions (key, action, operator, reason, at) with
    actions discard, replay and fix. released: replayed rows and the fixed rows that pass
    the rules now; still_bad: those that fail again; waiting: rows without a decision;
    audit: the decisions that met a row."""
    action = decisions.select(key, "action").dropDuplicates([key])
    met = quarantine.drop(REASON).join(action, key)
    replay = met.filter("action = 'replay'").drop("action")
    substitutes = fixed.join(met.filter("action = 'fix'").select(key), key, "left_semi")
    good, bad = split_quarantine(replay.unionByName(substitutes), rules)
    return {"released": good, "still_bad": bad, "waiting": quarantine.join(action, key, "left_anti"), "audit": decisions.join(quarantine.select(key).distinct(), key, "left_semi")}


#: Fixed value: the folder, beside a quarantined file, of its repaired form.
FIXED = "_fixed"


def repaired_path(path: Column) -> Column:
    """Where the repaired form of a file lies: <parent>/_fixed/<name>."""
    return F.regexp_replace(path, "/([^/]+)$", f"/{FIXED}/$1")


def dispose_files(quarantine: DataFrame, decisions: DataFrame, repaired: DataFrame, rules: list[Rule], file: str = "_source_file") -> dict[str, DataFrame]:
    """dispose() by file: decisions (file, action, ...) are on files; quarantine and repaired have
    the file of each row. A fix takes the rows that lie at the repaired path of the file, all
    of them, and no others; a file of which no repaired form lies there yet is waiting. The
    decisions, one row for each decided file, are broadcast, so that the rows of a file, however
    many, stay in the tasks that read them."""
    action = decisions.select(F.col(file).alias("_file"), "action").dropDuplicates(["_file"])
    expected = F.broadcast(action.filter("action = 'fix'").select(repaired_path(F.col("_file")).alias("_there")).distinct())
    there = repaired.join(expected, F.col(file) == F.col("_there"), "left_semi").select(F.col(file).alias("_there")).distinct()
    ready = F.broadcast(action.join(F.broadcast(there), repaired_path(F.col("_file")) == F.col("_there"), "left").filter((F.col("action") != "fix") | F.col("_there").isNotNull()))
    met = quarantine.drop(REASON).join(ready, F.col(file) == F.col("_file"))
    replay = met.filter("action = 'replay'").select([c for c in quarantine.columns if c != REASON])
    fixes = F.broadcast(ready.filter("action = 'fix'").select("_there"))
    substitutes = repaired.join(fixes, F.col(file) == F.col("_there"), "left_semi")
    good, bad = split_quarantine(replay.unionByName(substitutes), rules)
    waiting = quarantine.join(ready, F.col(file) == F.col("_file"), "left_anti")
    return {"released": good, "still_bad": bad, "waiting": waiting, "audit": decisions.join(quarantine.select(file).distinct(), file, "left_semi")}
