"""Billing events: taken once, folded to states, with plans and their allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def states(events: DataFrame, now: Column) -> DataFrame:
    """(subscription_id, plan, status, at) by the latest of events (event_id, subscription_id, event, at, period_end), each
    event_id once. A cancelled subscription keeps its plan until the period that was paid last ends."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct("subscription_id", "event", "at", "period_end"), "at").alias("e")).select("event_id", "e.*")
    last = first.groupBy("subscription_id").agg(F.max_by(F.struct("event", "at"), F.struct("at", "event_id")).alias("x"), F.max(F.when(F.col("event").isin("activated", "charged"), F.col("period_end"))).alias("paid_until"))
    event = F.col("x.event")
    plan = F.when(event.isin("activated", "charged", "payment_failed") | ((event == "cancelled") & F.coalesce(F.col("paid_until") > now, F.lit(False))), "pro").otherwise("free")
    status = F.when(event.isin("activated", "charged"), "active").when(event == "payment_failed", "past_due").when(event == "cancelled", "cancelled").otherwise("completed")
    return last.select("subscription_id", plan.alias("plan"), status.alias("status"), F.col("x.at").alias("at"))


def alive(cache: DataFrame, now: Column, seconds: int, key: str | None = None, most: int | None = None) -> DataFrame:
    """Entries (at, ..) younger than `seconds`; with key and most the newest of each key only."""
    rows = cache.filter(now - F.col("at") < seconds)
    if most is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id")))).filter(F.col("_r") <= most).drop("_r")


def with_allowance(requests: DataFrame, plans: DataFrame, allowances: dict[str, int], *keys: str) -> DataFrame:
    """requests (user_id, keys, at, id) with plan, used and allowed: the first ones up to the plan's allowance count."""
    plan = F.coalesce("plan", F.lit("free"))
    limit = F.coalesce(*(F.when(plan == name, F.lit(n)) for name, n in allowances.items()), F.lit(0))
    place = F.row_number().over(Window.partitionBy("user_id", *keys).orderBy("at", "id"))
    met = requests.join(plans.select("user_id", "plan"), "user_id", "left").withColumn("plan", plan)
    return met.withColumn("allowed", place <= limit).withColumn("used", F.least(place, limit).cast("bigint"))
