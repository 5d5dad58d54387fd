"""State machines, sessions and registries over event tables, as windows in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of an index job, by kind.
ACTIVE, TERMINAL = ["building", "cancelling"], ["ready", "cancelled", "failed"]


def transition_allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another: cancelling only ends in cancelled, an ended job only starts anew, building needs no restart."""
    started = F.when(before.isin(TERMINAL), after.isin("building") | (after == before))
    return F.when(before.isNull(), True).when(before == "cancelling", after.isin("cancelling", "cancelled")).otherwise(F.coalesce(started, F.lit(True)))


def transitions(events: DataFrame) -> DataFrame:
    """Every event with the state before it in its job and whether the step is allowed; events: job, ts, event_id, state."""
    order = Window.partitionBy("job").orderBy("ts", "event_id")
    return events.withColumn("before", F.lag("state").over(order)).withColumn("allowed", transition_allowed(F.col("before"), F.col("state")))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job and how many it had."""
    return events.groupBy("job").agg(F.max_by(F.struct("event_id", "state", "ts"), F.struct("ts", "event_id")).alias("e"), F.count("*").alias("events")).select("job", "e.*", "events")


def sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, events): runs of events with less than `idle` between them."""
    gap = F.col("ts") >= F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + F.expr(f"interval {idle}")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("new").over(order))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events")).drop("session")


def registry_alive(events: DataFrame, now: Column, ttl: str = "30 minutes", most: int = 512) -> DataFrame:
    """Entries of each owner that are younger than `ttl` and among its newest `most`: views don't extend them."""
    young = events.where(F.col("ts") > now - F.expr(f"interval {ttl}"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return young.withColumn("age_rank", F.row_number().over(newest).cast("long")).where(F.col("age_rank") <= most)


def fit_history(turns: DataFrame, most_bytes: int) -> DataFrame:
    """The newest turns of each conversation that fit in `most_bytes`."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used_bytes", F.sum(F.octet_length("text")).over(newest)).where(F.col("used_bytes") <= most_bytes)
