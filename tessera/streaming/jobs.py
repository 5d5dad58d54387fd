"""Structured Streaming twins of the state operators. Clocks are event time, with watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import keepers
from .keepers import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# Event types as job states.
STATES = {"view": "building", "click": "building", "purchase": "ready", "signup": "cancelling", "error": "failed"}


def with_instants(events: DataFrame) -> DataFrame:
    """Timestamps without zone are read as UTC instants, whatever the session's zone."""
    if dict(events.dtypes)["ts"] != "timestamp_ntz":
        return events
    return events.withColumn("ts", F.expr("to_timestamp(concat(cast(ts as string), 'Z'))"))


def as_jobs(events: DataFrame) -> DataFrame:
    name = F.when(F.lit(False), "")
    for kind, state in STATES.items():
        name = name.when(F.col("event_type") == kind, state)
    return with_instants(events).select(F.col("user_id").alias("job"), "ts", "event_id", name.otherwise("failed").alias("state"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return with_instants(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_folder(sf_dir)))


def _folder(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet*"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Starts a stream over what is there, waits for its end, and returns what it wrote to a table in the shared folder."""
    spark = stream.sparkSession
    set_before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # keeps large state out of the heap, and map states need it
    try:
        return _run_to_end(spark, stream, mode)
    finally:
        if set_before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, set_before)


def _run_to_end(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        part = "" if mode == "complete" else f"/batch={number}"  # a batch that is run again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{path}/out{part}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day: updates, so that days before the watermark leave the state; of the updates of a day the one of most events is the last."""
    days = read_events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    told = run_to_end(days.select(F.unix_micros("w.start").alias("day_us"), "event_type", "n", "total"), "update")
    return told.groupBy("day_us", "event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_events(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.min("ts").alias("started"), F.count("*").alias("events"))
    return run_to_end(runs.select("user_id", F.unix_micros("started").alias("started_us"), "events"), "complete")


def keep_latest(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The newest (ts, event_id) and state of a job, and its number of events so far; the state is four numbers and a name."""
    ts, event_id, name, n = state.get if state.exists else (-1, -1, "", 0)
    for part in parts:
        for t, e, s in zip(part["us"], part["event_id"], part["state"]):
            n += 1
            if (t, e) > (ts, event_id):
                ts, event_id, name = int(t), int(e), s
    state.update((ts, event_id, name, n))
    yield pd.DataFrame({"job": [key[0]], "last_state": [name], "events": [n]})


def state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of each job's latest state; the update with most events is the last."""
    rows = as_jobs(read_events(spark, sf_dir)).select("job", F.unix_micros("ts").alias("us"), "event_id", "state")
    kept = rows.groupBy("job").applyInPandasWithState(keep_latest, "job long, last_state string, events long", "ts long, event_id long, name string, n long", "update", "NoTimeout")
    return run_to_end(kept, "update").groupBy("job").agg(F.max_by("last_state", "events").alias("last_state"), F.max("events").alias("events"))


def model_events(lines: DataFrame) -> DataFrame:
    """(kind, text) of newline-delimited JSON of a model stream: thinking, content or done; works on batches and streams."""
    parsed = lines.select(F.from_json("value", "message struct<thinking string, content string>, done boolean").alias("e"))
    kind = F.when(F.col("e.done"), "done").when(F.col("e.message.thinking") != "", "thinking").when(F.col("e.message.content") != "", "content")
    return parsed.select(kind.alias("kind"), F.coalesce(F.nullif("e.message.thinking", F.lit("")), "e.message.content").alias("text")).where("kind is not null")


def as_steps(events: DataFrame, kinds: dict[str, str], ids: int) -> DataFrame:
    """Events as steps of an owner's store: the event type tells the kind of step, the id is one of `ids`, requests alternate."""
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return with_instants(events).select(F.col("user_id").cast("string").alias("owner"), "ts", "event_id", F.element_at(kind, F.col("event_type")).alias("kind"), F.concat(F.lit("i"), (F.col("event_id") % ids).cast("string")).alias("id"), (F.col("event_id") % 2).cast("string").alias("request"), (F.col("event_id") * 1000).alias("size"))


CONFIRMATION_STEPS = {"signup": "create", "view": "begin", "click": "complete", "purchase": "create", "error": "fail"}
JOB_STEPS = {"signup": "submit_deep", "view": "submit", "click": "status", "purchase": "done", "error": "finish"}
TALK_STEPS = {"signup": "new", "view": "view", "click": "start", "purchase": "new", "error": "finish"}
#: Stores with bounds small enough that the events, some a day apart, reach them: times are in days.
DAY = 86400
STORES = {
    "confirmations": (lambda: keepers.Confirmations(3, 4 * DAY, 9 * DAY), CONFIRMATION_STEPS, 6),
    "jobs": (lambda: keepers.Jobs(2, 3 * DAY, 4, 10_000_000), JOB_STEPS, 5),
    "conversations": (lambda: keepers.Talks(3, 6 * DAY, 6 << 20, 9 << 20), TALK_STEPS, 6),
}


def status_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event was taken as the next state of its user's job."""
    steps = as_jobs(read_events(spark, sf_dir)).select(F.col("job").cast("string").alias("owner"), "ts", "event_id", F.col("state").alias("kind"), F.lit("job").alias("id"), F.lit("").alias("request"), F.lit(0).alias("size"))
    return run_to_end(keepers.kept_by(keepers.Statuses(400 * DAY), steps), "append").where("event_id >= 0").select("event_id", F.col("owner").cast("long").alias("job"), (F.col("outcome") == "taken").alias("taken"))


def answers(spark: SparkSession, sf_dir: str, store: str) -> DataFrame:
    """What a store answers to every event of the table, taken as its steps."""
    keeper, kinds, ids = STORES[store]
    out = run_to_end(keepers.kept_by(keeper(), as_steps(read_events(spark, sf_dir), kinds, ids)), "append")
    return out.where("event_id >= 0").select("event_id", "owner", "id", "outcome")
