"""Queries over events and conversations: states, sessions, registries, histories, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..registry import query, table
from ..streaming import jobs

JOBS = "jobs AS (SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'view' THEN 'building' WHEN 'click' THEN 'building' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'cancelling' ELSE 'failed' END AS state FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as states of the user's index job."""
    return jobs.as_jobs(table(spark, sf_dir, "events"))


@query("WITH " + JOBS + ", b AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY ts, event_id) AS before FROM jobs) SELECT event_id, job, before, state, CASE WHEN before IS NULL THEN true WHEN before = 'cancelling' THEN state IN ('cancelling', 'cancelled') WHEN before IN ('ready', 'cancelled', 'failed') THEN state = 'building' OR state = before ELSE true END AS allowed FROM b")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.transitions(_jobs(spark, sf_dir)).select("event_id", "job", "before", "state", "allowed")


@query("WITH " + JOBS + " SELECT job, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(state, (ts, event_id)) AS state, epoch_us(max(ts)) AS at_us, count(*) AS events FROM jobs GROUP BY job")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(_jobs(spark, sf_dir)).select("job", "event_id", "state", F.unix_micros("ts").alias("at_us"), "events")


@query(
    "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS events FROM s GROUP BY user_id, session"
)
def session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.sessions(_ts(table(spark, sf_dir, "events")), "30 minutes")
    return out.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "events")


def _ts(events: DataFrame) -> DataFrame:
    return jobs.with_instants(events)


@query("WITH n AS (SELECT max(ts) AS now FROM events), y AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age_rank FROM events, n WHERE ts > now - INTERVAL 15 DAY) SELECT * FROM y WHERE age_rank <= 3")
def registry_ttl_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries younger than fifteen days at the last event, the newest three of each owner."""
    events = _ts(table(spark, sf_dir, "events"))
    now = events.agg(F.max("ts").alias("now"))
    return state.registry_alive(events.join(F.broadcast(now)), F.col("now"), "15 days", 3).select("event_id", "user_id", "age_rank")


@query("SELECT * FROM (SELECT conv_id, turn, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes FROM conversations) WHERE used_bytes <= 600")
def conversation_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fit_history(table(spark, sf_dir, "conversations"), 600).select("conv_id", "turn", "used_bytes")


@query("WITH d AS (SELECT user_id, count(*) AS generated, round(date_diff('microsecond', min(ts), max(ts)) / CAST(1000000 AS DOUBLE), 3) AS seconds FROM events GROUP BY user_id) SELECT user_id, generated, CASE WHEN generated >= 3 AND seconds > 0 THEN round(generated / seconds, 8) END AS rate FROM d")
def rate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second of users with three or more."""
    d = _ts(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("generated"), F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000.0, 3).alias("seconds"))
    return d.select("user_id", "generated", F.when((F.col("generated") >= 3) & (F.col("seconds") > 0), F.round(F.col("generated") / F.col("seconds"), 8)).alias("rate"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days by a watermarked stream over the events, run to its end."""
    return jobs.daily_counts(spark, sf_dir)


@query(
    "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS events FROM s GROUP BY user_id, session"
)
def session_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of session_idle by session_window on a stream."""
    return jobs.session_stream(spark, sf_dir)


@query("WITH " + JOBS + " SELECT job, arg_max(state, (ts, event_id)) AS last_state, count(*) AS events FROM jobs GROUP BY job")
def state_machine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest states kept by a stateful stream operator."""
    return jobs.state_stream(spark, sf_dir)


@query(
    "WITH RECURSIVE "
    + JOBS
    + """, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS i FROM jobs),
w AS (SELECT job, event_id, i, state, true AS taken FROM n WHERE i = 1
 UNION ALL SELECT n.job, n.event_id, n.i, CASE WHEN t.ok THEN n.state ELSE w.state END, t.ok FROM w JOIN n ON n.job = w.job AND n.i = w.i + 1,
  LATERAL (SELECT CASE WHEN w.state = 'cancelling' THEN n.state IN ('cancelling', 'cancelled') WHEN w.state IN ('ready', 'cancelled', 'failed') THEN n.state IN (w.state, 'building') ELSE true END AS ok) t)
SELECT event_id, job, taken FROM w"""
)
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a stream takes as the next state of their job: refused ones leave it as it is."""
    return jobs.status_answers(spark, sf_dir)


@query()
def confirmation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every user's store of confirmations (held against a replay in the tests)."""
    return jobs.answers(spark, sf_dir, "confirmations")


@query()
def job_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every user's table of jobs."""
    return jobs.answers(spark, sf_dir, "jobs")


@query()
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every user's store of conversations."""
    return jobs.answers(spark, sf_dir, "conversations")
