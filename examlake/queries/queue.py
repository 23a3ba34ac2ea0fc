"""The work queue over the events table (J series, R18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.plans.model import table
from examlake.registry import query
from examlake.streaming import jobs

_STATES = """last as (select user_id, count(*) filter (event_type in ('click', 'view')) as attempts, count(*) filter (event_type = 'error') as failures,
    max(ts) as last_at, max_by(event_type, (ts, event_id)) as kind from events group by user_id),
states as (select user_id, attempts, failures, last_at, case when kind = 'purchase' then 'completed' when kind = 'signup' then 'queued' when kind = 'error' and failures >= 2 then 'failed' when kind = 'error' then 'queued' else 'processing' end as state from last)"""
_NOW = "2024-01-30 12:00:00"


@query(f"with {_STATES} select user_id, attempts, failures, state, last_at from states")
def jobs_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every job after its events."""
    return jobs.states(table(spark, sf_dir, "events"))


@query(f"with {_STATES} select user_id, last_at from states where state = 'processing' and last_at < timestamp '{_NOW}' - interval 45 minutes")
def jobs_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started jobs that went silent."""
    return jobs.stale(jobs.states(table(spark, sf_dir, "events")), _NOW).select("user_id", "last_at")


@query("select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) as place from events")
def jobs_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the entries of each queue are claimed."""
    return jobs.claim_order(table(spark, sf_dir, "events"), "event_type").select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("""select c_custkey as document_id, event_type as job_type, ts, cast(json_extract_string(props, '$.k') as bigint) as param from customer
left join (select * from events where event_type <> 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) e on e.user_id = c_custkey""")
def latest_active_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its latest unfinished job; the latest is an aggregate, not a window."""
    last = F.max(F.struct("ts", "event_id", "event_type", "props"))
    latest = table(spark, sf_dir, "events").where("event_type <> 'purchase'").groupBy("user_id").agg(last.alias("x"))
    d = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("user_id"), "left")
    return d.select(F.col("c_custkey").alias("document_id"), F.col("x.event_type").alias("job_type"), F.col("x.ts").alias("ts"), F.get_json_object("x.props", "$.k").cast("long").alias("param"))


@query("""with w as (select user_id, event_type, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events)
select user_id, count(*) as steps, cast(sum(epoch_us(ts) - epoch_us(before)) // 1000 as bigint) as busy_ms, cast(max(epoch_us(ts) - epoch_us(before)) // 1000 as bigint) as longest_ms from w where before is not null group by user_id""")
def jobs_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a job's events."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    w = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).alias("us")).where("us is not null")
    return w.groupBy("user_id").agg(F.count("*").alias("steps"), F.expr("sum(us) div 1000").alias("busy_ms"), F.expr("max(us) div 1000").alias("longest_ms"))


@query("select conv_id, list(role || ':' || length(text) order by turn) as thread, count(*) as turns from conversations group by conv_id")
def review_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each review in order."""
    turn = F.struct("turn", F.concat_ws(":", "role", F.char_length("text").cast("string")).alias("t"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn))["t"].alias("thread"), F.count("*").alias("turns"))
