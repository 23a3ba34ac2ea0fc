"""The work queue as state: leases, retries and stale recovery, over a batch of events or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.plans.tables import kept

#: Attempts after which a failing job fails for good, and how long a started job may stay silent.
MOST_ATTEMPTS, STALE = 2, "45 minutes"


def states(events: DataFrame, job: str = "user_id", kind: str = "event_type", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """``job, attempts, failures, state, last_at``: a job's state after all its events.

    signup queues, click and view start or touch it, purchase completes, error
    fails an attempt and requeues until MOST_ATTEMPTS are used up.  Aggregation
    alone decides, so a job's events never have to be sorted or gathered.
    """
    last = F.max(F.struct(at, tie, F.col(kind).alias("kind")))
    out = events.groupBy(job).agg(F.count_if(F.col(kind).isin("click", "view")).alias("attempts"), F.count_if(F.col(kind) == "error").alias("failures"), last.alias("last"))
    state = (
        F.when(F.col("last.kind") == "purchase", "completed")
        .when(F.col("last.kind") == "signup", "queued")
        .when((F.col("last.kind") == "error") & (F.col("failures") >= MOST_ATTEMPTS), "failed")
        .when(F.col("last.kind") == "error", "queued")
        .otherwise("processing")
    )
    return out.select(job, "attempts", "failures", state.alias("state"), F.col(f"last.{at}").alias("last_at"))


def stale(jobs: DataFrame, now: str) -> DataFrame:
    """Started jobs that have been silent for longer than STALE at ``now``; they go back to the queue."""
    return jobs.where(F.col("state") == "processing").where(F.col("last_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {STALE}"))


def claim_order(events: DataFrame, queue: str, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``place``: where an entry stands in its queue, in the order in which workers claim.

    Entries are dealt over tasks by ranges of that order, so a queue that holds
    most entries is no task of its own: each range counts its own entries from
    where the ranges before it end.
    """
    dealt = kept(events.repartitionByRange(queue, at, tie).withColumn("part", F.spark_partition_id()), "queue-ranges")
    earlier = Window.partitionBy(queue).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(queue, "part").agg(F.count("*").alias("n")).select(queue, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part", queue).orderBy(at, tie))
    return dealt.withColumn("own", place).join(starts, [queue, "part"]).withColumn("place", F.col("own") + F.col("start")).drop("own", "start", "part")


def stream_states(events: DataFrame, path: str, checkpoint: str):
    """Start to keep ``states`` of an event stream as tables: every micro-batch writes the whole new state, which grows with jobs and not with events.

    Each batch has a folder of its own and is named once it is whole, so a reader
    never sees half a state and keeps what it opened; a batch that is run again
    writes the same folder.  Folders older than any reader are the caller's to remove.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        batch.sparkSession.range(number, number + 1).coalesce(1).write.mode("append").parquet(f"{path}/named")

    return states(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The state that ``stream_states`` named last under ``path``."""
    newest = spark.read.schema("id long").parquet(f"{path}/named").agg(F.max("id")).first()[0]
    return spark.read.parquet(f"{path}/batch-{newest}")
