"""The job state machine: guarded updates of whole tables; a move that isn't allowed is a violation row, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.admission import active

TERMINAL = ("succeeded", "failed", "canceled")


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _update(df: DataFrame, hit: Column, **values: Column) -> DataFrame:
    df = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    for c, v in values.items():
        old = F.col(c) if c in df.columns else F.lit(None)
        df = df.withColumn(c, F.when(F.col("__hit"), v).otherwise(old))
    return df.drop("__hit")


def _requested(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (id, ...); one each."""
    return jobs.join(requests.withColumn("__asked", F.lit(True)), "id", "left")


def start(jobs: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests: (id, on_agent). queued becomes running."""
    df = _requested(jobs, requests)
    return _update(df, F.col("__asked") & (F.col("status") == "queued"), agent_id=F.col("on_agent"), started_at=_at(now), status=F.lit("running")).drop("__asked", "on_agent")


def finish(jobs: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests: (id, final, message). What isn't at an end takes a final state."""
    df = _requested(jobs, requests)
    ok = F.col("__asked") & ~F.col("status").isin(*TERMINAL) & F.col("final").isin(*TERMINAL)
    return _update(df, ok, ended_at=_at(now), error=F.col("message"), status=F.col("final")).drop("__asked", "final", "message")


def retry(jobs: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests: (id). failed and canceled go back to the queue."""
    df = _requested(jobs, requests)
    none = F.lit(None).cast("timestamp_ntz")
    return _update(df, F.col("__asked") & F.col("status").isin("failed", "canceled"), queued_at=_at(now), started_at=none, ended_at=none, error=F.lit(""), agent_id=F.lit(""), status=F.lit("queued")).drop("__asked")


def recover(jobs: DataFrame, now: str, reason: str = "server_lost") -> DataFrame:
    """After a restart all active jobs have failed."""
    return _update(jobs, active(), ended_at=_at(now), error=F.lit(reason or "server_lost"), status=F.lit("failed"))


def illegal(jobs: DataFrame, requests: DataFrame, move: str) -> DataFrame:
    """Requests that the state of their job doesn't allow: (id, status, problem)."""
    allowed = {"start": F.col("status") == "queued", "finish": ~F.col("status").isin(*TERMINAL), "retry": F.col("status").isin("failed", "canceled")}[move]
    df = requests.select("id").join(jobs.select("id", "status"), "id", "left")
    return df.withColumn("problem", F.when(F.col("status").isNull(), "not_found").when(~allowed, F.concat(F.lit("is_"), F.col("status")))).where("problem is not null")


def backup_requests(requests: DataFrame) -> DataFrame:
    """requests (target_id, storage_id, type, parent_id; blank: not given) with the type filled in and `problem`."""
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    kind = F.when(given("type"), F.col("type")).when(given("parent_id"), "incr").otherwise("full")
    df = requests.withColumn("type", kind)
    problem = (
        F.when(~given("target_id"), "no target given").when(~given("storage_id"), "no storage given").when(~F.col("type").isin("full", "incr", "diff"), "unknown type")
        .when((F.col("type") == "full") & given("parent_id"), "a full backup has no parent")
        .when(F.col("type").isin("incr", "diff") & ~given("parent_id"), "this type needs a parent").otherwise("")
    )
    return df.withColumn("problem", problem)


def with_report_defaults(jobs: DataFrame) -> DataFrame:
    """Finished restore and verify jobs get the backup they are about and a level, where the agent left them out."""
    about = F.when(F.col("operation").isin("restore", "verify") & F.col("status").isin(*TERMINAL), F.coalesce(F.nullif(F.col("restore_backup_id"), F.lit("")), F.lit("unknown")))
    level = F.when((F.col("operation") == "verify") & F.col("status").isin(*TERMINAL), F.lit("manifest"))
    return jobs.withColumn("report_backup_id", about).withColumn("report_level", level)


def deliveries(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Finished jobs with the enabled rules that listen to their event: an equi-join on the event, rules being exploded to their events."""
    from granary.operators.catalog import event_of

    events = jobs.withColumn("event", event_of(F.col("status"))).where("event is not null")
    listening = rules.where("enabled").select(F.col("id").alias("rule_id"), F.explode(F.array_distinct(F.split("events", ","))).alias("event"))
    return events.join(listening, "event").select("id", "rule_id", "event")
