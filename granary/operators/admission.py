"""Which queued job may run next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.metrics import ACTIVE

DEGRADED_AFTER = 30


def active() -> Column:
    return F.col("status").isin(*ACTIVE)


def agents(heartbeats: DataFrame, now: str, seconds: int = DEGRADED_AFTER) -> DataFrame:
    """Last heartbeat of each agent by arrival, and its state: degraded once the last is more than `seconds` ago."""
    last = heartbeats.groupBy("agent_id").agg(F.max_by(F.struct("capacity", "heartbeat_at"), "arrival").alias("x")).select("agent_id", "x.capacity", "x.heartbeat_at")
    late = F.col("heartbeat_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval '{seconds}' second")
    return last.withColumn("status", F.when(late, "degraded").otherwise("healthy"))


def fail_lost(jobs: DataFrame, agents: DataFrame, now: str) -> DataFrame:
    """Active jobs of degraded agents fail with agent_lost."""
    lost = agents.where("status = 'degraded'").select(F.col("agent_id").alias("__lost"))
    df = jobs.join(lost, (F.col("agent_id") == F.col("__lost")) & (F.col("agent_id") != ""), "left")
    hit = F.col("__lost").isNotNull() & active()
    return df.withColumn("error", F.when(hit, "agent_lost").otherwise(F.col("error"))).withColumn("ended_at", F.when(hit, F.lit(now).cast("timestamp_ntz"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("__lost")


def not_busy(jobs: DataFrame) -> DataFrame:
    """Queued jobs whose target has no active job (one's own state doesn't count; no target is never busy)."""
    running = jobs.where(active()).select(F.col("target_id").alias("__t")).where("coalesce(__t, '') <> ''").distinct()
    queued = jobs.where("status = 'queued'")
    return queued.join(running, F.col("target_id") == F.col("__t"), "left_anti")


def fits_agent(jobs: DataFrame, targets: DataFrame, agent_id: str) -> DataFrame:
    """Jobs whose target is bound to no other agent; jobs of unknown targets fit."""
    if not agent_id:
        return jobs
    label = targets.select(F.col("id").alias("__t"), F.trim("agent_label").alias("__label"))
    df = jobs.join(label, F.col("target_id") == F.col("__t"), "left")
    return df.where(F.coalesce("__label", F.lit("")).isin("", agent_id)).drop("__t", "__label")


def claim(jobs: DataFrame, targets: DataFrame, agents: DataFrame, agent_id: str, now: str) -> DataFrame:
    """The job that an agent gets, or none: after lost jobs have failed, if there is room among the healthy agents (an unknown
    capacity doesn't limit), the first queued one, by (queued_at, id), on an idle target that fits the agent."""
    state = fail_lost(jobs, agents, now)
    room = agents.where("status = 'healthy'").agg(F.coalesce(F.sum(F.when(F.col("capacity") <= 0, 1).otherwise(F.col("capacity"))), F.lit(0)).alias("__room"))
    used = state.agg(F.count_if(active()).alias("__used"))
    first = fits_agent(not_busy(state), targets, agent_id).orderBy("queued_at", "id").limit(1)
    # three tables of one row each
    return first.crossJoin(room).crossJoin(used).where("__room <= 0 or __used < __room").drop("__room", "__used")


def ready(jobs: DataFrame) -> DataFrame:
    """The first queued job of each idle target; jobs without target don't wait for each other."""
    idle = not_busy(jobs)
    alone = F.when(F.coalesce("target_id", F.lit("")) == "", F.col("id")).otherwise(F.col("target_id"))
    return idle.withColumn("__n", F.row_number().over(Window.partitionBy(alone).orderBy("queued_at", "id"))).where("__n = 1").drop("__n")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").groupBy("target_id").agg(F.count("*").alias("pending"))
