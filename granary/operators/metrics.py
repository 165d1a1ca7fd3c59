"""Dashboard aggregates, in long form (metric, label, value): one pass over each table, by grouping sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import importable

ACTIVE = ("running", "finalizing")


def _long(df: DataFrame, metric: str, label, value) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), label.alias("label"), value.cast("long").alias("value"))


def _unpivot(row: DataFrame, label="") -> DataFrame:
    """One row of totals to rows of (metric, label, value)."""
    names = row.columns
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(label).alias("label"), F.col(n).cast("long").alias("value")) for n in names]))
    return row.select(stacked.alias("x")).select("x.*")


def _by_sets(df: DataFrame, keys: list[str], aggregates: list, names: dict[str, dict[str, str]], totals: dict[str, str]) -> DataFrame:
    """One scan: grouping sets over each key alone and over none; names: key -> {aggregate column: metric}; totals (0 without rows): {aggregate column: metric}."""
    sets = df.groupingSets([*[[F.col(k)] for k in keys], []], *map(F.col, keys)).agg(*aggregates, F.grouping_id().alias("g"))
    everything = (1 << len(keys)) - 1
    entry = lambda g, metric, label, column: F.when(F.col("g") == g, F.struct(F.lit(metric).alias("metric"), label.cast("string").alias("label"), F.col(column).cast("long").alias("value")))
    out = [entry(everything & ~(1 << (len(keys) - 1 - i)), metric, F.col(k), column) for i, k in enumerate(keys) for column, metric in names[k].items()]
    out += [entry(everything, metric, F.lit(""), column) for column, metric in totals.items()]
    long = sets.select(F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("x")).select("x.*").where("value is not null")
    zero = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in totals.values()])).alias("metric"), F.lit("").alias("label"), F.lit(0).cast("long").alias("value"))
    return long.unionByName(zero).groupBy("metric", "label").agg(F.max("value").alias("value"))


def backup_metrics(backups: DataFrame) -> DataFrame:
    return _by_sets(
        backups, ["type", "target_id", "storage_id"],
        [
            F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max(F.unix_seconds(F.col("ended_at").cast("timestamp"))).alias("latest"), F.sum("chunk_count").alias("chunks"),
            F.count_if("protected").alias("protected"),
        ],
        {
            "type": {"n": "backups_by_type"},
            "target_id": {"n": "backups_by_target", "bytes": "backups_bytes_by_target", "latest": "backups_latest_by_target"},
            "storage_id": {"n": "backups_by_storage", "bytes": "backups_bytes_by_storage", "latest": "backups_latest_by_storage"},
        },
        {"n": "backups_total", "bytes": "backups_bytes_total", "chunks": "backups_chunks_total", "protected": "backups_protected", "latest": "backups_latest_completed"},
    )


def job_metrics(jobs: DataFrame) -> DataFrame:
    active = F.col("status").isin(*ACTIVE)
    marked = jobs.select("status", "operation", "agent_id", active.alias("active"))
    sets = _by_sets(
        marked, ["status", "operation", "agent_id"], [F.count("*").alias("n"), F.count_if("active").alias("m")],
        {"status": {"n": "jobs_by_status"}, "operation": {"n": "jobs_by_operation", "m": "jobs_active_by_operation"}, "agent_id": {"m": "jobs_active_by_agent"}}, {"m": "jobs_active"},
    )
    return sets.where("metric = 'jobs_active' or (label <> '' or metric = 'jobs_by_status') and (value > 0 or metric in ('jobs_by_status', 'jobs_by_operation'))")


def inventory_metrics(targets: DataFrame, storages: DataFrame, schedules: DataFrame, policies: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    count = lambda df, metric, key: _long(df.groupBy(key).count(), metric, F.col(key), F.col("count"))
    parts = [
        count(targets, "targets_by_driver", "driver"), count(storages, "storages_by_kind", "kind"), count(schedules, "schedules_by_type", "backup_type"),
        _unpivot(targets.agg(F.count("*").alias("targets_total"))), _unpivot(storages.agg(F.count("*").alias("storages_total"))),
        _unpivot(schedules.agg(F.count("*").alias("schedules_total"), F.count_if("paused").alias("schedules_paused"))),
        _unpivot(policies.agg(F.count("*").alias("retention_policies_total"))),
        _unpivot(rules.agg(F.count("*").alias("notification_rules_total"), F.count_if("enabled").alias("notification_rules_enabled"), F.count_if(~F.col("enabled")).alias("notification_rules_disabled"))),
        _unpivot(users.agg(F.count("*").alias("users_total"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def token_metrics(tokens: DataFrame, now: str) -> DataFrame:
    """A token can be both revoked and expired."""
    at = F.lit(now).cast("timestamp_ntz")
    return _unpivot(tokens.agg(F.count("*").alias("tokens_total"), F.count_if(F.col("revoked_at").isNotNull()).alias("tokens_revoked"), F.count_if(F.col("expires_at") <= at).alias("tokens_expired")))


def agent_metrics(agents: DataFrame) -> DataFrame:
    """agents: (agent_id, capacity, status)."""
    healthy = F.col("status") == "healthy"
    room = F.when(F.col("capacity") <= 0, 1).otherwise(F.col("capacity"))
    return _unpivot(agents.agg(F.count_if(healthy).alias("agents_healthy"), F.count_if(~healthy).alias("agents_degraded"), F.coalesce(F.sum(F.when(healthy, room)), F.lit(0)).alias("agents_capacity")))


def snapshot(parts: list[DataFrame]) -> DataFrame:
    """All metrics in long form."""
    return reduce(DataFrame.unionByName, parts)


def readiness(probes: DataFrame) -> DataFrame:
    """probes (place, store, error; null or blank: fine) to one row: ok if all are, and the first error."""
    bad = F.coalesce(F.trim("error"), F.lit("")) != ""
    return probes.agg(
        F.coalesce(F.bool_and(~bad), F.lit(True)).alias("ok"), F.min(F.when(bad, F.struct("place", "store", "error"))).alias("x"), F.count_if(bad).alias("errors"),
    ).select("ok", "errors", F.col("x.store").alias("first_store"), F.col("x.error").alias("first_error"))


def latest(df: DataFrame, at: str, k: int = 5) -> DataFrame:
    return df.orderBy(F.desc(at), "id").limit(k)


def overview(jobs: DataFrame, backups: DataFrame) -> DataFrame:
    """Status histogram, attention counters and the ids of the latest five of either, as one row. Each side is aggregated to a row before they meet."""
    by = lambda *xs: [F.count_if(F.col("status") == x).alias(f"jobs_{x}") for x in xs]
    j = jobs.agg(*by("queued", "running", "finalizing", "succeeded", "failed", "canceled"), F.count_if(F.col("status").isin(*ACTIVE)).alias("jobs_active"))
    b = backups.agg(
        F.count("*").alias("backups_total"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("backups_bytes"), F.count_if("protected").alias("backups_protected"),
        F.count_if(~F.col("protected")).alias("unprotected_backups"), F.coalesce(F.max(F.unix_seconds(F.col("ended_at").cast("timestamp"))), F.lit(0)).alias("latest_completed"),
    )
    names = lambda df, at, name: latest(df.select("id", at), at).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col(at).cast("timestamp"))).alias("t"), "id"))), lambda x: x["id"]), ",").alias(name))
    return j.crossJoin(b).crossJoin(names(jobs, "queued_at", "latest_jobs")).crossJoin(names(backups, "ended_at", "latest_backups"))


def exposition(long: DataFrame, prefix: str = "granary") -> DataFrame:
    """Lines of the text format, labels sorted; backslash, quote and line break are escaped."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("label", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    line = F.concat(F.lit(prefix + "_"), F.col("metric"), F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{label="'), safe, F.lit('"}'))), F.lit(" "), F.col("value").cast("string"))
    return long.select(F.coalesce("metric", F.lit("")).alias("metric"), F.coalesce("label", F.lit("")).alias("label"), "value").select("metric", "label", line.alias("line")).orderBy("metric", "label")


def freshness_alerts(backups: DataFrame, now: str, hours: int) -> DataFrame:
    """Targets whose newest backup is older than the given hours."""
    newest = backups.groupBy("target_id").agg(F.max("ended_at").alias("newest"))
    return newest.where(F.col("newest") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval '{hours}' hour"))


def nonzero_sorted(long: DataFrame) -> DataFrame:
    return long.where("value <> 0").orderBy(F.desc("value"), "label")


def entropy(df: DataFrame, key: str, data: str) -> DataFrame:
    """Shannon entropy of the bytes of each row's data, in bits."""
    importable(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("data"):
                n = np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=1) if x.is_valid and len(x.as_buffer()) else np.ones(1)
                n = n[n > 0]
                out.append(float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.float64())], names=["key", "entropy"])

    some = df.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data"))
    return some.mapInArrow(work, T.StructType([some.schema["key"], T.StructField("entropy", T.DoubleType())]))


def algorithm_for(entropy_col, empty) -> F.Column:
    """none for what looks random already (over 7.6 bits), else zstd; an empty sample is zstd."""
    return F.when(~empty & (entropy_col > 7.6), "none").otherwise("zstd")
