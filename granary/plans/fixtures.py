"""The service's tables, derived from the star-schema test tables.

Each is one SQL text that Spark and DuckDB both run (`{sha256:x}` stands for the hex digest of x in either), so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import table

#: The instant that stands for now in queries.
NOW = "2024-01-05 00:00:00"
#: The instant that stands for now where backups are concerned.
RETENTION_NOW = "1998-08-01 00:00:00"

SQL: dict[str, str] = {
    "backups": """
select concat('b-', cast(l.k as varchar(20))) as id, concat('t-', cast(l.tgt as varchar(20))) as target_id, concat('s-', cast(l.sto as varchar(20))) as storage_id,
       concat('j-', cast(l.k as varchar(20))) as job_id, l.type,
       case l.type when 'incr' then concat('b-', cast(l.prev_k as varchar(20))) when 'diff' then concat('b-', cast(f.k as varchar(20))) end as parent_id,
       concat('m-', cast(l.k as varchar(20))) as manifest_id,
       l.ended_at - interval '5' minute as started_at, l.ended_at, l.size_bytes, l.k % 40 as chunk_count,
       l.st = 'P' and l.k % 10 = 0 as protected
from (
  select *, lag(k) over (partition by tgt, sto order by ended_at, k) as prev_k,
         max(case when type = 'full' then ended_at end) over (partition by tgt, sto order by ended_at, k rows between unbounded preceding and current row) as last_full_at
  from (
    select *, case when row_number() over (partition by tgt, sto order by ended_at, k) = 1 then 'full'
                   when pr = '1-URGENT' then 'full' when pr = '2-HIGH' then 'diff' else 'incr' end as type
    from (
      select o_orderkey as k, o_custkey % 20 as tgt, o_custkey % 3 as sto, o_orderstatus as st, o_orderpriority as pr,
             o_orderdate + interval '1' second * (o_orderkey % 86400) as ended_at,
             cast(floor(o_totalprice * 100) as bigint) as size_bytes
      from orders) base) typed) l
left join (
  select tgt, sto, ended_at, min(k) as k from (
    select *, case when row_number() over (partition by tgt, sto order by ended_at, k) = 1 then 'full'
                   when pr = '1-URGENT' then 'full' when pr = '2-HIGH' then 'diff' else 'incr' end as type
    from (
      select o_orderkey as k, o_custkey % 20 as tgt, o_custkey % 3 as sto, o_orderpriority as pr,
             o_orderdate + interval '1' second * (o_orderkey % 86400) as ended_at
      from orders) base2) typed2
  where type = 'full' group by tgt, sto, ended_at) f
on f.tgt = l.tgt and f.sto = l.sto and f.ended_at = l.last_full_at""",
    "chunk_refs": """
select concat('m-', cast(l_orderkey as varchar(20))) as manifest_id, cast(l_linenumber as bigint) as sequence,
       {sha256:concat('chunk-', cast(l_partkey % 500 as varchar(20)), '-', cast(l_suppkey as varchar(20)))} as hash,
       cast(l_quantity * 4096 as bigint) as size
from lineitem""",
    "jobs": """
select concat('j-', cast(event_id as varchar(20))) as id,
       case when event_id % 10 < 6 then 'backup' when event_id % 10 < 8 then 'verify' when event_id % 50 = 9 then '' else 'restore' end as operation,
       case event_type when 'error' then 'failed' when 'view' then 'succeeded' when 'click' then 'queued' when 'purchase' then (case when event_id % 9 = 0 then 'finalizing' else 'running' end) else 'canceled' end as status,
       concat('t-', cast(user_id % 150 as varchar(20))) as target_id, concat('s-', cast(user_id % 3 as varchar(20))) as storage_id,
       case when event_id % 11 = 0 then '' else concat('a-', cast(user_id % 7 as varchar(20))) end as agent_id, ts as queued_at,
       case when event_type = 'error' then 'driver failed' else '' end as error,
       case when event_id % 4 = 0 then concat('b-', cast(event_id % 97 as varchar(20))) else '' end as restore_backup_id
from events""",
    "audit_events": """
select cast(row_number() over (order by ts, event_id) as bigint) as seq, concat('e-', cast(event_id as varchar(20))) as id, concat('u-', cast(user_id as varchar(20))) as actor_id,
       concat('job.', event_type) as action, case when event_id % 3 = 0 then 'backup' else 'job' end as resource_type,
       concat('j-', cast(event_id as varchar(20))) as resource_id, props as metadata_json, ts as occurred_at
from events""",
    "heartbeats": """
select concat('a-', cast(user_id % 70 as varchar(20))) as agent_id, cast(event_id % 4 as int) as capacity, ts as heartbeat_at, event_id as arrival
from events where event_type = 'view'""",
    "targets": """
select concat('t-', cast(c_custkey as varchar(20))) as id, case when c_custkey % 17 = 0 then '' else c_name end as name,
       case c_custkey % 4 when 0 then 'postgres' when 1 then 'mysql' when 2 then 'mongodb' else 'redis' end as driver,
       case when c_custkey % 5 = 0 then concat(' a-', cast(c_custkey % 7 as varchar(20))) else '  ' end as agent_label,
       c_mktsegment as tier, timestamp '2023-06-01 00:00:00' + interval '1' hour * c_custkey as created_at
from customer""",
    "storages": """
select concat('s-', cast(s_suppkey as varchar(20))) as id, s_name as name,
       case s_suppkey % 5 when 0 then 'local' when 1 then 's3' when 2 then 'sftp' when 3 then 'azure' else 'gcs' end as kind,
       case s_suppkey % 5 when 0 then concat('file:///srv/', s_name) when 1 then concat('s3://bucket-', cast(s_suppkey as varchar(20))) when 2 then 'sftp://host/path'
            when 3 then 'azure:///nothost' else concat('ftp://', s_name) end as uri
from supplier""",
    "schedules": """
select concat('sc-', cast(p_partkey as varchar(20))) as id, p_name as name, concat('t-', cast(p_partkey % 150 as varchar(20))) as target_id,
       concat('s-', cast(p_partkey % 3 as varchar(20))) as storage_id,
       case when p_size % 3 = 0 then 'full' when p_size % 3 = 1 then 'incr' else 'diff' end as backup_type,
       cast(p_size % 60 as int) as minute_of_hour, cast(p_partkey % 24 as int) as hour_of_day, p_size % 5 = 0 as paused,
       timestamp '2024-01-04 00:00:00' + interval '1' minute * (p_partkey % 1000) as created_at,
       case p_partkey % 3 when 0 then 'skip' when 1 then 'queue' else 'run_once' end as catch_up_policy
from part""",
    "users": """
select concat('u-', cast(c_custkey as varchar(20))) as id, concat(lower(c_mktsegment), cast(c_custkey % 90 as varchar(20)), '@example.org') as email,
       case when c_custkey % 3 = 0 then 'admin' when c_custkey % 3 = 1 then 'operator' else 'viewer' end as role
from customer""",
    "tokens": """
select concat('k-', cast(o_orderkey as varchar(20))) as id, concat('u-', cast(o_custkey as varchar(20))) as user_id, o_orderpriority as name,
       o_orderdate as created_at, case when o_orderstatus = 'F' then o_orderdate + interval '3' day end as revoked_at,
       case when o_orderkey % 3 = 0 then o_orderdate + interval '90' day end as expires_at,
       case o_orderkey % 5 when 0 then 'backup:*, audit:read' when 1 then ' *' when 2 then 'job:read,, job:read,backup:read' when 3 then 'admin:*' else 'metrics:read' end as scopes
from orders""",
    "notification_rules": """
select concat('n-', cast(n_nationkey as varchar(20))) as id, n_name as name, n_nationkey % 4 <> 0 as enabled,
       case n_regionkey when 0 then 'job.failed' when 1 then 'job.succeeded,job.failed' when 2 then 'job.canceled' else 'job.succeeded,job.canceled,job.failed' end as events
from nation""",
    "policies": "select concat('p-', cast(r_regionkey as varchar(20))) as id, r_name as name from region",
    "objects": """
select concat('data/', substr(hash, 1, 2), '/', substr(hash, 3, 2), '/', hash) as object_key, max(size) as size
from (select {sha256:concat('chunk-', cast(l_partkey % 500 as varchar(20)), '-', cast(l_suppkey as varchar(20)))} as hash, cast(l_quantity * 4096 as bigint) as size, l_partkey
      from lineitem) x where l_partkey % 13 <> 0 group by hash""",
}
SOURCES = {
    "backups": ["orders"], "chunk_refs": ["lineitem"], "jobs": ["events"], "audit_events": ["events"], "heartbeats": ["events"], "targets": ["customer"],
    "storages": ["supplier"], "schedules": ["part"], "users": ["customer"], "tokens": ["orders"], "notification_rules": ["nation"], "policies": ["region"], "objects": ["lineitem"],
}


def _engine(sql: str, spark: bool) -> str:
    out = re.sub(r"\{sha256:((?:[^{}])*)\}", r"sha2(\1, 256)" if spark else r"sha256(\1)", sql)
    return out.replace("varchar(20)", "string") if spark else out


#: How the texts number a log; Spark does that without sorting all of it in one task.
NUMBER = "row_number() over (order by ts, event_id)"


def numbered(events: DataFrame) -> DataFrame:
    """events with `__number`, their place by ts and event_id from 1 on: within each minute, behind all that the minutes before hold. Only the counts of minutes are put in one order."""
    minute = F.date_trunc("minute", "ts")
    counts = events.groupBy(minute.alias("__at")).agg(F.count("*").alias("__n"))
    before = counts.select("__at", (F.sum("__n").over(Window.orderBy("__at")) - F.col("__n")).alias("__before"))
    within = events.withColumns({"__minute": minute, "__within": F.row_number().over(Window.partitionBy(minute).orderBy("ts", "event_id"))})
    return within.join(before, F.col("__minute").eqNullSafe(F.col("__at"))).withColumn("__number", F.col("__before") + F.col("__within")).drop("__minute", "__at", "__before", "__within")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as DataFrame."""
    text = _engine(SQL[name], spark=True)
    given = {s: table(spark, sf_dir, s) for s in SOURCES[name]}
    if NUMBER in text:
        text, given["events"] = text.replace(NUMBER, "__number"), numbered(given["events"])
    for source in SOURCES[name]:
        text = re.sub(rf"\b(from|join) {source}\b", rf"\1 {{{source}}}", text)
    df = spark.sql(text, **given)
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def with_tables(names: str, query: str) -> str:
    """A DuckDB query over derived tables."""
    ctes = ", ".join(f"{n} as ({_engine(SQL[n], spark=False)})" for n in names.split())
    query = query.strip()
    if query.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {query[14:]}"
    if query.lower().startswith("with "):
        return f"with {ctes}, {query[4:]}"
    return f"with {ctes} {query}"
