"""Retention: which backups a policy keeps, and why.

Backups are ranked newest first (by end, else start; ties by id). Rules are or-ed; reasons appear once each, in the order protected,
rules in policy order, then `chain` for an ancestor that only its descendants keep. Every rule is a Column, or one window over
what its ranking needs; `scope` names columns (target, storage) within which the policy holds, so that ranking is per scope and not in
one task; without a scope the backups of the whole table are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.durations import seconds_of
from granary.operators.folds import scan
from granary.operators.lineage import ancestors

KINDS = ("count", "time", "size", "gfs")
#: Bucket of each tier as sortable numbers, newest highest (weeks are ISO weeks).
TIERS = {
    "daily": lambda t: F.date_format(t, "yyyyMMdd").cast("int"),
    "weekly": lambda t: F.extract(F.lit("YEAROFWEEK"), t) * 100 + F.extract(F.lit("WEEK"), t),
    "monthly": lambda t: F.date_format(t, "yyyyMM").cast("int"),
    "yearly": lambda t: F.year(t),
}


def _first(params: dict, *names: str, default=None):
    for n in names:
        if n in params:
            return params[n]
    if default is not None:
        return default
    raise ValueError(f"missing parameter {names[0]}")


def whole_number(x) -> int:
    """Numbers and their text; fractions are cut off."""
    out = int(float(x)) if isinstance(x, str) else int(x)
    if out < 0:
        raise ValueError("must not be negative")
    return out


def ranked(scope: list[str], *more: Column) -> Window:
    return Window.partitionBy(*scope, *more).orderBy(F.desc("t"), "id")


def with_time(backups: DataFrame) -> DataFrame:
    return backups.withColumn("t", F.coalesce("ended_at", "started_at"))


def count_rule(df: DataFrame, params: dict, scope: list[str], out: str) -> DataFrame:
    n = whole_number(_first(params, "n", "keep", "count"))
    of = params.get("type") or None
    fits = F.lit(True) if of is None else F.col("type") == of
    place = F.row_number().over(ranked(scope, fits))
    return df.withColumn(out, F.when(fits & (place <= n), "count"))


def time_rule(df: DataFrame, params: dict, now: str, out: str) -> DataFrame:
    seconds = seconds_of(_first(params, "duration", "younger_than"))
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))
    return df.withColumn(out, F.when(F.col("t") >= cutoff, "time"))


def size_rule(df: DataFrame, params: dict, scope: list[str], out: str) -> DataFrame:
    """Greedy: newest first, a backup that would exceed the rest of the room is skipped and later smaller ones may still fit.

    That depends on each decision before it, so it is a fold over a scope's backups in order."""
    room = whole_number(_first(params, "max_bytes", "bytes"))

    def step(total: int, size: int | None) -> tuple[int, tuple[str | None]]:
        if size is None or total + size > room:
            return total, (None,)
        return total + size, ("size",)

    return scan(df, scope, [F.desc("t"), F.col("id")], {"size": F.when(~F.col("protected"), F.col("size_bytes"))}, 0, step, {out: T.StringType()})


def tier_rule(df: DataFrame, tier: str, n: int, scope: list[str], out: str) -> DataFrame:
    """The newest backup of each of the n newest periods that have one."""
    bucket = TIERS[tier](F.col("t"))
    first = F.row_number().over(ranked(scope, bucket)) == 1
    place = F.dense_rank().over(Window.partitionBy(*scope).orderBy(F.desc("__bucket")))
    return df.withColumn("__bucket", bucket).withColumn(out, F.when(first & (place <= n), f"gfs:{tier}")).drop("__bucket")


def resolve(backups: DataFrame, rules: list[dict], now: str, scope: list[str] | None = None) -> DataFrame:
    """backups with keep and reasons (joined by commas); rules: dicts with kind and params."""
    scope = scope or []
    df = with_time(backups)
    columns = []
    for i, rule in enumerate(rules):
        kind, params, out = rule["kind"], rule.get("params", {}), f"__r{i}"
        if kind == "count":
            df = count_rule(df, params, scope, out)
        elif kind == "time":
            df = time_rule(df, params, now, out)
        elif kind == "size":
            df = size_rule(df, params, scope, out)
        elif kind == "gfs":
            for tier in TIERS:
                if n := whole_number(params.get(tier, 0)):
                    df = tier_rule(df, tier, n, scope, f"{out}_{tier}")
                    columns.append(f"{out}_{tier}")
            continue
        else:
            raise ValueError(f"unsupported retention rule {kind!r}")
        columns.append(out)
    reasons = F.array_distinct(F.array_compact(F.array(F.when(F.col("protected"), "protected"), *columns)))
    df = df.withColumn("reasons", reasons).drop("t", *columns)
    held = ancestors(df.where(F.size("reasons") > 0).select("id", "parent_id"), df.select("id", "parent_id"))
    df = df.join(held.withColumnRenamed("id", "__held"), F.col("id") == F.col("__held"), "left")
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).when(F.col("__held").isNotNull(), F.array(F.lit("chain"))).otherwise(F.col("reasons"))
    return df.withColumn("reasons", F.array_join(reasons, ",")).drop("__held").withColumn("keep", F.col("reasons") != "")


def apply(backups: DataFrame, plan: DataFrame) -> DataFrame:
    """What is left after dropping what the plan doesn't keep."""
    return backups.join(plan.where("not keep").select("id"), "id", "left_anti")
