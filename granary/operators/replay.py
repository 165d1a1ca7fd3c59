"""Replay of captured change streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.folds import scan


def until(records: DataFrame, stream: list[str], order: list[str], stop: Column, inclusive: bool = False) -> DataFrame:
    """Records of each stream, in order, up to the first that stops: without it, or with it (`inclusive`).

    The first stop is an aggregate per stream, joined back: no running window over a whole stream in one task."""
    place = F.struct(*order)
    first = records.where(F.coalesce(stop, F.lit(False))).groupBy(*stream).agg(F.min(place).alias("__stop"))
    df = records.join(first, stream, "left")
    before = place <= F.col("__stop") if inclusive else place < F.col("__stop")
    return df.where(F.col("__stop").isNull() | before).drop("__stop")


def stops(position: Column, at: Column, target_position=None, target_time: str | None = None, equal_only: bool = False) -> Column:
    """A record stops a replay if its instant is after the target's, or its position (a number) reaches the target's (`equal_only`: is it)."""
    out = F.lit(False)
    if target_time is not None:
        out = out | (at > F.lit(target_time).cast("timestamp_ntz"))
    if target_position is not None:
        out = out | ((position == target_position) if equal_only else (position >= target_position))
    return out


def last_changes(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key, deletes included."""
    columns = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*key, "x.*")


def applied(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """State after changes (operation: insert, update, replace, delete): the last change of each key, unless it deletes."""
    return last_changes(changes, key, order).where("operation <> 'delete'")


def resume_points(records: DataFrame, stream: list[str], position: str) -> DataFrame:
    """Where a capture of each stream goes on: its last position, as a manifest keeps it (column marker)."""
    return records.groupBy(*stream).agg(F.max(position).alias("marker"))


def resumed(records: DataFrame, points: DataFrame, stream: list[str], position: str) -> DataFrame:
    """Records after their stream's resume point; all of a stream that has none."""
    return records.join(points, stream, "left").where(F.col("marker").isNull() | (F.col(position) > F.col("marker"))).drop("marker")


def rate_limited(requests: DataFrame, client: str, at: str, window_seconds: int, limit: int, tie: str) -> DataFrame:
    """requests with `allowed`: a client's window starts with its first request and again with the first one that comes when it has
    run out; within it the first `limit` are let through.

    Where a window starts depends on the one before, so a client's requests are folded in order, with two numbers as state."""
    width = window_seconds * 1_000_000

    def step(state: tuple[int | None, int], t: int) -> tuple[tuple[int | None, int], tuple[bool]]:
        first, n = state
        if first is None or t - first >= width:
            return (t, 1), (True,)
        return (first, n + (n < limit)), (n < limit,)

    return scan(requests, [client], [F.col(at), F.col(tie)], {"t": F.unix_micros(F.col(at).cast("timestamp"))}, (None, 0), step, {"allowed": T.BooleanType()})
