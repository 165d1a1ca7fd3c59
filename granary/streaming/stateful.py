"""Change events folded into a table, and what a snapshot of agents says. Keyed states with timers are in `scheduler` and `expiring`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def liveness(snapshot: DataFrame, now: str, seconds: int = 30) -> DataFrame:
    late = F.col("heartbeat_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval '{seconds}' second")
    return snapshot.withColumn("status", F.when(late, "degraded").otherwise("healthy"))


def pruned(snapshot: DataFrame, now: str, max_age_seconds: int) -> DataFrame:
    return snapshot.where(F.col("heartbeat_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval '{max_age_seconds}' second"))


def apply_changes(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, compact: int = 50):
    """Fold change events into a table: the last change of a key wins, deletes remove. Read it with `current`.

    Each batch writes the last change of the keys it has, in a folder of its own, so its cost follows the batch and not the table; every `compact`
    batches all are folded into one base. A repeated batch writes its folders again."""
    from granary.operators.replay import last_changes

    def fold(batch: DataFrame, number: int) -> None:
        last_changes(batch, key, [order]).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if number % compact == compact - 1:
            _folded(batch.sparkSession, path, key, order, number, below=True).write.mode("overwrite").parquet(f"{path}/base/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def _batches(spark, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
    done = [n for n in names if n.startswith("batch=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def _folded(spark, path: str, key: list[str], order: str, upto: int | None = None, below: bool = False) -> DataFrame:
    from granary.operators.replay import last_changes

    bases = [n for n in _batches(spark, f"{path}/base") if upto is None or (n < upto if below else n <= upto)]
    since = bases[-1] if bases else -1
    fresh = [n for n in _batches(spark, f"{path}/changes") if n > since and (upto is None or n <= upto)]
    folders = [f"{path}/base/batch={since}"] * bool(bases) + [f"{path}/changes/batch={n}" for n in fresh]
    if not folders:
        raise ValueError(f"no batch below {path}")
    return last_changes(spark.read.parquet(*folders), key, [order])


def current(spark, path: str, key: list[str], order: str) -> DataFrame:
    """The table that `apply_changes` keeps: the newest base and the changes since."""
    return _folded(spark, path, key, order).where("operation <> 'delete'")
