"""What the operators of this subpackage share: tables, checkpoints, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import checkpoint, importable, shared_dir, table

__all__ = ["MAX_PARTS", "by_number", "checkpoint", "components", "dealt", "importable", "lookup", "shared_dir", "table"]

#: Partitions of a shuffle at most. Beyond, a partition has several shards, sorted, and a task works on one after the other.
MAX_PARTS = 20_000


def dealt(df: DataFrame, column: str, numbers: int, most: int = MAX_PARTS) -> DataFrame:
    """Rows by the number (a shard) in a column: about one shard a partition, or where there are too many, several in order."""
    out = df.repartition(min(numbers, most), column)
    return out.sortWithinPartitions(column) if numbers > most else out


def by_number(batches: Iterator[pa.RecordBatch], ordered: bool) -> Iterator[tuple[int, list[list]]]:
    """(number, rows) of each shard in a partition, the number being the first column; in order, one shard is held at a time."""
    found: dict[int, list] = {}
    for batch in batches:
        for s, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if ordered and found and s not in found:
                yield found.popitem()
            found.setdefault(s, []).append(row)
    batch = row = None  # else the last batch is held as long as the rows
    for s in sorted(found):
        yield s, found.pop(s)


#: A key is hot if it has more than one row in so many; there are fewer such keys than this.
HOT = 1000


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """rows with the other columns of values (one row a key), null where there is none. counts: (keys, n), how many rows a key has, at least of those with many.

    The values of hot keys are broadcast: under HOT rows, whatever the size of the tables. All other keys are joined by a shuffle, in which rows that have
    their value already, and rows with a null key, go by numbers of their own."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    more = [c for c in values.columns if c not in keys]
    hot = values.join(F.broadcast(counts.where(F.col("n") * HOT > total).select(keys)), keys, "left_semi")
    hot = hot.select(*keys, F.struct(*more).alias("__hot"))
    known = rows.join(F.broadcast(hot), keys, "left")
    free = F.col("__hot").isNotNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    known = known.withColumn("__to", F.when(free, F.monotonically_increasing_id() + 1).otherwise(0))
    cold = values.select(*keys, F.struct(*more).alias("__cold"), F.lit(0).cast("long").alias("__to"))
    value = F.coalesce("__hot", "__cold")
    return known.join(cold, [*keys, "__to"], "left").select(*rows.columns, *[value[c].alias(c) for c in more])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (u, v), longs: rows (node, component), component the least node.

    Randomised contraction: in every round a node hangs itself on the neighbour (or itself) with the least
    hash, the links move to the parents, and loops and repeats fall away. A star collapses in one round, a
    chain shrinks by a constant factor. Neighbour minima are aggregated before the shuffle, so a hub with a
    third of all links costs one row for each task. Nodes without a link to another node don't occur in the result.
    """
    spark = edges.sparkSession
    left = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    left = checkpoint(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    parents: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(parents))
        rank = lambda c: F.struct(F.xxhash64(turn, c).alias("rank"), c.alias("node"))
        both = left.select("u", "v").union(left.select(F.col("v"), F.col("u")))
        nearest = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        parent = checkpoint(nearest.select(F.col("u").alias("node"), F.least(F.col("m"), rank(F.col("u")))["node"].alias("parent")))
        parents.append(parent)
        moved = left.join(parent.toDF("u", "pu"), "u").join(parent.toDF("v", "pv"), "v").where("pu <> pv")
        left = checkpoint(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not parents:
        return spark.createDataFrame([], "node long, component long")
    labels = parents[0].toDF("node", "root")
    for parent in parents[1:]:
        labels = labels.join(parent.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    labels = checkpoint(labels)
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return checkpoint(labels.join(least, "root").select("node", "component"))
