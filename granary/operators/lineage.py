"""Chains of backups: ancestors, restore plans, parents of due jobs, references of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import checkpoint


def ancestors(start: DataFrame, backups: DataFrame) -> DataFrame:
    """ids of all present ancestors of `start`; missing parents are ignored.

    Path doubling: each round every backup knows an ancestor twice as far up, so a chain of n needs log2(n) rounds, and
    cycles end with no new pairs. Held are pairs (id, ancestor) of backups in question only, without repeats."""
    edges = backups.where("parent_id is not null and parent_id <> ''").select("id", F.col("parent_id").alias("up"))
    edges = checkpoint(edges.join(backups.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    found = checkpoint(start.select("id").distinct())
    jump = edges  # the ancestor 2**k steps up; found holds all ancestors less than 2**k steps up
    while True:
        more = checkpoint(found.join(jump, "id").select(F.col("up").alias("id")).distinct().join(found, "id", "left_anti"))
        if more.isEmpty():
            break
        found = checkpoint(found.union(more))
        jump = checkpoint(jump.toDF("id", "mid").join(jump.toDF("mid", "up"), "mid").select("id", "up"))
    return found.join(edges, "id").select(F.col("up").alias("id")).distinct()


def _jumps(backups: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """([(id, up), ...], endless): the k-th pairs each backup with the ancestor 2**k steps up, if it has so many; `endless` has those whose ancestors run in a cycle.

    In each round some backup of a chain runs out of ancestors, so once none does, those that are left lead into cycles."""
    edges = backups.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    jump = checkpoint(edges.join(backups.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    jumps, left = [], jump.count()
    while left:
        jumps.append(jump)
        jump = checkpoint(jump.toDF("id", "mid").join(jump.toDF("mid", "up"), "mid").select("id", "up"))
        before, left = left, jump.count()
        if left == before:
            return jumps, jump
    return jumps, None


def restore_plans(backups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Steps of the restore of each wanted backup (column backup_id), root first: (backup_id, step_no, id, type, parent_id, manifest_id, problem).

    problem: '' or `missing` (not there), `missing_parent`, `cycle`. Path doubling: a chain of n needs log2(n) rounds, however long it is. The longest jumps come first, so
    all but the last rounds hold few of the steps. A backup's step and what its chain lacks are the same in all chains that hold it: they are worked out once for each backup, not for each step.
    Steps of a cycle are each backup once, by its least depth.
    """
    backups = checkpoint(backups.select("id", "type", "parent_id", "manifest_id"))
    jumps, endless = _jumps(backups)
    asked = wanted.select("backup_id").distinct()
    rows = asked.join(backups.select(F.col("id").alias("backup_id")), "backup_id").select("backup_id", F.col("backup_id").alias("id"))
    if endless is not None:
        turning = rows.join(endless.select(F.col("id").alias("backup_id")), "backup_id", "left_semi").withColumn("depth", F.lit(0).cast("long"))
        rows = rows.join(endless.select(F.col("id").alias("backup_id")), "backup_id", "left_anti")
    ends = backups.select("id", F.col("id").alias("end"), F.lit(1).cast("long").alias("step_no"))
    for k in reversed(range(len(jumps))):
        rows = rows.join(jumps[k], "id", "left").select("backup_id", F.explode(F.array_compact(F.array("id", "up"))).alias("id"))
        above = F.when(F.col("up").isNull(), 0).otherwise(1 << k)
        ends = ends.join(jumps[k].toDF("end", "up"), "end", "left").select("id", F.coalesce("up", "end").alias("end"), (F.col("step_no") + above).alias("step_no"))
        if k and k % 4 == 0:
            rows, ends = checkpoint(rows), checkpoint(ends)
    beyond = backups.select(F.col("id").alias("end"), F.when(F.col("parent_id").isNotNull(), "missing_parent").otherwise("").alias("problem"))
    columns = ["backup_id", "step_no", "id", "type", "parent_id", "manifest_id", "problem"]
    steps = rows.join(backups.join(ends, "id").join(beyond, "end"), "id").select(*columns)
    if endless is not None:
        around = _around(checkpoint(turning), jumps[0]).withColumn("step_no", F.max("depth").over(Window.partitionBy("backup_id")) - F.col("depth") + 1)
        steps = steps.unionByName(around.join(backups, "id").withColumn("problem", F.lit("cycle")).select(*columns))
    missing = asked.join(backups.select(F.col("id").alias("backup_id")), "backup_id", "left_anti")
    none = F.lit(None).cast("string")
    lost = missing.select("backup_id", F.lit(0).cast("long").alias("step_no"), none.alias("id"), none.alias("type"), none.alias("parent_id"), none.alias("manifest_id"), F.lit("missing").alias("problem"))
    return steps.unionByName(lost)


def _around(rows: DataFrame, jump: DataFrame) -> DataFrame:
    """(backup_id, id, depth) of backups whose ancestors run in a cycle, each ancestor once."""
    far = 1
    while True:
        more = rows.join(jump, "id").groupBy("backup_id", F.col("up").alias("id")).agg((F.min("depth") + far).alias("depth"))
        more = checkpoint(more.join(rows.select("backup_id", "id"), ["backup_id", "id"], "left_anti"))
        if more.isEmpty():
            return rows
        rows = checkpoint(rows.union(more))
        jump, far = checkpoint(jump.toDF("id", "mid").join(jump.toDF("mid", "up"), "mid").select("id", "up")), 2 * far


def point_in_time_warning(at: str) -> F.Column:
    """A restore to a point after the backup's end needs stream backups."""
    return F.when(F.lit(at).cast("timestamp_ntz") > F.col("ended_at"), "the backup ends before the wanted instant: changes recorded after it are needed as well")


def attach_parents(due: DataFrame, backups: DataFrame, as_of: bool = False) -> DataFrame:
    """due (id, target_id, storage_id, type[, due_at]) with parent_id: the newest backup (by end, then least id) of the same target and storage
    that has a manifest; only full ones for `diff`. Without one the type becomes full. as_of: only parents that ended by due_at.

    The newest is found by one aggregation before the join; as_of by a last value over backups and due runs of a target and storage in order of time."""
    fits = backups.where("coalesce(manifest_id, '') <> ''")
    if as_of:
        some = fits.where(F.col("type").isin("full", "incr", "diff")).select("target_id", "storage_id", F.col("ended_at").alias("at"), F.col("id").alias("bid"), (F.col("type") == "full").alias("full"), F.lit(None).cast("string").alias("id"))
        asked = due.select("target_id", "storage_id", F.col("due_at").alias("at"), F.lit(None).cast("string").alias("bid"), F.lit(None).cast("boolean").alias("full"), "id")
        # at one instant backups come first, the least id last
        order = Window.partitionBy("target_id", "storage_id").orderBy("at", F.col("bid").isNull(), F.desc("bid")).rowsBetween(Window.unboundedPreceding, 0)
        newest = some.union(asked).select("id", F.last("bid", ignorenulls=True).over(order).alias("a"), F.last(F.when(F.col("full"), F.col("bid")), ignorenulls=True).over(order).alias("f")).where("id is not null")
        out = due.join(newest, "id", "left").withColumn("found", F.when(F.col("type") == "diff", F.col("f")).otherwise(F.col("a"))).drop("f", "a")
    else:
        newest = lambda c: F.min(F.when(c, F.struct((-F.unix_micros(F.col("ended_at").cast("timestamp"))).alias("age"), "id")))["id"]
        best = fits.groupBy("target_id", "storage_id").agg(newest(F.col("type") == "full").alias("f"), newest(F.col("type").isin("full", "incr", "diff")).alias("a"))
        out = due.join(best, ["target_id", "storage_id"], "left").withColumn("found", F.when(F.col("type") == "diff", F.col("f")).otherwise(F.col("a"))).drop("f", "a")
    needs = F.col("type").isin("incr", "diff")
    return out.withColumn("parent_id", F.when(needs, F.col("found"))).withColumn("type", F.when(needs & F.col("found").isNull(), "full").otherwise(F.col("type"))).drop("found")


def chain_refs(steps: DataFrame, refs: DataFrame) -> DataFrame:
    """References of the manifests of a chain, in order of step and place."""
    return steps.where("problem = ''").select("backup_id", "step_no", "manifest_id").join(refs, "manifest_id").orderBy("backup_id", "step_no", "sequence")


def chain_totals(backups: DataFrame, wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """(backup_id, chunks, bytes, steps) of the references of each wanted backup's chain, where it is whole and has any; steps: those with references.

    References are summed up for each manifest, and chains by path doubling: a round adds what the next 2**k steps hold, so rows are as many as backups, however long their chains are."""
    backups = checkpoint(backups.select("id", "parent_id", "manifest_id"))
    jumps, endless = _jumps(backups)
    own = refs.groupBy("manifest_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.lit(1).cast("long").alias("steps"))
    lacks = F.col("parent_id").isNotNull()
    if jumps:
        backups = backups.join(jumps[0].select("id", F.lit(True).alias("linked")), "id", "left")
        lacks = lacks & F.col("linked").isNull()
    sums = backups.join(own, "manifest_id", "left").select("id", "chunks", "bytes", "steps", lacks.alias("open"))
    totals = ("chunks", "bytes", "steps")
    for jump in jumps:
        sums = checkpoint(sums)
        more = jump.join(sums.select(F.col("id").alias("up"), *[F.col(c).alias(f"more_{c}") for c in totals], F.col("open").alias("more_open")), "up").drop("up")
        both = [F.coalesce(F.col(c) + F.col(f"more_{c}"), f"more_{c}", c).alias(c) for c in totals]
        sums = sums.join(more, "id", "left").select("id", *both, (F.col("open") | F.coalesce("more_open", F.lit(False))).alias("open"))
    if endless is not None:
        sums = sums.join(endless, "id", "left_anti")
    asked = wanted.select(F.col("backup_id").alias("id")).distinct()
    return sums.where("not open and chunks > 0").join(asked, "id", "left_semi").select(F.col("id").alias("backup_id"), *totals)
