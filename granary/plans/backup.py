"""The flow of a backup: chunks, duplicates left out before encoding, objects put if absent, references and totals.

Everything is decided on chunk references (stream, place, size, hash): which chunk of equal ones is stored, what exists, places, totals. Only then are the
bytes of the chosen chunks cut out of their streams. So the exchanges move references, whose size doesn't depend on the payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import chunking
from granary.operators import integrity, lineage
from granary.session import checkpoint

#: Lists of chunks to cut out are broadcast up to this many chunks (about 150 bytes each).
BROADCAST_CHUNKS = 500_000


def references(streams: DataFrame, algo: str = "sha256", sizes: tuple[int, int, int] = (chunking.MIN, chunking.AVERAGE, chunking.MAX)) -> DataFrame:
    """(stream, part, offset, size, hash, algo) of the chunks of streams (stream, data), kept in the shared folder. A stream's name may occur once."""
    parts = chunking.chunks(streams, "stream", "data", *sizes, algo=algo).withColumnsRenamed({"key": "stream", "sequence": "part"})
    kept = checkpoint(parts)
    twice = kept.where("part = 0").groupBy("stream").count().where("count > 1").first()
    if twice:
        raise ValueError(f"more than one stream is named {twice['stream']}")
    return kept


def uploaded(refs: DataFrame, streams: DataFrame, existing: DataFrame, key: Column, key_id: Column, algorithm: Column, broadcast: int = BROADCAST_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(references, objects to write) of refs (manifest_id, sequence, hash, algo, size, stream, offset) into streams (stream, data).

    A chunk whose object exists or comes earlier in the run is a duplicate: it is neither encoded nor stored, and its stored_size is 0. The chosen chunks are
    listed by stream and joined to the streams: by broadcast while they are few (counted first), else by the stream's name, which moves no
    bytes either where the streams are a table bucketed by it; else the streams that have something to store are exchanged once."""
    place = F.struct("manifest_id", "sequence")
    refs = refs.withColumn("object_key", integrity.object_key(F.col("hash")))
    first = refs.groupBy("object_key").agg(F.min_by(F.struct("manifest_id", "sequence", "stream", "offset", "size", "hash"), place).alias("first"))
    there = existing.select("object_key", F.lit(True).alias("there")).distinct()
    first = checkpoint(first.join(there, "object_key", "left").select("object_key", "first", F.coalesce("there", F.lit(False)).alias("there")))
    chosen = first.where(~F.col("there")).select("object_key", "first.stream", "first.offset", "first.size", "first.hash")
    lists = chosen.groupBy("stream").agg(F.collect_list(F.struct("object_key", "offset", "size", "hash")).alias("cuts"))
    cut = streams.select("stream", "data").join(F.broadcast(lists) if chosen.count() <= broadcast else lists, "stream").select("data", F.explode("cuts").alias("c"))
    data = F.substring(F.col("data"), (F.col("c.offset") + 1).cast("int"), F.col("c.size").cast("int"))
    nonce = F.unhex(F.substring("c.hash", 1, 24))  # a key seals each content once
    envelope = chunking.sealed(chunking.compressed(data, algorithm), key, key_id, nonce, F.col("c.hash").cast("binary"))
    objects = cut.select("c.object_key", algorithm.alias("algorithm"), envelope.alias("envelope"))
    sizes = objects.select("object_key", F.length("envelope").cast("long").alias("written"))
    flags = refs.join(first, "object_key").withColumn("duplicate", F.col("there") | (place != F.struct("first.manifest_id", "first.sequence"))).drop("first", "there")
    return flags.join(sizes, "object_key", "left").withColumn("stored_size", F.when(F.col("duplicate"), F.lit(0)).otherwise(F.col("written"))).drop("written"), objects


def placed(parts: DataFrame) -> DataFrame:
    """parts (target_id, name, part, ...) with `sequence`: their place among the target's, by name and part. Chunks are counted for each stream; only these counts are put in order."""
    counts = parts.groupBy("target_id", "name").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("target_id").orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(counts.select("target_id", "name", F.coalesce(before, F.lit(0)).alias("before")), ["target_id", "name"]).withColumn("sequence", F.col("before") + F.col("part")).drop("before")


def run(
    requests: DataFrame, streams: DataFrame, backups: DataFrame, existing: DataFrame, key: Column, key_id: Column, algorithm: Column, algo: str = "sha256"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, references, objects to write) of backup requests (id, target_id, storage_id, type) over streams (target_id, name, data).

    An incremental or differential one without a parent becomes full, and the manifest records what it was. Places in a manifest follow the names of its streams. Ids of requests are distinct.

    All requests of a target have the same chunks at the same places, so of a target's manifests only the first can hold a chunk's first place: that one alone is looked up in the
    index, the others' chunks are duplicates. Totals are counted for each target; what grows with requests times chunks are the references alone, where they are asked for."""
    actual = lineage.attach_parents(requests.select("id", "target_id", "storage_id", "type"), backups).withColumn("manifest_id", F.concat(F.lit("m-"), "id"))
    named = streams.select(F.to_json(F.struct("target_id", "name")).alias("stream"), "data")
    wanted = checkpoint(actual.groupBy("target_id").agg(F.min("manifest_id").alias("manifest_id")))
    parts = references(named, algo)
    parts = checkpoint(placed(parts.select("*", F.from_json("stream", "target_id string, name string").alias("s")).select("s.*", "part", "stream", "offset", "size", "hash", "algo")))
    columns = ["manifest_id", "sequence", "hash", "algo", "size", "stream", "offset"]
    first, objects = uploaded(parts.join(wanted, "target_id").select(*columns), named, existing, key, key_id, algorithm)
    others = parts.join(actual.select("target_id", "manifest_id").join(wanted, ["target_id", "manifest_id"], "left_anti"), "target_id").select(*columns)
    again = others.withColumns({"object_key": integrity.object_key(F.col("hash")), "duplicate": F.lit(True), "stored_size": F.lit(0).cast("long")})
    refs = first.unionByName(again.select(*first.columns))
    sizes = parts.groupBy("target_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes_in"))
    fresh = first.groupBy("manifest_id").agg(F.count_if(~F.col("duplicate")).alias("uploaded_chunks"))
    manifests = actual.join(sizes, "target_id", "left").join(fresh, "manifest_id", "left").fillna(0, ["chunks", "bytes_in", "uploaded_chunks"])
    return manifests, refs, objects
