"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import free_name, partitions
from cleargrain.session import staged_path

# Slots of the lookup table: a prime well above 100 x the number of shards, so that shares differ by about 1 %.
SLOTS = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot.

    Every shard has its own order of preference over the slots, start + k x step modulo the prime ``slots``. The shards
    take turns; at its turn a shard claims the first slot of its order that is still free. Turns keep the shares equal
    within one slot, and orders that depend on the shard's name alone keep most slots in place when a shard comes or goes.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    words = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(w[:8], "big") % slots for w in words]
    step = [int.from_bytes(w[8:16], "big") % (slots - 1) + 1 for w in words]
    owner, free, turn = [-1] * slots, slots, 0
    while free:
        while owner[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % slots
        owner[at[turn]] = turn
        free, turn = free - 1, (turn + 1) % len(shards)
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5 modulo the prime; a null key counts as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots).cast("bigint"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with two more columns: the slot and the shard's index of each row, by the column ``key``.

    The broadcast side has ``slots`` rows of 12 bytes whatever the data's size. Rows with equal keys share a shard.
    """
    spark = df.sparkSession
    owners = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"`{slot}` bigint, `{shard}` int")
    return df.withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(owners), slot)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> tuple[str, str]:
    """Write ``df`` as one folder per shard; returns the names of the slot and shard columns.

    Each shard is written by several tasks, dealt by row, so a key that holds a large share of the rows makes its shard's
    folder larger but no task. Column names that ``df`` already has get underscores appended.
    """
    slot, shard = free_name(df.columns, "slot"), free_name(df.columns, "shard")
    n = partitions(df.sparkSession)
    placed = place(df.withColumn(turn := free_name(df.columns, "turn"), F.monotonically_increasing_id() % n), key, shards, slots, slot, shard)
    # each writing task serves a few shards: shard s goes to the tasks that its rows' turns pick out of n // few
    few = max(1, n // len(shards))
    placed = placed.repartition(n, F.col(shard), F.col(turn) % few).drop(turn)
    placed.write.partitionBy(shard).parquet(path)
    return slot, shard


def shard_documents(docs: DataFrame, shards: int = 64, slots: int = SLOTS) -> DataFrame:
    """Place whole documents by doc_id, write the shards and return (doc_id, slot, shard) from the written files.

    Null ids share the slot of the empty text, repeated ids share a slot, an empty table gives an empty result.
    """
    spark, names = docs.sparkSession, [f"shard-{i:05d}" for i in range(shards)]
    path = staged_path(spark, "shards")
    slot, shard = write_shards(docs, "doc_id", names, path, slots)
    schema = docs.select("doc_id").schema.add(slot, "long").add(shard, "integer")
    return spark.read.schema(schema).parquet(path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(slot).alias("slot"), F.col(shard).alias("shard")
    )
