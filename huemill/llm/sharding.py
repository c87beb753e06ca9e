"""Placement of rows on shards through a permutation-filled lookup table, with DataFrame functions only.

Each shard has a preference order over the slots of a table of prime size (an offset and a step
derived from its name); the shards take turns, each claiming its next free slot, until all are
taken. Any two shards' slots differ by one at most, and few slots change hands when a shard is
added or removed. A row's key is hashed to a slot, and the broadcast table gives its shard.

The table is bounded by its size, a parameter (65,537 rows by default), whatever the data. Keys
are hashed row by row, so a hot source is spread like any other. A null key is placed like any
key; rows with equal keys share a shard. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import fresh

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that holds each slot."""
    if not _is_prime(size):
        raise ValueError("the table's size must be a prime number")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    order = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        order.append((int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1))
    table, turn, free = [-1] * size, [0] * len(shards), size
    while True:
        for k, (offset, step) in enumerate(order):
            while True:
                slot = (offset + turn[k] * step) % size
                turn[k] += 1
                if table[slot] < 0:
                    break
            table[slot] = k
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its string form, modulo the table's size; null counts as an empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, shards: list[str], key: Column, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and shard of each row; columns of these names are replaced."""
    spark = df.sparkSession
    packed = ",".join(map(str, fill_table(shards, size)))
    kept = df.drop(*(c for c in df.columns if c.lower() in (slot_col.lower(), shard_col.lower())))
    at, slot, shard = (fresh(df, c) for c in ("at", "table_slot", "table_shard"))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias(slot, "k"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = table.select(slot, F.get(names, F.col("k").cast("int")).alias(shard))
    placed = kept.withColumn(at, slot_of(key, size)).join(F.broadcast(table), F.col(at) == F.col(slot))
    return placed.select(*kept.columns, F.col(at).alias(slot_col), F.col(shard).alias(shard_col))


def write_shards(df: DataFrame, path: str, shards: list[str], key: Column, files: int = 4, size: int = TABLE_SIZE) -> None:
    """Writes each shard to its own folder, every shard spread over a few files so that no task holds a whole one."""
    placed = assign_shards(df, shards, key, size)
    salt = fresh(placed, "salt")
    salted = placed.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(files)))
    salted.repartition("shard", salt).drop(salt).write.partitionBy("shard").mode("overwrite").parquet(path)
