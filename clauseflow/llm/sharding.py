"""Sharding: a lookup table filled by permutations.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step drawn from the digest of its
name); shards take turns, each claiming the first slot of its order that is still free.  Every shard gets the same number
of slots, give or take one, and when a shard leaves few slots other than its own change hands.  The table's size is
fixed, so broadcasting it is safe at any input size; placing a row is one hash and one lookup, without a shuffle.

Defined results: rows with equal ids, repeated ones included, share a shard; a null id is placed like the id "null"; an
existing column with the name of an output column is replaced; an empty input gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

SHARDS, TABLE_SIZE = 64, 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Shard number of each slot."""
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime, not {size}")
    if not 0 < len(set(names)) == len(names) <= size:
        raise ValueError("shard names must be distinct, one at least and no more than slots")
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    owner = [-1] * size
    filled = 0
    while True:
        for k in range(len(names)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + step[k]) % size
            owner[slot] = k
            at[k] = (slot + step[k]) % size
            filled += 1
            if filled == size:
                return np.array(owner, np.int32)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def assign_shards(df: DataFrame, names: list[str] | None = None, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """df with columns slot and shard."""
    spark = df.sparkSession
    table = lookup_table(names or shard_names(), size)
    slots = spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": table}))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    slot = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")
    plain = without(df, "slot", "shard")
    placed = plain.withColumn("slot", slot)
    return placed.join(F.broadcast(slots), "slot", "left").select(*[F.col(f"`{c}`") for c in plain.columns], "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder a shard; rows meet in as many tasks as there are shards, or more where AQE splits a large one."""
    df.repartition(shards, "shard").write.partitionBy("shard").parquet(path)


def oracle_sql(size: int = TABLE_SIZE) -> str:
    owner = ",".join(map(str, lookup_table(shard_names(), size)))
    return f"""
WITH t AS (SELECT string_split('{owner}', ',') AS owner),
     d AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
SELECT d.*, CAST(t.owner[d.slot + 1] AS INTEGER) AS shard FROM d, t"""
