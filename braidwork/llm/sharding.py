"""Sharding by a permutation-filled lookup table (Eisenbud et al. 2016).

Each shard prefers the slots of a prime-sized table in its own order, offset + j * skip. Shards take turns, each claiming the
next free slot of its order, until the table is full. A document's key is hashed to a slot; the table is broadcast, so
placement is one lookup without a shuffle. When a shard is added or lost few of the others' slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._names import unused

#: A prime, about a thousand times the number of shards: then shards differ by 1% at most. The table is all that is broadcast,
#: and its size doesn't depend on the data.
SLOTS = 65_537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot. Names have to be distinct, slots prime and no fewer than shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots has to be prime and no fewer than shards")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digest]
    table = np.full(slots, -1, dtype=np.int32)
    at = list(offset)
    left = slots
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % slots
            table[slot] = i
            at[i] = (slot + skip[i]) % slots
            left -= 1
            if not left:
                return table


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def place(docs: DataFrame, shards: Sequence[str] | None = None, *, slots: int = SLOTS) -> DataFrame:
    """docs with a column shard, the index of the shard that each row goes to.

    The key is doc_id, for a null doc_id the text, so equal keys share a shard, repeated rows too; rows without either go
    where the empty text goes. All columns of docs stay as they are; if there is a shard already (in any case) the new
    column is shard_, and so on. An empty table gives an empty table; no shards are an error.
    """
    table = lookup_table(shard_names() if shards is None else shards, slots)
    slot, owner, name = unused("shard_slot", docs.columns), unused("shard_owner", docs.columns), unused("shard", docs.columns)
    rows = docs.sparkSession.createDataFrame([(int(i), int(s)) for i, s in enumerate(table)], f"{owner}_slot int, {owner} int")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))).otherwise(F.xxhash64(F.coalesce("text", F.lit(""))))
    placed = docs.withColumn(slot, F.pmod(key, F.lit(slots)).cast("int")).join(F.broadcast(rows), F.col(slot) == F.col(f"{owner}_slot"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(owner).alias(name))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "source", "shard")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}
