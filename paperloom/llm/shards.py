"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: ``(offset + j * skip) mod size``, a full
permutation since the size is prime. Shards take turns, each claiming the next free slot of its order, until the table
is full. Loads differ by one slot at most, and a lost shard moves few keys besides its own.

The table's size is a parameter, independent of the data, so it is filled on the driver and sent to every executor;
placing a row is one hash, one remainder and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A prime; at most this many rows are broadcast.
TABLE_SIZE = 65_537
_LARGEST = 1_000_003


def _hash(text: str, seed: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{text}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. Deterministic; the order of ``shards`` breaks ties by turn."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be unique and at least one")
    if not len(shards) <= size <= _LARGEST or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table size must be a prime from the number of shards to {_LARGEST}")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key, by 60 bits of its MD5. A null key has the slot of the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(df: DataFrame, key: Column, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``__row`` (the row as a struct), ``slot``, ``shard``: one row per input row, without a shuffle.

    Equal keys, repeated rows and null keys (all as one) go to one shard each. An empty table gives an empty result.
    """
    slots = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))]
    table = df.sparkSession.createDataFrame(slots, "slot long, shard string").coalesce(1)
    rows = df.select(F.struct(*df.columns).alias("__row"), slot_of(key, size).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("__row", "slot", "shard")
