"""Sharding by a permutation-filled lookup table.

Every shard derives from its name a permutation of the slots of a prime-sized
table (an offset and a skip).  The shards take turns; at its turn a shard claims
the first slot of its permutation that is still free, until the table is full.
Each shard so owns the table's size divided by the number of shards, give or
take one slot, and a shard that joins or leaves moves few slots of the others.

A row's slot is a hash of its key modulo the table's size, and its shard is one
look-up in a broadcast table, whose size is a parameter and not a function of
the data.  No shuffle is needed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most slots a table may have: 2 million (long, int) pairs are what is broadcast at worst.
MAX_SLOTS = 2_000_003


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    d = 2
    while d * d <= n:
        if n % d == 0:
            return False
        d += 1
    return True


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation of the slots."""
    digest = hashlib.md5(name.encode("utf-8")).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int, weights: list[int] | None = None) -> list[int]:
    """The owner (an index into ``names``) of each slot.

    ``weights`` (1 by default) is the number of turns a shard has in each round.
    """
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}, not {slots}")
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and at least one")
    weights = weights or [1] * len(names)
    if len(weights) != len(names) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be whole numbers of 0 or more, one for each shard, not all 0")
    owner, prefer = [-1] * slots, [preference(n, slots) for n in names]
    at, left = [p[0] for p in prefer], slots
    while True:
        for shard, turns in enumerate(weights):
            for _ in range(turns):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + prefer[shard][1]) % slots
                owner[at[shard]] = shard
                left -= 1
                if not left:
                    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of the key as text, modulo the table's size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots


def table(spark: SparkSession, names: list[str], slots: int, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard, shard_name), one row for each slot."""
    owner = fill(names, slots, weights)
    literal = F.from_json(F.lit("[" + ",".join(map(str, owner)) + "]"), "array<int>")
    named = F.array(*[F.lit(n) for n in names])
    return spark.range(1).select(F.posexplode(literal).alias("slot", "shard")).select(
        F.col("slot").cast("long"), "shard", F.element_at(named, F.col("shard") + 1).alias("shard_name")
    )


def place(df: DataFrame, key: str, names: list[str], slots: int = 4099, weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` (long), ``shard`` (int) and ``shard_name`` (string).

    Columns of ``df`` that have one of these names are replaced.  Rows with a
    null key are placed like the empty text.  Repeated rows go to one shard.
    An empty table gives an empty one with the same columns.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard", "shard_name")]
    keyed = df.select(
        *[F.col(f"`{c}`") for c in kept], slot_of(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), slots).alias("slot")
    )
    return keyed.join(F.broadcast(table(spark, names, slots, weights)), "slot", "left").select(
        *[F.col(f"`{c}`") for c in kept], "slot", "shard", "shard_name"
    )
