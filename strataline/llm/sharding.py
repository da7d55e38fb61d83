"""Consistent placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table (a start and a stride from its name's hash).  Shards take turns claiming
the first slot of their order that is still free until none is left, so all
own the same number of slots within one, and when a shard joins or leaves few
slots change hands.  The table has `slots` rows, a parameter and not a
function of the data, so the broadcast has a fixed bound and a row is placed by
one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast; 16 bytes a row, so 32 MB.
MOST_SLOTS = 2_000_003


def _prime(n: int) -> bool:
    return n > 2 and n % 2 == 1 and all(n % d for d in range(3, int(n**0.5) + 1, 2))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = 65_537) -> list[int]:
    """For every slot the index of its shard.

    Shards are distinct names, at least one and at most `slots`; `slots` is a prime.
    """
    if not _prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, from one to as many as slots")
    at = [_number(f"{s}|start") % slots for s in shards]
    step = [_number(f"{s}|stride") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = 65_537) -> DataFrame:
    """slot long, shard int, shard_name string: `slots` rows."""
    rows = [(k, i, shards[i]) for k, i in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def slot_of(keys: list[Column], slots: int) -> Column:
    """Slot of a row: 60 bits of the md5 of its keys, modulo the table's size.

    Null and empty keys are told apart.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = 65_537, prefix: str = "") -> DataFrame:
    """`df` with slot, shard and shard_name (after `prefix`), one row for each of its rows.

    Equal keys get equal shards.  A null key is a value of its own.  Columns of
    df with the names to be added are an error; choose a prefix.  An empty df
    gives an empty result.  No shuffle: the table of fixed size is broadcast.
    """
    new = [f"{prefix}{c}" for c in ("slot", "shard", "shard_name")]
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in new}:
        raise ValueError(f"df already has {sorted(clash)}; give a prefix")
    table = lookup_table(df.sparkSession, shards, slots).toDF(*new)
    keyed = df.withColumn(new[0], slot_of([F.col(f"`{k}`") for k in keys], slots))
    return keyed.join(F.broadcast(table), new[0], "left").select(*[keyed[f"`{c}`"] for c in df.columns], *new)
