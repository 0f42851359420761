"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.llm.exact_dedup import whole

#: Slots of the lookup table, a prime. It bounds what is broadcast.
SLOTS = 65_537
#: Names of the shards of the registered query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))

_CLAIM = 15  # hex digits of a hash that fit a long


def _number(key: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{key}".encode()).hexdigest()[:_CLAIM], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number that owns each slot.

    Every shard prefers the slots offset, offset + skip, offset + 2 skip, ...
    (mod `slots`), both numbers from a hash of its name. As `slots` is prime that
    visits all of them. The shards take turns, each claiming the next slot of its
    order that is still free, until none is. Their shares differ by one slot at
    most, and adding or removing a shard moves few other slots. The table depends
    on the shards alone, never on the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, and there must be one at least")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    place = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot a key falls into, by its text's MD5; null counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, _CLAIM), 16, 10).cast("long") % slots


def shard_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The lookup table as a DataFrame of `slots` rows: slot, shard."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return table.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """Each row of `docs` as doc, a struct of its columns, with slot and shard.

    One lookup by id per row. The table has `slots` rows whatever the size of
    `docs`, so it is broadcast; the documents do not move. Rows with equal ids
    share a shard; null and empty ids share one as well. No column but the id
    matters. An empty table gives an empty result.
    """
    table = shard_table(docs.sparkSession, shards, slots)
    placed = docs.select(whole(docs), slot_of(F.col(id_col), slots).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select("doc", "slot", "shard")
