"""Placement by a permutation-filled lookup table (Eisenbud et al., 2016)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime of over 100 slots a shard keeps shares within about 1 %.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of each slot.

    Shards take turns, in the order given; each claims the first free slot in its own preference
    order ``offset, offset + skip, ...`` modulo the prime ``slots``, a permutation of all slots. A
    shard of weight w claims w slots a turn. Names must differ, and no more shards than slots.
    """
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: a prime is needed")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("from 1 to as many shards as slots, of different names")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            for _ in range(min(turns[k], free)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                free -= 1
    return table


def place(spark: SparkSession, rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, weights: dict[str, int] | None = None, spread: list[str] | None = None) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``.

    A row's slot is a hash of its key modulo ``slots``; the table of slots, whose size is fixed by
    ``slots`` and not by the data, is broadcast, so a row is placed in constant time and without a
    shuffle. Where a key holds a large share of the rows (a source, say), ``spread`` names columns
    that are hashed with it and deal the key's rows over the shards.

    A null key (and spread column) hashes as a value of its own. Equal rows go to one shard. Columns
    of ``rows`` named slot or shard are replaced. An empty table stays empty.
    """
    table = fill_table(shards, slots, weights)
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], "slot int, shard string")
    cols = [key, *(spread or [])]
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in cols])
    slot = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")
    return rows.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(lookup), "slot", "left").select(*rows.drop("slot", "shard").columns, "slot", "shard")
