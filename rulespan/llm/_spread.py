"""A left join whose keys may each hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: The keys that most rows share: so many are joined by broadcast, and all others by shuffle.
HEAVY = 1024


def join_spread(many: DataFrame, few: DataFrame, key: list[str], order: str, salt: str) -> DataFrame:
    """``many`` left-joined with ``few``, which has each key once; no key brings many rows to one task.

    The HEAVY keys with the greatest ``order`` are joined by broadcast: their number is fixed. Rows that they take
    go on under keys of their own, by ``salt``, so the shuffle deals them evenly; so do rows with a null in the key,
    which meet nothing. ``order`` isn't in the result.
    """
    few = Scratch(few.sparkSession, "keys").put(few, "keys")
    names = [c for c in few.columns if c not in key and c != order]
    heavy = few.orderBy(F.desc(order), *key).limit(HEAVY).select(*key, F.struct(*names).alias("__heavy"))
    rest = few.select(F.to_json(F.struct(*key)).alias("__key"), F.struct(*names).alias("__rest"))
    rows = many.join(F.broadcast(heavy), key, "left")
    alone = F.concat(F.lit("-"), F.col(salt).cast("string"))
    apart = reduce(lambda a, k: a | F.col(k).isNull(), key, F.col("__heavy").isNotNull())
    rows = rows.withColumn("__key", F.when(apart, alone).otherwise(F.to_json(F.struct(*key))))
    out = rows.join(rest, "__key", "left")
    return out.select(*many.columns, *[F.coalesce(F.col(f"__heavy.{n}"), F.col(f"__rest.{n}")).alias(n) for n in names])
