"""Joins with a side whose size is measured before a strategy is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it has at most so many rows (narrow rows: keys and a few fixed columns), …
BROADCAST_ROWS = 200_000
#: … or, where rows are wide, so many bytes by the caller's measure of a row.
BROADCAST_BYTES = 64 << 20
#: A key is hot when it holds more than so many rows and more than HOT_SHARE of all; so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS = 500_000
HOT_SHARE = 1e-4


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", row_bytes: int | None = None, rows: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, which is unique on ``on``.

    ``small`` is counted first (unless the caller has: ``rows``). Up to the limit it is broadcast, beyond it both sides are shuffled
    (``salted_join``). Null keys match nothing (``left`` keeps such rows of ``big``).
    """
    limit = BROADCAST_ROWS if row_bytes is None else min(BROADCAST_ROWS, BROADCAST_BYTES // max(row_bytes, 1))
    if (small.limit(limit + 1).count() if rows is None else rows) <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)


def hot_key_salts(big: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hot keys of ``big`` with __salts, the number of tasks their rows are spread over. At most 1 / HOT_SHARE rows; counted map-side."""
    counts = big.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = counts.filter((F.col("__n") > hot_rows) & (F.col("__n") > total * HOT_SHARE))
    return hot.select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``big`` joined with ``small`` (unique on ``on``) by a shuffle of both sides in which no key of ``big`` is larger than about ``hot_rows``.

    The rows of a hot key are spread over as many tasks as it needs by a hash of the whole row, and only the rows of ``small`` with such keys are
    repeated; all others are sent once. ``big`` is read once more to count its keys; the hot keys, few by definition, are broadcast.
    """
    hot = F.broadcast(hot_key_salts(big, on, hot_rows))
    hashed = [f.name for f in big.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.col("__salts")).cast("int"), F.lit(0))
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    left = big.join(hot, on, "left").withColumn("__salt", salt).drop("__salts")
    right = small.join(hot, on, "left").withColumn("__salt", spread).drop("__salts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")
