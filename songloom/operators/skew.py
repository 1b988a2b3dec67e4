"""Joins and positions that hold up when one key carries a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.storage import cut_lineage

SALTS = 1024
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in these bits


def counted_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    shares: int = 1000,
    spread: list[str] | None = None,
) -> DataFrame:
    """Left join to a table with one row per key, whose ``weight`` says how many rows a key has.

    Keys holding more than 1/``shares`` of all counted rows are fewer than ``shares``, so that
    part of ``right`` is always small enough to broadcast. Rows it answers, and rows without a
    key, get a salt that matches nothing and spreads them over the shuffle of the ordinary join,
    where no key is left with more than 1/``shares`` of the rows. ``spread`` names the columns
    the salt is drawn from; together they should be close to unique.
    """
    names = left.columns
    payload = [name for name in right.columns if name != key]
    packed = right.select(
        F.col(key).alias("_key"), F.col(weight).alias("_weight"), F.struct(*payload).alias("_row")
    )
    total = right.agg(F.sum(weight)).scalar()
    is_hot = F.col("_weight") * F.lit(shares) > total
    hot = packed.filter(is_hot).select(F.col("_key").alias("_hot_key"), F.col("_row").alias("_hot"))
    cold = packed.filter(~is_hot).select("_key", "_row", F.lit(0).alias("_cold_salt"))

    flagged = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    settled = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(*(spread or names)), F.lit(SALTS)).cast("int") + 1
    flagged = flagged.withColumn("_salt", F.when(settled, salt).otherwise(F.lit(0)))
    found = flagged.join(
        cold, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    return found.select(*names, F.coalesce("_hot", "_row").alias("_found")).select(
        *names, *[F.col(f"_found.{name}").alias(name) for name in payload]
    )


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``max_rows`` rows.

    The check reads no more than one row beyond the bound. A larger table is returned as it
    is, for Spark to join by shuffling.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def with_position(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Number the rows of ``df`` in a total ``order`` without gathering them in one task.

    The rows are range-sorted and stored once. Each then knows its place within its partition,
    and only one count per partition is accumulated to give the partition's first number.
    """
    placed = cut_lineage(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: bounded by the shuffle's partition count, and stored
    # so that every reader of the numbered table finds the starts ready.
    starts = cut_lineage(
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    within = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within + F.lit(first))
        .select(*df.columns, name)
    )
