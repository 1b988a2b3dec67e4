"""Deduplication, null filling and id normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILLS = {"year": 0, "listen_count": 0}


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Copies are folded on the map side, so a hot row costs nothing extra."""
    return df.dropDuplicates()


def dedupe_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest in the order of the remaining columns, nulls last."""
    rest = [name for name in df.columns if name not in keys]
    # min() over a struct is a partial aggregate; a window would ship every version of a key.
    ranked = [
        part for name in rest for part in (F.col(name).isNull().alias(f"_{name}_null"), F.col(name))
    ]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_best"))
    return best.select(
        *[F.col(n) if n in keys else F.col(f"_best.{n}").alias(n) for n in df.columns]
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Null year and null listen count become 0, whichever of them the frame has."""
    present = {name: value for name, value in FILLS.items() if name in df.columns}
    return df.fillna(present)


def clean(df: DataFrame, order: str = "fill_first") -> DataFrame:
    """Fill and deduplicate.

    ``fill_first`` leaves no equal rows. ``dedupe_first`` keeps the original order of the two
    steps, after which a null and a 0 version of a row end up as two equal rows.
    """
    if order == "fill_first":
        return dedupe(fill_missing(df))
    if order == "dedupe_first":
        return fill_missing(dedupe(df))
    raise ValueError(f"unknown order {order!r}")


def fold_pairs(df: DataFrame, mode: str = "listens") -> DataFrame:
    """One row per user and song: the sum of their listens, or weight 1.

    Repeated pairs are folded before the shuffle, so that a user who holds many rows still
    brings no more than one per song into training.
    """
    if mode not in ("unit", "listens"):
        raise ValueError(f"unknown weight mode {mode!r}")
    weight = F.lit(1) if mode == "unit" else F.sum("listen_count")
    return df.groupBy("user_id", "song_id").agg(weight.cast("double").alias("listen_count"))


def normalise_ids(df: DataFrame, column: str = "song_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def with_weight(df: DataFrame, mode: str = "unit") -> DataFrame:
    """Training weight of an interaction: constant 1, or the listens it records."""
    if mode == "unit":
        return df.withColumn("listen_count", F.lit(1))
    if mode == "listens":
        return df.withColumn("listen_count", F.coalesce("listen_count", F.lit(0)))
    raise ValueError(f"unknown weight mode {mode!r}")
