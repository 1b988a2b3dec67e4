"""Series behind the catalog charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songloom.functions.scalars import to_number
from songloom.operators.skew import with_position


def valid_years(catalog: DataFrame) -> DataFrame:
    """Rows whose year is a positive number; blank counts as 0, so it goes too."""
    return catalog.withColumn("year", to_number("year")).filter(F.col("year") > 0)


def songs_per_year(catalog: DataFrame, distinct: bool = False) -> DataFrame:
    rows = catalog.dropDuplicates() if distinct else catalog
    return valid_years(rows.select("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def songs_per_artist(catalog: DataFrame, distinct: bool = False) -> DataFrame:
    """Count per artist; songs without an artist form one group under the empty name."""
    rows = catalog.dropDuplicates() if distinct else catalog
    artist = F.coalesce("artist_name", F.lit("")).alias("artist")
    return rows.select(artist).groupBy("artist").agg(F.count(F.lit(1)).alias("n"))


def series_max(series: DataFrame) -> DataFrame:
    return series.agg(F.max("n").alias("max_n"))


def scaled_counts(series: DataFrame) -> DataFrame:
    """Count as a fraction of the largest; the maximum is one scalar, not a global window."""
    return series.withColumn("fraction", F.col("n") / series_max(series).scalar())


def top_artists(catalog: DataFrame, k: int = 10, distinct: bool = False) -> DataFrame:
    return songs_per_artist(catalog, distinct).orderBy(F.desc("n"), "artist").limit(k)


def artist_share(catalog: DataFrame, k: int = 10, distinct: bool = False) -> DataFrame:
    """Pie slices of the ``k`` largest artists, largest first, with their angles in radians.

    The windows are global, but only ever see the k rows that the limit left.
    """
    slices = top_artists(catalog, k, distinct)
    everything = Window.partitionBy()
    so_far = Window.orderBy(F.desc("n"), "artist").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(everything)
    until = F.sum("n").over(so_far)
    return slices.select(
        "artist",
        "n",
        (F.col("n") / total).alias("share"),
        ((until - F.col("n")) / total * (2 * math.pi)).alias("start_angle"),
        (until / total * (2 * math.pi)).alias("end_angle"),
    )


def release_trend(catalog: DataFrame, distinct: bool = False) -> DataFrame:
    """Songs per year as points of a line, in year order."""
    return with_position(
        songs_per_year(catalog, distinct), [F.asc("year")], "position", first=1
    ).orderBy("position")
