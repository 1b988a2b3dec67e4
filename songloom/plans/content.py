"""Songs with similar properties, within one artist.

Score: 0.7 for the same release, plus 0.3 * max(0, 1 - years apart / 50). Candidates score above
zero; ties go to the nearer year, then to the smaller song id. A missing year counts as year 0.

Everything is decided per profile (artist, release, year). Songs sharing a profile share one
candidate list, and a profile finds its candidates among its neighbours in sorted order, so the
work grows with the number of songs even when one artist or release holds most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.operators.cleaning import dedupe_by_key
from songloom.operators.skew import counted_lookup, with_position
from songloom.storage import cut_lineage

RELEASE_WEIGHT, YEAR_WEIGHT, YEAR_SPAN = 0.7, 0.3, 50


def _first(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")


def _listed(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Per key, an array of the first ``rows`` candidates by years apart, then song id."""
    entry = F.struct("apart", "candidate", "candidate_release")
    return (
        _first(df, keys, ["apart", "candidate"], rows)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("listed"))
    )


def _years_apart(one: str, other: str) -> Column:
    return F.abs(F.col(one).cast("long") - F.col(other).cast("long"))


def _same_release(heads: DataFrame, k: int) -> DataFrame:
    """Nearest songs of the same release, per profile.

    Profiles are numbered in (artist, release, year) order. Each holds at least one song, so
    the k nearest songs lie within k numbers on either side.
    """
    profile = ["artist_name", "release", "year"]
    shelves = heads.filter(F.col("release").isNotNull())
    shelves = shelves.groupBy(*profile).agg(F.collect_list("song_id").alias("songs"))
    numbered = with_position(shelves, [F.asc(name) for name in profile], "number")
    steps = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    seekers = numbered.select(*profile, "number", steps.alias("step")).select(
        *profile, (F.col("number") + F.col("step")).alias("number")
    )
    offered = numbered.select(
        "number",
        F.col("artist_name").alias("_artist"),
        F.col("release").alias("candidate_release"),
        F.col("year").alias("_year"),
        "songs",
    )
    met = seekers.join(offered, "number").filter(
        (F.col("artist_name") == F.col("_artist"))
        & (F.col("release") == F.col("candidate_release"))
    )
    found = met.select(
        *profile,
        F.explode("songs").alias("candidate"),
        "candidate_release",
        _years_apart("year", "_year").alias("apart"),
    )
    return _listed(found, profile, k + 1)


def _other_releases(heads: DataFrame, k: int) -> DataFrame:
    """Nearest songs of the artist per (artist, year), over all releases.

    No release takes more than k + 1 of the 2 * (k + 1) places, so whichever release a reader
    leaves out, k + 1 songs of others remain if there are as many.
    """
    spot = ["artist_name", "year"]
    offered = _first(heads, spot, ["song_id"], 2 * (k + 1)).select(
        "artist_name",
        F.col("year").alias("_year"),
        F.col("song_id").alias("candidate"),
        F.col("release").alias("candidate_release"),
    )
    # Years further apart score nothing, so a year's own span and those beside it hold all.
    span = lambda year: F.floor(F.col(year).cast("long") / YEAR_SPAN)
    reach = F.explode(F.sequence(span("year") - 1, span("year") + 1))
    seekers = heads.select(*spot).dropDuplicates().select(*spot, reach.alias("_span"))
    met = (
        seekers.join(offered.withColumn("_span", span("_year")), ["artist_name", "_span"])
        .withColumn("apart", _years_apart("year", "_year"))
        .filter(F.col("apart") < YEAR_SPAN)
    )
    capped = _first(met, [*spot, "candidate_release"], ["apart", "candidate"], k + 1)
    return _listed(capped, spot, 2 * (k + 1))


def _score(same_release: Column, apart: Column) -> Column:
    closeness = F.greatest(F.lit(0.0), 1 - apart / F.lit(float(YEAR_SPAN)))
    release = F.when(F.coalesce(same_release, F.lit(False)), RELEASE_WEIGHT).otherwise(0.0)
    return release + closeness * YEAR_WEIGHT


def profiles(catalog: DataFrame) -> DataFrame:
    """What content compares: one row per song with an artist; a missing year counts as 0."""
    rows = catalog.filter(F.col("song_id").isNotNull() & F.col("artist_name").isNotNull())
    details = ["release", "artist_name", F.coalesce("year", F.lit(0)).alias("year")]
    return dedupe_by_key(rows.select("song_id", *details), ["song_id"])


def profile_distance_score(same_release: Column, year: Column, other_year: Column) -> Column:
    """Content score of two songs of one artist."""
    return _score(same_release, F.abs(year.cast("long") - other_year.cast("long")))


def profile_score(x: str, y: str) -> Column:
    """Content score of two profiles ``struct(release, artist_name, year)``; 0 for different artists."""
    score = _score(F.col(f"{x}.release") == F.col(f"{y}.release"), _years_apart(f"{x}.year", f"{y}.year"))
    same_artist = F.col(f"{x}.artist_name") == F.col(f"{y}.artist_name")
    return F.when(same_artist, score).otherwise(0.0)


def score_content(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(song_id, candidate)`` with their ``content`` score, 0 for different artists."""
    items = profiles(catalog)
    x = items.select("song_id", F.struct("release", "artist_name", "year").alias("x"))
    y = items.select(F.col("song_id").alias("candidate"), F.struct("release", "artist_name", "year").alias("y"))
    both = pairs.join(x, "song_id", "left").join(y, "candidate", "left")
    return both.select("song_id", "candidate", profile_score("x", "y").alias("content"))


def content_similarity(catalog: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar songs of every song as ``(song_id, candidate, score, rank)``."""
    items = profiles(catalog)
    profile = ["artist_name", "release", "year"]
    heads = _first(items, profile, ["song_id"], k + 1)
    same = _same_release(heads, k).withColumnRenamed("listed", "same")
    near = _other_releases(heads, k).withColumnRenamed("listed", "near")

    shelves = items.groupBy(*profile).agg(F.count(F.lit(1)).alias("songs"))
    lists = shelves.join(same, profile, "left").join(near, ["artist_name", "year"], "left")
    others = F.filter(
        "near", lambda c: ~F.coalesce(c["candidate_release"] == F.col("release"), F.lit(False))
    )
    empty = F.array().cast("array<struct<apart:bigint,candidate:string,candidate_release:string>>")
    candidates = F.concat(F.coalesce("same", empty), F.coalesce(F.slice(others, 1, k + 1), empty))
    # Stored, since the lookup reads its table twice.
    lists = cut_lineage(
        lists.select(
            F.struct(*profile).alias("profile"), "songs", candidates.alias("candidates")
        )
    )
    found = counted_lookup(
        items.select("song_id", "release", F.struct(*profile).alias("profile")),
        lists,
        "profile",
        "songs",
        spread=["song_id"],
    )
    usable = F.slice(
        F.filter("candidates", lambda c: c["candidate"] != F.col("song_id")), 1, k
    )
    score = _score(F.col("release") == F.col("c.candidate_release"), F.col("c.apart"))
    return found.select("song_id", "release", F.posexplode(usable).alias("pos", "c")).select(
        "song_id",
        F.col("c.candidate").alias("candidate"),
        score.alias("score"),
        (F.col("pos") + 1).alias("rank"),
    )
