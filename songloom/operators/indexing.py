"""Labels to dense integer ids, as tables rather than driver-side maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.operators.skew import counted_lookup, with_position


def build_index(df: DataFrame, column: str) -> DataFrame:
    """Table ``(label, n, index)``: most frequent label first, ties by label, from 0.

    The numbers equal those of a frequency-ordered ``StringIndexer``, but the labels stay
    on the executors.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = with_position(counts, [F.desc("n"), F.asc("label")], "index")
    return placed.withColumn("index", F.col("index").cast("int"))


def apply_index(
    df: DataFrame, index: DataFrame, column: str, output: str, unseen: str = "drop"
) -> DataFrame:
    """Add ``output`` with the id of ``column``.

    Labels the index lacks, null among them, are dropped (``drop``), get null (``null``), or
    share the id one past the last (``keep``).
    """
    table = index.select(
        F.col("label").alias(column), F.col("index").alias(output), F.col("n").alias("_n")
    )
    found = counted_lookup(df, table, column, "_n", spread=df.columns).drop("_n")
    if unseen == "drop":
        return found.filter(F.col(output).isNotNull())
    if unseen == "null":
        return found
    if unseen == "keep":
        size = index.agg(F.count(F.lit(1)).cast("int")).scalar()
        return found.withColumn(output, F.coalesce(F.col(output), size))
    raise ValueError(f"unknown unseen mode {unseen!r}")


def index_interactions(
    interactions: DataFrame, users: DataFrame, songs: DataFrame, unseen: str = "drop"
) -> DataFrame:
    with_user = apply_index(interactions, users, "user_id", "user_index", unseen)
    return apply_index(with_user, songs, "song_id", "song_index", unseen)


def index_sizes(df: DataFrame) -> DataFrame:
    """Largest user and song index, in one pass."""
    return df.agg(
        F.max("user_index").alias("max_user_index"), F.max("song_index").alias("max_song_index")
    )
