"""Explicit schemas of every dataset the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("song_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("release", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)

INTERACTIONS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("song_id", T.StringType()),
        T.StructField("listen_count", T.IntegerType()),
    ]
)

SONG_ENTRY = T.StructType(
    [
        T.StructField("song_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)

SONG_ENTRY_WITH_LISTENS = T.StructType(
    SONG_ENTRY.fields + [T.StructField("listen_count", T.IntegerType())]
)


def playlists(listens: bool = False) -> T.StructType:
    entry = SONG_ENTRY_WITH_LISTENS if listens else SONG_ENTRY
    return T.StructType(
        [
            T.StructField("user_id", T.StringType()),
            T.StructField("songs", T.ArrayType(entry)),
        ]
    )


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail early, by name, when a frame lacks columns an operator needs."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; frame has {df.columns}")
    return df
