"""Scores from factor tables, and the top of them per user.

A factor table has one row ``(id, features)`` per user or item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songloom.functions.vectors import dot, norm

USER_BLOCK = 4096
ITEM_BLOCK = 65536
_CELLS = 4_000_000  # scores held at once inside a task
MAX_PARTITIONS = 100_000


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Score of the given ``(user, item)`` pairs; a pair with an unknown id is dropped."""
    left = users.select(F.col("id").alias("user"), F.col("features").alias("_u"))
    right = items.select(F.col("id").alias("item"), F.col("features").alias("_v"))
    both = pairs.join(left, "user").join(right, "item")
    return both.withColumn("score", dot("_u", "_v")).drop("_u", "_v")


def unit_length(factors: DataFrame) -> DataFrame:
    """Factors scaled to length 1, so that a dot product is a cosine; zero vectors are dropped."""
    return (
        factors.withColumn("_norm", norm("features"))
        .filter(F.col("_norm") > 0)
        .select(
            "id",
            F.transform("features", lambda x: x.cast("double") / F.col("_norm")).alias("features"),
        )
    )


def _per_block(
    users: DataFrame,
    items: DataFrame,
    work: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    user_block: int,
    item_block: int,
) -> DataFrame:
    """Run ``work(user ids, item ids, scores)`` over every block of users against every block of items.

    Both tables are hashed into blocks of bounded size and meet by an ordinary keyed shuffle.
    Only what ``work`` keeps leaves a task; the scores themselves never become rows.
    """
    user_blocks = max(1, -(-users.count() // user_block))
    item_blocks = max(1, -(-items.count() // item_block))
    # A fixed number, because adaptive execution would merge these small but busy partitions.
    partitions = min(user_blocks * item_blocks, MAX_PARTITIONS)

    def side(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return df.select(
            # a new name, so that a table can also be scored against itself
            F.col("id").alias("row_id"),
            F.transform("features", lambda x: x.cast("double")).alias("features"),
            F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other),
        ).repartition(partitions, "user_block", "item_block")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        results = list(_chunks(left, right, work))
        return pd.concat(results, ignore_index=True) if results else work_nothing()

    def work_nothing() -> pd.DataFrame:
        return work(np.empty(0, "int64"), np.empty(0, "int64"), np.empty((0, 0)))

    left = side(users, "user_block", user_blocks, "item_block", item_blocks)
    right = side(items, "item_block", item_blocks, "user_block", user_blocks)
    return (
        left.groupBy("user_block", "item_block")
        .cogroup(right.groupBy("user_block", "item_block"))
        .applyInPandas(meet, schema)
    )


def _chunks(left: pd.DataFrame, right: pd.DataFrame, work: Callable) -> Iterator[pd.DataFrame]:
    if left.empty or right.empty:
        return
    right = right.sort_values("row_id")
    item_ids = right["row_id"].to_numpy()
    item_factors = np.stack(right["features"].to_list())
    user_ids = left["row_id"].to_numpy()
    user_factors = np.stack(left["features"].to_list())
    step = max(1, _CELLS // len(item_ids))
    for start in range(0, len(user_ids), step):
        rows = slice(start, start + step)
        yield work(user_ids[rows], item_ids, user_factors[rows] @ item_factors.T)


def top_scores(
    users: DataFrame,
    items: DataFrame,
    n: int,
    digits: int | None = None,
    user_block: int = USER_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """The ``n`` best items of every user as ``(user, item, score, rank)``.

    With ``digits`` scores are rounded before ranking, so that nearly equal ones tie. Ties go to
    the smaller item id.
    """

    def best(user_ids: np.ndarray, item_ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        if scores.size == 0:
            return pd.DataFrame({"user": user_ids, "item": item_ids, "score": scores.ravel()})
        if digits is not None:
            scores = np.round(scores, digits) + 0.0
        keep = min(n, len(item_ids))
        floor = np.partition(scores, len(item_ids) - keep, axis=1)[:, len(item_ids) - keep]
        rows, columns = np.nonzero(scores >= floor[:, None])
        values = scores[rows, columns]
        order = np.lexsort((columns, -values, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        firsts = np.searchsorted(rows, np.arange(len(user_ids)))
        chosen = np.arange(len(rows)) - firsts[rows] < keep
        return pd.DataFrame(
            {
                "user": user_ids[rows[chosen]],
                "item": item_ids[columns[chosen]],
                "score": values[chosen],
            }
        )

    found = _per_block(
        users, items, best, "user long, item long, score double", user_block, item_block
    )
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", place).filter(F.col("rank") <= n)


def top_for_users(
    users: DataFrame, items: DataFrame, wanted: DataFrame, n: int, digits: int | None = None
) -> DataFrame:
    """:func:`top_scores` of the users in ``wanted(user_index)``, filtered before any scoring."""
    ids = wanted.select(F.col("user_index").cast("int").alias("id")).dropDuplicates()
    return top_scores(users.join(ids, "id", "left_semi"), items, n, digits)


def score_summary(
    users: DataFrame,
    items: DataFrame,
    user_block: int = USER_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Every user scored against every item, reduced to count, lowest, highest and mean score."""

    def reduce(user_ids: np.ndarray, item_ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        some = scores.size > 0
        return pd.DataFrame(
            {
                "user": user_ids,
                "items": np.full(len(user_ids), len(item_ids), "int64"),
                "lowest": scores.min(axis=1) if some else np.empty(0),
                "highest": scores.max(axis=1) if some else np.empty(0),
                "total": scores.sum(axis=1) if some else np.empty(0),
            }
        )

    schema = "user long, items long, lowest double, highest double, total double"
    parts = _per_block(users, items, reduce, schema, user_block, item_block)
    return parts.groupBy("user").agg(
        F.sum("items").alias("items"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        (F.sum("total") / F.sum("items")).alias("mean"),
    )


def nest_recs(top: DataFrame) -> DataFrame:
    """``(user_index, recommendations)`` with the n best songs of a user in one array."""
    entry = F.struct(
        "rank",
        F.col("item").cast("int").alias("song_index"),
        F.col("score").cast("float").alias("rating"),
    )
    nested = top.groupBy(F.col("user").cast("int").alias("user_index")).agg(
        F.sort_array(F.collect_list(entry)).alias("_entries")
    )
    return nested.select(
        "user_index",
        F.transform(
            "_entries",
            lambda e: F.struct(e["song_index"].alias("song_index"), e["rating"].alias("rating")),
        ).alias("recommendations"),
    )


def flatten_recs(recs: DataFrame) -> DataFrame:
    """One row per recommendation, with its rank in the list."""
    return recs.select("user_index", F.posexplode("recommendations").alias("pos", "rec")).select(
        "user_index", (F.col("pos") + 1).alias("rank"), "rec.*"
    )
