"""Blend of collaborative and content similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.operators.skew import counted_lookup
from songloom.plans.content import (
    RELEASE_WEIGHT,
    content_similarity,
    profile_distance_score,
    profile_score,
    profiles,
)
from songloom.plans.cooccurrence import listeners, mark_widest, similar_by_listeners
from songloom.storage import cut_lineage


PAIR = ["song_id", "candidate"]
_SLACK = 1e-9  # relative, for rounding of scores
_NEVER = 1 << 52  # more users than there are
_DEEPER = 4  # how much longer the lists of a song become whose best blends aren't certain yet


def _facts(heard: DataFrame, catalog: DataFrame, wide: int) -> DataFrame:
    """Per song: listeners, which of the widest users heard it, and its profile."""
    sizes = heard.groupBy("user_id").agg(F.count(F.lit(1)).alias("songs"))
    known = mark_widest(heard, sizes, wide).groupBy("song_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("bits"),
    )
    profile = profiles(catalog).select("song_id", F.struct("release", "artist_name", "year").alias("profile"))
    return known.join(profile, "song_id", "full").fillna({"size": 0, "bits": 0})


def _common_within_artists(heard: DataFrame, facts: DataFrame, alpha: float, wide: int) -> DataFrame:
    """``(song_id, candidate, narrow)``: users in common, all but the widest, of songs of one artist,
    as far as the pair's blend reaches the ``floor`` of either song in ``facts``.

    Pairs are spelled out per user and artist, which are few songs each, next to how many common users
    they need. A user with more than ``wide`` songs is cut into blocks, as in :func:`song_pairs`.
    """
    sizes = heard.groupBy("user_id").agg(F.count(F.lit(1)).alias("songs"))
    narrow = mark_widest(heard, sizes, wide).filter(F.col("bit").isNull()).select("user_id", "song_id")
    details = facts.select("song_id", "size", "bits", "floor", "profile", F.col("profile.artist_name").alias("artist"))
    placed = counted_lookup(narrow, details, "song_id", "size").filter("artist IS NOT NULL")
    # at most a row for every ``wide`` interactions
    large = cut_lineage(sizes.filter(F.col("songs") > wide).select("user_id", F.ceil(F.col("songs") / wide).cast("int").alias("blocks")))
    cut = not large.isEmpty()
    blocked = placed.join(F.broadcast(large), "user_id", "left") if cut else placed.withColumn("blocks", F.lit(1))
    blocked = blocked.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    song = F.struct("song_id", "size", "bits", "floor", F.col("profile.release").alias("release"), F.col("profile.year").alias("year"))
    shelves = (
        blocked.withColumn("block", F.pmod(F.xxhash64("song_id"), F.col("blocks")).cast("int"))
        .groupBy("user_id", "artist", "blocks", "block")
        .agg(F.collect_list(song).alias("songs"))
    )
    later = shelves.filter(F.size("songs") > 1).select("songs", F.posexplode("songs").alias("place", "x"))
    met = later.select("x", F.explode(F.expr("slice(songs, place + 2, size(songs))")).alias("y"))
    if cut:
        of_large = shelves.filter("blocks > 1")
        keys = ["user_id", "artist", "low", "high"]
        left = of_large.filter("block < blocks - 1").select(
            "user_id", "artist", F.col("block").alias("low"), F.expr("explode(sequence(block + 1, blocks - 1))").alias("high"), F.col("songs").alias("xs")
        )
        right = of_large.filter("block > 0").select(
            "user_id", "artist", F.expr("explode(sequence(0, block - 1))").alias("low"), F.col("block").alias("high"), F.col("songs").alias("ys")
        )
        crossed = left.join(right, keys).select(F.explode("xs").alias("x"), "ys")
        met = met.unionByName(crossed.select("x", F.explode("ys").alias("y")))
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = pairs.select(F.col("x.song_id").alias("a"), F.col("y.song_id").alias("b"), _needed(alpha).alias("need"), F.least("x.size", "y.size").alias("most"))
    counted = pairs.filter("need <= most").groupBy("a", "b").agg(F.count(F.lit(1)).alias("narrow"), F.max("need").alias("need"))
    counted = counted.filter("narrow >= need")
    return counted.select(
        F.explode(F.array(F.struct(F.col("a").alias("song_id"), F.col("b").alias("candidate")), F.struct(F.col("b").alias("song_id"), F.col("a").alias("candidate")))).alias("p"),
        "narrow",
    ).select("p.*", "narrow")


def _needed(alpha: float) -> Column:
    """How many common users, all but the widest, two songs ``x`` and ``y`` of one artist need for their
    blend to reach the lower of their floors."""
    content = profile_distance_score(F.col("x.release") == F.col("y.release"), F.col("x.year"), F.col("y.year"))
    missing = F.least("x.floor", "y.floor") * (1 - _SLACK) - content * (1 - alpha)
    if alpha <= 0:
        return F.when(missing <= 0, 0).otherwise(_NEVER).cast("long")
    users = missing / alpha * F.sqrt((F.col("x.size") * F.col("y.size")).cast("double")) * (1 - _SLACK)
    of_widest = F.bit_count(F.col("x.bits").bitwiseAND(F.col("y.bits")))
    return F.when(missing <= 0, 0).otherwise(F.ceil(F.least(users, F.lit(float(_NEVER)))) - of_widest).cast("long")


def hybrid_similarity(
    interactions: DataFrame,
    catalog: DataFrame,
    alpha: float,
    k: int,
    heard: DataFrame | None = None,
    wide: int = 1000,
) -> DataFrame:
    """The k best blends of every song over all pairs, with both scores in full.

    A threshold algorithm over two ranked lists per song, co-occurrence and content. What the lists
    show, and all pairs of one artist with enough common users to reach the lists, is scored exactly. A pair not seen so has
    either no content score and at most the last co-occurrence score, or at most the last content
    score and users in common only among the widest. A song whose k-th best blend is above that bound is
    done; the others go on with longer lists. Without wide users one round is enough.

    Pairs that blend to 0 are left out; ties go to the smaller candidate id. Songs in
    ``heard(song_id)`` are left out of the candidates.
    """
    known = cut_lineage(listeners(interactions))
    facts = cut_lineage(_facts(known, catalog, wide))
    if heard is not None:
        left_out = cut_lineage(heard.select(F.col("song_id").alias("candidate")).dropDuplicates())
    within = None
    x = facts.select("song_id", "size", "bits", F.col("profile").alias("x"))
    y = facts.select(
        F.col("song_id").alias("candidate"), F.col("size").alias("_size"), F.col("bits").alias("_bits"), F.col("profile").alias("y")
    )
    open_songs, finished, depth = None, [], k
    while True:
        near = cut_lineage(similar_by_listeners(known, depth, wide))
        like = cut_lineage(content_similarity(catalog, depth))
        last = lambda rows, name: rows.filter(F.col("rank") == depth).select("song_id", F.col("score").alias(name))
        of_near, of_like = F.col("last_near") * alpha, F.col("last_like") * (1 - alpha)
        if within is None:
            # either list alone holds k blends that are not below its last one
            floors = facts.join(last(near, "last_near"), "song_id", "left").join(last(like, "last_like"), "song_id", "left")
            floor = F.lit(0.0) if heard is not None else F.greatest(of_near, of_like)
            floors = floors.fillna({"last_near": 0.0, "last_like": 0.0}).withColumn("floor", floor)
            within = _common_within_artists(known, cut_lineage(floors), alpha, wide)
            if heard is not None:
                within = within.join(left_out, "candidate", "left_anti")
            within = cut_lineage(within)
        sources = [
            near.select(*PAIR, F.lit(0).cast("long").alias("narrow"), "common"),
            like.select(*PAIR, F.lit(0).cast("long").alias("narrow"), F.lit(0).cast("long").alias("common")),
        ]
        if heard is not None:
            sources = [source.join(left_out, "candidate", "left_anti").select(source.columns) for source in sources]
        sources.append(within.select(*PAIR, "narrow", F.lit(0).cast("long").alias("common")))
        if open_songs is not None:
            sources = [source.join(open_songs, "song_id", "left_semi") for source in sources]
        seen = sources[0].unionByName(sources[1]).unionByName(sources[2])
        # by song last, so that a song's pairs are merged and ranked where they are scored
        met = seen.join(y, "candidate").join(x, "song_id")
        common = F.greatest("common", F.col("narrow") + F.bit_count(F.col("bits").bitwiseAND(F.col("_bits"))))
        both_sizes = F.sqrt((F.col("size") * F.col("_size")).cast("double"))
        each = met.select(
            *PAIR,
            F.when(common > 0, common / both_sizes).otherwise(0.0).alias("collaborative"),
            F.coalesce(profile_score("x", "y"), F.lit(0.0)).alias("content"),
        )
        scored = each.groupBy(*PAIR).agg(F.max("collaborative").alias("collaborative"), F.max("content").alias("content"))
        best = cut_lineage(_best_blends(scored, alpha, k))
        state = (
            (x if open_songs is None else x.join(open_songs, "song_id", "left_semi"))
            .join(last(near, "last_near"), "song_id", "left")
            .join(last(like, "last_like"), "song_id", "left")
            .join(best.filter(F.col("rank") == k).select("song_id", F.col("score").alias("floor")), "song_id", "left")
            .fillna({"last_near": 0.0, "last_like": 0.0, "floor": 0.0})
        )
        bound = F.greatest(of_near, of_like + F.when(F.col("bits") > 0, of_near).otherwise(0.0))
        # both lists in blend order down to their ends: what they don't show comes later in any case
        in_order = (F.col("bits") == 0) & (F.col("last_like") != RELEASE_WEIGHT) & F.lit(heard is None)
        certain = in_order | (F.col("floor") > bound) | (bound == 0)
        open_songs = cut_lineage(state.filter(~certain).select("song_id"))
        finished.append(best.join(open_songs, "song_id", "left_anti").select(best.columns))
        if open_songs.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        depth *= _DEEPER


def _best_blends(scored: DataFrame, alpha: float, k: int) -> DataFrame:
    blend = F.col("collaborative") * alpha + F.col("content") * (1 - alpha)
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("score"), "candidate"))
    ranked = scored.withColumn("score", blend).filter("score > 0").withColumn("rank", place)
    return ranked.filter(F.col("rank") <= k).select(*PAIR, "collaborative", "content", "score", "rank")


def hybrid(
    collaborative: DataFrame,
    content: DataFrame,
    alpha: float,
    k: int,
    heard: DataFrame | None = None,
) -> DataFrame:
    """The k best ``(song_id, candidate)`` by alpha * collaborative + (1 - alpha) * content.

    A pair that only one table has scores 0 on the other; :func:`hybrid_similarity` gives both. Songs in ``heard(song_id)`` are
    left out of the candidates.
    """
    pair = ["song_id", "candidate"]
    left = collaborative.select(*pair, F.col("score").alias("collaborative"))
    right = content.select(*pair, F.col("score").alias("content"))
    both = left.join(right, pair, "full").fillna({"collaborative": 0.0, "content": 0.0})
    if heard is not None:
        known = heard.select(F.col("song_id").alias("candidate")).dropDuplicates()
        both = both.join(known, "candidate", "left_anti")
    blend = F.col("collaborative") * alpha + F.col("content") * (1 - alpha)
    place = F.row_number().over(
        Window.partitionBy("song_id").orderBy(F.desc("score"), "candidate")
    )
    return (
        both.withColumn("score", blend)
        .withColumn("rank", place)
        .filter(F.col("rank") <= k)
        .select(*pair, "collaborative", "content", "score", "rank")
    )
