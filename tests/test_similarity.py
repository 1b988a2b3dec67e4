"""Similarity plans against brute force, with hot users, hot songs and hot artists."""

import math
import random
from collections import defaultdict

import pytest

from songloom.plans import content, cooccurrence, hybrid
from tests.conftest import rows


def brute_cooccurrence(pairs, k):
    fans = defaultdict(set)
    for user, song in pairs:
        fans[song].add(user)
    expected = []
    for song, mine in fans.items():
        scored = []
        for other, theirs in fans.items():
            common = len(mine & theirs)
            if other != song and common:
                strength = common * common / len(theirs)
                scored.append((-strength, other, common, common / math.sqrt(len(mine) * len(theirs))))
        for place, (_, other, common, score) in enumerate(sorted(scored)[:k], 1):
            expected.append((song, other, common, round(score, 9), place))
    return sorted(expected)


def hot_interactions(seed, users=40, songs=120, wide_users=3):
    """Some users who heard a large part of everything, one song everybody heard."""
    draw = random.Random(seed)
    pairs = set()
    for u in range(users):
        pairs.add((f"u{u}", "s000"))
        for _ in range(draw.randrange(1, 6)):
            pairs.add((f"u{u}", f"s{draw.randrange(songs):03d}"))
    for w in range(wide_users):
        for s in range(songs):
            if draw.random() < 0.8:
                pairs.add((f"w{w}", f"s{s:03d}"))
    return sorted(pairs)


@pytest.mark.parametrize(
    "wide,wide_users,k", [(1000, 3, 4), (10, 3, 4), (10, 0, 4), (4, 12, 3), (10, 1, 500)]
)
def test_cooccurrence_equals_brute_force(spark, wide, wide_users, k):
    pairs = hot_interactions(wide + wide_users, wide_users=wide_users)
    data = spark.createDataFrame([*pairs, *pairs[:50], (None, "s001"), ("u1", None)], "user_id string, song_id string")
    best = cooccurrence.item_cooccurrence(data, k, wide=wide)
    got = sorted((r.song_id, r.candidate, r.common, round(r.score, 9), r["rank"]) for r in best.collect())
    assert got == brute_cooccurrence(pairs, k)


@pytest.mark.parametrize("wide,wide_users,pairs", [(1000, 0, 50), (10, 9, 400), (4, 12, 1000)])
def test_songs_dealt_out_to_many_groups_are_counted_whole(spark, wide, wide_users, pairs):
    heard = hot_interactions(7, wide_users=wide_users)
    data = spark.createDataFrame(heard, "user_id string, song_id string")
    best = cooccurrence.item_cooccurrence(data, 4, wide=wide, pairs=pairs)
    got = sorted((r.song_id, r.candidate, r.common, round(r.score, 9), r["rank"]) for r in best.collect())
    assert got == brute_cooccurrence(heard, 4)


def test_pairs_of_songs_are_not_shuffled(spark, monkeypatch):
    """Nothing leaves a task but packed lists, and what may be among the best."""
    heard = hot_interactions(3, wide_users=0)
    songs = len({song for _, song in heard})
    data = spark.createDataFrame(heard, "user_id string, song_id string")
    monkeypatch.setattr(cooccurrence, "song_pairs", None)
    stored, store = [], cooccurrence.cut_lineage
    monkeypatch.setattr(cooccurrence, "cut_lineage", lambda df: stored.append(store(df)) or stored[-1])
    assert cooccurrence.item_cooccurrence(data, 1).count() == songs
    met = stored[-1]
    assert met.columns == ["item", "other", "seen", "partial"]
    assert met.count() < 3 * songs  # the best of each song, and ties


def test_a_user_with_most_songs_does_not_spell_out_pairs(spark):
    """30,000 songs of one user would be 450 million pairs; the lists come from their sizes."""
    songs = 30_000
    wide = spark.range(songs).selectExpr("'wide' AS user_id", "format_string('s%05d', id) AS song_id")
    # songs from s20000 on are known to one more user each, so they are weaker candidates
    extra = wide.filter("song_id >= 's20000'").selectExpr("song_id AS user_id", "song_id")
    best = cooccurrence.item_cooccurrence(wide.union(extra), k=3)
    assert best.count() == songs * 3
    lists = best.groupBy("rank", "candidate").count().collect()
    assert {r.candidate for r in lists} == {"s00000", "s00001", "s00002", "s00003"}
    first = [r for r in best.filter("song_id = 's25000'").orderBy("rank").collect()]
    assert [r.candidate for r in first] == ["s00000", "s00001", "s00002"]
    assert first[0].score == pytest.approx(1 / math.sqrt(2))


def test_cooccurrence_for_one_song_is_its_list(spark):
    pairs = hot_interactions(3)
    data = spark.createDataFrame(pairs, "user_id string, song_id string")
    seed = spark.createDataFrame([("s007",)], "song_id string")
    got = [r.song_id for r in cooccurrence.cooccurrence_for(data, seed, 6).collect()]
    expected = [(place, other) for song, other, _, _, place in brute_cooccurrence(pairs, 6) if song == "s007"]
    assert got == [other for _, other in sorted(expected)]


def brute_content(items, k):
    expected = []
    for song, release, artist, year in items:
        scored = []
        for other, their_release, their_artist, their_year in items:
            if other == song or artist is None or artist != their_artist:
                continue
            apart = abs((year or 0) - (their_year or 0))
            same = release is not None and release == their_release
            score = (0.7 if same else 0.0) + max(0.0, 1 - apart / 50) * 0.3
            if score > 0:
                scored.append((-score, apart, other))
        for place, (score, _, other) in enumerate(sorted(scored)[:k], 1):
            expected.append((song, other, round(-score, 9), place))
    return sorted(expected)


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10), (3, 200)])
def test_content_equals_brute_force(spark, seed, k):
    draw = random.Random(seed)
    items = []
    for i in range(150):
        artist = "hot" if draw.random() < 0.5 else draw.choice(["a", "b", "c", None])
        release = "album" if draw.random() < 0.4 else draw.choice(["x", "y", "z", None, f"only{i}"])
        year = draw.choice([None, 0, 1960, 1999, 2000, 2001, draw.randrange(1900, 2020)])
        items.append((f"s{i:03d}", release, artist, year))
    data = spark.createDataFrame(
        [(s, "t", r, a, y) for s, r, a, y in items],
        "song_id string, title string, release string, artist_name string, year int",
    )
    best = content.content_similarity(data, k)
    got = sorted((r.song_id, r.candidate, round(r.score, 9), r["rank"]) for r in best.collect())
    assert got == brute_content(items, k)


def test_hybrid_blends_and_leaves_out_heard_songs(spark):
    schema = "song_id string, candidate string, score double"
    left = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 0.4)], schema)
    right = spark.createDataFrame([("a", "c", 1.0), ("a", "d", 0.2)], schema)
    blended = hybrid.hybrid(left, right, alpha=0.5, k=2)
    assert rows(blended) == [("a", "b", 0.8, 0.0, 0.4, 2), ("a", "c", 0.4, 1.0, 0.7, 1)]
    heard = spark.createDataFrame([("c",)], "song_id string")
    left_over = hybrid.hybrid(left, right, alpha=0.5, k=2, heard=heard)
    assert [r.candidate for r in left_over.orderBy("rank").collect()] == ["b", "d"]


def brute_blend(pairs, catalog, alpha, k, heard=()):
    """The k best blends of every song, every pair scored."""
    fans = defaultdict(set)
    for user, song in pairs:
        fans[song].add(user)
    profile = {song: (release, artist, year or 0) for song, release, artist, year in catalog if artist is not None}
    out = []
    names = sorted(fans.keys() | profile.keys())
    for a in names:
        found = []
        for b in names:
            if a == b or b in heard:
                continue
            common = len(fans[a] & fans[b])
            collaborative = common / math.sqrt(len(fans[a]) * len(fans[b])) if common else 0.0
            content = 0.0
            if a in profile and b in profile and profile[a][1] == profile[b][1]:
                apart = abs(profile[a][2] - profile[b][2])
                same = profile[a][0] is not None and profile[a][0] == profile[b][0]
                content = (0.7 if same else 0.0) + max(0.0, 1 - apart / 50) * 0.3
            score = collaborative * alpha + content * (1 - alpha)
            if score > 0:
                found.append((-score, b))
        out += [(a, b, round(-score, 9), rank) for rank, (score, b) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(
    ("wide", "wide_users", "alpha", "years", "left_out"),
    [(1000, 2, 0.5, 30, 0), (10, 3, 0.5, 200, 0), (10, 3, 0.9, 10, 12), (1000, 1, 1.0, 30, 0)],
)
def test_hybrid_is_the_best_blend_of_all_pairs(spark, wide, wide_users, alpha, years, left_out):
    """Songs that neither list shows among its first may still blend best; rounds go on until they can't."""
    pairs = hot_interactions(wide + wide_users, songs=90, wide_users=wide_users)
    draw = random.Random(wide_users)
    catalog = [
        (f"s{n:03d}", draw.choice(["r1", "r2", None]), draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(years)]))
        for n in range(5, 100)
    ]
    data = spark.createDataFrame(pairs, "user_id string, song_id string")
    songs = spark.createDataFrame(catalog, "song_id string, release string, artist_name string, year int")
    heard = [f"s{n:03d}" for n in range(left_out)]
    known = spark.createDataFrame([(x,) for x in heard], "song_id string") if left_out else None
    best = hybrid.hybrid_similarity(data, songs, alpha, 3, heard=known, wide=wide)
    got = sorted((r.song_id, r.candidate, round(r.score, 9), r["rank"]) for r in best.collect())
    assert got == brute_blend(pairs, catalog, alpha, 3, set(heard))


def test_hybrid_drops_pairs_of_an_artist_that_cannot_reach_the_lists(spark, monkeypatch):
    """Ten songs of each release hold the best places; other songs of the artist need most of their users in common."""
    draw = random.Random(5)
    releases = {f"s{n:03d}": f"r{n % 6}" for n in range(60)}
    pairs = sorted({(f"u{u}", f"s{draw.randrange(60):03d}") for u in range(80) for _ in range(12)})
    data = spark.createDataFrame(pairs, "user_id string, song_id string")
    catalog = spark.createDataFrame([(s, r, "a", 2000) for s, r in releases.items()], "song_id string, release string, artist_name string, year int")
    stored, store = [], hybrid.cut_lineage
    monkeypatch.setattr(hybrid, "cut_lineage", lambda df: stored.append(store(df)) or stored[-1])
    got = hybrid.hybrid_similarity(data, catalog, 0.5, 3).collect()
    within = next(df for df in stored if df.columns == ["song_id", "candidate", "narrow"])
    met = {(a, b) for u, a in pairs for v, b in pairs if u == v and a != b}
    assert len(met) > 2000 and within.count() < len(met) / 4
    fans = defaultdict(set)
    for user, song in pairs:
        fans[song].add(user)

    def blend(a, b):
        common = len(fans[a] & fans[b]) / math.sqrt(len(fans[a]) * len(fans[b]))
        return common * 0.5 + (1.0 if releases[a] == releases[b] else 0.3) * 0.5

    expected = []
    for a in releases:
        best = sorted((-round(blend(a, b), 9), b) for b in releases if b != a)[:3]
        expected += [(a, b, -score) for score, b in best]
    assert sorted((r.song_id, r.candidate, round(r.score, 9)) for r in got) == sorted(expected)
