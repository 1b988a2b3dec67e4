import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.models import als, embedding
from songloom.operators import scoring
from songloom.operators.metrics import mse
from songloom.operators.splitting import hash_split
from songloom.storage import scratch_path
from tests.conftest import rows

USERS, SONGS, RANK = 60, 40, 3


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings with a low-rank structure, two of three pairs known, one user holding a third."""
    draw = np.random.default_rng(5)
    left, right = draw.uniform(0.2, 1, (USERS, RANK)), draw.uniform(0.2, 1, (SONGS, RANK))
    data = [
        (u, s, float(left[u] @ right[s]))
        for u in range(USERS)
        for s in range(SONGS)
        if (u * 7 + s * 5) % 3
    ]
    return spark.createDataFrame(data, "user_index int, song_index int, listen_count double").cache()


@pytest.fixture(scope="module")
def model(planted):
    return als.fit_als(planted, seed=1)


def brute_top(users, items, n):
    expected = []
    for user, u in users:
        scored = [(round(float(np.dot(u, v)), 6), item) for item, v in items]
        best = sorted(scored, key=lambda pair: (-pair[0], pair[1]))[:n]
        expected += [(user, item, score, place) for place, (score, item) in enumerate(best, 1)]
    return sorted(expected)


@pytest.mark.parametrize("user_block,item_block,n", [(4096, 65536, 5), (7, 11, 5), (3, 4, 100)])
def test_top_scores_equal_brute_force(spark, user_block, item_block, n):
    draw = np.random.default_rng(9)
    # few distinct values, so that many scores tie
    users = [(i, [float(x) for x in draw.integers(0, 3, 4)]) for i in range(25)]
    items = [(i * 2, [float(x) for x in draw.integers(-1, 3, 4)]) for i in range(30)]
    schema = "id int, features array<float>"
    left, right = spark.createDataFrame(users, schema), spark.createDataFrame(items, schema)
    top = scoring.top_scores(left, right, n, user_block=user_block, item_block=item_block)
    assert sorted(tuple(r) for r in top.collect()) == brute_top(users, items, n)
    stats = scoring.score_summary(left, right, user_block, item_block).collect()
    for row in stats:
        scores = [np.dot(users[row.user][1], v) for _, v in items]
        assert row["items"] == 30
        assert (row.lowest, row.highest) == (min(scores), max(scores))
        assert row["mean"] == pytest.approx(np.mean(scores))


def test_no_items_means_no_recommendations(spark):
    users = spark.createDataFrame([(1, [1.0])], "id int, features array<double>")
    assert scoring.top_scores(users, users.filter("id > 1"), 3).isEmpty()


def test_recommend_all_equals_the_library_call(model):
    mine = {r.user_index: [x.song_index for x in r.recommendations] for r in als.recommend_all(model, 5).collect()}
    theirs = {
        r.user_index: [x.song_index for x in r.recommendations]
        for r in model.recommendForAllUsers(5).collect()
    }
    assert mine == theirs


def test_subset_and_flattening(spark, model):
    wanted = spark.createDataFrame([(3,), (3,), (5,), (9999,)], "user_index int")
    flat = scoring.flatten_recs(als.recs_for_user(model, wanted, 4)).collect()
    assert sorted({r.user_index for r in flat}) == [3, 5] and len(flat) == 8
    for user in (3, 5):
        ratings = [r.rating for r in sorted(flat, key=lambda r: r["rank"]) if r.user_index == user]
        assert ratings == sorted(ratings, reverse=True)


def test_error_beats_the_mean_and_seeds_repeat(planted):
    run = als.train_and_evaluate(planted, seed=1, params=als.ALSParams(rank=3, reg=0.01))
    _, test = hash_split(planted, ["user_index", "song_index"])
    spread = test.agg(F.stddev_pop("listen_count")).first()[0]
    report = als.report(run).first()
    assert report.rmse < spread / 2
    assert 0 < report.fit_seconds <= report.total_seconds
    first, second = (als.fit_als(planted, seed=4) for _ in range(2))
    assert rows(first.itemFactors) == rows(second.itemFactors)


def test_user_factors_solve_their_least_squares(planted, model):
    """The last half-step solves (sum of v v' + reg * n) u = sum of r v for every user."""
    songs = {r.id: np.array(r.features) for r in model.itemFactors.collect()}
    heard = {}
    for r in planted.collect():
        heard.setdefault(r.user_index, []).append((songs[r.song_index], r.listen_count))
    for row in model.userFactors.collect():
        vectors, labels = map(np.array, zip(*heard[row.id]))
        left = vectors.T @ vectors + als.DEFAULT.reg * len(labels) * np.eye(als.DEFAULT.rank)
        assert np.allclose(np.linalg.solve(left, vectors.T @ labels), row.features, atol=1e-3)


def test_nonnegative_factors_and_unknown_ids(spark, planted):
    fitted = als.fit_als(planted, 1, als.NONNEGATIVE)
    lowest = fitted.userFactors.union(fitted.itemFactors).select(F.min(F.array_min("features")))
    assert lowest.first()[0] >= 0
    pairs = spark.createDataFrame([(1, 1), (1, 9999)], "user_index int, song_index int")
    assert als.predict(fitted, pairs).count() == 1


def test_model_round_trip(spark, model):
    path = scratch_path(spark, "als")
    als.save_model(model, path)
    assert rows(als.load_model(path).userFactors) == rows(model.userFactors)


def test_one_embedding_step_equals_adam_by_hand(planted):
    def table(frame):
        got = {(r.kind, r.id): np.array(r.features) for r in frame.collect()}
        left = np.array([got["user", i] for i in range(USERS)])
        return left, np.array([got["song", i] for i in range(SONGS)])

    start = embedding.initial_embeddings(planted, 4, seed=2)
    features = F.array(*[f"w{i}" for i in range(4)]).alias("features")
    left, right = table(start.select("kind", "id", features))
    assert abs(left.mean()) < 0.3 and 0.8 < left.std() < 1.2

    data = [(r.user_index, r.song_index, r.listen_count) for r in planted.collect()]
    slope_left, slope_right = np.zeros_like(left), np.zeros_like(right)
    for u, s, label in data:
        error = 2 * (left[u] @ right[s] - label) / len(data)
        slope_left[u] += error * right[s]
        slope_right[s] += error * left[u]

    def adam(weights, slope):  # first step: both moment corrections cancel
        return weights - 0.05 * slope / (np.abs(slope) + 1e-8)

    after = embedding.fit_embeddings(planted, seed=2, dim=4, step=0.05, epochs=1)
    new_left, new_right = table(after)
    assert np.allclose(new_left, adam(left, slope_left), atol=1e-6)
    assert np.allclose(new_right, adam(right, slope_right), atol=1e-6)


def test_embedding_error_falls_with_mini_batches(spark, planted):
    def error(model):
        return mse(embedding.predict_embeddings(model, planted)).first()[0]

    before = error(embedding.fit_embeddings(planted, seed=2, epochs=0))
    model = embedding.fit_embeddings(planted, seed=2, step=0.1, epochs=4, batch_size=600)
    assert error(model) < before / 2
    path = scratch_path(spark, "embeddings")
    embedding.save_embeddings(model, path)
    assert rows(embedding.load_embeddings(spark, path)) == rows(model)


def test_small_scores_keep_their_order(spark):
    users = spark.createDataFrame([(1, [1e-4])], "id int, features array<float>")
    items = spark.createDataFrame([(i, [i * 1e-4]) for i in range(1, 20)], "id int, features array<float>")
    assert [row.item for row in scoring.top_scores(users, items, 3).orderBy("rank").collect()] == [19, 18, 17]


def test_similar_items_with_ties(spark):
    from songloom.plans.recommend import similar_items

    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id int, features array<float>")
    seeds = spark.createDataFrame([(5,)], "id int")
    found = similar_items(same, seeds, 3).orderBy("rank").collect()
    assert [(row.item, row.rank) for row in found] == [(0, 1), (1, 2), (2, 3)]


def test_optimality_tells_other_factors_from_the_best(spark):
    """One user, one factor: the best is (sum of r v) / (sum of v v + reg n), or 0 where that is negative."""
    from types import SimpleNamespace

    users = [(0, [2.2 / (1.25 + 0.2)]), (1, [0.0]), (2, [0.5]), (3, [-0.5])]
    ratings = {0: (2.0, 0.4), 1: (-3.0, 0.0), 2: (2.0, 0.4), 3: (-3.0, 0.0)}
    model = SimpleNamespace(
        rank=1,
        userFactors=spark.createDataFrame(users, "id int, features array<double>"),
        itemFactors=spark.createDataFrame([(0, [1.0]), (1, [0.5])], "id int, features array<double>"),
    )
    pairs = spark.createDataFrame([(u, s, x) for u, r in ratings.items() for s, x in enumerate(r)], "user_index int, song_index int, listen_count double")
    found = {row.user_index: row for row in als.user_optimality(model, pairs, 0.1).collect()}
    assert found[0].residual < 1e-9 and found[1].residual == 0
    assert found[2].residual > 0.1 and found[3].residual > 0.1 and found[3].lowest < 0


def test_blocks_of_als_grow_with_what_a_task_can_hold(spark, monkeypatch):
    """More blocks than needed multiply the factors that every half-step sends."""
    asked = []

    class Fake:
        def __init__(self, **settings):
            asked.append((settings["numUserBlocks"], settings["numItemBlocks"]))

        def fit(self, pairs):
            return None

    monkeypatch.setattr(als, "ALS", Fake)
    for pairs in (1000, 36_000_000, 300_000_000):
        als.fit_als(spark.range(pairs).selectExpr("id AS user_index", "id AS song_index", "1 AS listen_count"), seed=1)
    assert asked == [(8, 8), (8, 8), (10, 10)]
