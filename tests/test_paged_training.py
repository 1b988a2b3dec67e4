"""Pages of mini-batches: the same as one plain process over all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom import workloads
from songloom.models import embedding
from songloom.operators.metrics import mse
from tests.conftest import SMALL

DIM, STEP, EPOCHS, SIZE, PAGE, SEED = 3, 0.05, 2, 4, 15, 3


def _plain(start, data, blocks):
    """Dense Adam, step by step; a step takes a mini-batch of each cell of a diagonal."""
    w = {key: np.array(x) for key, x in start.items()}
    m, v = ({key: np.zeros(DIM) for key in w} for _ in range(2))
    time = 0
    for diagonal in range(blocks):
        cells = []
        for a in range(blocks):
            rows = sorted(x for x in data if x[0] % blocks == a and (x[1] - x[0]) % blocks == diagonal)
            steps = []
            for first in range(0, len(rows), PAGE):
                page = rows[first : first + PAGE]
                for epoch in range(EPOCHS):
                    mixed = embedding._mixed(np.arange(first, first + len(page)), epoch, EPOCHS, SEED)
                    order = sorted(range(len(page)), key=lambda i: (mixed[i], i))
                    steps += [[page[i] for i in order[x : x + SIZE]] for x in range(0, len(page), SIZE)]
            cells.append(steps)
        for number in range(max(map(len, cells))):
            g = {key: np.zeros(DIM) for key in w}
            for steps in cells:
                batch = steps[number] if number < len(steps) else []
                for u, s, r in batch:
                    slope = (w["user", u] @ w["song", s] - r) * 2 / len(batch)
                    g["user", u] += slope * w["song", s]
                    g["song", s] += slope * w["user", u]
            time += 1
            for key in w:
                m[key] = m[key] * 0.9 + g[key] * 0.1
                v[key] = v[key] * 0.999 + g[key] ** 2 * 0.001
                w[key] = w[key] - STEP * (m[key] / (1 - 0.9**time)) / (np.sqrt(v[key] / (1 - 0.999**time)) + 1e-8)
    return w


@pytest.mark.parametrize("cell_rows,block_ids,blocks", [(1000, 1000, 1), (40, 1000, 3), (1000, 40, 2)])
def test_pages_equal_one_plain_process(spark, monkeypatch, cell_rows, block_ids, blocks):
    """One user holds a third of the rows, pairs repeat, and ids or ratings are missing."""
    draw = np.random.default_rng(1)
    data = [(0 if k % 3 == 0 else int(draw.integers(0, 30)), int(draw.integers(-10, 30)), 1.0) for k in range(220)]
    odd = [(None, 3, 1.0), (4, None, 1.0), (None, None, 1.0), (5, 6, None), (4711, 6, None)]
    df = spark.createDataFrame(data + odd, "user_index int, song_index int, listen_count double")
    monkeypatch.setattr(embedding, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding, "BLOCK_IDS", block_ids)
    settings = {"dim": DIM, "step": STEP, "epochs": EPOCHS, "batch_size": SIZE, "page_size": PAGE}
    model = embedding.fit_embeddings(df, SEED, **settings)
    assert model.schema["id"].dataType.simpleString() == "int"
    found = {(x.kind, x.id): x.features for x in model.collect()}
    first = embedding.initial_embeddings(df, DIM, SEED).select("kind", "id", F.array("w0", "w1", "w2").alias("w"))
    first = {(x.kind, x.id): x.w for x in first.collect()}
    unknown = {key: x for key, x in first.items() if key[1] is None}
    expected = _plain({key: x for key, x in first.items() if key not in unknown}, data, blocks) | unknown
    assert found.keys() == expected.keys() and len(unknown) == 2
    assert max(np.abs(np.subtract(found[key], expected[key])).max() for key in found) < 1e-9


def test_rows_left_alone_move_by_their_moments():
    """Steps without a gradient, more than are added up, equal those taken one by one."""
    draw = np.random.default_rng(2)
    w, m, v = draw.normal(size=(3, 4, 2))
    v, last = v * v, np.array([3, 40, 900, 1000])
    m[1] = 0
    mine, now = [x.copy() for x in (w, m, v)], 1000
    embedding._catch_up(*mine, last, now, 0.01)
    for i in range(4):
        for time in range(last[i] + 1, now + 1):
            m[i], v[i] = m[i] * 0.9, v[i] * 0.999
            w[i] -= 0.01 * (m[i] / (1 - 0.9**time)) / (np.sqrt(v[i] / (1 - 0.999**time)) + 1e-8)
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-13) for x, y in zip(mine, (w, m, v)))


def test_fm_train_takes_a_step_per_mini_batch(spark):
    """A step per epoch leaves the start values almost as they were."""
    rows = workloads.cleaning.with_weight(workloads.indexed_triplets(spark, SMALL))
    weights = workloads.fm_train(spark, SMALL).groupBy("kind", "id").agg(
        F.sort_array(F.collect_list(F.struct("i", "weight"))).getField("weight").alias("features")
    )
    error = mse(embedding.predict_embeddings(weights, rows)).first()[0]
    start = embedding.fit_embeddings(rows, workloads.SEED, epochs=0)
    assert error < 0.5 * mse(embedding.predict_embeddings(start, rows)).first()[0]


def test_no_rows_have_no_pages(spark):
    none = spark.createDataFrame([], "user_index int, song_index int, listen_count double")
    assert embedding.fit_embeddings(none, 1, batch_size=4, page_size=8).isEmpty()
