import random

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from songloom.operators import indexing
from songloom.operators.skew import broadcast_if_small, counted_lookup, with_position
from songloom.storage import cut_lineage, scratch_path, shared_dir
from tests.conftest import rows


def skewed(spark, n=6000):
    """A third of the rows under one key, some without a key, the rest spread out."""
    draw = random.Random(7)
    data = []
    for i in range(n):
        kind = draw.random()
        key = "hot" if kind < 0.34 else None if kind < 0.4 else f"k{draw.randrange(900):03d}"
        data.append((i, key))
    return spark.createDataFrame(data, "row int, key string")


@pytest.mark.parametrize("shares", [1, 10, 100_000])
def test_lookup_equals_plain_left_join(spark, shares):
    left = skewed(spark)
    right = (
        left.filter("key is not null and key not like '%7'")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.max("row").alias("last"))
    )
    plain = left.join(right, "key", "left").select("row", "key", "n", "last")
    found = counted_lookup(left, right, "key", "n", shares=shares)
    assert rows(found.select("row", "key", "n", "last")) == rows(plain)


def test_positions_are_a_dense_order(spark):
    shuffled = spark.range(10_000).select(F.xxhash64("id").alias("value")).repartition(13)
    numbered = with_position(shuffled, [F.desc("value")], "place", first=5)
    got = [(row.place, row.value) for row in numbered.orderBy("place").collect()]
    values = sorted((row.value for row in shuffled.collect()), reverse=True)
    assert got == list(enumerate(values, start=5))


def test_index_equals_string_indexer(spark):
    data = skewed(spark)
    model = StringIndexer(inputCol="key", outputCol="i", handleInvalid="skip").fit(data)
    mine = {row.label: row["index"] for row in indexing.build_index(data, "key").collect()}
    assert mine == {label: place for place, label in enumerate(model.labels)}


@pytest.mark.parametrize("bound,marked", [(9, False), (10, True)])
def test_broadcast_only_within_the_bound(spark, bound, marked):
    table = cut_lineage(spark.range(10))
    joined = spark.range(100).join(broadcast_if_small(table, bound), "id")
    hints = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in hints) == marked
    assert joined.count() == 10


def test_stored_tables_stay_in_the_shared_folder(spark):
    stored = cut_lineage(spark.range(5).withColumn("pair", F.struct("id")).filter("id < 0"))
    assert stored.isEmpty() and stored.columns == ["id", "pair"]
    path = scratch_path(spark, "x")
    assert path.startswith(f"{shared_dir(spark)}/songloom/{spark.sparkContext.applicationId}/x-")
    assert path != scratch_path(spark, "x")


def test_unseen_labels(spark):
    index = indexing.build_index(skewed(spark).filter("key < 'k'"), "key")
    data = spark.createDataFrame([("hot",), ("never",), (None,)], "key string")
    by_mode = {
        mode: rows(indexing.apply_index(data, index, "key", "i", unseen=mode).select("i"))
        for mode in ("drop", "null", "keep")
    }
    assert by_mode["drop"] == [(0,)]
    assert by_mode["null"] == [(0,), (None,), (None,)]
    assert by_mode["keep"] == [(0,), (1,), (1,)]
    with pytest.raises(ValueError):
        indexing.apply_index(data, index, "key", "i", unseen="guess")
