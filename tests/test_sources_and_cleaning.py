import pytest

from songloom import schemas
from songloom.operators import cleaning
from songloom.plans import ingest
from songloom.sources import files
from songloom.storage import scratch_path
from tests.conftest import rows

CATALOG = [
    ("s1", "T1", "R1", "A1", 2001),
    ("s1", "T1", "R1", "A1", None),
    ("s1", "T1", "R1", "A1", 0),
    ("s2", "T2", "R2", "A2", None),
    ("s1", "T1", "R1", "A1", 2001),
    (None, "T3", "R3", None, 1999),
]
INTERACTIONS = [("u1", "s1", 3), ("u1", "sX", 1), ("u2", "s2", 2), (None, "s2", 1), ("u2", "s2", None)]


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(CATALOG, schemas.CATALOG)


@pytest.fixture
def interactions(spark):
    return spark.createDataFrame(INTERACTIONS, schemas.INTERACTIONS)


def test_order_of_fill_and_dedupe(catalog):
    assert cleaning.clean(catalog, "fill_first").count() == 4
    late = cleaning.clean(catalog, "dedupe_first")
    assert (late.count(), late.distinct().count()) == (5, 4)
    with pytest.raises(ValueError):
        cleaning.clean(catalog, "never")


def test_dedupe_by_key_keeps_one_known_version(catalog):
    kept = {row.song_id: row.year for row in cleaning.dedupe_by_key(catalog, ["song_id"]).collect()}
    assert kept == {"s1": 0, "s2": None, None: 1999}


def test_weights(interactions):
    assert {r.listen_count for r in cleaning.with_weight(interactions).collect()} == {1}
    listens = cleaning.with_weight(interactions, "listens").select("listen_count")
    assert rows(listens) == [(0,), (1,), (1,), (2,), (3,)]
    with pytest.raises(ValueError):
        cleaning.with_weight(interactions, "other")


def test_pairs_are_folded(spark):
    data = spark.createDataFrame([("u", "a", 2), ("u", "a", 3), ("u", "b", 1)], schemas.INTERACTIONS)
    assert rows(cleaning.fold_pairs(data)) == [("u", "a", 5.0), ("u", "b", 1.0)]
    assert rows(cleaning.fold_pairs(data, "unit")) == [("u", "a", 1.0), ("u", "b", 1.0)]
    with pytest.raises(ValueError):
        cleaning.fold_pairs(data, "other")


def test_swapped_csv_columns_are_refused(spark, interactions):
    path = scratch_path(spark, "swapped")
    interactions.select("song_id", "user_id", "listen_count").write.option("header", True).csv(path)
    with pytest.raises(Exception, match="header does not conform"):
        files.read_interactions(spark, path).collect()


def test_unparseable_year_becomes_null(spark):
    path = scratch_path(spark, "bad-year")
    lines = ["song_id,title,release,artist_name,year", "s1,T1,R1,A1,abc", "s2,T2,R2,A2,1999"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    years = files.read_catalog(spark, path).select("song_id", "year")
    assert rows(years) == [("s1", None), ("s2", 1999)]


def test_ingest_from_csv_to_json(spark, catalog, interactions):
    paths = {name: scratch_path(spark, name) for name in ("c", "i", "cj", "pj")}
    catalog.write.option("header", True).csv(paths["c"])
    interactions.write.option("header", True).csv(paths["i"])
    for _ in range(2):  # the second run overwrites
        ingest.run_ingest(spark, paths["c"], paths["i"], paths["cj"], paths["pj"], listens=True)
    stored = files.read_catalog_json(spark, paths["cj"])
    assert rows(stored) == rows(cleaning.clean(catalog))
    lists = {
        row.user_id: [(s.song_id, s.title, s.year, s.listen_count) for s in row.songs]
        for row in files.read_playlists_json(spark, paths["pj"], listens=True).collect()
    }
    assert lists["u1"] == [("s1", "T1", 0, 3), ("s1", "T1", 2001, 3), ("sX", None, None, 1)]
    assert lists["u2"] == [("s2", "T2", 0, 0), ("s2", "T2", 0, 2)]
    assert lists[None] == [("s2", "T2", 0, 1)]
