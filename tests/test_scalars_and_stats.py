import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom import schemas
from songloom.functions import scalars
from songloom.functions.vectors import cosine, dot
from songloom.operators import catalog_stats, metrics, results, search
from tests.conftest import rows

NUMBERS = {
    "": 0.0, "  ": 0.0, None: 0.0, "abc": None, " 2001 ": 2001.0, "\t7\n": 7.0, "1e3": 1000.0,
    "0b" + "1" * 70: float(2**70 - 1), "0xffffffffffffffffffff": float(16**20 - 1),
    "-7": -7.0, "+4.": 4.0, ".5": 0.5, "1d": None, "12abc": None, "0x10": 16.0, "0b11": 3.0,
    "0o17": 15.0, "Infinity": math.inf, "-Infinity": -math.inf, "NaN": None, "1,5": None, ".": None,
}


def test_numbers_as_a_browser_reads_them(spark):
    data = spark.createDataFrame([(text,) for text in NUMBERS], "text string")
    got = {r.text: r.number for r in data.select("text", scalars.to_number("text").alias("number")).collect()}
    assert got == NUMBERS


def test_rating_text_equals_float_formatting(spark):
    values = [0.125, 0.375, 1.005, 2.5, -0.001, -1.255, 3.14159, 0.0, 1e6 / 3]
    singles = [float(np.float32(v)) for v in values]
    data = spark.createDataFrame([(v,) for v in singles], "rating float")
    text = data.select(scalars.format_rating("rating")).collect()
    assert [row[0] for row in text] == [f"{v:.2f}" for v in singles]
    doubles = [*values, 0.165, 8.345, 4.565, 2.675, 0.155, 0.215, 1e15 + 0.3, -0.005, *[n / 1000 for n in range(5, 3000, 10)]]
    data = spark.createDataFrame([*[(v,) for v in doubles], (None,)], "rating double")
    text = data.select(scalars.format_rating("rating")).collect()
    assert [row[0] for row in text] == [*[f"{v:.2f}" for v in doubles], None]


def test_labels_and_requests(spark):
    data = spark.createDataFrame([("Brand#12",), ("ab",), ("a b&c",)], "t string")
    assert rows(data.select(scalars.short_label("t"))) == [("Brand...",), ("a b&c...",), ("ab...",)]
    sent = data.filter("t like 'a b%'").select(scalars.cover_request("t", "http://x/?q="))
    assert rows(sent) == [("http://x/?q=a%20b%26c&type=track",)]


def test_covers(spark):
    bodies = [
        ("one", '{"tracks":{"items":[{"album":{"images":[{"url":"u1"},{"url":"u2"}]}}]}}'),
        ("one", '{"tracks":{"items":[{"album":{"images":[{"url":"u1"},{"url":"u2"}]}}]}}'),
        ("one", '{"tracks":{"items":[]}}'),
        ("none", '{"tracks":{"items":[]}}'),
        ("odd", "{}"),
    ]
    stored = spark.createDataFrame(bodies, "title string, body string")
    recs = spark.createDataFrame([("one",), ("none",), ("odd",), ("unknown",)], "title string")
    expected = [("none", None), ("odd", None), ("one", "u1"), ("unknown", None)]
    assert rows(results.attach_covers(recs, stored)) == expected


def test_vectors(spark):
    data = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "u array<float>, v array<float>")
    got = data.select(dot("u", "v"), F.round(cosine("u", "v"), 6)).collect()
    assert tuple(got[0]) == (11.0, 0.98387) and tuple(got[1]) == (0.0, None)


@pytest.fixture
def catalog(spark):
    data = [
        ("1", "Sun", "r", "B", 2001), ("2", "sunny", "r", "A", 2001), ("3", None, "r", None, 0),
        ("4", "Moon", "r", "A", None), ("4", "Moon", "r", "A", None), ("5", "Sun", "r", "C", 1990),
    ]
    return spark.createDataFrame(data, schemas.CATALOG)


def test_series(catalog):
    assert rows(catalog_stats.songs_per_year(catalog)) == [(1990.0, 1), (2001.0, 2)]
    assert rows(catalog_stats.songs_per_artist(catalog)) == [("", 1), ("A", 3), ("B", 1), ("C", 1)]
    once = catalog_stats.songs_per_artist(catalog, distinct=True)
    assert rows(once) == [("", 1), ("A", 2), ("B", 1), ("C", 1)]
    trend = catalog_stats.release_trend(catalog).collect()
    assert [tuple(row) for row in trend] == [(1990.0, 1, 1), (2001.0, 2, 2)]
    assert [r.artist for r in catalog_stats.top_artists(catalog, 2).collect()] == ["A", ""]


def test_pie(catalog):
    slices = catalog_stats.artist_share(catalog, 2).orderBy("start_angle").collect()
    assert [(r.artist, r.share) for r in slices] == [("A", 0.75), ("", 0.25)]
    assert slices[0].end_angle == pytest.approx(slices[1].start_angle)
    assert slices[1].end_angle == pytest.approx(2 * math.pi)


def test_search(catalog):
    assert rows(search.find_songs(catalog, "Sun").select("song_id")) == [("1",), ("5",)]
    assert search.find_songs(catalog, "SUN", ignore_case=True).count() == 3
    assert search.find_songs(catalog, "").count() == 5  # every title but the null one
    assert search.has_rows(catalog) and not search.has_rows(search.find_songs(catalog, "zzz"))
    assert search.pick_song(search.find_songs(catalog, "un")).first().song_id == "1"


def test_error_measures_skip_unusable_predictions(spark):
    data = spark.createDataFrame(
        [(1, 1, 2.0), (1, 3, 3.0), (2, 5, 1.0), (2, 1, float("nan")), (2, 1, None), (2, None, 1.0)],
        "batch int, listen_count int, prediction double",
    )
    assert metrics.rmse(data).first()[0] == pytest.approx(math.sqrt(17 / 3))
    assert rows(metrics.mse(data, by="batch")) == [(1, 0.5), (2, 16.0)]
    assert metrics.mse(data).first()[0] == pytest.approx(17 / 3)
