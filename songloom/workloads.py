"""Every operator as a query over the supplied tables, next to SQL that states its result.

The supplied tables stand in for a song catalog and listening records: ``part`` is the catalog,
``lineitem`` joined to ``orders`` the interactions, ``documents`` the reviews, ``embeddings`` a
fixed factor table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.functions import scalars
from songloom.functions.tokens import words
from songloom.functions.vectors import dot
from songloom.models import als, embedding
from songloom.operators import (
    catalog_stats,
    cleaning,
    indexing,
    metrics,
    playlists,
    pruned,
    results,
    scoring,
    search,
    splitting,
)
from songloom.plans import content, cooccurrence, hybrid, ingest, recommend, reviews
from songloom.sources import files
from songloom.storage import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEED = 42
TITLE_TEXT = "small ring"
ENTRY_COLUMNS = ["song_id", "title", "artist_name", "year"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# --- the supplied tables in the shape of the data model ------------------------------------------

SONGS_SQL = """songs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS title, p_type AS release,
         p_brand AS artist_name, p_size AS year FROM part)"""
TRIPLETS_SQL = """triplets AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS song_id,
         CAST(l_quantity AS INTEGER) AS listen_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
# every song twice, years of 1 unknown; listens of 1 unknown
RAW_SONGS_SQL = f"""{SONGS_SQL}, raw_songs AS (
  SELECT song_id, title, release, artist_name, nullif(year, 1) AS year FROM songs
  UNION ALL SELECT song_id, title, release, artist_name, year FROM songs)"""
RAW_TRIPLETS_SQL = f"""{TRIPLETS_SQL}, raw_triplets AS (
  SELECT user_id, song_id, nullif(listen_count, 1) AS listen_count FROM triplets)"""
# years as they come in a text file
TEXT_SONGS_SQL = f"""{SONGS_SQL}, text_songs AS (
  SELECT song_id, title, release, artist_name,
         CASE year WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN ' 2001 ' WHEN 4 THEN '0'
                   WHEN 5 THEN '-7' WHEN 6 THEN '1.5e3' ELSE CAST(year AS VARCHAR) END AS year
  FROM songs)"""
INDEX_SQL = """song_index AS (
  SELECT song_id, n, row_number() OVER (ORDER BY n DESC, song_id) - 1 AS song_index
  FROM (SELECT song_id, count(*) AS n FROM triplets GROUP BY song_id))"""
TOP_SQL = """scores AS (
  SELECT u.vec_id AS user_index, i.vec_id AS song_index,
         round(list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6)
           AS score
  FROM embeddings u, embeddings i WHERE u.label = 0 AND i.label <> 0),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY user_index ORDER BY score DESC, song_index) AS rank FROM scores)
  WHERE rank <= 5)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def songs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("song_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("release"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_size").alias("year"),
    )


def triplets(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("song_id"),
        F.col("l_quantity").cast("int").alias("listen_count"),
    )


def raw_songs(spark: SparkSession, sf: str) -> DataFrame:
    rows = songs(spark, sf)
    return rows.withColumn("year", F.nullif("year", F.lit(1))).union(rows)


def raw_triplets(spark: SparkSession, sf: str) -> DataFrame:
    unknown = F.nullif("listen_count", F.lit(1))
    return triplets(spark, sf).withColumn("listen_count", unknown)


def text_songs(spark: SparkSession, sf: str) -> DataFrame:
    year = F.when(F.col("year") == 1, "")
    for number, text in {2: "abc", 3: " 2001 ", 4: "0", 5: "-7", 6: "1.5e3"}.items():
        year = year.when(F.col("year") == number, text)
    return songs(spark, sf).withColumn("year", year.otherwise(F.col("year").cast("string")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def factors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    picked = [F.col("vec_id").alias("id"), F.col("embedding").alias("features")]
    return rows.filter("label = 0").select(picked), rows.filter("label <> 0").select(picked)


def fixed_top(spark: SparkSession, sf: str) -> DataFrame:
    users, items = factors(spark, sf)
    return scoring.top_scores(users, items, 5, digits=6)


def as_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, **keep_spaces).csv(path)
    return path


def as_json(df: DataFrame, name: str, partitions: int | None = None) -> str:
    path = scratch_path(df.sparkSession, name)
    files.write_json(df, path, partitions)
    return path


# --- sources and sinks ---------------------------------------------------------------------------


@query(f"WITH {RAW_SONGS_SQL} SELECT * FROM raw_songs")
def scan_csv_catalog(spark, sf):
    return files.read_catalog(spark, as_csv(raw_songs(spark, sf), "catalog-csv"))


@query(f"WITH {RAW_TRIPLETS_SQL} SELECT * FROM raw_triplets")
def scan_csv_interactions(spark, sf):
    return files.read_interactions(spark, as_csv(raw_triplets(spark, sf), "interactions-csv"))


@query(f"WITH {TEXT_SONGS_SQL} SELECT * FROM text_songs")
def scan_csv_untyped(spark, sf):
    rows = files.read_catalog_raw(spark, as_csv(text_songs(spark, sf), "raw-csv"))
    return rows.fillna({"year": ""})


@query(f"WITH {RAW_SONGS_SQL} SELECT * FROM raw_songs")
def scan_json_catalog(spark, sf):
    return files.read_catalog_json(spark, as_json(raw_songs(spark, sf), "catalog-json"))


PLAYLIST_ENTRIES_SQL = f"""WITH {TRIPLETS_SQL}, {SONGS_SQL}
SELECT t.user_id, t.song_id, s.title, s.artist_name, s.year
FROM (SELECT DISTINCT * FROM triplets) t LEFT JOIN songs s ON t.song_id = s.song_id"""


@query(PLAYLIST_ENTRIES_SQL)
def scan_json_playlists(spark, sf):
    nested = ingest.prepare_playlists(triplets(spark, sf), songs(spark, sf))
    read = files.read_playlists_json(spark, as_json(nested, "playlists-json"))
    return playlists.flatten_playlist_entries(read)


@query(
    f"""WITH {RAW_SONGS_SQL}
    SELECT DISTINCT song_id, title, release, artist_name, coalesce(year, 0) AS year
    FROM raw_songs"""
)
def sink_json_catalog(spark, sf):
    path = as_json(cleaning.clean(raw_songs(spark, sf)), "catalog-json")
    return files.read_catalog_json(spark, path)


@query(
    f"""WITH {RAW_TRIPLETS_SQL}, {SONGS_SQL},
    t AS (SELECT DISTINCT user_id, song_id, coalesce(listen_count, 0) AS listen_count
          FROM raw_triplets)
    SELECT t.user_id, t.song_id, s.title, s.artist_name, s.year
    FROM t LEFT JOIN songs s ON t.song_id = s.song_id"""
)
def sink_json_playlists(spark, sf):
    """The whole ingest job, from two CSV files to two JSON datasets."""
    catalog_json, playlists_json = scratch_path(spark, "songs"), scratch_path(spark, "users")
    ingest.run_ingest(
        spark,
        as_csv(songs(spark, sf), "catalog-csv"),
        as_csv(raw_triplets(spark, sf), "interactions-csv"),
        catalog_json,
        playlists_json,
    )
    return playlists.flatten_playlist_entries(files.read_playlists_json(spark, playlists_json))


@query(f"WITH {TRIPLETS_SQL} SELECT * FROM triplets")
def repartition_output(spark, sf):
    path = as_json(triplets(spark, sf), "ten-parts", partitions=10)
    return spark.read.schema("user_id string, song_id string, listen_count int").json(path)


# --- projections and filters ---------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS title FROM part")
def cast_song_id(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title")
    )
    return cleaning.normalise_ids(rows)


ENRICHED_SQL = f"""WITH {TRIPLETS_SQL}, {SONGS_SQL},
known AS (SELECT * FROM songs WHERE year <= 25),
enriched AS (SELECT t.user_id, t.song_id, t.listen_count, k.title, k.release, k.artist_name, k.year
             FROM triplets t LEFT JOIN known k ON t.song_id = k.song_id)"""


def enriched(spark, sf):
    """Interactions against a catalog that lacks the songs after year 25."""
    return playlists.enrich(triplets(spark, sf), songs(spark, sf).filter("year <= 25"))


@query(f"{ENRICHED_SQL} SELECT * FROM enriched")
def enrich_left_join(spark, sf):
    return enriched(spark, sf)


@query(f"{ENRICHED_SQL} SELECT user_id, song_id, title, artist_name, year FROM enriched")
def drop_listen_count(spark, sf):
    packed = enriched(spark, sf).select("user_id", scalars.song_struct().alias("song"))
    return packed.select("user_id", "song.*")


@query(
    f"""{ENRICHED_SQL}
    SELECT user_id, concat_ws('|', song_id, title, artist_name, CAST(year AS VARCHAR),
                              CAST(listen_count AS VARCHAR)) AS song FROM enriched"""
)
def pack_song(spark, sf):
    packed = enriched(spark, sf).select("user_id", scalars.song_struct(listens=True).alias("song"))
    entry = [F.col(f"song.{name}").cast("string") for name in [*ENTRY_COLUMNS, "listen_count"]]
    return packed.select("user_id", F.concat_ws("|", *entry).alias("song"))


@query(f"WITH {TRIPLETS_SQL} SELECT user_id, song_id, 1 AS listen_count FROM triplets")
def implicit_weight(spark, sf):
    return cleaning.with_weight(triplets(spark, sf))


@query(f"WITH {SONGS_SQL} SELECT * FROM songs WHERE contains(title, 'ring')")
def title_contains(spark, sf):
    return search.find_songs(songs(spark, sf), "ring")


@query(
    f"""WITH {SONGS_SQL}
    SELECT 'ring' AS text, count(*) > 0 AS found FROM songs WHERE contains(title, 'ring')
    UNION ALL
    SELECT 'zzz', count(*) > 0 FROM songs WHERE contains(title, 'zzz')"""
)
def exists_check(spark, sf):
    catalog = songs(spark, sf)

    def answer(text: str) -> DataFrame:
        found = search.exists(search.find_songs(catalog, text))
        return found.select(F.lit(text).alias("text"), "found")

    return answer("ring").union(answer("zzz"))


@query(
    f"""WITH {SONGS_SQL} SELECT song_id, title, release, artist_name, year FROM songs
    WHERE contains(title, '{TITLE_TEXT}') ORDER BY title, song_id LIMIT 1"""
)
def first_match(spark, sf):
    return search.pick_song(search.find_songs(songs(spark, sf), TITLE_TEXT))


TO_NUMBER_SQL = """CASE WHEN coalesce(trim(year), '') = '' THEN 0
                        ELSE TRY_CAST(trim(year) AS DOUBLE) END"""


@query(
    f"""WITH {TEXT_SONGS_SQL}, numbers AS (SELECT song_id, {TO_NUMBER_SQL} AS year FROM text_songs)
    SELECT song_id, year FROM numbers WHERE year > 0"""
)
def valid_year(spark, sf):
    return catalog_stats.valid_years(text_songs(spark, sf).select("song_id", "year"))


@query(f"WITH {TEXT_SONGS_SQL} SELECT song_id, {TO_NUMBER_SQL} AS number FROM text_songs")
def to_number(spark, sf):
    return text_songs(spark, sf).select("song_id", scalars.to_number("year").alias("number"))


@query(f"WITH {SONGS_SQL} SELECT song_id, substr(artist_name, 1, 5) || '...' AS label FROM songs")
def short_label(spark, sf):
    return songs(spark, sf).select("song_id", scalars.short_label("artist_name").alias("label"))


@query(
    """SELECT vec_id, printf('%.2f', CAST(embedding[1] AS DOUBLE)) AS text,
              printf('%.2f', CAST(vec_id * 10 + 5 AS DOUBLE) / 1000) AS half,
              CASE WHEN vec_id % 2 = 0 THEN printf('%.2f', CAST(vec_id AS DOUBLE) / 8) END AS eighth
    FROM embeddings"""
)
def format_rating(spark, sf):
    """Factors as ratings, and doubles whose decimal text ends in a half, as some of them do."""
    values = {
        "text": F.get("embedding", F.lit(0)),
        "half": (F.col("vec_id") * 10 + 5).cast("double") / 1000,
        "eighth": F.when(F.col("vec_id") % 2 == 0, F.col("vec_id").cast("double") / 8),
    }
    rated = [scalars.format_rating(value).alias(name) for name, value in values.items()]
    return table(spark, sf, "embeddings").select("vec_id", *rated)


@query(
    """SELECT p_partkey, 'https://search.example/?q=' || url_encode(p_name) || '&type=track'
    AS request FROM part"""
)
def cover_request(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", scalars.cover_request("p_name", "https://search.example/?q=").alias("request")
    )


def responses(catalog: DataFrame) -> DataFrame:
    """Stored search responses: a cover per release, and none for the songs of year 1."""
    image = F.struct(F.concat(F.lit("https://img.example/"), "release").alias("url"))
    album = F.struct(F.struct(F.array(image).alias("images")).alias("album"))
    items = F.when(F.col("year") > 1, F.array(album)).otherwise(F.array().cast(
        "array<struct<album:struct<images:array<struct<url:string>>>>>"
    ))
    body = F.to_json(F.struct(F.struct(items.alias("items")).alias("tracks")))
    return catalog.select("song_id", "title", body.alias("body"))


COVER_SQL = "CASE WHEN year > 1 THEN 'https://img.example/' || release END"


@query(f"WITH {SONGS_SQL} SELECT song_id, {COVER_SQL} AS cover_url FROM songs")
def cover_url(spark, sf):
    bodies = responses(songs(spark, sf))
    return bodies.select("song_id", scalars.cover_url("body").alias("cover_url"))


# --- cleaning and nesting ------------------------------------------------------------------------


@query(f"WITH {RAW_SONGS_SQL} SELECT DISTINCT * FROM raw_songs")
def dedup_catalog(spark, sf):
    return cleaning.dedupe(raw_songs(spark, sf))


@query(f"WITH {TRIPLETS_SQL} SELECT DISTINCT * FROM triplets")
def dedup_interactions(spark, sf):
    return cleaning.dedupe(triplets(spark, sf))


@query(
    f"""WITH {RAW_SONGS_SQL}
    SELECT song_id, title, release, artist_name, coalesce(year, 0) AS year
    FROM (SELECT DISTINCT * FROM raw_songs)"""
)
def fill_year(spark, sf):
    return cleaning.clean(raw_songs(spark, sf), order="dedupe_first")


@query(
    f"""WITH {RAW_TRIPLETS_SQL}
    SELECT DISTINCT user_id, song_id, coalesce(listen_count, 0) AS listen_count FROM raw_triplets"""
)
def fill_listens(spark, sf):
    return cleaning.clean(raw_triplets(spark, sf), order="fill_first")


@query(
    f"""WITH {TRIPLETS_SQL}, {SONGS_SQL},
    entries AS (SELECT t.user_id, concat_ws('|', t.song_id, s.title, s.artist_name,
                                            CAST(s.year AS VARCHAR)) AS song, t.song_id
                FROM triplets t LEFT JOIN songs s ON t.song_id = s.song_id)
    SELECT user_id, count(*) AS n, string_agg(song, ';' ORDER BY song_id) AS songs
    FROM entries GROUP BY user_id"""
)
def build_playlists(spark, sf):
    nested = playlists.build_playlists(playlists.enrich(triplets(spark, sf), songs(spark, sf)))
    entry = F.transform(
        "songs", lambda s: F.concat_ws("|", *[s[name].cast("string") for name in ENTRY_COLUMNS])
    )
    return nested.select(
        "user_id", F.size("songs").cast("bigint").alias("n"), F.array_join(entry, ";").alias("songs")
    )


@query(f"WITH {TRIPLETS_SQL} SELECT user_id, song_id FROM triplets")
def flatten_playlists(spark, sf):
    nested = playlists.build_playlists(playlists.enrich(triplets(spark, sf), songs(spark, sf)))
    return playlists.flatten_playlists(nested)


# --- catalog charts ------------------------------------------------------------------------------

PER_YEAR_SQL = f"""WITH {TEXT_SONGS_SQL},
numbers AS (SELECT {TO_NUMBER_SQL} AS year FROM text_songs),
per_year AS (SELECT year, count(*) AS n FROM numbers WHERE year > 0 GROUP BY year)"""
PER_ARTIST_SQL = f"""WITH {SONGS_SQL},
per_artist AS (SELECT coalesce(artist_name, '') AS artist, count(*) AS n FROM songs
               GROUP BY coalesce(artist_name, '')),
top AS (SELECT * FROM per_artist ORDER BY n DESC, artist LIMIT 10)"""


@query(f"{PER_YEAR_SQL} SELECT year, n FROM per_year")
def songs_per_year(spark, sf):
    return catalog_stats.songs_per_year(text_songs(spark, sf))


@query(f"{PER_ARTIST_SQL} SELECT artist, n FROM per_artist")
def songs_per_artist(spark, sf):
    return catalog_stats.songs_per_artist(songs(spark, sf))


@query(f"{PER_ARTIST_SQL} SELECT max(n) AS max_n FROM per_artist")
def series_max(spark, sf):
    return catalog_stats.series_max(catalog_stats.songs_per_artist(songs(spark, sf)))


@query(f"{PER_ARTIST_SQL} SELECT artist, n, n / max(n) OVER () AS fraction FROM per_artist")
def scaled_count(spark, sf):
    return catalog_stats.scaled_counts(catalog_stats.songs_per_artist(songs(spark, sf)))


@query(f"{PER_ARTIST_SQL} SELECT artist, n FROM top")
def first_k_artists(spark, sf):
    return catalog_stats.top_artists(songs(spark, sf), 10)


@query(
    f"""{PER_ARTIST_SQL}, ends AS (
      SELECT artist, n, sum(n) OVER () AS total,
             sum(n) OVER (ORDER BY n DESC, artist ROWS UNBOUNDED PRECEDING) AS until FROM top)
    SELECT artist, n, round(n / total, 6) AS share,
           round((until - n) / total * 2 * pi(), 6) AS start_angle,
           round(until / total * 2 * pi(), 6) AS end_angle FROM ends"""
)
def artist_share(spark, sf):
    slices = catalog_stats.artist_share(songs(spark, sf), 10)
    rounded = [F.round(c, 6).alias(c) for c in ("share", "start_angle", "end_angle")]
    return slices.select("artist", "n", *rounded)


@query(f"{PER_YEAR_SQL} SELECT year, n, row_number() OVER (ORDER BY year) AS position FROM per_year")
def release_trend(spark, sf):
    return catalog_stats.release_trend(text_songs(spark, sf))


# --- ids, splits, pages, measures ----------------------------------------------------------------


@query(
    f"""WITH {TRIPLETS_SQL}, {INDEX_SQL}
    SELECT song_id AS label, n, song_index AS "index" FROM song_index"""
)
def frequency_index(spark, sf):
    return indexing.build_index(triplets(spark, sf), "song_id")


@query(
    f"""WITH {TRIPLETS_SQL},
    heavy AS (SELECT song_id, row_number() OVER (ORDER BY count(*) DESC, song_id) - 1 AS song_index
              FROM triplets WHERE listen_count = 50 GROUP BY song_id)
    SELECT t.user_id, t.song_id, t.listen_count,
           coalesce(h.song_index, (SELECT count(*) FROM heavy)) AS song_index
    FROM triplets t LEFT JOIN heavy h ON t.song_id = h.song_id"""
)
def apply_index(spark, sf):
    """Index of the songs heard 50 times by someone, applied to all; the rest are unseen."""
    rows = triplets(spark, sf)
    heavy = indexing.build_index(rows.filter("listen_count = 50"), "song_id")
    return indexing.apply_index(rows, heavy, "song_id", "song_index", unseen="keep")


def indexed_triplets(spark, sf):
    rows = triplets(spark, sf)
    users = indexing.build_index(rows, "user_id")
    catalog = indexing.build_index(rows, "song_id")
    return indexing.index_interactions(rows, users, catalog)


@query(
    f"""WITH {TRIPLETS_SQL}
    SELECT count(DISTINCT user_id) - 1 AS max_user_index,
           count(DISTINCT song_id) - 1 AS max_song_index FROM triplets"""
)
def max_index(spark, sf):
    return indexing.index_sizes(indexed_triplets(spark, sf))


@query(f"WITH {TRIPLETS_SQL} SELECT count(*) AS n FROM triplets")
def count_rows(spark, sf):
    return triplets(spark, sf).agg(F.count(F.lit(1)).alias("n"))


HASH_SQL = "CAST('0x' || substr(md5(concat_ws('|', user_id, song_id, '{}')), 1, 15) AS BIGINT)"


@query(
    f"""WITH {TRIPLETS_SQL}
    SELECT user_id, song_id, listen_count,
           CASE WHEN {HASH_SQL.format('')} % 100 < 80 THEN 'train' ELSE 'test' END AS part
    FROM triplets"""
)
def hash_split(spark, sf):
    train, test = splitting.hash_split(triplets(spark, sf), ["user_id", "song_id"], 80)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


def digits_sql(*parts: object) -> str:
    """The first 15 hexadecimal digits of an MD5 of the parts, as a number."""
    return f"CAST('0x' || substr(md5(concat_ws('/', {', '.join(map(str, parts))})), 1, 15) AS BIGINT)"


NUMBERED_SQL = f"""{TRIPLETS_SQL}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY user_id, song_id, listen_count) - 1 AS row FROM triplets)"""


@query(
    f"""WITH {NUMBERED_SQL}
    SELECT user_id, song_id, listen_count,
           CASE WHEN {digits_sql(SEED, 'row')} / CAST(1152921504606846976 AS DOUBLE) < 0.8::DOUBLE
                THEN 'train' ELSE 'test' END AS part FROM numbered"""
)
def train_test_split(spark, sf):
    """Every interaction with its part of the split."""
    train, test = splitting.split(triplets(spark, sf), 0.8, SEED, ["user_id", "song_id"])
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query(f"WITH {NUMBERED_SQL} SELECT user_id, song_id, listen_count, row // 1000 AS batch FROM numbered")
def page_batches(spark, sf):
    return splitting.batches(triplets(spark, sf), 1000, ["user_id", "song_id"])


def network_sql(source: str, key: str) -> str:
    """One pass of ``source(row, cell)`` through the Feistel network of a key."""
    sql = f"SELECT row, wide, high, cell // high AS x, cell % high AS y FROM {source}, sized"
    for turn in range(6):
        x, y = (f"(x + {digits_sql(key, turn, 'y')}) % wide", "y") if turn % 2 == 0 else ("x", f"(y + {digits_sql(key, turn, 'x')}) % high")
        sql = f"SELECT row, wide, high, {x} AS x, {y} AS y FROM ({sql})"
    return f"SELECT row, x * high + y AS cell FROM ({sql})"


@query(
    f"""WITH RECURSIVE {NUMBERED_SQL},
    counted AS (SELECT count(*) AS n FROM numbered),
    sized AS (SELECT wide, (n + wide - 1) // wide AS high
              FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS wide FROM counted)),
    walk AS (
      {network_sql('(SELECT row, row AS cell FROM numbered)', "'0/3'")}
      UNION ALL
      {network_sql('(SELECT row, cell FROM walk WHERE cell >= (SELECT n FROM counted))', "'0/3'")})
    SELECT user_id, song_id, listen_count, cell // 32 AS batch
    FROM numbered JOIN walk USING (row) WHERE cell < (SELECT n FROM counted)"""
)
def epoch_shuffle(spark, sf):
    """The mini-batch of every interaction in the fourth epoch: 32 rows each, but the last."""
    return splitting.epoch_shuffle(triplets(spark, sf), 32, ["user_id", "song_id"], epoch=3)


PREDICTED_SQL = f"""WITH {TRIPLETS_SQL},
means AS (SELECT song_id, avg(listen_count) AS prediction FROM triplets GROUP BY song_id),
predicted AS (SELECT t.*, m.prediction FROM triplets t JOIN means m ON t.song_id = m.song_id)"""


def predicted(spark, sf):
    """Every interaction next to the mean listens of its song."""
    rows = triplets(spark, sf)
    means = rows.groupBy("song_id").agg(F.avg("listen_count").alias("prediction"))
    return rows.join(means, "song_id")


@query(
    f"""{PREDICTED_SQL}
    SELECT round(sqrt(avg(power(listen_count - prediction, 2))), 6) AS rmse FROM predicted"""
)
def rmse(spark, sf):
    return metrics.rmse(predicted(spark, sf)).select(F.round("rmse", 6).alias("rmse"))


@query(
    f"""{PREDICTED_SQL}, paged AS (
      SELECT *, (row_number() OVER (ORDER BY user_id, song_id, listen_count) - 1) // 1000 AS batch
      FROM predicted)
    SELECT batch, round(avg(power(listen_count - prediction, 2)), 6) AS mse
    FROM paged GROUP BY batch"""
)
def mse_loss(spark, sf):
    paged = splitting.batches(predicted(spark, sf), 1000, ["user_id", "song_id"])
    return metrics.mse(paged, by="batch").select("batch", F.round("mse", 6).alias("mse"))


# --- scores and results on a fixed factor table --------------------------------------------------


@query(
    """SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]),
              CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS score FROM embeddings"""
)
def dot_product(spark, sf):
    score = dot("embedding", F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query(
    """WITH scores AS (
      SELECT u.vec_id AS user, list_dot_product(CAST(u.embedding AS DOUBLE[]),
                                                CAST(i.embedding AS DOUBLE[])) AS score
      FROM embeddings u, embeddings i WHERE u.label = 0 AND i.label <> 0)
    SELECT user, count(*) AS items, round(min(score), 6) AS lowest, round(max(score), 6) AS highest,
           round(avg(score), 6) AS mean FROM scores GROUP BY user"""
)
def rec_scoring_cross(spark, sf):
    users, items = factors(spark, sf)
    stats = scoring.score_summary(users, items)
    rounded = [F.round(c, 6).alias(c) for c in ("lowest", "highest", "mean")]
    return stats.select("user", "items", *rounded)


@query(f"WITH {TOP_SQL} SELECT user_index AS user, song_index AS item, score, rank FROM top")
def topn_scores(spark, sf):
    return fixed_top(spark, sf)


@query(
    f"""WITH {TOP_SQL}
    SELECT user_index, song_index, rank, CAST(CAST(score AS FLOAT) AS DOUBLE) AS rating FROM top"""
)
def flatten_recs(spark, sf):
    flat = scoring.flatten_recs(scoring.nest_recs(fixed_top(spark, sf)))
    return flat.withColumn("rating", F.col("rating").cast("double"))


@query(f"WITH {TOP_SQL} SELECT song_index, CAST(CAST(score AS FLOAT) AS DOUBLE) AS rating FROM top")
def source_inline_rows(spark, sf):
    flat = scoring.flatten_recs(scoring.nest_recs(fixed_top(spark, sf)))
    return flat.select("song_index", F.col("rating").cast("double").alias("rating"))


TITLED_SQL = f"""WITH {TOP_SQL}, {TRIPLETS_SQL}, {SONGS_SQL}, {INDEX_SQL},
titled AS (SELECT s.song_id, s.title, s.artist_name, t.score AS rating
           FROM top t JOIN song_index i ON t.song_index = i.song_index
                      JOIN songs s ON s.song_id = i.song_id)"""


def titled(spark, sf):
    recs = fixed_top(spark, sf).select(
        F.col("item").alias("song_index"), F.col("score").alias("rating")
    )
    index = indexing.build_index(triplets(spark, sf), "song_id")
    return results.attach_titles(recs, songs(spark, sf), index)


@query(f"{TITLED_SQL} SELECT song_id, title, artist_name, rating FROM titled")
def rec_titles(spark, sf):
    return titled(spark, sf)


@query(f"WITH {SONGS_SQL} SELECT song_id, title, artist_name, year AS rating FROM songs")
def project_result(spark, sf):
    return results.project_result(songs(spark, sf).withColumnRenamed("year", "rating"))


@query(
    f"""{TITLED_SQL} SELECT song_id, title, artist_name, rating FROM titled
    ORDER BY rating DESC, song_id"""
)
def collect_result(spark, sf):
    return results.ordered(titled(spark, sf))


@query(
    f"""{TITLED_SQL}, bodies AS (
      SELECT title, body, row_number() OVER (PARTITION BY title ORDER BY body) AS place
      FROM (SELECT title, {COVER_SQL} AS body FROM songs) WHERE body IS NOT NULL)
    SELECT t.song_id, t.title, t.artist_name, t.rating, b.body AS cover_url
    FROM titled t LEFT JOIN bodies b ON t.title = b.title AND b.place = 1"""
)
def attach_covers(spark, sf):
    found = responses(songs(spark, sf))
    return results.attach_covers(titled(spark, sf), found)


# --- models --------------------------------------------------------------------------------------

_fitted: dict[tuple[str, str, str], recommend.Fitted] = {}


def heard(spark, sf):
    return cleaning.with_weight(cleaning.clean(triplets(spark, sf)), "listens")


def fitted(spark, sf, name: str, params: als.ALSParams) -> recommend.Fitted:
    """One fit per session, table folder and parameter set, shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _fitted:
        _fitted[key] = recommend.fit(heard(spark, sf), SEED, params, mode="listens")
    return _fitted[key]


def all_factors(model) -> DataFrame:
    sides = [
        side.select(F.lit(name).alias("side"), "id", F.array_join("features", " ").alias("features"))
        for name, side in (("user", model.userFactors), ("song", model.itemFactors))
    ]
    return sides[0].union(sides[1])


def indexed_heard(spark, sf, ready: recommend.Fitted):
    return indexing.index_interactions(heard(spark, sf), ready.users, ready.songs)


USER_SIZES_SQL = f"""WITH {TRIPLETS_SQL},
sizes AS (SELECT user_id, count(*) AS n, count(DISTINCT song_id) AS songs
          FROM (SELECT DISTINCT * FROM triplets) GROUP BY user_id),
user_sizes AS (SELECT songs, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS user_index
               FROM sizes)"""


@query(f"{USER_SIZES_SQL} SELECT user_index, songs, true AS solved FROM user_sizes")
def als_default(spark, sf):
    """Every user of the trained model, and whether their factors solve their least squares."""
    ready = fitted(spark, sf, "default", als.DEFAULT)
    pairs = cleaning.fold_pairs(heard(spark, sf))
    indexed = indexing.index_interactions(pairs, ready.users, ready.songs)
    found = als.user_residuals(ready.model, indexed, als.DEFAULT.reg)
    return found.select("user_index", "songs", (F.col("residual") < 1e-5).alias("solved"))


@query(f"{USER_SIZES_SQL} SELECT user_index, songs, true AS nonnegative, true AS solved FROM user_sizes")
def als_nonneg(spark, sf):
    """Every user of the non-negative model, and whether their factors are the best without a negative one."""
    ready = fitted(spark, sf, "nonnegative", als.NONNEGATIVE)
    pairs = cleaning.fold_pairs(heard(spark, sf))
    indexed = indexing.index_interactions(pairs, ready.users, ready.songs)
    found = als.user_optimality(ready.model, indexed, als.NONNEGATIVE.reg)
    return found.select(
        "user_index", "songs", (F.col("lowest") >= 0).alias("nonnegative"), (F.col("residual") < 1e-5).alias("solved")
    )


@query(
    f"""WITH {TRIPLETS_SQL}
    SELECT 'user' AS side, count(DISTINCT user_id) AS nonnegative FROM triplets
    UNION ALL SELECT 'song', count(DISTINCT song_id) FROM triplets"""
)
def als_nonneg_signs(spark, sf):
    """How many users and songs have no negative factor: all of them."""
    model = fitted(spark, sf, "nonnegative", als.NONNEGATIVE).model
    sides = [
        side.filter(F.array_min("features") >= 0).agg(F.count(F.lit(1)).alias("nonnegative"))
        for side in (model.userFactors, model.itemFactors)
    ]
    return sides[0].select(F.lit("user").alias("side"), "nonnegative").union(
        sides[1].select(F.lit("song").alias("side"), "nonnegative")
    )


@query()
def als_factors(spark, sf):
    """The factors themselves."""
    return all_factors(fitted(spark, sf, "default", als.DEFAULT).model)


@query(
    f"""WITH {TRIPLETS_SQL}
    SELECT t.user_id, t.song_id, t.listen_count,
           round(list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6)
             AS prediction
    FROM (SELECT *, CAST(user_id AS BIGINT) % ((SELECT count(*) FROM embeddings) + 7) AS u,
                 CAST(song_id AS BIGINT) % (SELECT count(*) FROM embeddings) AS i FROM triplets) t
    JOIN embeddings u ON t.u = u.vec_id JOIN embeddings i ON t.i = i.vec_id"""
)
def predict_pairs(spark, sf):
    """Scores of all interactions under the fixed factors, which ids share by remainder; seven
    remainders of users have none."""
    known = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )
    n = known.count()
    pairs = triplets(spark, sf).withColumns(
        {"user": F.col("user_id").cast("long") % (n + 7), "item": F.col("song_id").cast("long") % n}
    )
    scored = scoring.score_pairs(pairs, known, known)
    return scored.select(
        "user_id",
        "song_id",
        "listen_count",
        F.round("score", 6).alias("prediction"),
    )


@query()
def predict_pairs_als(spark, sf):
    ready = fitted(spark, sf, "default", als.DEFAULT)
    return als.predict(ready.model, indexed_heard(spark, sf, ready))


@query()
def topn_all_users_als(spark, sf):
    ready = fitted(spark, sf, "default", als.DEFAULT)
    return scoring.flatten_recs(als.recommend_all(ready.model, 10))


@query(
    f"""WITH {TOP_SQL} SELECT user_index AS user, song_index AS item, score, rank FROM top
    WHERE user_index IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0)"""
)
def user_index_filter(spark, sf):
    """Recommendations of some users only: those whose first factor is positive."""
    users, items = factors(spark, sf)
    wanted = users.filter(F.get("features", F.lit(0)) > 0)
    picked = wanted.select(F.col("id").alias("user_index"))
    return scoring.top_for_users(users, items, picked, 5, digits=6)


@query()
def user_index_filter_als(spark, sf):
    """Recommendations of the users who heard the most popular song."""
    ready = fitted(spark, sf, "default", als.DEFAULT)
    fans = indexed_heard(spark, sf, ready).filter("song_index = 0").select("user_index")
    return scoring.flatten_recs(als.recs_for_user(ready.model, fans, 10))


@query(
    f"""WITH {TRIPLETS_SQL}
    SELECT 'user' AS side, count(DISTINCT user_id) AS same FROM triplets
    UNION ALL SELECT 'song', count(DISTINCT song_id) FROM triplets"""
)
def sink_model(spark, sf):
    """How many factor rows come back from storage as they were: one per user and per song."""
    path = scratch_path(spark, "model")
    model = fitted(spark, sf, "default", als.DEFAULT).model
    als.save_model(model, path)
    back = all_factors(als.load_model(path)).withColumnRenamed("features", "read")
    both = all_factors(model).join(back, ["side", "id"]).filter(F.col("features") == F.col("read"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("same"))


@query()
def training_report_als(spark, sf):
    rows = cut_lineage(indexed_triplets(spark, sf))
    return als.report(als.train_and_evaluate(rows, SEED))


def adam_sql(dim: int, step: float, epochs: int, rows: str = "true") -> str:
    """The training of the embeddings, one materialised table per step, the last one ``trained``.

    ``rows`` says which rows of ``all_data(user_id, song_id, user_index, song_index)`` are trained on.
    """

    def uniform(part: str) -> str:
        text = f"concat_ws('|', kind, CAST(id AS VARCHAR), '{SEED}/' || CAST(i AS VARCHAR) || '/{part}')"
        return f"((CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976)"

    parts = [
        f"""WITH {TRIPLETS_SQL}, {INDEX_SQL},
        user_index AS (
          SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS user_index
          FROM triplets GROUP BY user_id),
        all_data AS MATERIALIZED (
          SELECT row_number() OVER () AS row, t.user_id, t.song_id, u.user_index, s.song_index
          FROM triplets t JOIN user_index u ON t.user_id = u.user_id
                          JOIN song_index s ON t.song_id = s.song_id),
        data AS MATERIALIZED (SELECT row, user_index, song_index FROM all_data WHERE {rows}),
        ids AS (SELECT DISTINCT 'user' AS kind, user_index AS id FROM data
                UNION ALL SELECT DISTINCT 'song', song_index FROM data),
        w0 AS MATERIALIZED (
          SELECT kind, id, i, sqrt(-2 * ln({uniform('a')})) * cos({uniform('b')} * 2 * pi()) AS w,
                 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
          FROM ids, range({dim}) AS dims(i))"""
    ]
    for time in range(1, epochs + 1):
        old = f"w{time - 1}"
        parts.append(
            f"""slopes{time} AS MATERIALIZED (
              SELECT d.row, any_value(d.user_index) AS user_index,
                     any_value(d.song_index) AS song_index,
                     (sum(u.w * s.w) - 1) * 2 / (SELECT count(*) FROM data) AS slope
              FROM data d JOIN {old} u ON u.kind = 'user' AND u.id = d.user_index
                          JOIN {old} s ON s.kind = 'song' AND s.id = d.song_index AND s.i = u.i
              GROUP BY d.row),
            g{time} AS MATERIALIZED (
              SELECT 'user' AS kind, user_index AS id, i, sum(slope * w) AS g
              FROM slopes{time} JOIN {old} ON kind = 'song' AND id = song_index
              GROUP BY user_index, i
              UNION ALL
              SELECT 'song', song_index, i, sum(slope * w)
              FROM slopes{time} JOIN {old} ON kind = 'user' AND id = user_index
              GROUP BY song_index, i),
            moments{time} AS (
              SELECT kind, id, i, w, m * 0.9::DOUBLE + g * 0.1::DOUBLE AS m,
                     v * 0.999::DOUBLE + g * g * 0.001::DOUBLE AS v
              FROM {old} JOIN g{time} USING (kind, id, i)),
            w{time} AS MATERIALIZED (
              SELECT kind, id, i, m, v,
                     w - {step}::DOUBLE * (m / (1 - power(0.9::DOUBLE, {time})))
                         / (sqrt(v / (1 - power(0.999::DOUBLE, {time}))) + 1e-8::DOUBLE) AS w
              FROM moments{time})"""
        )
    return ", ".join(parts) + f", trained AS (SELECT kind, id, i, w FROM w{epochs})"


DIM, STEP, EPOCHS = 5, 0.01, 5
VECTORS_SQL = f"""{adam_sql(DIM, STEP, EPOCHS)},
vectors AS MATERIALIZED (
  SELECT kind, id, list(w ORDER BY i) AS features FROM trained GROUP BY kind, id)"""
_trained: dict[tuple[str, str], DataFrame] = {}


def trained(spark, sf) -> DataFrame:
    """Embeddings of users and songs: a model whose training SQL repeats. One training per session
    and folder, stored as a table and shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        rows = cleaning.with_weight(indexed_triplets(spark, sf))
        _trained[key] = cut_lineage(embedding.fit_embeddings(rows, SEED, dim=DIM, step=STEP, epochs=EPOCHS))
    return _trained[key]


def trained_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    model = trained(spark, sf)
    side = lambda kind: model.filter(F.col("kind") == kind).select("id", "features")
    return side(embedding.USER), side(embedding.SONG)


@query(
    f"""{VECTORS_SQL},
    scores AS (
      SELECT u.id AS user, s.id AS item, round(list_dot_product(u.features, s.features), 6) + 0.0 AS score
      FROM vectors u, vectors s WHERE u.kind = 'user' AND s.kind = 'song')
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank
                   FROM scores) WHERE rank <= 10"""
)
def topn_all_users(spark, sf):
    """The ten best songs of every user under the trained embeddings."""
    users, songs_ = trained_sides(spark, sf)
    return pruned.top_scores_pruned(users, songs_, 10, digits=6, first_tier=512)


IN_TRAINING_SQL = (
    "CAST('0x' || substr(md5(concat_ws('|', user_index, song_index, '')), 1, 15) AS BIGINT) % 100 < 80"
)


@query(
    f"""{adam_sql(DIM, STEP, EPOCHS, IN_TRAINING_SQL)},
    vectors AS MATERIALIZED (
      SELECT kind, id, list(w ORDER BY i) AS features FROM trained GROUP BY kind, id),
    errors AS (
      SELECT list_dot_product(u.features, s.features) - 1 AS miss FROM all_data d
      JOIN vectors u ON u.kind = 'user' AND u.id = d.user_index
      JOIN vectors s ON s.kind = 'song' AND s.id = d.song_index WHERE NOT {IN_TRAINING_SQL})
    SELECT round(sqrt(avg(miss * miss)), 6) AS rmse, count(*) AS pairs FROM errors"""
)
def training_report(spark, sf):
    """Error of embeddings trained on four fifths of the interactions, on the rest."""
    rows = cut_lineage(cleaning.with_weight(indexed_triplets(spark, sf)))
    _, report = embedding.train_and_evaluate(rows, SEED, dim=DIM, step=STEP, epochs=EPOCHS)
    return report.select(F.round("rmse", 6).alias("rmse"), "pairs")


def paged_sql(dim: int, step: float, epochs: int, size: int, page: int) -> str:
    """The training in pages of mini-batches, a recursion step per training step; the last table is ``trained``.

    ``dealt`` puts every row of every epoch into its mini-batch, ``batches`` has the rows of a step.
    """
    dims = range(dim)

    def every(text: str) -> str:
        return ", ".join(text.replace("#", str(i)) for i in dims)

    def uniform(part: str) -> str:
        text = f"concat_ws('|', kind, CAST(id AS VARCHAR), '{SEED}/#/{part}')"
        return f"((CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976)"

    names = ", ".join(every(f"{x}#") for x in "wmv")
    start = every(f"sqrt(-2 * ln({uniform('a')})) * cos({uniform('b')} * 2 * pi())")
    zeros = ", ".join(["0.0::DOUBLE"] * (2 * dim))
    first = "(old.m# * 0.9::DOUBLE + coalesce(g.g#, 0) * 0.1::DOUBLE)"
    second = "(old.v# * 0.999::DOUBLE + coalesce(g.g#, 0) * coalesce(g.g#, 0) * 0.001::DOUBLE)"
    weight = f"old.w# - {step}::DOUBLE * ({first} / now.c) / (sqrt({second} / now.d) + 1e-8::DOUBLE)"
    product = " + ".join(f"u.w{i} * s.w{i}" for i in dims)
    return f"""WITH RECURSIVE {TRIPLETS_SQL}, {INDEX_SQL},
    user_index AS (
      SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS user_index
      FROM triplets GROUP BY user_id),
    data AS MATERIALIZED (
      SELECT u.user_index, s.song_index FROM triplets t JOIN user_index u ON t.user_id = u.user_id
                                                        JOIN song_index s ON t.song_id = s.song_id),
    ids AS (SELECT DISTINCT 'user' AS kind, user_index AS id FROM data
            UNION ALL SELECT DISTINCT 'song', song_index FROM data),
    blocks AS (
      SELECT greatest(CAST(floor(sqrt((greatest(count(*), 1) - 1) // {embedding.CELL_ROWS})) AS BIGINT),
                      (SELECT greatest(count(*), 1) - 1 FROM ids) // {embedding.BLOCK_IDS}) + 1 AS n FROM data),
    cells AS (
      SELECT user_index, song_index, user_index % n AS a, (song_index % n - user_index % n + n) % n AS diagonal
      FROM data, blocks),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY diagonal, a ORDER BY user_index, song_index) - 1 AS place,
             count(*) OVER (PARTITION BY diagonal, a) AS held FROM cells),
    mixed1 AS (
      SELECT *, place // {page} AS page, least({page}, held - place // {page} * {page}) AS wide,
             ((place * {epochs} + epoch + {SEED}) * 48271 + 11) % 2147483647 AS x1
      FROM placed, range({epochs}) AS epochs(epoch)),
    mixed2 AS (SELECT *, (xor(x1, x1 >> 15) * 48271 + 11) % 2147483647 AS x2 FROM mixed1),
    mixed AS (SELECT *, (xor(x2, x2 >> 15) * 48271 + 11) % 2147483647 AS x FROM mixed2),
    dealt AS (
      SELECT *, (row_number() OVER (PARTITION BY diagonal, a, page, epoch ORDER BY x, place) - 1) // {size} AS batch
      FROM mixed),
    steps AS (
      SELECT *, page * {epochs * -(-page // size)} + epoch * ((wide + {size - 1}) // {size}) + batch + 1 AS step,
             count(*) OVER (PARTITION BY diagonal, a, page, epoch, batch) AS n FROM dealt),
    lengths AS (SELECT diagonal, max(step) AS steps FROM steps GROUP BY diagonal),
    begins AS (
      SELECT diagonal, coalesce(sum(steps) OVER (
        ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM lengths),
    batches AS MATERIALIZED (
      SELECT CAST(begin + step AS BIGINT) AS t, list(struct_pack(u := user_index, s := song_index, n := n)) AS rows,
             1 - power(0.9::DOUBLE, begin + step) AS c, 1 - power(0.999::DOUBLE, begin + step) AS d
      FROM steps JOIN begins USING (diagonal) GROUP BY begin + step),
    state(kind, id, t, {names}) USING KEY (kind, id) AS (
      SELECT kind, id, 0::BIGINT, {start}, {zeros} FROM ids
      UNION
      SELECT old.kind, old.id, now.t, {every(weight)}, {every(first)}, {every(second)}
      FROM state old JOIN (SELECT t, c, d FROM batches) now ON now.t = old.t + 1
      LEFT JOIN (
        SELECT kind, id, {every("sum(slope * x#) AS g#")} FROM (
          SELECT unnest([struct_pack(kind := 'user', id := r.u, slope := slope, {every("x# := s#")}),
                         struct_pack(kind := 'song', id := r.s, slope := slope, {every("x# := u#")})],
                        recursive := true)
          FROM (SELECT r, ({product} - 1) * 2 / r.n AS slope, {every("u.w# AS u#")}, {every("s.w# AS s#")}
                FROM (SELECT unnest(rows) AS r FROM batches WHERE t = (SELECT max(t) + 1 FROM state))
                JOIN state u ON u.kind = 'user' AND u.id = r.u
                JOIN state s ON s.kind = 'song' AND s.id = r.s))
        GROUP BY kind, id) g ON old.kind = g.kind AND old.id = g.id),
    trained AS (
      SELECT kind, id, unnest(range({dim})) AS i, unnest([{every("w#")}]) AS w FROM state)"""


MINI_BATCH, PAGE = 32, 1000


@query(
    f"""{paged_sql(DIM, STEP, EPOCHS, MINI_BATCH, PAGE)}
    SELECT kind, id, i, round(w, 6) AS weight FROM trained"""
)
def fm_train(spark, sf):
    """Embeddings of users and songs, trained in pages of mini-batches and read back from where the training wrote them."""
    rows = cleaning.with_weight(indexed_triplets(spark, sf))
    model = embedding.fit_embeddings(
        rows, SEED, dim=5, step=0.01, epochs=5, batch_size=MINI_BATCH, page_size=PAGE
    )
    path = scratch_path(spark, "embeddings")
    embedding.save_embeddings(model, path)
    read = embedding.load_embeddings(spark, path)
    return read.select("kind", "id", F.posexplode("features").alias("i", "w")).select(
        "kind", "id", "i", F.round("w", 6).alias("weight")
    )


_playlists: dict[tuple[str, str], str] = {}


def stored_playlists(spark, sf):
    """Playlists as the ingest job leaves them: JSON in the shared folder, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _playlists:
        nested = ingest.prepare_playlists(triplets(spark, sf), songs(spark, sf))
        _playlists[key] = as_json(nested, "playlists-json")
    return files.read_playlists_json(spark, _playlists[key])


@query(
    f"""WITH {TRIPLETS_SQL}, {SONGS_SQL},
    heard AS (SELECT DISTINCT user_id, song_id FROM triplets),
    sizes AS (SELECT song_id, count(*) AS n FROM heard GROUP BY song_id),
    seed AS (SELECT song_id FROM songs WHERE contains(title, '{TITLE_TEXT}')
             ORDER BY title, song_id LIMIT 1),
    fans AS (SELECT user_id FROM heard WHERE song_id IN (SELECT song_id FROM seed)),
    common AS (SELECT song_id, count(*) AS c FROM heard
               WHERE user_id IN (SELECT user_id FROM fans)
                 AND song_id NOT IN (SELECT song_id FROM seed) GROUP BY song_id),
    best AS (SELECT c.song_id, c.c / sqrt((SELECT count(*) FROM fans) * s.n) AS rating
             FROM common c JOIN sizes s ON c.song_id = s.song_id
             ORDER BY CAST(c.c AS DOUBLE) * c.c / s.n DESC, c.song_id LIMIT 10)
    SELECT b.song_id, s.title, s.artist_name, round(b.rating, 6) AS rating
    FROM best b JOIN songs s ON b.song_id = s.song_id"""
)
def recommend_for_song(spark, sf):
    found = recommend.recommend_for_song(
        TITLE_TEXT, songs(spark, sf), stored_playlists(spark, sf), 10, mode="cooccurrence"
    )
    return found.withColumn("rating", F.round("rating", 6))


def _by_model(spark, sf, mode: str) -> DataFrame:
    ready = fitted(spark, sf, "default", als.DEFAULT)
    return recommend.recommend_for_song(
        TITLE_TEXT, songs(spark, sf), stored_playlists(spark, sf), 10, mode=mode, fitted=ready
    )


@query()
def recommend_for_song_similar_items(spark, sf):
    return _by_model(spark, sf, "similar_items")


@query()
def recommend_for_song_listeners(spark, sf):
    return _by_model(spark, sf, "listeners")


@query()
def recommend_for_song_literal(spark, sf):
    return _by_model(spark, sf, "literal")


# --- similarity and reviews ----------------------------------------------------------------------

COOCCURRENCE_SQL = f"""WITH {TRIPLETS_SQL}, {SONGS_SQL},
heard AS (SELECT DISTINCT user_id, song_id FROM triplets),
sizes AS (SELECT song_id, count(*) AS n FROM heard GROUP BY song_id),
common AS (SELECT a.song_id, b.song_id AS candidate, count(*) AS common
           FROM heard a JOIN heard b ON a.user_id = b.user_id AND a.song_id <> b.song_id
           GROUP BY a.song_id, b.song_id),
collaborative AS (
  SELECT c.song_id, c.candidate, c.common, c.common / sqrt(x.n * y.n) AS score,
         row_number() OVER (PARTITION BY c.song_id ORDER BY
           CAST(c.common AS DOUBLE) * c.common / y.n DESC, c.candidate) AS rank
  FROM common c JOIN sizes x ON c.song_id = x.song_id JOIN sizes y ON c.candidate = y.song_id)"""
CONTENT_SQL = """scored AS (
  SELECT a.song_id, b.song_id AS candidate, abs(a.year - b.year) AS apart,
         CASE WHEN a.release = b.release THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
         + greatest(0.0::DOUBLE, 1 - abs(a.year - b.year) / 50.0::DOUBLE) * 0.3::DOUBLE AS score
  FROM songs a JOIN songs b ON a.artist_name = b.artist_name AND a.song_id <> b.song_id),
content AS (
  SELECT song_id, candidate, score, row_number() OVER (PARTITION BY song_id
    ORDER BY score DESC, apart, candidate) AS rank FROM scored WHERE score > 0)"""


@query(
    f"""{COOCCURRENCE_SQL}
    SELECT song_id, candidate, common, round(score, 6) AS score, rank
    FROM collaborative WHERE rank <= 10"""
)
def item_cooccurrence(spark, sf):
    best = cooccurrence.item_cooccurrence(triplets(spark, sf), 10)
    return best.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {SONGS_SQL}, {CONTENT_SQL}
    SELECT song_id, candidate, round(score, 6) AS score, rank FROM content WHERE rank <= 10"""
)
def content_similarity(spark, sf):
    best = content.content_similarity(songs(spark, sf), 10)
    return best.withColumn("score", F.round("score", 6))


@query(
    f"""{COOCCURRENCE_SQL}, {CONTENT_SQL},
    blended AS (
      SELECT coalesce(l.song_id, r.song_id) AS song_id, coalesce(l.candidate, r.candidate) AS candidate,
             coalesce(l.score, 0) AS collaborative, coalesce(r.score, 0) AS content
      FROM collaborative l FULL JOIN (SELECT * FROM scored WHERE score > 0) r
        ON l.song_id = r.song_id AND l.candidate = r.candidate),
    ranked AS (
      SELECT *, collaborative * 0.5::DOUBLE + content * 0.5::DOUBLE AS score FROM blended),
    placed AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, candidate)
               AS rank FROM ranked)
    SELECT song_id, candidate, round(score, 6) AS score, rank FROM placed WHERE rank <= 10"""
)
def hybrid_recs(spark, sf):
    best = hybrid.hybrid_similarity(triplets(spark, sf), songs(spark, sf), alpha=0.5, k=10)
    return best.select("song_id", "candidate", F.round("score", 6).alias("score"), "rank")


QUERIES["hybrid"] = QUERIES.pop("hybrid_recs")
SQL["hybrid"] = SQL.pop("hybrid_recs")

# Frequent words of four languages, and shorthand with its long form.
STOPWORDS = {
    "de": "der die das und den dem von zu mit sich auf des für ist im nicht ein eine als auch",
    "en": "the of and to a in is that it for was on with be by as this are at from",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
    "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec",
}
SHORTHAND = {
    "u": "you", "ur": "your", "r": "are", "n": "and", "nd": "and", "th": "the", "d": "the",
    "y": "why", "k": "okay", "b4": "before", "gr8": "great", "l8r": "later", "2": "to",
    "4": "for", "pls": "please", "thx": "thanks", "msg": "message", "txt": "text", "w8": "wait",
    "ha": "have", "er": "her", "bc": "because", "ppl": "people", "cu": "see you",
}
STOPWORDS_SQL = "stopwords(lang, word) AS (VALUES {})".format(
    ", ".join(f"('{lang}', '{word}')" for lang, text in STOPWORDS.items() for word in text.split())
)
SHORTHAND_SQL = "shorthand(token, expansion) AS (VALUES {})".format(
    ", ".join(f"('{token}', '{expansion}')" for token, expansion in SHORTHAND.items())
)
WORDS_SQL = (
    "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"
)


def stopwords(spark: SparkSession) -> DataFrame:
    rows = [(lang, word) for lang, text in STOPWORDS.items() for word in text.split()]
    return spark.createDataFrame(rows, "lang string, word string")


@query(
    f"""WITH {STOPWORDS_SQL},
    tokens AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
    hits AS (SELECT t.doc_id, s.lang, count(*) AS hits
             FROM tokens t JOIN stopwords s ON t.word = s.word GROUP BY t.doc_id, s.lang),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS place
             FROM hits)
    SELECT d.doc_id, b.lang AS language, coalesce(b.hits, 0) AS hits
    FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.place = 1"""
)
def regional_language(spark, sf):
    return reviews.detect_language(documents(spark, sf), stopwords(spark))


@query(
    f"""WITH {SHORTHAND_SQL},
    pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (
      SELECT doc_id,
             regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS p
      FROM documents)),
    joined AS (SELECT doc_id, string_agg(coalesce(s.expansion, piece), '' ORDER BY pos) AS text
               FROM pieces LEFT JOIN shorthand s ON lower(piece) = s.token GROUP BY doc_id)
    SELECT d.doc_id, coalesce(j.text, '') AS text
    FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""
)
def sms_normalise(spark, sf):
    dictionary = spark.createDataFrame(list(SHORTHAND.items()), "token string, expansion string")
    return reviews.normalise_text(documents(spark, sf), dictionary)


def label_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """How often documents with a word are labelled good, and how often toxic."""
    labelled = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    rows = labelled.select(F.explode(F.array_distinct(words("text"))).alias("word"), "quality", "toxic")
    return rows.groupBy("word").agg(F.avg("quality").alias("pos"), F.avg("toxic").alias("neg"))


@query(
    f"""WITH tokens AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
    lexicon AS (SELECT word, avg(quality) - avg(toxic) AS balance
                FROM (SELECT DISTINCT doc_id, word FROM tokens) t
                JOIN labels l ON t.doc_id = l.doc_id GROUP BY word),
    sums AS (SELECT t.doc_id, count(l.balance) AS hits, round(coalesce(sum(l.balance), 0), 6) AS score
             FROM tokens t LEFT JOIN lexicon l ON t.word = l.word GROUP BY t.doc_id),
    every AS (SELECT d.doc_id, coalesce(s.hits, 0) AS hits, coalesce(s.score, 0) AS score
              FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id)
    SELECT *, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
                   ELSE 'neutral' END AS sentiment FROM every"""
)
def lexicon_sentiment(spark, sf):
    return reviews.lexicon_sentiment(documents(spark, sf), label_lexicon(spark, sf))


@query(
    f"""WITH copies AS (SELECT text, count(*) AS n FROM documents GROUP BY text),
    judged AS (
      SELECT d.doc_id, len({WORDS_SQL.replace('text', 'd.text')}) < 20 AS too_short, c.n > 1 AS duplicate,
             coalesce(length(regexp_replace(d.text, '[^\\p{{L}}]', '', 'g'))
                      / nullif(length(d.text), 0), 0) < 0.7 AS few_letters,
             list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x)),
                         lambda x: x <> '') AS lines
      FROM documents d JOIN copies c ON d.text = c.text),
    flagged AS (SELECT doc_id, too_short, duplicate, few_letters,
                       len(lines) - len(list_distinct(lines)) > len(lines) * 0.2::DOUBLE
                         AS repeated_lines FROM judged)
    SELECT *, too_short OR duplicate OR few_letters OR repeated_lines AS spam FROM flagged"""
)
def spam_reviews(spark, sf):
    return reviews.flag_spam(documents(spark, sf))
