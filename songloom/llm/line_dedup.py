"""Line dedup: winnowed fingerprints and guarantee windows of lines, matched to their first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import plain_names, WORD, table
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

#: A repeated run of whole lines with this many words is always found.
GUARANTEE_WORDS = 50
#: Words in the run of lines whose hash is a fingerprint; shorter repeats are never found.
GRAM_WORDS = 25


def _lines_needed(units: Column, at: Column, words: int) -> Column:
    """How many lines from ``at`` (counted from 1) on reach ``words``; null if the text ends before.

    A line has a word at least, so no more than ``words`` lines are looked at.
    """
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(
        F.slice(units, at, F.lit(words)),
        start,
        lambda acc, unit: F.when(acc["sum"] >= words, acc).otherwise(
            F.struct((acc["sum"] + unit["n"]).alias("sum"), (acc["n"] + 1).alias("n"))
        ),
        lambda acc: F.when(acc["sum"] >= words, acc["n"]),
    )


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, guarantee: int, gram: int
) -> DataFrame:
    """``key`` (of a run of lines), ``id``, ``text_key``, ``first`` and ``last`` (line numbers), and
    the lines ``before`` (nearest first) and ``after``, as far as another fingerprint may be away.

    The window of a line goes on until it has ``guarantee`` words. Of the runs that fill ``gram``
    words inside it, that with the least hash is selected, which depends on nothing outside: equal
    runs of lines with a whole window select the same.

    The windows themselves are fingerprints too, with nothing before and after: from every line on,
    and back from every line. Those inside a run of ``guarantee`` words cover all its lines.
    """
    text = F.col(text_col).cast("string")
    read = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    described = F.transform(
        "lines",
        lambda line, i: F.struct(
            F.xxhash64(line).alias("h"),
            F.regexp_count(line, F.lit(WORD)).cast("long").alias("n"),
            i.alias("line"),
        ),
    )
    units = read.select(
        "id", "text_key", F.filter(described, lambda unit: unit["n"] > 0).alias("units")
    )
    units = units.withColumn("backward", F.reverse("units"))
    reach = lambda words, name="units": F.transform(
        name, lambda unit, i: _lines_needed(F.col(name), i + 1, words)
    )
    reached = units.select(
        "id",
        "text_key",
        "units",
        reach(guarantee).alias("windows"),
        F.reverse(reach(guarantee, "backward")).alias("windows_back"),
        reach(gram).alias("grams"),
    )
    hashes = lambda i, n: F.array_join(
        F.transform(F.slice("units", i + 1, n), lambda unit: unit["h"].cast("string")), ","
    )
    key = lambda i: F.md5(hashes(i, F.get("grams", i)))
    keyed = reached.select(
        "id",
        "text_key",
        "units",
        "windows",
        "windows_back",
        "grams",
        F.transform("grams", lambda n, i: F.when(n.isNotNull(), key(i))).alias("keys"),
    )
    inside = lambda i, n: F.filter(
        F.sequence(i, i + n - 1),
        lambda s: F.coalesce(s + F.get("grams", s) <= i + n, F.lit(False)),
    )
    least = lambda i, n: F.array_min(
        F.transform(inside(i, n), lambda s: F.struct(F.get("keys", s).alias("key"), s.alias("s")))
    )
    selected = F.array_distinct(
        F.filter(
            F.transform("windows", lambda n, i: F.when(n.isNotNull(), least(i, n))),
            lambda x: x.isNotNull(),
        )
    )
    spans = F.concat(
        F.transform("windows", lambda n, i: F.when(n.isNotNull(), F.struct(i.alias("s"), n.alias("n")))),
        F.transform(
            "windows_back", lambda n, i: F.when(n.isNotNull(), F.struct((i - n + 1).alias("s"), n.alias("n")))
        ),
    )
    whole = F.transform(
        F.filter(F.array_distinct(spans), lambda x: x.isNotNull()),
        lambda x: F.struct(
            F.md5(F.concat(F.lit("window "), hashes(x["s"], x["n"]))).alias("key"),
            x["s"].alias("s"),
            x["n"].alias("n"),
            F.lit(0).alias("around"),
        ),
    )
    runs = F.transform(
        selected,
        lambda x: F.struct(
            x["key"].alias("key"), x["s"].alias("s"), F.get("grams", x["s"]).alias("n"), F.lit(guarantee).alias("around")
        ),
    )
    exploded = keyed.select("id", "text_key", "units", F.explode(F.concat(runs, whole)).alias("x"))
    s = F.col("x.s")
    size = F.col("x.n")
    around = F.col("x.around")
    unit = lambda i: F.get("units", i)
    pick = lambda u: F.struct(u["h"].alias("h"), u["line"].alias("line"))
    after = F.slice("units", s + size + 1, around)
    before = F.reverse(F.slice("units", F.greatest(s - around, F.lit(0)) + 1, F.least(s, around)))
    return exploded.select(
        F.unhex(F.col("x.key")).alias("key"),
        "id",
        "text_key",
        unit(s)["line"].alias("first"),
        unit(s + size - 1)["line"].alias("last"),
        F.transform(_until(before, guarantee), pick).alias("before"),
        F.transform(_until(after, guarantee), pick).alias("after"),
    )


def _until(units: Column, words: int) -> Column:
    """The first of ``units`` that together have ``words`` words, or all."""
    needed = _lines_needed(units, F.lit(1), words)
    return F.slice(units, F.lit(1), F.coalesce(needed, F.size(units)))


def _common(mine: Column, other: Column) -> Column:
    """How many lines two lists have in common from their start on."""
    equal = F.zip_with(mine, other, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("int")


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    guarantee: int = GUARANTEE_WORDS,
    gram: int = GRAM_WORDS,
) -> DataFrame:
    """``id``, ``text_key`` and ``runs`` (first and last line number) that repeat earlier lines.

    Places are ordered by id, text hash and line. Each fingerprint's first place is found by a
    grouped minimum; every other place looks it up and compares the lines around, so no two places
    are paired. Keys with a large part of the places are met by a small broadcast. A run that only
    later places share is found by its windows, whose first place is the first of these.
    """
    found = cut_lineage(fingerprints(docs, id_col, text_col, guarantee, gram))
    place = F.struct("id", "text_key", "first")
    firsts = cut_lineage(
        found.groupBy("key")
        .agg(
            F.min(F.struct("id", "text_key", "first", "before", "after")).alias("earliest"),
            F.count(F.lit(1)).alias("places"),
        )
        .filter("places > 1")
    )
    met = counted_lookup(found, firsts, "key", "places", spread=["text_key", "first"])
    earliest = F.struct("earliest.id", "earliest.text_key", "earliest.first")
    later = met.filter(F.col("earliest").isNotNull()).filter(place > earliest)
    back = _common(F.col("before"), F.col("earliest.before"))
    on = _common(F.col("after"), F.col("earliest.after"))
    runs = later.select(
        "id",
        "text_key",
        F.struct(
            F.coalesce(F.get("before", back - 1)["line"], F.col("first")).alias("first"),
            F.coalesce(F.get("after", on - 1)["line"], F.col("last")).alias("last"),
        ).alias("run"),
    )
    # a text's own runs: as many as its fingerprints; overlapping ones become one
    own = Window.partitionBy("id", "text_key").orderBy("first", "last")
    earlier = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.select("id", "text_key", "run.*").distinct().withColumn(
        "begins", F.coalesce(F.col("first") > earlier, F.lit(True)).cast("int")
    )
    joined = begun.withColumn("part", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = joined.groupBy("id", "text_key", "part").agg(
        F.struct(F.min("first").alias("first"), F.max("last").alias("last")).alias("run")
    )
    return parts.groupBy("id", "text_key").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    guarantee: int = GUARANTEE_WORDS,
    gram: int = GRAM_WORDS,
) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text_col``, and ``n_lines``, ``n_removed``.

    The earliest place of a run stays: the least id (nulls first), then text hash, then line. A
    run within one document counts too. Blank lines inside a deleted run go with it. Every
    repeated run of whole lines with ``guarantee`` words goes in whole, whatever else its lines
    repeat; shorter runs go with a fingerprint inside that the fingerprint's first place has.

    Rows with equal id and text are one document that is there twice: they lose the same lines. A
    null text stays null and has no lines; columns called like results give way to them. An empty
    table gives no rows.
    """
    names = [name for name in docs.columns if name not in ("n_lines", "n_removed")]
    plain, place = plain_names(docs.select(*names))
    cleaned = _without_runs(plain, place[id_col], place[text_col], guarantee, gram)
    return cleaned.toDF(*names, "n_lines", "n_removed")


def _without_runs(docs: DataFrame, id_col: str, text_col: str, guarantee: int, gram: int) -> DataFrame:
    names = docs.columns
    runs = repeated_runs(docs, id_col, text_col, guarantee, gram).select(
        F.col("id").alias("_id"), F.col("text_key").alias("_other_key"), F.col("runs").alias("_runs")
    )
    keyed = docs.select(*names, F.xxhash64(F.col(text_col).cast("string")).alias("_key"))
    match = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_other_key"))
    joined = keyed.join(runs, match, "left").withColumn("_lines", F.split(text_col, "\n"))
    inside = lambda i: F.exists("_runs", lambda run: (i >= run["first"]) & (i <= run["last"]))
    kept = F.when(F.col("_runs").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda line, i: ~inside(i))
    )
    cleaned = joined.withColumn("_left", kept)
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    n_left = F.coalesce(F.size("_left"), F.lit(0))
    text = F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(F.array_join("_left", "\n"))
    return cleaned.select(
        *[text.alias(name) if name == text_col else F.col(name) for name in names],
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(n_lines - n_left, F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place has."""
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
