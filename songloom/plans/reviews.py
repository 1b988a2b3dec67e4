"""Language, spelling, sentiment and spam of review texts ``(doc_id, text)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.functions.tokens import words
from songloom.operators.cleaning import dedupe_by_key
from songloom.operators.skew import broadcast_if_small, counted_lookup
from songloom.storage import cut_lineage

SMALL_TABLE = 500_000  # rows of a word table that may be broadcast

# Fixed value: runs of letters and digits, or of anything else; together they cover the text.
PIECES = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def _word_rows(docs: DataFrame) -> DataFrame:
    # Outer, so that a text without any word keeps its document in the result.
    return docs.select("doc_id", F.explode_outer(words("text")).alias("word"))


def detect_language(docs: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Language whose ``stopwords(lang, word)`` occur most often; ties go to the first by name.

    A document's hits are summed where its words are read, so only a few counts per document
    are shuffled.
    """
    marks = stopwords.select("word", F.col("lang").alias("language")).dropDuplicates()
    hits = (
        _word_rows(docs)
        .join(broadcast_if_small(cut_lineage(marks), SMALL_TABLE), "word", "left")
        .groupBy("doc_id", "language")
        .agg(F.count("language").alias("hits"))
    )
    best = F.min(F.struct((-F.col("hits")).alias("minus_hits"), F.isnull("language"), "language"))
    return (
        hits.groupBy("doc_id")
        .agg(best.alias("best"))
        .select("doc_id", "best.language", (-F.col("best.minus_hits")).alias("hits"))
    )


def normalise_text(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace words found in ``dictionary(token, expansion)``, leaving all else as it is.

    Texts are cut into pieces once. Only pieces that the dictionary knows become rows that are kept, as
    (row, place, expansion); each row's patches are gathered and put in place between the pieces that
    stay. Rows have a number of their own, so repeated ids stay apart. A null text stays null; entries
    without a token are ignored.
    """
    named = dictionary.select("token", "expansion").filter(F.col("token").isNotNull())
    known = broadcast_if_small(cut_lineage(dedupe_by_key(named, ["token"])), SMALL_TABLE)
    cut = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    # stored, so that a row's number and pieces are the same for both readers
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", cut.alias("pieces")))
    places = rows.select("_row", F.posexplode("pieces").alias("pos", "piece"))
    hits = places.join(known, F.lower("piece") == F.col("token")).filter("expansion IS NOT NULL")
    patches = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "expansion"))).alias("patches"))
    return rows.join(patches, "_row", "left").select("doc_id", _patched().alias("text"))


def _patched() -> Column:
    """``pieces`` as one text, with each of ``patches`` in place of the piece at its position."""
    pieces, patches = F.col("pieces"), F.col("patches")

    def stretch(patch: Column, number: Column) -> Column:
        """The pieces after the patch before, and the patch."""
        first = F.when(number > 0, F.get(patches, number - 1)["pos"] + 1).otherwise(0)
        kept = F.slice(pieces, first + 1, patch["pos"] - first)
        return F.concat(F.array_join(kept, ""), patch["expansion"])

    rest = F.get(patches, F.size(patches) - 1)["pos"] + 1
    end = F.array_join(F.slice(pieces, rest + 1, F.size(pieces) - rest), "")
    mended = F.concat(F.array_join(F.transform(patches, stretch), ""), end)
    return F.when(patches.isNull(), F.array_join(pieces, "")).otherwise(mended)


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sum of (pos - neg) over the words found in ``lexicon(word, pos, neg)``, and its sign.

    A word with several rows, one for each sense, counts with their mean.
    """
    balance = lexicon.groupBy("word").agg(F.avg(F.col("pos") - F.col("neg")).alias("balance"))
    sums = (
        _word_rows(docs)
        .join(broadcast_if_small(cut_lineage(balance), SMALL_TABLE), "word", "left")
        .groupBy("doc_id")
        .agg(
            F.count("balance").alias("hits"),
            F.round(F.coalesce(F.sum("balance"), F.lit(0.0)), 6).alias("score"),
        )
    )
    label = F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative")
    return sums.withColumn("sentiment", label.otherwise("neutral"))


@dataclass(frozen=True)
class SpamRules:
    min_words: int = 20
    min_letter_ratio: float = 0.7
    max_repeated_lines: float = 0.2


def flag_spam(docs: DataFrame, rules: SpamRules = SpamRules()) -> DataFrame:
    """Rule flags per document, and whether any of them holds.

    Texts are read once and reduced to flags and a digest, which are stored; copies are found
    among the digests, and a text copied very often is matched without gathering its copies.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda line: F.trim(line)), lambda line: line != ""
    )
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    repeated = F.col("line_count") - F.col("different_lines")
    judged = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select(
            "doc_id",
            F.md5(F.col("text").cast("binary")).alias("digest"),
            F.size(words("text")).alias("words"),
            F.try_divide(letters, F.length("text")).alias("letter_ratio"),
            F.size(lines).alias("line_count"),
            F.size(F.array_distinct(lines)).alias("different_lines"),
        )
        .select(
            "doc_id",
            "digest",
            (F.col("words") < rules.min_words).alias("too_short"),
            (F.coalesce("letter_ratio", F.lit(0.0)) < rules.min_letter_ratio).alias("few_letters"),
            (repeated > F.col("line_count") * F.lit(rules.max_repeated_lines)).alias(
                "repeated_lines"
            ),
        )
    )
    judged = cut_lineage(judged)
    copies = (
        judged.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
    matched = counted_lookup(judged, copies, "digest", "copies", spread=["doc_id"])
    flags = ["too_short", "duplicate", "few_letters", "repeated_lines"]
    flagged = matched.withColumn("duplicate", F.col("copies").isNotNull())
    any_flag = F.col(flags[0])
    for name in flags[1:]:
        any_flag = any_flag | F.col(name)
    return flagged.select("doc_id", *flags, any_flag.alias("spam"))
