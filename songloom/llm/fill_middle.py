"""Fill-in-the-middle: every text cut in three by one regular expression of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import table

#: Marks of the three parts; a text that holds one of them is left as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
#: One code point, line breaks included.
CODE_POINT = r"(?s:.)"
#: Of a hundred texts, so many are cut, and of a hundred cut ones, so many begin with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
_STRIDE = 1024  # units counted at once



def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units ``text`` has, matched from left to right.

    Whole strides are counted first and cut off, so that the matches held at once are either few
    or short: a very long text doesn't become an array of its units.
    """
    stride = f"(?:{unit}){{{_STRIDE}}}"
    strides = F.regexp_count(text, F.lit(stride)).cast("bigint")
    rest = F.regexp_replace(text, F.lit(f"\\G{stride}"), F.lit(""))
    return strides * _STRIDE + F.regexp_count(rest, F.lit(unit))


def _number(digest: Column, group: int) -> Column:
    """The given 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = CODE_POINT,
    seed: int = 1,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``output``, ``prefix_chars`` and ``middle_chars``, which take
    the place of columns of those names.

    ``n`` counts the units of the text: code points by default, or any pattern without capturing
    groups that never matches nothing. A text that its units don't tile from the start is plain. Two cuts and the form are drawn from a digest of ``seed`` and the id, so a
    rerun or a recomputed partition gives the same. A pattern made for the row, with possessive
    counted groups ``(unit{a})`` and ``(unit{b-a})``, captures prefix, middle and suffix in one match, which
    the replacement puts in order: ``<P>prefix<S>suffix<M>middle`` (form psm) or
    ``<S>suffix<P>prefix<M>middle`` (spm). A plain text is its own output.

    Null and empty texts have the output "", form plain, and null part sizes. A null id is drawn
    as the empty text. Rows with equal ids draw alike, and repeated rows stay. An empty table
    gives no rows. All in one pass without a shuffle; other columns are carried along.
    """
    made = ["n", "form", "output", "prefix_chars", "middle_chars"]
    kept = [name for name in docs.columns if name not in made]
    names = {name: f"_column{place}" for place, name in enumerate(kept)}
    read = docs.select(
        *[docs[name].alias(alias) for name, alias in names.items()],
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("_id"),
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id")).cast("binary"), 256)
    counted = read.withColumn("_n", count_units(F.col("_text"), unit)).withColumn("_digest", digest)
    first, second = [_number(F.col("_digest"), k) % (F.col("_n") + 1) for k in (1, 2)]
    plain = (
        (F.col("_text") == "")
        | F.col("_text").rlike(MARK)
        | (_number(F.col("_digest"), 3) % 100 >= cut_percent)
    )
    suffix_first = _number(F.col("_digest"), 4) % 100 < suffix_first_percent
    drawn = counted.select(
        "*",
        F.least(first, second).alias("_a"),
        F.greatest(first, second).alias("_b"),
        F.when(plain, "plain").when(suffix_first, "spm").otherwise("psm").alias("_form"),
    )
    units = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(
        F.lit(r"\A"), units(F.col("_a")), units(F.col("_b") - F.col("_a")), F.lit(r"((?s:.*+))\z")
    )
    order = F.when(F.col("_form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(
        f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    )
    replaced = F.regexp_replace("_text", pattern, order)
    cut = drawn.withColumn("_output", F.when(F.col("_form") == "plain", F.col("_text")).otherwise(replaced))
    # an output without marks is a text that is plain, or that units don't tile
    is_plain = F.col("_output") == F.col("_text")
    size = lambda value: F.when(~is_plain, value)
    return cut.select(
        *[F.col(alias).alias(name) for name, alias in names.items()],
        F.col("_n").alias("n"),
        F.when(is_plain, "plain").otherwise(F.col("_form")).alias("form"),
        F.col("_output").alias("output"),
        size(F.col("_a")).alias("prefix_chars"),
        size(F.col("_b") - F.col("_a")).alias("middle_chars"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Parts hold no marks, so the marks delimit them."""
    parts = F.split(output, MARK, 4)
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Cuts and digests of every document's output and of the text rebuilt from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """WITH read AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), '') AS id
  FROM documents),
counted AS (SELECT doc_id, body, length(body) AS n, sha256('1:' || id) AS digest FROM read),
numbers AS (
  SELECT doc_id, body, n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS x,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS y,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS cut,
         CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS turned FROM counted),
formed AS (
  SELECT doc_id, body, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>')
                OR contains(body, '<M>') OR cut >= 90 THEN 'plain'
              WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, body, n, a, b, form, substr(body, 1, a) AS prefix,
         substr(body, a + 1, b - a) AS middle, substr(body, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
         WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts"""
