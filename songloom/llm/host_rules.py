"""Quality rules judged by host: failures are counted by domain, and their shrunk rates decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import table, words_column
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

MIN_WORDS = 50
#: A host that fails a rule this often, after shrinking, is rejected with all its documents.
HOST_LIMIT = 0.5
#: A document may fail a rule that its host fails less often than this.
TOLERATED = 0.005
SYMBOLS = "#*$%&|<>"
GRAM = 3
#: Rules on the counts of a document; a null or empty text fails ``short`` alone.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")


def count_features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``doc_id``, ``host`` and the counts that the rules use, from whole texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    zero = F.lit(0).cast("long")
    long_ = lambda x: x.cast("long")
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("body")
    )
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = read.select(
        "doc_id",
        "host",
        long_(F.length(F.translate("body", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long_(F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).alias("n_symbols"),
        words_column(F.col("body")).alias("words"),
        lines.alias("lines"),
    )
    size = F.size("words")
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(size - (GRAM - 1), F.lit(0))),
        lambda word, i: F.concat_ws(
            " ", word, *[F.get("words", i + step) for step in range(1, GRAM)]
        ),
    )
    counted = cut.select(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        long_(size).alias("n_words"),
        long_(F.size("lines")).alias("n_lines"),
        long_(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # windows sorted with their places: equal neighbours are repeats
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ordered = F.when(some, F.sort_array(placed))
    same = lambda x, k: F.coalesce(x["w"] == F.get("ordered", k)["w"], F.lit(False))
    repeated = F.filter("ordered", lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    added = F.transform(
        "places",
        lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get("places", k + 1) - p, F.lit(GRAM))),
    )
    names = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    return (
        counted.select(*names, ordered.alias("ordered"))
        .select(*names, places.alias("places"))
        .select(
            *names,
            F.coalesce(F.aggregate(added, zero, lambda a, x: a + x), zero).alias("n_repeat_words"),
        )
    )


def host_rates(features: DataFrame) -> DataFrame:
    """``host``, ``n_docs`` and a shrunk rate for every rule.

    The prior of a rule is the beta distribution whose mean and variance are those of the hosts'
    own rates, so hosts with few documents are judged by what is usual.
    """
    hosts = cut_lineage(
        features.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()],
        )
    )
    moments = hosts.agg(
        *[F.avg(F.col(name) / F.col("n_docs")).alias(f"m_{name}") for name in RULES],
        *[F.avg((F.col(name) / F.col("n_docs")) ** 2).alias(f"s_{name}") for name in RULES],
    ).first()
    rates = []
    for name in RULES:
        mean, square = moments[f"m_{name}"] or 0.0, moments[f"s_{name}"] or 0.0
        variance = max(square - mean * mean, 1e-9)
        strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6)
        rate = (F.col(name) + mean * strength) / (F.col("n_docs") + strength)
        rates.append(rate.alias(f"rate_{name}"))
    return hosts.select("host", "n_docs", *rates)


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    host_limit: float = HOST_LIMIT,
    tolerated: float = TOLERATED,
) -> DataFrame:
    """Counts of every document, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules, its host isn't rejected for any rule, and it
    fails no rule but such as its host hardly ever fails.

    One row per row, repeated rows included. A null text counts as empty, a null host is a host
    of its own. An empty table gives no rows. Other columns are not read. Texts are read once and
    never shuffled; hosts with a large part of the documents are met by a small broadcast.
    """
    features = cut_lineage(count_features(docs, id_col, text_col, host_col))
    rates = host_rates(features)
    name = F.when(F.col("host").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "host"))
    left = features.withColumn("_host", name)
    right = cut_lineage(rates.withColumn("_host", name).drop("host"))
    joined = counted_lookup(left, right, "_host", "n_docs", spread=["doc_id", "word_chars"])
    rejected = F.greatest(*[F.col(f"rate_{rule}") for rule in RULES]) > host_limit
    at_fault = F.lit(False)
    for rule, test in RULES.items():
        if rule not in BASE:
            at_fault = at_fault | (F.expr(test) & (F.col(f"rate_{rule}") >= tolerated))
    base_failed = F.expr(" OR ".join(f"({RULES[rule]})" for rule in BASE))
    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~rejected & ~at_fault).alias("kept"),
    )


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; its source is its host."""
    return judge_documents(table(spark, sf_dir, "documents"))


_FAILS = ", ".join(f"({rule}) AS f_{name}" for name, rule in RULES.items())
_HOSTS = ", ".join(f"sum(CAST(f_{name} AS BIGINT)) AS k_{name}" for name in RULES)
_MOMENTS = ", ".join(
    f"avg(CAST(k_{name} AS DOUBLE) / n) AS m_{name}, avg((CAST(k_{name} AS DOUBLE) / n) ** 2) AS s_{name}"
    for name in RULES
)
_STRENGTHS = ", ".join(
    f"m_{name}, least(greatest(m_{name} * (1 - m_{name}) / greatest(s_{name} - m_{name} * m_{name}, 1e-9) - 1, 1), 1e6) AS t_{name}"
    for name in RULES
)
_RATES = ", ".join(f"(k_{name} + m_{name} * t_{name}) / (n + t_{name}) AS r_{name}" for name in RULES)
_WORST = ", ".join(f"r_{name}" for name in RULES)
_FAULT = " OR ".join(f"(f_{name} AND r_{name} >= {TOLERATED})" for name in RULES if name not in BASE)
OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT k, i, w[i:i + 2] AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (
  SELECT k, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT place) AS n FROM repeated GROUP BY k),
c AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (k)),
f AS (SELECT *, {_FAILS} FROM c),
hosts AS (SELECT source, count(*) AS n, {_HOSTS} FROM f GROUP BY source),
moments AS (SELECT {_MOMENTS} FROM hosts),
prior AS (SELECT {_STRENGTHS} FROM moments),
rates AS (SELECT source, {_RATES} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       f_short OR f_repeats AS base_failed,
       NOT (f_short OR f_repeats) AND greatest({_WORST}) <= {HOST_LIMIT} AND NOT ({_FAULT}) AS kept
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""
