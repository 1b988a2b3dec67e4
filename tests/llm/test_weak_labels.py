"""Weak labels against plain programs: measures, votes, estimation and scores."""

from __future__ import annotations

import math
import random
from collections import Counter

import regex

from songloom.llm import weak_labels
from songloom.llm.common import table
from tests.llm.odd import odd_docs

GAP = "[ \t\n\x0b\x0c\r]"
NOT_GAP = "[^ \t\n\x0b\x0c\r]"


def _measures(text: str | None) -> dict[str, int]:
    text = text or ""
    words = [w for w in regex.split(f"{GAP}+", text) if w]
    lines = [line for line in text.split("\n") if regex.search(NOT_GAP, line)]
    return {
        "n_words": len(words),
        "n_distinct": len(set(words)),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:])),
        "n_marks": len(regex.findall(f"[!?#$%&*]{{2,}}(?!{NOT_GAP})", text)),
        "n_lone": sum(regex.fullmatch(r"[^\p{L}\p{N}]+", w) is not None for w in words),
        "n_lines": len(lines),
        "n_repeated_lines": len(lines) - len(set(lines)),
        "n_symbols": sum(c in weak_labels.SYMBOLS for c in text),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_letters": sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text),
        "word_chars": sum(map(len, words)),
    }


def _votes(measures: dict[str, int]) -> str:
    says = lambda rule: eval(rule.replace(" = ", " == ").replace("AND", "and").replace("OR", "or"), {}, measures)  # noqa: E731, S307
    rules = [
        (bad, good.replace("word_chars BETWEEN 3 * n_words AND 9 * n_words", "3 * n_words <= word_chars <= 9 * n_words"))
        for bad, good in weak_labels.LABELLERS.values()
    ]
    return "".join("b" if says(bad) else "g" if says(good) else "a" for bad, good in rules)


def test_votes_equal_a_plain_program(spark, sf_dir):
    for docs in (table(spark, sf_dir, "documents").select("doc_id", "text"), odd_docs(spark)):
        texts = Counter((row.doc_id, _votes(_measures(row.text))) for row in docs.collect())
        measured = weak_labels.measure(docs, "doc_id", "text").collect()
        assert Counter((row.id, row.votes) for row in measured) == texts


def test_accuracies_are_estimated(spark):
    """Votes drawn from known chances give those chances back, without a label."""
    draw = random.Random(2)
    truth = [
        {"b": (draw.uniform(0.2, 0.7), draw.uniform(0, 0.03)), "a": (0.2, draw.uniform(0.05, 0.4))}
        for _ in weak_labels.LABELLERS
    ]
    patterns: Counter = Counter()
    for _ in range(40_000):
        good = draw.random() < 0.8
        votes = ""
        for labeller in truth:
            x, bad, none = draw.random(), labeller["b"][good], labeller["a"][good]
            votes += "b" if x < bad else "a" if x < bad + none else "g"
        patterns[votes] += 1
    share, chances = weak_labels.fit_accuracies(patterns)
    assert abs(share - 0.8) < 0.01
    for known, found in zip(truth, chances):
        assert all(abs(a - b) < 0.03 for o in "ab" for a, b in zip(known[o], found[o]))
        assert all(math.isclose(sum(found[o][c] for o in "abg"), 1) for c in (0, 1))


def test_scores_are_the_models(spark, sf_dir):
    """The score's expression gives what the fitted model gives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    found = {row.doc_id: row for row in weak_labels.classify(docs).collect()}
    counts = Counter(row.votes for row in found.values())
    share, chances = weak_labels.fit_accuracies(counts)
    for row in found.values():
        assert math.isclose(row.posterior, weak_labels.posterior(row.votes, share, chances), rel_tol=1e-9)
    features = weak_labels._features(docs, "doc_id", "text")
    known = spark.createDataFrame([(v, weak_labels.posterior(v, share, chances)) for v in counts], "votes string, p double")
    rows = features.join(known, "votes").dropDuplicates(["id", "text_key"])
    good = rows.select("features", F.lit(1.0).alias("label"), F.col("p").alias("weight"))
    bad = rows.select("features", F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40).fit(good.union(bad))
    again = model.transform(features).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    assert all(abs(found[row.id].score - row.score) < 0.02 for row in again.collect())
