"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import id_remainder, map_texts, plain_names, table
from songloom.storage import cut_lineage

#: Most labelled documents the lexicon is learned from, the same at every size of the input.
MAX_LABELLED = 20_000
#: A document of this score or more is toxic.
THRESHOLD = 0.7
#: A pattern needs this many toxic documents and this log ratio of its shares of the two classes.
MIN_SUPPORT, MIN_WEIGHT = 3, math.log(20)
_SHORTEST, _LONGEST = 3, 12  # letters of a learned word start
_BUFFER, _EMITTED = 1_000_000, 50_000  # counts that a task holds, and rows of one batch
_DAMPING = 50  # words added to a text's length, so a hit in a short text isn't everything

# Look-alike letters of other scripts, and digits or signs written for letters.
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}


def _fold_table() -> dict[int, str]:
    fold = {code: " " for code in range(128) if not chr(code).isalnum()}
    fold |= {code: chr(code).lower() for code in range(ord("A"), ord("Z") + 1)}
    fold |= {ord(char): to for char, to in _LOOKALIKE.items()}
    fold |= {ord(char.upper()): to for char, to in _LOOKALIKE.items() if len(char.upper()) == 1}
    # full-width forms of the printable ASCII characters
    fold |= {code + 0xFEE0: fold.get(code, chr(code)) for code in range(0x21, 0x7F)}
    fold |= {code: "" for code in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD)}  # invisible
    return fold


_FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Lower-case words between single blanks, with look-alikes and digits read as letters."""
    if not text:
        return " "
    return f" {' '.join(text.translate(_FOLD).lower().split())} "


@dataclass
class Lexicon:
    """Weights of word starts and words, phrases that excuse them, and the calibration.

    A key of ``weights`` begins with a blank; one that also ends with a blank is a whole word.
    """

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        machine = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            machine.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        if not len(machine):
            return None
        machine.make_automaton()
        return machine


def hits(folded: str, machine: ahocorasick.Automaton | None) -> dict[int, float]:
    """Weight by start of word: the heaviest pattern there, unless an exception covers it."""
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if machine is None:
        return found
    for end, (size, weight) in machine.iter(folded):
        first = end - size + 1
        if weight is None:
            excused.append((first, end))
        else:
            found[first] = max(weight, found.get(first, 0.0))
    if excused:
        found = {
            at: weight
            for at, weight in found.items()
            if not any(first <= at < last for first, last in excused)
        }
    return found


def _features(weight: float, n_words: int) -> tuple[float, float]:
    """Total weight of a text, and its weight per hundred words, both damped."""
    return math.log1p(weight), math.log1p(100 * weight / (n_words + _DAMPING))


def score(weight: float, n_words: int, coefficients: tuple[float, float, float]) -> float:
    total, rate = _features(weight, n_words)
    bias, by_total, by_rate = coefficients
    return 1 / (1 + math.exp(-(bias + by_total * total + by_rate * rate)))


def _word_starts(folded: str) -> set[str]:
    found = set()
    for word in set(folded.split()):
        found.update(f" {word[:size]}" for size in range(_SHORTEST, min(_LONGEST, len(word)) + 1))
        found.add(f" {word} ")
    return found


def _class_counts(
    batches: Iterator[pa.RecordBatch], found: Callable[[str], set[str]]
) -> Iterator[pa.RecordBatch]:
    """How many clean and how many toxic texts show each thing that ``found`` gives for a text.

    A task sums up to ``_BUFFER`` things before it emits them, and emits nothing if it saw none.
    """

    def emitted() -> Iterator[pa.RecordBatch]:
        keys = list(counts[0] | counts[1])
        for first in range(0, len(keys), _EMITTED):
            part = keys[first : first + _EMITTED]
            columns = [pa.array(part, pa.string())]
            columns += [pa.array([count[x] for x in part], pa.int64()) for count in counts]
            yield pa.RecordBatch.from_arrays(columns, ["thing", "n_clean", "n_toxic"])

    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["body"].to_pylist(), batch["toxic"].to_pylist()):
            counts[int(toxic)].update(found(fold(text)))
            if len(counts[0]) + len(counts[1]) > _BUFFER:
                yield from emitted()
                counts = (Counter(), Counter())
    yield from emitted()


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _class_counts(batches, _word_starts)


_COUNTS = "thing string, n_clean long, n_toxic long"


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("thing").agg(
        F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic")
    )


def _select(rows: list, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Of each chain of word starts, the longest that still finds nearly all of the toxic texts."""
    toxic = {row.thing: row.n_toxic for row in rows}
    weight = {
        row.thing: math.log((row.n_toxic + 0.5) / (n_toxic + 1))
        - math.log((row.n_clean + 0.5) / (n_clean + 1))
        for row in rows
    }
    best_longer: Counter = Counter()
    for pattern, count in toxic.items():
        for size in range(_SHORTEST + 1, len(pattern)):
            best_longer[pattern[:size]] = max(best_longer[pattern[:size]], count)
    chosen: dict[str, float] = {}
    for pattern in sorted(toxic, key=lambda x: (len(x), x)):
        if best_longer[pattern] >= 0.9 * toxic[pattern]:
            continue
        shorter = [chosen.get(pattern[:size], 0.0) for size in range(_SHORTEST + 1, len(pattern))]
        if weight[pattern] > max(shorter, default=0.0) + 1e-9:
            chosen[pattern] = weight[pattern]
    return chosen


def _phrases(folded: str, machine: ahocorasick.Automaton) -> set[str]:
    """Each hit word with the word after it."""
    found = set()
    for at in hits(folded, machine):
        pair = folded[at + 1 :].split(" ", 2)[:2]
        if len(pair) == 2 and pair[1]:
            found.add(f" {pair[0]} {pair[1]} ")
    return found


def _learn_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around a pattern that clean texts use and toxic ones don't."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        return _class_counts(batches, lambda folded: _phrases(folded, machine))

    kept = _summed(sample.mapInArrow(count, _COUNTS)).filter("n_clean >= 2 AND n_toxic = 0")
    return sorted(row.thing for row in kept.collect())  # from a sample of bounded size


def _calibrate(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on a text's damped weights, from a table of counts."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            out: list[list[int]] = [[], []]
            for text in batch["body"].to_pylist():
                folded = fold(text)
                weight = sum(hits(folded, machine).values())
                for column, value in zip(out, _features(weight, folded.count(" ") - 1)):
                    column.append(round(4 * value))
            arrays = [*[pa.array(column, pa.int32()) for column in out], batch["toxic"]]
            yield pa.RecordBatch.from_arrays(arrays, ["total", "rate", "toxic"])

    counted = sample.mapInArrow(cells, "total int, rate int, toxic int")
    rows = counted.groupBy("total", "rate", "toxic").count().collect()  # a grid of two logarithms
    if not rows:
        return Lexicon().coefficients
    x = np.array([[1.0, row.total / 4, row.rate / 4] for row in rows])
    y = np.array([float(row.toxic) for row in rows])
    n = np.array([float(row["count"]) for row in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ beta
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    exceptions: list[str] | None = None,
) -> Lexicon:
    """Learn weighted patterns, exception phrases and calibration from labelled documents.

    At most ``max_labelled`` documents are used, those whose ids hash lowest, so texts are met
    with a broadcast of bounded size and aren't shuffled. An id labelled twice counts as toxic if
    any label says so; null ids and labels are left out. A repeated document counts each time.
    Without toxic or without clean examples the lexicon is empty and every score is low.
    ``exceptions`` adds phrases that excuse the words in them.
    """
    marked = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_key"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(max_labelled)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("body"))
    sample = cut_lineage(
        found.join(F.broadcast(marked), F.col("_id") == F.col("_key"))
        .filter(F.col("body").isNotNull())
        .select("body", "toxic")
    )
    sizes = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    lexicon = Lexicon()
    if n_clean and n_toxic:
        counted = _summed(sample.mapInArrow(_count_patterns, _COUNTS))
        share = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log(
            (F.col("n_clean") + 0.5) / (n_clean + 1)
        )
        rows = counted.filter((F.col("n_toxic") >= MIN_SUPPORT) & (share >= MIN_WEIGHT)).collect()
        lexicon.weights = _select(rows, n_clean, n_toxic)
        if lexicon.weights:
            lexicon.exceptions = _learn_exceptions(sample, lexicon)
        lexicon.coefficients = _calibrate(sample, lexicon)
    lexicon.exceptions += [fold(phrase) for phrase in exceptions or []]
    return lexicon


def score_toxicity(
    docs: DataFrame,
    lexicon: Lexicon,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, in place of columns of those names.

    ``keep`` names the columns to carry along (default: all).

    One row per row, repeated rows included; a null or empty text has no hits and the score of a
    text without hits. Texts are scored whole, and nothing is shuffled.
    """
    names = keep or [name for name in docs.columns if name not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        machine, by = sent.value.automaton(), sent.value.coefficients

        def run(texts: list[str | None]) -> list:
            folded = [fold(text) for text in texts]
            weights = [sum(hits(x, machine).values()) for x in folded]
            return [[score(w, x.count(" ") - 1, by) for w, x in zip(weights, folded)]]

        return run

    scored = map_texts(docs, text_col, names, make, {"score": ("double", pa.float64())})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns.

    A null or empty text stays; repeated rows stay or go alike. An empty table, or labels without
    examples of both classes, reject nothing. Columns of ``docs`` may have any name.
    """
    lexicon = learn_lexicon(docs, _training(labels), text_col=text_col)
    plain, place = plain_names(docs)
    scored = score_toxicity(plain, lexicon, place[text_col])
    return scored.filter("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def _training(labels: DataFrame) -> DataFrame:
    return labels.filter(id_remainder(F.col("doc_id"), 3) != 1)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs, _training(labels))
    scored = score_toxicity(docs, lexicon, keep=["doc_id"])
    held_out = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")
