"""Small tables with everything that a corpus may hold."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, node string, "
    "spans string, n_words string"
)


def prose(seed: int, n_words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n_words))


def odd_rows() -> list[tuple]:
    long_text = prose(1, 20_000)
    texts = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n ", None),
        (4, "one", "b"),
        (5, prose(2, 60), "b"),
        (5, prose(2, 60), "b"),  # the row before again
        (None, prose(3, 80), "a"),
        (None, None, None),
        (6, long_text, "a"),
        (7, prose(2, 60), None),  # the text of 5
        (8, "Zwei  Wörter Größe\n\nzeile 中文", "c"),
        (9, "\n".join([prose(4, 60), prose(5, 60)]), "c"),
        (10, "\n".join([prose(6, 60), prose(5, 60)]), "c"),
    ]
    return [(i, t, "en", s, 0, 0.5, "n", "s", "w") for i, t, s in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
