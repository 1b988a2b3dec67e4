from songloom.plans import reviews
from tests.conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_language_ties_and_empty_texts(spark):
    marks = spark.createDataFrame(
        [("en", "the"), ("en", "a"), ("fr", "la"), ("es", "la"), ("es", "el")], "lang string, word string"
    )
    texts = docs(spark, "The cat, a dog", "la casa", "", None, "La el", "über 12")
    got = rows(reviews.detect_language(texts, marks))
    assert got == [(0, "en", 2), (1, "es", 1), (2, None, 0), (3, None, 0), (4, "es", 2), (5, None, 0)]


def test_normalised_text_keeps_everything_else(spark):
    dictionary = spark.createDataFrame(
        [("u", "you"), ("b4", "before"), ("gr8", "great"), (None, "no")], "token string, expansion string"
    )
    texts = docs(spark, "C U  b4\nnoon, gr8!", "nothing; here", "", "u", None)
    again = spark.createDataFrame([(3, "ab  u")], texts.schema)
    got = rows(reviews.normalise_text(texts.union(again), dictionary))
    assert got == [
        (0, "C you  before\nnoon, great!"), (1, "nothing; here"), (2, ""), (3, "ab  you"), (3, "you"), (4, None),
    ]


def test_sentiment(spark):
    lexicon = spark.createDataFrame(
        [("good", 0.75, 0.0), ("bad", 0.0, 0.625), ("fine", 0.5, 0.5), ("good", 0.25, 0.0), ("good", 1.25, 0.0)], "word string, pos double, neg double"
    )
    texts = docs(spark, "Good, good!", "bad good bad", "fine", "unknown", "")
    got = rows(reviews.lexicon_sentiment(texts, lexicon))
    assert got == [
        (0, 2, 1.5, "positive"), (1, 3, -0.5, "negative"), (2, 1, 0.0, "neutral"),
        (3, 0, 0.0, "neutral"), (4, 0, 0.0, "neutral"),
    ]


def test_spam_flags(spark):
    long = " ".join(["word"] * 30)
    copies = ["copied text " * 20] * 40
    texts = docs(spark, long, "short one", "1234 !!! " * 30 + long[:20], f"{long}\n{long}", *copies, None)
    got = {r.doc_id: r for r in reviews.flag_spam(texts).collect()}
    assert not got[0].spam
    assert got[1].too_short and got[1].spam
    assert got[2].few_letters
    assert got[3].repeated_lines and not got[3].duplicate
    assert all(got[i].duplicate for i in range(4, 44)) and len(got) == 45
    assert got[44].spam and not got[44].duplicate


def test_patches_equal_a_plain_replacement(spark):
    """Neighbouring, first, last and repeated hits, in short and long texts."""
    import random
    import re

    words = {"u": "you", "b4": "before", ":)": "smile", "a": "", "straße": "road"}
    draw = random.Random(4)
    parts = [*words, "x", "yy", " ", " ", "\n", ".", "U", "STRASSE", "Straße", "é1"]
    texts = ["".join(draw.choices(parts, k=draw.choice([0, 1, 2, 3, 9, 40]))) for _ in range(300)]
    texts += ["u " * 5_000, "x" * 10_000, "u" + " x" * 5_000 + " u"]
    swap = lambda piece: words.get(piece[0].lower(), piece[0])
    wanted = [re.sub(r"[^\W_]+|[\W_]+", swap, text) for text in texts]
    dictionary = spark.createDataFrame(list(words.items()), "token string, expansion string")
    got = {row.doc_id: row.text for row in reviews.normalise_text(docs(spark, *texts).repartition(5), dictionary).collect()}
    assert [got[n] for n in range(len(texts))] == wanted
