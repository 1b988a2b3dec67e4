"""Quality classifier from weak labels: agreement of heuristics, then a hashed linear scorer."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import WORD, table, words_column
from songloom.storage import cut_lineage, scratch_path

#: Most documents the scorer is trained on, the same at every size; the labellers see all.
MAX_TRAINING = 20_000
HASHED_FEATURES = 1 << 12
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>{}=~^_"
ABSTAIN, BAD, GOOD = OUTCOMES = "a", "b", "g"
_ROUNDS, _SMOOTHING = 200, 0.1
#: When each labeller calls a document bad or good; otherwise it abstains.
LABELLERS = {
    "symbols": ("5 * n_symbols > n_words", "50 * n_symbols < n_words"),
    "capitals": ("2 * n_capitals > n_letters", "5 * n_capitals < n_letters"),
    "stutter": ("5 * n_stutter > n_words", "50 * n_stutter <= n_words AND n_words > 1"),
    # distinct words grow about as the root of a text's length
    "variety": (
        "10 * n_distinct < 3 * n_words AND n_distinct * n_distinct < 4 * n_words",
        "n_words > 1 AND (2 * n_distinct > n_words OR n_distinct * n_distinct > 25 * n_words)",
    ),
    "lines": ("10 * n_repeated_lines > 3 * n_lines", "n_repeated_lines = 0 AND n_lines > 1"),
    "length": ("n_words < 3", "n_words >= 50"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    "lone_marks": ("10 * n_lone > n_words", "50 * n_lone < n_words"),
    "marks": ("10 * n_marks > n_words", "100 * n_marks < n_words"),
}
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _removed(text: str, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id``, ``text_key``, the labellers' measures, ``votes`` (a letter for each), and ``more``."""
    text = F.col(text_col).cast("string")
    read = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(text, F.lit("")).alias("body"),
        *more,
    )
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD))
    cut = read.withColumn("words", words_column(F.col("body"))).withColumn("lines", lines)
    # one pass of an expression over the text is cheaper than a function of each word
    count = lambda pattern: F.regexp_count("body", F.lit(pattern)).cast("long")
    capitals = _removed("body", CAPITALS)
    measured = cut.select(
        *[name for name in read.columns if name != "body"],
        count(WORD).alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count(r"(?<!\S)(\S+)\s+(?=\1(?!\S))").alias("n_stutter"),
        count(r"[!?#$%&*]{2,}(?!\S)").alias("n_marks"),
        count(r"(?<!\S)[^\s\p{L}\p{N}]+(?!\S)").alias("n_lone"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_repeated_lines"),
        _removed("body", SYMBOLS).alias("n_symbols"),
        capitals.alias("n_capitals"),
        (capitals + _removed("body", SMALL)).alias("n_letters"),
        F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    votes = [
        F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(ABSTAIN)
        for bad, good in LABELLERS.values()
    ]
    return measured.withColumn("votes", F.concat(*votes))


Chances = list[dict[str, tuple[float, float]]]


def fit_accuracies(patterns: dict[str, int]) -> tuple[float, Chances]:
    """Part of good documents, and for each labeller and outcome its chances on a bad and a good one.

    Expectation-maximisation on how often each pattern of votes occurs. A labeller has three
    outcomes, of which abstaining is one and says what it says; labellers are taken as
    independent given the truth. Only the start tells the classes apart: the belief that whatever
    any labeller calls bad is bad. Patterns number at most 3 to the power of the labellers,
    whatever the corpus.
    """
    belief = {votes: 0.001 if BAD in votes else 0.999 for votes in patterns}
    share, chances = 0.5, [dict.fromkeys(OUTCOMES, (1 / 3, 1 / 3)) for _ in LABELLERS]
    for _ in range(_ROUNDS):
        n_bad = sum((1 - belief[v]) * c for v, c in patterns.items())
        n_good = sum(belief[v] * c for v, c in patterns.items())
        share = (n_good + 1) / (n_bad + n_good + 2)
        chances = []
        for k in range(len(LABELLERS)):
            seen = {outcome: [_SMOOTHING, _SMOOTHING] for outcome in OUTCOMES}
            for votes, count in patterns.items():
                seen[votes[k]][0] += (1 - belief[votes]) * count
                seen[votes[k]][1] += belief[votes] * count
            whole = [n + 3 * _SMOOTHING for n in (n_bad, n_good)]
            chances.append({o: (bad / whole[0], good / whole[1]) for o, (bad, good) in seen.items()})
        fresh = {votes: posterior(votes, share, chances) for votes in patterns}
        moved = max((abs(fresh[v] - belief[v]) for v in patterns), default=0)
        belief = fresh
        if moved < 1e-7:
            break
    return share, chances


def posterior(votes: str, share: float, chances: Chances) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(share / (1 - share))
    for vote, chance in zip(votes, chances):
        bad, good = chance[vote]
        odds += math.log(good / bad)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def token_shapes(text: Column) -> Column:
    """What the scorer sees of each word: long and short runs of small letters, capitals and
    digits as one letter each, and marks as they are."""
    shaped = F.coalesce(text, F.lit(""))
    for pattern, letter in ((r"\p{Ll}{10,}", "y"), (r"\p{Ll}+", "x"), (r"\p{Lu}+", "X"), (r"[0-9]+", "0")):
        shaped = F.regexp_replace(shaped, pattern, letter)
    return words_column(shaped)


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    read = measure(docs, id_col, text_col, token_shapes(text).alias("tokens"))
    # a token for each word that is the one before it again, and for words of repeated lines; and
    # one for the text itself, so that the vector isn't empty
    repeats = F.array_repeat(F.lit("again"), F.col("n_stutter").cast("int"))
    lines = F.array_repeat(F.lit("line again"), (10 * F.col("n_repeated_lines")).cast("int"))
    filled = read.withColumn("tokens", F.concat("tokens", repeats, lines, F.array(F.lit("text"))))
    hashed = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=HASHED_FEATURES).transform(filled)
    return Normalizer(inputCol="counts", outputCol="features", p=2.0).transform(hashed).select("id", "text_key", "votes", "features")


def classify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_training: int = MAX_TRAINING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Weak posterior and score of every document; no labels are used.

    Overlapping heuristics vote on every text; from all patterns of votes follow their accuracies
    and each document's posterior. A logistic scorer on hashed word shapes then learns the
    posteriors of at most ``max_training`` documents (those whose ids and texts hash lowest) and
    scores all.

    A row per row: id, ``votes``, ``posterior``, ``score``, ``kept`` (the score is at least ``threshold``).
    A null text counts as empty; null ids and repeated rows are rows like others. An empty
    table gives no rows. Other columns are not read. Texts are never shuffled.
    """
    spark = docs.sparkSession
    # texts are read here and nowhere else; the vectors are read as vectors for the fit and as arrays
    # for the scores, whose expression needs none of the model's own functions
    made = _features(docs, id_col, text_col)
    path = scratch_path(spark, "votes-and-features")
    made.write.parquet(path)
    vectors = spark.read.schema(made.schema).parquet(path)
    id_type = made.schema["id"].dataType.simpleString()
    stored = spark.read.schema(f"id {id_type}, text_key long, votes string, features {_SPARSE}").parquet(path)
    counts = {row.votes: row["count"] for row in stored.groupBy("votes").count().collect()}
    share, chances = fit_accuracies(counts)
    # at most 3 ** 9 rows
    known = [(votes, posterior(votes, share, chances)) for votes in counts]
    believed = F.broadcast(spark.createDataFrame(known, "_votes string, posterior double"))
    sample = (
        vectors.orderBy(F.xxhash64("id", "text_key"), "id", "text_key")
        .limit(max_training)
        .dropDuplicates(["id", "text_key"])
        .join(believed, F.col("votes") == F.col("_votes"))
        .select("posterior", "features")
    )
    if counts:
        linear = _fit_scorer(cut_lineage(sample))
    else:
        linear = F.lit(0.0)
    met = stored.withColumn("_linear", linear).join(believed, F.col("votes") == F.col("_votes"), "left")
    score = 1 / (1 + F.exp(-F.col("_linear")))
    return met.select(
        F.col("id").alias(id_col), "votes", "posterior", score.alias("score"), (score >= threshold).alias("kept")
    )


#: A stored sparse vector, read as plain columns.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _fit_scorer(sample: DataFrame) -> Column:
    """Log odds of a document as an expression over its ``features``, from ``(posterior, features)``."""
    # each example is good with its posterior's weight and bad with the rest
    both = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")),
        )
    )
    training = sample.select("features", both.alias("x")).select("features", "x.label", "x.weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40).fit(training)
    weights = F.expr("array({})".format(", ".join(f"{w!r}D" for w in model.coefficients.toArray().tolist())))
    products = F.zip_with("features.indices", "features.values", lambda i, x: x * F.get(weights, i))
    return F.aggregate(products, F.lit(float(model.intercept)), lambda total, x: total + x)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Posterior and score of every document."""
    return classify(table(spark, sf_dir, "documents"))
