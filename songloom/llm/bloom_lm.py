"""Language-model scores from quantised n-gram counts in a Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from songloom.llm.common import id_remainder, map_texts, table
from songloom.storage import cut_lineage

#: Counts are stored as the largest k with BASE**(k - 1) <= count.
BASE = 1.25
#: A bigram enters the model when it has been seen this often.
MIN_BIGRAM = 2
HASHES = 4
#: Bits for one stored level; 4 hashes then give one false answer in about a hundred probes.
BITS_PER_LEVEL = 10
#: A filter is never larger, so that it can be broadcast; beyond it errors become more frequent.
MAX_BITS = 1 << 29
_PIECES = 512  # of a filter, each set by one group of rows; as many whatever its size
_PLACES = 1 << 19  # positions that a task gathers before it deals them out to the pieces
#: Words that hold more than this part of all tokens go to every task as a table: there are fewer
#: of them than its inverse, 16 bytes each.
FREQUENT = 1 / 2_000_000
_SCORED_ROWS = 1000  # texts that are scored together, whose repeated words and bigrams are looked up once
_BIT = np.array([1 << bit for bit in range(8)], np.uint8)
_BUFFER = 4_000_000  # hashes that a task sums before it emits them
_LEVEL_BITS = np.uint64(0xFF)  # low bits of a bigram's key: the level of its first word
_END = b"\n"  # no word contains it


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words (UTF-8, A-Z in lower case) of some texts, each text's followed by an end, and tokens
    of each text. Splitting bytes cuts at ASCII white space only."""
    cut = [[*(text or "").encode().lower().split(), _END] for text in texts]
    flat = np.array([w for x in cut for w in x], dtype=object)
    return flat, np.array([len(x) for x in cut], np.int64)


def word_hashes(words: np.ndarray) -> np.ndarray:
    # hashing each word is cheaper than finding the distinct ones first
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


_END_HASH = word_hashes(np.array([_END], object))[0]


def _previous(values: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """The value of the token before each; a text begins after an end."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[np.concatenate([[0], np.cumsum(counts)[:-1]])] = end
    return before


def bigram_key(v: np.ndarray, w: np.ndarray, level: np.ndarray) -> np.ndarray:
    """56 bits of a hash of both words, and the level of the first word's count."""
    return (_mixed(_mixed(v) + w) & ~_LEVEL_BITS) | level.astype(np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, 0 for 0; counts are at least 1 otherwise."""
    safe = np.maximum(counts, 1)
    return np.where(counts > 0, np.floor(np.log(safe) / math.log(BASE) + 1e-9) + 1, 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the whole numbers that have a level."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE ** level.astype(float) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _stored_levels() -> np.ndarray:
    """Levels that some whole number has: the only ones that need to be stored and probed."""
    numbers = np.unique(level_of(np.unique(np.floor(BASE ** np.arange(0, 190.0)))))
    return np.unique(np.concatenate([level_of(np.arange(1, 200)), numbers]))


STORED = _stored_levels()
_TWICE = int(level_of(np.array([MIN_BIGRAM]))[0])


def _hashes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of keys that reach a level; the filter's positions follow from them."""
    salt = np.uint64(int(level) * 0x9E3779B97F4A7C15 % (1 << 64))
    one = _mixed(key + salt)
    return one, _mixed(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


def _place(one: np.ndarray, two: np.ndarray, number: int, n_bits: int) -> np.ndarray:
    """The position that one of ``HASHES`` hashes gives; ``n_bits`` is below 2 ** 32."""
    return (((one + np.uint64(number) * two) >> np.uint64(32)) * np.uint64(n_bits)) >> np.uint64(32)


@dataclass
class Filter:
    """A log-frequency Bloom filter: a key with level k is stored with every level up to k."""

    bits: np.ndarray
    n_bits: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level each key reaches, found by probing one level after the other."""
        places, distinct = pd.factorize(keys)
        return self.distinct_levels(distinct)[places]

    def distinct_levels(self, distinct: np.ndarray) -> np.ndarray:
        """:meth:`levels` of keys that don't repeat."""
        found = np.zeros(len(distinct), np.int64)
        keys, alive = distinct, np.arange(len(distinct))
        for level in STORED:
            one, two = _hashes(keys, level)
            at = None  # of the keys that all probes have hit; None while these are all
            for number in range(HASHES):
                place = _place(one, two, number, self.n_bits)
                byte = self.bits.take((place >> np.uint64(3)).view(np.int64))
                hit = np.flatnonzero(byte & _BIT.take((place & np.uint64(7)).view(np.int64)))
                if len(hit) < len(one):
                    one, two, at = one.take(hit), two.take(hit), hit if at is None else at.take(hit)
            if at is not None:
                keys, alive = keys.take(at), alive.take(at)
            if not len(alive):
                break
            found[alive] = level
        return found

    def word_levels(self, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of words, and of the words before them."""
        both = self.levels(np.append(w, _END_HASH))
        return both[:-1], _previous(both[:-1], counts, both[-1])


@dataclass
class Model:
    unigrams: Filter
    bigrams: Filter
    weights: np.ndarray  # of the bigram, by level of the first word's count
    total: int  # tokens learned from
    vocabulary: int

    def score(self, w: np.ndarray, counts: np.ndarray, places: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """log10 probability of each text: its word hashes and end, given the word before each.
        ``w`` is ``distinct[places]``.

        P(w | v) = x * c(vw) / c(v) + (1 - x) * P(w), with P(w) = (c(w) + 1) / (N + V + 1) and x
        by the level of c(v). Rare bigrams are left out, so the sum over w is at most 1.
        """
        own = self.unigrams.distinct_levels(distinct)[places]
        level = _previous(own, counts, own[-1])  # the last token is an end
        single = (count_of(own) + 1) / (self.total + self.vocabulary + 1)
        stored = np.zeros(len(w), np.int64)
        often = (own >= _TWICE) & (level >= _TWICE)  # else the pair can't have been seen twice
        v = _previous(w, counts, _END_HASH)
        stored[often] = self.bigrams.levels(bigram_key(v[often], w[often], level[often]))
        pair = count_of(stored)
        share = np.minimum(pair / np.maximum(count_of(level), 1.0), 1.0)
        x = self.weights[level]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(np.log10(x * share + (1 - x) * single), starts)


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    words, counts = tokens(texts)
    return word_hashes(words), counts


def _summed(training: DataFrame, text_col: str, keys_of: Callable) -> DataFrame:
    """``key`` and ``c``: how often each key occurs that ``keys_of()`` finds in texts. Tasks sum
    what they have read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, held, size = keys_of(), [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                held.append(function(batch.slice(first, 1000).column(0).to_pylist()))
                size += len(held[-1])
                if size > _BUFFER:
                    yield from _counted(held)
                    held, size = [], 0
        yield from _counted(held)

    read = training.select(F.col(text_col).cast("string").alias("_body"))
    partial = read.mapInArrow(run, "key long, n int")
    return partial.groupBy("key").agg(F.sum("n").alias("c"))


def _counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for first in range(0, len(keys), 100_000):
            part = slice(first, first + 100_000)
            columns = [pa.array(keys[part].view(np.int64)), pa.array(n[part].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n"])


def build_filter(counts: DataFrame, max_bits: int = MAX_BITS) -> Filter:
    """The filter that holds stored ``counts`` (key, c). Its size follows their number up to
    ``max_bits``. Positions are found on the executors; the driver gets packed chunks."""
    levels = F.floor(F.log("c") / math.log(BASE) + 1e-9) + 1
    n_levels = counts.agg(F.sum(F.least(levels, F.lit(len(STORED))))).first()[0] or 1
    n_bits = int(min(max_bits, max(1 << 16, BITS_PER_LEVEL * n_levels)))

    size = max(1, -(-n_bits // (8 * _PIECES)))  # bytes of a piece

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0
        for batch in batches:
            key = batch["key"].to_numpy(np.int64).view(np.uint64)
            reached = level_of(batch["c"].to_numpy(np.float64))
            for level in STORED:
                on = reached >= level
                if not on.any():
                    break
                one, two = _hashes(key[on], level)
                held += [_place(one, two, number, n_bits).astype(np.uint32) for number in range(HASHES)]
                n_held += HASHES * len(one)
            if n_held > _PLACES:
                yield by_piece(held)
                held, n_held = [], 0
        if held:
            yield by_piece(held)

    def by_piece(held: list[np.ndarray]) -> pd.DataFrame:
        at = np.unique(np.concatenate(held))
        chunk = at // np.uint32(8 * size)
        first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        places = (at % np.uint32(8 * size)).astype("<u4")
        return pd.DataFrame(
            {
                "chunk": chunk[first].astype(np.int64),
                "places": [x.tobytes() for x in np.split(places, first[1:])],
            }
        )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, plane = None, np.zeros(8 * size, np.uint8)

        def packed():
            return pd.DataFrame({"chunk": [held], "bits": [np.packbits(plane, bitorder="little").tobytes()]})

        for batch in batches:
            for chunk, places in zip(batch["chunk"], batch["places"]):
                if chunk != held:
                    if held is not None:
                        yield packed()
                    held, plane = chunk, np.zeros(8 * size, np.uint8)
                plane[np.frombuffer(places, "<u4")] = 1
        if held is not None:
            yield packed()

    found = counts.mapInPandas(positions, "chunk long, places binary")
    grouped = found.repartition("chunk").sortWithinPartitions("chunk")
    chunks = cut_lineage(grouped.mapInPandas(pack, "chunk long, bits binary"))
    bits = np.zeros((n_bits + 7) // 8, np.uint8)
    for row in chunks.toLocalIterator():  # as many bits as the filter has
        part = np.frombuffer(row.bits, np.uint8)[: len(bits) - row.chunk * size]
        bits[row.chunk * size : row.chunk * size + len(part)] |= part
    return Filter(bits, n_bits)


def learn(training: DataFrame, text_col: str = "text", max_bits: int = MAX_BITS) -> tuple[Model, DataFrame]:
    """A model of the texts, and the stored counts (key, c) of its words.

    Bigrams are counted after the words, so that each carries the level of its first word's count;
    those below ``MIN_BIGRAM`` are left out, and so are pairs with a word below it. The weight of bigrams after words of one level is the
    part of these words' occurrences that kept bigrams, less a discount, go on from.
    """
    spark = training.sparkSession
    words = cut_lineage(_summed(training, text_col, lambda: lambda texts: _hashed(texts)[0]))
    total, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    unigrams = build_filter(words, max_bits)
    sent = spark.sparkContext.broadcast(unigrams)

    def pairs():
        known = sent.value

        def run(texts: list[str | None]) -> np.ndarray:
            w, counts = _hashed(texts)
            own, level = known.word_levels(w, counts)
            # a pair with a word seen once isn't seen twice
            often = (own >= _TWICE) & (level >= _TWICE)
            v = _previous(w, counts, _END_HASH)
            return bigram_key(v[often], w[often], level[often])

        return run

    seen = Observation()
    once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    counted = _summed(training, text_col, pairs).observe(seen, once.alias("once"), twice.alias("twice"))
    kept = cut_lineage(counted.filter(F.col("c") >= MIN_BIGRAM))
    once, twice = seen.get["once"], seen.get["twice"]
    discount = once / (once + 2 * twice) if once else 0.5
    level = F.floor(F.log("c") / math.log(BASE) + 1e-9) + 1
    contexts = words.groupBy(level.alias("level")).agg(F.sum("c").alias("c")).collect()
    first = F.col("key").bitwiseAND(F.lit(int(_LEVEL_BITS)))
    masses = kept.groupBy(first.alias("level")).agg(F.sum(F.col("c") - discount).alias("mass")).collect()
    weights = np.zeros(int(_LEVEL_BITS) + 1)
    occurrences = {int(row.level): row.c for row in contexts}  # rows by level: fewer than 200
    for row in masses:
        weights[row.level] = min(0.95, row.mass / max(1, occurrences.get(int(row.level), 1)))
    model = Model(unigrams, build_filter(kept, max_bits), weights, int(total), int(vocabulary))
    return model, words


def score_corpus(
    docs: DataFrame,
    training: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Score the texts of ``docs`` by a bigram model learned from those of ``training``.

    A row per row of ``docs``: its id, ``n_tokens``, ``n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (add-one unigrams, from exact counts) and ``score`` (the
    model's log10 probability).

    Words are met by 64-bit hashes. Counts of all words and bigrams are summed by shuffles of what
    each task has summed. The model goes to the workers as two Bloom filters of bounded size. For
    the exact base, frequent words (fewer than two million) are met where the text is read, and
    the others by a join, as one row for each text and word.

    A null or empty text is one end. Null ids and repeated rows are rows like others. Without
    training texts no token is known and all are equally likely. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    model, words = learn(training, text_col, max_bits)
    bound = model.total * FREQUENT
    # fewer rows than 1 / FREQUENT, two numbers each, in blocks
    often = words.filter(F.col("c") > bound).sort("key").toArrow()
    keys = often.column("key").to_numpy()
    sent = spark.sparkContext.broadcast((model, keys, often.column("c").to_numpy()))
    base = math.log10(model.total + model.vocabulary + 1)

    def make():
        known, keys, c = sent.value

        def run(texts: list[str | None]) -> list:
            w, counts = _hashed(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            places, distinct = pd.factorize(w)
            signed = distinct.view(np.int64)
            at = np.minimum(np.searchsorted(keys, signed), max(len(keys) - 1, 0))
            frequent = keys[at] == signed if len(keys) else np.zeros(len(signed), bool)
            terms = np.where(frequent, np.log10(c[at] + 1.0) - base, 0.0) if len(keys) else np.zeros(len(signed))
            hot = frequent[places]
            sums = np.bincount(owner, terms[places], len(texts))
            n_hot = np.bincount(owner, hot, len(texts)).astype(np.int64)
            # a number for each text and rare word of it
            both, n = np.unique(owner[~hot] * len(distinct) + places[~hot], return_counts=True)
            o, x = both // len(distinct), signed[both % len(distinct)]
            ends = np.searchsorted(o, np.arange(1, len(texts)))
            lists = [np.split(x, ends), np.split(n.astype(np.int64), ends)]
            return [counts, n_hot, sums, known.score(w, counts, places, distinct), *lists]

        return run

    fields = {
        "n_tokens": ("long", pa.int64()),
        "n_hot": ("long", pa.int64()),
        "hot_sum": ("double", pa.float64()),
        "score": ("double", pa.float64()),
        "rare": ("array<long>", pa.list_(pa.int64())),
        "n_rare": ("array<long>", pa.list_(pa.int64())),
    }
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    scored = map_texts(read, "body", ["id"], make, fields, rows=_SCORED_ROWS)
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "n_rare")).alias("x")).select(
        "row", F.col("x.rare").alias("key"), F.col("x.n_rare").alias("n")
    )
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0) - F.lit(base)
    sums = (
        each.join(words.filter(F.col("c") <= bound), "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * log_c).alias("cold_sum"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_cold"),
        )
    )
    return (
        scored.select("row", "id", "n_tokens", "n_hot", "hot_sum", "score")
        .join(sums, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_tokens",
            (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
            F.lit(model.total).cast("long").alias("train_tokens"),
            (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    fold = id_remainder(F.col("doc_id"), 7)
    scored = score_corpus(docs, docs.filter(fold != 2))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
