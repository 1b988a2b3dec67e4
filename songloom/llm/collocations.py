"""Phrase collocations by dynamic itemset counting over shards of the corpus.

Texts are encoded once: every word becomes a 64-bit number and the documents are dealt to shards.
The shards are then scanned in a cycle. Words are counted from the first scan on. A longer phrase
is counted from the scan after both of its parts, without its last and without its first word, have
reached the threshold, so lengths grow beside each other instead of one after the other. A phrase
is done when it has seen every shard once.

Nobody lists the active phrases: a phrase that a scan meets is active if its two parts have
reached the threshold, in scans that say when its own cycle began. A scan asks a Bloom filter of
bounded size, and sums what passes. At the end a join with the parts of the frequent phrases tells
which sums hold scans outside a phrase's cycle, and these are taken again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import small_batches, table
from songloom.storage import cut_lineage, scratch_path

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
SHARDS = 3
UNKNOWN_LANG = "und"
#: A phrase that a longer one holds goes if the longer one has this share of its occurrences.
CONTAINED_PERCENT = 80
SCALE = 2_000_000
#: 64-bit words of the filter, at most: 8 MB. A fuller filter lets more phrases through to the join.
MAX_SLOTS = 1 << 20
_BITS_PER_PHRASE = 16
_BITS = 64  # of a word's number
_BREAK = 0  # stands between pieces and documents; no word has this number
_CHUNK_BYTES, _CHUNK_WORDS = 1 << 20, 1 << 18
_SEEN = 200_000  # words whose spelling a task remembers to have emitted
_PIECE_END = r"[.,;:!?\n\x0b\x0c\r]"


# --- encoding ------------------------------------------------------------------------------------


def _hashed(words: np.ndarray, seed: int, bits: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    numbers = pd.util.hash_array(words, hash_key=f"{seed:016d}", categorize=False)
    numbers = (numbers >> np.uint64(64 - bits)).view(np.int64)
    return np.where(numbers == _BREAK, 1, numbers)


def _encode(
    texts: pa.Array, seed: int, bits: int = _BITS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of some texts with breaks between pieces, how many each text has, and
    the distinct words with their numbers."""
    # a copy, because the functions below misread an array that begins inside its buffer
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    plain = pc.ascii_lower(pc.fill_null(texts, ""))
    cut = pc.replace_substring_regex(plain, pattern=_PIECE_END, replacement=" \n ")
    lists = pc.split_pattern(pc.replace_substring(cut, "\t", " "), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    is_word = (words != "") & (words != "\n")
    numbers = np.where(is_word, _hashed(words, seed, bits), _BREAK)
    codes = coded.indices.to_numpy()
    values, kept = numbers[codes], (words != "")[codes]
    # a break after a break adds nothing
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py())
    values_kept = values[kept]
    sizes = np.diff(np.concatenate([[0], np.cumsum(kept)])[ends])
    return values_kept, sizes, words[is_word], numbers[is_word]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes in a text column, or one long text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    first, total = 0, 0
    for at, size in enumerate(sizes):
        if total and total + size > _CHUNK_BYTES:
            yield batch.slice(first, at - first)
            first, total = at, 0
        total += int(size)
    if batch.num_rows > first:
        yield batch.slice(first)


#: Rows of documents have a language; rows without one hold words and how they are spelled.
_ENCODED = pa.schema(
    {
        "lang": pa.string(),
        "words": pa.list_(pa.int64()),
        "spelled": pa.list_(pa.string()),
    }
)
_NUMBERINGS = 20  # tried before giving up


def _encoder(seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _slices(batch, 1):
                values, sizes, spelled, numbers = _encode(part.column(1), seed, bits)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.nulls(n, pa.list_(pa.string())),
                    ],
                    schema=_ENCODED,
                )
                fresh = [k for k, number in enumerate(numbers.tolist()) if number not in seen]
                if fresh:
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen.update(numbers[fresh].tolist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(1, pa.string()),
                            pa.array([numbers[fresh]], pa.list_(pa.int64())),
                            pa.array([spelled[fresh].tolist()], pa.list_(pa.string())),
                        ],
                        schema=_ENCODED,
                    )
            pa.default_memory_pool().release_unused()

    return run


def _encoded(
    docs: DataFrame, text_col: str, lang_col: str, shards: int, bits: int = _BITS
) -> tuple[list[DataFrame], DataFrame]:
    """The documents as numbers, a table per shard, and each word's number; no two words share one.

    Shards are groups of the files that the encoding tasks wrote.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        docs[text_col].cast("string").alias("body"),
    )
    schema = "lang string, words array<long>, spelled array<string>"
    for seed in range(_NUMBERINGS):
        path = scratch_path(spark, "encoded")
        # numbers repeat: a large dictionary of a column chunk keeps them small
        made = read.mapInArrow(_encoder(seed, bits), schema)
        with small_batches(spark):
            made.write.option("parquet.dictionary.page.size", 4 << 20).parquet(path)
        stored = spark.read.schema(schema).parquet(path)
        pairs = stored.filter(F.col("lang").isNull()).select(
            F.explode(F.arrays_zip("words", "spelled")).alias("pair")
        )
        distinct = pairs.select(F.col("pair.words").alias("number"), F.col("pair.spelled").alias("word"))
        spelling = cut_lineage(distinct.dropDuplicates())
        if spelling.groupBy("number").count().filter("count > 1").isEmpty():
            files = sorted(stored.inputFiles())
            dealt = [files[shard::shards] for shard in range(shards)]
            read_files = lambda names: spark.read.schema(schema).parquet(*names) if names else stored.limit(0)
            return [read_files(names).filter(F.col("lang").isNotNull()) for names in dealt], spelling
    raise RuntimeError("no way to number words kept them apart")


# --- scans ---------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase followed by a word."""
    return _mixed(key * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64) + np.uint64(1))


def _lang_keys(langs: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(langs, object), categorize=False)


def _place(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and bits of a key: three bits in one 64-bit word, so a probe reads memory once."""
    one = np.uint64(1)
    bits = one << (keys & np.uint64(63))
    bits |= one << ((keys >> np.uint64(6)) & np.uint64(63))
    bits |= one << ((keys >> np.uint64(12)) & np.uint64(63))
    return ((keys >> np.uint64(18)) % np.uint64(slots)).astype(np.int64), bits


def _holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot, bits = _place(keys, len(filter_))
    return (filter_[slot] & bits) == bits


def _filter_of(phrases: DataFrame, n: int, longest: int) -> np.ndarray:
    """A Bloom filter of phrases, put together from at most ``MAX_SLOTS`` sums of bits."""
    slots = 1 << 8
    while slots * 64 < n * _BITS_PER_PHRASE and slots < MAX_SLOTS:
        slots *= 2
    columns = _word_columns(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [batch.column(1 + j).to_numpy() for j in range(longest)]
            key = _lang_keys(batch.column(0).to_pylist())
            for word in words:
                key = np.where(word == _BREAK, key, _longer(key, word))
            slot, bits = _place(key, slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(bits.view(np.int64))], ["slot", "bits"]
            )

    filled = np.zeros(slots, np.uint64)
    marked = phrases.select("lang", *columns).mapInArrow(run, "slot long, bits long")
    summed = marked.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # bounded slots
    if summed.num_rows:
        bits = summed.column("bits").to_numpy().view(np.uint64)
        filled[summed.column("slot").to_numpy()] = bits
    return filled


def _word_columns(longest: int) -> list[str]:
    return [f"w{j}" for j in range(1, longest + 1)]


def _scan(spark, shard: DataFrame, step: int, shards: int, reached, recent, longest: int) -> DataFrame:
    """Occurrences in one shard of words, while they are counted, and of phrases whose parts the
    filters may hold, summed per chunk of a task."""
    sent = spark.sparkContext.broadcast((reached, recent))
    count_words = step < shards

    def chunk(langs: list[str], lang: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        reached, recent = sent.value
        is_word = v != _BREAK
        lang_keys = _lang_keys(langs)[lang]
        if count_words:
            yield from emit(langs, lang, v, np.flatnonzero(is_word), lang_keys, 1)
        if reached is None:
            return
        # where the phrase of the current length begins, its key, and what the filters say
        starts = np.flatnonzero(is_word)
        base = _longer(lang_keys[starts], v[starts])
        for k in range(2, longest + 1):
            known = _holds(reached, base)
            starts, base = starts[known], base[known]
            if not len(starts):
                return
            fresh = _holds(recent, base) if recent is not reached else np.ones(len(starts), bool)
            # a phrase one longer needs the part that begins one word later too
            follows = np.flatnonzero(np.diff(starts) == 1)
            counted = follows[fresh[follows] | fresh[follows + 1]]
            first = starts[counted]
            key = _longer(base[counted], v[first + k - 1])
            yield from emit(langs, lang, v, first, key, k, keyed=True)
            starts = starts[follows]
            base = _longer(base[follows], v[starts + k - 1])

    def emit(langs, lang, v, first, key, k, keyed=False) -> Iterator[pa.RecordBatch]:
        if not len(first):
            return
        if not keyed:
            key = _longer(key[first], v[first])
        _, at, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        model = first[at][group]
        # equal keys of different phrases are told apart, however unlikely they are
        same = lang[first] == lang[model]
        for j in range(k):
            same &= v[first + j] == v[model + j]
        where, n = first[at], n
        if not same.all():
            n = np.bincount(group[same], minlength=len(at))
            where = np.concatenate([where, first[~same]])
            n = np.concatenate([n, np.ones((~same).sum(), n.dtype)])
        names = pa.array(langs, pa.string())
        columns = [names.take(pa.array(lang[where])), pa.array(np.full(len(where), k, np.int32))]
        columns += [pa.array(v[where + j]) if j < k else pa.array(np.zeros(len(where), np.int64)) for j in range(longest)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy()
            codes = batch.column(0).dictionary_encode()
            langs, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            at = 0
            while at < batch.num_rows:
                # whole documents up to the chunk's size, or one long document
                end = int(np.searchsorted(offsets, offsets[at] + _CHUNK_WORDS, "right")) - 1
                end = min(max(end, at + 1), batch.num_rows)
                sizes = np.diff(offsets[at : end + 1])
                # a break after every document
                v = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
                inside = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
                v[inside] = flat[offsets[at] : offsets[end]]
                yield from chunk(langs, np.repeat(lang[at:end], sizes + 1), v)
                at = end
            pa.default_memory_pool().release_unused()

    output = ["lang", "k", *_word_columns(longest), "n"]
    schema = f"lang string, k int, {', '.join(f'{w} long' for w in _word_columns(longest))}, n long"
    counted = shard.select("lang", "words").mapInArrow(run, schema)
    return counted.groupBy("lang", "k", *_word_columns(longest)).agg(F.sum("n").alias("n"))


def _in_whole_cycles(scans: DataFrame, reached: DataFrame, shards: int, longest: int, min_count: int) -> DataFrame:
    """``lang``, ``k``, words and ``n`` of the frequent phrases of all scans' sums.

    A phrase's cycle begins after the scan in which the later of its parts reached the threshold. A filter
    never misses an active phrase, but may let one in at other scans; such a phrase, which shows in
    its first and last scan, is summed again over its own cycle.
    """
    words = _word_columns(longest)
    keys = ["lang", "k", *words]
    summed = scans.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("step").alias("_first"), F.max("step").alias("_last")
    ).filter(F.col("n") >= min_count)
    summed = cut_lineage(summed)
    parts = reached.select("lang", *words[:-1], "step")
    before = parts.toDF("_lang1", *[f"_p{j}" for j in range(longest - 1)], "_reach1")
    after = parts.toDF("_lang2", *[f"_s{j}" for j in range(longest - 1)], "_reach2")
    first = [F.when(F.col("k") > j + 1, F.col(words[j])).otherwise(_BREAK) for j in range(longest - 1)]
    located = cut_lineage(
        summed.filter("k > 1")
        .withColumns({f"_f{j}": part for j, part in enumerate(first)})
        .join(before, [F.col("lang") == F.col("_lang1"), *[F.col(f"_f{j}") == F.col(f"_p{j}") for j in range(longest - 1)]])
        .join(after, [F.col("lang") == F.col("_lang2"), *[F.col(words[j + 1]) == F.col(f"_s{j}") for j in range(longest - 1)]])
        .select(*keys, "n", "_first", "_last", (F.greatest("_reach1", "_reach2") + 1).alias("_begins"))
    )
    within = (F.col("_first") >= F.col("_begins")) & (F.col("_last") < F.col("_begins") + shards)
    exact = summed.filter("k = 1").select(*keys, "n").unionByName(located.filter(within).select(*keys, "n"))
    doubtful = located.filter(~within).select(*keys, "_begins")
    again = (
        scans.join(doubtful, keys)
        .filter((F.col("step") >= F.col("_begins")) & (F.col("step") < F.col("_begins") + shards))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )
    return exact.unionByName(again.filter(F.col("n") >= min_count))


def count_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    shards: int = SHARDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases, words in all, and spellings.

    The first table has ``lang``, ``k``, word numbers ``w1`` .. and the exact count ``n`` of every
    phrase of up to ``longest`` words found ``min_count`` times or more; the second ``lang`` and the
    number of all word occurrences; the third ``number`` and ``word``.
    """
    spark = docs.sparkSession
    words = _word_columns(longest)
    numbers = ", ".join(f"{word} long" for word in words)
    stored, spelling = _encoded(docs, text_col, lang_col, shards)
    scans = _Steps(spark, "scans", f"lang string, k int, {numbers}, n long")
    reached = _Steps(spark, "phrases-reached", f"lang string, {numbers}")
    new: list[int] = []
    while len(new) < shards or any(new[-shards:]):
        step = len(new)
        bound, late = None, None
        if any(new):
            bound = _filter_of(reached.since(0), sum(new), longest)
            late = bound
            if step > shards:  # parts that reached the threshold earlier begin no open cycle
                late = _filter_of(reached.since(step - shards), sum(new[-shards:]), longest)
        with small_batches(spark):
            scans.add(_scan(spark, stored[step % shards], step, shards, bound, late, longest))
        # the whole cycle of what is still counted lies in the last scans; words are counted in the first
        counted = (F.col("k") < longest) & ((F.col("k") > 1) | F.lit(step < shards))
        lately = scans.since(step + 1 - shards).filter(counted)
        enough = lately.groupBy("lang", *words).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
        fresh = enough.join(reached.since(0), ["lang", *words], "left_anti") if any(new) else enough
        new.append(reached.add(fresh.select("lang", *words)).count())
    totals = scans.since(0).filter("k = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = _in_whole_cycles(scans.since(0), reached.since(0), shards, longest, min_count)
    return cut_lineage(frequent), cut_lineage(totals), spelling


class _Steps:
    """Rows that are added scan by scan and read as one table, with the number of their scan."""

    def __init__(self, spark, name: str, schema: str) -> None:
        self.spark, self.schema = spark, schema
        self.path = scratch_path(spark, name)
        self.steps = 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Store the rows of the next scan and give them back."""
        path = f"{self.path}/step={self.steps}"
        rows.write.parquet(path)
        self.steps += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def since(self, step: int) -> DataFrame:
        if not self.steps:
            return self.spark.createDataFrame([], f"{self.schema}, step int")
        stored = self.spark.read.schema(f"{self.schema}, step int").parquet(self.path)
        return stored.filter(F.col("step") >= step)


# --- scores --------------------------------------------------------------------------------------


def _scored(frequent: DataFrame, longest: int, scale: int) -> DataFrame:
    """Candidates with the counts of both parts of their lowest-scoring cut."""
    words = _word_columns(longest)
    parts = frequent.filter(F.col("k") < longest).select("lang", *words[:-1], "n")
    left = parts.toDF("_lang1", *[f"_l{j}" for j in range(longest - 1)], "l")
    right = parts.toDF("_lang2", *[f"_r{j}" for j in range(longest - 1)], "r")
    cuts = frequent.filter("k > 1").withColumnRenamed("n", "a")
    cuts = cuts.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    whole = F.array(*words)
    for j in range(longest - 1):
        first = F.when(F.col("_cut") > j, F.col(words[j])).otherwise(_BREAK)
        rest = F.coalesce(F.get(whole, F.col("_cut") + j), F.lit(_BREAK))
        cuts = cuts.withColumn(f"_x{j}", first).withColumn(f"_y{j}", rest)
    joined = cuts.join(
        left, [F.col("lang") == F.col("_lang1"), *[F.col(f"_x{j}") == F.col(f"_l{j}") for j in range(longest - 1)]]
    ).join(
        right, [F.col("lang") == F.col("_lang2"), *[F.col(f"_y{j}") == F.col(f"_r{j}") for j in range(longest - 1)]]
    )
    # decimals of 38 digits: the product passes 64 bits
    score = F.expr(f"(CAST(a AS DECIMAL(28, 0)) * {scale}BD) div CAST(l + r AS DECIMAL(28, 0))")
    best = joined.groupBy("lang", "k", *words, "a").agg(
        F.min(F.struct(score.alias("score"), "_cut", "l", "r")).alias("_best")
    )
    return best.select("lang", "k", *words, "a", "_best.l", "_best.r", "_best.score")


def _without_contained(scored: DataFrame, frequent: DataFrame, longest: int, percent: int) -> DataFrame:
    words = _word_columns(longest)
    inner = F.array(
        *[
            F.when(F.col("k") >= first + size + (1 if first == 0 else 0), F.struct(F.lit(first).alias("first"), F.lit(size).alias("size")))
            for size in range(2, longest)
            for first in range(longest - size + 1)
        ]
    )
    held = frequent.filter("k > 2").select("*", F.explode(F.array_compact(inner)).alias("_in"))
    whole = F.array(*words)
    for j in range(longest - 1):
        word = F.when(F.col("_in.size") > j, F.get(whole, F.col("_in.first") + j)).otherwise(_BREAK)
        held = held.withColumn(f"_h{j}", word)
    most = held.groupBy(F.col("lang").alias("_lang"), *[f"_h{j}" for j in range(longest - 1)]).agg(F.max("n").alias("_most"))
    match = [F.col("lang") == F.col("_lang"), F.col(words[-1]) == _BREAK]
    match += [F.col(words[j]) == F.col(f"_h{j}") for j in range(longest - 1)]
    covered = 100 * F.col("_most").cast("decimal(20,0)") >= percent * F.col("a").cast("decimal(20,0)")
    return scored.join(most, match, "left").filter(F.col("_most").isNull() | ~covered).select(scored.columns)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    shards: int = SHARDS,
    contained_percent: int = CONTAINED_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """The ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Words are cut at blanks and tabs inside pieces, which end at ``.,;:!?`` and line breaks; A-Z
    count as small letters. A phrase of 2 to ``longest`` words seen ``min_count`` times or more scores
    ``scale * a / (l + r)``, rounded down, at its worst cut into two parts seen l and r times, ties to
    the earliest cut. Phrases inside a longer one with ``contained_percent`` of their occurrences are
    left out. Ties in rank go to the larger ``a``, then to the phrase's UTF-8 bytes. ``n`` counts all
    words of the language.

    Counts are exact and cover all texts, whatever the number of shards. Null and empty texts have no
    words, a null language is ``und``, repeated rows count each time, an empty table gives no rows.
    Other columns are not read, so they may have any name.
    """
    frequent, totals, spelling = count_phrases(docs, text_col, lang_col, min_count, longest, shards)
    words = _word_columns(longest)
    scored = _without_contained(_scored(frequent, longest, scale), frequent, longest, contained_percent)
    spelled = scored
    known = cut_lineage(
        spelling.join(frequent.filter("k = 1").select(F.col("w1").alias("number")).distinct(), "number")
    )
    for word in words:
        names = known.select(F.col("number").alias(f"_{word}"), F.col("word").alias(f"_text_{word}"))
        spelled = spelled.join(names, F.col(word) == F.col(f"_{word}"), "left")
    phrase: Column = F.concat_ws(" ", *[f"_text_{word}" for word in words])
    named = spelled.join(totals, "lang").select(
        "lang", phrase.alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score"
    )
    # a limit per language, which Spark applies before the shuffle
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, list_filter(
  regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
tokens AS (SELECT lang, id, unnest(words) AS w1, unnest(range(len(words))) AS spot FROM numbered),
windows AS (
  SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3,
         lead(w1, 3) OVER piece AS w4
  FROM tokens WINDOW piece AS (PARTITION BY id ORDER BY spot)),
grams AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM windows GROUP BY ALL
  UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) AS p, count(*) FROM windows
  WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) AS p, count(*) FROM windows
  WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) AS p, count(*) FROM windows
  WHERE w4 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM grams
  WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut.x, x.f AS l, y.f AS r,
         CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS score
  FROM candidates c JOIN (VALUES (1), (2), (3)) AS cut(x) ON cut.x < c.k
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : cut.x], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut.x + 1 : c.k], ' ')),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) AS place
                 FROM cuts) WHERE place = 1),
inside AS (
  SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, k, words, a, s.size, unnest(range(1, k - s.size + 2)) AS i
        FROM candidates, (VALUES (2), (3)) AS s(size) WHERE s.size < k)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase
  WHERE i.most IS NULL OR 100 * i.most < 80 * w.a),
ranked AS (
  SELECT lang, phrase, a, l, r, CAST(score AS BIGINT) AS score, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT k.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM ranked k JOIN totals t ON k.lang = t.lang WHERE rank <= 2000"""
