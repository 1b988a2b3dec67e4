"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import lower_ascii, map_texts, plain_names, table

WINDOW = 10
#: Words of benchmark text searched for in one pass; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


_FOUND = {
    "n_words": ("long", pa.int64()),
    "spans": (
        "array<struct<first:int,last:int>>",
        pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
    ),
    "items": ("array<string>", pa.list_(pa.string())),
}


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, and of all non-ASCII characters, after lower-casing A-Z."""
    return [] if text is None else _WORDS.findall(lower_ascii(text))


class WuManber:
    """Finds all occurrences of equally long word patterns.

    A block is two neighbouring words (one if the patterns are single words). ``shift`` says how
    far the search may move when a block ends at the current word; blocks that end a pattern
    (shift 0) lead to the bucket of patterns with that suffix, which are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[str, ...], set[str]]):
        self.length = length = len(next(iter(patterns)))
        self.block = block = min(2, length)
        self.farthest = length - block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[tuple[str, ...], set[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.farthest), length - end)
            self.bucket.setdefault(pattern[-block:], []).append((pattern, items))

    def search(self, words: list[str]) -> Iterator[tuple[int, set[str]]]:
        """First word and items of every occurrence."""
        length, block, shift, farthest = self.length, self.block, self.shift, self.farthest
        end, size = length, len(words)
        while end <= size:
            key = tuple(words[end - block : end])
            step = shift.get(key, farthest)
            if step:
                end += step
                continue
            found = tuple(words[end - length : end])
            for pattern, items in self.bucket[key]:
                if pattern == found:
                    yield end - length, items
            end += 1


def searchers(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per pattern length: ``window`` words, or all words of a shorter item."""
    by_length: dict[int, dict[tuple[str, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for first in range(len(words) - size + 1 if size else 0):
            pattern = tuple(words[first : first + size])
            by_length.setdefault(size, {}).setdefault(pattern, set()).add(item)
    return [WuManber(patterns) for patterns in by_length.values()]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Item lists of at most ``block_words`` words (or one item), one after the other."""
    block, size = [], 0
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("body")
    )
    for row in rows.toLocalIterator():
        weight = len(row.body) // 2 + 1
        if block and size + weight > block_words:
            yield block
            block, size = [], 0
        block.append((row.item, row.body))
        size += weight
    yield block


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Where documents contain ``window`` consecutive words of a benchmark item.

    One row per row of ``docs``: the columns in ``keep`` (default: the id), then ``n_words``,
    ``spans`` (merged runs of hit words, first and end) and ``items`` (ids as text, sorted).
    Benchmark items are read in blocks of at most ``block_words`` words; each block is one pass
    over the documents with a broadcast of that bounded size. There is no shuffle.

    A null or empty text has no words and no hits. Repeated documents give one row each, repeated
    items count once, items without words match nothing, an empty benchmark gives documents without
    hits. Words of an item with a null id are hit like others, but there is no id to list. Columns of ``docs`` not in ``keep`` are not read, and kept columns with
    the name of a result give way to it.
    """
    keep = [name for name in keep or [id_col] if name not in _FOUND]
    send = docs.sparkSession.sparkContext.broadcast
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_words)
    block, after = next(blocks), next(blocks, None)
    # with more passes to come the text and what has been found are carried along
    body = docs[text_col].cast("string").alias("_text")
    found = docs.select(*[docs[name] for name in keep], body)
    found = _scan(found, keep if after is None else [*keep, "_text"], send(block), window)
    while after is not None:
        block, after = after, next(blocks, None)
        held = found.withColumnsRenamed({"spans": "_spans", "items": "_items"}).drop("n_words")
        carried = [*keep, "_spans", "_items", *(["_text"] if after is not None else [])]
        found = _scan(held, carried, send(block), window)
        found = found.withColumn("spans", _merged_column(F.concat("_spans", "spans"))).withColumn(
            "items", F.array_sort(F.array_union("_items", "items"))
        ).drop("_spans", "_items")
    return found.select(*keep, *_FOUND)


def _scan(docs: DataFrame, keep: list[str], sent, window: int) -> DataFrame:
    def make():
        search = searchers(sent.value, window)

        def run(texts: list[str | None]) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for text in texts:
                words = words_of(text)
                spans, items = [], set()
                for one in search:
                    for first, found in one.search(words):
                        spans.append((first, first + one.length))
                        items |= found
                out[0].append(len(words))
                out[1].append([{"first": a, "last": b} for a, b in _merge(spans)])
                out[2].append(sorted(items - {None}))
            return list(out)

        return run

    return map_texts(docs, "_text", keep, make, _FOUND)


def _merged_column(spans):
    """The runs of ``spans`` with overlapping and touching ones joined."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["first"].alias("first"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["last"], x["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no ``WINDOW`` words of an item, with all their columns.

    Null and empty texts stay; repeated rows stay or go alike; an empty benchmark rejects nothing.
    Columns of ``docs`` may have any name.
    """
    plain, place = plain_names(docs)
    key = place[text_col]
    found = find_benchmark(plain, benchmark, key, key, keep=plain.columns)
    return found.filter("size(spans) = 0").select(*plain.columns).toDF(*docs.columns)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, over the whole benchmark."""
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item, least(10, len(w)) AS size,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size)),
hits AS (SELECT k, i, p.size, item FROM grams g JOIN patterns p ON g.size = p.size AND g.gram = p.gram),
hit_words AS (SELECT k, count(DISTINCT x) AS n_hit
              FROM (SELECT k, unnest(range(i, i + size)) AS x FROM hits) GROUP BY k),
hit_items AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
              FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
"""
