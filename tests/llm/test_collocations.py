"""Phrase collocations against a plain program and the SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from songloom.llm import collocations
from tests.llm.odd import SCHEMA, no_docs, odd_docs
from tests.oracle import connect, differences

LOWER = {code: code + 32 for code in range(65, 91)}


def _plain(rows, min_count: int, longest: int, top: int, percent: int = 80) -> list[tuple]:
    """Every phrase of every piece counted in a dictionary."""
    counts: dict = defaultdict(Counter)
    total: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {phrase: a for phrase, a in f.items() if len(phrase) > 1 and a >= min_count}
        covered = set()
        for phrase, n in found.items():
            for size in range(2, len(phrase)):
                for first in range(len(phrase) - size + 1):
                    part = phrase[first : first + size]
                    if 100 * n >= percent * f[part]:
                        covered.add(part)
        ranked = []
        for phrase, a in found.items():
            if phrase not in covered:
                cuts = [(2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _found(docs, **more) -> list[tuple]:
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(row[c] for c in columns) for row in collocations.collocations(docs, **more).collect())


def _rows(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    words = ["Of", "the", "a\x00b", "grosse", "Größe", " x", "y", "z", "|", "é", "\U0001f600"]
    phrases = [" ".join(draw.choices(words, k=draw.randint(2, 6))) for _ in range(15)]
    rows = []
    for i in range(n):
        parts = [draw.choice(phrases) if draw.random() < 0.5 else draw.choice(words) for _ in range(draw.randint(0, 30))]
        text = "".join(part + draw.choice([" ", " ", "\t", ". ", "\n", " ,", "  "]) for part in parts)
        rows.append((text if i % 17 else None, draw.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("shards", "longest", "min_count"), [(4, 4, 30), (2, 3, 5)])
def test_equals_plain_counting(spark, shards, longest, min_count):
    rows = _rows(shards, 200)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = _found(docs, shards=shards, longest=longest, min_count=min_count, top=40)
    assert found == _plain(rows, min_count, longest, 40) and found


def test_counts_do_not_depend_on_the_filter(spark, monkeypatch):
    """A filter that says yes to nearly everything costs work, not exactness."""
    rows = _rows(9, 100)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "_filter_of", lambda *_: collocations.np.full(4, -1, collocations.np.int64).view(collocations.np.uint64))
    assert _found(docs, min_count=6, top=100, shards=3) == _plain(rows, 6, 4, 100)


def test_equals_sql(spark, sf_dir):
    result = collocations.op13_collocations(spark, sf_dir)
    assert differences(result, collocations.OP13_SQL, connect(sf_dir)) == []


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(row.text, row.lang) for row in docs.collect()]
    assert _found(docs, min_count=3, shards=2) == _plain(rows, 3, 4, 2000)
    assert _found(no_docs(spark)) == []
    none = spark.createDataFrame([(1, None, None, "s", 0, 0.5, "n", "s", "w"), (2, ",", "en", "s", 0, 0.5, "n", "s", "w")], SCHEMA)
    assert _found(none, min_count=1) == []


def test_slices_and_collisions():
    texts = pa.array(["x", "One two, three", None, "", "a\tb  c!d\r\ne", "two"])
    whole, sizes, spelled, numbers = collocations._encode(texts, 1)
    later, later_sizes, _, _ = collocations._encode(texts.slice(4), 1)
    assert sizes.tolist() == [1, 4, 0, 0, 8, 1]
    assert later.tolist() == whole[5:].tolist() and later_sizes.tolist() == [8, 1]
    spell = dict(zip(numbers.tolist(), spelled.tolist()))
    assert [spell.get(x, "/") for x in whole.tolist()] == "x one two / three a b c / d / / e two".split()


def test_two_words_with_one_number(spark):
    """A numbering that gives two words one number is found and replaced, or refused."""
    docs = spark.createDataFrame([(" ".join(map(str, range(12))), "en")], "text string, lang string")
    _, spelling = collocations._encoded(docs, "text", "lang", 2, bits=6)
    assert spelling.count() == spelling.select("number").distinct().count() == 12
    with pytest.raises(RuntimeError):
        collocations._encoded(docs, "text", "lang", 2, bits=2)
