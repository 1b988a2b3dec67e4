"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

from songloom.llm import (
    bloom_lm,
    decontaminate,
    host_rules,
    line_dedup,
    mixing,
    near_join,
    token_files,
    toxicity,
    url_templates,
    weak_labels,
)
from songloom.storage import scratch_path
from tests.llm.odd import no_docs, odd_docs, odd_rows, prose

ROWS = len(odd_rows())


def _benchmark(spark):
    rows = [(1, prose(3, 30)), (2, "one"), (3, None), (None, prose(4, 60)), (4, ""), (1, prose(3, 30))]
    return spark.createDataFrame(rows, "item_id long, text string")


def _labels(spark):
    rows = [(5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module", params=["odd", "none"])
def docs(request, spark):
    return (odd_docs if request.param == "odd" else no_docs)(spark).cache()


def _expected(docs):
    return docs.count()


def test_classifier(docs):
    rows = weak_labels.classify(docs).collect()
    assert len(rows) == _expected(docs)
    assert all(0 <= row.score <= 1 for row in rows)


def test_host_rules(docs):
    rows = host_rules.judge_documents(docs).collect()
    assert len(rows) == _expected(docs)
    assert all(row.base_failed for row in rows if row.doc_id in (1, 2, 3, 4))
    assert {row.n_words for row in rows if row.doc_id in (1, 2, 3)} <= {0}


def test_near_join(docs):
    rows = near_join.near_groups(docs).collect()
    assert len(rows) == _expected(docs)
    by_id = {row.doc_id: row for row in rows if row.doc_id is not None}
    if rows:
        assert by_id[7].class_id == 5 and by_id[7].n_copies == 3 and by_id[7].n_links == 0
        assert by_id[1].class_id == 1 and by_id[2].class_id == 2
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(row.doc_id for row in kept.collect() if row.doc_id is not None)
    assert ids == ([1, 2, 3, 4, 5, 6, 8, 9, 10] if rows else [])


def test_lm(docs):
    rows = bloom_lm.score_corpus(docs, docs.filter("doc_id <> 6")).collect()
    assert len(rows) == _expected(docs)
    assert all(row.score <= 0 and row.base_score <= 0 for row in rows)
    assert {row.n_tokens for row in rows if row.doc_id in (1, 2, 3)} <= {1}


def test_lm_without_training(spark):
    rows = bloom_lm.score_corpus(odd_docs(spark), no_docs(spark)).collect()
    assert len(rows) == ROWS and all(row.n_known == 0 and row.train_tokens == 0 for row in rows)


def test_toxicity(docs, spark):
    lexicon = toxicity.learn_lexicon(docs, _labels(spark))
    rows = toxicity.score_toxicity(docs, lexicon).collect()
    assert len(rows) == _expected(docs)
    kept = toxicity.reject_toxic(docs, _labels(spark))
    assert kept.columns == docs.columns
    assert {row.node for row in kept.collect()} <= {"n"}


def test_mixing(docs):
    mix = mixing.mix_sources(docs, block_words=16, shard_blocks=8)
    rows = mix.rows.collect()
    assert len(rows) == _expected(docs)
    taken: dict = {}
    for piece in mix.segments.collect():
        taken[piece.row] = taken.get(piece.row, 0) + piece.n_words
    by_source: dict = {}
    for row in rows:
        assert taken.get(row.row, 0) <= 2 * row.size
        key = row.source, row.target
        by_source[key] = by_source.get(key, 0) + taken.get(row.row, 0)
    assert all(abs(words - target) <= 0.5 for (_, target), words in by_source.items())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert all(row.text for row in mixed.collect())


def test_token_files(docs, spark):
    files = token_files.write_tokens(
        docs, scratch_path(spark, "tokens"), token_files.default_tokenizer(), frame_ids=500
    )
    rows = token_files.read_tokens(files).orderBy("start").collect()
    assert len(rows) == _expected(docs)
    place = 0
    for row in rows:
        assert row.start == place and row.n_tokens == len(row.ids) and row.ids[-1] == 2
        place += row.n_tokens
    ids = [row.doc_id for row in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert all(row.n_tokens == 1 for row in rows if row.doc_id in (1, 2))
    some = token_files.read_tokens(files, [6, 9, 77]).collect()
    assert sorted(row.doc_id for row in some) == ([6, 9] if rows else [])


def test_line_dedup(docs):
    cleaned = line_dedup.dedup_lines(docs)
    rows = cleaned.collect()
    assert len(rows) == _expected(docs)
    by_id = {row.doc_id: row for row in rows if row.doc_id is not None}
    if rows:
        assert by_id[9].n_removed == 0 and by_id[10].n_removed == 1
        assert by_id[10].text == prose(6, 60)
        assert by_id[7].n_removed == 1 and by_id[7].text == ""  # the line of 5
        assert by_id[5].n_removed == 0 and by_id[1].text is None


def test_decontamination(docs, spark):
    found = decontaminate.find_benchmark(docs, _benchmark(spark), keep=["doc_id", "n_words"])
    rows = found.collect()
    assert len(rows) == _expected(docs)
    if rows:
        by_id = {row.doc_id: row for row in rows}
        assert by_id[4]["items"] == ["2"] and by_id[None] is not None
    in_blocks = decontaminate.find_benchmark(docs, _benchmark(spark), block_words=1)
    both = lambda df: sorted((repr(r.doc_id), repr(r["items"]), repr(r.spans)) for r in df.collect())
    assert both(in_blocks) == both(found)
    clean = decontaminate.drop_contaminated(docs, _benchmark(spark))
    assert clean.columns == docs.columns and clean.count() <= len(rows)
    empty = decontaminate.find_benchmark(docs, _benchmark(spark).limit(0))
    assert empty.filter("size(spans) > 0").count() == 0


def test_url_filters(spark):
    urls = [
        (1, "http://A.Example.com/en/x?y", "example.com/en/", "block"),
        (2, "https://www.example.com/en/1#/z", "www.example.com/en/", "allow"),
        (3, "http://other.com", None, "allow"),  # no path, so no rule
        (4, "http://other.com/", "com/", "allow"),
        (5, "http://x.net/fr/1", "net/fr/", "block"),
        (6, "http://xnet/fr/1", None, "allow"),
        (7, None, None, "allow"),
        (8, "no scheme/com/", None, "allow"),
        (8, "no scheme/com/", None, "allow"),
        (9, "http://h.org/a/b/c/d/e/f/g", None, "allow"),
        (None, "http://h.org/" + "s/" * 5000, None, "allow"),
    ]
    pages = spark.createDataFrame([x[:2] for x in urls], "page_id long, url string")
    rows = url_templates.judge_urls(pages, _labels(spark).limit(0)).collect()
    expected = sorted(((x[0], x[2], x[3]) for x in urls), key=repr)
    assert sorted(((r.page_id, r.rule, r.verdict) for r in rows), key=repr) == expected
    assert url_templates.judge_urls(pages.limit(0), _labels(spark)).count() == 0
