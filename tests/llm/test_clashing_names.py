"""Columns called like the operators' own, repeated and missing ids, and the pipeline on odd tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from songloom.llm import decontaminate, line_dedup, mixing, near_join, toxicity
from tests.llm.odd import no_docs, odd_docs, prose

CLASHES = ["_key", "_text_key", "_id", "_turn", "_lines", "_runs", "_left", "text_key", "class_key", "size", "node"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["\n".join([prose(1, 60), prose(k, 60)]) for k in range(2, 6)] + [None, "", "one"]
    rows = [(k, text, "s", *[f"{name}{k}" for name in CLASHES]) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in CLASHES)}")


def _own(rows) -> bool:
    return all(row[name] == f"{name}{row.doc_id}" for row in rows for name in CLASHES)


def test_clashing_names(spark, clashing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, prose(3, 60))], "item_id long, text string")
    for result, n_rows in (
        (line_dedup.dedup_lines(clashing), 7),
        (near_join.keep_one(clashing), 7),
        (toxicity.reject_toxic(clashing, labels), 7),
        (decontaminate.drop_contaminated(clashing, benchmark), 6),
    ):
        rows = result.collect()
        assert len(rows) == n_rows and _own(rows)
        assert [c for c in result.columns if c not in ("n_lines", "n_removed")] == clashing.columns
    mixed = mixing.mix_documents(clashing)
    assert mixed.columns == clashing.columns and _own(mixed.collect())
    renamed = clashing.withColumnsRenamed({"doc_id": "key", "text": "body", "source": "from"})
    other = mixing.mix_documents(renamed, id_col="key", text_col="body", source_col="from")
    assert sorted(r.key for r in other.collect()) == sorted(r.doc_id for r in mixed.collect())


def test_hits_of_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "x " + prose(3, 20) + " y"), (2, prose(5, 20))], "doc_id long, text string")
    items = spark.createDataFrame([(None, prose(3, 20)), (7, prose(3, 10))], "item_id long, text string")
    found = {row.doc_id: row for row in decontaminate.find_benchmark(docs, items).collect()}
    assert [tuple(span) for span in found[1].spans] == [(1, 21)] and found[1].items == ["7"]
    assert not found[2].spans and not found[2].items


def test_classes_do_not_depend_on_ids(spark):
    near = prose(1, 200)
    rows = [(5, prose(2, 80)), (5, prose(3, 80)), (None, near), (None, f"{near} end"), (5, prose(2, 80)), (6, f"{prose(3, 80)} x"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((str(row.doc_id), row.text or "") for row in near_join.keep_one(docs).collect())
    longer = [text for key, text in kept if key == "None" and text]
    assert len(longer) == 1 and longer[0].startswith(near)
    assert [x for x in kept if x[0] != "None"] == sorted([("5", ""), ("5", prose(2, 80)), ("5", prose(3, 80))])
    assert ("None", "") in kept


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_pipeline_on_odd_tables(spark, tmp_path, make):
    docs = make(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(None, prose(3, 30)), (1, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {row.doc_id for row in rows}
    assert ids <= {r.doc_id for r in docs.collect()} and (not rows or 6 in ids)
