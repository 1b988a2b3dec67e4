"""Properties of the physical plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from songloom import workloads
from songloom.operators import catalog_stats, search
from songloom.plans import cooccurrence

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# model.transform() of the library is all that predict_pairs and training_report run
QUERIES = sorted(contract.queries())


def plan(df) -> str:
    explain = df.sparkSession._jvm.PythonSQLUtils.explainString
    return explain(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_row_by_row_python(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    assert [word for word in FORBIDDEN if word in text] == []


def test_title_search_reaches_the_scan(spark, sf_dir):
    text = plan(search.find_songs(workloads.songs(spark, sf_dir), "ring").select("song_id"))
    assert "StringContains(p_name,ring)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_charts_read_one_column(spark, sf_dir):
    text = plan(catalog_stats.songs_per_artist(workloads.songs(spark, sf_dir)))
    assert "ReadSchema: struct<p_brand:string>" in text
    assert text.count("Exchange hashpartitioning") <= 2  # once in the tree, once in the details


def test_top_candidates_are_cut_before_the_shuffle(spark, sf_dir):
    text = plan(cooccurrence.item_cooccurrence(workloads.triplets(spark, sf_dir), 5))
    assert text.count("WindowGroupLimit") >= 2


def test_text_is_not_shuffled_by_spam_rules(spark, sf_dir):
    from songloom.plans import reviews

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # texts were reduced and stored beforehand; what is joined and shuffled holds none of them
    text = plan(reviews.flag_spam(docs))
    assert "digest" in text and "text#" not in text and "documents.parquet" not in text


def test_interactions_keep_only_needed_columns(spark, sf_dir):
    text = plan(workloads.triplets(spark, sf_dir).groupBy("song_id").agg(F.count("*")))
    assert "l_extendedprice" not in text and "o_totalprice" not in text
