"""The physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from vitrine.fixtures import table, view
from vitrine.operators import drops, facets, history, pipeline_status, tables, trending
from vitrine.operators import vector_search as vs
from vitrine.operators.ordinals import with_ordinals, with_running_total
from vitrine.queries import trending as logged


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def docs(spark, data):
    return view(spark, data, "products")


def test_filters_and_columns_reach_the_scan(spark, tmp_path_factory, docs):
    folder = str(tmp_path_factory.mktemp("stored"))
    docs.write.mode("overwrite").parquet(folder)
    stored = spark.read.parquet(folder)
    requests = stored.select(F.col("id").alias("request_id"), "vector")
    found = vs.vector_top_k(drops.in_window(stored, 5, 10).filter("category = 'cat1'"), requests)
    text = formatted(found)
    assert "GreaterThan(upserted_at,5)" in text and "LessThanOrEqual(upserted_at,10)" in text
    assert "EqualTo(category,cat1)" in text
    read = re.findall(r"ReadSchema: struct<(.*)>", text)[0]
    assert set(re.findall(r"(\w+):", read.replace("array<float>", "float"))) == {
        "id", "vector", "category", "upserted_at",
    }


def test_top_k_is_cut_before_the_shuffle(docs):
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    text = plan(vs.vector_top_k(docs, requests))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_block_form_has_no_product_join(docs):
    requests = docs.select(F.col("id").alias("request_id"), "vector")
    text = plan(vs.vector_top_k(docs, requests, broadcast_limit=0))
    assert "FlatMapCoGroupsInArrow" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("build", [
    lambda df: with_ordinals(df, ["id"]),
    lambda df: with_running_total(df, ["id"], "upserted_at"),
])
def test_ordinals_use_no_single_partition(docs, build):
    assert "SinglePartition" not in plan(build(docs.select("id", "upserted_at")))


def test_membership_is_an_equi_join(spark, data, docs):
    marks = view(spark, data, "checkpoints")
    text = plan(drops.drop_membership(docs, marks))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text
    text = plan(drops.drop_membership(docs, marks, broadcast_limit=0))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_counts_are_combined_before_the_shuffle(spark, data, docs):
    stages = view(spark, data, "stage_events")
    for df in (
        facets.facet_counts(docs, ["category", "title"]),
        pipeline_status.stage_counts(stages),
        history.recent_views(view(spark, data, "user_views")),
        trending.search_groups(trending.keyed_searches(logged.searches(spark, data))),
    ):
        assert "partial_" in plan(df)


def test_per_user_ranking_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(history.recent_views(view(spark, data, "user_views")))


def test_page_is_a_top_n(docs):
    text = plan(drops.browse_page(docs, (0, 10**15), 5))
    assert "TakeOrderedAndProject" in text


def test_narrow_reads(spark, data):
    """The trending log scan leaves out what it does not use."""
    groups = trending.search_groups(trending.keyed_searches(logged.searches(spark, data)))
    columns = re.findall(r"ReadSchema: struct<(.*?)>", formatted(groups))
    assert not any("value:double" in c for c in columns)
    assert not any("p_retailprice" in c for c in columns)


def test_anti_join_reads_only_keys(spark, data):
    docs = view(spark, data, "products").select("id", "title")
    known = table(spark, data, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    text = formatted(tables.skip_existing(docs, known))
    assert "LeftAnti" in text
    assert "text:string" not in text


def test_words_of_texts_are_not_sorted_for_a_few_tokens(spark):
    """The join on text runs sorted all words of all texts, a frequent one in one task."""
    from vitrine.operators.inverted import token_hits

    texts = spark.createDataFrame(
        [("a", "red lamp", "lamp"), ("b", "lamps", "x"), ("c", "desk", None)], "id string, low_text string, label string"
    )
    wanted = spark.createDataFrame([("lamp",), ("esk",)], "token string")
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        found = token_hits(texts, wanted, category="label")
        text = plan(found)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "SortAggregate" not in text
        got = sorted((r["token"], r["id"], bool(r["is_category"])) for r in found.collect())
        assert got == [("esk", "c", False), ("lamp", "a", True), ("lamp", "b", False)]
    finally:
        spark.conf.set(name, before)


def test_words_without_a_token_are_dropped_first(spark, monkeypatch):
    """All words of all texts were shuffled; with many tokens they still are, for the same hits."""
    from vitrine.operators import inverted

    texts = spark.createDataFrame([("a", "red lamp oak"), ("b", "lamps"), ("c", "desk top")], "id string, low_text string")
    wanted = spark.createDataFrame([("lamp",), ("am",), ("esk",)], "token string")
    runs = texts.select(F.explode(inverted.with_a_token(F.split("low_text", " "), wanted)).alias("run"))
    assert sorted(r["run"] for r in runs.collect()) == ["desk", "lamp", "lamps"]
    found = sorted((r["token"], r["id"]) for r in inverted.token_hits(texts, wanted).collect())
    assert found == [("am", "a"), ("am", "b"), ("esk", "c"), ("lamp", "a"), ("lamp", "b")]
    monkeypatch.setattr(inverted, "FEW_TOKENS", 1)
    assert sorted((r["token"], r["id"]) for r in inverted.token_hits(texts, wanted).collect()) == found
