"""Shapes of the physical plans that matter on large inputs."""

import __spark_entry__ as entry
import pytest

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["collab_recommendations", "similar", "hybrid_without_svd", "explained", "merge_scored"])
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["top_rated", "favourite_seeds", "collab_recommendations"])
def test_lists_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(spark, "user_totals")
    assert "l_comment" not in text and "l_extendedprice" not in text and "o_totalprice" not in text


def test_term_counts_shuffle_texts_not_terms(spark):
    from marquee.operators import content

    df = spark.createDataFrame([(1, "a few words here")], "id long, soup string")
    text = content.term_counts(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["collab_matrix", "user_profile"])
def test_many_rows_are_dealt_over_more_tasks(spark, monkeypatch, name):
    from marquee import session

    few = rows_of(spark, name)
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert "REPARTITION_BY_NUM" in plan(spark, name)
    assert rows_of(spark, name) == few


def rows_of(spark, name):
    return sorted(map(str, entry.queries()[name](spark, FOLDER).collect()))


def test_merged_lists_are_dealt_over_more_tasks(spark, monkeypatch):
    from marquee import session

    few = rows_of(spark, "merge_scored")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert "REPARTITION_BY_NUM" in plan(spark, "merge_scored")
    assert rows_of(spark, "merge_scored") == few
