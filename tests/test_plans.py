"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.inputs import interactions, items, users
from tidemark.operators import activity, cf, entity_features, joins, oplog, sessions
from tidemark.inputs import load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(activity.hourly_activity(interactions(spark, sf)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "event_type" not in schema


def test_lists_are_cut_before_the_shuffle(spark, sf):
    for df in (
        activity.recent_events(interactions(spark, sf)),
        activity.early_runs(interactions(spark, sf)),
        oplog.recent_performance(load(spark, sf, "oplog")),
    ):
        assert "Partial" in re.search(r"WindowGroupLimit.*", plan(df)).group(0) or plan(df).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    "build",
    [
        lambda s, d: activity.kpi_summary(interactions(s, d), users(s, d)),
        lambda s, d: entity_features.user_features(interactions(s, d)),
        lambda s, d: sessions.session_features(interactions(s, d)),
        lambda s, d: cf.item_similarity(cf.interaction_weights(interactions(s, d))),
        lambda s, d: joins.similar_by_attribute(items(s, d), interactions(s, d)),
        lambda s, d: joins.candidates(users(s, d), items(s, d), interactions(s, d), 5),
    ],
)
def test_no_cross_products(spark, sf, build):
    text = plan(build(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_windows_share_one_sort(spark, sf):
    rows = sessions.sessionise(interactions(spark, sf).select("user_id", "id", "event_time"))
    assert plan(rows).count("Exchange hashpartitioning") == 1


def test_group_sums_combine_before_the_shuffle(spark, sf):
    text = plan(interactions(spark, sf).groupBy("user_id").agg(F.count(F.lit(1))))
    assert text.count("HashAggregate") == 2


def test_scored_rows_stay_in_place(spark, sf):
    """All parts of the scores are laid out by user; neither the sums nor the ranking shuffle them again."""
    from tidemark.inputs import training_events
    from tidemark.operators import scoring
    from tidemark.plans import popularity_cf

    model = popularity_cf.fit(training_events(spark, sf))
    scores = popularity_cf.component_scores(model, 10).withColumnRenamed("item_cf", "score")
    text = plan(scoring.top_k(scores, 10))
    assert not re.search(r"Exchange hashpartitioning\(user_id#\w+, item_id", text)
    assert not re.search(r"Exchange", text.split("Union")[0])
