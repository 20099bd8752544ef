"""Context matches of events are worked out once per item and kind of moment."""

import math

from pyspark.sql import functions as F

from tidemark.catalog import load_all
from tidemark.functions import device as dev
from tidemark.functions import vectors
from tidemark.inputs import interactions, items


def test_equal_to_a_match_per_event(spark, sf):
    rows = interactions(spark, sf).join(items(spark, sf).select("item_id", "embedding"), "item_id")
    kind, ts = dev.device_type(F.col("os")), F.col("event_time")
    short = F.array_join(F.transform(vectors.short_context_vector(ts, kind), lambda x: F.round(x, 4)), ",")
    fused = vectors.fuse(F.col("embedding"), vectors.long_context_vector(ts, kind))
    direct = rows.select("id", short.alias("s"), "embedding", fused.alias("f")).toPandas()
    match = vectors._cosine_rows(direct["embedding"], direct["f"])
    want = sorted(zip(direct["id"], direct["s"], match))
    got = sorted(map(tuple, load_all()[0]["event_context_vectors"](spark, sf).collect()))
    assert [(i, s) for i, s, _ in got] == [(i, s) for i, s, _ in want]
    assert all((m is None and math.isnan(w)) or abs(m - w) < 1e-5 for (_, _, m), (_, _, w) in zip(got, want))


def test_vectors_do_not_travel_with_events(spark, sf):
    plan = load_all()[0]["event_context_vectors"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # matches were worked out before, on distinct items and kinds
