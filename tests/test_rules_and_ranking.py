"""Rulebook, score algebra, re-rankers and recommender invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.inputs import interactions, items, training_events, users
from tidemark.operators import joins, rerank, scoring
from tidemark.operators import rulebook as R
from tidemark.plans import popularity_cf as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_confidence(spark):
    conf = lambda *v: spark.range(1).select(R.confidence(*[F.lit(x) for x in v])).first()[0]
    assert conf(10.0, 1.0, 10, 1) == 0.81
    assert conf(0.0, 0.0, 0, 0) == 0.0
    assert conf(0.0, 9.0, 0, 9) == -1.0


def test_conflicts(spark):
    act = lambda a, b: spark.range(1).select(R.conflict_action(F.lit(a), F.lit(b))).first()[0]
    assert [act(-0.1, -0.1), act(-0.1, 0.5), act(0.5, -0.5), act(0.2, 0.2)] == ["delete", "keep", "update", "update"]


def test_similar_rules_match_by_text(spark):
    cols = "rule_id string, feature string, tone string, genre string, guideline string"
    old = spark.createDataFrame([("R7", "Expand", "formal", "narrative", "add vivid detail to each scene"), ("R8", "Expand", "formal", "narrative", "keep it short")], cols)
    new = spark.createDataFrame([("expand_formal_narrative", "Expand", "formal", "narrative", "add vivid details to each scene"), ("other", "Expand", "common", "narrative", "x")], cols)
    got = R.match_rules(new, old).first()
    assert (got["rule_id"], got["old_id"], got["method"]) == ("expand_formal_narrative", "R7", "similarity") and got["similarity"] > 80


def test_initial_rules(spark):
    schema = (
        "created_at string, context_rules map<string, map<string, struct<examples: array<struct<original: string, selected: string>>, "
        "confidence: double, total_samples: int, selection_count: int, selection_rate: double, rule_id: string>>>"
    )
    data = {
        "formal_informative": {"Paraphrase": ([("a long sentence", "short")], 0.7, 9, 6, 0.66, "R001")},
        "common": {"Expand": ([("abc", "abc")], None, 4, 2, 0.5, "R002"), "Compress": (None, None, None, None, None, None)},
    }
    out = {r["rule_id"]: r for r in R.initial_rules(spark.createDataFrame([("2024", data)], schema)).collect()}
    assert out["paraphrase_formal_informative"]["guideline"] == R.SHORTER
    assert out["expand_common_general"]["guideline"] == R.PREFERENCE and out["expand_common_general"]["confidence"] == 0.6
    assert out["compress_common_general"]["guideline"] == R.NO_EXAMPLES and out["compress_common_general"]["satisfied_count"] == 0


def test_prompt_block(spark):
    cols = "rule_id string, feature string, tone string, genre string, guideline string, avoid_guidelines array<string>, confidence double"
    rules = spark.createDataFrame(
        [("a", "Expand", "formal", "narrative", "do this", ["no"], 0.9), ("b", "Expand", "formal", "narrative", "g", ["not that"], -0.2), ("c", "Expand", "formal", "dialogue", "g", [], 0.3)], cols
    )
    out = R.prompt_blocks(rules).collect()
    assert len(out) == 1 and out[0]["rule_id"] == "expand_formal_narrative"
    assert "- do this" in out[0]["prompt"] and "- not that" in out[0]["prompt"] and "- no\n" not in out[0]["prompt"]


DEMO = {"a": {1: 0.9, 2: 0.7, 3: 0.5}, "b": {1: 0.8, 2: 0.9, 3: 0.6, 4: 0.7}}


@pytest.mark.parametrize(
    "method,want",
    [
        ("weighted", {1: 0.86, 2: 0.78, 3: 0.54, 4: 0.7}),
        ("sum", {1: 0.86, 2: 0.78, 3: 0.54, 4: 0.28}),
        ("rrf", {1: 0.6 / 61 + 0.4 / 62, 2: 0.6 / 62 + 0.4 / 61, 3: 0.6 / 63 + 0.4 / 64, 4: 0.4 / 63}),
        ("borda", {1: 0.6 * 3 + 0.4 * 3, 2: 0.6 * 2 + 0.4 * 4, 3: 0.6 + 0.4, 4: 0.4 * 2}),
    ],
)
def test_blends(spark, method, want):
    frames = {n: spark.createDataFrame([(1, i, s) for i, s in d.items()], "user_id int, item_id int, score double") for n, d in DEMO.items()}
    got = {r["item_id"]: r["score"] for r in scoring.blend(frames, {"a": 0.6, "b": 0.4}, method).collect()}
    assert got == pytest.approx(want)


def test_constant_scores(spark):
    df = spark.createDataFrame([(1, i, 2.0) for i in range(3)], "user_id int, item_id int, score double")
    value = lambda m: {r["score"] for r in scoring.normalise(df, m).collect()}
    assert value("minmax") == {0.5} and value("minmax_one") == {1.0} and value("zscore") == {0.0} and value("sigmoid") == {0.5}
    assert sum(r["score"] for r in scoring.normalise(df, "softmax").collect()) == pytest.approx(1.0)


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 9, 2.0)], "user_id int, item_id int, score double")
    assert [r["item_id"] for r in scoring.top_k(df, 3).orderBy("rank").collect()] == [9, 3, 5]


def plain_mmr(score, sim, lam):
    left, out = list(range(len(score))), []
    while left:
        value = lambda i: round(lam * score[i] - (1 - lam) * max((sim[i][j] for j in out), default=0.0), 10)
        best = max(left, key=lambda i: (value(i), -i))
        out.append(best)
        left.remove(best)
    return out


def test_mmr_equals_a_plain_greedy(spark):
    rng = np.random.default_rng(0)
    data = [(u, i, float(np.round(rng.random(), 3)), f"c{rng.integers(3)}", [float(x) for x in rng.normal(size=4)] if i % 4 else None) for u in range(5) for i in range(9)]
    df = spark.createDataFrame(data, "user_id int, item_id int, score double, category string, embedding array<double>")
    got = rerank.rerank(rerank.pack(df, "category", "embedding"), "mmr", lam=0.6).toPandas()
    for u in range(5):
        mine = sorted([d for d in data if d[0] == u], key=lambda d: (-d[2], d[1]))
        cos = lambda a, b: max(0.0, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))
        sim = [[cos(a[4], b[4]) if a[4] and b[4] else float(a[3] == b[3]) for b in mine] for a in mine]
        want = [mine[i][1] for i in plain_mmr([m[2] for m in mine], sim, 0.6)]
        assert list(got[got["user_id"] == u].sort_values("place")["item_id"]) == want


def test_category_gap(spark):
    data = [(1, i, 1.0 - i / 10, c) for i, c in enumerate("aabab")]
    df = spark.createDataFrame(data, "user_id int, item_id int, score double, category string")
    out = rerank.rerank(rerank.pack(df, "category"), "category_gap", limit=4).orderBy("place")
    assert [r["item_id"] for r in out.collect()] == [0, 2, 3, 4]


def test_few_unseen_items(spark):
    ev = [(u, i, f"2024-01-{d:02d} 00:00:00") for u in (1, 2, 3) for i in range(8) for d in (1, 2) if not (u == 1 and i >= 6)]
    df = spark.createDataFrame(ev, "user_id int, item_id int, t string").select("user_id", "item_id", F.to_timestamp("t").alias("event_time"))
    out = P.recommend(P.fit(df, 1, 1), k=5)
    assert sorted(r["item_id"] for r in out.filter("user_id = 1").collect()) == [6, 7]
    assert out.filter("user_id <> 1").count() == 0


def test_ranks_are_dense_and_unseen(spark, sf):
    ev = training_events(spark, sf)
    model = P.fit(ev)
    out = P.recommend(model, k=10).cache()
    assert out.join(ev.select("user_id", "item_id").distinct(), ["user_id", "item_id"]).count() == 0
    gaps = out.groupBy("user_id").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d"), F.count(F.lit(1)).alias("n"))
    assert gaps.filter("m <> d OR d <> n").count() == 0


def test_spread_order_equals_a_plain_greedy(spark, sf):
    model = P.fit(training_events(spark, sf))
    out = P.recommend(model, k=8).toPandas()
    sims = {(r["item_a"], r["item_b"]): r["sim"] for r in model.item_sims.collect()}
    for _, mine in out.groupby("user_id"):
        cand = mine.assign(o=-mine["score"].round(10)).sort_values(["o", "item_id"])
        ids, score = list(cand["item_id"]), list(cand["score"])
        chosen, left = [0], list(range(1, len(ids)))
        while left:
            value = lambda i: round(0.3 * score[i] + 0.7 * (1 - np.mean([sims.get((ids[i], ids[j]), 0.0) for j in chosen])), 10)
            best = max(left, key=lambda i: (value(i), -i))
            chosen.append(best)
            left.remove(best)
        want = [ids[i] for i in chosen] if len(ids) > 3 else ids
        assert list(mine.sort_values("rank")["item_id"]) == want


def test_candidates_are_unseen(spark, sf):
    seen = interactions(spark, sf)
    got = joins.candidates(users(spark, sf), items(spark, sf), seen, 5)
    assert got.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count() == 0
    assert got.groupBy("user_id").count().filter("count <> 5").count() == 0


def test_short_lists_are_ordered_by_all_tasks(spark):
    from tidemark.operators import rerank

    rows = [(u, i, float(i % 7), "a" if i % 2 else "b") for u in range(40) for i in range(6)]
    cands = spark.createDataFrame(rows, "user_id long, item_id long, score double, category string")
    packed = rerank.pack(cands, "category")
    # Small lists are not merged into few tasks ahead of the ordering, which takes the time.
    assert packed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rerank.rerank(packed, "category_gap").collect()
    assert len(out) == 240 and {r["place"] for r in out if r["user_id"] == 3} == set(range(1, 7))
