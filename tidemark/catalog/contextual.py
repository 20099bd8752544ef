"""Queries of the context and time aware recommenders, layout slots and evaluation."""

from pyspark.sql import functions as F

from tidemark.catalog.features import ITEM_BASE
from tidemark.catalog.recommend import HYBRID, ITEM_CF, ITEM_TOP, PAIRS, USER_CF, USER_TOP, WEIGHTED, decayed_sql, greedy_sql
from tidemark.catalog.registry import query
from tidemark.functions.stage import stage
from tidemark.inputs import interactions, items, load, training_events, users
from tidemark.operators import cf, evaluate
from tidemark.operators import entity_features as E
from tidemark.plans import contextual as C
from tidemark.plans import popularity_cf as P

MOMENT = C.Moment("2024-01-31 10:00:00", "Windows 11")  # a Wednesday morning at work


def item_features(spark, d):
    return stage(E.item_features(interactions(spark, d)), "item-features")


def parts(spark, d):
    """Staged personal and catalogue scores."""
    w = stage(cf.interaction_weights(interactions(spark, d), "weighted"), "weights")
    it = items(spark, d)
    active = it.filter("is_active").select("item_id")
    user_cf = cf.unseen(cf.user_cf_scores(stage(cf.user_neighbours(w, 20), "neighbours"), w), w)
    item_cf = cf.unseen(cf.item_cf_scores(w, C.item_cf_neighbours(w)), w)
    personal = stage(C.personal_scores(user_cf, item_cf, active), "personal")
    return personal, C.catalogue_scores(it, item_features(spark, d), MOMENT)


# One-hot context vector at the fixed moment: morning, business hours, desktop; unit length.
CTX9 = "[0.0, 1/sqrt(3), 0.0, 0.0, 0.0, 1/sqrt(3), 0.0, 1/sqrt(3), 0.0]"
SCORES = f"""{WEIGHTED}, {USER_TOP.format('ww')}, {USER_CF}, {ITEM_TOP}, {ITEM_CF}, {ITEM_BASE},
act AS (SELECT * FROM items WHERE is_active),
un_ AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s
  FROM ucf SEMI JOIN act USING (item_id) WINDOW w AS (PARTITION BY user_id)),
in_ AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s
  FROM icf SEMI JOIN act USING (item_id) WINDOW w AS (PARTITION BY user_id)),
rr AS (SELECT item_id, 0.6 * n7 / total_events + 0.4 / (1 + idle) AS r FROM b),
rn AS (SELECT item_id, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) AS r FROM rr),
cx AS (SELECT item_id, CASE WHEN embedding IS NULL THEN 0.5 + CASE WHEN is_premium THEN 0.1 ELSE 0 END
  ELSE least(1, greatest(0, (list_cosine_similarity(CAST(embedding[1:9] AS DOUBLE[]), CAST({CTX9} AS DOUBLE[])) + 1) / 2)) END AS c FROM act),
cn AS (SELECT item_id, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS c FROM cx),
gg AS (SELECT cn.item_id, 0.2 * c + 0.2 * coalesce(r, 0) AS g FROM cn LEFT JOIN rn USING (item_id)),
bs AS (SELECT u.user_id, gg.item_id, g + 0.3 * coalesce(a.s, 0) + 0.3 * coalesce(i.s, 0) AS score FROM users u CROSS JOIN gg
  LEFT JOIN un_ a ON a.user_id = u.user_id AND a.item_id = gg.item_id LEFT JOIN in_ i ON i.user_id = u.user_id AND i.item_id = gg.item_id)"""


@query("recommend_hybrid", f"""WITH {SCORES}
SELECT user_id, item_id, round(score, 5) AS score FROM bs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) <= 10""")
def _(spark, d):
    personal, catalogue = parts(spark, d)
    return C.hybrid(users(spark, d), personal, catalogue, 10).select("user_id", "item_id", F.round("score", 5).alias("score"))


# Greedy order with similarities in [-1, 1]; the largest one to what is placed counts, negative ones moved to [0, 0.5].
SIGNED = "list_max([b.sv[p] FOR p IN g.chosen])"
SIGNED_VALUE = f"0.5 * b.score - 0.5 * CASE WHEN {SIGNED} < 0 THEN ({SIGNED} + 1) / 2 ELSE {SIGNED} END"


@query("recommend_hybrid_diversified", f"""WITH RECURSIVE {SCORES},
t AS (SELECT c.user_id, c.item_id, c.score, i.category, CAST(i.embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY user_id ORDER BY round(c.score, 10) DESC, item_id) AS pos
  FROM (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) <= 10) c JOIN items i USING (item_id)),
bl AS (SELECT a.user_id, a.pos, any_value(a.score) AS score, list(CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN list_cosine_similarity(a.e, b.e)
    WHEN a.category = b.category AND a.category <> '' THEN 1 ELSE 0 END ORDER BY b.pos) AS sv FROM t a JOIN t b USING (user_id) GROUP BY a.user_id, a.pos),
{greedy_sql(SIGNED_VALUE, 10)}
SELECT t.user_id, t.item_id, round(t.score, 5) AS score, CAST(place AS INT) AS rank FROM t JOIN pl ON pl.user_id = t.user_id AND pl.pos = t.pos""")
def _(spark, d):
    personal, catalogue = parts(spark, d)
    top = stage(C.hybrid(users(spark, d), personal, catalogue, 10), "hybrid")
    return C.diversified(top, items(spark, d)).withColumn("score", F.round("score", 5))


@query("recommend_hybrid_finished")
def _(spark, d):
    personal, catalogue = parts(spark, d)
    top = C.hybrid(users(spark, d), personal, catalogue, 20)
    blocked = items(spark, d).filter("is_premium")
    done = C.finish(top, items(spark, d), min_score=0.1, limit=10, exclude=blocked)
    return C.with_suggestions(done).select("user_id", "item_id", "rank", "score", "reason", "type", "content")


TEMPORAL = """h AS (SELECT user_id, hour(event_time) AS h, count(*)::DOUBLE AS n FROM interactions GROUP BY ALL),
w7 AS (SELECT user_id, isodow(event_time) AS h, count(*)::DOUBLE AS n FROM interactions GROUP BY ALL),
hi AS (SELECT item_id, hour(event_time) AS h, count(*)::DOUBLE AS n FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL),
wi AS (SELECT item_id, isodow(event_time) AS h, count(*)::DOUBLE AS n FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL),
un1 AS (SELECT user_id, sqrt(sum(n * n)) AS s, arg_max(h, n * 100 - h) AS peak FROM h GROUP BY 1), un2 AS (SELECT user_id, sqrt(sum(n * n)) AS s FROM w7 GROUP BY 1),
in1 AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM hi GROUP BY 1), in2 AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM wi GROUP BY 1),
d1 AS (SELECT user_id, item_id, sum(h.n * hi.n) AS x FROM h JOIN hi USING (h) GROUP BY ALL), d2 AS (SELECT user_id, item_id, sum(w7.n * wi.n) AS x FROM w7 JOIN wi USING (h) GROUP BY ALL),
pk AS (SELECT user_id, least(abs(10 - peak), 24 - abs(10 - peak)) AS dist FROM un1),
af AS (SELECT bs.user_id, bs.item_id, bs.score AS base, pk.dist, CASE WHEN un1.s IS NULL OR in1.s IS NULL THEN 0.5 ELSE
    (0.7 * (coalesce(d1.x, 0) / (un1.s * in1.s) + 1) / 2 + 0.3 * (coalesce(d2.x, 0) / (un2.s * in2.s) + 1) / 2) * CASE WHEN pk.dist <= 2 THEN 1 - pk.dist / 3.0 * 0.2 ELSE 1 END END AS aff
  FROM bs LEFT JOIN un1 USING (user_id) LEFT JOIN un2 USING (user_id) LEFT JOIN pk USING (user_id) LEFT JOIN in1 USING (item_id) LEFT JOIN in2 USING (item_id)
  LEFT JOIN d1 USING (user_id, item_id) LEFT JOIN d2 USING (user_id, item_id)),
ru AS (SELECT user_id, item_id, exp(-(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(event_time))) / 3600000000.0 / 24) AS r FROM interactions SEMI JOIN act USING (item_id) GROUP BY ALL),
rx AS (SELECT user_id, item_id, CASE WHEN max(r) OVER w = min(r) OVER w THEN 1 ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END AS r FROM ru WINDOW w AS (PARTITION BY user_id)),
nx AS (SELECT *, CASE WHEN round(max(base) OVER w, 12) = round(min(base) OVER w, 12) THEN 1 ELSE (base - min(base) OVER w) / (max(base) OVER w - min(base) OVER w) END AS bn,
  CASE WHEN round(max(aff) OVER w, 12) = round(min(aff) OVER w, 12) THEN 1 ELSE (aff - min(aff) OVER w) / (max(aff) OVER w - min(aff) OVER w) END AS an FROM af WINDOW w AS (PARTITION BY user_id)),
tt AS (SELECT user_id, item_id, (0.3 * bn + 0.4 * an + 0.3 * coalesce(r, 0)) * CASE WHEN dist <= 2 THEN greatest(1, 1.3 * (1 - dist / 3.0)) ELSE 1 END AS score
  FROM nx LEFT JOIN rx USING (user_id, item_id))"""


def temporal_top(spark, d, k=10):
    personal, catalogue = parts(spark, d)
    ev = interactions(spark, d)
    active = items(spark, d).filter("is_active").select("item_id")
    up, ip = C.patterns(ev)
    return C.temporal_scores(users(spark, d), personal, catalogue, C.recent_use(ev, active), up, ip, MOMENT, k)


@query("recommend_temporal", f"""WITH {SCORES}, {TEMPORAL}
SELECT user_id, item_id, round(score, 5) AS score FROM tt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) <= 10""")
def _(spark, d):
    return temporal_top(spark, d).select("user_id", "item_id", F.round("score", 5).alias("score"))


@query("recommend_temporal_reasons")
def _(spark, d):
    ev = interactions(spark, d)
    up, _ = C.patterns(ev)
    out = C.temporal_reasons(stage(temporal_top(spark, d, 5), "temporal"), up, ev, MOMENT)
    return out.withColumn("score", F.round("score", 5))


LONG18 = "[0.0,0.5,0,0,0, 0,0,0.5,0,0,0,0, 0.5, 0,0.5,0,0, 0]"
LAYOUT = f"""{SCORES},
cand AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) <= 18),
us_ AS (SELECT user_id, item_id, count(*) AS uses FROM interactions GROUP BY ALL),
ly AS (SELECT c.user_id, c.item_id, coalesce(uses, 0) AS uses, 1.2 * (0.40 * c.score + 0.20 * (0.5 + CASE WHEN i.is_premium THEN 0.1 ELSE 0 END) + 0.15 * (0.5 + 0.5 * least(coalesce(uses, 0) / 10.0, 1))
  + 0.10 * CASE WHEN rr.item_id IS NOT NULL THEN least(1, coalesce(rr.r, 0))
      ELSE greatest(0, 1 - 0.05 * date_diff('day', i.created_at, TIMESTAMP '2024-01-31 10:00:00')) END
  + 0.15 * coalesce((list_dot_product(CAST(i.embedding[1:18] AS DOUBLE[]), CAST({LONG18} AS DOUBLE[]))
    / sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) + 1) / 2, 0)) AS score
  FROM cand c JOIN items i USING (item_id) LEFT JOIN us_ USING (user_id, item_id) LEFT JOIN rr USING (item_id))"""


def slots(spark, d):
    personal, catalogue = parts(spark, d)
    base = C.hybrid(users(spark, d), personal, catalogue, 18)
    return C.layout_scores(base, items(spark, d), item_features(spark, d), interactions(spark, d), MOMENT, "hero_banner")


@query("layout_scores", f"WITH {LAYOUT} SELECT user_id, item_id, uses, round(score, 4) AS score FROM ly")
def _(spark, d):
    return slots(spark, d).select("user_id", "item_id", "uses", F.round("score", 4).alias("score"))


def _layout(name, use_mmr):
    @query(name)
    def run(spark, d):
        scored = stage(slots(spark, d), "slots")
        return C.layout(scored, items(spark, d), item_features(spark, d), MOMENT, use_mmr=use_mmr)


_layout("layout_mmr", True)
_layout("layout_category_gap", False)


@query("layout_refresh", """
WITH l AS (SELECT user_id, TIMESTAMP '2024-01-30 12:00:00' + to_hours(CAST(user_id % 16 AS BIGINT)) - to_hours(4) AS built_at FROM users WHERE user_id % 3 <> 0),
c AS (SELECT e.user_id, count(*) AS clicks FROM interactions e JOIN l USING (user_id) WHERE e.event_time > built_at AND e.event_time <= TIMESTAMP '2024-01-30 22:00:00' GROUP BY 1)
SELECT u.user_id, coalesce(clicks, 0) AS clicks, l.built_at IS NULL OR TIMESTAMP '2024-01-30 22:00:00' - l.built_at > INTERVAL 6 HOURS OR coalesce(clicks, 0) >= 2 AS refresh
FROM users u LEFT JOIN l USING (user_id) LEFT JOIN c USING (user_id)""")
def _(spark, d):
    u = users(spark, d)
    start = F.lit("2024-01-30 08:00:00").cast("timestamp")
    built = u.filter("user_id % 3 <> 0").select("user_id", F.timestamp_seconds(F.unix_seconds(start) + F.col("user_id") % 16 * 3600).alias("built_at"))
    return C.needs_refresh(u, built, interactions(spark, d), "2024-01-30 22:00:00", clicks=2).drop("built_at")


# --- evaluation ---------------------------------------------------------------------------------


def lists(spark, d):
    return P.recommend(P.fit(training_events(spark, d)))


@query("evaluate_list_diversity")
def _(spark, d):
    return evaluate.list_diversity(lists(spark, d))


@query("evaluate_head_share", f"""WITH {decayed_sql('interactions', 5, 3)}, p AS (SELECT item_id, sum(w) / (SELECT sum(w) FROM dw) AS p FROM dw GROUP BY 1),
t AS (SELECT p FROM p ORDER BY round(p, 10) DESC, item_id LIMIT 3) SELECT round(sum(p), 6) AS share, round(max(p), 6) AS top FROM t""")
def _(spark, d):
    out = evaluate.head_share(cf.popularity(cf.decayed_weights(training_events(spark, d))))
    return out.select(F.round("share", 6).alias("share"), F.round("top", 6).alias("top"))


@query("evaluate_item_similarity", f"""WITH {decayed_sql('interactions', 5, 3)}, {PAIRS.format('dw')}
SELECT round(avg(dot / sqrt(qa * qb)), 6) AS mean_sim, round(max(dot / sqrt(qa * qb)), 6) AS max_sim FROM pq""")
def _(spark, d):
    out = evaluate.item_similarity_summary(cf.item_similarity(cf.decayed_weights(training_events(spark, d))))
    return out.select(F.round("mean_sim", 6).alias("mean_sim"), F.round("max_sim", 6).alias("max_sim"))


@query("evaluate_user_similarity", f"""WITH {decayed_sql('interactions', 5, 3)}, {USER_TOP.format('dw')}
SELECT round(avg(sim), 6) AS mean_sim, round(max(sim), 6) AS max_sim FROM us WHERE u < v""")
def _(spark, d):
    out = cf.user_similarity_summary(cf.decayed_weights(training_events(spark, d)))
    return out.select(F.round("mean_sim", 6).alias("mean_sim"), F.round("max_sim", 6).alias("max_sim"))


@query("evaluate_model_comparison")
def _(spark, d):
    model = P.fit(training_events(spark, d))
    one, two = (evaluate.list_diversity(P.recommend(model, weights=w)) for w in (P.BASE_WEIGHTS, P.REBALANCED_WEIGHTS))
    return evaluate.compare_models(one, two, "ratio")


TOP10 = f"""{HYBRID}, sc AS (SELECT user_id, item_id, 0.25 * ucf + 0.25 * icf + 0.40 * pop AS score FROM al),
rc AS (SELECT user_id, item_id FROM sc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= 10)"""


@query("evaluate_user_coverage", f"""WITH {TOP10}, z AS (SELECT user_id, count(*) AS n FROM rc GROUP BY 1)
SELECT count(*) AS users, round(count(n) / count(*), 6) AS success_rate, avg(n) AS mean_length FROM users LEFT JOIN z USING (user_id)""")
def _(spark, d):
    return evaluate.user_coverage(lists(spark, d), users(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@query("evaluate_catalogue_coverage", f"WITH {TOP10} SELECT round(count(DISTINCT rc.item_id) / (SELECT count(*) FROM items), 6) AS coverage FROM rc")
def _(spark, d):
    return evaluate.catalogue_coverage(lists(spark, d), items(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query("evaluate_intra_list_diversity", f"""WITH {TOP10}, c AS (SELECT user_id, category, count(*) AS c FROM rc JOIN items USING (item_id) GROUP BY ALL),
p AS (SELECT user_id, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1) SELECT round(avg(1 - same / (n * (n - 1))), 6) AS diversity FROM p WHERE n > 1""")
def _(spark, d):
    return evaluate.intra_list_diversity(lists(spark, d), items(spark, d)).withColumn("diversity", F.round("diversity", 6))


SPLIT = """q AS (SELECT quantile_cont(epoch_us(event_time)::DOUBLE, 0.8) AS c FROM interactions WHERE item_id IS NOT NULL),
tr AS (SELECT user_id, item_id, event_time FROM interactions, q WHERE item_id IS NOT NULL AND epoch_us(event_time) < c),
te AS (SELECT DISTINCT user_id, item_id FROM interactions, q WHERE item_id IS NOT NULL AND epoch_us(event_time) >= c)"""


@query("evaluate_ranking", f"""WITH {SPLIT}, {decayed_sql('tr', 5, 3)}, pp AS (SELECT item_id, sum(w) AS p FROM dw GROUP BY 1),
al AS (SELECT u.user_id, pp.item_id, p FROM (SELECT DISTINCT user_id FROM dw) u CROSS JOIN pp ANTI JOIN dw USING (user_id, item_id)),
rc AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(p / (SELECT sum(w) FROM dw), 10) DESC, item_id) AS rank FROM al QUALIFY rank <= 10),
h AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM rc SEMI JOIN te USING (user_id, item_id) GROUP BY 1),
w AS (SELECT user_id, count(*) AS wanted FROM te GROUP BY 1),
j AS (SELECT wanted, coalesce(hits, 0) AS hits, coalesce(dcg, 0) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= wanted) AS ideal FROM w LEFT JOIN h USING (user_id))
SELECT count(*) AS users, round(avg(hits / 10.0), 6) AS precision, round(avg(hits / wanted), 6) AS recall, round(avg(dcg / ideal), 6) AS ndcg FROM j""")
def _(spark, d):
    train, test = P.split_by_time(training_events(spark, d))
    model = P.fit(train)
    recs = P.recommend(model, 10, {"user_cf": 0.0, "item_cf": 0.0, "popularity": 1.0}, diversity=1.0)
    out = evaluate.ranking_metrics(recs, test)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "ndcg")})


@query("purchases_popularity_cf")
def _(spark, d):
    out = P.recommend(P.fit(load(spark, d, "purchases"), 5, 3, 365.0))
    return out.withColumn("score", F.round("score", 6))
