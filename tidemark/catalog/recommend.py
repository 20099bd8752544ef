"""Queries of weights, similarities, neighbours, scores and recommenders."""

from pyspark.sql import functions as F

from tidemark.catalog.activity import r6
from tidemark.catalog.features import PROFILES
from tidemark.catalog.registry import query
from tidemark.inputs import interactions, items, load, training_events, users
from tidemark.operators import cf, scoring
from tidemark.operators import entity_features as E
from tidemark.plans import custom
from tidemark.plans import popularity_cf as P

T0 = "TIMESTAMP '2024-01-31 00:00:00'"

# --- weights ----------------------------------------------------------------------------


@query("weights_binary", "SELECT DISTINCT user_id, item_id, 1.0::DOUBLE AS w FROM interactions WHERE item_id IS NOT NULL")
def _(spark, d):
    return cf.interaction_weights(interactions(spark, d), "binary")


@query("weights_count", "SELECT user_id, item_id, count(*)::DOUBLE AS w FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return cf.interaction_weights(interactions(spark, d), "count")


WEIGHTED = f"""ww AS (SELECT user_id, item_id, sum(exp(-floor((epoch_us({T0}) - epoch_us(event_time)) / 86400000000) / 30.0)
  * CASE event_name WHEN 'selected_paraphrasing' THEN 1.5 WHEN 'copy_sentence' THEN 2.0 ELSE 1.0 END) AS w
  FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL)"""


@query("weights_weighted", f"WITH {WEIGHTED} SELECT user_id, item_id, round(w, 6) AS w FROM ww")
def _(spark, d):
    return cf.interaction_weights(interactions(spark, d), "weighted").withColumn("w", F.round("w", 6))


@query("weights_simple_matrix", f"""
WITH c AS (SELECT user_id, item_id, count(*)::DOUBLE AS w FROM interactions WHERE item_id IS NOT NULL
  AND event_time >= {T0} - INTERVAL 7 DAYS GROUP BY ALL)
SELECT * FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY 1 HAVING count(*) >= 12)""")
def _(spark, d):
    return cf.simple_matrix(interactions(spark, d), days=7, min_items=12)


@query("weights_of_user", f"WITH {WEIGHTED} SELECT item_id, round(w, 6) AS w FROM ww WHERE user_id = 8")
def _(spark, d):
    w = cf.interaction_weights(interactions(spark, d), "weighted")
    return cf.vector_of(w, "user_id", 8).withColumn("w", F.round("w", 6))


@query("weights_normalised", f"""WITH {WEIGHTED} SELECT user_id, item_id,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 6) AS w FROM ww""")
def _(spark, d):
    return cf.normalised_rows(cf.interaction_weights(interactions(spark, d), "weighted")).withColumn("w", F.round("w", 6))


@query("matrix_info", """
WITH p AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE item_id IS NOT NULL),
m AS (SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS nnz FROM p)
SELECT *, round(nnz / (users * items), 6) AS density, round(1 - nnz / (users * items), 6) AS sparsity FROM m""")
def _(spark, d):
    out = cf.matrix_info(cf.interaction_weights(interactions(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("density", "sparsity")})


def decayed_sql(source, min_user, min_item, decay=30.0):
    return f"""pc AS (SELECT user_id, item_id, count(*) AS n, max(event_time) AS last FROM {source} WHERE item_id IS NOT NULL GROUP BY ALL),
kp AS (SELECT * FROM pc WHERE user_id IN (SELECT user_id FROM pc GROUP BY 1 HAVING sum(n) >= {min_user})
  AND item_id IN (SELECT item_id FROM pc GROUP BY 1 HAVING sum(n) >= {min_item})),
dw AS (SELECT user_id, item_id, sum(exp(-floor((epoch_us((SELECT max(last) FROM kp)) - epoch_us(event_time)) / 86400000000) / {decay})) AS w
  FROM {source} SEMI JOIN kp USING (user_id, item_id) GROUP BY ALL)"""


@query("weights_decayed", f"WITH {decayed_sql('interactions', 60, 95)} SELECT user_id, item_id, round(w, 6) AS w FROM dw")
def _(spark, d):
    return cf.decayed_weights(training_events(spark, d), 60, 95).withColumn("w", F.round("w", 6))


@query("weights_decayed_purchases", f"WITH {decayed_sql('purchases', 30, 20, 365.0)} SELECT user_id, item_id, round(w, 6) AS w FROM dw")
def _(spark, d):
    return cf.decayed_weights(load(spark, d, "purchases"), 30, 20, 365.0).withColumn("w", F.round("w", 6))


# --- similarities -----------------------------------------------------------------------

PAIRS = """sq AS (SELECT item_id, sum(w * w) AS q, count(*) AS n FROM {0} GROUP BY 1),
ps AS (SELECT a.item_id AS item_a, b.item_id AS item_b, sum(a.w * b.w) AS dot, count(*) AS common,
  corr(a.w, b.w) AS r FROM {0} a JOIN {0} b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL),
pq AS (SELECT ps.*, x.q AS qa, y.q AS qb, x.n AS na, y.n AS nb FROM ps JOIN sq x ON x.item_id = item_a JOIN sq y ON y.item_id = item_b)"""
METRIC_SQL = {
    "cosine": "dot / sqrt(qa * qb)",
    "jaccard": "common / (na + nb - common)",
    "pearson": "CASE WHEN common < 2 OR r IS NULL OR isnan(r) THEN 0 ELSE r END",
    "euclidean": "exp(-sqrt(greatest(0, qa + qb - 2 * dot)))",
}


def _similarity(metric):
    @query(f"item_similarity_{metric}", f"""WITH {WEIGHTED}, {PAIRS.format('ww')}
SELECT item_a, item_b, round({METRIC_SQL[metric]}, 6) AS sim, common FROM pq""")
    def run(spark, d):
        w = cf.interaction_weights(interactions(spark, d), "weighted")
        return cf.item_similarity(w, metric).withColumn("sim", F.round("sim", 6))


for _m in METRIC_SQL:
    _similarity(_m)

ITEM_TOP = f"""{PAIRS.format('ww')},
full_ AS (SELECT item_a, item_b, dot / sqrt(qa * qb) AS sim, common FROM pq UNION ALL SELECT item_b, item_a, dot / sqrt(qa * qb), common FROM pq),
ik AS (SELECT item_a, item_b, sim, common, CAST(row_number() OVER (PARTITION BY item_a ORDER BY round(sim, 10) DESC, item_b) AS INT) AS rank FROM full_)"""


@query("item_neighbours", f"""WITH {WEIGHTED}, {ITEM_TOP} SELECT item_a, item_b, round(sim, 6) AS sim, common, rank FROM ik
WHERE rank <= 20 AND sim > 0 AND common >= 40""")
def _(spark, d):
    w = cf.interaction_weights(interactions(spark, d), "weighted")
    return cf.item_neighbours(cf.mirrored(cf.item_similarity(w)), 20, 40).withColumn("sim", F.round("sim", 6))


@query("similar_items_of_item", f"""WITH {WEIGHTED}, {ITEM_TOP} SELECT item_b, round(sim, 6) AS sim, common, rank FROM ik
WHERE rank <= 10 AND sim > 0 AND item_a = 7""")
def _(spark, d):
    w = cf.interaction_weights(interactions(spark, d), "weighted")
    best = cf.item_neighbours(cf.mirrored(cf.item_similarity(w)), 10)
    return best.filter("item_a = 7").drop("item_a").withColumn("sim", F.round("sim", 6))


USER_TOP = """uq AS (SELECT user_id, sqrt(sum(w * w)) AS q FROM {0} GROUP BY 1),
up AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.w * b.w) AS dot, count(*) AS common FROM {0} a JOIN {0} b USING (item_id) GROUP BY ALL),
us AS (SELECT u, v, round(CASE WHEN u = v THEN 1 ELSE dot / (x.q * y.q) END, 12) AS sim, common FROM up JOIN uq x ON x.user_id = u JOIN uq y ON y.user_id = v),
un AS (SELECT u AS user_id, v AS other_id, sim, common, CAST(row_number() OVER (PARTITION BY u ORDER BY sim DESC, (u = v) DESC, v) AS INT) AS rank FROM us)"""


@query("user_neighbours", f"""WITH {WEIGHTED}, {USER_TOP.format('ww')}
SELECT user_id, other_id, round(sim, 6) AS sim, common, rank FROM un WHERE rank <= 21 AND other_id <> user_id AND common >= 3""")
def _(spark, d):
    w = cf.interaction_weights(interactions(spark, d), "weighted")
    return cf.user_neighbours(w, 20, min_common=3).withColumn("sim", F.round("sim", 6))


def user_metric_sql(w, metric, k):
    """The k + 1 nearest users of each user, itself included; pairs without a common item do not appear."""
    return f"""uq AS (SELECT user_id, sum(w * w) AS q, count(*) AS n FROM {w} GROUP BY 1),
up AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.w * b.w) AS dot, count(*) AS common, corr(a.w, b.w) AS r FROM {w} a JOIN {w} b USING (item_id) GROUP BY ALL),
pq AS (SELECT up.*, x.q AS qa, y.q AS qb, x.n AS na, y.n AS nb FROM up JOIN uq x ON x.user_id = u JOIN uq y ON y.user_id = v),
un AS (SELECT u AS user_id, v AS other_id, round({METRIC_SQL[metric]}, 12) AS sim, common FROM pq),
ur AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (user_id = other_id) DESC, sim DESC, other_id) AS INT) AS rank FROM un)
SELECT user_id, other_id, round(sim, 6) AS sim, common, rank FROM ur WHERE rank <= {k + 1} AND other_id <> user_id AND sim > 0"""


def _user_metric(metric):
    @query(f"user_neighbours_{metric}", f"WITH {WEIGHTED}, {user_metric_sql('ww', metric, 10)}")
    def run(spark, d):
        w = cf.interaction_weights(interactions(spark, d), "weighted")
        return cf.user_neighbours(w, 10, metric=metric).withColumn("sim", F.round("sim", 6))


for _m in ("jaccard", "pearson", "euclidean"):
    _user_metric(_m)


@query("user_neighbours_purchases", f"WITH w AS (SELECT user_id, item_id, count(*)::DOUBLE AS w FROM purchases GROUP BY ALL), {user_metric_sql('w', 'cosine', 10)}")
def _(spark, d):
    w = cf.interaction_weights(load(spark, d, "purchases"), "count")
    return cf.user_neighbours(w, 10).withColumn("sim", F.round("sim", 6))


@query("item_similarity_purchases", f"""
WITH w AS (SELECT user_id, item_id, count(*)::DOUBLE AS w FROM purchases GROUP BY ALL), {PAIRS.format('w')}
SELECT item_a, item_b, round(dot / sqrt(qa * qb), 6) AS sim, common FROM pq WHERE common >= 3""")
def _(spark, d):
    w = cf.interaction_weights(load(spark, d, "purchases"), "count")
    return cf.item_similarity(w, min_common=3).withColumn("sim", F.round("sim", 6))


USER_CF = """n20 AS (SELECT * FROM un WHERE rank <= 21 AND other_id <> user_id AND sim > 0),
ut AS (SELECT user_id, sum(sim) AS t FROM n20 GROUP BY 1),
ucs AS (SELECT n.user_id, w.item_id, sum(n.sim * w.w) AS s FROM n20 n JOIN ww w ON w.user_id = n.other_id GROUP BY ALL),
ucf AS (SELECT user_id, item_id, s / t AS score FROM ucs JOIN ut USING (user_id) ANTI JOIN ww USING (user_id, item_id))"""
ITEM_CF = """i20 AS (SELECT * FROM ik WHERE rank <= 20 AND sim > 0),
held AS (SELECT user_id, count(*) AS h FROM ww GROUP BY 1),
ics AS (SELECT w.user_id, n.item_b AS item_id, sum(w.w * n.sim) AS s FROM ww w JOIN i20 n ON n.item_a = w.item_id GROUP BY ALL),
icf AS (SELECT user_id, item_id, s / h AS score FROM ics JOIN held USING (user_id) ANTI JOIN ww USING (user_id, item_id))"""


def weighted(spark, d):
    return cf.interaction_weights(interactions(spark, d), "weighted")


def user_cf(spark, d):
    w = weighted(spark, d)
    return cf.unseen(cf.user_cf_scores(cf.user_neighbours(w, 20), w), w)


def item_cf(spark, d):
    w = weighted(spark, d)
    sims = cf.item_neighbours(cf.mirrored(cf.item_similarity(w)), 20)
    return cf.unseen(cf.item_cf_scores(w, sims), w)


@query("user_cf_scores", f"WITH {WEIGHTED}, {USER_TOP.format('ww')}, {USER_CF} SELECT user_id, item_id, round(score, 6) AS score FROM ucf")
def _(spark, d):
    return user_cf(spark, d).withColumn("score", F.round("score", 6))


@query("item_cf_scores", f"WITH {WEIGHTED}, {ITEM_TOP}, {ITEM_CF} SELECT user_id, item_id, round(score, 6) AS score FROM icf")
def _(spark, d):
    return item_cf(spark, d).withColumn("score", F.round("score", 6))


@query("neighbour_explanations", f"""WITH {WEIGHTED}, {USER_TOP.format('ww')}, n10 AS (SELECT * FROM un WHERE rank <= 11 AND other_id <> user_id AND sim > 0)
SELECT n.user_id, w.item_id, count(*) AS neighbours FROM n10 n JOIN ww w ON w.user_id = n.other_id GROUP BY ALL""")
def _(spark, d):
    w = weighted(spark, d)
    return cf.neighbour_explanations(cf.user_neighbours(w, 10), w)


@query("closest_owned_items", f"""WITH {WEIGHTED}, {ITEM_TOP}, {ITEM_CF},
t AS (SELECT user_id, item_id FROM icf QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= 5),
o AS (SELECT user_id, item_id AS owned_id FROM ww QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 5)
SELECT t.user_id, t.item_id, o.owned_id, round(f.sim, 6) AS sim FROM t JOIN o USING (user_id) JOIN full_ f ON f.item_a = t.item_id AND f.item_b = o.owned_id
QUALIFY row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY round(f.sim, 10) DESC, o.owned_id) = 1""")
def _(spark, d):
    w = weighted(spark, d)
    sims = cf.mirrored(cf.item_similarity(w))
    top = scoring.top_k(cf.unseen(cf.item_cf_scores(w, cf.item_neighbours(sims, 20)), w), 5)
    return cf.closest_owned(top, w, sims).withColumn("sim", F.round("sim", 6))


# --- popularity + CF recommender ---------------------------------------------------------

HYBRID = f"""{decayed_sql('interactions', 5, 3)}, {PAIRS.format('dw')}, {USER_TOP.format('dw')},
n50 AS (SELECT * FROM un WHERE rank <= 50 AND sim > 0), ut AS (SELECT user_id, sum(sim) + 1e-10 AS t FROM n50 GROUP BY 1),
uc AS (SELECT n.user_id, w.item_id, sum(n.sim * w.w) AS s FROM n50 n JOIN dw w ON w.user_id = n.other_id GROUP BY ALL),
sm AS (SELECT item_a, item_b, dot / sqrt(qa * qb) AS sim FROM pq UNION ALL SELECT item_b, item_a, dot / sqrt(qa * qb) FROM pq
       UNION ALL SELECT item_id, item_id, 1.0 FROM sq),
hd AS (SELECT user_id, count(*) AS h FROM dw GROUP BY 1),
ic AS (SELECT w.user_id, m.item_b AS item_id, sum(m.sim) AS s FROM dw w JOIN sm m ON m.item_a = w.item_id GROUP BY ALL),
pp AS (SELECT item_id, sum(w) / (SELECT sum(w) FROM dw) AS pop FROM dw GROUP BY 1),
al AS (SELECT hd.user_id, pp.item_id, pop, coalesce(uc.s / t, 0) AS ucf, coalesce(ic.s / h, 0) AS icf FROM hd CROSS JOIN pp
  LEFT JOIN uc USING (user_id, item_id) LEFT JOIN ut USING (user_id) LEFT JOIN ic USING (user_id, item_id) ANTI JOIN dw USING (user_id, item_id))"""
REASONS_SQL = "concat_ws(',', CASE WHEN ucf > 0.1 THEN 'similar_users' END, CASE WHEN icf > 0.1 THEN 'related_items' END, CASE WHEN pop > 0.05 THEN 'popular' END)"


def hybrid_sql(k, u, i, p):
    return f"""WITH {HYBRID}, sc AS (SELECT user_id, item_id, {u} * ucf + {i} * icf + {p} * pop AS score, {REASONS_SQL} AS reasons FROM al)
SELECT user_id, item_id, round(score, 6) AS score, reasons FROM sc
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= {k}"""


def greedy_sql(value, limit):
    """Rows of bl (user_id, pos, score, sv: similarities to the places) in greedy order: the first place, then the best value each time."""
    return f"""g AS (SELECT user_id, [1] AS chosen FROM bl WHERE pos = 1
UNION ALL SELECT user_id, list_append(chosen, nxt) FROM (SELECT g.user_id, g.chosen, b.pos AS nxt,
    row_number() OVER (PARTITION BY g.user_id ORDER BY round({value}, 10) DESC, b.pos) AS rn
  FROM g JOIN bl b ON b.user_id = g.user_id AND NOT list_contains(g.chosen, b.pos) AND len(g.chosen) < {limit}) WHERE rn = 1),
gl AS (SELECT user_id, arg_max(chosen, len(chosen)) AS chosen FROM g GROUP BY 1),
pl AS (SELECT user_id, unnest(chosen) AS pos, unnest(range(1, len(chosen) + 1)) AS place FROM gl)"""


SPREAD_SQL = greedy_sql("0.3 * b.score + 0.7 * (1 - list_sum([b.sv[p] FOR p IN g.chosen]) / len(g.chosen))", 10)


@query("recommend_popularity_cf", f"""WITH RECURSIVE {HYBRID}, sc AS (SELECT user_id, item_id, 0.25 * ucf + 0.25 * icf + 0.40 * pop AS score, {REASONS_SQL} AS reasons FROM al),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) AS pos FROM sc QUALIFY pos <= 10),
bl AS (SELECT a.user_id, a.pos, any_value(a.score) AS score, list(coalesce(sm.sim, 0) ORDER BY b.pos) AS sv
  FROM t a JOIN t b USING (user_id) LEFT JOIN sm ON sm.item_a = a.item_id AND sm.item_b = b.item_id GROUP BY a.user_id, a.pos),
{SPREAD_SQL},
sz AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1)
SELECT t.user_id, t.item_id, round(t.score, 6) AS score, CAST(CASE WHEN n <= 3 THEN t.pos ELSE place END AS INT) AS rank, t.reasons
FROM t JOIN sz USING (user_id) JOIN pl ON pl.user_id = t.user_id AND pl.pos = t.pos""")
def _(spark, d):
    out = P.recommend(P.fit(training_events(spark, d)))
    return out.withColumn("score", F.round("score", 6))


@query("recommend_popularity_cf_items", hybrid_sql(10, 0.25, 0.25, 0.40))
def _(spark, d):
    return P.recommend(P.fit(training_events(spark, d))).drop("rank").withColumn("score", F.round("score", 6))


@query("recommend_rebalanced_items", hybrid_sql(10, 0.35, 0.35, 0.20))
def _(spark, d):
    out = P.recommend(P.fit(training_events(spark, d)), weights=P.REBALANCED_WEIGHTS)
    return out.drop("rank").withColumn("score", F.round("score", 6))


@query("popularity", f"WITH {decayed_sql('interactions', 5, 3)} SELECT item_id, round(sum(w) / (SELECT sum(w) FROM dw), 6) AS popularity FROM dw GROUP BY 1")
def _(spark, d):
    return cf.popularity(cf.decayed_weights(training_events(spark, d))).withColumn("popularity", F.round("popularity", 6))


@query("recommend_cold_start", f"""WITH {decayed_sql('interactions', 5, 3)},
p AS (SELECT item_id, sum(w) / (SELECT sum(w) FROM dw) AS s FROM dw GROUP BY 1),
t AS (SELECT item_id, s, CAST(row_number() OVER (ORDER BY round(s, 10) DESC, item_id) AS INT) AS rank FROM p QUALIFY rank <= 10)
SELECT u.user_id, t.item_id, round(t.s, 6) AS score, t.rank, 'popular,cold_start' AS reasons FROM users u CROSS JOIN t
WHERE u.user_id NOT IN (SELECT user_id FROM dw)""")
def _(spark, d):
    w = cf.decayed_weights(training_events(spark, d))
    model = P.Model(w, w, w, cf.popularity(w))
    return P.cold_start(model, users(spark, d)).withColumn("score", F.round("score", 6))


@query("time_split", """
WITH q AS (SELECT quantile_cont(epoch_us(event_time)::DOUBLE, 0.8) AS c FROM interactions WHERE item_id IS NOT NULL)
SELECT CASE WHEN epoch_us(event_time) < c THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM interactions, q WHERE item_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    train, test = P.split_by_time(training_events(spark, d))
    count = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(train, "train").unionByName(count(test, "test"))


@query("recommend_adaptive", f"""WITH {HYBRID}, {PROFILES},
st AS (SELECT * FROM (VALUES ('new', 'base', 5), ('beginner', 'base', 8), ('regular', 'rebalanced', 10), ('heavy', 'rebalanced', 12), ('inactive', 'base', 5)) t(segment, variant, k)),
sc AS (SELECT user_id, item_id, segment, variant, k, CASE variant WHEN 'base' THEN 0.25 * ucf + 0.25 * icf + 0.40 * pop ELSE 0.35 * ucf + 0.35 * icf + 0.20 * pop END AS score
  FROM al JOIN prof USING (user_id) JOIN st USING (segment)),
kn AS (SELECT user_id, item_id, segment, variant, round(score, 6) AS score FROM sc
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= k),
tp AS (SELECT item_id, pop, row_number() OVER (ORDER BY round(pop, 10) DESC, item_id) AS r FROM pp)
SELECT * FROM kn UNION ALL SELECT user_id, item_id, segment, variant, round(pop, 6) FROM prof JOIN st USING (segment) JOIN tp ON r <= k
WHERE user_id NOT IN (SELECT user_id FROM dw)""")
def _(spark, d):
    model = P.fit(training_events(spark, d))
    profiles = E.adaptive_profiles(interactions(spark, d), users(spark, d))
    return P.adaptive(model, profiles).drop("rank", "reasons").withColumn("score", F.round("score", 6))


# --- score algebra ------------------------------------------------------------------------

BASE = "s AS (SELECT user_id, item_id, w AS score FROM ww)"


def base(spark, d):
    return weighted(spark, d).withColumnRenamed("w", "score")


NORM_SQL = {
    "minmax": "CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END",
    "zscore": "(score - avg(score) OVER w) / stddev_pop(score) OVER w",
    "sigmoid": "1 / (1 + exp(-(score - avg(score) OVER w) / stddev_pop(score) OVER w))",
    "softmax": "exp(score - max(score) OVER w) / e",
    "rank": "row_number() OVER (PARTITION BY user_id ORDER BY score, item_id DESC) / count(*) OVER w",
}


def _normalise(method):
    @query(f"scores_{method}", f"""WITH {WEIGHTED}, {BASE}, m AS (SELECT user_id, max(score) AS mx FROM s GROUP BY 1),
t AS (SELECT user_id, sum(exp(score - mx)) AS e FROM s JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, item_id, round({NORM_SQL[method]}, 5) AS score FROM s JOIN t USING (user_id) WINDOW w AS (PARTITION BY user_id)""")
    def run(spark, d):
        return scoring.normalise(base(spark, d), method).withColumn("score", F.round("score", 5))


for _m in NORM_SQL:
    _normalise(_m)

TWO = f"""{WEIGHTED}, a AS (SELECT user_id, item_id, w AS score FROM ww),
b AS (SELECT user_id, item_id, count(*)::DOUBLE AS score FROM interactions WHERE event_name <> 'error_event' GROUP BY ALL),
u AS (SELECT *, 'a' AS src, 0.6 AS wt FROM a UNION ALL SELECT *, 'b', 0.4 FROM b)"""
PLACED = """p AS (SELECT *, row_number() OVER (PARTITION BY user_id, src ORDER BY score DESC, item_id) AS r,
  count(*) OVER (PARTITION BY user_id, src) AS n FROM u)"""
BLEND_SQL = {
    "weighted": "SELECT user_id, item_id, round(sum(wt * score) / sum(wt), 6) AS score FROM u GROUP BY ALL",
    "sum": "SELECT user_id, item_id, round(sum(wt * score), 6) AS score FROM u GROUP BY ALL",
    "rrf": "SELECT user_id, item_id, round(sum(wt / (60 + r)), 6) AS score FROM p GROUP BY ALL",
    "borda": "SELECT user_id, item_id, round(sum(wt * (n - r + 1)), 6) AS score FROM p GROUP BY ALL",
}


def _blend(method):
    @query(f"blend_{method}", f"WITH {TWO}, {PLACED} {BLEND_SQL[method]}")
    def run(spark, d):
        # Two sources that differ by nature: all weighted interactions, and how often an item was used without an error.
        used = interactions(spark, d).filter("event_name <> 'error_event'")
        counts = cf.interaction_weights(used, "count").withColumnRenamed("w", "score")
        sources = {"a": base(spark, d), "b": counts}
        return scoring.blend(sources, {"a": 0.6, "b": 0.4}, method).withColumn("score", F.round("score", 6))


for _m in BLEND_SQL:
    _blend(_m)

TRANSFORM_SQL = {
    "exp": "exp(score)",
    "log": "ln(1 + score)",
    "power": "pow(score, 2)",
    "threshold": "CASE WHEN score >= 0.5 THEN score ELSE 0 END",
}


def _transform(name):
    @query(f"transform_{name}", f"WITH {WEIGHTED}, {BASE} SELECT user_id, item_id, round({TRANSFORM_SQL[name]}, 5) AS score FROM s")
    def run(spark, d):
        return scoring.transform(base(spark, d), name).withColumn("score", F.round("score", 5))


for _m in TRANSFORM_SQL:
    _transform(_m)


@query("scores_filtered", f"""WITH {WEIGHTED}, {BASE},
f AS (SELECT *, score >= 2.0 AND score <= 6.0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY (score >= 2.0 AND score <= 6.0) DESC, score DESC, item_id) AS p,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS b FROM s),
g AS (SELECT *, count(*) FILTER (WHERE ok AND p <= 8) OVER (PARTITION BY user_id) AS c FROM f)
SELECT user_id, item_id, round(score, 6) AS score FROM g WHERE CASE WHEN c < 4 THEN b <= 4 ELSE ok AND p <= 8 END""")
def _(spark, d):
    out = scoring.filter_scores(base(spark, d), 2.0, 6.0, top_k=8, min_count=4)
    return out.withColumn("score", F.round("score", 6))


@query("score_statistics", f"""WITH {WEIGHTED}, {BASE}
SELECT user_id, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max,
  round(median(score), 6) AS median, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.75), 6) AS q75 FROM s GROUP BY 1""")
def _(spark, d):
    out = scoring.statistics(base(spark, d))
    return out.select("user_id", "n", *r6("mean", "std", "min", "max", "median", "q25", "q75"))


@query("top_scores", f"""WITH {WEIGHTED}, {BASE} SELECT user_id, item_id, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def _(spark, d):
    return scoring.top_k(base(spark, d), 10).withColumn("score", F.round("score", 6))


SHORT_LIST = f"""{WEIGHTED}, {BASE},
t AS (SELECT s.user_id, s.item_id, s.score, i.category, CAST(i.embedding AS DOUBLE[]) AS e,
  row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 10) DESC, s.item_id) AS pos
  FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= 20) s JOIN items i USING (item_id))"""


@query("rerank_mmr", f"""WITH RECURSIVE {SHORT_LIST},
bl AS (SELECT a.user_id, a.pos, any_value(a.score) AS score, list(greatest(0, CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN list_cosine_similarity(a.e, b.e)
    WHEN a.category = b.category AND a.category <> '' THEN 1 ELSE 0 END) ORDER BY b.pos) AS sv FROM t a JOIN t b USING (user_id) GROUP BY a.user_id, a.pos),
{greedy_sql("0.7 * b.score - 0.3 * list_max([b.sv[p] FOR p IN g.chosen])", 20)}
SELECT t.user_id, t.item_id, round(t.score, 6) AS score, CAST(place AS INT) AS place FROM t JOIN pl ON pl.user_id = t.user_id AND pl.pos = t.pos""")
def _(spark, d):
    from tidemark.operators import rerank

    best = scoring.top_k(base(spark, d), 20).drop("rank")
    meta = items(spark, d).select("item_id", "category", "embedding")
    return rerank.rerank(rerank.pack(best.join(meta, "item_id"), "category", "embedding"), "mmr", lam=0.7).withColumn("score", F.round("score", 6))


@query("rerank_category_gap", f"""WITH RECURSIVE {SHORT_LIST},
g AS (SELECT user_id, 1 AS upto, [1] AS chosen, category AS last FROM t WHERE pos = 1
UNION ALL SELECT g.user_id, g.upto + 1, CASE WHEN len(chosen) < 8 AND t.category IS DISTINCT FROM g.last THEN list_append(chosen, t.pos) ELSE chosen END,
  CASE WHEN len(chosen) < 8 AND t.category IS DISTINCT FROM g.last THEN t.category ELSE g.last END FROM g JOIN t ON t.user_id = g.user_id AND t.pos = g.upto + 1),
f AS (SELECT user_id, arg_max(chosen, upto) AS chosen, max(upto) AS n FROM g GROUP BY 1),
o AS (SELECT user_id, list_concat(chosen, [p FOR p IN range(1, n + 1) IF NOT list_contains(chosen, p)])[1:8] AS l FROM f),
pl AS (SELECT user_id, unnest(l) AS pos, unnest(range(1, len(l) + 1)) AS place FROM o)
SELECT t.user_id, t.item_id, round(t.score, 6) AS score, CAST(place AS INT) AS place FROM t JOIN pl ON pl.user_id = t.user_id AND pl.pos = t.pos""")
def _(spark, d):
    from tidemark.operators import rerank

    best = scoring.top_k(base(spark, d), 20).drop("rank")
    meta = items(spark, d).select("item_id", "category")
    return rerank.rerank(rerank.pack(best.join(meta, "item_id"), "category"), "category_gap", limit=8).withColumn("score", F.round("score", 6))


@query("scores_clipped", f"""WITH {WEIGHTED}, {BASE}
SELECT user_id, item_id, round(least(1.5, greatest(-1.0, {NORM_SQL["zscore"]})), 5) AS score FROM s WINDOW w AS (PARTITION BY user_id)""")
def _(spark, d):
    return scoring.normalise(base(spark, d), "zscore", clip=(-1.0, 1.5)).withColumn("score", F.round("score", 5))


# --- a scorer of one's own --------------------------------------------------------------


def premium_cf(weights, items, context):
    """Item CF scores, raised for premium items."""
    sims = cf.item_neighbours(cf.mirrored(cf.item_similarity(weights)), context["neighbours"])
    rows = cf.item_cf_scores(weights, sims).join(items.select("item_id", "is_premium"), "item_id")
    return rows.withColumn("score", F.when(F.col("is_premium"), F.col("score") * context["premium"]).otherwise(F.col("score")))


@query("recommend_scorer", f"""WITH {WEIGHTED}, {ITEM_TOP}, {ITEM_CF},
sc AS (SELECT user_id, item_id, CASE WHEN is_premium THEN score * 1.25 ELSE score END AS score FROM icf JOIN items USING (item_id))
SELECT user_id, item_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) AS INT) AS rank FROM sc
WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, item_id) <= 10""")
def _(spark, d):
    recs = custom.recommend(premium_cf, weighted(spark, d), items(spark, d), {"neighbours": 20, "premium": 1.25}, k=10, min_score=0.05)
    return recs.select("user_id", "item_id", "score", "rank")
