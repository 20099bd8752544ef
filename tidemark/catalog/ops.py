"""Queries of the request-log panels and the rulebook."""

from pyspark.sql import functions as F

from tidemark.catalog.activity import r6, stamp
from tidemark.catalog.registry import query
from tidemark.inputs import load
from tidemark.operators import oplog as O
from tidemark.operators import rulebook as R


def log(spark, d):
    return O.with_endpoint(load(spark, d, "oplog"))


WIN = "strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S')"
EP = "regexp_replace(path, '/[0-9]+$', '/{id}')"


def w(df):
    return df.withColumn("window_start", stamp("window_start"))


@query("ops_request_rates", f"""SELECT {WIN} AS window_start, {EP} AS endpoint, method, count(*) AS n, round(count(*) / 300.0, 6) AS per_second
FROM oplog GROUP BY ALL""")
def _(spark, d):
    return w(O.request_rates(log(spark, d))).withColumn("per_second", F.round("per_second", 6))


@query("ops_status_rates", f"SELECT {WIN} AS window_start, status_code, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM oplog GROUP BY ALL")
def _(spark, d):
    return w(O.request_rates(log(spark, d), ["status_code"])).withColumn("per_second", F.round("per_second", 6))


@query("ops_success_rates", f"""SELECT {WIN} AS window_start, model_type, count(*) AS n,
  round(count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) / count(*), 6) AS success_rate FROM oplog GROUP BY ALL""")
def _(spark, d):
    return w(O.success_rates(log(spark, d), ["model_type"])).withColumn("success_rate", F.round("success_rate", 6))


def _latency(name, by, sql):
    @query(f"ops_latency_by_{name}", f"""SELECT {sql} AS {by}, round(quantile_cont(duration_s, 0.5), 6) AS p50, round(quantile_cont(duration_s, 0.95), 6) AS p95,
  round(quantile_cont(duration_s, 0.99), 6) AS p99 FROM oplog GROUP BY 1""")
    def run(spark, d):
        return O.latency_quantiles(log(spark, d), [by]).select(by, *r6("p50", "p95", "p99"))


_latency("endpoint", "endpoint", EP)
_latency("model", "model_type", "model_type")


@query("ops_latency_histogram", f"""WITH b AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'Infinity'::DOUBLE]) AS le)
SELECT {EP} AS endpoint, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE duration_s <= le) AS n FROM oplog, b GROUP BY ALL""")
def _(spark, d):
    out = O.histogram(log(spark, d), ["endpoint"])
    name = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return out.withColumn("le", name)


@query("ops_histogram_p95", f"""WITH b AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'Infinity'::DOUBLE]) AS le),
h AS (SELECT {EP} AS endpoint, le, count(*) FILTER (WHERE duration_s <= le) AS n FROM oplog, b GROUP BY ALL),
r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, 0.95 * max(n) OVER (PARTITION BY endpoint) AS rank FROM h WINDOW w AS (PARTITION BY endpoint ORDER BY le))
SELECT endpoint, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS quantile FROM r WHERE n >= rank AND below < rank""")
def _(spark, d):
    return O.histogram_quantile(O.histogram(log(spark, d), ["endpoint"]), ["endpoint"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("ops_mean_durations", f"SELECT {WIN} AS window_start, method, round(avg(duration_s), 6) AS mean_duration_s FROM oplog GROUP BY ALL")
def _(spark, d):
    return w(O.means(log(spark, d), ["duration_s"], ["method"])).withColumn("mean_duration_s", F.round("mean_duration_s", 6))


@query("ops_cache_hit_rates", "SELECT model_type, count(*) AS n, round(count(*) FILTER (WHERE cache_hit) / count(*), 6) AS hit_rate FROM oplog GROUP BY 1")
def _(spark, d):
    return O.cache_hit_rates(log(spark, d), ["model_type"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query("ops_error_counts", f"SELECT {WIN} AS window_start, model_type, count(*) AS n FROM oplog WHERE status_code >= 500 GROUP BY ALL")
def _(spark, d):
    return w(O.error_counts(log(spark, d), ["model_type"]))


@query("ops_top_errors", """WITH c AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, path, count(*) AS n FROM oplog WHERE status_code >= 500 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY n DESC, path) AS INT) AS rank FROM c QUALIFY rank <= 10""")
def _(spark, d):
    return w(O.top_errors(log(spark, d), "path", width="1 hour"))


@query("ops_recent_performance", f"""WITH t AS (SELECT {EP} AS endpoint, duration_s * 1000 AS ms, row_number() OVER (PARTITION BY {EP} ORDER BY ts DESC, id DESC) AS r FROM oplog),
l AS (SELECT endpoint, list_sort(list(ms)) AS a FROM t WHERE r <= 100 GROUP BY 1)
SELECT endpoint, CAST(len(a) AS INT) AS n, round(list_avg(a), 4) AS mean_ms, round(a[1], 4) AS min_ms, round(a[len(a)], 4) AS max_ms,
  round(a[CAST(floor(len(a) * 0.5) AS INT) + 1], 4) AS p50_ms, round(a[CAST(floor(len(a) * 0.95) AS INT) + 1], 4) AS p95_ms,
  round(a[CAST(floor(len(a) * 0.99) AS INT) + 1], 4) AS p99_ms, a[len(a)] > 1000 AS has_slow FROM l""")
def _(spark, d):
    out = O.recent_performance(load(spark, d, "oplog"))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_ms")})


@query("ops_quota_violations", """WITH q AS (SELECT client_key, id,
  count(*) OVER (PARTITION BY client_key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS last_minute,
  count(*) OVER (PARTITION BY client_key ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS last_hour FROM oplog)
SELECT * FROM q WHERE last_minute > 1 OR last_hour > 2""")
def _(spark, d):
    return O.quota_violations(load(spark, d, "oplog"), per_minute=1, per_hour=2)


# --- rulebook ------------------------------------------------------------------------------

INSIGHTS = """ins AS (SELECT id, selected_feature, tone, genre, feedback, corrected_text AS recommended_rule, original, corrected_text, processed,
  CASE WHEN id % 3 = 0 THEN NULL ELSE (id % 10) / 100.0 END AS weight, CASE WHEN id % 2 = 0 THEN 0.05 END AS recommendation_score FROM feedbacks)"""


def insights(spark, d):
    i = F.col("id")
    return load(spark, d, "feedbacks").withColumns(
        {
            "recommended_rule": F.col("corrected_text"),
            "why": F.array("original"),
            "weight": F.when(i % 3 != 0, (i % 10) / 100.0),
            "recommendation_score": F.when(i % 2 == 0, 0.05),
            "timestamp": F.timestamp_seconds(i),
        }
    )


def rules_sql(where="true", suffix=""):
    conf = lambda sw, dw, sn, dn: f"""round_even(greatest(-1, least(1, {sn} / ({sn} + {dn}) - 0.2 * {dw}
  + CASE WHEN {sn} >= 10 THEN 0.1 WHEN {sn} >= 5 THEN 0.05 WHEN {sn} >= 3 THEN 0.02 ELSE 0 END)), 2)"""
    return f"""r{suffix} AS (SELECT lower(selected_feature || '_' || tone || '_' || genre) AS rule_id, any_value(selected_feature) AS feature, any_value(tone) AS tone, any_value(genre) AS genre,
  count(*) AS total_count, count(*) FILTER (WHERE feedback = 'satisfied') AS sn, count(*) FILTER (WHERE feedback <> 'satisfied') AS dn,
  coalesce(sum(coalesce(weight, recommendation_score, 1.0)) FILTER (WHERE feedback = 'satisfied'), 0) AS sw,
  coalesce(sum(coalesce(weight, recommendation_score, 1.0)) FILTER (WHERE feedback <> 'satisfied'), 0) AS dw FROM ins WHERE {where} GROUP BY 1),
g{suffix} AS (SELECT lower(selected_feature || '_' || tone || '_' || genre) AS rule_id, recommended_rule AS guideline FROM ins WHERE feedback = 'satisfied' AND {where}
  QUALIFY row_number() OVER (PARTITION BY 1, lower(selected_feature || '_' || tone || '_' || genre) ORDER BY length(recommended_rule) DESC, id) = 1),
ru{suffix} AS (SELECT rule_id, feature, tone, genre, coalesce(guideline, '') AS guideline, total_count, sn, dn, round_even(sw, 2) AS sw, round_even(dw, 2) AS dw,
  round_even(sn / total_count, 2) AS positive_ratio, {conf('sw', 'dw', 'sn', 'dn')} AS confidence FROM r{suffix} LEFT JOIN g{suffix} USING (rule_id))"""


@query("rules_from_feedback", f"""WITH {INSIGHTS}, {rules_sql()}
SELECT rule_id, feature, tone, genre, guideline, total_count, sn AS satisfied_count, dn AS dissatisfied_count, sw AS satisfied_weight,
  dw AS dissatisfied_weight, positive_ratio, confidence FROM ru""")
def _(spark, d):
    out = R.rules_from_insights(insights(spark, d))
    return out.drop("avoid_guidelines", "why_good", "why_bad", "examples", "created_at", "updated_at")


@query("rule_texts", f"""WITH {INSIGHTS}, k AS (SELECT *, lower(selected_feature || '_' || tone || '_' || genre) AS rule_id FROM ins),
f AS (SELECT rule_id, feedback, original, min(id) AS i FROM k GROUP BY ALL),
wg AS (SELECT rule_id, feedback, original, row_number() OVER (PARTITION BY rule_id, feedback ORDER BY i, original) AS r FROM f),
e AS (SELECT rule_id, id, row_number() OVER (PARTITION BY rule_id ORDER BY id) AS r, substr(original, 1, 120) AS o FROM k)
SELECT rule_id, coalesce((SELECT string_agg(original, '|' ORDER BY r) FROM wg WHERE wg.rule_id = x.rule_id AND feedback = 'satisfied' AND r <= 3), '') AS why_good,
  coalesce((SELECT string_agg(original, '|' ORDER BY r) FROM wg WHERE wg.rule_id = x.rule_id AND feedback <> 'satisfied' AND r <= 3), '') AS why_bad,
  (SELECT string_agg(o, '|' ORDER BY r) FROM e WHERE e.rule_id = x.rule_id AND r <= 10) AS examples FROM (SELECT DISTINCT rule_id FROM k) x""")
def _(spark, d):
    out = R.rules_from_insights(insights(spark, d))
    shown = F.array_join(F.transform("examples", lambda e: e["original"]), "|")
    return out.select("rule_id", F.array_join("why_good", "|").alias("why_good"), F.array_join("why_bad", "|").alias("why_bad"), shown.alias("examples"))


@query("feedback_pending", "SELECT id, user_id, selected_feature, feedback FROM feedbacks WHERE NOT processed ORDER BY id LIMIT 10")
def _(spark, d):
    return R.pending(load(spark, d, "feedbacks")).select("id", "user_id", "selected_feature", "feedback")


@query("feedback_marked", """WITH p AS (SELECT id FROM feedbacks WHERE NOT processed ORDER BY id LIMIT 10)
SELECT id, processed OR id IN (SELECT id FROM p) AS processed, id IN (SELECT id FROM p) AS stamped FROM feedbacks""")
def _(spark, d):
    f = load(spark, d, "feedbacks")
    return R.mark_processed(f, R.pending(f)).select("id", "processed", F.col("processed_at").isNotNull().alias("stamped"))


@query("feedback_per_user", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE NOT processed) AS pending FROM feedbacks GROUP BY 1")
def _(spark, d):
    return R.has_feedback(load(spark, d, "feedbacks"))


@query("rulebook_merge", f"""WITH {INSIGHTS}, {rules_sql('processed', 'o')}, {rules_sql('NOT processed', 'n')},
j AS (SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, CASE WHEN o.rule_id IS NULL THEN 'added' WHEN n.rule_id IS NULL THEN 'untouched'
    WHEN n.confidence < 0 AND o.confidence < 0 THEN 'delete' WHEN n.confidence < 0 THEN 'kept' ELSE 'updated' END AS action,
  n.sn AS nsn, n.dn AS ndn, n.sw AS nsw, n.dw AS ndw, n.confidence AS nc, n.guideline AS ng, o.sn AS osn, o.dn AS odn, o.sw AS osw, o.dw AS odw, o.confidence AS oc, o.guideline AS og
  FROM run n FULL JOIN ruo o ON n.rule_id = o.rule_id),
t AS (SELECT *, CASE action WHEN 'updated' THEN nsn + osn WHEN 'added' THEN nsn ELSE osn END AS sn, CASE action WHEN 'updated' THEN ndn + odn WHEN 'added' THEN ndn ELSE odn END AS dn,
  CASE action WHEN 'updated' THEN ndw + odw WHEN 'added' THEN ndw ELSE odw END AS dw FROM j WHERE action <> 'delete')
SELECT rule_id, action, sn AS satisfied_count, dn AS dissatisfied_count, CASE action WHEN 'updated' THEN ng WHEN 'added' THEN ng ELSE og END AS guideline,
  CASE action WHEN 'added' THEN nc WHEN 'updated' THEN round_even(greatest(-1, least(1, sn / (sn + dn) - 0.2 * dw
    + CASE WHEN sn >= 10 THEN 0.1 WHEN sn >= 5 THEN 0.05 WHEN sn >= 3 THEN 0.02 ELSE 0 END)), 2) ELSE oc END AS confidence FROM t""")
def _(spark, d):
    ins = insights(spark, d)
    old, new = R.rules_from_insights(ins.filter("processed")), R.rules_from_insights(ins.filter("NOT processed"))
    out = R.merge_rulebook(old, new)
    return out.select("rule_id", "action", "satisfied_count", "dissatisfied_count", "guideline", "confidence")


@query("rule_lookup", f"""WITH {INSIGHTS}, {rules_sql()} SELECT rule_id, confidence, guideline FROM ru
WHERE feature = 'Expand' AND tone = 'formal' AND genre = 'narrative'""")
def _(spark, d):
    rules = R.rules_from_insights(insights(spark, d))
    return R.find_rules(rules, "Expand", "formal", "narrative").select("rule_id", "confidence", "guideline")


@query("rule_prompts")
def _(spark, d):
    return R.prompt_blocks(R.rules_from_insights(insights(spark, d)))
