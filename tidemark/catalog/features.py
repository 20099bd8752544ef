"""Queries of the user, item, session, temporal and context features."""

from pyspark.sql import functions as F

from tidemark.catalog.activity import map_text, r6, stamp
from tidemark.catalog.registry import query
from tidemark.functions import device as dev
from tidemark.functions import skew, text, vectors
from tidemark.functions import timefn as tf
from tidemark.functions.stage import stage
from tidemark.inputs import interactions, items, load, raw, users
from tidemark.operators import activity as A
from tidemark.operators import context, sessions, temporal
from tidemark.operators import entity_features as E
from tidemark.session import AS_OF

T0 = "TIMESTAMP '2024-01-31 00:00:00'"


def days_sql(ts):
    return f"CAST(floor((epoch_us({T0}) - epoch_us({ts})) / 86400000000) AS BIGINT)"


def mode_sql(key, expr, out):
    return f"""(SELECT {key}, v AS {out} FROM (SELECT {key}, {expr} AS v, count(*) AS n FROM interactions
  WHERE {expr} IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) = 1)"""


def weekday(ts="event_time"):
    return f"CAST(isodow({ts}) - 1 AS INT)"


USER_MODES = {
    "preferred_tone": "tone",
    "preferred_maintenance": "maintenance",
    "preferred_language": "target_language",
    "most_active_hour": "CAST(hour(event_time) AS INT)",
    "most_active_weekday": weekday(),
    "primary_browser": "browser",
    "primary_os": "os",
    "primary_device": "device_id",
}
USER_BASE = f"""uf AS (SELECT user_id, count(*) AS total_events,
  count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00') AS last_7d_count,
  count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00') AS last_30d_count,
  round(avg(response_time_ms), 6) AS avg_response_time_ms, round(avg(input_sentence_length), 6) AS avg_input_length,
  {days_sql('min(event_time)')} AS days_since_first, {days_sql('max(event_time)')} AS days_since_last,
  round((count(*) FILTER (WHERE event_name ILIKE '%run%') + 1.5 * count(*) FILTER (WHERE event_name ILIKE '%select%')
    + 2.0 * count(*) FILTER (WHERE event_name ILIKE '%copy%')) / count(*), 6) AS engagement_score,
  round((count(DISTINCT tone) + count(DISTINCT maintenance)) / 10.0, 6) AS exploration_score,
  round(count(*) FILTER (WHERE event_name ILIKE '%select%') / greatest(count(*) FILTER (WHERE event_name ILIKE '%run%'), 1), 6) AS selections_per_run,
  round(count(*) FILTER (WHERE event_name ILIKE '%copy%') / greatest(count(*) FILTER (WHERE event_name ILIKE '%run%'), 1), 6) AS copy_rate
  FROM interactions GROUP BY user_id)"""
USER_ROUND = ["avg_response_time_ms", "avg_input_length", "engagement_score", "exploration_score", "selections_per_run", "copy_rate"]
USER_COLS = "uf.*, " + ", ".join(USER_MODES)
USER_JOINS = " ".join(f"LEFT JOIN {mode_sql('user_id', e, o)} USING (user_id)" for o, e in USER_MODES.items())


def user_feats(spark, d):
    return E.user_features(interactions(spark, d)).withColumns({c: F.round(c, 6) for c in USER_ROUND})


@query("user_features", f"WITH {USER_BASE} SELECT {USER_COLS} FROM uf {USER_JOINS}")
def _(spark, d):
    return user_feats(spark, d)


@query("user_feature_defaults", f"""WITH {USER_BASE}
SELECT u.user_id, coalesce(total_events, 0) AS total_events, coalesce(last_7d_count, 0) AS last_7d_count,
  coalesce(engagement_score, 0) AS engagement_score, coalesce(copy_rate, 0) AS copy_rate, days_since_last
FROM users u LEFT JOIN uf USING (user_id)""")
def _(spark, d):
    table = E.user_feature_table(users(spark, d), user_feats(spark, d))
    return table.select("user_id", "total_events", "last_7d_count", "engagement_score", "copy_rate", "days_since_last")


@query("user_growth", f"""WITH {USER_BASE}
SELECT u.user_id, u.distinct_id, coalesce(total_events, 0) AS total_activities, coalesce(last_30d_count, 0) AS monthly_activity,
  coalesce(last_7d_count, 0) AS weekly_activity, round(coalesce(last_7d_count, 0) / 7.0, 6) AS avg_daily,
  greatest(0, 7 - coalesce(days_since_last, 7)) AS streak_days, coalesce(avg_input_length, 0) AS avg_length,
  coalesce(engagement_score, 0) AS engagement, coalesce(days_since_first, 0) AS journey_days, coalesce(days_since_last, 0) AS days_inactive
FROM users u LEFT JOIN uf USING (user_id)""")
def _(spark, d):
    return A.user_growth(users(spark, d), user_feats(spark, d)).withColumn("avg_daily", F.round("avg_daily", 6))


@query("user_cohort", f"""WITH {USER_BASE}
SELECT u.user_id, u.distinct_id, total_events, engagement_score, days_since_last FROM users u JOIN uf USING (user_id)
WHERE days_since_last <= 7 AND total_events >= 60 AND engagement_score >= 0.8""")
def _(spark, d):
    out = E.cohort(users(spark, d), user_feats(spark, d), max_idle_days=7, min_events=60, min_engagement=0.8)
    return out.select("user_id", "distinct_id", "total_events", "engagement_score", "days_since_last")


ITEM_BASE = f"""pr AS (SELECT item_id, user_id, count(*) AS n FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL),
ret AS (SELECT item_id, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS retention_rate FROM pr GROUP BY 1),
b AS (SELECT item_id, count(*) AS total_events, count(*) FILTER (WHERE event_name ILIKE '%run%') AS runs,
  count(*) FILTER (WHERE event_name ILIKE '%select%') AS selects, count(*) FILTER (WHERE event_name ILIKE '%copy%') AS copies,
  count(DISTINCT user_id) AS unique_users,
  count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-24 00:00:00' THEN user_id END) AS unique_users_7d,
  count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-01 00:00:00' THEN user_id END) AS unique_users_30d,
  count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00') AS n7,
  avg(response_time_ms) AS rt, {days_sql('max(event_time)')} AS idle
  FROM interactions WHERE item_id IS NOT NULL GROUP BY 1),
itf AS (SELECT item_id, total_events, runs, selects, copies, unique_users, unique_users_7d, unique_users_30d,
  round(rt, 6) AS avg_response_time_ms, round((runs + 1.5 * selects + 2.0 * copies) / total_events, 6) AS popularity_score,
  round(n7 / total_events, 6) AS trending_score, round(1.0 / (1 + idle), 6) AS freshness_score,
  round((selects + copies) / greatest(runs, 1), 6) AS success_rate,
  round(0.3 * (1 - least(rt / 10000.0, 1.0)) + 0.7 * (selects + copies) / greatest(runs, 1), 4) AS quality_score FROM b)"""
ITEM_ROUND = ["avg_response_time_ms", "popularity_score", "trending_score", "freshness_score", "success_rate", "retention_rate"]


def item_feats(spark, d):
    return E.item_features(interactions(spark, d)).withColumns(
        {**{c: F.round(c, 6) for c in ITEM_ROUND}, "quality_score": F.round("quality_score", 4)}
    )


@query("item_features", f"""WITH {ITEM_BASE} SELECT itf.*, retention_rate, peak_hour, peak_weekday FROM itf JOIN ret USING (item_id)
JOIN {mode_sql('item_id', 'CAST(hour(event_time) AS INT)', 'peak_hour')} USING (item_id)
JOIN {mode_sql('item_id', weekday(), 'peak_weekday')} USING (item_id)""")
def _(spark, d):
    return item_feats(spark, d)


@query("item_statistics", f"""WITH {ITEM_BASE},
c AS (SELECT item_id, event_name, count(*) AS n, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00') AS d7,
  count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00') AS d30 FROM interactions GROUP BY ALL),
s AS (SELECT item_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(d7) AS BIGINT) AS last_7d, CAST(sum(d30) AS BIGINT) AS last_30d,
  string_agg(event_name || ':' || n, ',' ORDER BY event_name) AS distribution FROM c GROUP BY 1)
SELECT i.item_id, i.item_name, i.category, s.events, s.last_7d, s.last_30d, s.distribution, popularity_score, trending_score
FROM items i LEFT JOIN s USING (item_id) LEFT JOIN itf USING (item_id)""")
def _(spark, d):
    out = A.item_statistics(interactions(spark, d), items(spark, d), item_feats(spark, d))
    return out.withColumn("distribution", map_text("distribution"))


@query("trending_items", f"""WITH {ITEM_BASE} SELECT i.item_id, i.item_name, i.category, trending_score, freshness_score
FROM items i JOIN itf USING (item_id) WHERE i.is_active ORDER BY trending_score DESC, item_id LIMIT 10""")
def _(spark, d):
    return E.trending_items(items(spark, d), item_feats(spark, d))


@query("category_ranks", """
WITH c AS (SELECT i.item_id, i.category, count(e.id) AS uses FROM items i LEFT JOIN interactions e USING (item_id)
  WHERE i.is_active AND i.category IS NOT NULL GROUP BY ALL)
SELECT item_id, category, uses, CAST(row_number() OVER w AS INT) AS category_rank,
  round(1.0 - (row_number() OVER w - 1) / count(*) OVER (PARTITION BY category), 6) AS category_percentile
FROM c WINDOW w AS (PARTITION BY category ORDER BY uses DESC, item_id)""")
def _(spark, d):
    out = E.category_ranks(interactions(spark, d), items(spark, d))
    return out.withColumn("category_percentile", F.round("category_percentile", 6))


@query("user_detail", f"""
WITH h AS (SELECT user_id, hour(event_time) AS v, count(*) AS n FROM interactions GROUP BY ALL),
w AS (SELECT user_id, {weekday()} AS v, count(*) AS n FROM interactions GROUP BY ALL),
c AS (SELECT e.user_id, i.category AS v, count(*) AS n FROM interactions e JOIN items i USING (item_id)
      WHERE i.category IS NOT NULL GROUP BY ALL),
hm AS (SELECT user_id, string_agg(v || ':' || n, ',' ORDER BY v) AS hour_counts FROM h GROUP BY 1),
wm AS (SELECT user_id, string_agg(v || ':' || n, ',' ORDER BY v) AS weekday_counts FROM w GROUP BY 1),
cm AS (SELECT user_id, string_agg(v || ':' || n, ',' ORDER BY v) AS category_counts FROM c GROUP BY 1),
r AS (SELECT user_id, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00') AS last_7d FROM interactions GROUP BY 1)
SELECT * FROM r JOIN hm USING (user_id) JOIN wm USING (user_id) LEFT JOIN cm USING (user_id)
JOIN {mode_sql('user_id', 'CAST(hour(event_time) AS INT)', 'peak_hour')} USING (user_id)
JOIN {mode_sql('user_id', weekday(), 'peak_weekday')} USING (user_id)""")
def _(spark, d):
    out = E.user_detail(interactions(spark, d), items(spark, d))
    return out.withColumns({c: map_text(c) for c in ("hour_counts", "weekday_counts", "category_counts")})


@query("category_preferences", """SELECT e.user_id, i.category, count(*) AS n FROM interactions e JOIN items i USING (item_id)
WHERE i.category IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return E.category_preferences(interactions(spark, d), items(spark, d))


@query("item_detail", """SELECT item_id, count(*) AS interactions, count(DISTINCT user_id) AS unique_users,
  round(count(*) / count(DISTINCT user_id), 2) AS per_user FROM interactions WHERE item_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return E.item_detail(interactions(spark, d))


PROFILES = f"""p AS (SELECT user_id, count(*) AS events, {days_sql('max(event_time)')} AS idle_days,
  count(DISTINCT item_id) / count(*) AS diversity, {days_sql('min(event_time)')} AS tenure_days FROM interactions GROUP BY 1),
prof AS (SELECT u.user_id, coalesce(events, 0) AS events, coalesce(idle_days, 999) AS idle_days,
  round(coalesce(diversity, 0), 6) AS diversity, coalesce(tenure_days, 0) AS tenure_days,
  CASE WHEN events IS NULL THEN 'new' WHEN idle_days > 30 THEN 'inactive' WHEN events <= 2 THEN 'new' WHEN events <= 9 THEN 'beginner'
       WHEN events <= 29 THEN 'regular' ELSE 'heavy' END AS segment FROM users u LEFT JOIN p USING (user_id))"""


@query("adaptive_profiles", f"WITH {PROFILES} SELECT * FROM prof")
def _(spark, d):
    return E.adaptive_profiles(interactions(spark, d), users(spark, d)).withColumn("diversity", F.round("diversity", 6))


@query("segment_distribution", f"WITH {PROFILES} SELECT segment, count(*) AS users FROM prof GROUP BY 1")
def _(spark, d):
    return E.segment_distribution(E.adaptive_profiles(interactions(spark, d), users(spark, d)))


@query("satisfaction_segments", """
WITH a AS (SELECT user_id, count(*) AS n, avg(CASE WHEN feedback = 'satisfied' THEN 1.0 ELSE 0.0 END) AS s
           FROM feedbacks WHERE processed GROUP BY 1)
SELECT user_id, n, round(s, 6) AS satisfaction, CASE WHEN n >= 10 THEN 'power' WHEN s > 0.7 THEN 'satisfied' ELSE 'new' END AS segment FROM a""")
def _(spark, d):
    return E.satisfaction_segments(load(spark, d, "feedbacks")).withColumn("satisfaction", F.round("satisfaction", 6))


# --- sessions -------------------------------------------------------------------------

SESSIONS = """g AS (SELECT *, epoch_us(event_time) / 60000000.0 - lag(epoch_us(event_time) / 60000000.0) OVER w AS gap_raw,
    lag(device_id) OVER w AS p_device, lag(tone) OVER w AS p_tone, lag(maintenance) OVER w AS p_maint,
    (epoch_us(event_time) - lag(epoch_us(event_time)) OVER w) / 1000000.0 / 60.0 AS gap
  FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY event_time, id)),
ev AS (SELECT *, CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_time, id) AS BIGINT) AS session_no,
    gap IS NULL OR gap > 30 AS starts FROM g)"""


@query("session_events", f"WITH {SESSIONS} SELECT user_id, id, session_no, starts, round(gap, 4) AS gap_minutes FROM ev")
def _(spark, d):
    out = sessions.sessionise(interactions(spark, d).select("user_id", "id", "event_time"))
    return out.select("user_id", "id", "session_no", "starts", F.round("gap_minutes", 4).alias("gap_minutes"))


@query("session_features", f"""WITH {SESSIONS},
kinds AS (SELECT user_id, session_no, event_name, count(*) AS n FROM ev GROUP BY ALL),
dist AS (SELECT user_id, session_no, string_agg(event_name || ':' || n, ',' ORDER BY event_name) AS event_counts FROM kinds GROUP BY ALL),
s AS (SELECT user_id, session_no, min(event_time) AS s0, max(event_time) AS s1, count(*) AS events, count(DISTINCT item_id) AS unique_items,
  count(*) FILTER (WHERE event_name = 'run_paraphrasing') AS runs, count(*) FILTER (WHERE event_name = 'selected_paraphrasing') AS selects,
  count(*) FILTER (WHERE event_name = 'copy_sentence') AS copies, count(DISTINCT tone) AS tone_diversity,
  count(*) FILTER (WHERE starts OR coalesce(device_id <> p_device, true)) - 1 AS device_changes,
  count(*) FILTER (WHERE starts OR coalesce(tone <> p_tone, true)) - 1 AS tone_changes,
  count(*) FILTER (WHERE starts OR coalesce(maintenance <> p_maint, true)) - 1 AS maintenance_changes,
  avg(response_time_ms) AS rt, avg(gap) AS ag, max(gap) AS mg, median(gap) AS md FROM ev GROUP BY ALL)
SELECT user_id, session_no, user_id || '_session_' || session_no AS session_id, strftime(s0, '%Y-%m-%d %H:%M:%S') AS session_start,
  events, unique_items, runs, selects, copies, tone_diversity, device_changes, tone_changes, maintenance_changes, event_counts,
  round(rt, 6) AS avg_response_time_ms, round(ag, 4) AS avg_gap, round(mg, 4) AS max_gap, round(md, 4) AS median_gap,
  round((epoch_us(s1) - epoch_us(s0)) / 60000000.0, 4) AS duration_minutes, CAST(hour(s0) AS INT) AS hour,
  CASE WHEN hour(s0) < 6 THEN 'dawn' WHEN hour(s0) < 12 THEN 'morning' WHEN hour(s0) < 18 THEN 'afternoon' WHEN hour(s0) < 22 THEN 'evening' ELSE 'night' END AS time_of_day,
  hour(s0) IN (7, 8) AS is_peak, round(unique_items / events * tone_diversity / 4.0, 6) AS exploration_score,
  round(events / greatest((epoch_us(s1) - epoch_us(s0)) / 60000000.0, 1), 4) AS events_per_minute, round(selects / greatest(runs, 1), 6) AS select_rate
FROM s JOIN dist USING (user_id, session_no)""")
def _(spark, d):
    out = sessions.session_features(interactions(spark, d)).drop("session_end")
    four = ["avg_gap", "max_gap", "median_gap", "duration_minutes", "events_per_minute"]
    six = ["avg_response_time_ms", "exploration_score", "select_rate"]
    return out.withColumns(
        {
            **{c: F.round(c, 4) for c in four},
            **{c: F.round(c, 6) for c in six},
            "event_counts": map_text("event_counts"),
            "session_start": stamp("session_start"),
        }
    )


@query("session_minutes", f"""WITH {SESSIONS},
s AS (SELECT user_id, session_no, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 60000000.0 AS m FROM ev GROUP BY ALL)
SELECT user_id, count(*) AS sessions, round(avg(m), 4) AS avg_session_minutes FROM s GROUP BY 1""")
def _(spark, d):
    rows = sessions.sessionise(interactions(spark, d).select("user_id", "id", "event_time"))
    spans = rows.groupBy("user_id", "session_no").agg(
        (tf.seconds_between(F.min("event_time"), F.max("event_time")) / 60.0).alias("duration_minutes")
    )
    return sessions.mean_session_minutes(spans).withColumn("avg_session_minutes", F.round("avg_session_minutes", 4))


GRAMS = f"""{SESSIONS},
l AS (SELECT user_id, session_no, event_time, id, event_name AS e0, lag(event_name) OVER w AS e1, lag(event_name, 2) OVER w AS e2
      FROM ev WINDOW w AS (PARTITION BY user_id, session_no ORDER BY event_time, id)),
f AS (SELECT user_id, session_no, 2 AS len, e1 || '>' || e0 AS gram, event_time, id FROM l WHERE e1 IS NOT NULL
      UNION ALL SELECT user_id, session_no, 3, e2 || '>' || e1 || '>' || e0, event_time, id FROM l WHERE e2 IS NOT NULL),
gr AS (SELECT user_id, session_no, gram, any_value(len) AS len, count(*) AS n, min(event_time) AS t0, min(id) AS i0 FROM f GROUP BY user_id, session_no, gram)"""


@query("session_common_sequences", f"""WITH {GRAMS}
SELECT user_id, session_no, gram, n, CAST(row_number() OVER (PARTITION BY user_id, session_no ORDER BY n DESC, len, t0, i0, gram) AS INT) AS rank
FROM gr QUALIFY rank <= 5""")
def _(spark, d):
    out = sessions.common_sequences(sessions.session_grams(interactions(spark, d)))
    return out.select("user_id", "session_no", F.array_join("gram", ">").alias("gram"), "n", "rank")


@query("session_sequence_scores", f"""WITH {GRAMS},
t AS (SELECT user_id, session_no, max(n) / sum(n) AS r, count(*) / sum(n) AS v FROM gr WHERE len = 3 GROUP BY ALL)
SELECT DISTINCT ev.user_id, ev.session_no, round(coalesce(r, 0), 6) AS repeat_score, round(coalesce(v, 0), 6) AS sequence_diversity
FROM ev LEFT JOIN t USING (user_id, session_no)""")
def _(spark, d):
    ev = interactions(spark, d)
    all_sessions = sessions.sessionise(ev.select("user_id", "id", "event_time")).select("user_id", "session_no").distinct()
    out = sessions.session_sequence_scores(sessions.session_grams(ev), all_sessions)
    return out.withColumns({c: F.round(c, 6) for c in ("repeat_score", "sequence_diversity")})


@query("frequent_sequences", """
WITH l AS (SELECT user_id, event_name AS e0, lag(event_name) OVER w AS e1, lag(event_name, 2) OVER w AS e2, lag(event_name, 3) OVER w AS e3,
             lag(event_name, 4) OVER w AS e4 FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY event_time, id)),
f AS (SELECT user_id, e1 || '>' || e0 AS seq FROM l UNION ALL SELECT user_id, e2 || '>' || e1 || '>' || e0 FROM l
      UNION ALL SELECT user_id, e3 || '>' || e2 || '>' || e1 || '>' || e0 FROM l
      UNION ALL SELECT user_id, e4 || '>' || e3 || '>' || e2 || '>' || e1 || '>' || e0 FROM l)
SELECT user_id, seq, count(*) AS n FROM f WHERE seq IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    out = sessions.frequent_sequences(interactions(spark, d))
    return out.select("user_id", F.array_join("seq", ">").alias("seq"), "n")


@query("gap_statistics", """
WITH g AS (SELECT user_id, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY user_id ORDER BY event_time, id)) / 60000000.0 AS gap
           FROM interactions WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00'),
s AS (SELECT user_id, avg(gap) AS a, min(gap) AS mi, max(gap) AS ma, stddev_pop(gap) AS sd, count(gap) AS n, median(gap) AS md
      FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT u.user_id, round(coalesce(a, 0), 4) AS avg_gap, round(coalesce(mi, 0), 4) AS min_gap, round(coalesce(ma, 0), 4) AS max_gap,
  round(coalesce(sd, 0), 4) AS std_gap, coalesce(n, 0) AS gaps, round(coalesce(md, 0), 4) AS median_gap FROM users u LEFT JOIN s USING (user_id)""")
def _(spark, d):
    out = sessions.gap_statistics(interactions(spark, d), users(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_gap")})


SWITCH = ", ".join(
    f"count(*) FILTER (WHERE p IS NULL OR coalesce({c} <> p_{c}, true)) - 1 AS {c.removesuffix('_id')}_switches" for c in sessions.ATTRIBUTES
)
SWITCH_RATES = ", ".join(
    f"round({c.removesuffix('_id')}_switches / greatest(events - 1, 1), 6) AS {c.removesuffix('_id')}_switch_rate" for c in sessions.ATTRIBUTES
)


@query("context_switches", f"""
WITH l AS (SELECT *, lag(id) OVER w AS p, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in sessions.ATTRIBUTES)} FROM interactions
  WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' WINDOW w AS (PARTITION BY user_id ORDER BY event_time, id)),
s AS (SELECT user_id, count(*) AS events, count(DISTINCT tone) AS tone_diversity, {SWITCH} FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT *, {SWITCH_RATES} FROM s""")
def _(spark, d):
    out = sessions.context_switches(interactions(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate")})


# --- temporal patterns ----------------------------------------------------------------


def pattern_sql(key):
    hours = " || ',' || ".join(f"CAST(CAST(round(100000 * count(*) FILTER (WHERE hour(event_time) = {h}) / count(*)) AS INT) AS VARCHAR)" for h in range(24))
    days = " || ',' || ".join(f"CAST(CAST(round(100000 * count(*) FILTER (WHERE isodow(event_time) = {w + 1}) / count(*)) AS INT) AS VARCHAR)" for w in range(7))
    share = lambda c: f"round(count(*) FILTER (WHERE {c}) / count(*), 6)"
    return f"""WITH p AS (SELECT {key}, count(*) AS total, {hours} AS hour_shares, {days} AS weekday_shares,
  {share('hour(event_time) BETWEEN 6 AND 11')} AS morning_ratio, {share('hour(event_time) BETWEEN 12 AND 17')} AS afternoon_ratio,
  {share('hour(event_time) BETWEEN 18 AND 21')} AS evening_ratio, {share('hour(event_time) >= 22 OR hour(event_time) < 6')} AS night_ratio,
  {share('isodow(event_time) <= 5')} AS weekday_ratio, {share('isodow(event_time) > 5')} AS weekend_ratio,
  {share('hour(event_time) BETWEEN 9 AND 17 AND isodow(event_time) <= 5')} AS business_hours_ratio,
  {share('isodow(event_time) <= 5')} AS business_hours_ratio_legacy FROM interactions
  WHERE event_time >= {T0} - INTERVAL 90 DAYS AND {key} IS NOT NULL GROUP BY 1)
SELECT * FROM p JOIN {mode_sql(key, 'CAST(hour(event_time) AS INT)', 'peak_hour')} USING ({key})
JOIN {mode_sql(key, weekday(), 'peak_weekday')} USING ({key})"""


def pattern_query(spark, d, key):
    ev = interactions(spark, d).filter(F.col(key).isNotNull())
    out = temporal.temporal_patterns(ev, key)
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 100000, 0).cast("int").cast("string")), ",").alias(c)
    ratios = [c for c in out.columns if "_ratio" in c]
    return out.select(key, "total", as_text("hour_shares"), as_text("weekday_shares"), "peak_hour", "peak_weekday", *r6(*ratios))


@query("user_temporal_patterns", pattern_sql("user_id"))
def _(spark, d):
    return pattern_query(spark, d, "user_id")


@query("item_temporal_patterns", pattern_sql("item_id"))
def _(spark, d):
    return pattern_query(spark, d, "item_id")


AFFINITY = """uh AS (SELECT user_id, hour(event_time) AS h, count(*) AS n FROM interactions GROUP BY ALL),
ud AS (SELECT user_id, isodow(event_time) AS h, count(*) AS n FROM interactions GROUP BY ALL),
ih AS (SELECT item_id, hour(event_time) AS h, count(*) AS n FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL),
idd AS (SELECT item_id, isodow(event_time) AS h, count(*) AS n FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL),
nuh AS (SELECT user_id, sqrt(sum(n * n)) AS s, arg_max(h, n * 100 - h) AS peak FROM uh GROUP BY 1), nud AS (SELECT user_id, sqrt(sum(n * n)) AS s FROM ud GROUP BY 1),
nih AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM ih GROUP BY 1), nid AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM idd GROUP BY 1),
prs AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE item_id IS NOT NULL),
hs AS (SELECT p.user_id, p.item_id, sum(a.n * b.n) AS x FROM prs p JOIN uh a USING (user_id) JOIN ih b ON b.item_id = p.item_id AND a.h = b.h GROUP BY ALL),
ds AS (SELECT p.user_id, p.item_id, sum(a.n * b.n) AS x FROM prs p JOIN ud a USING (user_id) JOIN idd b ON b.item_id = p.item_id AND a.h = b.h GROUP BY ALL),
aff AS (SELECT user_id, item_id, 0.7 * (coalesce(hs.x, 0) / (nuh.s * nih.s) + 1) / 2 + 0.3 * (coalesce(ds.x, 0) / (nud.s * nid.s) + 1) / 2 AS base,
  least(abs(9 - nuh.peak), 24 - abs(9 - nuh.peak)) AS dist
  FROM prs LEFT JOIN hs USING (user_id, item_id) LEFT JOIN ds USING (user_id, item_id) JOIN nuh USING (user_id) JOIN nud USING (user_id)
  JOIN nih USING (item_id) JOIN nid USING (item_id))"""


@query("temporal_affinity", f"""WITH {AFFINITY}
SELECT user_id, item_id, round(base * CASE WHEN dist <= 2 THEN 1 - dist / 3.0 * 0.2 ELSE 1 END, 6) AS affinity FROM aff""")
def _(spark, d):
    ev = interactions(spark, d).filter(F.col("item_id").isNotNull())
    pairs = ev.select("user_id", "item_id").distinct()
    up, ip = temporal.temporal_patterns(interactions(spark, d), "user_id"), temporal.temporal_patterns(ev, "item_id")
    return temporal.pair_affinity(pairs, up, ip, now_hour=9).withColumn("affinity", F.round("affinity", 6))


# --- context and scalar functions ------------------------------------------------------

TOD_SQL = """CASE WHEN hour({0}) < 6 THEN 'dawn' WHEN hour({0}) < 12 THEN 'morning' WHEN hour({0}) < 18 THEN 'afternoon'
  WHEN hour({0}) < 22 THEN 'evening' ELSE 'night' END"""


@query("event_time_context", f"""
SELECT id, CAST(hour(event_time) AS INT) AS hour, {weekday()} AS day_of_week, {TOD_SQL.format('event_time')} AS time_of_day,
  CASE WHEN isodow(event_time) > 5 THEN 'weekend' ELSE 'weekday' END AS day_type,
  hour(event_time) BETWEEN 9 AND 17 AND isodow(event_time) <= 5 AS is_business_hours, isodow(event_time) > 5 AS is_weekend,
  hour(event_time) IN (7, 8) AS is_peak_hours,
  CASE WHEN hour(event_time) < 6 THEN 'creative' WHEN hour(event_time) < 12 THEN 'focused' WHEN hour(event_time) < 18 THEN 'expansive'
       WHEN hour(event_time) < 22 THEN 'emotional' ELSE 'neutral' END AS recommendation_tone FROM interactions""")
def _(spark, d):
    return interactions(spark, d).select("id", context.temporal_context(F.col("event_time")).alias("t")).select("id", "t.*")


@query("event_device_context", """
SELECT id, CASE WHEN os LIKE 'Mac%' THEN 'mac' WHEN os LIKE 'Windows%' THEN 'desktop' ELSE 'tablet' END AS device_type,
  browser AS browser_family, CASE WHEN os LIKE 'Mac%' THEN 'Mac OS X' WHEN os LIKE 'Windows%' THEN 'Windows' ELSE 'Other' END AS os_family,
  device_id, os LIKE 'Mac%' AS is_mac, os LIKE 'Windows%' AS is_desktop, os = 'iPad' AS is_tablet,
  coalesce(browser = 'Chrome', false) AS is_chrome, coalesce(browser = 'Whale', false) AS is_whale,
  coalesce(browser IN ('Chrome', 'Whale'), false) AS is_major_browser FROM interactions""")
def _(spark, d):
    c = context.device_context(F.col("browser"), F.col("os"), F.col("device_id"))
    return interactions(spark, d).select("id", c.alias("t")).select("id", "t.*")


@query("user_regions", """SELECT user_id, country_code,
  CASE country_code WHEN 'KR' THEN 'Asia' WHEN 'US' THEN 'Americas' WHEN 'DE' THEN 'Europe' END AS region,
  coalesce(country_code = 'KR', false) AS is_korea FROM users""")
def _(spark, d):
    c = F.col("country_code")
    return users(spark, d).select("user_id", "country_code", dev.region(c).alias("region"), dev.is_korea(c).alias("is_korea"))


@query("user_latest_context", f"""
WITH {SESSIONS},
le AS (SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) = 1),
ss AS (SELECT user_id, session_no, count(*) AS n, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 60000000.0 AS m FROM ev GROUP BY user_id, session_no
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) = 1),
td AS (SELECT user_id, count(DISTINCT tone) AS tone_diversity FROM interactions GROUP BY 1)
SELECT user_id, {TOD_SQL.format('le.event_time')} AS time_of_day, n AS events_in_session, round(m, 4) AS session_minutes, le.event_name AS last_event,
  CASE WHEN n = 0 THEN 'new' WHEN n < 5 THEN 'low' WHEN n < 15 THEN 'medium' WHEN n < 50 THEN 'high' ELSE 'power' END AS activity_level,
  CASE WHEN m < 2 THEN 'exploring' WHEN m < 10 THEN 'active' WHEN m < 30 THEN 'engaged' ELSE 'deep_work' END AS engagement_level,
  CASE u.country_code WHEN 'KR' THEN 'Asia' WHEN 'US' THEN 'Americas' WHEN 'DE' THEN 'Europe' END AS region,
  tone_diversity, tone_diversity <= 1 AS is_single_tone_user, tone_diversity <= 2 AS needs_exploration
FROM le JOIN ss USING (user_id) JOIN td USING (user_id) LEFT JOIN users u USING (user_id)""")
def _(spark, d):
    ev = interactions(spark, d)
    rows = sessions.sessionise(ev.select("user_id", "id", "event_time"))
    spans = rows.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("events"),
        (tf.seconds_between(F.min("event_time"), F.max("event_time")) / 60.0).alias("duration_minutes"),
    )
    prefs = skew.modes(
        ev,
        ["user_id"],
        {"preferred_tone": F.col("tone"), "preferred_maintenance": F.col("maintenance"), "preferred_language": F.col("target_language")},
        distinct=["preferred_tone"],
    ).withColumnRenamed("n_preferred_tone", "tone_diversity")
    out = context.latest_context(ev, users(spark, d), spans, prefs)
    return out.select(
        "user_id",
        "temporal.time_of_day",
        "session.events_in_session",
        F.round("session.session_duration_minutes", 4).alias("session_minutes"),
        F.col("session.last_event_name").alias("last_event"),
        "session.activity_level",
        "session.engagement_level",
        "location.region",
        "user_preference.tone_diversity",
        "user_preference.is_single_tone_user",
        "user_preference.needs_exploration",
    )


@query("event_ages", f"""
WITH a AS (SELECT id, (epoch_us({T0}) - epoch_us(event_time)) / 1000000.0 AS s FROM interactions)
SELECT id, CASE WHEN s < 1 THEN printf('%.2f', s * 1000) || 'ms' WHEN s < 60 THEN printf('%.2f', s) || 's'
  WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || printf('%.2f', s % 60) || 's'
  WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s % 3600) / 60) AS BIGINT) || 'm'
  ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ' || CAST(floor((s % 86400) / 3600) AS BIGINT) || 'h' END AS age,
  CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || ' seconds ago'
       WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || CASE WHEN floor(s / 60) = 1 THEN ' minute ago' ELSE ' minutes ago' END
       WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || CASE WHEN floor(s / 3600) = 1 THEN ' hour ago' ELSE ' hours ago' END
       WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || CASE WHEN floor(s / 86400) = 1 THEN ' day ago' ELSE ' days ago' END
       ELSE CAST(floor(s / 2592000) AS BIGINT) || CASE WHEN floor(s / 2592000) = 1 THEN ' month ago' ELSE ' months ago' END END AS said,
  round(s / 3600, 4) AS hours, round(exp(-floor(s / 86400) / 30.0), 6) AS day_decay, round(exp(-s / 3600 / 24.0), 6) AS hour_decay
FROM a""")
def _(spark, d):
    now, ts = tf.as_ts(AS_OF), F.col("event_time")
    rows = interactions(spark, d).withColumn("s", tf.seconds_between(ts, now))
    age = text.format_duration(F.col("s"))
    return rows.select(
        "id",
        F.when(F.col("s") < 86_400, F.regexp_replace(age, " [0-9]+s$", "")).otherwise(age).alias("age"),
        text.relative_time(F.col("s")).alias("said"),
        F.round(tf.time_difference(ts, now, "hours"), 4).alias("hours"),
        F.round(tf.day_decay(ts, now), 6).alias("day_decay"),
        F.round(tf.hour_decay(ts, now, 24), 6).alias("hour_decay"),
    )


@query("hourly_calendar", f"""
WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS h),
e AS (SELECT date_trunc('hour', event_time) AS h, count(*) AS n FROM interactions GROUP BY 1)
SELECT strftime(c.h, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(n, 0) AS n FROM c LEFT JOIN e USING (h)""")
def _(spark, d):
    calendar = tf.time_range(spark, "2024-01-01 00:00:00", "2024-01-30 23:00:00", "1 HOUR").withColumnRenamed("ts", "h")
    counts = interactions(spark, d).groupBy(F.date_trunc("hour", "event_time").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    joined = calendar.join(counts, "h", "left")
    return joined.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


LABEL_SQL = "CASE event_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.EVENT_LABELS.items()) + " ELSE event_name END"


@query("event_labels", f"SELECT event_name, {LABEL_SQL} AS label, count(*) AS n FROM interactions GROUP BY ALL")
def _(spark, d):
    counts = A.event_distribution(interactions(spark, d))
    return counts.select("event_name", text.event_label(F.col("event_name")).alias("label"), "n")


@query("event_context_hash", """
SELECT id, substr(sha256('{' || coalesce('"browser":"' || browser || '",', '') || '"hour":' || hour(event_time) || ',"os":"' || os || '"}'), 1, 16) AS context_hash
FROM interactions""")
def _(spark, d):
    ctx = F.struct("browser", F.hour("event_time").alias("hour"), "os")
    return interactions(spark, d).select("id", text.context_hash(ctx).alias("context_hash"))


@query("item_embedding_to_first", """
WITH q AS (SELECT embedding AS qv FROM items WHERE item_id = 0)
SELECT item_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 5) AS raw,
  round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) + 1) / 2, 5) AS unit FROM items, q WHERE embedding IS NOT NULL""")
def _(spark, d):
    it = items(spark, d).filter(F.col("embedding").isNotNull())
    first = it.filter("item_id = 0").select("embedding").first()[0]
    scored = it.withColumn("raw", vectors.cosine(F.col("embedding"), F.lit(first)))
    return scored.select("item_id", F.round("raw", 5).alias("raw"), F.round((F.col("raw") + 1) / 2, 5).alias("unit"))


@query("event_context_vectors")
def _(spark, d):
    # The vectors depend on hour, weekday and device only: at most 24 x 7 x 4 different ones.
    rows = interactions(spark, d).select(
        "id", "item_id", "event_time", F.hour("event_time").alias("h"), F.weekday("event_time").alias("w"), dev.device_type(F.col("os")).alias("kind")
    )
    ts = F.col("ts")
    kinds = rows.groupBy("h", "w", "kind").agg(F.min("event_time").alias("ts"))
    vecs = kinds.select("h", "w", "kind", vectors.short_context_vector(ts, F.col("kind")).alias("short"), vectors.long_context_vector(ts, F.col("kind")).alias("long"))
    # So does the match of an item with them: it is worked out once per item and kind, not once per event.
    by = ["item_id", "h", "w", "kind"]
    met = rows.select(*by).distinct().join(F.broadcast(vecs), ["h", "w", "kind"]).join(items(spark, d).select("item_id", "embedding"), "item_id")
    # Written before the match: Spark may try to evaluate a Python function over lambda expressions by itself and fail.
    fused = vectors.fuse(F.col("embedding"), F.col("long")).alias("fused")
    shorts = F.array_join(F.transform("short", lambda x: F.round(x, 4)), ",").alias("short_vector")
    ready = stage(met.select(*by, shorts, "embedding", fused), "context-vectors")
    matches = ready.select(*by, "short_vector", F.round(vectors.cosine(F.col("embedding"), F.col("fused")), 5).alias("fused_match"))
    return rows.join(stage(matches, "context-matches"), by).select("id", "short_vector", "fused_match")


@query("nearest_items", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM items WHERE item_id = 0)
SELECT item_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 5) AS sim FROM items, q WHERE embedding IS NOT NULL AND item_id NOT IN (0, 5)
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, item_id LIMIT 10""")
def _(spark, d):
    it = items(spark, d)
    first = it.filter("item_id = 0").select("embedding").first()[0]
    return vectors.nearest(it, first, 10, exclude=[0, 5]).withColumn("sim", F.round("sim", 5))


@query("event_properties", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(spark, d):
    props = F.try_parse_json(F.col("props"))
    return raw(spark, d, "events").select(F.col("event_id").alias("id"), F.try_variant_get(props, "$.k", "int").alias("k"))
