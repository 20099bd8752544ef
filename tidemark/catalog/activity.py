"""Queries of the activity panels."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.inputs import interactions, items, users
from tidemark.operators import activity as A

DAY = "strftime({0}, '%Y-%m-%d')"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def day(col="day"):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


@query("event_distribution", """
SELECT event_name, count(*) AS n FROM interactions
WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL""")
def _(spark, d):
    return A.event_distribution(interactions(spark, d), days=7)


@query("event_distribution_per_user", "SELECT user_id, event_name, count(*) AS n FROM interactions GROUP BY ALL")
def _(spark, d):
    return A.event_distribution(interactions(spark, d), by=["user_id"])


@query("hourly_activity", """
SELECT CAST(hour(event_time) AS INT) AS hour, count(*) AS n, round(avg(response_time_ms), 6) AS avg_response,
       count(DISTINCT user_id) AS unique_users
FROM interactions WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1""")
def _(spark, d):
    return A.hourly_activity(interactions(spark, d)).select("hour", "n", *r6("avg_response"), "unique_users")


@query("daily_rhythm", """
SELECT strftime(event_time, '%Y-%m-%d') AS day, event_name, count(*) AS n, count(DISTINCT user_id) AS unique_users
FROM interactions WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY ALL""")
def _(spark, d):
    return A.daily_rhythm(interactions(spark, d)).withColumn("day", day())


RHYTHM = """
WITH r AS (SELECT strftime(event_time, '%Y-%m-%d') AS day, event_name, count(*) AS n, count(DISTINCT user_id) AS u
           FROM interactions WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY ALL),
s AS (SELECT day, CAST(sum(n) AS BIGINT) AS total, max(u) AS peak_users FROM r GROUP BY day)
"""


@query("daily_summary", RHYTHM + "SELECT * FROM s")
def _(spark, d):
    return A.daily_summary(A.daily_rhythm(interactions(spark, d))).withColumn("day", day())


@query("daily_summary_totals", RHYTHM + """
SELECT round(avg(total), 6) AS mean_per_day, max(total) AS max_per_day, round(avg(peak_users), 6) AS mean_users,
       max(peak_users) AS max_users FROM s""")
def _(spark, d):
    out = A.daily_summary_totals(A.daily_rhythm(interactions(spark, d)))
    return out.select(*r6("mean_per_day"), "max_per_day", *r6("mean_users"), "max_users")


@query("period_distribution", """
WITH p AS (SELECT CASE WHEN hour(event_time) BETWEEN 5 AND 7 THEN 'dawn' WHEN hour(event_time) BETWEEN 8 AND 11 THEN 'morning'
  WHEN hour(event_time) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(event_time) BETWEEN 18 AND 21 THEN 'evening'
  ELSE 'night' END AS period FROM interactions WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00')
SELECT period, count(*) AS n, CAST(CASE period WHEN 'dawn' THEN 1 WHEN 'morning' THEN 2 WHEN 'afternoon' THEN 3
  WHEN 'evening' THEN 4 ELSE 5 END AS INT) AS ordinal FROM p GROUP BY ALL""")
def _(spark, d):
    return A.period_distribution(interactions(spark, d))


@query("average_response_by_event", """
SELECT event_name, round(avg(response_time_ms), 6) AS avg_response, count(*) AS n FROM interactions
WHERE response_time_ms IS NOT NULL GROUP BY event_name""")
def _(spark, d):
    return A.average_response(interactions(spark, d), ["event_name"]).select("event_name", *r6("avg_response"), "n")


@query("browser_distribution", "SELECT browser AS value, count(*) AS n FROM interactions WHERE browser IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.value_distribution(interactions(spark, d), "browser")


@query("tone_distribution", """SELECT tone AS value, count(*) AS n FROM interactions
WHERE tone IS NOT NULL AND event_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1""")
def _(spark, d):
    return A.value_distribution(interactions(spark, d), "tone", days=30)


@query("diversity_score", """
WITH c AS (SELECT user_id, event_name, count(*) AS n FROM interactions
           WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL),
t AS (SELECT user_id, sum(n) AS tot FROM c GROUP BY user_id),
h AS (SELECT user_id, CAST(any_value(tot) AS BIGINT) AS events, -sum((n / tot) * ln(n / tot)) AS e
      FROM c JOIN t USING (user_id) GROUP BY user_id)
SELECT user_id, events, abs(round(e, 6)) AS entropy, abs(round(greatest(0, least(100, e * 100 / 1.6)), 6)) AS score FROM h""")
def _(spark, d):
    out = A.diversity_score(interactions(spark, d))
    return out.select("user_id", "events", *[F.abs(F.round(c, 6)).alias(c) for c in ("entropy", "score")])


KPI = """
SELECT count(*) AS total_events, count(DISTINCT user_id) AS active_users,
       count(DISTINCT CAST(event_time AS DATE)) AS active_days, round(avg(response_time_ms), 6) AS avg_response,
       count(DISTINCT event_name) AS event_types, (SELECT count(*) FROM users) AS total_users
FROM interactions WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00'"""


@query("kpi_summary", KPI)
def _(spark, d):
    return A.kpi_summary(interactions(spark, d), users(spark, d)).withColumn("avg_response", F.round("avg_response", 6))


@query("growth_dashboard_totals", f"""
WITH k AS ({KPI}) SELECT total_users, active_users, round(active_users / total_users * 100, 6) AS activity_rate FROM k""")
def _(spark, d):
    out = A.growth_dashboard_totals(A.kpi_summary(interactions(spark, d), users(spark, d)))
    return out.withColumn("activity_rate", F.round("activity_rate", 6))


@query("user_statistics", """
WITH c AS (SELECT user_id, event_name, count(*) AS n, max(event_time) AS last FROM interactions GROUP BY ALL),
s AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS events, max(last) AS last_event,
      string_agg(event_name || ':' || n, ',' ORDER BY event_name) AS distribution FROM c GROUP BY user_id)
SELECT u.user_id, u.distinct_id, u.country_code, u.account_type, coalesce(s.events, 0) AS events,
       strftime(s.last_event, '%Y-%m-%d %H:%M:%S') AS last_event, s.distribution
FROM users u LEFT JOIN s USING (user_id)""")
def _(spark, d):
    out = A.user_statistics(interactions(spark, d), users(spark, d))
    return out.select("user_id", "distinct_id", "profile.*", "events", stamp("last_event"), map_text("distribution"))


def map_text(col):
    pairs = F.transform(F.map_entries(col), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return F.when(F.col(col).isNotNull(), F.array_join(pairs, ",")).alias(col)


@query("category_distribution", "SELECT category, count(*) AS n FROM items WHERE category IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.category_distribution(items(spark, d))


@query("system_totals", """
WITH b AS (SELECT count(*) AS total_events, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00') AS events_7d,
  count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-24 00:00:00' THEN user_id END) AS active_users_7d FROM interactions)
SELECT *, (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM items) AS total_items,
  round(total_events / (SELECT count(*) FROM users), 6) AS events_per_user,
  round(events_7d / greatest(active_users_7d, 1), 6) AS events_7d_per_active FROM b""")
def _(spark, d):
    out = A.system_totals(interactions(spark, d), users(spark, d), items(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("events_per_user", "events_7d_per_active")})


@query("active_users", """
SELECT count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-30 11:55:00' THEN user_id END) AS active_5m,
       count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-30 11:00:00' THEN user_id END) AS active_1h,
       count(DISTINCT CASE WHEN event_time >= TIMESTAMP '2024-01-29 12:00:00' THEN user_id END) AS active_24h
FROM interactions WHERE event_time <= TIMESTAMP '2024-01-30 12:00:00'""")
def _(spark, d):
    return A.active_users(interactions(spark, d), as_of="2024-01-30 12:00:00")


@query("user_types", """
WITH c AS (SELECT u.user_id, count(i.id) AS events FROM users u LEFT JOIN interactions i USING (user_id) GROUP BY 1)
SELECT user_id, events,
  CASE WHEN events >= 50 THEN 'power' WHEN events >= 15 THEN 'growth' WHEN events >= 1 THEN 'casual' ELSE 'new' END AS user_type,
  CASE WHEN events >= 50 THEN 'soft_loop' WHEN events >= 15 THEN 'context_echo' WHEN events >= 1 THEN 'ghost_preview' ELSE 'ambient' END AS style
FROM c""")
def _(spark, d):
    return A.user_types(interactions(spark, d), users(spark, d))


@query("activity_counts", """
SELECT u.user_id, u.distinct_id, count(i.id) AS events FROM users u LEFT JOIN interactions i USING (user_id) GROUP BY ALL""")
def _(spark, d):
    return A.activity_counts(interactions(spark, d), users(spark, d))


@query("dashboard_segments", """
WITH c AS (SELECT u.user_id, count(i.id) AS n FROM users u LEFT JOIN interactions i USING (user_id) GROUP BY 1)
SELECT CASE WHEN n <= 4 THEN 'new' WHEN n <= 19 THEN 'exploring' WHEN n <= 49 THEN 'growing' ELSE 'power' END AS segment,
  count(*) AS users FROM c GROUP BY 1""")
def _(spark, d):
    return A.dashboard_segments(interactions(spark, d), users(spark, d))


@query("top_users", """
SELECT u.user_id, u.distinct_id, count(i.id) AS events, strftime(max(i.event_time), '%Y-%m-%d %H:%M:%S') AS last_event
FROM users u JOIN interactions i USING (user_id) WHERE i.event_time >= TIMESTAMP '2024-01-24 00:00:00'
GROUP BY ALL ORDER BY events DESC, user_id LIMIT 10""")
def _(spark, d):
    out = A.top_users(interactions(spark, d), users(spark, d), days=7)
    return out.withColumn("last_event", stamp("last_event"))


@query("new_user_flags", """
SELECT u.user_id, count(i.id) AS events, count(i.id) <= 2 AS is_new
FROM users u LEFT JOIN interactions i USING (user_id) GROUP BY 1""")
def _(spark, d):
    return A.new_user_flags(interactions(spark, d), users(spark, d))


COUNT_SUMMARY = """
WITH c AS (SELECT {0}, count(*) AS n FROM interactions WHERE {0} IS NOT NULL GROUP BY 1)
SELECT count(*) AS keys, round(avg(n), 6) AS mean_n, median(n) AS median_n, min(n) AS min_n, max(n) AS max_n FROM c"""


@query("events_per_user_summary", COUNT_SUMMARY.format("user_id"))
def _(spark, d):
    return A.interaction_count_summary(interactions(spark, d), "user_id").withColumn("mean_n", F.round("mean_n", 6))


@query("events_per_item_summary", COUNT_SUMMARY.format("item_id"))
def _(spark, d):
    return A.interaction_count_summary(interactions(spark, d), "item_id").withColumn("mean_n", F.round("mean_n", 6))


@query("top_items_with_share", """
SELECT item_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM interactions WHERE item_id IS NOT NULL), 6) AS share
FROM interactions WHERE item_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10""")
def _(spark, d):
    return A.top_items_with_share(interactions(spark, d)).withColumn("share", F.round("share", 6))


@query("filtered_count", """
SELECT count(*) AS rows, count(*) FILTER (WHERE event_name = 'copy_sentence') AS matching,
       bool_or(event_name = 'copy_sentence') AS exists FROM interactions""")
def _(spark, d):
    return A.filtered_count(interactions(spark, d), F.col("event_name") == "copy_sentence")


@query("growth_timeline", """
WITH c AS (SELECT user_id, strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n FROM interactions
           WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY ALL)
SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS cumulative FROM c""")
def _(spark, d):
    return A.growth_timeline(interactions(spark, d)).withColumn("day", day())


@query("recent_repetitions", """
WITH l AS (SELECT user_id, event_name, lag(event_name) OVER (PARTITION BY user_id ORDER BY event_time, id) AS prev,
             row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) AS rn FROM interactions)
SELECT user_id, event_name, count(*) AS repetitions FROM l WHERE rn <= 10 AND event_name = prev GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    return A.recent_repetitions(interactions(spark, d), last_n=10, min_repeats=2)


@query("early_runs", """
WITH p AS (SELECT user_id, event_name, event_time, row_number() OVER (PARTITION BY user_id ORDER BY event_time, id) AS pos FROM interactions),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_name ORDER BY pos) AS island FROM p WHERE pos <= 100)
SELECT user_id, event_name, count(*) AS run_length, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS start,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS "end" FROM q GROUP BY user_id, event_name, island HAVING count(*) >= 3""")
def _(spark, d):
    return A.early_runs(interactions(spark, d)).withColumns({"start": stamp("start"), "end": stamp("end")})


@query("item_reach", """
SELECT item_id, count(DISTINCT user_id) AS unique_users, arg_min(user_id, event_time) AS first_user
FROM interactions WHERE item_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return A.item_reach(interactions(spark, d))


@query("first_use", """
SELECT user_id, item_id, id AS first_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS first_time FROM interactions
WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_time, id) = 1""")
def _(spark, d):
    return A.first_use(interactions(spark, d)).withColumn("first_time", stamp("first_time"))


@query("last_use", """
SELECT user_id, item_id, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_time,
       epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(event_time)) < 86400 AS recent
FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return A.last_use(interactions(spark, d)).withColumn("last_time", stamp("last_time"))


@query("recent_events", """
SELECT user_id, id, event_name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) AS INT) AS rank
FROM interactions QUALIFY rank <= 10""")
def _(spark, d):
    return A.recent_events(interactions(spark, d)).select("user_id", "id", "event_name", "rank")


@query("recent_events_in_hours", """
SELECT user_id, id, event_name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) AS INT) AS rank
FROM interactions WHERE event_time >= TIMESTAMP '2024-01-28 00:00:00' QUALIFY rank <= 20""")
def _(spark, d):
    return A.recent_events(interactions(spark, d), k=20, hours=72).select("user_id", "id", "event_name", "rank")


@query("context_flow", """
SELECT user_id, id, event_name, tone, maintenance, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_time, id) AS INT) AS rank
FROM interactions QUALIFY rank <= 20""")
def _(spark, d):
    out = A.recent_events(interactions(spark, d), k=20, newest_first=False)
    return out.select("user_id", "id", "event_name", "tone", "maintenance", "rank")


@query("popular_items", """
SELECT i.item_id, i.item_name, i.category, count(*) AS uses FROM items i JOIN interactions e USING (item_id)
WHERE i.is_active AND e.event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL ORDER BY uses DESC, item_id LIMIT 10""")
def _(spark, d):
    return A.popular_items(interactions(spark, d), items(spark, d), days=7)


@query("recently_seen_users", """
SELECT u.user_id, u.distinct_id, strftime(max(e.event_time), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM users u JOIN interactions e USING (user_id) GROUP BY ALL
HAVING max(e.event_time) >= TIMESTAMP '2024-01-01 00:00:00' ORDER BY max(e.event_time) DESC, user_id LIMIT 100""")
def _(spark, d):
    out = A.recently_seen_users(interactions(spark, d), users(spark, d))
    return out.withColumn("last_seen", stamp("last_seen"))


@query("active_items_by_category", """
WITH c AS (SELECT i.item_id, i.item_name, i.category, count(e.id) AS uses FROM items i LEFT JOIN interactions e USING (item_id)
           WHERE i.is_active GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY uses DESC, item_id) AS INT) AS rank FROM c QUALIFY rank <= 5""")
def _(spark, d):
    return A.active_items_by(items(spark, d), interactions(spark, d), "category")
