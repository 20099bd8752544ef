"""Queries of cleaning, validation, quality, loading and joins.

Raw records are derived from the sample tables: padded texts, empty words, suffixed
columns, epoch times and repeated records, so that every cleaning rule has work to do.
"""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.activity import stamp
from tidemark.catalog.features import ITEM_BASE, USER_BASE, item_feats, user_feats
from tidemark.catalog.registry import query
from tidemark.functions.stage import stage, stage_dir
from tidemark.inputs import interactions, items, load, raw, users
from tidemark.operators import cf, cleaning, cooccurrence, joins, quality, sessions, validation
from tidemark.operators import entity_features as E
from tidemark.plans import etl
from tidemark.sources import files, tables
from tidemark.sources.buckets import BucketTable


def raw_events(spark, d):
    ev = interactions(spark, d)
    i = F.col("id")
    once = ev.select(
        F.concat(F.lit(" "), "event_name").alias("event_name"),
        F.when(i % 50 == 7, "null").otherwise(F.concat(F.lit("u-"), F.col("user_id").cast("string"), F.lit(" "))).alias("distinct_id"),
        "insert_id",
        F.when(i % 97 == 3, F.lit(None)).otherwise(F.unix_seconds("event_time")).cast("string").alias("time"),
        F.struct(
            F.when(i % 11 == 0, "nan").otherwise(F.col("tone")).alias("tone_m1"),
            F.lit("other").alias("tone_m2"),
            "maintenance",
            "browser",
            "os",
            F.when(i % 3 == 0, F.lit(0)).otherwise(F.col("response_time_ms")).alias("response_time_ms"),
            F.lit(2).alias("response_time_seconds"),
            F.when(i % 2 == 0, "openai").alias("llm_info_provider"),
            F.lit("ignored").alias("insert_id"),
        ).alias("properties"),
    )
    return once.unionByName(once.filter(F.col("insert_id").endswith("5")))


CLEAN_EVENTS = """ce AS (SELECT event_name, 'u-' || user_id AS distinct_id, insert_id, event_time,
  CASE event_name WHEN 'run_paraphrasing' THEN 'action' WHEN 'selected_paraphrasing' THEN 'action' WHEN 'copy_sentence' THEN 'copy' ELSE 'other' END AS event_type,
  CASE WHEN event_name IN ('run_paraphrasing', 'selected_paraphrasing', 'copy_sentence') THEN 'interaction' ELSE 'other' END AS interaction_category,
  CAST(hour(event_time) AS INT) AS hour_of_day, dayname(event_time) AS day_of_week, isodow(event_time) > 5 AS is_weekend,
  CASE WHEN id % 11 = 0 THEN NULL ELSE tone END AS tone, maintenance, CAST(CASE WHEN id % 3 = 0 OR response_time_ms = 0 THEN 2000 ELSE response_time_ms END AS INT) AS response_time_ms,
  CASE WHEN id % 2 = 0 THEN 'openai' END AS llm_provider, user_id FROM interactions WHERE id % 50 <> 7 AND id % 97 <> 3)"""


def clean(spark, d):
    return cleaning.clean_events(files.flatten_records(raw_events(spark, d)))


@query("clean_events", f"""WITH {CLEAN_EVENTS} SELECT event_name, distinct_id, insert_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, event_type,
  interaction_category, hour_of_day, day_of_week, is_weekend, tone, maintenance, response_time_ms, llm_provider FROM ce""")
def _(spark, d):
    out = clean(spark, d)
    return out.select(
        "event_name", "distinct_id", "insert_id", stamp("event_time"), "event_type", "interaction_category", "hour_of_day",
        "day_of_week", "is_weekend", "tone", "maintenance", F.col("response_time_ms").cast("int").alias("response_time_ms"), "llm_provider",
    )


@query("events_with_user_keys", f"""WITH {CLEAN_EVENTS} SELECT c.insert_id, c.distinct_id, u.user_id FROM ce c
LEFT JOIN (SELECT * FROM users WHERE user_id % 7 <> 0) u ON u.distinct_id = c.distinct_id""")
def _(spark, d):
    known = users(spark, d).filter("user_id % 7 <> 0")
    return cleaning.with_user_keys(clean(spark, d), known).select("insert_id", "distinct_id", "user_id")


@query("truncation_counts", f"""WITH {CLEAN_EVENTS} SELECT 'event_name' AS "column", count(*) FILTER (WHERE length(event_name) > 12) AS truncated FROM ce
UNION ALL SELECT 'tone', count(*) FILTER (WHERE length(tone) > 6) FROM ce""")
def _(spark, d):
    return cleaning.truncation_counts(clean(spark, d), {"event_name": 12, "tone": 6})


def raw_users(spark, d):
    k = F.col("c_custkey")
    return raw(spark, d, "customer").select(
        F.concat(F.lit(" u-"), k.cast("string")).alias("Distinct_ID"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.com")).alias("email"),
        F.when(k % 5 == 0, "None").otherwise(F.col("c_name")).alias("name"),
        F.array(*[F.lit(b) for b in ["Mobile Chrome", "Firefox 9", "Safari", "Edge", "Naver Whale", "Opera"]])[(k % 6).cast("int")].alias("browser.2"),
        F.array(*[F.lit(b) for b in ["Mac OS X", "Windows 11", "iPad", "Android", "Plan 9"]])[(k % 5).cast("int")].alias("os"),
        F.array(*[F.lit(b) for b in ["$direct", "www.Google.com", "blog.search.naver.com", "localhost", "none"]])[(k % 5).cast("int")].alias("initial_referring_domain"),
        F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "yes").when(k % 4 == 2, "0").alias("is_logged_in"),
        F.when(k % 3 == 0, "true").otherwise("false").alias("is_naver_account"),
        F.when(k % 2 == 0, "1").alias("is_email_account"),
        F.when(k % 9 == 0, "admin").otherwise((k % 3).cast("string")).alias("role"),
        F.when(k % 8 == 0, F.lit(None)).otherwise((k % 40).cast("string")).alias("total_sessions"),
        F.when(k % 10 == 0, "soon").otherwise(F.date_format(F.date_sub(F.lit("2024-01-30").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd'T'12:00:00'Z'")).alias("last_seen"),
    )


@query("clean_users", """
WITH k AS (SELECT c_custkey AS k, c_name FROM customer)
SELECT 'u-' || k AS distinct_id, 'user' || k || '@mail.example.com' AS email, CASE WHEN k % 5 = 0 THEN NULL ELSE c_name END AS name,
  ['chrome', 'firefox', 'safari', 'edge', 'whale', 'other'][k % 6 + 1] AS browser_family, ['mac', 'desktop', 'ios', 'android', 'other'][k % 5 + 1] AS device_category,
  [NULL, 'google.com', 'naver.com', 'localhost', NULL][k % 5 + 1] AS referrer_domain_clean, k % 4 IN (0, 1) AS is_logged_in,
  CASE WHEN k % 3 = 0 THEN 'naver' WHEN k % 2 = 0 THEN 'email' END AS account_type, CAST(CASE WHEN k % 9 = 0 THEN 1 ELSE k % 3 END AS INT) AS role,
  CAST(CASE WHEN k % 8 = 0 THEN 0 ELSE k % 40 END AS INT) AS total_sessions, CASE WHEN k % 10 = 0 THEN NULL ELSE k % 60 END AS days_since_last_seen,
  CASE WHEN k % 10 = 0 THEN NULL ELSE k % 60 <= 30 END AS is_active FROM k""")
def _(spark, d):
    out = cleaning.clean_users(raw_users(spark, d))
    return out.select(
        "distinct_id", "email", "name", "browser_family", "device_category", "referrer_domain_clean", "is_logged_in", "account_type",
        "role", "total_sessions", "days_since_last_seen", "is_active",
    )


@query("masked_emails", """
SELECT c_custkey AS id, 'u' || repeat('*', length('user' || c_custkey) - 2) || right(CAST(c_custkey AS VARCHAR), 1) || '@mail.example.com' AS email FROM customer""")
def _(spark, d):
    e = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com"))
    return raw(spark, d, "customer").select(F.col("c_custkey").alias("id"), cleaning.mask_email(e).alias("email"))


@query("masked_records", """
SELECT event_id AS id, '{"user":' || user_id || ',"auth_token":"***MASKED***","parts":[{"pwd":"***MASKED***","k":"' || event_type || '"}]}' AS record FROM events""")
def _(spark, d):
    rows = raw(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.struct(
            F.col("user_id").alias("user"),
            F.col("props").alias("auth_token"),
            F.array(F.struct(F.col("props").alias("pwd"), F.col("event_type").alias("k"))).alias("parts"),
        ).alias("record"),
    )
    return cleaning.mask_secrets(rows).select("id", F.to_json("record").alias("record"))


@query("normalised_endpoints", """
SELECT regexp_replace(path, '/[0-9]+$', '/{id}') AS endpoint, count(*) AS n FROM oplog GROUP BY 1""")
def _(spark, d):
    paths = load(spark, d, "oplog").select(cleaning.endpoint_of(F.col("path")).alias("endpoint"))
    return paths.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query("user_filter", "SELECT user_id, country_code, account_type FROM users WHERE country_code = 'KR' AND account_type IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    out = cleaning.equal_filter(users(spark, d), country_code="KR", account_type=["BUILDING", "MACHINERY"])
    return out.select("user_id", "country_code", "account_type")


@query("item_search", "SELECT item_id, item_name, category FROM items WHERE item_name ILIKE '%RING%' OR category ILIKE '%RING%'")
def _(spark, d):
    return cleaning.search(items(spark, d), "RING", ["item_name", "category"]).select("item_id", "item_name", "category")


@query("user_page", "SELECT user_id, name FROM users ORDER BY user_id LIMIT 20 OFFSET 40")
def _(spark, d):
    return cleaning.page(users(spark, d).select("user_id", "name"), [F.asc("user_id")], 20, 40)


# --- validation and quality -------------------------------------------------------------------

RULES = [
    validation.Rule("event_name", "string", allowed=("run_paraphrasing", "selected_paraphrasing", "copy_sentence", "tutorial_start")),
    validation.Rule("tone", "string", required=True, pattern="(normal|formal|common)"),
    validation.Rule("response_time_ms", "integer", required=False, min_value=40, max_value=1500),
    validation.Rule("browser", "string", required=False, custom=lambda c: F.length(c) < 6 + F.lit(1)),
    validation.Rule("id", "float", max_value=10**15),
]
ERRORS = """er AS (SELECT id, 'event_name' AS field, 'invalid_value' AS error_type FROM interactions WHERE event_name = 'error_event'
UNION ALL SELECT id, 'tone', 'missing_field' FROM interactions WHERE tone IS NULL
UNION ALL SELECT id, 'tone', 'pattern_mismatch' FROM interactions WHERE NOT regexp_matches(tone, '^(normal|formal|common)')
UNION ALL SELECT id, 'response_time_ms', 'value_too_small' FROM interactions WHERE response_time_ms < 40
UNION ALL SELECT id, 'response_time_ms', 'value_too_large' FROM interactions WHERE response_time_ms > 1500)"""


@query("validation_errors", f"WITH {ERRORS} SELECT * FROM er")
def _(spark, d):
    return validation.error_rows(validation.with_errors(interactions(spark, d), RULES), "id").select("id", "field", "error_type")


@query("validation_summary", f"""WITH {ERRORS}, a AS (SELECT (SELECT count(*) FROM interactions) AS total, (SELECT count(DISTINCT id) FROM er) AS invalid,
  (SELECT count(*) FROM er) AS errors) SELECT total, total - invalid AS valid, errors, invalid, round(invalid / total, 6) AS error_rate FROM a""")
def _(spark, d):
    out = validation.summary(validation.with_errors(interactions(spark, d), RULES))
    return out.withColumn("error_rate", F.round("error_rate", 6))


@query("missing_required_fields", "SELECT event_id AS id, 'time' AS field, 'missing_field' AS error_type FROM events")
def _(spark, d):
    rows = interactions(spark, d).select("id", "event_name", F.col("insert_id").alias("distinct_id"))
    return validation.error_rows(validation.with_errors(rows, validation.EVENT_RULES), "id").select("id", "field", "error_type")


def quality_rows(spark, d):
    ev = interactions(spark, d)
    return ev.select(
        "id", "user_id", "event_name", "tone", "browser", "event_time", F.lit("web").alias("channel"),
        (F.col("response_time_ms") - 20).alias("wait_duration"),
    )


QUALITY = """WITH q AS (SELECT id, user_id, event_name, tone, browser, event_time, response_time_ms - 20 AS w FROM interactions),
a AS (SELECT count(*) AS n, count(*) - count(tone) AS nt, count(*) - count(browser) AS nb, count(*) FILTER (WHERE w < 0) AS neg,
  quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.75) AS q3 FROM q),
o AS (SELECT count(*) AS c FROM q, a WHERE w < q1 - 1.5 * (q3 - q1) OR w > q3 + 1.5 * (q3 - q1)),
r AS (SELECT 'data_completeness' AS check_name, 1 - (nt + nb) / (n * 8.0) >= 0.95 AS passed, CASE WHEN 1 - (nt + nb) / (n * 8.0) < 0.8 THEN 'error' ELSE 'warning' END AS severity FROM a
UNION ALL SELECT 'column_completeness_tone', false, 'warning' FROM a WHERE nt / n > 0.1 UNION ALL SELECT 'column_completeness_browser', false, 'warning' FROM a WHERE nb / n > 0.1
UNION ALL SELECT 'wait_duration_negative_values', false, 'error' FROM a WHERE neg > 0 UNION ALL SELECT 'duplicate_rows', true, 'warning'
UNION ALL SELECT 'uniqueness_user_id', false, 'warning' FROM q HAVING count(DISTINCT user_id) / count(user_id) < 0.95
UNION ALL SELECT 'channel_imbalance', false, 'info' UNION ALL SELECT 'outliers_wait_duration', false, 'info' FROM o, a WHERE c / n > 0.05)"""


@query("quality_checks", QUALITY + " SELECT * FROM r")
def _(spark, d):
    return quality.quality_checks(quality_rows(spark, d)).select("check_name", "passed", "severity")


@query("quality_report", QUALITY + """ SELECT count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS overall_passed, count(*) AS total_checks,
  count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors, count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings FROM r""")
def _(spark, d):
    return quality.report(quality.quality_checks(quality_rows(spark, d)))


@query("event_load", f"""WITH {CLEAN_EVENTS} SELECT c.insert_id, c.distinct_id, u.user_id, c.event_type FROM ce c JOIN users u ON u.distinct_id = c.distinct_id
WHERE c.user_id % 2 = 1""")
def _(spark, d):
    already = interactions(spark, d).filter("user_id % 2 = 0").select("insert_id")
    valid = files.flatten_records(raw_events(spark, d)).withColumn("time", F.col("time").cast("double")).filter("time IS NOT NULL")
    done = etl.run_events(valid, users(spark, d), already)
    return done.rows.select("insert_id", "distinct_id", "user_id", "event_type")


@query("rows_to_insert", """SELECT id, insert_id FROM interactions WHERE item_id IS NOT NULL AND id % 3 <> 0""")
def _(spark, d):
    ev = interactions(spark, d).select("id", "insert_id", "item_id", "event_time")
    twice = ev.unionByName(ev.withColumns({"event_time": F.col("event_time") + F.expr("INTERVAL 1 DAY"), "id": F.col("id") + 1_000_000}))
    return tables.rows_to_insert(twice, ev.filter("id % 3 = 0"), "insert_id", ["event_time"], ["item_id"]).select("id", "insert_id")


@query("user_upsert", """SELECT user_id, user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'new-' || name ELSE name END AS name FROM users
UNION ALL SELECT user_id + 1000000, user_id + 1000000, 'new-' || name FROM users WHERE user_id % 3 = 0""")
def _(spark, d):
    old = users(spark, d).select("user_id", F.col("user_id").alias("id"), "name")
    some = old.filter("user_id % 3 = 0").withColumns({"name": F.concat(F.lit("new-"), "name"), "id": F.col("id") - 5})
    more = some.withColumns({"user_id": F.col("user_id") + 1_000_000, "id": F.col("user_id") + 1_000_000})
    return tables.upsert(old, some.unionByName(more), ["user_id"])


@query("bucket_upsert", """SELECT user_id, user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'new-' || name ELSE name END AS name FROM users
UNION ALL SELECT user_id + 1000000, user_id + 1000000, 'new-' || name FROM users WHERE user_id % 3 = 0""")
def _(spark, d):
    old = users(spark, d).select("user_id", F.col("user_id").alias("id"), "name")
    some = old.filter("user_id % 3 = 0").withColumns({"name": F.concat(F.lit("new-"), "name"), "id": F.col("id") - 5})
    more = some.withColumns({"user_id": F.col("user_id") + 1_000_000, "id": F.col("user_id") + 1_000_000})
    table = BucketTable(spark, f"{stage_dir(spark)}/tidemark/users-{uuid.uuid4().hex}", old.schema, ["user_id"])
    for part in (old, some, more):
        table.upsert(part)
    return table.read()


@query("table_projection", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN value > 20 THEN NULL ELSE value END AS value, CAST(NULL AS INT) AS extra FROM events")
def _(spark, d):
    src = raw(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("value") > 20, float("nan")).otherwise(F.col("value")).alias("value"), "props"
    )
    schema = spark.createDataFrame([], "id long, user_id string, value double, extra int").schema
    return tables.to_schema(src, schema)


@query("recent_scan", "SELECT user_id, item_id, count(*) AS n FROM interactions WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL")
def _(spark, d):
    recent = tables.scan_recent(interactions(spark, d), days=7)
    return recent.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_round_trip", "SELECT user_id, count(*) AS n FROM interactions GROUP BY 1")
def _(spark, d):
    return stage(interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "snapshot")


@query("combined_columns", "SELECT user_id, name, NULL::VARCHAR AS insert_id FROM users UNION ALL SELECT user_id, NULL, insert_id FROM interactions")
def _(spark, d):
    a, b = users(spark, d).select("user_id", "name"), interactions(spark, d).select("user_id", "insert_id")
    return a.unionByName(b, allowMissingColumns=True)


# --- joins -----------------------------------------------------------------------------------


@query("users_with_features", f"WITH {USER_BASE} SELECT u.user_id, u.distinct_id, uf.total_events, uf.engagement_score FROM users u LEFT JOIN uf USING (user_id)")
def _(spark, d):
    out = joins.with_features(users(spark, d), user_feats(spark, d), "user_id")
    return out.select("user_id", "distinct_id", "total_events", "engagement_score")


@query("items_with_features", f"WITH {ITEM_BASE} SELECT i.item_id, i.category, itf.total_events, itf.popularity_score FROM items i LEFT JOIN itf USING (item_id)")
def _(spark, d):
    out = joins.with_features(items(spark, d), item_feats(spark, d), "item_id")
    return out.select("item_id", "category", "total_events", "popularity_score")


@query("active_known_users", """SELECT count(DISTINCT user_id) AS active_users FROM interactions
WHERE event_time >= TIMESTAMP '2024-01-24 00:00:00' AND user_id IN (SELECT user_id FROM users)""")
def _(spark, d):
    return joins.active_known_users(interactions(spark, d), users(spark, d))


@query("similar_items_by_attribute", """
WITH u AS (SELECT item_id, count(*) AS uses FROM interactions GROUP BY 1),
p AS (SELECT a.item_id, b.item_id AS other_id, coalesce(u.uses, 0) AS uses FROM items a JOIN items b ON a.item_id <> b.item_id
  AND (a.category = b.category OR a.item_type = b.item_type) LEFT JOIN u ON u.item_id = b.item_id WHERE b.is_active)
SELECT item_id, other_id, uses, CAST(row_number() OVER (PARTITION BY item_id ORDER BY uses DESC, other_id) AS INT) AS rank FROM p QUALIFY rank <= 10""")
def _(spark, d):
    return joins.similar_by_attribute(items(spark, d), interactions(spark, d))


@query("enough_data_pairs", """WITH p AS (SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY ALL)
SELECT user_id, item_id, n FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY 1 HAVING sum(n) >= 65) AND item_id IN (SELECT item_id FROM p GROUP BY 1 HAVING sum(n) >= 100)""")
def _(spark, d):
    pairs = interactions(spark, d).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return cf.enough_data(pairs, 65, 100)


@query("candidate_items", """
WITH s AS (SELECT DISTINCT user_id, item_id FROM interactions),
c AS (SELECT u.user_id, i.item_id FROM users u CROSS JOIN (SELECT item_id FROM items WHERE is_active) i ANTI JOIN s USING (user_id, item_id))
SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS INT) AS rank FROM c QUALIFY rank <= 8""")
def _(spark, d):
    return joins.candidates(users(spark, d), items(spark, d), interactions(spark, d), 8)


@query("item_cooccurrence", """
WITH c AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n FROM interactions a JOIN interactions b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  AND b.event_time BETWEEN a.event_time - INTERVAL 24 HOURS AND a.event_time + INTERVAL 24 HOURS GROUP BY ALL)
SELECT *, round(n / max(n) OVER (PARTITION BY item_a), 6) AS score FROM c""")
def _(spark, d):
    return cooccurrence.item_cooccurrence(interactions(spark, d)).withColumn("score", F.round("score", 6))


@query("items_used_together", """
WITH c AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n FROM interactions a JOIN interactions b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  AND b.event_time BETWEEN a.event_time - INTERVAL 24 HOURS AND a.event_time + INTERVAL 24 HOURS GROUP BY ALL),
k AS (SELECT item_a, item_b, row_number() OVER (PARTITION BY item_a ORDER BY n DESC, item_b) AS rank FROM c)
SELECT item_a AS item_id, string_agg(CAST(item_b AS VARCHAR), ',' ORDER BY rank) AS used_with FROM k WHERE rank <= 10 GROUP BY 1""")
def _(spark, d):
    pairs = cooccurrence.item_cooccurrence(interactions(spark, d))
    out = cooccurrence.used_together(pairs)
    return out.select("item_id", F.array_join(F.transform("used_with", lambda e: e["item_id"].cast("string")), ",").alias("used_with"))
