"""Adapters from the shared sample tables to the engine's logical tables.

Each adapter is a narrow projection over a parquet scan, so filters and column
pruning of the caller reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column expressions that map the sample tables onto the logical
# ones. They are plain SQL, valid in Spark and in DuckDB, so tests and oracles share them.
INTERACTION_COLUMNS = """
event_id AS id, user_id,
CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS item_id,
CAST(ts AS TIMESTAMP) AS event_time,
CASE event_type WHEN 'click' THEN 'run_paraphrasing' WHEN 'view' THEN 'selected_paraphrasing'
     WHEN 'purchase' THEN 'copy_sentence' WHEN 'signup' THEN 'tutorial_start' ELSE 'error_event' END AS event_name,
CONCAT('ins-', CAST(event_id AS STRING)) AS insert_id,
CONCAT('dev-', CAST(user_id % 7 + event_id % 2 AS STRING)) AS device_id,
CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Whale' ELSE NULL END AS browser,
CASE user_id % 3 WHEN 0 THEN 'Windows 11' WHEN 1 THEN 'Mac OS X' ELSE 'iPad' END AS os,
CASE event_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'formal' WHEN 2 THEN 'common' WHEN 3 THEN 'terminal_word' ELSE NULL END AS tone,
CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END AS maintenance,
CASE user_id % 2 WHEN 0 THEN 'Korean' ELSE 'English' END AS target_language,
CAST(FLOOR(value * 20) AS INT) AS response_time_ms,
CAST(event_id % 120 AS INT) AS input_sentence_length
"""

VIEWS = {
    "interactions": f"SELECT {INTERACTION_COLUMNS} FROM events",
    "items": """
SELECT p.p_partkey AS item_id, CONCAT('item-', CAST(p.p_partkey AS STRING)) AS item_code, p.p_name AS item_name,
       p.p_brand AS item_type, p.p_type AS category, p.p_partkey % 10 <> 9 AS is_active,
       p.p_size >= 40 AS is_premium, e.embedding, TIMESTAMP '2024-01-31 00:00:00' - p.p_size * INTERVAL '1' DAY AS created_at
FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey""",
    "users": """
SELECT c_custkey AS user_id, CONCAT('u-', CAST(c_custkey AS STRING)) AS distinct_id, c_name AS name,
       CASE c_nationkey % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' ELSE NULL END AS country_code,
       c_mktsegment AS account_type
FROM customer""",
    "purchases": """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, CAST(o.o_orderdate AS TIMESTAMP) AS event_time,
       l.l_quantity AS quantity
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
    "feedbacks": """
SELECT a.conv_id * 1000 + a.turn AS id, CONCAT('u-', CAST(a.conv_id % 50 AS STRING)) AS user_id,
       u.text AS original, a.text AS corrected_text,
       CASE a.conv_id % 4 WHEN 0 THEN 'Paraphrase' WHEN 1 THEN 'Tone Adjust' WHEN 2 THEN 'Expand' ELSE 'Compress' END AS selected_feature,
       CASE (a.conv_id + a.turn) % 3 WHEN 0 THEN 'dissatisfied' ELSE 'satisfied' END AS feedback,
       CASE a.turn % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'formal' WHEN 2 THEN 'common' ELSE 'terminal_word' END AS tone,
       CASE a.conv_id % 3 WHEN 0 THEN 'informative' WHEN 1 THEN 'narrative' ELSE 'dialogue' END AS genre,
       a.conv_id % 5 <> 0 AS processed
FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'""",
    "oplog": """
SELECT CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method,
       CONCAT('/api/v1/', event_type, '/', regexp_extract(props, '([0-9]+)', 1)) AS path,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       value / 100 AS duration_s,
       CASE user_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'temporal' ELSE 'ambient' END AS model_type,
       event_id % 5 <> 0 AS cache_hit, CAST(user_id AS STRING) AS client_key, event_id AS id
FROM events""",
}

SOURCES = {
    "interactions": ["events"],
    "items": ["part", "embeddings"],
    "users": ["customer"],
    "purchases": ["orders", "lineitem"],
    "feedbacks": ["conversations"],
    "oplog": ["events"],
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One logical table, e.g. `load(spark, dir, "interactions")`."""
    tables = {name: raw(spark, sf_dir, name) for name in SOURCES[view]}
    text = VIEWS[view]
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **tables)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "interactions")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "items")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "users")


def training_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, event_time) with a known item: what the CF models are fitted on."""
    return interactions(spark, sf_dir).select("user_id", "item_id", "event_time").filter(F.col("item_id").isNotNull())
