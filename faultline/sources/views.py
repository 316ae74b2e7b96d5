"""The domain tables as deterministic views over the driver's tables.

Each view is a text in the dialect that Spark SQL and DuckDB share, so the engine's queries and their oracles start from the same
rows; ``div`` and array literals are the only places where the two are written differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Every time-dependent query takes this as "now".
AS_OF = "2024-02-01 00:00:00"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_item": """
SELECT vec_id AS item_id, 1 + vec_id % 2 AS project_id, {div:vec_id,25} AS launch_id, concat('nightly-', CAST({div:vec_id,25} % 5 AS {string})) AS launch_name,
  {div:vec_id,25} AS launch_number, vec_id % 40 AS test_case_hash,
  CASE WHEN label IN (0, 1) THEN 'pb001' WHEN label IN (2, 3) THEN 'ab001' WHEN label IN (4, 5) THEN 'si001' WHEN label = 6 THEN 'nd001' WHEN label = 7 THEN 'ti001' WHEN label = 8 THEN 'pb_custom' END AS issue_type,
  CASE WHEN label IN (0, 1, 8) THEN 'pb' WHEN label IN (2, 3) THEN 'ab' WHEN label IN (4, 5) THEN 'si' WHEN label = 6 THEN 'nd' WHEN label = 7 THEN 'ti' END AS issue_group,
  TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL '1' HOUR AS start_time FROM {embeddings}""",
    "v_signature": """
SELECT e.vec_id AS item_id, 1 + e.vec_id % 2 AS project_id, e.embedding AS emb, coalesce(d.text, '') AS msg_text,
  CASE e.label WHEN 0 THEN 'java.lang.NullPointerException' WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'StaleElementReferenceException' WHEN 3 THEN 'org.shop.NoSuchElementException' WHEN 4 THEN 'java.net.SocketTimeoutException'
  WHEN 5 THEN 'java.net.ConnectException' WHEN 6 THEN 'KeyError' WHEN 7 THEN '' WHEN 8 THEN 'org.shop.Region.RateError' ELSE 'ValueError' END AS exc_text, {array:e.label,e.vec_id % 7,e.vec_id % 11} AS template_ids, {array:500 + e.label % 4} AS status_codes,
  concat('org.shop.Case', CAST(e.label AS {string}), '.step', CAST(e.vec_id % 7 AS {string}), ' org.shop.Region.rate') AS frames_text, concat('step ', CAST(e.label AS {string}), ' of ', CAST(e.vec_id % 11 AS {string})) AS tmpl_text,
  e.label AS exception_fp, CASE WHEN {div:vec_id,25} % 8 = 3 AND vec_id % 25 < 12 THEN 7000 + {div:vec_id,25} ELSE e.label * 100 + e.vec_id % 5 END AS error_hash FROM {embeddings} e LEFT JOIN {documents} d ON e.vec_id = d.doc_id""",
    "v_log": """
SELECT conv_id AS item_id, turn AS pos, CASE role WHEN 'assistant' THEN 40000 WHEN 'user' THEN 30000 ELSE 20000 END AS log_level, text AS message FROM {conversations}""",
    "v_label_event": """
SELECT event_id, user_id AS item_id, 1 + user_id % 2 AS project_id,
  CASE event_type WHEN 'view' THEN 'pb001' WHEN 'click' THEN 'ab001' WHEN 'signup' THEN 'si001' WHEN 'purchase' THEN 'nd001' ELSE 'ti001' END AS new_label,
  CASE event_id % 3 WHEN 0 THEN 'rp_defect_update' WHEN 1 THEN 'human_ui' ELSE 'early' END AS source, ts FROM {events}""",
    "v_suggestion": """
SELECT event_id AS suggestion_id, user_id % 3 AS project_id, user_id AS item_id,
  CASE event_type WHEN 'view' THEN 'pb001' WHEN 'click' THEN 'ab001' WHEN 'signup' THEN 'si001' WHEN 'purchase' THEN 'nd001' ELSE 'ti001' END AS predicted_label,
  CASE WHEN value / 200 > 1 THEN 1.0 ELSE value / 200 END AS confidence,
  CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'ignored' ELSE 'pending' END AS outcome,
  CASE event_id % 5 WHEN 0 THEN 'gbm-v1' WHEN 1 THEN 'rubric+v1' WHEN 2 THEN 'rule_cold' ELSE 'gbm-v2' END AS model_ver, ts AS created_at FROM {events}""",
    "v_history": "SELECT event_id, user_id AS test_case_hash, event_type = 'error' AS failed, ts FROM {events}",
    "v_llm_event": """
SELECT event_id, 1 + user_id % 2 AS project_id, user_id AS item_id, event_type AS role, value * 10 AS latency_ms, event_id % 5 = 0 AS cache_hit,
  CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'guardrail' WHEN 2 THEN 'timeout' ELSE 'ok' END AS outcome, ts AS created_at FROM {events}""",
    "v_mode_member": """
SELECT vec_id AS item_id, 1 + vec_id % 2 AS project_id, 1 + vec_id % 13 AS mode_id, CAST(vec_id * 37 % 101 AS DOUBLE) / 100 AS match_score FROM {embeddings}""",
    "v_mode": """
SELECT 1 + vec_id AS mode_id, 1 + vec_id % 2 AS project_id, CASE vec_id % 5 WHEN 0 THEN 'seed' WHEN 1 THEN 'candidate' WHEN 4 THEN 'retired' ELSE 'confirmed' END AS status,
  CASE vec_id % 4 WHEN 0 THEN 'pb001' WHEN 1 THEN 'ab001' WHEN 2 THEN 'si001' ELSE 'nd001' END AS issue_type, {array:label,(label + 3) % 10} AS exception_fps, {array:label,vec_id % 7,vec_id % 11} AS template_ids,
  CASE WHEN vec_id % 6 = 5 THEN NULL ELSE embedding END AS centroid, CAST(90 + vec_id % 11 AS DOUBLE) / 100 AS purity, vec_id * 2 AS support FROM {embeddings} WHERE vec_id < 40""",
    "v_message": """
SELECT event_id AS message_id, event_type AS routing_key, CASE event_id % 3 WHEN 0 THEN concat(CAST(event_id * 1000 AS {string}), 'L') WHEN 1 THEN CAST(event_id * 1000 AS {string}) WHEN 2 THEN 'soon' END AS header,
  CASE WHEN event_id % 10 = 7 THEN substr(props, 1, 3) ELSE props END AS body, ts FROM {events}""",
    "v_template": "SELECT DISTINCT event_type AS pattern_key, user_id % 11 AS template_id, concat('step ', event_type, ' <NUM>') AS pattern FROM {events}",
}


def _written(text: str, spark: bool) -> str:
    text = text.replace("{string}", "STRING" if spark else "VARCHAR")
    text = re.sub(r"\{div:(\w+),(\d+)\}", r"(\1 div \2)" if spark else r"(\1 // \2)", text)
    text = re.sub(r"\{array:([^}]*)\}", r"array(\1)" if spark else r"[\1]", text)
    return text if spark else re.sub(r"\{(\w+)\}", r"\1", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table. Catalyst reads through a view, so a query's scans are pruned to what it needs."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _written(VIEWS[name], True)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def oracle(query: str) -> str:
    """A query over views as one DuckDB statement."""
    heads = [f"{v} AS ({_written(t, False).strip()})" for v, t in VIEWS.items() if re.search(rf"\b{v}\b", query)]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", query)
    if own:
        return f"WITH {own[1] or ''}" + ", ".join([*heads, query[own.end() :]])
    return "WITH " + ", ".join(heads) + " " + query if heads else query
