"""Exploration, knowledge-base, decision and maintenance queries over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import source_weight
from ..functions.text import jaccard
from ..operators.relational import latest, top_k
from ..sources.views import AS_OF
from .registry import Views, query


def _placed(v: Views) -> DataFrame:
    """Signatures with what is known of their items."""
    s = v("v_signature").select("project_id", "item_id", "error_hash", "exception_fp", "template_ids", "emb")
    return s.join(v("v_item").select("project_id", "item_id", "launch_id", "launch_name", "launch_number", "test_case_hash", "issue_type", "issue_group", "start_time"), ["project_id", "item_id"])


# joins


@query("j11_mode_merge", "SELECT item_id, CASE WHEN mode_id = 7 THEN 3 ELSE mode_id END AS mode_id, match_score FROM v_mode_member")
def j11(v: Views) -> DataFrame:
    return v("v_mode_member").select("item_id", F.when(F.col("mode_id") == 7, F.lit(3).cast("long")).otherwise(F.col("mode_id")).alias("mode_id"), "match_score")


@query("j15_group_members", """
WITH m AS (SELECT l.item_id AS owner, o.item_id FROM v_signature l JOIN v_signature o USING (project_id, error_hash) WHERE l.item_id % 50 = 0 UNION SELECT l.item_id, o.item_id FROM v_item l JOIN v_item o ON l.launch_id = o.launch_id AND l.test_case_hash = o.test_case_hash WHERE l.item_id % 50 = 0)
SELECT owner, item_id FROM m QUALIFY row_number() OVER (PARTITION BY owner ORDER BY owner <> item_id, item_id) <= 60""")
def j15(v: Views) -> DataFrame:
    s, i = v("v_signature").select("project_id", "error_hash", "item_id"), v("v_item").select("launch_id", "test_case_hash", "item_id")
    asked = lambda df: df.where("item_id % 50 = 0").withColumnRenamed("item_id", "owner")
    both = asked(s).join(s, ["project_id", "error_hash"]).select("owner", "item_id").union(asked(i).join(i, ["launch_id", "test_case_hash"]).select("owner", "item_id")).distinct()
    return top_k(both, ["owner"], [F.asc(F.col("owner") != F.col("item_id")), F.asc("item_id")], 60).select("owner", "item_id")


@query("j18_template_rows", """
WITH p AS (SELECT item_id, unnest(template_ids) AS template_id, unnest(range(len(template_ids))) AS pos FROM v_signature), t AS (SELECT template_id, min(pattern) AS pattern FROM v_template GROUP BY template_id)
SELECT item_id, pos, template_id, pattern, pattern IS NULL AS missing FROM p LEFT JOIN t USING (template_id)""")
def j18(v: Views) -> DataFrame:
    parts = v("v_signature").select("item_id", F.posexplode("template_ids").alias("pos", "template_id")).withColumn("pos", F.col("pos").cast("long"))
    patterns = v("v_template").groupBy("template_id").agg(F.min("pattern").alias("pattern"))
    return parts.join(patterns, "template_id", "left").select("item_id", "pos", "template_id", "pattern", F.col("pattern").isNull().alias("missing"))


@query("j21_llm_events_named", "SELECT e.event_id, i.launch_name FROM v_llm_event e LEFT JOIN v_item i USING (project_id, item_id) ORDER BY created_at DESC, event_id DESC LIMIT 100")
def j21(v: Views) -> DataFrame:
    newest = v("v_llm_event").select("project_id", "item_id", "event_id", "created_at").orderBy(F.desc("created_at"), F.desc("event_id")).limit(100)
    return newest.join(v("v_item").select("project_id", "item_id", "launch_name"), ["project_id", "item_id"], "left").select("event_id", "launch_name")


@query("j22_conflict_pool", """
WITH l AS (SELECT item_id, arg_max(source, {'t': ts, 'e': event_id}) AS source FROM v_label_event GROUP BY item_id)
SELECT q.item_id AS query_id, i.item_id, s.error_hash, l.source FROM v_signature q JOIN v_signature s USING (project_id, error_hash) JOIN v_item i ON i.item_id = s.item_id AND i.project_id = s.project_id LEFT JOIN l ON l.item_id = i.item_id
WHERE q.item_id % 50 = 0 AND issue_type IS NOT NULL AND i.item_id <> q.item_id QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY i.item_id DESC) <= 10""")
def j22(v: Views) -> DataFrame:
    """For each query item the ten newest labelled items of its hash, with the source of each one's last label. A hash is cut to its
    eleven newest first, of which the query may be one."""
    heads = top_k(_placed(v).where("issue_type IS NOT NULL").select("project_id", "error_hash", "item_id"), ["project_id", "error_hash"], [F.desc("item_id")], 11, "of_hash")
    asked = v("v_signature").where("item_id % 50 = 0").select("project_id", "error_hash", F.col("item_id").alias("query_id"))
    found = top_k(asked.join(heads, ["project_id", "error_hash"]).where("query_id <> item_id"), ["query_id"], [F.desc("item_id")], 10).select("query_id", "item_id", "error_hash")
    return found.join(latest(v("v_label_event"), ["item_id"], ["ts", "event_id"], ["source"]), "item_id", "left")


# retrieval


@query("r10_hash_matches_with_source", """
WITH l AS (SELECT item_id, arg_max(source, {'t': ts, 'e': event_id}) AS source, max(ts) AS ts FROM v_label_event GROUP BY item_id)
SELECT s.error_hash, s.item_id, CASE l.source WHEN 'rp_defect_update' THEN 'rp' WHEN 'human_ui' THEN 'human' WHEN 'early' THEN 'ai_suggested' END AS provenance FROM v_signature s JOIN v_item i USING (project_id, item_id) LEFT JOIN l ON l.item_id = s.item_id
WHERE issue_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY error_hash ORDER BY l.ts DESC NULLS LAST, s.item_id DESC) <= 10""")
def r10(v: Views) -> DataFrame:
    rows = _placed(v).where("issue_type IS NOT NULL").select("error_hash", "item_id").join(latest(v("v_label_event").withColumn("at", F.col("ts")), ["item_id"], ["ts", "event_id"], ["source", "at"]), "item_id", "left")
    named = F.when(F.col("source") == "rp_defect_update", "rp").when(F.col("source") == "human_ui", "human").when(F.col("source") == "early", "ai_suggested")
    return top_k(rows, ["error_hash"], [F.desc_nulls_last("at"), F.desc("item_id")], 10).select("error_hash", "item_id", named.alias("provenance"))


@query("r12_candidate_flags", """
SELECT a.item_id, b.item_id AS other_id, a.test_case_hash = b.test_case_hash AS same_test_case, a.exception_fp = b.exception_fp AS same_fp, abs(a.launch_number - b.launch_number) AS launch_distance
FROM (SELECT * FROM v_signature JOIN v_item USING (project_id, item_id)) a JOIN (SELECT * FROM v_signature JOIN v_item USING (project_id, item_id)) b USING (project_id, error_hash) WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id""")
def r12(v: Views) -> DataFrame:
    p = _placed(v).select("project_id", "error_hash", "item_id", "test_case_hash", "exception_fp", "launch_number")
    a, b = p.where("item_id % 50 = 0").alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.error_hash") == F.col("b.error_hash")) & (F.col("a.item_id") != F.col("b.item_id")))
    same = lambda c, n: (F.col(f"a.{c}") == F.col(f"b.{c}")).alias(n)
    return pairs.select("a.item_id", F.col("b.item_id").alias("other_id"), same("test_case_hash", "same_test_case"), same("exception_fp", "same_fp"), F.abs(F.col("a.launch_number") - F.col("b.launch_number")).alias("launch_distance"))


# aggregations


@query("a3_metrics_since", "SELECT project_id, count(*) AS suggestions, count(*) FILTER (WHERE outcome = 'accepted') AS accepted FROM v_suggestion WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY project_id")
def a3(v: Views) -> DataFrame:
    recent = v("v_suggestion").where(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp"))
    return recent.groupBy("project_id").agg(F.count("*").alias("suggestions"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))


_COUNTERS = {
    "items": "true", "unlabelled": "issue_type IS NULL", "abstained": "issue_group = 'ti'", "product_bugs": "issue_group = 'pb'", "automation_bugs": "issue_group = 'ab'", "system_issues": "issue_group = 'si'", "no_defects": "issue_group = 'nd'",
}
_TABLES = {"signatures": "v_signature", "label_events": "v_label_event", "suggestions": "v_suggestion", "llm_events": "v_llm_event", "modes": "v_mode", "mode_members": "v_mode_member"}


@query("a13_project_summary", "WITH i AS (SELECT project_id, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTERS.items()) + ", count(DISTINCT launch_id) AS launches, count(DISTINCT test_case_hash) AS tests FROM v_item GROUP BY project_id) SELECT i.*, " + ", ".join(f"(SELECT count(*) FROM {t} x WHERE x.project_id = i.project_id) AS {n}" for n, t in _TABLES.items()) + " FROM i")
def a13(v: Views) -> DataFrame:
    counters = [F.count_if(F.expr(c)).alias(n) for n, c in _COUNTERS.items()]
    out = v("v_item").groupBy("project_id").agg(*counters, F.count_distinct("launch_id").alias("launches"), F.count_distinct("test_case_hash").alias("tests"))
    for n, t in _TABLES.items():  # a row a project
        out = out.join(v(t).groupBy("project_id").agg(F.count("*").alias(n)), "project_id", "left")
    return out.fillna(0, list(_TABLES))


@query("a18_stale_template_sets", """
WITH s AS (SELECT exception_fp, array_to_string(list_sort(template_ids), ',') AS k, max(item_id) AS newest FROM v_signature GROUP BY ALL)
SELECT k, max(newest) AS newest FROM s WHERE k NOT IN (SELECT array_to_string(list_sort(template_ids), ',') FROM v_signature WHERE item_id % 10 = 0) GROUP BY k""")
def a18(v: Views) -> DataFrame:
    sets = v("v_signature").select("item_id", F.array_join(F.array_sort("template_ids").cast("array<string>"), ",").alias("k"))
    return sets.groupBy("k").agg(F.max("item_id").alias("newest")).join(sets.where("item_id % 10 = 0").select("k"), "k", "left_anti")


@query("a19_cache_stats", "SELECT role, count(*) AS entries, count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 14 DAY) AS fresh FROM v_llm_event GROUP BY role")
def a19(v: Views) -> DataFrame:
    fresh = F.col("created_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL '14' DAY")
    return v("v_llm_event").groupBy("role").agg(F.count("*").alias("entries"), F.count_if("cache_hit").alias("hits"), F.count_if(fresh).alias("fresh"))


@query("a20_events_since", "SELECT project_id, count(*) AS n FROM v_label_event WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY project_id")
def a20(v: Views) -> DataFrame:
    return v("v_label_event").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).groupBy("project_id").agg(F.count("*").alias("n"))


@query("a21_first_seen", "SELECT error_hash, min(coalesce(start_time, TIMESTAMP '2024-02-01 00:00:00')) AS first_seen FROM v_signature JOIN v_item USING (project_id, item_id) GROUP BY error_hash")
def a21(v: Views) -> DataFrame:
    return _placed(v).groupBy("error_hash").agg(F.min(F.coalesce("start_time", F.lit(AS_OF).cast("timestamp"))).alias("first_seen"))


@query("a24_flip_rate", """
WITH o AS (SELECT item_id, predicted_label, confidence, lag(predicted_label) OVER w AS p, lag(confidence) OVER w AS c FROM v_suggestion WINDOW w AS (PARTITION BY item_id ORDER BY created_at, suggestion_id))
SELECT p AS before, predicted_label AS after, count(*) AS n, round(avg(abs(confidence - c)), 6) AS mean_delta FROM o WHERE p IS NOT NULL GROUP BY ALL""")
def a24(v: Views) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy("created_at", "suggestion_id")
    rows = v("v_suggestion").select("item_id", "predicted_label", "confidence", F.lag("predicted_label").over(w).alias("p"), F.lag("confidence").over(w).alias("c")).where("p IS NOT NULL")
    return rows.groupBy(F.col("p").alias("before"), F.col("predicted_label").alias("after")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("confidence") - F.col("c"))), 6).alias("mean_delta"))


@query("a28_labels_of_hash", "SELECT error_hash, coalesce(issue_group, 'none') AS label_group, count(*) AS n FROM v_signature JOIN v_item USING (project_id, item_id) GROUP BY ALL")
def a28(v: Views) -> DataFrame:
    return _placed(v).groupBy("error_hash", F.coalesce("issue_group", F.lit("none")).alias("label_group")).agg(F.count("*").alias("n"))


@query("a29_prefix_tree", """
WITH t AS (SELECT string_split(message, ' ') AS w FROM v_log), d AS (SELECT w, unnest(range(1, 5)) AS depth FROM t)
SELECT depth, array_to_string(list_slice(w, 1, depth), ' ') AS prefix, count(*) AS n FROM d WHERE len(w) >= depth GROUP BY ALL""")
def a29(v: Views) -> DataFrame:
    rows = v("v_log").select(F.split("message", " ").alias("w")).select("w", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("depth")).where(F.size("w") >= F.col("depth"))
    return rows.groupBy("depth", F.array_join(F.slice("w", F.lit(1), F.col("depth").cast("int")), " ").alias("prefix")).agg(F.count("*").alias("n"))


@query("a32_learning_timeline", "SELECT event_id, ts, lag(substr(new_label, 1, 2)) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS old_group, substr(new_label, 1, 2) AS new_group FROM v_label_event")
def a32(v: Views) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy("ts", "event_id")
    group = F.substring("new_label", 1, 2)
    return v("v_label_event").select("event_id", "ts", F.lag(group).over(w).alias("old_group"), group.alias("new_group"))


@query("a34_item_llm_events", "SELECT item_id, event_id FROM v_llm_event QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, event_id DESC) <= 20")
def a34(v: Views) -> DataFrame:
    return top_k(v("v_llm_event").select("item_id", "event_id", "created_at"), ["item_id"], [F.desc("created_at"), F.desc("event_id")], 20).select("item_id", "event_id")


# rankings


@query("w7_fold_assignment", "SELECT item_id, (row_number() OVER (PARTITION BY project_id ORDER BY item_id) - 1) % 5 AS fold FROM v_item")
def w7(v: Views) -> DataFrame:
    return v("v_item").select("item_id", ((F.row_number().over(Window.partitionBy("project_id").orderBy("item_id")) - 1) % 5).cast("long").alias("fold"))


@query("w10_page", "SELECT error_hash, count(*) AS n FROM v_signature GROUP BY error_hash ORDER BY n DESC, error_hash LIMIT 10 OFFSET 10")
def w10(v: Views) -> DataFrame:
    return v("v_signature").groupBy("error_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_hash").offset(10).limit(10)


@query("w15_group_list", "SELECT launch_id, error_hash, count(*) AS n, CAST(row_number() OVER (PARTITION BY launch_id ORDER BY count(*) DESC, error_hash) AS INTEGER) AS place FROM v_signature JOIN v_item USING (project_id, item_id) GROUP BY launch_id, error_hash")
def w15(v: Views) -> DataFrame:
    groups = _placed(v).groupBy("launch_id", "error_hash").agg(F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("launch_id").orderBy(F.desc("n"), "error_hash")))


# knowledge base and decisions


@query("d18_method_of_decision", "SELECT CASE WHEN model_ver LIKE 'gbm%' THEN 'gbm' WHEN model_ver LIKE 'rubric+%' THEN 'rubric' ELSE 'rule_cold' END AS method, CASE WHEN confidence >= 0.75 THEN 'auto' WHEN confidence >= 0.45 THEN 'suggest' ELSE 'abstain' END AS action, count(*) AS n FROM v_suggestion GROUP BY ALL")
def d18(v: Views) -> DataFrame:
    from ..functions.labels import band

    method = F.when(F.col("model_ver").startswith("gbm"), "gbm").when(F.col("model_ver").startswith("rubric+"), "rubric").otherwise("rule_cold")
    return v("v_suggestion").groupBy(method.alias("method"), band(F.col("confidence")).alias("action")).agg(F.count("*").alias("n"))


@query("g3_representative", """
WITH l AS (SELECT item_id, count(*) AS logs FROM v_log GROUP BY item_id)
SELECT launch_id, error_hash, arg_max(item_id, {'s': item_id % 3 = 0, 'l': coalesce(logs, 0), 'i': -item_id}) AS item_id FROM v_signature JOIN v_item USING (project_id, item_id) LEFT JOIN l USING (item_id) GROUP BY ALL""")
def g3(v: Views) -> DataFrame:
    """With a stack first (every third item's), then most logs, then the least id."""
    logs = v("v_log").groupBy("item_id").agg(F.count("*").alias("logs"))
    rows = _placed(v).select("launch_id", "error_hash", "item_id").join(logs, "item_id", "left")
    best = F.struct(F.col("item_id") % 3 == 0, F.coalesce("logs", F.lit(0)), -F.col("item_id"))
    return rows.groupBy("launch_id", "error_hash").agg(F.max_by("item_id", best).alias("item_id"))


@query("g6_cluster_reply", """
SELECT i.item_id, launch_id, md5(concat(project_id, ':', launch_id, ':', error_hash)) AS cluster_id, array_to_string(list_slice(string_split(msg_text, chr(10)), 1, 5), chr(10)) AS message
FROM v_signature s JOIN v_item i USING (project_id, item_id)""")
def g6(v: Views) -> DataFrame:
    """A row for each member with its cluster's name and the first five lines of its message: a cluster of any size is no group."""
    rows = v("v_signature").select("project_id", "item_id", "error_hash", "msg_text").join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    return rows.select("item_id", "launch_id", F.md5(F.concat_ws(":", "project_id", "launch_id", "error_hash").cast("binary")).alias("cluster_id"), F.substring_index("msg_text", "\n", 5).alias("message"))


@query("h10_source_weights", "SELECT event_id, CASE source WHEN 'rp_defect_update' THEN 1.0 WHEN 'human_ui' THEN 0.9 ELSE 0.3 END::DOUBLE AS weight FROM v_label_event")
def h10(v: Views) -> DataFrame:
    return v("v_label_event").select("event_id", source_weight(F.col("source")).alias("weight"))


# learning and maintenance


@query("l3_training_matrix", """
SELECT item_id, new_label FROM v_label_event WHERE source IS DISTINCT FROM 'early' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1 AND new_label NOT LIKE 'ti%'""")
def l3(v: Views) -> DataFrame:
    events = v("v_label_event").where(~F.col("source").eqNullSafe("early"))
    return latest(events, ["item_id"], ["ts", "event_id"], ["new_label"]).where(~F.col("new_label").startswith("ti"))


@query("l12_orphans_past_grace", f"SELECT item_id, min(ts) AS first_orphaned FROM v_label_event WHERE item_id NOT IN (SELECT item_id FROM v_item WHERE item_id % 2 = 0) GROUP BY item_id HAVING min(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def l12(v: Views) -> DataFrame:
    orphans = v("v_label_event").join(v("v_item").where("item_id % 2 = 0").select("item_id"), "item_id", "left_anti")
    return orphans.groupBy("item_id").agg(F.min("ts").alias("first_orphaned")).where(F.col("first_orphaned") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL '30' DAY"))


@query("l13_delete_launches", "SELECT item_id FROM v_signature WHERE item_id NOT IN (SELECT item_id FROM v_item WHERE launch_id IN (1, 3))")
def l13(v: Views) -> DataFrame:
    gone = v("v_item").where(F.col("launch_id").isin(1, 3)).select("item_id")
    return v("v_signature").select("item_id").join(gone, "item_id", "left_anti")


@query("l21_cold_projects", "SELECT project_id, count(*) < 50 AS cold FROM v_label_event GROUP BY project_id")
def l21(v: Views) -> DataFrame:
    return v("v_label_event").groupBy("project_id").agg((F.count("*") < 50).alias("cold"))


@query("s11_templates_by_use", "SELECT template_id, count(*) AS n FROM v_template GROUP BY template_id ORDER BY n DESC, template_id")
def s11(v: Views) -> DataFrame:
    return v("v_template").groupBy("template_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template_id")


@query("s7_item_projection", "SELECT item_id, nullif(lower(trim(issue_type)), '') AS issue_type, nullif(test_case_hash, 0) AS test_case_hash FROM v_item")
def s7(v: Views) -> DataFrame:
    return v("v_item").select("item_id", F.nullif(F.lower(F.trim("issue_type")), F.lit("")).alias("issue_type"), F.nullif("test_case_hash", F.lit(0)).alias("test_case_hash"))
