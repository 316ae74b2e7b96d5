"""Joins, filters, rankings and aggregations over the domain views."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_group, decay, difference_lower, shown_group, source_weight, wilson
from ..functions.text import jaccard
from ..operators.relational import as_of, delete_matching, latest, top_k, upsert
from ..sources.shared import shared_dir
from ..sources.views import AS_OF
from .registry import Views, query


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# filters


@query("f1_error_logs", "SELECT item_id, pos, log_level, message FROM v_log WHERE log_level >= 40000 AND trim(message) <> ''")
def f1(v: Views) -> DataFrame:
    return v("v_log").where("log_level >= 40000 AND trim(message) <> ''").select("item_id", "pos", "log_level", "message")


@query("f3_tail_cap", "SELECT item_id, pos FROM v_log QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos DESC) <= 20")
def f3(v: Views) -> DataFrame:
    return top_k(v("v_log"), ["item_id"], [F.desc("pos")], 20).select("item_id", "pos")


@query("f4_near_error_context", """
WITH e AS (SELECT item_id, min(pos) AS first_error FROM v_log WHERE log_level >= 40000 GROUP BY item_id)
SELECT l.item_id, l.pos FROM v_log l JOIN e USING (item_id) WHERE l.pos < first_error AND log_level >= 30000 AND log_level < 40000
QUALIFY row_number() OVER (PARTITION BY l.item_id ORDER BY l.pos DESC) <= 5""")
def f4(v: Views) -> DataFrame:
    logs = v("v_log").select("item_id", "pos", "log_level")
    first = logs.where("log_level >= 40000").groupBy("item_id").agg(F.min("pos").alias("first_error"))
    before = logs.where("log_level >= 30000 AND log_level < 40000").join(first, "item_id").where("pos < first_error")
    return top_k(before, ["item_id"], [F.desc("pos")], 5).select("item_id", "pos")


SMALL_LOG = 100
STACK_LINE_RE2 = "[A-Za-z0-9_]+\\.[a-z]{1,4}:\\d+|\\bline \\d+|(^|\\n)\\s*at \\S+\\(.*\\)|(^|\\n)\\s*[\\w$]+(\\.[\\w$]+)+\\([^)]*\\)\\s*(\\n|$)"


@query("f5_small_log_merge", f"""
WITH l AS (SELECT item_id, pos, message, length(message) < {SMALL_LOG} AND NOT regexp_matches(message, '{STACK_LINE_RE2}') AS small FROM v_log),
n AS (SELECT item_id, count(*) AS n_logs, bool_and(small) AND count(*) >= 2 AS merged FROM l GROUP BY item_id)
SELECT item_id, merged, n_logs, string_agg(message, chr(10) ORDER BY pos) FILTER (WHERE merged) AS message FROM l JOIN n USING (item_id) GROUP BY ALL""")
def f5(v: Views) -> DataFrame:
    """An item's logs become one if there are two or more, all small and without stack lines; only such messages are gathered."""
    logs = v("v_log").select("item_id", "pos", "message", ((F.length("message") < SMALL_LOG) & ~F.col("message").rlike(STACK_LINE_RE2)).alias("small"))
    counts = logs.groupBy("item_id").agg(F.count("*").alias("n_logs"), F.bool_and("small").alias("all_small")).select("item_id", "n_logs", (F.col("all_small") & (F.col("n_logs") >= 2)).alias("merged"))
    texts = logs.join(counts.where("merged").select("item_id"), "item_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "message"))).alias("logs"))
    return counts.join(texts, "item_id", "left").select("item_id", "merged", "n_logs", F.array_join(F.col("logs.message"), "\n").alias("message"))


@query("f6_labelled_items", "SELECT item_id, issue_type FROM v_item WHERE issue_type IS NOT NULL AND issue_group <> 'ti'")
def f6(v: Views) -> DataFrame:
    return v("v_item").where("issue_type IS NOT NULL AND issue_group <> 'ti'").select("item_id", "issue_type")


def in_scope(mode: Column, launch_id: Column, launch_name: Column, q_launch: Column, q_name: Column, q_previous: Column) -> Column:
    """If a candidate's launch lies in the scope that an analyzer mode sets; an unknown or null mode sets none."""
    m = F.upper(F.trim(mode))
    return (
        F.when(m == "LAUNCH_NAME", (launch_name == q_name) & (launch_id != q_launch)).when(m == "CURRENT_AND_THE_SAME_NAME", launch_name == q_name)
        .when(m == "CURRENT_LAUNCH", launch_id == q_launch).when(m == "PREVIOUS_LAUNCH", launch_id == q_previous).when(m == "ALL", launch_id != q_launch).otherwise(True)
    )


@query("f8_scope_modes", """
SELECT i.item_id, m.mode FROM v_item i, (VALUES ('CURRENT_LAUNCH'), ('PREVIOUS_LAUNCH'), ('LAUNCH_NAME'), ('CURRENT_AND_THE_SAME_NAME'), ('ALL'), (''), (' all ')) AS m(mode)
WHERE issue_group IS NOT NULL AND issue_group <> 'ti' AND CASE upper(trim(m.mode)) WHEN 'CURRENT_LAUNCH' THEN launch_id = 5 WHEN 'PREVIOUS_LAUNCH' THEN launch_id = 4 WHEN 'LAUNCH_NAME' THEN launch_name = 'nightly-0' AND launch_id <> 5
WHEN 'CURRENT_AND_THE_SAME_NAME' THEN launch_name = 'nightly-0' WHEN 'ALL' THEN launch_id <> 5 ELSE TRUE END""")
def f8(v: Views) -> DataFrame:
    """The labelled history that each mode lets launch 5, a nightly-0, look at; '' is the default."""
    modes = F.array(*[F.lit(m) for m in ("CURRENT_LAUNCH", "PREVIOUS_LAUNCH", "LAUNCH_NAME", "CURRENT_AND_THE_SAME_NAME", "ALL", "", " all ")])
    rows = v("v_item").where("issue_group IS NOT NULL AND issue_group <> 'ti'").withColumn("mode", F.explode(modes))
    return rows.where(in_scope(F.col("mode"), F.col("launch_id"), F.col("launch_name"), F.lit(5), F.lit("nightly-0"), F.lit(4))).select("item_id", "mode")


@query("f11_template_search", "SELECT DISTINCT template_id, pattern FROM v_template WHERE pattern ILIKE '%PUR%'")
def f11(v: Views) -> DataFrame:
    return v("v_template").where(F.col("pattern").ilike("%PUR%")).select("template_id", "pattern").distinct()


@query("f12_signature_search", "SELECT item_id FROM v_signature WHERE exc_text ILIKE '%KEYERR%' OR msg_text ILIKE '%thandon%' OR frames_text ILIKE '%case7.STEP3%'")
def f12(v: Views) -> DataFrame:
    return v("v_signature").where(F.col("exc_text").ilike("%KEYERR%") | F.col("msg_text").ilike("%thandon%") | F.col("frames_text").ilike("%case7.STEP3%")).select("item_id")


#: The groups that outcomes of a text model's calls are filtered by.
OUTCOME_GROUPS = {"ok": ("ok",), "guardrail": ("guardrail", "invalid", "rejected"), "unavailable": ("timeout", "error", "circuit_open")}


@query("f13_llm_event_filter", "SELECT event_id, role, CASE outcome WHEN 'ok' THEN 'ok' WHEN 'guardrail' THEN 'guardrail' ELSE 'unavailable' END AS outcome_group FROM v_llm_event WHERE role IN ('click', 'view') AND outcome IN ('guardrail', 'timeout')")
def f13(v: Views) -> DataFrame:
    """Events of two roles that didn't go well, by group of outcome."""
    group = F.coalesce(*[F.when(F.col("outcome").isin(*names), F.lit(g)) for g, names in OUTCOME_GROUPS.items()])
    return v("v_llm_event").select("event_id", "role", group.alias("outcome_group")).where(F.col("role").isin("click", "view") & F.col("outcome_group").isin("guardrail", "unavailable"))


@query("f14_time_window_delete", "SELECT item_id FROM v_item WHERE NOT coalesce(start_time >= TIMESTAMP '2024-01-05 00:00:00' AND start_time < TIMESTAMP '2024-01-10 00:00:00', FALSE)")
def f14(v: Views) -> DataFrame:
    gone = (F.col("start_time") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("start_time") < F.lit("2024-01-10").cast("timestamp"))
    return delete_matching(v("v_item"), gone).select("item_id")


@query("f15_fresh_rows", f"SELECT event_id FROM v_llm_event WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def f15(v: Views) -> DataFrame:
    return v("v_llm_event").where(F.col("created_at") >= now() - F.expr("INTERVAL '14' DAY")).select("event_id")


@query("f16_training_snapshot", "SELECT event_id FROM v_label_event WHERE source IS DISTINCT FROM 'early'")
def f16(v: Views) -> DataFrame:
    return v("v_label_event").where(~F.col("source").eqNullSafe("early")).select("event_id")


@query("f17_model_prefix", "SELECT suggestion_id FROM v_suggestion WHERE model_ver LIKE 'rubric+%' OR model_ver LIKE 'rule_cold%'")
def f17(v: Views) -> DataFrame:
    return v("v_suggestion").where(F.col("model_ver").startswith("rubric+") | F.col("model_ver").startswith("rule_cold")).select("suggestion_id")


# joins


@query("j1_signature_item", "SELECT s.item_id, i.launch_id, s.error_hash FROM v_signature s JOIN v_item i USING (project_id, item_id)")
def j1(v: Views) -> DataFrame:
    return v("v_signature").join(v("v_item"), ["project_id", "item_id"]).select("item_id", "launch_id", "error_hash")


@query("j4_latest_label", """
SELECT i.item_id, l.new_label, l.source FROM v_item i LEFT JOIN
(SELECT item_id, arg_max(new_label, {'t': ts, 'e': event_id}) AS new_label, arg_max(source, {'t': ts, 'e': event_id}) AS source FROM v_label_event GROUP BY item_id) l USING (item_id)""")
def j4(v: Views) -> DataFrame:
    return v("v_item").select("item_id").join(latest(v("v_label_event"), ["item_id"], ["ts", "event_id"], ["new_label", "source"]), "item_id", "left")


@query("j5_best_mode", "SELECT item_id, arg_max(mode_id, match_score) AS mode_id FROM v_mode_member GROUP BY item_id")
def j5(v: Views) -> DataFrame:
    return v("v_mode_member").groupBy("item_id").agg(F.max_by("mode_id", "match_score").alias("mode_id"))


@query("j6_point_in_time", """
SELECT event_id, suggestion_id, confidence FROM (SELECT l.event_id, s.suggestion_id, s.confidence,
row_number() OVER (PARTITION BY l.event_id ORDER BY s.created_at DESC, s.suggestion_id DESC) AS k
FROM v_label_event l LEFT JOIN v_suggestion s ON s.item_id = l.item_id AND s.created_at <= l.ts AND s.model_ver IS DISTINCT FROM 'rule_cold') WHERE k = 1""")
def j6(v: Views) -> DataFrame:
    found = as_of(v("v_label_event").select("item_id", "event_id", "ts"), v("v_suggestion").where(~F.col("model_ver").eqNullSafe("rule_cold")), ["item_id"], "ts", "created_at", "suggestion_id", ["suggestion_id", "confidence"])
    return found.select("event_id", "suggestion_id", "confidence")


@query("j7_training_frame", """
WITH h AS (SELECT test_case_hash, count(*) AS runs, count(*) FILTER (WHERE failed) AS failures FROM v_history GROUP BY ALL),
m AS (SELECT item_id, arg_max(mode_id, match_score) AS mode_id FROM v_mode_member GROUP BY item_id)
SELECT l.event_id, l.new_label, i.issue_group, h.runs, h.failures, m.mode_id FROM v_label_event l LEFT JOIN v_item i USING (item_id)
LEFT JOIN h ON h.test_case_hash = i.test_case_hash LEFT JOIN m ON m.item_id = l.item_id WHERE l.source IS DISTINCT FROM 'early'""")
def j7(v: Views) -> DataFrame:
    history = v("v_history").groupBy("test_case_hash").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"))
    modes = v("v_mode_member").groupBy("item_id").agg(F.max_by("mode_id", "match_score").alias("mode_id"))
    events = v("v_label_event").where(~F.col("source").eqNullSafe("early")).select("event_id", "item_id", "new_label")
    items = v("v_item").select("item_id", "issue_group", "test_case_hash")
    return events.join(items, "item_id", "left").join(history, "test_case_hash", "left").join(modes, "item_id", "left").select("event_id", "new_label", "issue_group", "runs", "failures", "mode_id")


@query("j8_orphan_events", "SELECT event_id FROM v_label_event l WHERE NOT EXISTS (SELECT 1 FROM v_item i WHERE i.item_id = l.item_id)")
def j8(v: Views) -> DataFrame:
    return v("v_label_event").join(v("v_item"), "item_id", "left_anti").select("event_id")


@query("j9_items_with_events", "SELECT item_id FROM v_item i WHERE EXISTS (SELECT 1 FROM v_label_event l WHERE l.item_id = i.item_id)")
def j9(v: Views) -> DataFrame:
    return v("v_item").join(v("v_label_event"), "item_id", "left_semi").select("item_id")


@query("j13_array_overlap", "SELECT DISTINCT a.item_id AS item_id, b.item_id AS other_id FROM v_signature a JOIN v_signature b ON a.project_id = b.project_id AND list_has_any(a.template_ids, b.template_ids) WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id")
def j13(v: Views) -> DataFrame:
    """Sets overlap where an element is shared: exploded elements join by equality, and a pair is made at the least element it shares,
    so pairs, which grow with the square of the items, are neither shuffled nor held. The asking rows are a stated query set."""
    signatures = v("v_signature")
    sets = signatures.groupBy("project_id", "item_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("template_ids"))))).alias("set"))
    parts = sets.select("project_id", "item_id", "set", F.posexplode("set").alias("place", "t")).select("project_id", "item_id", "t", F.slice("set", F.lit(1), F.col("place")).alias("less"))
    return _meeting(parts, v("v_item").count())


def _meeting(parts: DataFrame, n: int, share_items: int = 16_384) -> DataFrame:
    """(item_id, other_id) of (project_id, item_id, t, less) of n items, for asking items with others that share t and nothing less.
    An element that very many items hold is met in shares of about ``share_items``."""
    shares = max(1, -(-n // share_items))
    keys = ["project_id", "t", "share"]
    others = parts.select("project_id", "t", F.pmod(F.xxhash64("item_id"), F.lit(shares)).cast("int").alias("share"), F.col("item_id").alias("other_id"), F.col("less").alias("other_less"))
    asking = parts.where("item_id % 50 = 0").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = others.repartition(8 * shares, *keys).join(asking.repartition(8 * shares, *keys), keys)
    return met.where((F.col("item_id") != F.col("other_id")) & ~F.arrays_overlap("less", "other_less")).select("item_id", "other_id")


@query("j14_hash_seen_elsewhere", "SELECT s.item_id, (SELECT count(DISTINCT i2.launch_id) FROM v_signature s2 JOIN v_item i2 USING (item_id) WHERE s2.project_id = s.project_id AND s2.error_hash = s.error_hash) > 1 AS seen FROM v_signature s")
def j14(v: Views) -> DataFrame:
    placed = v("v_signature").select("project_id", "item_id", "error_hash").join(v("v_item").select("item_id", "launch_id"), "item_id")
    spread = placed.groupBy("project_id", "error_hash").agg((F.min("launch_id") < F.max("launch_id")).alias("seen"))
    return v("v_signature").select("project_id", "item_id", "error_hash").join(spread, ["project_id", "error_hash"]).select("item_id", "seen")


@query("j17_project_counts", """
SELECT p.project_id, coalesce(i.n, 0) AS items, coalesce(i.l, 0) AS launches FROM (VALUES (1), (2), (3)) p(project_id)
LEFT JOIN (SELECT project_id, count(*) AS n, count(DISTINCT launch_id) AS l FROM v_item GROUP BY project_id) i USING (project_id)""")
def j17(v: Views) -> DataFrame:
    items = v("v_item")
    projects = items.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("project_id"))
    counts = items.groupBy("project_id").agg(F.count("*").alias("n"), F.count_distinct("launch_id").alias("l"))
    return projects.join(counts, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("l", F.lit(0)).alias("launches"))


@query("j20_item_list", "SELECT i.item_id, i.issue_type, s.emb IS NOT NULL AS has_emb FROM v_item i LEFT JOIN v_signature s USING (project_id, item_id)")
def j20(v: Views) -> DataFrame:
    signatures = v("v_signature").select("project_id", "item_id", F.col("emb").isNotNull().alias("e"))
    return v("v_item").join(signatures, ["project_id", "item_id"], "left").select("item_id", "issue_type", F.coalesce("e", F.lit(False)).alias("has_emb"))


# ranking


@query("w3_latest_per_item", "SELECT item_id, suggestion_id, predicted_label FROM v_suggestion QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, suggestion_id DESC) = 1")
def w3(v: Views) -> DataFrame:
    return latest(v("v_suggestion"), ["item_id"], ["created_at", "suggestion_id"], ["suggestion_id", "predicted_label"])


@query("w4_latest_rubric", f"""
WITH r AS (SELECT 'rubric' AS kind, item_id, suggestion_id AS id, created_at FROM v_suggestion WHERE model_ver LIKE 'rubric+%' UNION ALL SELECT 'latest', item_id, suggestion_id, created_at FROM v_suggestion
  UNION ALL SELECT 'judge', item_id, event_id, created_at FROM v_llm_event WHERE role = 'purchase' AND outcome = 'ok' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '14' DAY)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind, item_id ORDER BY created_at DESC, id DESC) = 1""")
def w4(v: Views) -> DataFrame:
    """For each item the last provisional suggestion of the rubric, the last judgement of the last 14 days, and the last suggestion."""
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), "item_id", F.col(key).alias("id"), "created_at")
    s, e = v("v_suggestion"), v("v_llm_event")
    fresh = F.col("created_at").cast("timestamp") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 14 DAYS")
    rows = row(s.where(F.col("model_ver").startswith("rubric+")), "rubric", "suggestion_id").union(row(s, "latest", "suggestion_id")).union(row(e.where((F.col("role") == "purchase") & (F.col("outcome") == "ok") & fresh), "judge", "event_id"))
    return latest(rows.withColumn("at", F.col("created_at")), ["kind", "item_id"], ["at", "id"], ["id", "created_at"])


@query("w6_chronological_split", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= floor(0.8 * count(*) OVER ()) AS train FROM v_label_event")
def w6(v: Views) -> DataFrame:
    """Places in time order without one task: range partitions, their counts, then places inside each. The partitions are written
    once, so that both uses see the same."""
    rows = v("v_label_event").select("event_id", "ts")
    path = f"{shared_dir(rows.sparkSession)}/split-{uuid.uuid4().hex}"
    rows.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("ts", "event_id"))).join(F.broadcast(earlier), "part")
    return placed.select("event_id", (F.col("k") + F.col("start") <= F.floor(F.col("total") * 0.8)).alias("train"))


@query("w8_flakiness", """
WITH o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY test_case_hash) AS n, failed IS DISTINCT FROM lag(failed) OVER w AND row_number() OVER w > 1 AS flip FROM v_history WINDOW w AS (PARTITION BY test_case_hash ORDER BY ts, event_id))
SELECT test_case_hash, count(*) AS runs, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE flip) AS flips, round(coalesce(sum(0.1 * pow(0.9, n - k)) FILTER (WHERE flip), 0), 6) AS flakiness, max(ts) FILTER (WHERE failed) AS last_failure FROM o GROUP BY test_case_hash""")
def w8(v: Views) -> DataFrame:
    w = Window.partitionBy("test_case_hash").orderBy("ts", "event_id")
    rows = v("v_history").withColumn("k", F.row_number().over(w)).withColumn("flip", F.coalesce(F.col("failed") != F.lag("failed").over(w), F.lit(False))).withColumn("n", F.count("*").over(Window.partitionBy("test_case_hash")))
    score = F.coalesce(F.sum(F.when(F.col("flip"), 0.1 * F.pow(F.lit(0.9), F.col("n") - F.col("k")))), F.lit(0.0))
    return rows.groupBy("test_case_hash").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.count_if("flip").alias("flips"), F.round(score, 6).alias("flakiness"), F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_failure"))


@query("w16_representative", """
SELECT error_hash, item_id FROM v_signature s JOIN v_item i USING (project_id, item_id)
QUALIFY row_number() OVER (PARTITION BY error_hash ORDER BY (issue_type IS NULL OR issue_group = 'ti'), item_id) = 1""")
def w16(v: Views) -> DataFrame:
    rows = v("v_signature").select("project_id", "item_id", "error_hash").join(v("v_item").select("project_id", "item_id", "issue_group"), ["project_id", "item_id"])
    unlabelled = F.coalesce(F.col("issue_group") == "ti", F.lit(True))
    return rows.groupBy("error_hash").agg(F.min_by("item_id", F.struct(unlabelled, F.col("item_id"))).alias("item_id"))


@query("w17_capped_members", "SELECT error_hash, item_id, count(*) OVER (PARTITION BY error_hash) AS total FROM v_signature QUALIFY row_number() OVER (PARTITION BY error_hash ORDER BY item_id) <= 50")
def w17(v: Views) -> DataFrame:
    rows = v("v_signature").select("error_hash", "item_id")
    totals = rows.groupBy("error_hash").agg(F.count("*").alias("total"))
    return top_k(rows, ["error_hash"], [F.asc("item_id")], 50).join(totals, "error_hash").select("error_hash", "item_id", "total")


# merges


@query("s8_upsert_items", """
WITH n AS (SELECT * FROM v_item WHERE item_id % 3 = 0)
SELECT i.item_id, CASE WHEN n.item_id IS NOT NULL THEN 'relabelled' ELSE i.issue_type END AS issue_type FROM v_item i LEFT JOIN n USING (item_id)""")
def s8(v: Views) -> DataFrame:
    old = v("v_item").select("item_id", "issue_type")
    return upsert(old, old.where("item_id % 3 = 0").withColumn("issue_type", F.lit("relabelled")), ["item_id"])




@query("a1_daily_rollup", """
SELECT project_id, CAST(created_at AS DATE) AS day, count(*) AS suggestions, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'corrected') AS corrected,
count(*) FILTER (WHERE outcome = 'ignored') AS ignored, count(*) FILTER (WHERE predicted_label LIKE 'ti%') AS abstained, count(*) FILTER (WHERE confidence >= 0.75 AND predicted_label NOT LIKE 'ti%') AS auto_labeled,
arg_max(model_ver, {'t': created_at, 'i': suggestion_id}) AS model_ver FROM v_suggestion GROUP BY ALL""")
def a1(v: Views) -> DataFrame:
    abstained = F.col("predicted_label").startswith("ti")
    return v("v_suggestion").groupBy("project_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("suggestions"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "corrected", "ignored")], F.count_if(abstained).alias("abstained"),
        F.count_if((F.col("confidence") >= 0.75) & ~abstained).alias("auto_labeled"), F.max_by("model_ver", F.struct("created_at", "suggestion_id")).alias("model_ver"))


@query("a4_mode_purity", """
WITH c AS (SELECT mode_id, issue_group, count(*) AS n FROM v_mode_member JOIN v_item USING (item_id) WHERE issue_group IS NOT NULL GROUP BY ALL)
SELECT mode_id, sum(n)::BIGINT AS support, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY mode_id""")
def a4(v: Views) -> DataFrame:
    labelled = v("v_mode_member").select("mode_id", "item_id").join(v("v_item").where("issue_group IS NOT NULL").select("item_id", "issue_group"), "item_id")
    return labelled.groupBy("mode_id", "issue_group").agg(F.count("*").alias("n")).groupBy("mode_id").agg(F.sum("n").alias("support"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


@query("a5_mode_centroid", """
SELECT mode_id, k - 1 AS k, round(avg(CAST(emb[k] AS DOUBLE)), 5) AS mean FROM v_mode_member JOIN v_signature USING (item_id), range(1, 65) AS r(k) GROUP BY ALL""")
def a5(v: Views) -> DataFrame:
    parts = v("v_mode_member").select("mode_id", "item_id").join(v("v_signature").select("item_id", "emb"), "item_id").select("mode_id", F.posexplode("emb").alias("k", "x"))
    return parts.groupBy("mode_id", F.col("k").cast("long").alias("k")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("a8_launch_list", "SELECT launch_id, count(*) AS items, count(*) FILTER (WHERE issue_type IS NULL) AS unlabelled, max(start_time) AS last_start FROM v_item GROUP BY launch_id")
def a8(v: Views) -> DataFrame:
    return v("v_item").groupBy("launch_id").agg(F.count("*").alias("items"), F.count_if(F.col("issue_type").isNull()).alias("unlabelled"), F.max("start_time").alias("last_start"))


@query("a9_signature_explorer", """
SELECT error_hash, count(*) AS members, count(DISTINCT exception_fp) AS fps, min(start_time) AS first_seen, max(start_time) AS last_seen, count(DISTINCT issue_group) FILTER (WHERE issue_group <> 'ti') AS n_groups,
array_to_string(list_sort(list_distinct(list(issue_type) FILTER (WHERE issue_type IS NOT NULL))), ',') AS labels FROM v_signature JOIN v_item USING (project_id, item_id) GROUP BY error_hash HAVING count(*) > 1""")
def a9(v: Views) -> DataFrame:
    rows = v("v_signature").select("project_id", "item_id", "error_hash", "exception_fp").join(v("v_item"), ["project_id", "item_id"])
    return rows.groupBy("error_hash").agg(
        F.count("*").alias("members"), F.count_distinct("exception_fp").alias("fps"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"),
        F.count_distinct(F.when(F.col("issue_group") != "ti", F.col("issue_group"))).alias("n_groups"), F.nullif(F.array_join(F.array_sort(F.collect_set("issue_type")), ","), F.lit("")).alias("labels")).where("members > 1")


@query("a10_conflict_total", "SELECT count(*) AS conflicts FROM (SELECT error_hash FROM v_signature JOIN v_item USING (project_id, item_id) WHERE issue_group <> 'ti' GROUP BY error_hash HAVING count(DISTINCT issue_group) > 1)")
def a10(v: Views) -> DataFrame:
    rows = v("v_signature").select("project_id", "item_id", "error_hash").join(v("v_item").where("issue_group <> 'ti'").select("project_id", "item_id", "issue_group"), ["project_id", "item_id"])
    return rows.groupBy("error_hash").agg((F.min("issue_group") < F.max("issue_group")).alias("conflict")).agg(F.count_if("conflict").alias("conflicts"))


@query("a11_fingerprint_space", "SELECT count(*) AS signatures, count(DISTINCT exception_fp) AS fps, count(DISTINCT error_hash) AS hashes, count(*) FILTER (WHERE emb IS NOT NULL) AS embedded FROM v_signature")
def a11(v: Views) -> DataFrame:
    return v("v_signature").agg(F.count("*").alias("signatures"), F.count_distinct("exception_fp").alias("fps"), F.count_distinct("error_hash").alias("hashes"), F.count_if(F.col("emb").isNotNull()).alias("embedded"))


@query("a12_label_breakdown", "SELECT coalesce(substr(issue_type, 1, 2), 'none') AS label_group, count(*) AS n FROM v_item GROUP BY ALL")
def a12(v: Views) -> DataFrame:
    return v("v_item").groupBy(shown_group(F.col("issue_type")).alias("label_group")).agg(F.count("*").alias("n"))


@query("a14_maturity", """
SELECT project_id, count(*) AS events, count(*) FILTER (WHERE source = 'human_ui') AS human, count(DISTINCT item_id) FILTER (WHERE new_label <> 'ti') AS labelled,
CASE WHEN count(DISTINCT item_id) FILTER (WHERE new_label <> 'ti') < 50 THEN 'cold' WHEN count(DISTINCT item_id) FILTER (WHERE new_label <> 'ti') < 300 THEN 'warm' ELSE 'hot' END AS stage FROM v_label_event GROUP BY project_id""")
def a14(v: Views) -> DataFrame:
    rows = v("v_label_event").groupBy("project_id").agg(F.count("*").alias("events"), F.count_if(F.col("source") == "human_ui").alias("human"), F.count_distinct(F.when(F.col("new_label") != "ti", F.col("item_id"))).alias("labelled"))
    return rows.withColumn("stage", F.when(F.col("labelled") < 50, "cold").when(F.col("labelled") < 300, "warm").otherwise("hot"))


@query("a15_llm_summary", """
SELECT role, count(*) AS n, count(*) FILTER (WHERE cache_hit) AS cached, count(*) FILTER (WHERE outcome = 'ok') AS ok, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.9), 4) AS p90, max(latency_ms) AS longest, max(created_at) AS last_event FROM v_llm_event GROUP BY role""")
def a15(v: Views) -> DataFrame:
    p = lambda q: F.round(F.percentile("latency_ms", q), 4)
    return v("v_llm_event").groupBy("role").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("cached"), F.count_if(F.col("outcome") == "ok").alias("ok"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max("latency_ms").alias("longest"), F.max("created_at").alias("last_event"))


@query("a16_role_comparison", "SELECT project_id, count(*) FILTER (WHERE model_ver LIKE 'gbm%') AS gbm, count(*) FILTER (WHERE model_ver LIKE 'gbm%' AND outcome = 'accepted') AS gbm_accepted, count(*) FILTER (WHERE model_ver LIKE 'rubric+%') AS rubric, count(*) FILTER (WHERE model_ver LIKE 'rubric+%' AND outcome = 'accepted') AS rubric_accepted FROM v_suggestion GROUP BY project_id")
def a16(v: Views) -> DataFrame:
    gbm, rubric, accepted = F.col("model_ver").startswith("gbm"), F.col("model_ver").startswith("rubric+"), F.col("outcome") == "accepted"
    return v("v_suggestion").groupBy("project_id").agg(F.count_if(gbm).alias("gbm"), F.count_if(gbm & accepted).alias("gbm_accepted"), F.count_if(rubric).alias("rubric"), F.count_if(rubric & accepted).alias("rubric_accepted"))


@query("a17_template_sets", "SELECT exception_fp, array_to_string(template_ids, ',') AS template_set, count(*) AS n, max(item_id) AS newest FROM v_signature GROUP BY ALL")
def a17(v: Views) -> DataFrame:
    return v("v_signature").groupBy("exception_fp", F.array_join(F.col("template_ids").cast("array<string>"), ",").alias("template_set")).agg(F.count("*").alias("n"), F.max("item_id").alias("newest"))


@query("a22_classification_report", """
WITH l AS (SELECT item_id, arg_max(new_label, {'t': ts, 'e': event_id}) AS truth FROM v_label_event GROUP BY item_id), s AS (SELECT item_id, arg_max(predicted_label, {'t': created_at, 'i': suggestion_id}) AS guess FROM v_suggestion GROUP BY item_id),
p AS (SELECT truth, guess FROM l JOIN s USING (item_id)), n AS (SELECT DISTINCT truth AS label FROM p),
c AS (SELECT label, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE guess = label) AS predicted, count(*) FILTER (WHERE truth = label AND guess = label) AS hits FROM n, p GROUP BY label),
r AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p, hits / support AS r, CASE WHEN hits > 0 THEN 2.0 * hits / (predicted + support) ELSE 0.0 END AS f FROM c)
SELECT label, support, predicted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round((SELECT avg(f) FROM r), 6) AS macro_f1, (SELECT count(*) FROM p WHERE guess LIKE 'ti%') AS abstained FROM r""")
def a22(v: Views) -> DataFrame:
    truth = latest(v("v_label_event"), ["item_id"], ["ts", "event_id"], ["new_label"])
    guess = latest(v("v_suggestion"), ["item_id"], ["created_at", "suggestion_id"], ["predicted_label"])
    sides = F.array(F.struct(F.col("new_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))
    rows = truth.join(guess, "item_id").select((F.col("new_label") == F.col("predicted_label")).alias("hit"), F.inline(sides))
    by_label = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("predicted"), F.count_if(F.col("hit") & (F.col("t") == 1)).alias("hits"))
    # a row a label from here on
    every = Window.partitionBy()
    abstained = F.coalesce(F.sum(F.when(F.col("label").startswith("ti"), F.col("predicted"))).over(every), F.lit(0))
    f1 = F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("predicted") + F.col("support"))).otherwise(0.0)
    scored = by_label.withColumn("abstained", abstained).where("support > 0").withColumn("f", f1)
    return scored.select(
        "label", "support", "predicted", "hits", F.round(F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), 6).alias("precision"), F.round(F.col("hits") / F.col("support"), 6).alias("recall"),
        F.round("f", 6).alias("f1"), F.round(F.avg("f").over(every), 6).alias("macro_f1"), "abstained",
    )


@query("a23_calibration_error", """
WITH b AS (SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN outcome = 'accepted' THEN 1.0 ELSE 0.0 END) AS a FROM v_suggestion WHERE outcome <> 'pending' GROUP BY bin)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""")
def a23(v: Views) -> DataFrame:
    rows = v("v_suggestion").where("outcome <> 'pending'").groupBy(F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.when(F.col("outcome") == "accepted", 1.0).otherwise(0.0)).alias("a"))
    return rows.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


_W = "(s / n + 3.8416 / (2 * n) {0} 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@query("a30_wilson_interval", f"""
WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'accepted') AS s, count(*) FILTER (WHERE model_ver LIKE 'gbm%') AS n1, count(*) FILTER (WHERE outcome = 'accepted' AND model_ver LIKE 'gbm%') AS s1 FROM v_suggestion GROUP BY project_id),
i AS (SELECT project_id, n, s, s / n AS p, {_W.format("-")} AS lo, {_W.format("+")} AS hi, n1, s1 FROM c), j AS (SELECT project_id, s / n AS p, {_W.format("-")} AS lo, {_W.format("+")} AS hi FROM (SELECT project_id, n1 AS n, s1 AS s FROM c))
SELECT project_id, round(i.lo, 6) AS lower, round(i.hi, 6) AS upper, round(j.p - i.p - sqrt((j.p - j.lo) * (j.p - j.lo) + (i.hi - i.p) * (i.hi - i.p)), 6) AS difference_lower FROM i JOIN j USING (project_id)""")
def a30(v: Views) -> DataFrame:
    """The interval of acceptance, and the lower bound of what the model's suggestions have over all."""
    hit, model = F.col("outcome") == "accepted", F.col("model_ver").startswith("gbm")
    rows = v("v_suggestion").groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("s"), F.count_if(model).alias("n1"), F.count_if(hit & model).alias("s1"))
    low, high = wilson(F.col("s"), F.col("n"))
    return rows.select("project_id", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"), F.round(difference_lower(F.col("s1"), F.col("n1"), F.col("s"), F.col("n")), 6).alias("difference_lower"))


# evidence


@query("r7_template_jaccard", """
SELECT a.item_id, b.item_id AS other_id, round(len(list_intersect(a.template_ids, b.template_ids)) / len(list_distinct(list_concat(a.template_ids, b.template_ids))), 6) AS jaccard
FROM v_signature a JOIN v_signature b ON a.error_hash = b.error_hash AND a.project_id = b.project_id AND a.item_id < b.item_id WHERE a.item_id % 50 = 0""")
def r7(v: Views) -> DataFrame:
    s = v("v_signature").select("project_id", "item_id", "error_hash", "template_ids")
    b = s.select("project_id", "error_hash", F.col("item_id").alias("other_id"), F.col("template_ids").alias("t"))
    pairs = s.where("item_id % 50 = 0").join(b, ["project_id", "error_hash"]).where("item_id < other_id")
    return pairs.select("item_id", "other_id", F.round(jaccard(F.col("template_ids"), F.col("t")), 6).alias("jaccard"))


@query("h11_weighted_evidence", f"""
SELECT item_id, round(sum(CASE source WHEN 'rp_defect_update' THEN 1.0 WHEN 'human_ui' THEN 0.9 ELSE 0.3 END * exp(-ln(2.0) * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0 / 90)), 6) AS weight FROM v_label_event GROUP BY item_id""")
def h11(v: Views) -> DataFrame:
    days = (F.unix_micros(now()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return v("v_label_event").groupBy("item_id").agg(F.round(F.sum(source_weight(F.col("source")) * decay(days)), 6).alias("weight"))


@query("d5_bands", "SELECT suggestion_id, CASE WHEN confidence >= 0.75 THEN 'auto' WHEN confidence >= 0.45 THEN 'suggest' ELSE 'abstain' END AS band FROM v_suggestion")
def d5(v: Views) -> DataFrame:
    from ..functions.labels import band

    return v("v_suggestion").select("suggestion_id", band(F.col("confidence")).alias("band"))


@query("t48_base_group", "SELECT item_id, CASE WHEN substr(issue_type, 1, 2) IN ('pb', 'ab', 'si', 'nd') THEN substr(issue_type, 1, 2) END AS base_group FROM v_item")
def t48(v: Views) -> DataFrame:
    return v("v_item").select("item_id", base_group(F.col("issue_type")).alias("base_group"))


@query("g4_burst_prior", """
WITH p AS (SELECT i.launch_id, s.error_hash, s.project_id FROM v_signature s JOIN v_item i USING (project_id, item_id)), g AS (SELECT launch_id, error_hash, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT launch_id, sum(n) AS total FROM g GROUP BY launch_id), f AS (SELECT error_hash, min(launch_id) AS first_launch FROM p GROUP BY error_hash)
SELECT launch_id, error_hash, n, CASE WHEN first_launch = launch_id AND n >= 5 AND n / total > 0.4 THEN round(least(0.9, 0.5 + n / total), 6) ELSE 0.0 END AS si_prior FROM g JOIN t USING (launch_id) JOIN f USING (error_hash)""")
def g4(v: Views) -> DataFrame:
    """A hash that is new, with five members or more and over 0.4 of its launch's failures, is likely systemic."""
    placed = v("v_signature").select("project_id", "item_id", "error_hash").join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    groups = placed.groupBy("launch_id", "error_hash").agg(F.count("*").alias("n"))
    totals = groups.groupBy("launch_id").agg(F.sum("n").alias("total"))
    first = groups.groupBy("error_hash").agg(F.min("launch_id").alias("first_launch"))
    share = F.col("n") / F.col("total")
    burst = (F.col("first_launch") == F.col("launch_id")) & (F.col("n") >= 5) & (share > 0.4)
    return groups.join(totals, "launch_id").join(first, "error_hash").select("launch_id", "error_hash", "n", F.when(burst, F.round(F.least(F.lit(0.9), 0.5 + share), 6)).otherwise(0.0).alias("si_prior"))


@query("l2_outcome_resolve", """
WITH l AS (SELECT item_id, arg_max(new_label, {'t': ts, 'e': event_id}) AS new_label FROM v_label_event GROUP BY item_id)
SELECT suggestion_id, CASE WHEN outcome <> 'pending' OR new_label IS NULL THEN outcome WHEN substr(predicted_label, 1, 2) IN ('pb', 'ab', 'si', 'nd') AND substr(predicted_label, 1, 2) = substr(new_label, 1, 2) THEN 'accepted' ELSE 'corrected' END AS outcome FROM v_suggestion LEFT JOIN l USING (item_id)""")
def l2(v: Views) -> DataFrame:
    rows = v("v_suggestion").join(latest(v("v_label_event"), ["item_id"], ["ts", "event_id"], ["new_label"]), "item_id", "left")
    same = base_group(F.col("predicted_label")) == base_group(F.col("new_label"))
    return rows.select("suggestion_id", F.when((F.col("outcome") != "pending") | F.col("new_label").isNull(), F.col("outcome")).when(same, "accepted").otherwise("corrected").alias("outcome"))


@query("x4_daily_windows", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x4(v: Views) -> DataFrame:
    return v("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
