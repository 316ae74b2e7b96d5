"""Messages, stores, filters, joins, windows, arithmetic and upkeep over the domain views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_group, clamp01, difference_lower, wilson
from ..functions.text import jaccard
from ..operators.feedback import Effects, feedback
from ..operators.relational import latest, top_k, upsert
from ..sources.views import AS_OF
from .decision import MODES_SQL, mode_matches
from .registry import Views, query
from .triage import LABELLED, evidence, hybrid, hybrid_sql

NOW_MS = 1706745600000


def _placed(v: Views) -> DataFrame:
    s = v("v_signature").select("project_id", "item_id", "error_hash", "exception_fp", "template_ids", "status_codes")
    return s.join(v("v_item").select("project_id", "item_id", "launch_id", "launch_name", "launch_number", "test_case_hash", "issue_type", "issue_group", "start_time"), ["project_id", "item_id"])


# messages


@query("s1_dead_letters", "SELECT message_id, NOT json_valid(body) AS dead FROM v_message")
def s1(v: Views) -> DataFrame:
    """Messages whose body isn't JSON go to the dead letters, the others on."""
    parsed = F.from_json("body", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return v("v_message").select("message_id", parsed.alias("m")).select("message_id", (F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()).alias("dead"))


@query("s2_priority", f"SELECT message_id, coalesce(TRY_CAST(rtrim(header, 'L') AS BIGINT), {NOW_MS}) AS priority FROM v_message")
def s2(v: Views) -> DataFrame:
    """The time in a message's header, which may end in L; now, where there is none."""
    return v("v_message").select("message_id", F.coalesce(F.regexp_replace("header", "L+$", "").try_cast("long"), F.lit(NOW_MS)).alias("priority"))


ROUTES = {"view": ("index", False), "click": ("analyze", True), "signup": ("suggest", True), "purchase": ("cluster", True)}


@query("s3_routes", "SELECT message_id, CASE routing_key " + " ".join(f"WHEN '{k}' THEN '{h}'" for k, (h, _) in ROUTES.items()) + " ELSE 'unknown' END AS handler FROM v_message")
def s3(v: Views) -> DataFrame:
    handlers = F.create_map(*[F.lit(x) for k, (h, _) in ROUTES.items() for x in (k, h)])
    return v("v_message").select("message_id", F.coalesce(F.try_element_at(handlers, F.col("routing_key")), F.lit("unknown")).alias("handler"))


@query("s4_replies", "SELECT message_id, CASE WHEN NOT json_valid(body) THEN 'dead' WHEN routing_key IN ('click', 'signup', 'purchase') THEN 'reply' WHEN routing_key = 'view' THEN 'exchange' ELSE 'dropped' END AS sink, CASE WHEN NOT json_valid(body) THEN routing_key END AS x_routing_key FROM v_message")
def s4(v: Views) -> DataFrame:
    """Where the answer to a message goes: back, to the exchange of results, to the dead letters with its key, or nowhere."""
    rows = v("v_message").join(s1(v), "message_id").join(s3(v), "message_id")
    replies = [h for h, reply in ROUTES.values() if reply]
    sink = F.when(F.col("dead"), "dead").when(F.col("handler").isin(*replies), "reply").when(F.col("handler") == "unknown", "dropped").otherwise("exchange")
    return rows.select("message_id", sink.alias("sink"), F.when(F.col("dead"), F.col("routing_key")).alias("x_routing_key"))


@query("s6_log_order", "SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos * 7 % 5, pos) - 1 AS place FROM v_log")
def s6(v: Views) -> DataFrame:
    """An item's logs by time (here pos * 7 % 5), in stable order."""
    w = Window.partitionBy("item_id").orderBy(F.col("pos") * 7 % 5, "pos")
    return v("v_log").select("item_id", "pos", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("s5_indexed_items", """
WITH l AS (SELECT item_id, min(pos) FILTER (WHERE log_level >= 40000) AS first_error, count(*) AS n_logs FROM v_log GROUP BY item_id)
SELECT i.item_id, nullif(lower(trim(issue_type)), '') AS issue_type, nullif(test_case_hash, 0) AS test_case_hash, first_error, coalesce(n_logs, 0) AS n_logs, error_hash FROM v_item i LEFT JOIN l USING (item_id) JOIN v_signature s USING (project_id, item_id)""")
def s5(v: Views) -> DataFrame:
    """What indexing writes for each item: the projected item, its first error and its signature's hash."""
    logs = v("v_log").groupBy("item_id").agg(F.min(F.when(F.col("log_level") >= 40000, F.col("pos"))).alias("first_error"), F.count("*").alias("n_logs"))
    rows = v("v_item").join(logs, "item_id", "left").join(v("v_signature").select("project_id", "item_id", "error_hash"), ["project_id", "item_id"])
    return rows.select("item_id", F.nullif(F.lower(F.trim("issue_type")), F.lit("")).alias("issue_type"), F.nullif("test_case_hash", F.lit(0)).alias("test_case_hash"), "first_error", F.coalesce("n_logs", F.lit(0)).alias("n_logs"), "error_hash")


@query("s9_signature_upsert", """
WITH o AS (SELECT item_id, error_hash, item_id * 10 AS error_log_id FROM v_signature WHERE item_id % 3 <> 0), n AS (SELECT item_id, error_hash + 1 AS error_hash, CASE WHEN item_id % 4 = 0 THEN item_id * 10 + 1 END AS error_log_id FROM v_signature WHERE item_id % 2 = 0)
SELECT coalesce(n.item_id, o.item_id) AS item_id, CASE WHEN n.item_id IS NOT NULL THEN n.error_hash ELSE o.error_hash END AS error_hash, coalesce(n.error_log_id, o.error_log_id) AS error_log_id FROM o FULL JOIN n USING (item_id)""")
def s9(v: Views) -> DataFrame:
    """New signatures replace old ones, but an unknown log id keeps the old one."""
    s = v("v_signature").select("item_id", "error_hash")
    old = s.where("item_id % 3 <> 0").select("item_id", "error_hash", (F.col("item_id") * 10).alias("error_log_id"))
    new = s.where("item_id % 2 = 0").select("item_id", (F.col("error_hash") + 1).alias("error_hash"), F.when(F.col("item_id") % 4 == 0, F.col("item_id") * 10 + 1).alias("error_log_id"))
    return upsert(old, new, ["item_id"], ("error_log_id",))


@query("s10_template_mirror", """
WITH t AS (SELECT user_id % 11 AS template_id, event_id, concat('step ', event_type, ' <NUM>') AS pattern, CASE WHEN event_id % 3 = 0 THEN concat('line ', event_id) END AS example, ts FROM events)
SELECT template_id, arg_max(pattern, event_id) AS pattern, count(*) AS match_count, arg_min(example, event_id) FILTER (WHERE example IS NOT NULL) AS example, max(ts) AS last_seen FROM t GROUP BY template_id""")
def s10(v: Views) -> DataFrame:
    """The mirror of mined templates: newest pattern, uses added up, first example kept, last time seen."""
    e = v("events")
    example = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("line "), F.col("event_id").cast("string")))
    t = e.select((F.col("user_id") % 11).alias("template_id"), "event_id", F.concat(F.lit("step "), "event_type", F.lit(" <NUM>")).alias("pattern"), example.alias("example"), "ts")
    first = F.min_by("example", F.when(F.col("example").isNotNull(), F.col("event_id")))
    return t.groupBy("template_id").agg(F.max_by("pattern", "event_id").alias("pattern"), F.count("*").alias("match_count"), first.alias("example"), F.max("ts").alias("last_seen"))


@query("s15_vector_text", "SELECT item_id, template_ids AS vector FROM v_signature")
def s15(v: Views) -> DataFrame:
    """Vectors written as text and read again."""
    return v("v_signature").select("item_id", F.to_json("template_ids").alias("t")).select("item_id", F.from_json("t", "array<bigint>").alias("vector"))


@query("s18_demo_corpus", "SELECT event_id, CASE WHEN event_type = 'error' THEN array_to_string(list_transform(range(3), lambda i: concat('user ', user_id, ' got error')), chr(10)) ELSE concat('user ', user_id, ' got ', event_type) END AS text FROM events")
def s18(v: Views) -> DataFrame:
    """Placeholders of an archetype filled from a row, one inside the other; errors repeat."""
    kind = F.when(F.col("event_type") == "error", F.lit("{who} got error")).otherwise(F.lit("{who} got {what}"))
    filled = F.replace(F.replace(F.replace(kind, F.lit("{who}"), F.lit("user {id}")), F.lit("{id}"), F.col("user_id").cast("string")), F.lit("{what}"), F.col("event_type"))
    return v("events").select("event_id", F.when(F.col("event_type") == "error", F.array_join(F.array_repeat(filled, 3), "\n")).otherwise(filled).alias("text"))


@query("s20_cache_hits", "SELECT item_id, count(*) FILTER (WHERE cache_hit) AS hits, max(created_at) FILTER (WHERE cache_hit) AS last_hit_at, max(created_at) FILTER (WHERE NOT cache_hit) AS created_at FROM v_llm_event GROUP BY item_id")
def s20(v: Views) -> DataFrame:
    """A cache entry's uses as one change a batch: hits add up, and a new answer starts its age again."""
    at = lambda c: F.max(F.when(c, F.col("created_at")))
    return v("v_llm_event").groupBy("item_id").agg(F.count_if("cache_hit").alias("hits"), at(F.col("cache_hit")).alias("last_hit_at"), at(~F.col("cache_hit")).alias("created_at"))


@query("s21_role_states", "SELECT r.role, coalesce(s.enabled, TRUE) AS enabled FROM (SELECT DISTINCT role FROM v_llm_event) r LEFT JOIN (SELECT 'click' AS role, FALSE AS enabled) s USING (role)")
def s21(v: Views) -> DataFrame:
    """A role that no one has switched is on."""
    roles = v("v_llm_event").select("role").distinct()
    states = roles.where("role = 'click'").select("role", F.lit(False).alias("enabled"))
    return roles.join(states, "role", "left").select("role", F.coalesce("enabled", F.lit(True)).alias("enabled"))


@query("s23_partitions", "SELECT project_id % 16 AS part, count(*) AS n FROM v_item GROUP BY ALL")
def s23(v: Views) -> DataFrame:
    """Sixteen partitions by project."""
    return v("v_item").groupBy(F.pmod("project_id", F.lit(16)).alias("part")).agg(F.count("*").alias("n"))


@query("s24_result_export", """
SELECT item_id, predicted_label, confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM v_suggestion s JOIN events e ON e.event_id = s.suggestion_id QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, suggestion_id DESC) = 1""")
def s24(v: Views) -> DataFrame:
    rows = v("v_suggestion").join(v("events").select(F.col("event_id").alias("suggestion_id"), F.get_json_object("props", "$.k").cast("long").alias("k")), "suggestion_id")
    return latest(rows, ["item_id"], ["created_at", "suggestion_id"], ["predicted_label", "confidence", "k"])


# filters and joins


@query("f7_candidate_filters", f"""
WITH l AS (SELECT item_id, max(ts) AS ts FROM v_label_event GROUP BY item_id)
SELECT i.item_id FROM v_item i LEFT JOIN l USING (item_id) WHERE i.item_id % 10 <> 0 AND launch_id <> 5 AND (l.ts IS NULL OR l.ts >= TIMESTAMP '2024-01-05 00:00:00') AND substr(issue_type, 1, 2) IN ('pb', 'si')""")
def f7(v: Views) -> DataFrame:
    """Without the excluded items and launches, not labelled too long ago, of the asked groups."""
    last = v("v_label_event").groupBy("item_id").agg(F.max("ts").alias("label_ts"))
    out = v("v_item").select("item_id").where("item_id % 10 = 0")
    rows = v("v_item").join(out, "item_id", "left_anti").where(F.col("launch_id") != 5).join(last, "item_id", "left")
    fresh = F.col("label_ts").isNull() | (F.col("label_ts") >= F.lit("2024-01-05").cast("timestamp"))
    return rows.where(fresh & F.substring("issue_type", 1, 2).isin("pb", "si")).select("item_id")


@query("j3_one_row_query", "WITH q AS (SELECT error_hash AS asked FROM v_signature WHERE item_id = 0) SELECT item_id FROM v_signature, q WHERE error_hash = asked")
def j3(v: Views) -> DataFrame:
    """Every row meets a query of one row."""
    asked = v("v_signature").where("item_id = 0").select(F.col("error_hash").alias("asked")).limit(1)
    return v("v_signature").join(F.broadcast(asked), F.col("error_hash") == F.col("asked")).select("item_id")


@query("j10_delete_using", "SELECT event_id FROM v_label_event e WHERE NOT EXISTS (SELECT 1 FROM v_item i WHERE i.item_id = e.item_id AND i.launch_id = 1)")
def j10(v: Views) -> DataFrame:
    gone = v("v_item").where("launch_id = 1").select("item_id")
    return v("v_label_event").join(gone, "item_id", "left_anti").select("event_id")


@query("j12_batch_gets", "SELECT i.item_id, launch_name, error_hash FROM v_item i JOIN v_signature USING (project_id, item_id) WHERE i.item_id IN (1, 5, 9, 400)")
def j12(v: Views) -> DataFrame:
    ids = (1, 5, 9, 400)
    return v("v_item").where(F.col("item_id").isin(*ids)).select("project_id", "item_id", "launch_name").join(v("v_signature").select("project_id", "item_id", "error_hash"), ["project_id", "item_id"]).select("item_id", "launch_name", "error_hash")


@query("j16_group_dictionary", """
WITH g AS (SELECT launch_id, error_hash, min(i.item_id) AS group_id, count(*) AS members FROM v_signature s JOIN v_item i USING (project_id, item_id) GROUP BY ALL HAVING count(*) >= 2)
SELECT i.item_id, g.group_id, g.members FROM v_signature s JOIN v_item i USING (project_id, item_id) LEFT JOIN g USING (launch_id, error_hash)""")
def j16(v: Views) -> DataFrame:
    p = _placed(v).select("launch_id", "error_hash", "item_id")
    groups = p.groupBy("launch_id", "error_hash").agg(F.min("item_id").alias("group_id"), F.count("*").alias("members")).where("members >= 2")
    return p.join(groups, ["launch_id", "error_hash"], "left").select("item_id", "group_id", "members")


@query("j19_expectations", """
WITH e AS (SELECT DISTINCT predicted_label AS archetype, outcome AS truth, concat(predicted_label, '/', outcome) AS want FROM v_suggestion WHERE outcome = 'accepted'), f AS (SELECT DISTINCT predicted_label AS archetype, concat(predicted_label, '/any') AS want FROM v_suggestion WHERE predicted_label <> 'ti001')
SELECT suggestion_id, coalesce(e.want, f.want) AS want FROM v_suggestion s LEFT JOIN e ON e.archetype = s.predicted_label AND e.truth = s.outcome LEFT JOIN f ON f.archetype = s.predicted_label""")
def j19(v: Views) -> DataFrame:
    """The expectation of (archetype, truth), else of the archetype."""
    s = v("v_suggestion").select("suggestion_id", F.col("predicted_label").alias("archetype"), F.col("outcome").alias("truth"))
    exact = s.where("truth = 'accepted'").select("archetype", "truth", F.concat_ws("/", "archetype", "truth").alias("exact")).distinct()
    other = s.where("archetype <> 'ti001'").select("archetype", F.concat("archetype", F.lit("/any")).alias("other")).distinct()
    return s.join(exact, ["archetype", "truth"], "left").join(other, "archetype", "left").select("suggestion_id", F.coalesce("exact", "other").alias("want"))


@query("j23_item_facts", "SELECT i.item_id, launch_name, start_time, error_hash, exc_text FROM v_signature s JOIN v_item i USING (project_id, item_id) WHERE i.item_id = 26")
def j23(v: Views) -> DataFrame:
    return v("v_signature").where("item_id = 26").join(v("v_item"), ["project_id", "item_id"]).select("item_id", "launch_name", "start_time", "error_hash", "exc_text")


@query("r11_candidates", hybrid_sql(LABELLED, 20) + ", " + MODES_SQL.replace("q AS (", "mq AS (").replace("FROM q JOIN v_mode", "FROM mq JOIN v_mode") + """,
u AS (SELECT query_id, 0 AS kind, mode_id AS id, place FROM k UNION ALL SELECT query_id, 1, item_id, place FROM best)
SELECT query_id, kind, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, place) AS INTEGER) AS place FROM u QUALIFY place <= 20 + 10""")
def r11(v: Views) -> DataFrame:
    """For each query item at most ten modes, then the best items of both legs, k + 10 in all."""
    modes = mode_matches(v).select("query_id", F.lit(0).alias("kind"), F.col("mode_id").alias("id"), "place")
    items = hybrid(v, evidence(v), 20).select("query_id", F.lit(1).alias("kind"), F.col("item_id").alias("id"), "place")
    return top_k(modes.unionByName(items).withColumnRenamed("place", "of_kind"), ["query_id"], [F.col("kind"), F.col("of_kind")], 20 + 10, "place").drop("of_kind")


# aggregates


@query("a2_rollup_upsert", """
WITH o AS (SELECT project_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM v_suggestion WHERE suggestion_id % 2 = 0 GROUP BY ALL), n AS (SELECT project_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM v_suggestion WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL)
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.day, o.day) AS day, coalesce(n.n, o.n) AS n FROM o FULL JOIN n ON o.project_id = n.project_id AND o.day = n.day""")
def a2(v: Views) -> DataFrame:
    """Days that are counted again replace their old counts; to do it twice changes nothing."""
    rolled = lambda df: df.groupBy("project_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    s = v("v_suggestion")
    new = rolled(s.where(F.col("created_at") >= F.lit("2024-01-10").cast("timestamp")))
    once = upsert(rolled(s.where("suggestion_id % 2 = 0")), new, ["project_id", "day"])
    return upsert(once, new, ["project_id", "day"])


@query("a6_centroid_merge", """
WITH m AS (SELECT a.mode_id, [a.support * a.centroid[1] + b.support * b.centroid[1], a.support * a.centroid[2] + b.support * b.centroid[2]]::DOUBLE[] AS s, a.support + b.support AS n FROM v_mode a JOIN v_mode b ON b.mode_id = a.mode_id + 10 WHERE a.mode_id <= 10 AND a.centroid IS NOT NULL AND b.centroid IS NOT NULL AND a.support + b.support > 0)
SELECT mode_id, round(s[1] / n, 5) AS x, round(s[2] / n, 5) AS y FROM m""")
def a6(v: Views) -> DataFrame:
    """Two modes' centroids merge by their support; a mode without one has nothing to give."""
    a = v("v_mode").where("mode_id <= 10 AND centroid IS NOT NULL").select("mode_id", "support", "centroid")
    b = v("v_mode").where("centroid IS NOT NULL").select((F.col("mode_id") - 10).alias("mode_id"), F.col("support").alias("n2"), F.col("centroid").alias("c2"))
    total = F.col("support") + F.col("n2")
    merged = F.zip_with("centroid", "c2", lambda x, y: (x.cast("double") * F.col("support") + y.cast("double") * F.col("n2")) / total)
    return a.join(b, "mode_id").where(total > 0).select("mode_id", merged.alias("c")).select("mode_id", F.round(F.col("c")[0], 5).alias("x"), F.round(F.col("c")[1], 5).alias("y"))


@query("a7_array_union", "SELECT a.mode_id, list_sort(list_distinct(list_concat(a.exception_fps, b.exception_fps))) AS exception_fps FROM v_mode a JOIN v_mode b ON b.mode_id = a.mode_id + 10 WHERE a.mode_id <= 10")
def a7(v: Views) -> DataFrame:
    b = v("v_mode").select((F.col("mode_id") - 10).alias("mode_id"), F.col("exception_fps").alias("f2"))
    return v("v_mode").where("mode_id <= 10").join(b, "mode_id").select("mode_id", F.array_sort(F.array_union("exception_fps", "f2")).alias("exception_fps"))


@query("a25_scorecard", """
WITH s AS (SELECT project_id, confidence >= 0.45 AS decided, outcome = 'accepted' AS hit, confidence >= 0.75 AND outcome = 'corrected' AS wrong, predicted_label LIKE 'ti%' AS should_abstain FROM v_suggestion)
SELECT project_id, round(avg(CASE WHEN decided = NOT should_abstain THEN 1.0 ELSE 0.0 END), 6) AS action_accuracy, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE decided), 6) AS label_accuracy, count(*) FILTER (WHERE wrong) AS confidently_wrong,
round(avg(CASE WHEN NOT decided THEN 1.0 ELSE 0.0 END) FILTER (WHERE should_abstain), 6) AS abstain_recall, CASE WHEN count(*) FILTER (WHERE wrong) = 0 THEN 'PASS' WHEN count(*) FILTER (WHERE wrong) < 0.2 * count(*) THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM s GROUP BY project_id""")
def a25(v: Views) -> DataFrame:
    s = v("v_suggestion").select("project_id", (F.col("confidence") >= 0.45).alias("decided"), (F.col("outcome") == "accepted").alias("hit"), ((F.col("confidence") >= 0.75) & (F.col("outcome") == "corrected")).alias("wrong"), F.col("predicted_label").startswith("ti").alias("abstains"))
    share = lambda c, of=None: F.round(F.avg(c.cast("double") if of is None else F.when(of, c.cast("double"))), 6)
    n, wrong = F.count("*"), F.count_if("wrong")
    return s.groupBy("project_id").agg(
        share(F.col("decided") != F.col("abstains")).alias("action_accuracy"), share(F.col("hit"), F.col("decided")).alias("label_accuracy"), wrong.alias("confidently_wrong"),
        share(~F.col("decided"), F.col("abstains")).alias("abstain_recall"), F.when(wrong == 0, "PASS").when(wrong < 0.2 * n, "PARTIAL").otherwise("FAIL").alias("verdict"),
    )


@query("a26_scenarios", "WITH s AS (SELECT item_id, unnest([concat('t', item_id % 3), concat('u', item_id % 2)]) AS scenario FROM v_item) SELECT scenario, count(*) AS n FROM s GROUP BY scenario")
def a26(v: Views) -> DataFrame:
    """An item counts in each of its scenarios."""
    of = F.array(F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")), F.concat(F.lit("u"), (F.col("item_id") % 2).cast("string")))
    return v("v_item").select(F.explode(of).alias("scenario")).groupBy("scenario").agg(F.count("*").alias("n"))


@query("a27_label_history", """
WITH c AS (SELECT error_hash, issue_group AS g, count(*) AS n FROM v_signature JOIN v_item USING (project_id, item_id) WHERE issue_group IN ('pb', 'ab', 'si', 'nd') GROUP BY ALL), t AS (SELECT error_hash, sum(n) AS total FROM c GROUP BY error_hash)
SELECT error_hash, total::BIGINT AS total, round(-sum(n / total * ln(n / total)) / ln(4), 6) + 0.0 AS entropy FROM c JOIN t USING (error_hash) GROUP BY error_hash, total""")
def a27(v: Views) -> DataFrame:
    """How evenly a hash's labels spread over the four groups."""
    c = _placed(v).where(base_group(F.col("issue_group")).isNotNull()).groupBy("error_hash", "issue_group").agg(F.count("*").alias("n"))
    t = c.groupBy("error_hash").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return c.join(t, "error_hash").groupBy("error_hash", "total").agg((F.round(-F.sum(p * F.log(p)) / F.log(F.lit(4.0)), 6) + 0.0).alias("entropy"))


# Fixed values of the kill switch: cases that a comparison and each of its arms must have, the tolerated gap, the precision above
# which a role stays, and the one that its upper bound must reach.
KILL_LEAST, KILL_GAP, KILL_STAYS, KILL_FLOOR = 50, 0.02, 0.95, 0.80
_BOUND = "(s{0} / n{0} + 3.8416 / (2 * n{0}) {1} 1.96 * sqrt(s{0} / n{0} * (1 - s{0} / n{0}) / n{0} + 3.8416 / (4.0 * n{0} * n{0}))) / (1 + 3.8416 / n{0})"


@query("a31_kill_switch", f"""
WITH c AS (SELECT project_id, role, count(*) FILTER (WHERE NOT cache_hit) AS n1, count(*) FILTER (WHERE NOT cache_hit AND outcome = 'ok') AS s1, count(*) FILTER (WHERE cache_hit) AS n2, count(*) FILTER (WHERE cache_hit AND outcome = 'ok') AS s2 FROM v_llm_event GROUP BY ALL),
w AS (SELECT *, CASE WHEN n1 > 0 THEN {_BOUND.format(1, "-")} END AS lo1, CASE WHEN n1 > 0 THEN {_BOUND.format(1, "+")} END AS hi1, CASE WHEN n2 > 0 THEN {_BOUND.format(2, "+")} END AS hi2, CASE WHEN n1 > 0 THEN s1 / n1 ELSE 0.0 END AS p1, CASE WHEN n2 > 0 THEN s2 / n2 ELSE 0.0 END AS p2 FROM c),
d AS (SELECT *, p1 - p2 - sqrt((p1 - lo1) * (p1 - lo1) + (hi2 - p2) * (hi2 - p2)) AS lower FROM w),
r AS (SELECT *, CASE WHEN n1 >= 50 AND hi1 < 0.8 THEN 'below_absolute_floor' WHEN least(n1, n2) < 50 THEN CASE WHEN n1 < 50 THEN 'too_few' ELSE 'other_arm_too_few' END WHEN p1 >= 0.95 THEN 'above_precision_floor'
  WHEN NOT p1 < p2 - 0.02 THEN 'gap_tolerated' WHEN NOT lower < 0 THEN 'bound_not_negative' ELSE 'less_precise' END AS reason FROM d)
SELECT project_id, role, n1 AS n, round(p1, 6) AS precision, round(p2, 6) AS other_precision, round(lower, 6) AS lower, reason, reason IN ('below_absolute_floor', 'less_precise') AS disabled FROM r""")
def a31(v: Views) -> DataFrame:
    """For each project and role the first rule that holds for its calls against those answered from the cache, the classical arm here."""
    ok, own = F.col("outcome") == "ok", ~F.col("cache_hit")
    c = v("v_llm_event").groupBy("project_id", "role").agg(F.count_if(own).alias("n1"), F.count_if(own & ok).alias("s1"), F.count_if(~own).alias("n2"), F.count_if(~own & ok).alias("s2"))
    some = lambda x, *n: F.when(reduce(lambda a, b: a & b, [F.col(k) > 0 for k in n]), x)
    upper = some(wilson(F.col("s1"), F.col("n1"))[1], "n1")
    p = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"s{k}") / F.col(f"n{k}")).otherwise(0.0)
    rows = c.select("*", p(1).alias("p1"), p(2).alias("p2"), upper.alias("upper"), some(difference_lower(F.col("s1"), F.col("n1"), F.col("s2"), F.col("n2")), "n1", "n2").alias("lower"))
    reason = (
        F.when((F.col("n1") >= KILL_LEAST) & (F.col("upper") < KILL_FLOOR), "below_absolute_floor").when(F.col("n1") < KILL_LEAST, "too_few").when(F.col("n2") < KILL_LEAST, "other_arm_too_few")
        .when(F.col("p1") >= KILL_STAYS, "above_precision_floor").when(~(F.col("p1") < F.col("p2") - KILL_GAP), "gap_tolerated").when(~(F.col("lower") < 0), "bound_not_negative").otherwise("less_precise")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("project_id", "role", F.col("n1").alias("n"), F.round("p1", 6).alias("precision"), F.round("p2", 6).alias("other_precision"), F.round("lower", 6).alias("lower"), "reason", F.col("reason").isin("below_absolute_floor", "less_precise").alias("disabled"))


@query("a33_day_slice", "SELECT suggestion_id FROM v_suggestion WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at < TIMESTAMP '2024-01-11 00:00:00'")
def a33(v: Views) -> DataFrame:
    day = F.lit("2024-01-10").cast("timestamp")
    return v("v_suggestion").where((F.col("created_at") >= day) & (F.col("created_at") < day + F.expr("INTERVAL '1' DAY"))).select("suggestion_id")


@query("a36_evidence_groups", """
WITH f AS (SELECT suggestion_id, unnest([{'g': 'history', 'n': 'hist', 'x': confidence - 0.5}, {'g': 'history', 'n': 'age', 'x': 0.1 - confidence}, {'g': 'text', 'n': 'cosine', 'x': confidence * 0.4}]) AS r FROM v_suggestion)
SELECT suggestion_id, r.g AS feature_group, round(sum(abs(r.x)), 6) AS weight, arg_max(r.n, abs(r.x)) AS top_feature FROM f GROUP BY ALL""")
def a36(v: Views) -> DataFrame:
    """A decision's evidence by groups of features: total weight and the strongest feature."""
    c = F.col("confidence")
    rows = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).alias("n"), x.alias("x")) for g, n, x in (("history", "hist", c - 0.5), ("history", "age", 0.1 - c), ("text", "cosine", c * 0.4))])
    f = v("v_suggestion").select("suggestion_id", F.inline(rows))
    return f.groupBy("suggestion_id", F.col("g").alias("feature_group")).agg(F.round(F.sum(F.abs("x")), 6).alias("weight"), F.max_by("n", F.abs("x")).alias("top_feature"))


# windows and sets


@query("w5_latest_labels", "SELECT project_id, item_id, arg_max(new_label, {'t': ts, 'e': event_id}) AS label FROM v_label_event GROUP BY project_id, item_id")
def w5(v: Views) -> DataFrame:
    return latest(v("v_label_event"), ["project_id", "item_id"], ["ts", "event_id"], ["new_label"]).withColumnRenamed("new_label", "label")


@query("w9_sort_order", "SELECT project_id, item_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY (launch_id % 7 = 3) DESC, issue_type DESC NULLS LAST, item_id) AS INTEGER) AS place FROM v_item QUALIFY place <= 200")
def w9(v: Views) -> DataFrame:
    """A page of each project: the asked launches first, then by label with nulls last."""
    rows = v("v_item").select("project_id", "item_id", "issue_type", (F.col("launch_id") % 7 == 3).alias("own"))
    return top_k(rows, ["project_id"], [F.desc("own"), F.desc_nulls_last("issue_type"), F.asc("item_id")], 200, "place").select("project_id", "item_id", "place")


@query("w11_set_operations", "SELECT 'all' AS op, count(*) AS n FROM (SELECT error_hash FROM v_signature UNION ALL SELECT exception_fp FROM v_signature) UNION ALL SELECT 'distinct', count(*) FROM (SELECT error_hash FROM v_signature UNION SELECT exception_fp FROM v_signature) UNION ALL SELECT 'both', count(*) FROM (SELECT error_hash FROM v_signature INTERSECT SELECT exception_fp FROM v_signature)")
def w11(v: Views) -> DataFrame:
    a, b = v("v_signature").select(F.col("error_hash").alias("x")), v("v_signature").select(F.col("exception_fp").alias("x"))
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return counted(a.union(b), "all").union(counted(a.union(b).distinct(), "distinct")).union(counted(a.intersect(b), "both"))


@query("w12_first_elements", "SELECT item_id, list_slice(template_ids, 1, 2) AS first_two FROM v_signature")
def w12(v: Views) -> DataFrame:
    return v("v_signature").select("item_id", F.slice("template_ids", 1, 2).alias("first_two"))


@query("w13_ordered_dedupe", "WITH p AS (SELECT item_id, unnest(template_ids) AS t, unnest(range(len(template_ids))) AS pos FROM v_signature), f AS (SELECT item_id, t, min(pos) AS pos FROM p GROUP BY ALL) SELECT item_id, list(t ORDER BY pos) AS templates FROM f GROUP BY item_id")
def w13(v: Views) -> DataFrame:
    return v("v_signature").select("item_id", F.array_distinct("template_ids").alias("templates"))


@query("w14_features_by_weight", """
WITH f AS (SELECT suggestion_id, unnest(['a', 'b', 'c']) AS n, unnest([confidence - 0.5, 0.2 - confidence, 0.1]::DOUBLE[]) AS x FROM v_suggestion) SELECT suggestion_id, array_to_string(list(n ORDER BY abs(x) DESC, n), ',') AS names FROM f GROUP BY suggestion_id""")
def w14(v: Views) -> DataFrame:
    c = F.col("confidence")
    rows = F.array(*[F.struct((-F.abs(x)).alias("w"), F.lit(n).alias("n")) for n, x in (("a", c - 0.5), ("b", 0.2 - c), ("c", F.lit(0.1)))])
    return v("v_suggestion").select("suggestion_id", F.array_join(F.transform(F.array_sort(rows), lambda s: s.n), ",").alias("names"))


@query("w18_group_of_item", """
WITH g AS (SELECT launch_id, error_hash, count(*) AS n FROM v_signature s JOIN v_item i USING (project_id, item_id) GROUP BY ALL)
SELECT i.item_id, arg_max(g.error_hash, {'own': g.error_hash = s.error_hash AND s.item_id % 2 = 0, 'n': g.n, 'h': g.error_hash}) AS group_hash FROM v_signature s JOIN v_item i USING (project_id, item_id) JOIN g USING (launch_id) WHERE i.item_id % 50 = 0 GROUP BY i.item_id""")
def w18(v: Views) -> DataFrame:
    """The group of an item's own fingerprint (known for even ids), else the largest of its launch."""
    p = _placed(v).select("launch_id", "error_hash", "item_id")
    groups = p.groupBy("launch_id", F.col("error_hash").alias("g_hash")).agg(F.count("*").alias("n"))
    rows = p.where("item_id % 50 = 0").join(groups, "launch_id")
    order = F.struct((F.col("g_hash") == F.col("error_hash")) & (F.col("item_id") % 2 == 0), "n", "g_hash")
    return rows.groupBy("item_id").agg(F.max_by("g_hash", order).alias("group_hash"))


# arithmetic


@query("h8_set_similarity", "SELECT a.item_id, b.item_id AS other_id, CASE WHEN len(a.template_ids) = 0 AND len(b.template_ids) = 0 THEN 1.0 ELSE round(len(list_intersect(a.template_ids, b.template_ids)) / len(list_distinct(list_concat(a.template_ids, b.template_ids))), 6) END AS similarity FROM v_signature a JOIN v_signature b ON b.item_id = a.item_id + 11")
def h8(v: Views) -> DataFrame:
    b = v("v_signature").select((F.col("item_id") - 11).alias("item_id"), F.col("item_id").alias("other_id"), F.col("template_ids").alias("t2"))
    return v("v_signature").select("item_id", "template_ids").join(b, "item_id").select("item_id", "other_id", F.round(jaccard(F.col("template_ids"), F.col("t2"), 1.0), 6).alias("similarity"))


@query("h9_running_mean", "SELECT launch_id, round(avg(CAST(emb[1] AS DOUBLE)), 5) AS x, round(avg(CAST(emb[2] AS DOUBLE)), 5) AS y FROM v_signature JOIN v_item USING (project_id, item_id) GROUP BY launch_id")
def h9(v: Views) -> DataFrame:
    """The mean of a launch's vectors, component by component."""
    rows = v("v_signature").select("project_id", "item_id", "emb").join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    return rows.groupBy("launch_id").agg(F.round(F.avg(F.col("emb")[0].cast("double")), 5).alias("x"), F.round(F.avg(F.col("emb")[1].cast("double")), 5).alias("y"))


@query("h12_scalings", "SELECT suggestion_id, round(greatest(0, least(1, confidence * 1.5 - 0.25)), 6) AS clamped, round(least(1, ln(1 + suggestion_id) / ln(201)), 6) AS logged FROM v_suggestion")
def h12(v: Views) -> DataFrame:
    return v("v_suggestion").select("suggestion_id", F.round(clamp01(F.col("confidence") * 1.5 - 0.25), 6).alias("clamped"), F.round(clamp01(F.log1p(F.col("suggestion_id").cast("double")) / F.log1p(F.lit(200.0))), 6).alias("logged"))


@query("h13_age_days", f"SELECT event_id, round(greatest(0, epoch(TIMESTAMP '{AS_OF}' - CAST(ts AS TIMESTAMP)) / 86400.0), 5) AS age FROM v_label_event")
def h13(v: Views) -> DataFrame:
    from ..functions.labels import age_days

    return v("v_label_event").select("event_id", F.round(age_days(F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp")), 5).alias("age"))


KNOTS = ((0.1, 0.05), (0.4, 0.3), (0.7, 0.8), (0.9, 0.95))


@query("h14_interpolation", "SELECT suggestion_id, round(CASE WHEN confidence <= 0.1e0 THEN 0.05e0 " + " ".join(f"WHEN confidence <= {b}e0 THEN {y}e0 + (confidence - {a}e0) * ({z}e0 - {y}e0) / ({b}e0 - {a}e0)" for (a, y), (b, z) in zip(KNOTS[:-1], KNOTS[1:], strict=True)) + " ELSE 0.95e0 END, 7) AS calibrated FROM v_suggestion")
def h14(v: Views) -> DataFrame:
    """Straight lines between a calibration's knots, flat beyond them. Confidences are multiples of 1/20,000, of which none lies on
    a tie of the seventh digit."""
    return v("v_suggestion").select("suggestion_id", F.round(interpolated(F.col("confidence"), KNOTS), 7).alias("calibrated"))


def interpolated(x, knots):
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (a, y), (b, z) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(x <= b, y + (x - a) * (z - y) / (b - a))
    return out.otherwise(F.lit(knots[-1][1]))


@query("h15_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NOT NULL AS has_none, (CASE WHEN event_id % 2 = 0 THEN 7 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS merged, json_extract_string(props, '$.k') IS DISTINCT FROM '3' AS differs FROM events")
def h15(v: Views) -> DataFrame:
    """A field of a JSON object, if a key is there, an object merged over it, and a comparison that knows nulls."""
    m = F.from_json("props", "map<string,string>")
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("7"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.coalesce(F.try_element_at(over, F.lit("k")), F.try_element_at(m, F.lit("k")))
    k = F.get_json_object("props", "$.k")
    return v("events").select("event_id", k.cast("long").alias("k"), F.map_contains_key(m, "none").alias("has_none"), merged.cast("long").alias("merged"), (~k.eqNullSafe("3")).alias("differs"))


@query("h16_text_functions", "SELECT item_id, regexp_extract(issue_type, '^[a-z]+') AS lead, split_part(launch_name, '-', 2) AS part, left(launch_name, 3) AS head, len(template_ids) AS n, list_filter(template_ids, lambda x: x <> 3) AS without, nullif(test_case_hash, 0) AS test, greatest(launch_id, test_case_hash) AS most FROM v_item JOIN v_signature USING (project_id, item_id)")
def h16(v: Views) -> DataFrame:
    rows = v("v_item").join(v("v_signature").select("project_id", "item_id", "template_ids"), ["project_id", "item_id"])
    return rows.select(
        "item_id", F.regexp_extract("issue_type", "^[a-z]+", 0).alias("lead"), F.split_part("launch_name", F.lit("-"), F.lit(2)).alias("part"), F.left("launch_name", F.lit(3)).alias("head"), F.size("template_ids").alias("n"),
        F.array_remove("template_ids", 3).alias("without"), F.nullif("test_case_hash", F.lit(0)).alias("test"), F.greatest("launch_id", "test_case_hash").alias("most"),
    )


@query("h18_timestamps", "SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS iso, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN '2024-01-05 10:00:00' ELSE 'soon' END AS TIMESTAMP) AS parsed FROM v_label_event")
def h18(v: Views) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, "2024-01-05 10:00:00").otherwise("soon")
    return v("v_label_event").select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.try_to_timestamp(text).alias("parsed"))


# knowledge base and learning


@query("k3_mode_upkeep", """
WITH u AS (SELECT mode_id, CASE WHEN status = 'candidate' AND support >= 10 AND purity >= 0.95 THEN 'confirmed' WHEN status = 'confirmed' AND purity < 0.92 THEN 'retired' ELSE status END AS status FROM v_mode)
SELECT project_id, u.status, count(*) AS modes, CAST(sum(support) AS BIGINT) AS support FROM u JOIN v_mode USING (mode_id) GROUP BY project_id, u.status""")
def k3(v: Views) -> DataFrame:
    """Candidates that have proven themselves are confirmed, confirmed ones that got impure retire; then the list by status."""
    s = F.col("status")
    status = F.when((s == "candidate") & (F.col("support") >= 10) & (F.col("purity") >= 0.95), "confirmed").when((s == "confirmed") & (F.col("purity") < 0.92), "retired").otherwise(s)
    return v("v_mode").withColumn("status", status).groupBy("project_id", "status").agg(F.count("*").alias("modes"), F.sum("support").alias("support"))


@query("g5_launch_groups", """
WITH g AS (SELECT launch_id, error_hash, count(*) AS n FROM v_signature s JOIN v_item i USING (project_id, item_id) GROUP BY ALL), t AS (SELECT launch_id, sum(n) AS total FROM g GROUP BY launch_id)
SELECT launch_id, error_hash, n AS members, n >= 5 AND n / total > 0.4 AND error_hash >= 7000 AS dominant FROM g JOIN t USING (launch_id)""")
def g5(v: Views) -> DataFrame:
    """Launch groups as they are stored; those with a burst prior are dominant."""
    from .relational import g4

    return g4(v).select("launch_id", "error_hash", F.col("n").alias("members"), (F.col("si_prior") > 0).alias("dominant"))


# feedback: the label events that come from outside are the updates, of which every seventh names an item that isn't known

_FEEDBACK_SQL = """
WITH u AS (SELECT project_id, CASE WHEN event_id % 7 = 0 THEN -item_id - 1 ELSE item_id END AS item_id, lower(trim(concat(' ', upper(new_label)))) AS new_label, ts AS stamp FROM v_label_event WHERE source = 'rp_defect_update'),
st AS (SELECT project_id, item_id, issue_type AS stored FROM v_item), kn AS (SELECT u.*, stored FROM u JOIN st USING (project_id, item_id)),
la AS (SELECT project_id, item_id, arg_max(new_label, {'t': stamp, 'l': new_label}) AS issue_type FROM kn GROUP BY ALL)"""


def effects(v: Views) -> Effects:
    item = F.when(F.col("event_id") % 7 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id"))
    updates = v("v_label_event").where("source = 'rp_defect_update'").select("project_id", item.alias("item_id"), F.concat(F.lit(" "), F.upper("new_label")).alias("issue_type"), F.col("ts").alias("at"))
    suggestions = v("v_suggestion").select("suggestion_id", (F.col("item_id") % 2 + 1).alias("project_id"), "item_id", "predicted_label", "outcome")
    return feedback(updates, v("v_item"), v("v_mode_member"), suggestions)


@query("l1_feedback", _FEEDBACK_SQL + " SELECT * FROM la")
def l1(v: Views) -> DataFrame:
    """The items that defect updates give another label."""
    return effects(v).items


@query("l1_feedback_events", _FEEDBACK_SQL + " SELECT project_id, item_id, coalesce(lag(new_label) OVER (PARTITION BY project_id, item_id ORDER BY stamp, new_label), stored) AS old_label, new_label, 'rp_defect_update' AS source, stamp AS \"at\" FROM kn")
def l1_events(v: Views) -> DataFrame:
    return effects(v).events


@query("l1_feedback_unknown", _FEEDBACK_SQL + " SELECT DISTINCT project_id, item_id FROM u ANTI JOIN st USING (project_id, item_id)")
def l1_unknown(v: Views) -> DataFrame:
    return effects(v).unknown


@query("l1_feedback_purity", _FEEDBACK_SQL + """,
nw AS (SELECT project_id, item_id, coalesce(issue_type, stored) AS label FROM st LEFT JOIN la USING (project_id, item_id) WHERE label <> ''),
ct AS (SELECT m.project_id, m.mode_id, label, count(*) AS n FROM v_mode_member m JOIN nw USING (project_id, item_id) WHERE (m.project_id, m.mode_id) IN (SELECT (project_id, mode_id) FROM v_mode_member JOIN la USING (project_id, item_id)) GROUP BY ALL)
SELECT project_id, mode_id, sum(n)::BIGINT AS labelled, round(max(n) / sum(n), 6) AS purity FROM ct GROUP BY ALL""")
def l1_purity(v: Views) -> DataFrame:
    return effects(v).purity.withColumn("purity", F.round("purity", 6))


@query("l1_feedback_outcomes", _FEEDBACK_SQL + """
SELECT suggestion_id, CASE WHEN substr(predicted_label, 1, 2) IN ('pb', 'ab', 'si', 'nd') AND substr(predicted_label, 1, 2) = substr(la.issue_type, 1, 2) THEN 'accepted' ELSE 'corrected' END AS outcome
FROM v_suggestion s JOIN la ON la.item_id = s.item_id AND la.project_id = s.item_id % 2 + 1 WHERE outcome = 'pending'""")
def l1_outcomes(v: Views) -> DataFrame:
    return effects(v).outcomes


_REPORT_SQL = """
WITH t AS (SELECT item_id, substr(arg_max(new_label, {'t': ts, 'e': event_id}), 1, 2) AS truth FROM v_label_event GROUP BY item_id),
p AS (SELECT model_ver, truth, substr(predicted_label, 1, 2) AS guess, confidence FROM v_suggestion JOIN t USING (item_id) WHERE model_ver IN ('gbm-v1', 'gbm-v2') AND truth IN ('pb', 'ab', 'si', 'nd')),
l AS (SELECT model_ver, g.label, count(*) FILTER (WHERE truth = g.label) AS support, count(*) FILTER (WHERE guess = g.label) AS predicted, count(*) FILTER (WHERE truth = g.label AND guess = g.label) AS hits FROM p, (VALUES ('pb'), ('ab'), ('si'), ('nd')) AS g(label) GROUP BY ALL),
f AS (SELECT model_ver, avg(CASE WHEN hits > 0 THEN 2.0 * hits / (predicted + support) ELSE 0.0 END) AS f1 FROM l WHERE support > 0 GROUP BY model_ver),
b AS (SELECT model_ver, least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS a FROM p GROUP BY ALL),
e AS (SELECT model_ver, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY model_ver),
o AS (SELECT model_ver, count(*) FILTER (WHERE truth = guess AND confidence >= 0.75) / nullif(count(*) FILTER (WHERE confidence >= 0.75), 0) AS auto, count(*) FILTER (WHERE confidence < 0.45) / count(*) AS abstain FROM p GROUP BY model_ver),
r AS (SELECT * FROM f JOIN e USING (model_ver) JOIN o USING (model_ver))"""
# Fixed values of the gate: how far F1 may fall, and may fall where calibration mends; what counts as bad calibration and as mended;
# the least precision of what is decided alone; how many more abstentions are borne.
F1_SLACK, F1_SLACK_MENDED, BAD_ECE, MENDED_ECE, AUTO_PRECISION, ABSTAIN_SLACK = 0.005, 0.05, 0.15, 0.05, 0.855, 0.05


def report(rows: DataFrame) -> DataFrame:
    """(model_ver, f1, ece, auto, abstain) of rows (model_ver, truth, guess, confidence): macro F1 over the groups that occur, calibration
    error over ten bins, precision of what is decided alone, share of abstentions. Counts by group and bin, then a row a model."""
    sides = F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))
    hit = F.col("truth") == F.col("guess")
    by_label = rows.select("model_ver", F.coalesce(hit, F.lit(False)).alias("hit"), F.inline(sides)).groupBy("model_ver", "label").agg(F.sum("t").alias("support"), F.sum("g").alias("predicted"), F.count_if(F.col("hit") & (F.col("t") == 1)).alias("hits"))
    f1 = by_label.where("support > 0").groupBy("model_ver").agg(F.avg(F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("predicted") + F.col("support"))).otherwise(0.0)).alias("f1"))
    bins = rows.groupBy("model_ver", F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("a"))
    ece = bins.groupBy("model_ver").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))
    alone = F.col("confidence") >= 0.75
    rest = rows.groupBy("model_ver").agg(F.try_divide(F.count_if(hit & alone), F.count_if(alone)).alias("auto"), (F.count_if(F.col("confidence") < 0.45) / F.count("*")).alias("abstain"))
    return f1.join(ece, "model_ver").join(rest, "model_ver")


@query("l7_ship_gate", _REPORT_SQL + """, a AS (SELECT * FROM r WHERE model_ver = 'gbm-v1'), c AS (SELECT * FROM r WHERE model_ver = 'gbm-v2')
SELECT c.f1 >= a.f1 - 0.005 OR (a.ece > 0.15 AND c.ece <= a.ece - 0.05 AND c.f1 >= a.f1 - 0.05) AS f1_ok, coalesce(c.auto, 0) >= greatest(coalesce(a.auto, 0), 0.855) AS auto_ok, c.abstain <= a.abstain + 0.05 AS abstain_ok,
  round(a.f1, 6) AS active_f1, round(c.f1, 6) AS new_f1, round(a.ece, 6) AS active_ece, round(c.ece, 6) AS new_ece FROM a, c""")
def l7(v: Views) -> DataFrame:
    """If the new model (gbm-v2) may take the active one's place, by both reports on the items whose last label is known: as good (or a
    little worse where a badly calibrated model is mended), as sure of what it decides alone, and as decided."""
    truth = latest(v("v_label_event"), ["item_id"], ["ts", "event_id"], ["new_label"]).select("item_id", base_group(F.col("new_label")).alias("truth")).where("truth IS NOT NULL")
    rows = v("v_suggestion").where(F.col("model_ver").isin("gbm-v1", "gbm-v2")).join(truth, "item_id").select("model_ver", "truth", F.substring("predicted_label", 1, 2).alias("guess"), "confidence")
    names = ("f1", "ece", "auto", "abstain")
    r = report(rows)
    of = lambda m, p: r.where(F.col("model_ver") == m).select(*[F.col(c).alias(f"{p}_{c}") for c in names])
    both = of("gbm-v1", "a").join(F.broadcast(of("gbm-v2", "c")))  # a row each
    zero, c = F.lit(0.0), F.col
    mended = (c("a_ece") > BAD_ECE) & (c("c_ece") <= c("a_ece") - MENDED_ECE) & (c("c_f1") >= c("a_f1") - F1_SLACK_MENDED)
    return both.select(
        ((c("c_f1") >= c("a_f1") - F1_SLACK) | mended).alias("f1_ok"), (F.coalesce("c_auto", zero) >= F.greatest(F.coalesce("a_auto", zero), F.lit(AUTO_PRECISION))).alias("auto_ok"), (c("c_abstain") <= c("a_abstain") + ABSTAIN_SLACK).alias("abstain_ok"),
        F.round("a_f1", 6).alias("active_f1"), F.round("c_f1", 6).alias("new_f1"), F.round("a_ece", 6).alias("active_ece"), F.round("c_ece", 6).alias("new_ece"),
    )


@query("l8_last_shipped", "SELECT project_id, arg_max(model_ver, {'t': created_at, 'i': suggestion_id}) AS active FROM v_suggestion WHERE model_ver LIKE 'gbm%' GROUP BY project_id")
def l8(v: Views) -> DataFrame:
    """The model version last used in each project."""
    return latest(v("v_suggestion").where(F.col("model_ver").startswith("gbm")), ["project_id"], ["created_at", "suggestion_id"], ["model_ver"]).withColumnRenamed("model_ver", "active")


@query("l9_retrain_trigger", "SELECT project_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00') >= 100 AS retrain FROM v_label_event GROUP BY project_id")
def l9(v: Views) -> DataFrame:
    """A hundred new labels since the last training ask for the next."""
    return v("v_label_event").groupBy("project_id").agg((F.count_if(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")) >= 100).alias("retrain"))


@query("l10_calibrator_choice", """
WITH n AS (SELECT project_id, count(*) >= 300 AS own FROM v_suggestion WHERE outcome <> 'pending' GROUP BY project_id), a AS (SELECT count(*) >= 300 AS every FROM v_suggestion WHERE outcome <> 'pending')
SELECT suggestion_id, CASE WHEN own THEN 'project' WHEN every THEN 'install' ELSE 'raw' END AS calibrator FROM v_suggestion LEFT JOIN n USING (project_id), a""")
def l10(v: Views) -> DataFrame:
    """A project's own calibrator where it has 300 outcomes, else the install's, else none."""
    known = v("v_suggestion").where("outcome <> 'pending'")
    own = known.groupBy("project_id").agg((F.count("*") >= 300).alias("own"))
    every = known.agg((F.count("*") >= 300).alias("every"))
    rows = v("v_suggestion").select("suggestion_id", "project_id").join(own, "project_id", "left").join(F.broadcast(every))  # one row
    return rows.select("suggestion_id", F.when(F.col("own"), "project").when(F.col("every"), "install").otherwise("raw").alias("calibrator"))


@query("l19_extractor_lookup", f"""
WITH c AS (SELECT item_id, arg_max(outcome, {{'t': created_at, 'e': event_id}}) AS answer, max(created_at) AS answered FROM v_llm_event WHERE NOT cache_hit GROUP BY item_id)
SELECT s.item_id, coalesce(CASE WHEN answered >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN answer END, 'unknown') AS failing_layer FROM v_signature s LEFT JOIN c USING (item_id)""")
def l19(v: Views) -> DataFrame:
    """What a fresh cache entry says of an item, else unknown."""
    c = latest(v("v_llm_event").where("NOT cache_hit").withColumn("at", F.col("created_at")), ["item_id"], ["created_at", "event_id"], ["outcome", "at"])
    fresh = F.col("at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL '14' DAY")
    return v("v_signature").select("item_id").join(c, "item_id", "left").select("item_id", F.coalesce(F.when(fresh, F.col("outcome")), F.lit("unknown")).alias("failing_layer"))


# decisions


@query("d10_early_policy", """
SELECT suggestion_id, p.policy FROM v_suggestion, (VALUES ('kb_inherit_only'), ('suggest_only'), ('kb_inherit_and_pb')) AS p(policy)
WHERE substr(predicted_label, 1, 2) <> 'si' AND CASE p.policy WHEN 'kb_inherit_only' THEN model_ver LIKE 'rubric+%' WHEN 'suggest_only' THEN FALSE ELSE model_ver LIKE 'rubric+%' OR substr(predicted_label, 1, 2) = 'pb' AND confidence >= 0.85 END""")
def d10(v: Views) -> DataFrame:
    """What each policy lets be applied before a launch has ended; system issues never."""
    known = F.col("model_ver").startswith("rubric+")
    group = F.substring("predicted_label", 1, 2)
    policies = {"kb_inherit_only": known, "suggest_only": F.lit(False), "kb_inherit_and_pb": known | ((group == "pb") & (F.col("confidence") >= 0.85))}
    applied = F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in policies.items()]))
    return v("v_suggestion").where(group != "si").select("suggestion_id", F.explode(applied).alias("policy"))


@query("d12_rubric_fallback", """
SELECT suggestion_id FROM v_suggestion s WHERE model_ver NOT LIKE 'rubric+%' AND confidence >= 0.45 UNION ALL
SELECT suggestion_id FROM v_suggestion s WHERE model_ver LIKE 'rubric+%' AND NOT EXISTS (SELECT 1 FROM v_suggestion t WHERE t.item_id = s.item_id AND t.model_ver NOT LIKE 'rubric+%' AND t.confidence >= 0.45)""")
def d12(v: Views) -> DataFrame:
    """A rubric's row stands in only for items that have no vouched one."""
    s = v("v_suggestion").select("suggestion_id", "item_id", "confidence", F.col("model_ver").startswith("rubric+").alias("rubric"))
    vouched = s.where("NOT rubric AND confidence >= 0.45")
    return vouched.select("suggestion_id").union(s.where("rubric").join(vouched.select("item_id"), "item_id", "left_anti").select("suggestion_id"))


@query("d13_provenance", "SELECT suggestion_id, concat(CASE WHEN model_ver LIKE 'gbm%' THEN 'model ' || model_ver WHEN model_ver LIKE 'rubric+%' THEN 'rubric' ELSE 'rules' END, ', ', CASE outcome WHEN 'accepted' THEN 'human-confirmed' WHEN 'corrected' THEN 'corrected' ELSE 'auto-analyzed' END) AS text FROM v_suggestion")
def d13(v: Views) -> DataFrame:
    m = F.col("model_ver")
    by = F.when(m.startswith("gbm"), F.concat(F.lit("model "), m)).when(m.startswith("rubric+"), "rubric").otherwise("rules")
    how = F.when(F.col("outcome") == "accepted", "human-confirmed").when(F.col("outcome") == "corrected", "corrected").otherwise("auto-analyzed")
    return v("v_suggestion").select("suggestion_id", F.concat_ws(", ", by, how).alias("text"))


@query("d15_stages", "SELECT suggestion_id, CASE WHEN suggestion_id % 7 = 0 THEN 'A' WHEN model_ver = 'rule_cold' THEN 'cold' ELSE 'C' END AS stage, CASE WHEN confidence >= 0.75 THEN 'auto' WHEN confidence >= 0.45 THEN 'suggest' ELSE 'abstain' END AS band FROM v_suggestion")
def d15(v: Views) -> DataFrame:
    """How the inspector names a decision: stage A where it has a matched item (every seventh here)."""
    from ..functions.labels import band

    stage = F.when(F.col("suggestion_id") % 7 == 0, "A").when(F.col("model_ver") == "rule_cold", "cold").otherwise("C")
    return v("v_suggestion").select("suggestion_id", stage.alias("stage"), band(F.col("confidence")).alias("band"))


@query("d16_carry_forward", """
WITH o AS (SELECT suggestion_id, item_id, predicted_label, model_ver, lag(suggestion_id) OVER w AS before, lag(predicted_label) OVER w AS p, lag(model_ver) OVER w AS m FROM v_suggestion WINDOW w AS (PARTITION BY item_id ORDER BY created_at, suggestion_id))
SELECT suggestion_id, before AS explained_by FROM o WHERE p = predicted_label AND m = model_ver""")
def d16(v: Views) -> DataFrame:
    """An explanation holds on where the next decision of its item is the same but for what the clock changes."""
    w = Window.partitionBy("item_id").orderBy("created_at", "suggestion_id")
    key = F.struct("predicted_label", "model_ver")
    rows = v("v_suggestion").select("suggestion_id", key.alias("k"), F.lag("suggestion_id").over(w).alias("explained_by"), F.lag(key).over(w).alias("before"))
    return rows.where("before = k").select("suggestion_id", "explained_by")
