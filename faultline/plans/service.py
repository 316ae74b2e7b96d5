"""Messages taken from a queue, decisions that fall due, and the map of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting
from ..operators.icicle import icicle
from ..operators.modes import members, modes, purity
from ..operators.replay import paired, report
from ..sources import messages
from ..sources.shared import Scratch
from ..streaming.dispatch import dispatched
from ..streaming.miner import PROVIDER
from ..streaming.timers import orphans, retrain_requests
from .registry import QUERIES, Views, query
from .relational import g4
from .text import _streamed

# messages: every 50th line of the queue is torn, every fourth sender waits for an answer

_KEYS = {"view": "index", "click": "analyze", "signup": "suggest", "error": "train_models"}
_LINES_SQL = "WITH m AS (SELECT *, message_id % 50 = 3 AS torn, CASE routing_key " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KEYS.items()) + """ ELSE 'other' END AS k,
  CASE WHEN message_id % 4 = 0 THEN concat('queue-', CAST(message_id % 3 AS VARCHAR)) END AS reply_to, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.k') AS BIGINT) * 37 END AS asked FROM v_message),
a AS (SELECT m.*, CASE WHEN torn THEN 'EnvelopeError: the line is no envelope' WHEN NOT json_valid(body) THEN 'JSONDecodeError: the body is no JSON' WHEN k = 'suggest' AND i.item_id IS NULL THEN 'KeyError: no such item' END AS error,
  CASE k WHEN 'index' THEN '1' WHEN 'analyze' THEN CASE WHEN issue_group <> 'ti' THEN concat('[{"item":', CAST(asked AS VARCHAR), ',"label":"', issue_type, '"}]') ELSE '[]' END WHEN 'suggest' THEN concat('[', CAST(launch_id AS VARCHAR), ']') END AS reply
  FROM m LEFT JOIN v_item i ON i.item_id = asked),
s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'dead' WHEN reply IS NULL THEN NULL WHEN reply_to IS NOT NULL THEN 'reply' WHEN k = 'analyze' AND reply <> '[]' THEN 'result' END AS sink FROM a)"""


@query("s4_message_run", _LINES_SQL + """
SELECT sink, CASE sink WHEN 'reply' THEN reply_to WHEN 'result' THEN 'results' END AS destination, CASE WHEN sink <> 'dead' THEN CAST(message_id AS VARCHAR) END AS correlation_id,
  CASE WHEN sink <> 'dead' THEN reply WHEN torn THEN concat('{"routing_key": "', k) ELSE body END AS body, error AS x_error, CASE WHEN sink = 'dead' THEN CASE WHEN torn THEN '' ELSE k END END AS x_routing_key
FROM s WHERE sink IS NOT NULL""", python=True)
def s4_run(v: Views) -> DataFrame:
    """All messages as a queue's lines, taken by the message source, handled, and what is sent where."""
    m = v("v_message")
    spark = m.sparkSession
    messages.register(spark)
    scratch = Scratch(spark, "queue")
    names = F.create_map(*[F.lit(x) for pair in _KEYS.items() for x in pair])
    key = F.coalesce(F.try_element_at(names, F.col("routing_key")), F.lit("other"))
    envelope = F.to_json(F.struct(
        key.alias("routing_key"), F.when(F.col("message_id") % 4 == 0, F.concat(F.lit("queue-"), (F.col("message_id") % 3).cast("string"))).alias("reply_to"),
        F.col("message_id").cast("string").alias("correlation_id"), F.create_map(F.lit("timestamp_in_ms"), F.coalesce("header", F.lit(""))).alias("headers"), "body",
    ))
    m.select(F.when(F.col("message_id") % 50 == 3, F.concat(F.lit('{"routing_key": "'), key)).otherwise(envelope).alias("value")).write.text(f"{scratch.path}/lines")
    items = v("v_item").select("item_id", "issue_type", "issue_group", "launch_id")

    def asked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("item_id", F.get_json_object("body", "$.k").cast("long") * 37).join(items, "item_id", "left")

    found = F.to_json(F.array(F.struct(F.col("item_id").alias("item"), F.col("issue_type").alias("label"))))
    none = F.lit(None).cast("string")
    handlers = {
        "index": lambda rows: rows.select("message_id", F.lit("1").alias("reply"), none.alias("error")),
        "analyze": lambda rows: asked(rows).select("message_id", F.when(F.col("issue_group") != "ti", found).otherwise("[]").alias("reply"), none.alias("error")),
        "suggest": lambda rows: asked(rows).select("message_id", F.to_json(F.array("launch_id")).alias("reply"), F.when(F.col("launch_id").isNull(), "KeyError: no such item").alias("error")),
        "train_models": lambda rows: rows.select("message_id", none.alias("reply"), none.alias("error")),
    }
    taken = scratch.write(messages.opened(spark.read.format("messages").load(f"{scratch.path}/lines")), "taken")
    return dispatched(taken, handlers).select("sink", "destination", "correlation_id", "body", "x_error", "x_routing_key")


# timers


def _l9(source: DataFrame) -> DataFrame:
    """Requests for training of two models. Every 37th event is the outcome of a training, every 50th an explicit request."""
    e = F.col("event_id")
    kind = F.when(e % 37 == 0, F.element_at(F.array(*map(F.lit, ("shipped", "rejected", "cold"))), (e % 3 + 1).cast("int"))).when(e % 50 == 1, "route").otherwise("label")
    return retrain_requests(source.select(F.concat(F.lit("project-"), (F.col("user_id") % 2).cast("string")).alias("model"), F.date_trunc("minute", "ts").alias("at"), kind.alias("kind")))


def _l12(source: DataFrame) -> DataFrame:
    """Labels of users' items; a signup writes an item, an error deletes it; three days of grace."""
    kind = F.when(F.col("event_type") == "signup", "item").when(F.col("event_type") == "error", "gone").otherwise("label")
    return orphans(source.select((1 + F.col("user_id") % 2).alias("project_id"), F.col("user_id").alias("item_id"), F.date_trunc("second", "ts").alias("at"), kind.alias("kind")), 3)


QUERIES["l9_training_requests"] = _streamed(_l9, "append", lambda told: told, dict([PROVIDER]))
QUERIES["l12_orphan_sweeps"] = _streamed(_l12, "append", lambda told: told, dict([PROVIDER]))


# the map of templates


@query("a29_icicle", r"""
WITH t AS (SELECT log_level, coalesce(message, '') AS pattern, count(*) AS n FROM v_log GROUP BY ALL), w AS (SELECT *, list_slice(regexp_split_to_array(pattern, '\s+'), 1, 4) AS words FROM t),
d AS (SELECT *, unnest(range(1, len(words) + 1)) AS depth FROM w), c AS (SELECT log_level, depth, list_slice(words, 1, depth) AS p, sum(n) AS n, bool_or(len(words) > depth) AS inside, min({'n': -n, 'p': pattern}) AS f FROM d GROUP BY ALL),
u AS (SELECT log_level, p AS cell, CASE WHEN inside THEN 1 ELSE n END AS own, unnest(range(1, depth + 1)) AS up FROM c), s AS (SELECT log_level, list_slice(cell, 1, up) AS p, CAST(sum(own) AS BIGINT) AS value FROM u GROUP BY ALL),
o AS (SELECT c.log_level, depth, c.p, value, coalesce(sum(value) OVER (PARTITION BY c.log_level, list_slice(c.p, 1, depth - 1) ORDER BY value DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c JOIN s USING (log_level, p)),
e AS (SELECT log_level, p AS cell, unnest(range(1, depth + 1)) AS up FROM o), b AS (SELECT e.log_level, cell, CAST(sum(before) AS BIGINT) AS start FROM e JOIN o ON o.log_level = e.log_level AND o.p = list_slice(cell, 1, up) GROUP BY ALL),
x AS (SELECT log_level, 1 + CAST(sum(value) FILTER (WHERE depth = 1) AS BIGINT) AS total, 1 + max(depth) AS bands FROM o GROUP BY log_level)
SELECT o.log_level, depth, array_to_string(p, ' ') AS path, p[-1] AS name, value, start / total AS x0, (start + value) / total AS x1, depth / bands AS y0, (depth + 1) / bands AS y1 FROM o JOIN b ON b.log_level = o.log_level AND cell = p JOIN x ON x.log_level = o.log_level""")
def a29_map(v: Views) -> DataFrame:
    """The logs of each level as nested intervals by their first words."""
    t = v("v_log").groupBy("log_level", F.coalesce("message", F.lit("")).alias("pattern")).agg(F.count("*").alias("n"))
    return icicle(t, Scratch(t.sparkSession, "icicle"), "log_level")


# modes from the log of what was done to them: each event is a step

_LOG_SQL = """
e AS (SELECT event_id, user_id, 1 + user_id % 2 AS project_id, event_type, value, user_id * 5 + event_id % 5 AS mode_id, {div} * 5 + event_id % 3 AS dst FROM {events}),
lg AS (SELECT DISTINCT project_id, -1 - m AS seq, 'spawn' AS op, m AS mode_id, NULL AS other_id, NULL AS item_id, NULL AS score, NULL AS matched_by, 'candidate' AS status, CASE WHEN m % 3 = 0 THEN 'pb001' END AS label
    FROM (SELECT project_id, mode_id AS m FROM e UNION SELECT project_id, dst AS m FROM e)
  UNION ALL SELECT project_id, event_id * 4, 'merge', mode_id, dst, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_id % 9 = 2
  UNION ALL SELECT project_id, event_id * 4, 'status', mode_id, NULL, NULL, NULL, NULL, 'confirmed', CASE WHEN event_id % 2 = 0 THEN 'ab001' END FROM e WHERE event_id % 9 = 4
  UNION ALL SELECT project_id, event_id * 4, 'spawn', 1000000000 + event_id, mode_id, NULL, NULL, NULL, 'candidate', NULL FROM e WHERE event_id % 9 = 7
  UNION ALL SELECT project_id, event_id * 4 + 1, 'add', 1000000000 + event_id, NULL, user_id, CAST(1.0 AS DOUBLE), 'human', NULL, NULL FROM e WHERE event_id % 9 = 7
  UNION ALL SELECT project_id, event_id * 4 + 2, 'retire', mode_id, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_id % 9 = 7
  UNION ALL SELECT project_id, event_id * 4, 'add', mode_id, NULL, event_id % 60, value, event_type, NULL, NULL FROM e WHERE event_id % 9 NOT IN (2, 4, 7))"""
_MODES_SQL = "WITH RECURSIVE " + _LOG_SQL.replace("{div}", "(user_id // 4 * 2 + user_id % 2)").replace("{events}", "events").lstrip() + """,
mg AS (SELECT project_id, mode_id AS src, other_id AS dst, seq, coalesce(lag(seq) OVER (PARTITION BY project_id, mode_id ORDER BY seq), -9000000000) AS prior FROM lg WHERE op = 'merge' AND mode_id <> other_id),
walk AS (SELECT project_id, item_id, seq AS id, CAST(score AS DOUBLE) AS score, matched_by, mode_id, seq AS came, [seq] AS times FROM lg WHERE op = 'add'
  UNION ALL SELECT w.project_id, item_id, id, score, matched_by, dst, seq, list_prepend(seq, times) FROM walk w JOIN mg ON mg.project_id = w.project_id AND src = w.mode_id AND seq > came AND prior < came),
stay AS (SELECT w.*, coalesce(mg.seq, 9000000000) AS left_at, mg.seq IS NULL AS final FROM walk w LEFT JOIN mg ON mg.project_id = w.project_id AND src = w.mode_id AND seq > came AND prior < came),
lost AS (SELECT DISTINCT s.project_id, s.id FROM stay s JOIN lg a ON a.op = 'add' AND a.project_id = s.project_id AND a.mode_id = s.mode_id AND a.item_id = s.item_id AND a.seq > s.came AND a.seq < s.left_at),
found AS (SELECT project_id, mode_id, item_id, max(score) AS score, arg_min(matched_by, times) AS matched_by FROM stay WHERE final AND (project_id, id) NOT IN (SELECT project_id, id FROM lost) GROUP BY ALL),
up AS (SELECT project_id, mode_id, mode_id AS ancestor, 0 AS far, 9000000000 AS until FROM lg WHERE op = 'spawn'
  UNION ALL SELECT u.project_id, u.mode_id, other_id, far + 1, seq FROM up u JOIN lg l ON l.op = 'spawn' AND l.project_id = u.project_id AND l.mode_id = ancestor AND other_id IS NOT NULL),
lb AS (SELECT u.project_id, u.mode_id, arg_max(label, {'f': -far, 's': seq}) AS label FROM up u JOIN lg l ON l.project_id = u.project_id AND l.mode_id = ancestor AND l.label IS NOT NULL AND seq < until GROUP BY ALL),
st AS (SELECT project_id, mode_id, arg_max(CASE WHEN op IN ('merge', 'retire') THEN 'retired' ELSE status END, seq) AS status FROM lg WHERE op IN ('spawn', 'status', 'retire') OR op = 'merge' AND mode_id <> other_id GROUP BY ALL)"""


def _log(v: Views) -> DataFrame:
    """The log as ``modes.LOG``."""
    e = v("events")
    text = "WITH " + _LOG_SQL.replace("{div}", "(user_id div 4 * 2 + user_id % 2)").lstrip() + " SELECT project_id, seq, op, mode_id, CAST(other_id AS BIGINT) AS other_id, CAST(item_id AS BIGINT) AS item_id, CAST(score AS DOUBLE) AS score, CAST(matched_by AS STRING) AS matched_by, status, label FROM lg"
    return e.sparkSession.sql(text, events=e)


@query("k3_mode_members", _MODES_SQL + " SELECT project_id, mode_id, item_id, score, matched_by FROM found")
def k3_members(v: Views) -> DataFrame:
    """Who is linked with which mode after all spawns, adds, merges and splits."""
    log = _log(v)
    scratch = Scratch(log.sparkSession, "modes")
    return members(scratch.write(log, "log"), scratch)


@query("k3_mode_list", _MODES_SQL + """,
m AS (SELECT f.project_id, f.mode_id, issue_type, count(*) AS n FROM found f LEFT JOIN v_item i USING (project_id, item_id) GROUP BY ALL),
p AS (SELECT project_id, mode_id, CAST(sum(n) AS BIGINT) AS members, CAST(coalesce(sum(n) FILTER (WHERE issue_type IS NOT NULL), 0) AS BIGINT) AS support, max(n) FILTER (WHERE issue_type IS NOT NULL) AS most FROM m GROUP BY ALL)
SELECT st.project_id, st.mode_id, status, label, coalesce(members, 0) AS members, coalesce(support, 0) AS support, coalesce(most / nullif(support, 0), 0.0) AS purity FROM st LEFT JOIN lb USING (project_id, mode_id) LEFT JOIN p USING (project_id, mode_id)""")
def k3_list(v: Views) -> DataFrame:
    """All modes with status, label, members, and how pure they are by their members' labels of now."""
    log = _log(v)
    scratch = Scratch(log.sparkSession, "modes")
    log = scratch.write(log, "log")
    pure = purity(members(log, scratch), v("v_item").select("project_id", "item_id", "issue_type"))
    rows = modes(log, scratch).join(pure, ["project_id", "mode_id"], "left")
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return rows.select("project_id", "mode_id", "status", "label", zero("members", 0), zero("support", 0), zero("purity", 0.0))


# decisions taken twice


@query("l11_paired_replay", python=True)
def l11(v: Views) -> DataFrame:
    """By project, what a model over an item's vector and its launch's features decides of all items, and what it would decide of each
    alone. The model is a small one, trained on the labelled items."""
    items = v("v_item").select("project_id", "item_id", "launch_id", "issue_group")
    groups = g4(v)
    launches = groups.groupBy("launch_id").agg(F.sum("n").alias("failures"))
    sizes = items.groupBy("launch_id").agg(F.count("*").alias("items"))
    rows = v("v_signature").where("size(emb) > 0").select("project_id", "item_id", "error_hash", "emb").join(items, ["project_id", "item_id"]).join(groups, ["launch_id", "error_hash"]).join(launches, "launch_id").join(sizes, "launch_id")
    launch = {"group_dominance": F.col("n") / F.col("failures"), "co_failure_group_size": F.log1p("n") / F.log1p(F.lit(200.0)), "launch_fail_fraction": F.col("failures") / F.col("items"), "si_prior": F.col("si_prior")}
    vector = F.concat(F.array(*[F.least(F.lit(1.0), c).cast("double") for c in launch.values()]), F.transform("emb", lambda x: x.cast("double")))
    placed = Scratch(items.sparkSession, "replay").write(rows.select("project_id", "item_id", "issue_group", vector.alias("features")), "features")
    labelled = placed.where(F.col("issue_group").isin("pb", "ab", "si", "nd"))
    model = boosting.boost(labelled.select("features", F.col("issue_group").alias("label")), boosting.Settings(rounds=4, leaves=8, rate=0.3, bins=31))
    return report(paired(model, placed.drop("issue_group"), list(launch)), ["project_id"])
