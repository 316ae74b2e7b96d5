"""Suggestions as they are shown and kept, facts for a text model, and what its answers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.cleaning import name_words, prepared_log, test_methods
from ..functions.labels import base_group
from ..operators.relational import latest, top_k
from ..sources.views import AS_OF
from .decision import LOCATORS, ladder
from .learning import project
from .registry import ORACLE_SQL, Views, query
from .triage import LABELLED, SOURCES_SQL, STAGE_C_SQL, labels, query_set, stage_c

# Least scores of what is shown and of what was looked at and declined, rows of either kind, why there is no answer.
SHOWN, LOOKED_AT = 0.45, 0.30
MOST, MOST_DECLINED, MOST_DECLINED_EVER = 3, 2, 3
REASONS = {
    "gbm_below_suggest": "model probability stayed below the suggest threshold",
    "gbm_boilerplate_only_neighbor": "the nearest neighbour shared no structural evidence (boilerplate guard)",
    "no_confident_rule": "no rule or model matched with enough confidence",
}
NO_REASON = "no candidate cleared the decision gates"
NEGATIVE_DAYS = 7
POOL = 10


def _reason(code: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[code], other)


def vouched_by(source: Column) -> Column:
    """Who stands behind a candidate's label."""
    known = F.when(source == "ai_suggested", "auto-analyzed").when(source.isin("rp", "human"), "human-confirmed").when(source == "seed", "seed")
    return F.coalesce(known, F.lit("unlabeled"))


def shown(decisions: DataFrame, candidates: DataFrame, with_declined: bool = False, chosen: DataFrame | None = None, most: int = MOST, most_declined: int = MOST_DECLINED) -> DataFrame:
    """The rows of each query's answer, in order of ``position``.

    ``decisions``: query_id, label, confidence, method, action, abstain_reason, issue_type, relevant_item_id, label_source (that
    item's), guess (a model's group, or null). ``candidates``: query_id, item_id, place, issue_type, cosine, rrf_score, label_source.
    ``chosen``: query_id, item_id that a judge prefers; it comes first unless the decision is automatic.

    The decision's own answer comes first, then candidates by place. Rows from ``LOOKED_AT`` to ``SHOWN`` come last and only with
    ``with_declined``; then a guess that was too unsure is one of them, under its best candidate. Without an answer they take their
    places from the others. A query whose best score is too low, or that has no rows, gives none.
    """
    floor = LOOKED_AT if with_declined else SHOWN
    one = lambda c: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))
    first = candidates.groupBy("query_id").agg(F.min_by("cosine", "place").alias("first_cosine"))
    proxy = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.col("confidence")).otherwise(one(F.col("first_cosine")))
    d = decisions.join(first, "query_id", "left").where(proxy >= floor).drop("first_cosine")
    about = d.select("query_id", "label", F.col("confidence").alias("d_confidence"), "action", "abstain_reason", "relevant_item_id", "guess")
    answered = (F.col("label") != "ti") & F.col("relevant_item_id").isNotNull()
    row = ["query_id", "item_id", "issue_type", "score", "es_score", "source", "rank"]
    own = d.where(answered).select(
        "query_id", F.col("relevant_item_id").alias("item_id"), "issue_type", F.col("confidence").alias("score"), F.lit(0.0).alias("es_score"),
        F.when(F.col("method") == "kb", "kb-mode").otherwise(vouched_by(F.col("label_source"))).alias("source"), F.lit(0).alias("rank"),
    )
    c = candidates.where("item_id IS NOT NULL AND issue_type IS NOT NULL").join(about, "query_id").where(~F.coalesce(answered & (F.col("item_id") == F.col("relevant_item_id")), F.lit(False)))
    c = c.withColumns({"score": one(F.col("cosine")), "es_score": F.col("rrf_score"), "source": vouched_by(F.col("label_source")), "rank": F.col("place").cast("int")})
    rows = own.unionByName(c.select(row)).where(F.col("score") >= floor)
    if with_declined:
        unsure = (F.col("abstain_reason") == "gbm_below_suggest") & (F.col("d_confidence") >= LOOKED_AT) & (F.col("d_confidence") < SHOWN)
        best = c.where(unsure & (F.col("score") < floor) & (base_group(F.col("issue_type")) == F.col("guess"))).groupBy("query_id").agg(F.min_by(F.struct("item_id", "issue_type", "es_score", "source", F.col("d_confidence").alias("score")), "place").alias("b"))
        extra = best.select("query_id", "b.item_id", "b.issue_type", "b.score", "b.es_score", "b.source", F.lit(2**31 - 1).alias("rank"))
        rows = rows.unionByName(extra.join(rows.select("query_id").distinct(), "query_id", "left_semi"))
    rows = rows.join(about.drop("guess"), "query_id")
    if chosen is not None:
        rows = rows.join(chosen.select("query_id", F.col("item_id").alias("chosen")), "query_id", "left")
        rows = rows.withColumn("rank", F.when((F.col("item_id") == F.col("chosen")) & (F.col("action") != "auto"), -1).otherwise(F.col("rank"))).drop("chosen")

    low = F.col("low")
    of_query = Window.partitionBy("query_id")
    rows = rows.withColumn("low", F.col("score") < SHOWN).repartition("query_id")  # both windows below then need no shuffle
    rows = rows.withColumns({"n_low": F.least(F.count_if(low).over(of_query), F.lit(max(0, min(most_declined, MOST_DECLINED_EVER)))), "n": F.count_if(~low).over(of_query), "k": F.row_number().over(Window.partitionBy("query_id", "low").orderBy("rank"))})
    room = F.when((F.col("n_low") > 0) & (F.col("label") == "ti"), F.greatest(F.lit(0), most - F.col("n_low"))).otherwise(F.lit(most))
    rows = rows.withColumn("n", F.least("n", room)).where(F.col("k") <= F.when(F.col("low"), F.col("n_low")).otherwise(F.col("n")))
    is_own = (F.col("label") != "ti") & F.coalesce(F.col("item_id") == F.col("relevant_item_id"), F.lit(False))
    band = F.when(F.col("low"), "below_suggest").when((F.col("action") == "auto") & is_own, "auto").otherwise("suggest")
    return rows.select(
        "query_id", (F.when(F.col("low"), F.col("n")).otherwise(0) + F.col("k") - 1).cast("int").alias("position"), "item_id", "issue_type", F.round(F.least(F.lit(1.0), "score") * 100, 2).alias("match_score"), F.round("es_score", 6).alias("es_score"),
        band.alias("band"), "source", F.when(is_own & (F.col("d_confidence") > 0), F.round("d_confidence", 4)).alias("answer_confidence"), F.when(F.col("low") & (F.col("k") == 1), _reason(F.col("abstain_reason"), F.lit(None).cast("string"))).alias("why"),
    )


def _decisions(v: Views, model: DataFrame | None = None) -> DataFrame:
    """The ladder's decisions with the source of the item each leans on, and a model's guess."""
    d = ladder(v, model).join(labels(v).select(F.col("item_id").alias("relevant_item_id"), "label_source"), "relevant_item_id", "left")
    return d.join(model.select("query_id", F.col("label").alias("guess")), "query_id", "left") if model is not None else d.withColumn("guess", F.lit(None).cast("string"))


@query("d11_suggestions")
def d11(v: Views) -> DataFrame:
    return shown(_decisions(v), stage_c(v))


@query("d11_declined_suggestions")
def d11_declined(v: Views) -> DataFrame:
    """With declined rows, for a stand-in model that guesses by the item's number, and a judge who prefers the third candidate."""
    turn = F.floor(F.col("query_id") / 50)
    guess = F.element_at(F.array(*[F.lit(x) for x in LOCATORS]), (turn % 4 + 1).cast("int"))
    model = query_set(v).select("query_id", guess.alias("label"), (turn % 10 / 10.0).alias("confidence"))
    c = stage_c(v)
    return shown(_decisions(v, model), c, True, c.where("place = 3").select("query_id", "item_id"))


def inherited_sentence(item: Column, source: Column, label: Column) -> Column:
    return F.concat(F.lit("Inherited from item "), item, F.lit(" ("), F.when(source.isin("rp", "human"), "human-labeled ").otherwise(""), label, F.lit(", same error_hash, discriminant gate passed)."))


@query("d14_suggestion_rows", f"""
SELECT query_id, issue_type, confidence, method, CASE WHEN method = 'hash' THEN concat('Inherited from item ', relevant_item_id, ' (', CASE WHEN label_source IN ('rp', 'human') THEN 'human-labeled ' ELSE '' END, issue_type, ', same error_hash, discriminant gate passed).') END AS explanation
FROM ({ORACLE_SQL['d4_decision_ladder']}) d LEFT JOIN (SELECT item_id, {SOURCES_SQL} AS label_source FROM v_label_event QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1) l ON l.item_id = relevant_item_id""")  # fmt: skip
def d14(v: Views) -> DataFrame:
    """A decision as a row to append; an inherited label has its sentence without any model."""
    said = F.when((F.col("method") == "hash") & F.col("relevant_item_id").isNotNull(), inherited_sentence(F.col("relevant_item_id"), F.coalesce("label_source", F.lit("")), F.col("issue_type")))
    return _decisions(v).select("query_id", "issue_type", "confidence", "method", said.alias("explanation"))


@query("d17_item_journey", f"""
WITH s AS (SELECT item_id, arg_max(predicted_label, {{'t': created_at, 's': suggestion_id}}) AS last_suggested, count(*) AS n_suggestions, count(*) FILTER (WHERE outcome = 'accepted') AS n_accepted FROM v_suggestion GROUP BY item_id),
l AS (SELECT item_id, arg_max(new_label, {{'t': ts, 'e': event_id}}) AS last_label, count(*) AS n_labels FROM v_label_event GROUP BY item_id), e AS (SELECT item_id, count(*) AS n_model_calls, count(*) FILTER (WHERE cache_hit) AS n_cached FROM v_llm_event GROUP BY item_id),
m AS (SELECT item_id, arg_max(mode_id, {{'s': match_score, 'm': -mode_id}}) AS mode_id FROM v_mode_member GROUP BY item_id), g AS (SELECT item_id, count(*) AS n_logs, count(*) FILTER (WHERE log_level >= 40000) AS n_errors FROM v_log GROUP BY item_id),
h AS (SELECT project_id, error_hash, count(*) AS n_same_hash FROM v_signature GROUP BY ALL)
SELECT i.item_id, i.launch_id, i.issue_type, x.error_hash, n_same_hash, coalesce(n_logs, 0) AS n_logs, coalesce(n_errors, 0) AS n_errors, mode_id, last_suggested, coalesce(n_suggestions, 0) AS n_suggestions, coalesce(n_accepted, 0) AS n_accepted, last_label, coalesce(n_labels, 0) AS n_labels, coalesce(n_model_calls, 0) AS n_model_calls, coalesce(n_cached, 0) AS n_cached
FROM v_item i JOIN v_signature x USING (project_id, item_id) JOIN h USING (project_id, error_hash) LEFT JOIN s USING (item_id) LEFT JOIN l USING (item_id) LEFT JOIN e USING (item_id) LEFT JOIN m USING (item_id) LEFT JOIN g USING (item_id) WHERE i.item_id % 50 = 0""")  # fmt: skip
def d17(v: Views) -> DataFrame:
    """What happened to an item, in one row: its logs, hash, mode, suggestions, labels and model calls. Each part is an aggregate
    of the asked items only."""
    asked = lambda name: v(name).where("item_id % 50 = 0")
    x = v("v_signature").select("project_id", "item_id", "error_hash")
    hashes = x.groupBy("project_id", "error_hash").agg(F.count("*").alias("n_same_hash"))
    out = asked("v_item").select("project_id", "item_id", "launch_id", "issue_type").join(x, ["project_id", "item_id"]).join(hashes, ["project_id", "error_hash"]).drop("project_id")
    parts = (
        asked("v_suggestion").groupBy("item_id").agg(F.max_by("predicted_label", F.struct("created_at", "suggestion_id")).alias("last_suggested"), F.count("*").alias("n_suggestions"), F.count_if(F.col("outcome") == "accepted").alias("n_accepted")),
        asked("v_label_event").groupBy("item_id").agg(F.max_by("new_label", F.struct("ts", "event_id")).alias("last_label"), F.count("*").alias("n_labels")),
        asked("v_llm_event").groupBy("item_id").agg(F.count("*").alias("n_model_calls"), F.count_if("cache_hit").alias("n_cached")),
        asked("v_mode_member").groupBy("item_id").agg(F.max_by("mode_id", F.struct("match_score", -F.col("mode_id"))).alias("mode_id")),
        asked("v_log").groupBy("item_id").agg(F.count("*").alias("n_logs"), F.count_if(F.col("log_level") >= 40000).alias("n_errors")),
    )
    for part in parts:
        out = out.join(part, "item_id", "left")
    return out.fillna(0, ["n_suggestions", "n_accepted", "n_labels", "n_model_calls", "n_cached", "n_logs", "n_errors"])


@query("r22_modes_map")
def r22(v: Views) -> DataFrame:
    """Items and centroids in one projection. Fewer than two vectors have none, so no rows."""
    items = v("v_signature").where("emb IS NOT NULL").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "emb")
    both = items.unionByName(v("v_mode").where("centroid IS NOT NULL").select(F.lit("mode").alias("kind"), F.col("mode_id").alias("id"), F.col("centroid").alias("emb")))
    if len(both.take(2)) < 2:
        return both.select("kind", "id", F.lit(None).cast("array<double>").alias("x")).limit(0)
    return project(both.select(F.struct("kind", "id").alias("item_id"), "emb")).select("item_id.*", "x")


# around a text model


def label_conflict(candidates: Column, pool: Column) -> Column:
    """What labels the evidence of an item without an answer splits over: its candidates', then its hash's; null without any."""
    found = F.array_distinct(F.filter(F.concat(candidates, pool), lambda x: x.isNotNull()))
    split = F.concat(F.lit("evidence splits across labels: "), F.array_join(found, ", "))
    return F.when(F.size(found) > 1, split).when(F.size(found) == 1, F.concat(F.lit("only weak same-label evidence: "), F.get(found, F.lit(0))))


@query("l18_label_conflict", """
WITH l AS (SELECT item_id, max(ts) AS ts FROM v_label_event GROUP BY item_id),
p AS (SELECT q.item_id AS query_id, i.issue_type, row_number() OVER (PARTITION BY q.item_id ORDER BY l.ts DESC NULLS LAST, i.item_id DESC) AS r FROM v_signature q JOIN v_signature s ON s.project_id = q.project_id AND s.error_hash = q.error_hash AND s.item_id <> q.item_id JOIN v_item i ON i.item_id = s.item_id AND i.project_id = s.project_id LEFT JOIN l ON l.item_id = s.item_id
  WHERE q.item_id % 50 = 0 AND q.error_hash <> 0 AND issue_type IS NOT NULL AND issue_group <> 'ti' QUALIFY r <= 10),
c AS (SELECT query_id, issue_type, count(*) AS n, min(r) AS f FROM p GROUP BY ALL)
SELECT query_id, string_agg(concat(n, 'x ', issue_type), '|' ORDER BY f) AS pool, CASE WHEN count(*) > 1 THEN concat('evidence splits across labels: ', string_agg(issue_type, ', ' ORDER BY f)) ELSE concat('only weak same-label evidence: ', min(issue_type)) END AS label_conflict FROM c GROUP BY query_id""")
def l18(v: Views) -> DataFrame:
    """The ten newest labelled items of an item's hash but itself, counted by label. Each hash is first cut to its eleven newest,
    so a hash that very many items share is never joined whole."""
    key = ["project_id", "error_hash"]
    s = v("v_signature").where("error_hash <> 0").select("item_id", *key)
    at = latest(v("v_label_event").withColumn("at", F.col("ts")), ["item_id"], ["ts"], ["at"])
    known = s.join(v("v_item").where(LABELLED).select("project_id", "item_id", "issue_type"), ["project_id", "item_id"]).join(at, "item_id", "left")
    newest = [F.desc_nulls_last("at"), F.desc("item_id")]
    pool = top_k(known, key, newest, POOL + 1).drop("rank").join(s.where("item_id % 50 = 0").select(*key, F.col("item_id").alias("query_id")), key).where("item_id <> query_id")
    counts = top_k(pool, ["query_id"], newest, POOL).groupBy("query_id", "issue_type").agg(F.count("*").alias("n"), F.min("rank").alias("f"))
    rows = counts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("f", "issue_type", "n"))).alias("c"))  # at most ten
    lines = F.array_join(F.transform("c", lambda c: F.concat(c.n, F.lit("x "), c.issue_type)), "|")
    return rows.select("query_id", lines.alias("pool"), label_conflict(F.array().cast("array<string>"), F.col("c.issue_type")).alias("label_conflict"))


def cache_plan(requests: DataFrame, cache: DataFrame, keys: list[str], as_of: str = AS_OF, days: int = NEGATIVE_DAYS) -> DataFrame:
    """What each request needs: ``hit``, ``negative`` (a failure that is kept for some days) or ``ask``. One of a repeated key asks.
    ``cache``: keys, negative, created_at, one row a key."""
    young = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) < days * 86_400_000_000
    plan = F.when(F.col("negative").isNull() | (F.col("negative") & ~young), "ask").when(F.col("negative"), "negative").otherwise("hit")
    return requests.select(*keys).distinct().join(cache.select(*keys, "negative", "created_at"), keys, "left").select(*keys, plan.alias("plan"))


@query("l15_cache_plan", f"""
WITH c AS (SELECT item_id, role, arg_max(outcome, {{'t': created_at, 'e': event_id}}) <> 'ok' AS negative, max(created_at) AS created_at FROM v_llm_event GROUP BY ALL)
SELECT r.item_id, r.role, CASE WHEN negative IS NULL OR negative AND NOT TIMESTAMP '{AS_OF}' - CAST(created_at AS TIMESTAMP) < INTERVAL 7 DAY THEN 'ask' WHEN negative THEN 'negative' ELSE 'hit' END AS plan FROM (SELECT DISTINCT item_id, 'view' AS role FROM v_suggestion) r LEFT JOIN c USING (item_id, role)""")
def l15(v: Views) -> DataFrame:
    last = v("v_llm_event").groupBy("item_id", "role").agg((F.max_by("outcome", F.struct("created_at", "event_id")) != "ok").alias("negative"), F.max("created_at").alias("created_at"))
    return cache_plan(v("v_suggestion").select("item_id", F.lit("view").alias("role")), last, ["item_id", "role"])


def cold_start_rows(answers: DataFrame, model: str) -> DataFrame:
    """Suggestions of (item_id, rule, label, bucket, reason): as sure as the rule says, else as the model; without rule names."""
    own = {r: prompts.BUCKETS[b] for r, _, b, _ in prompts.RUBRIC}
    number = lambda d, c: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[c]
    names = {r: name for r, _, _, name in prompts.RUBRIC}
    said = prompts.without_rule_ids(F.col("reason"))
    return answers.select(
        "item_id", F.col("label").alias("predicted_label"), F.coalesce(number(own, F.col("rule")), number(prompts.BUCKETS, F.col("bucket"))).alias("confidence"), F.lit(f"rubric+{model}").alias("model_ver"),
        F.coalesce(number(names, F.col("rule")), F.lit("")).alias("rule_name"), F.when(said != "", said).alias("explanation"),
    )


_RULES_SQL = ", ".join(f"({k}, {prompts.BUCKETS[b]}::DOUBLE, '{name.replace(chr(39), chr(39) * 2)}')" for k, (_, _, b, name) in enumerate(prompts.RUBRIC))


@query("l17_cold_start_rows", f"""
WITH r(place, confidence, name) AS (VALUES {_RULES_SQL})
SELECT suggestion_id, predicted_label, coalesce(r.confidence, 0.65::DOUBLE) AS confidence, 'rubric+v1' AS model_ver, coalesce(name, '') AS rule_name, concat('Item ', item_id, ' failed in setup.') AS explanation FROM v_suggestion LEFT JOIN r ON place = suggestion_id % 16""")
def l17(v: Views) -> DataFrame:
    """Answers that take the rules in turn, or none, and always say they are sure."""
    rules = F.array(*[F.lit(r) for r, *_ in prompts.RUBRIC], F.lit("none"), F.lit("none"))
    rule = F.get(rules, (F.col("suggestion_id") % 16).cast("int"))
    reason = F.concat(F.lit("Rule R4 applies. Item "), "item_id", F.lit(" failed in setup, matching R2."))
    answers = v("v_suggestion").select(F.col("suggestion_id").alias("item_id"), rule.alias("rule"), F.col("predicted_label").alias("label"), F.lit("high").alias("bucket"), reason.alias("reason"))
    return cold_start_rows(answers, "v1").withColumnRenamed("item_id", "suggestion_id")


def judged(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, choice, chosen_item_id) to note at a suggestion: ``candidate_k`` is the candidate of place k, ``none`` is no one,
    ``abstain`` notes nothing."""
    told = verdicts.where("choice <> 'abstain'").withColumn("place", F.regexp_extract("choice", "^candidate_(\\d+)$", 1).try_cast("int"))
    return told.join(candidates.select("query_id", "place", F.col("item_id").alias("chosen_item_id")), ["query_id", "place"], "left").select("query_id", "choice", "chosen_item_id")


@query("l17_judge_notes", STAGE_C_SQL + """, t AS (SELECT DISTINCT query_id, CASE (query_id // 50) % 4 WHEN 0 THEN 'candidate_1' WHEN 1 THEN 'candidate_2' WHEN 2 THEN 'none' ELSE 'abstain' END AS choice FROM stage_c)
SELECT query_id, choice, max(item_id) FILTER (WHERE choice = concat('candidate_', place)) AS chosen_item_id FROM t JOIN stage_c USING (query_id) WHERE choice <> 'abstain' GROUP BY ALL""")
def l17_judge(v: Views) -> DataFrame:
    c = stage_c(v).select("query_id", "place", "item_id")
    choice = F.element_at(F.array(*[F.lit(x) for x in ("candidate_1", "candidate_2", "none", "abstain")]), (F.floor(F.col("query_id") / 50) % 4 + 1).cast("int"))
    return judged(c.select("query_id").distinct().withColumn("choice", choice), c)


# text


@query("t35_name_words")
def t35(v: Views) -> DataFrame:
    return v("v_item").select("item_id", name_words(F.concat(F.lit("com.shop."), "launch_name", F.lit("Test.checkItem_of"), "launch_id")).alias("out"))


@query("t36_test_methods")
def t36(v: Views) -> DataFrame:
    return v("v_log").select("item_id", "pos", F.array_join(test_methods(F.concat("message", F.lit(" in com.shop.CartTest.add(1)"))), " ").alias("out"))


@query("t39_prepared_logs")
def t39(v: Views) -> DataFrame:
    return v("v_log").select("item_id", "pos", prepared_log(F.col("message")).alias("p")).select("item_id", "pos", "p.*")


@query("t43_excerpts")
def t43(v: Views) -> DataFrame:
    return v("v_signature").select("item_id", prompts.excerpt(F.col("msg_text"), 100).alias("out"))


@query("t44_without_rule_ids", "SELECT item_id, concat('Item ', item_id, ' failed in setup.') AS out FROM v_item")
def t44(v: Views) -> DataFrame:
    return v("v_item").select("item_id", prompts.without_rule_ids(F.concat(F.lit("Rule R4 applies. Item "), "item_id", F.lit(" failed in setup, matching R2."))).alias("out"))


@query("t45_cut_marks")
def t45(v: Views) -> DataFrame:
    return v("v_log").select("item_id", "pos", prompts.marked_cut(F.col("message"), F.when(F.col("pos") % 2 == 0, "length")).alias("out"))


@query("h17_schema_check", """SELECT message_id, coalesce(regexp_full_match(body, '\\{"k": -?[0-9]+\\}'), FALSE) AS fits FROM v_message""")
def h17(v: Views) -> DataFrame:
    """Bodies that are an object of one whole number."""
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer"}}}
    return v("v_message").select("message_id", prompts.fits_schema(F.try_parse_json("body"), schema).alias("fits"))
