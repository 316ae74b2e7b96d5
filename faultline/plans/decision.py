"""Decisions for the query items: inherited labels, known failure modes, seeds, features and the ladder over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import discriminant_agrees, identifier_jaccard, same_set, seed_mode, tokens
from ..functions.labels import band, base_group
from ..functions.seeds import SEED_MODES
from ..functions.text import jaccard
from ..operators.features import FEATURES, features, vector
from ..operators.relational import top_k
from ..operators.retrieval import cosine
from ..sources.views import AS_OF
from .registry import Views, query
from .relational import f5, g4, w8
from .triage import COSINE_SQL, JACCARD_SQL, SOURCES_SQL, labels, query_set, stage_c

# Fixed values of the decision.
INHERITED, OLDEST_DAYS, HUMAN_CONFIDENCE = 0.95, 180, 0.9
KB_WEIGHTS = (0.6, 0.25, 0.15)
KB_PURITY, KB_SUPPORT, KB_SCORE, KB_CAP, KB_CANDIDATE, SEED_LEAST = 0.95, 10, 0.85, 0.93, 0.7, 0.7
LOCATORS = {"pb": "pb001", "ab": "ab001", "si": "si001", "nd": "nd001"}

_TOKENS = "list_distinct(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_IDS = "list_filter({0}, lambda w: regexp_matches(w, '\\.|::|[a-z][A-Z]'))"
_SETS = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
MATCHES_SQL = f"""
WITH lb AS (SELECT item_id, {SOURCES_SQL} AS label_source, ts AS label_ts FROM v_label_event QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1),
h AS (SELECT a.item_id AS query_id, b.item_id, a.exception_fp, i.issue_type, label_source, label_ts, list_sort(list_distinct(a.status_codes)) = list_sort(list_distinct(b.status_codes)) AS same_codes, {_TOKENS.format("a.msg_text")} AS t, {_TOKENS.format("b.msg_text")} AS u,
  row_number() OVER (PARTITION BY a.item_id ORDER BY label_ts DESC NULLS LAST, b.item_id DESC) AS place
  FROM v_signature a JOIN v_signature b USING (project_id, error_hash) JOIN v_item i ON i.item_id = b.item_id LEFT JOIN lb ON lb.item_id = b.item_id WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id AND issue_type IS NOT NULL QUALIFY place <= 10),
j AS (SELECT *, {_IDS.format("t")} AS ti, {_IDS.format("u")} AS ui FROM h),
m AS (SELECT *, same_codes AND CASE WHEN len(ti) > 0 OR len(ui) > 0 THEN {_SETS.format("ti", "ui")} ELSE {_SETS.format("t", "u")} END >= 0.5 AS agrees FROM j)"""


def hash_matches(v: Views) -> DataFrame:
    """The ten newest labelled items of each query's error hash, and if they agree with it on what masking hides. A hash is cut to
    its eleven newest first, of which the query itself may be one, so a query meets no more however many items share its hash."""
    q = query_set(v).select("query_id", "project_id", "error_hash", F.col("exception_fp").alias("fp"), F.col("status_codes").alias("codes"), F.col("msg_text").alias("message"))
    known = v("v_item").where("issue_type IS NOT NULL").select("project_id", "item_id", "issue_type")
    others = v("v_signature").select("project_id", "item_id", "error_hash", "status_codes", "msg_text").join(known, ["project_id", "item_id"])
    newest = [F.desc_nulls_last("label_ts"), F.desc("item_id")]
    heads = top_k(others.join(labels(v), "item_id", "left"), ["project_id", "error_hash"], newest, 11, "of_hash").drop("of_hash")
    pairs = q.join(heads, ["project_id", "error_hash"]).where("query_id <> item_id")
    best = top_k(pairs, ["query_id"], newest, 10, "place")
    return best.withColumn("agrees", discriminant_agrees(F.col("codes"), F.col("message"), F.col("status_codes"), F.col("msg_text")))


@query("f9_discriminant_gate", MATCHES_SQL + " SELECT query_id, item_id, CAST(place AS INTEGER) AS place, agrees FROM m")
def f9(v: Views) -> DataFrame:
    return hash_matches(v).select("query_id", "item_id", "place", "agrees")


INHERIT_SQL = MATCHES_SQL + f""",
n AS (SELECT query_id, count(*) AS n, count(DISTINCT issue_type) AS types, arg_min(issue_type, place) AS issue_type, arg_min(item_id, place) AS item_id, arg_min(coalesce(label_source, ''), place) AS source, arg_min(coalesce(epoch(TIMESTAMP '{AS_OF}' - CAST(label_ts AS TIMESTAMP)) / 86400.0, 0), place) AS age
  FROM m WHERE agrees AND exception_fp <> 0 GROUP BY query_id),
inherits AS (SELECT query_id, item_id AS relevant_item_id, issue_type FROM n WHERE age <= 180 AND (n >= 2 AND types = 1 OR n = 1 AND source IN ('rp', 'human')) AND substr(issue_type, 1, 2) IN ('pb', 'ab', 'si', 'nd') AND NOT (substr(issue_type, 1, 2) = 'nd' AND source = 'ai_suggested'))"""


def inherited(v: Views) -> DataFrame:
    """(query_id, relevant_item_id, issue_type) where the agreeing matches let a label be inherited."""
    first = lambda c: F.min_by(c, "place")
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("label_ts").cast("timestamp"))) / 86_400_000_000.0
    m = hash_matches(v).where("agrees AND fp <> 0").withColumn("age", F.coalesce(age, F.lit(0.0))).withColumn("source", F.coalesce("label_source", F.lit("")))
    n = m.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("issue_type").alias("types"), first("issue_type").alias("issue_type"), first("item_id").alias("relevant_item_id"), first("source").alias("source"), first("age").alias("age"))
    human = (F.col("n") == 1) & F.col("source").isin("rp", "human")  # both are surer than HUMAN_CONFIDENCE
    base = base_group(F.col("issue_type"))
    fits = (F.col("age") <= OLDEST_DAYS) & (((F.col("n") >= 2) & (F.col("types") == 1)) | human) & base.isNotNull() & ~((base == "nd") & (F.col("source") == "ai_suggested"))
    return n.where(fits).select("query_id", "relevant_item_id", "issue_type")


@query("d1_inherit_guards", INHERIT_SQL + " SELECT * FROM inherits")
def d1(v: Views) -> DataFrame:
    return inherited(v)


MODES_SQL = f"""
q AS (SELECT item_id AS query_id, project_id, emb, template_ids AS q_t, exception_fp AS q_fp FROM v_signature WHERE item_id % 50 = 0),
c AS (SELECT query_id, m.*, list_contains(exception_fps, q_fp) AS same_fp, CASE WHEN centroid IS NOT NULL THEN {COSINE_SQL.format("emb", "centroid")} END AS cosine, {JACCARD_SQL.format("q_t", "template_ids")} AS jac FROM q JOIN v_mode m USING (project_id)
  WHERE status IN ('seed', 'candidate', 'confirmed') AND (centroid IS NOT NULL OR list_contains(exception_fps, q_fp))),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same_fp DESC, cosine DESC NULLS LAST, mode_id DESC) AS place, round(0.6 * coalesce(cosine, 0) + 0.25 * jac + CASE WHEN same_fp THEN 0.15 ELSE 0 END, 6) AS score FROM c QUALIFY place <= 10),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mode_id) = 1)"""


def mode_matches(v: Views) -> DataFrame:
    """The ten first modes of each query's project: those of its fingerprint, then the nearest; with their scores."""
    q = query_set(v).select("query_id", "project_id", "emb", F.col("template_ids").alias("q_t"), F.col("exception_fp").alias("q_fp"))
    modes = v("v_mode").where(F.col("status").isin("seed", "candidate", "confirmed"))
    rows = q.join(modes, "project_id").withColumn("same_fp", F.array_contains("exception_fps", F.col("q_fp"))).where("centroid IS NOT NULL OR same_fp")
    rows = rows.withColumn("cosine", F.round(cosine(F.col("emb"), F.col("centroid")), 6))
    parts = (F.coalesce("cosine", F.lit(0.0)), jaccard(F.col("q_t"), F.col("template_ids")), F.when(F.col("same_fp"), 1.0).otherwise(0.0))
    rows = rows.withColumn("score", F.round(sum((w * p for w, p in zip(KB_WEIGHTS[1:], parts[1:], strict=True)), KB_WEIGHTS[0] * parts[0]), 6))
    return top_k(rows.drop("emb", "centroid"), ["query_id"], [F.desc("same_fp"), F.desc_nulls_last("cosine"), F.desc("mode_id")], 10, "place")


def best_mode(v: Views) -> DataFrame:
    """The mode of the highest score for each query, the lowest id of equals, and if it decides alone."""
    best = top_k(mode_matches(v), ["query_id"], [F.desc("score"), F.asc("mode_id")], 1, "k")
    decides = (F.col("status") == "confirmed") & (F.col("purity") >= KB_PURITY) & (F.col("support") >= KB_SUPPORT) & (F.col("score") >= KB_SCORE)
    return best.select("query_id", "mode_id", "status", "issue_type", "purity", "support", "same_fp", "score", decides.alias("decides"), F.round(F.least(F.lit(KB_CAP), F.col("purity") * F.col("score")), 6).alias("confidence"))


@query("r8_mode_match", "WITH " + MODES_SQL + " SELECT query_id, mode_id, same_fp, cosine, CAST(place AS INTEGER) AS place FROM k")
def r8(v: Views) -> DataFrame:
    return mode_matches(v).select("query_id", "mode_id", "same_fp", "cosine", "place")


@query("d2_kb_score", "WITH " + MODES_SQL + " SELECT query_id, mode_id, score FROM b")
def d2(v: Views) -> DataFrame:
    return best_mode(v).select("query_id", "mode_id", "score")


_DECIDES = "status = 'confirmed' AND purity >= 0.95 AND support >= 10 AND score >= 0.85"


@query("d3_kb_short_circuit", f"WITH {MODES_SQL} SELECT query_id, mode_id, {_DECIDES} AS decides, round(least(0.93, purity * score), 6) AS confidence FROM b")
def d3(v: Views) -> DataFrame:
    return best_mode(v).select("query_id", "mode_id", "decides", "confidence")


def _seed_sql() -> str:
    """The seeds as a CASE in DuckDB's dialect, whose patterns know no look-ahead."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cases = []
    for m in SEED_MODES:
        parts = [f"regexp_matches(exc_text, {quoted(p)})" for p in m.exceptions]
        for p in m.messages:
            if "(?!" in p:
                head = p.partition("(?!")[0]
                parts.append(f"regexp_matches(msg_text, {quoted('(?im)' + head)}) AND NOT regexp_matches(msg_text, {quoted('(?im)' + head + '.*selenium')})")
            else:
                parts.append(f"regexp_matches(msg_text, {quoted('(?im)' + p)})")
        parts += [f"contains(lower(concat(msg_text, chr(10), exc_text)), {quoted(w)})" for w in m.words]
        cases.append(f"WHEN {' OR '.join(parts)} THEN '{m.key}'")
    return f"CASE {' '.join(cases)} END"


def seeds(v: Views) -> DataFrame:
    """(item_id, project_id, key, label, confidence) of every item's first fitting seed mode, nulls for none."""
    classes = F.when(F.col("exc_text") == "", F.array().cast("array<string>")).otherwise(F.array("exc_text"))
    found = v("v_signature").select("item_id", "project_id", seed_mode(classes, F.col("msg_text")).alias("s"))
    return found.select("item_id", "project_id", "s.key", "s.label", "s.confidence")


@query("k1_seed_match", f"SELECT item_id, {_seed_sql()} AS key FROM v_signature")
def k1(v: Views) -> DataFrame:
    return seeds(v).select("item_id", "key")


@query("k2_seed_copies", f"WITH s AS (SELECT DISTINCT project_id, {_seed_sql()} AS key FROM v_signature) SELECT project_id, key FROM s WHERE key IS NOT NULL AND NOT (project_id = 1 AND key = 'npe_undefined')")
def k2(v: Views) -> DataFrame:
    """The modes to copy into projects that hit them and haven't them; project 1 has one already. Again, it copies nothing."""
    there = v("v_item").where("project_id = 1").select("project_id", F.lit("npe_undefined").alias("key")).distinct()
    return seeds(v).where("key IS NOT NULL").select("project_id", "key").distinct().join(there, ["project_id", "key"], "left_anti")


@query("s14_seed_catalog", "SELECT DISTINCT label, confidence FROM (VALUES " + ", ".join(f"('{m.label}', {m.confidence}::DOUBLE)" for m in SEED_MODES) + ") AS t(label, confidence)")
def s14(v: Views) -> DataFrame:
    """The catalog as a table, once it has passed its rules."""
    checked = check_catalog(SEED_MODES)
    rows = F.array(*[F.struct(F.lit(m.label).alias("label"), F.lit(m.confidence).alias("confidence")) for m in checked])
    return v("region").select(F.inline(rows)).distinct()


def check_catalog(modes) -> tuple:
    """The modes if keys are unique, labels and confidences in range, every mode has a rule that compiles, and there are 50."""
    import re

    keys = {m.key for m in modes}
    if len(modes) != 50 or len(keys) != len(modes):
        raise ValueError("the catalog must hold 50 modes of different keys")
    for m in modes:
        if m.label not in LOCATORS or not 0 < m.confidence <= 1 or not (m.exceptions or m.messages or m.words):
            raise ValueError(f"{m.key}: a label of {sorted(LOCATORS)}, a confidence in (0, 1] and a rule are asked for")
        for p in (*m.exceptions, *m.messages):
            re.compile(p)
    return tuple(modes)


_MODE_KEY = " LEFT JOIN (SELECT item_id AS query_id, " + "{seed} AS key FROM v_signature WHERE item_id % 50 = 0) s USING (query_id)"


@query("d9_mode_of_item", f"WITH {MODES_SQL} SELECT query_id, CASE WHEN {_DECIDES} THEN concat('mode:', mode_id) WHEN key IS NOT NULL THEN concat('seed:', key) WHEN score >= 0.7 THEN concat('mode:', mode_id) END AS joins FROM b" + _MODE_KEY.format(seed=_seed_sql()))
def d9(v: Views) -> DataFrame:
    """The mode an item joins: one that decides alone, else its seed's, else the best of 0.7 or more."""
    rows = best_mode(v).join(seeds(v).select(F.col("item_id").alias("query_id"), "key"), "query_id", "left")
    mode = F.concat(F.lit("mode:"), F.col("mode_id").cast("string"))
    return rows.select("query_id", F.when(F.col("decides"), mode).when(F.col("key").isNotNull(), F.concat(F.lit("seed:"), F.col("key"))).when(F.col("score") >= KB_CANDIDATE, mode).alias("joins"))


def context(v: Views) -> DataFrame:
    """What is known of each query besides its candidates, as the features ask for it."""
    q = query_set(v).select("query_id", F.col("msg_text").alias("message"), F.col("status_codes").alias("codes"), "exc_text", "error_hash")
    item = v("v_item").select(F.col("item_id").alias("query_id"), "launch_id", "test_case_hash")
    best = best_mode(v).select("query_id", F.col("score").alias("kb_score"), F.col("purity").alias("kb_purity"), F.col("support").alias("kb_support"), F.col("same_fp").alias("kb_same_fp"))
    seed = seeds(v).select(F.col("item_id").alias("query_id"), F.col("label").alias("seed_label"), F.col("confidence").alias("seed_confidence"))
    history = w8(v).select("test_case_hash", "runs", "failures", "flips", "flakiness")
    first = v("v_history").groupBy("test_case_hash").agg(F.min("ts").alias("first_ts"))
    launches = v("v_item").groupBy("launch_id").agg(F.count("*").alias("launch_items"), F.count("issue_group").alias("launch_failures"))
    groups = g4(v).select("launch_id", "error_hash", F.col("n").alias("group_size"), "si_prior")
    logs = f5(v).select(F.col("item_id").alias("query_id"), F.col("n_logs").alias("log_count"), F.col("merged").alias("is_merged"))
    m = hash_matches(v)
    hashes = m.groupBy("query_id").agg(F.min_by("msg_text", "place").alias("hash_message"), F.min_by("status_codes", "place").alias("hash_codes"), (~F.bool_or(F.col("agrees")) & (F.max("fp") != 0)).alias("gate_blocked"))
    x = q.join(item, "query_id").join(best, "query_id", "left").join(seed, "query_id", "left").join(history, "test_case_hash", "left").join(first, "test_case_hash", "left")
    x = x.join(launches, "launch_id", "left").join(groups, ["launch_id", "error_hash"], "left").join(logs, "query_id", "left").join(hashes, "query_id", "left")
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 86_400_000_000.0
    named = F.col("exc_text") != ""
    return x.withColumns({"test_age": age, "has_stack": F.col("query_id") % 3 == 0, "is_assertion": F.col("exc_text").contains("Assertion"), "n_exceptions": named.cast("int"), "failing_layer": F.when(F.col("query_id") % 100 == 0, "app_code"), "error_class": F.when(F.col("exc_text").contains("Timeout"), "timeout")})


@query("d7_features")
def d7(v: Views) -> DataFrame:
    rows = features(stage_c(v), context(v))
    return rows.select("query_id", *[F.round(n, 6).alias(n) for n in FEATURES])


@query("d8_feature_vector")
def d8(v: Views) -> DataFrame:
    """The features as a model's list asks for them; a name that the features lack takes the model's default."""
    names = [*list(FEATURES)[:40], "dropped_ordinal", *list(FEATURES)[40:]]
    rows = features(stage_c(v), context(v))
    return rows.select("query_id", F.transform(vector(names, {"dropped_ordinal": 0.25}), lambda x: F.round(x, 6)).alias("vector"))


def ladder(v: Views, model: DataFrame | None = None) -> DataFrame:
    """(query_id, label, issue_type, confidence, method, action, abstain_reason, relevant_item_id, matched_mode_id): an inherited
    label, else a mode that decides alone, else the model (query_id, label, confidence, if there is one), else a sure seed, else
    none."""
    rows = query_set(v).select("query_id").join(inherited(v).withColumnRenamed("issue_type", "h_type"), "query_id", "left")
    rows = rows.join(best_mode(v).where("decides").select("query_id", F.col("mode_id").alias("k_mode"), F.col("issue_type").alias("k_type"), F.col("confidence").alias("k_confidence")), "query_id", "left")
    rows = rows.join(seeds(v).where(F.col("confidence") >= SEED_LEAST).select(F.col("item_id").alias("query_id"), F.col("label").alias("s_label"), F.col("confidence").alias("s_confidence")), "query_id", "left")
    rows = rows.join(model.select("query_id", F.col("label").alias("g_label"), F.col("confidence").alias("g_confidence")), "query_id", "left") if model is not None else rows.withColumns({"g_label": F.lit(None).cast("string"), "g_confidence": F.lit(None).cast("double")})
    locator = F.create_map(*[F.lit(x) for pair in LOCATORS.items() for x in pair])

    def step(label: Column, kind: Column, confidence: Column, method: str, alone: bool = False, item=None, mode=None, reason: Column | None = None) -> Column:
        action = F.when(label == "ti", "abstain").otherwise(F.lit("auto") if alone else band(confidence))
        none = F.lit(None).cast("long")
        return F.struct(
            label.alias("label"), kind.alias("issue_type"), F.round(confidence, 6).alias("confidence"), F.lit(method).alias("method"), action.alias("action"), F.when(action == "abstain", reason if reason is not None else F.lit(None).cast("string")).alias("abstain_reason"),
            (item if item is not None else none).cast("long").alias("relevant_item_id"), (mode if mode is not None else none).cast("long").alias("matched_mode_id"),
        )

    ti = F.lit("ti")
    unsure = F.col("g_confidence") < 0.45
    g_label = F.when(unsure, ti).otherwise(F.col("g_label"))
    out = (
        F.when(F.col("h_type").isNotNull(), step(base_group(F.col("h_type")), F.col("h_type"), F.lit(INHERITED), "hash", True, item=F.col("relevant_item_id")))
        .when(F.col("k_mode").isNotNull(), step(base_group(F.col("k_type")), F.col("k_type"), F.col("k_confidence"), "kb", True, mode=F.col("k_mode")))
        .when(F.col("g_label").isNotNull(), step(g_label, F.when(unsure, ti).otherwise(locator[F.col("g_label")]), F.col("g_confidence"), "gbm", reason=F.lit("gbm_below_suggest")))
        .when(F.col("s_label").isNotNull(), step(F.col("s_label"), locator[F.col("s_label")], F.col("s_confidence"), "rule_cold"))
        .otherwise(step(ti, ti, F.lit(0.0), "rule_cold", reason=F.lit("no_confident_rule")))
    )
    return rows.select("query_id", out.alias("d")).select("query_id", "d.*")


def model_decision(v: Views, model: DataFrame, sure: float = 0.75) -> DataFrame:
    """(query_id, label, issue_type, confidence, abstain_reason, relevant_item_id) of a model's (query_id, guess, max_prob).

    Below 0.45 there is no answer, unless the best candidate has the query's hash, a person's label and agrees on what masking
    hides: then its label is suggested, at 0.45. Below ``sure``, a best candidate with nothing of structure in common takes the
    answer back. The item named is the best candidate of the group.
    """
    rows = model.join(query_set(v).select("query_id", F.col("status_codes").alias("codes"), F.col("msg_text").alias("message")), "query_id")
    c = stage_c(v).withColumn("base", base_group(F.col("issue_type")))
    first = c.where("place = 1").select("query_id", F.col("item_id").alias("top_item"), F.col("issue_type").alias("top_type"), F.col("base").alias("top_base"), "label_source", "same_error_hash", "same_exception_fp", "jaccard_templates", F.col("msg_text").alias("top_message"))
    same = c.join(model.select("query_id", "guess"), "query_id").where("base = guess").groupBy("query_id").agg(F.min_by("item_id", "place").alias("item"), F.min_by("issue_type", "place").alias("type"))
    m = hash_matches(v)
    gate = m.groupBy("query_id").agg((~F.bool_or(F.col("agrees")) & (F.max("fp") != 0)).alias("blocked"), F.min_by("status_codes", "place").alias("hash_codes"))
    x = rows.join(first, "query_id", "left").join(same, "query_id", "left").join(gate, "query_id", "left")
    near = identifier_jaccard(tokens(F.coalesce("message", F.lit(""))), tokens(F.coalesce("top_message", F.lit("")))) >= 0.5
    coded = (F.size("codes") == 0) | F.coalesce(same_set(F.col("codes"), F.col("hash_codes")), F.lit(False))
    floor = F.coalesce(F.col("same_error_hash") & F.col("label_source").isin("rp", "human") & ~F.coalesce("blocked", F.lit(False)) & coded & near & F.col("top_base").isNotNull(), F.lit(False))
    bare = F.coalesce(~F.col("same_exception_fp") & ~F.col("same_error_hash") & (F.col("jaccard_templates") <= 0) & ~near, F.lit(False))
    locator = F.create_map(*[F.lit(y) for pair in LOCATORS.items() for y in pair])
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("max_prob")))
    unsure = (p < 0.45) | ~F.col("guess").isin(*LOCATORS)
    none = lambda t: F.lit(None).cast(t)
    answer = lambda label, kind, conf, reason, item: F.struct(label.alias("label"), kind.alias("issue_type"), F.round(conf, 6).alias("confidence"), reason.alias("abstain_reason"), item.cast("long").alias("relevant_item_id"))
    ti = F.lit("ti")
    out = (
        F.when(unsure & floor, answer(F.col("top_base"), F.col("top_type"), F.lit(0.45), none("string"), F.col("top_item"))).when(unsure, answer(ti, ti, p, F.lit("gbm_below_suggest"), none("long")))
        .when((p < sure) & bare, answer(ti, ti, p, F.lit("gbm_boilerplate_only_neighbor"), none("long"))).otherwise(answer(F.col("guess"), F.coalesce("type", locator[F.col("guess")]), p, none("string"), F.col("item")))
    )
    return x.select("query_id", out.alias("d")).select("query_id", "d.*")


@query("d6_model_decision")
def d6(v: Views) -> DataFrame:
    """For a stand-in model that guesses by the item's number."""
    q = query_set(v).select("query_id")
    guess = F.element_at(F.array(*[F.lit(x) for x in LOCATORS]), ((F.col("query_id") / 50) % 4 + 1).cast("int"))
    return model_decision(v, q.select("query_id", guess.alias("guess"), ((F.col("query_id") / 50) % 10 / 10.0).alias("max_prob")))


@query("d4_decision_ladder", INHERIT_SQL + ", " + MODES_SQL + f""", s AS (SELECT item_id AS query_id, {_seed_sql()} AS key FROM v_signature WHERE item_id % 50 = 0),
cat(key, label, confidence) AS (VALUES """ + ", ".join(f"('{x.key}', '{x.label}', {x.confidence}::DOUBLE)" for x in SEED_MODES) + f"""),
r AS (SELECT q.query_id, i.relevant_item_id, i.issue_type AS h, b.mode_id, b.issue_type AS k, least(0.93, purity * score) AS kc, cat.label, cat.confidence AS sc FROM q LEFT JOIN inherits i USING (query_id) LEFT JOIN (SELECT * FROM b WHERE {_DECIDES}) b USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN cat ON cat.key = s.key AND cat.confidence >= 0.7)
SELECT query_id, CASE WHEN h IS NOT NULL THEN substr(h, 1, 2) WHEN k IS NOT NULL THEN substr(k, 1, 2) ELSE coalesce(label, 'ti') END AS label, CASE WHEN h IS NOT NULL THEN h WHEN k IS NOT NULL THEN k WHEN label IS NOT NULL THEN concat(label, '001') ELSE 'ti' END AS issue_type,
round(CASE WHEN h IS NOT NULL THEN 0.95::DOUBLE WHEN k IS NOT NULL THEN kc ELSE coalesce(sc, 0) END, 6) AS confidence, CASE WHEN h IS NOT NULL THEN 'hash' WHEN k IS NOT NULL THEN 'kb' ELSE 'rule_cold' END AS method,
CASE WHEN h IS NOT NULL OR k IS NOT NULL THEN 'auto' WHEN label IS NULL THEN 'abstain' WHEN sc >= 0.75 THEN 'auto' ELSE 'suggest' END AS action, CASE WHEN h IS NULL AND k IS NULL AND label IS NULL THEN 'no_confident_rule' END AS abstain_reason,
CASE WHEN h IS NOT NULL THEN relevant_item_id END AS relevant_item_id, CASE WHEN h IS NULL THEN mode_id END AS matched_mode_id FROM r""")
def d4(v: Views) -> DataFrame:
    return ladder(v)


@query("k4_best_mode_of_item", "SELECT item_id, arg_max(mode_id, {'s': match_score, 'm': -mode_id}) AS mode_id FROM v_mode_member GROUP BY item_id")
def k4(v: Views) -> DataFrame:
    return v("v_mode_member").groupBy("item_id").agg(F.max_by("mode_id", F.struct("match_score", -F.col("mode_id"))).alias("mode_id"))


@query("g7_fan_out", """
WITH p AS (SELECT s.item_id, i.launch_id, s.error_hash, list_sort(list_distinct(status_codes)) AS codes, list_sort(list_distinct(list_filter(regexp_split_to_array(msg_text, '\\s+'), lambda w: w <> ''))) AS tokens FROM v_signature s JOIN v_item i USING (project_id, item_id)),
r AS (SELECT launch_id, error_hash, min(item_id) AS rep FROM p GROUP BY ALL)
SELECT p.item_id, r.rep, p.codes = x.codes AND p.tokens = x.tokens AS inherits FROM p JOIN r USING (launch_id, error_hash) JOIN p x ON x.item_id = r.rep""")
def g7(v: Views) -> DataFrame:
    """A group's decision goes to the members whose discriminant is the representative's; the others are decided alone."""
    words = F.array_sort(F.array_distinct(F.filter(F.split("msg_text", "\\s+"), lambda w: w != "")))
    named = F.sha2(F.to_json(F.struct(F.array_sort(F.array_distinct("status_codes")), words)), 256)
    p = v("v_signature").select("project_id", "item_id", "error_hash", named.alias("d")).join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    reps = p.groupBy("launch_id", "error_hash").agg(F.min("item_id").alias("rep"), F.min_by("d", "item_id").alias("rep_d"))
    return p.join(reps, ["launch_id", "error_hash"]).select("item_id", "rep", (F.col("d") == F.col("rep_d")).alias("inherits"))
