"""Retrieval over the domain views. The query set is every item whose id is divisible by 50; the evidence is all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import analyze_boost, suggest_boost
from ..functions.text import jaccard, trigrams
from ..operators.relational import latest, top_k
from ..operators.retrieval import dense_leg, fuse, sparse_leg
from ..operators.vector_index import build_index, comparisons, probes_for, search
from ..sources.views import AS_OF
from .registry import Views, query
from .relational import in_scope

LABELLED = "issue_type IS NOT NULL AND issue_group <> 'ti'"
SOURCES_SQL = "CASE source WHEN 'rp_defect_update' THEN 'rp' WHEN 'human_ui' THEN 'human' WHEN 'early' THEN 'ai_suggested' END"


def provenance(source: Column) -> Column:
    return F.when(source == "rp_defect_update", "rp").when(source == "human_ui", "human").when(source == "early", "ai_suggested")


def salient(row: str = "") -> Column:
    """The names of exceptions, the first 24 words of the message and the status codes, as an array."""
    words = F.slice(F.filter(F.split(row + "msg_text", "[ \\t\\n\\r]+"), lambda w: w != ""), 1, 24)
    names = F.when(F.col(row + "exc_text") == "", F.array().cast("array<string>")).otherwise(F.array(row + "exc_text"))
    return F.concat(names, words, F.transform(row + "status_codes", lambda c: F.concat(F.lit("HTTP_"), c.cast("string"))))


def query_set(v: Views) -> DataFrame:
    """The asking items, with their salient terms as a web query."""
    s = v("v_signature").where("item_id % 50 = 0")
    return s.select(F.col("item_id").alias("query_id"), "project_id", "emb", F.array_join(salient(), " ").alias("terms"), "template_ids", "exc_text", "msg_text", "status_codes", "exception_fp", "error_hash")


def labels(v: Views) -> DataFrame:
    """(item_id, label_source, label_ts) of each item's last label."""
    last = latest(v("v_label_event").withColumn("at", F.col("ts")), ["item_id"], ["ts", "event_id"], ["source", "at"])
    return last.select("item_id", provenance(F.col("source")).alias("label_source"), F.col("at").alias("label_ts"))


def evidence(v: Views, predicate: str = LABELLED) -> DataFrame:
    placed = v("v_item").where(predicate).select("project_id", "item_id", "issue_type", "launch_id", "launch_name", "launch_number", "test_case_hash")
    return v("v_signature").join(placed, ["project_id", "item_id"])


def hybrid(v: Views, items: DataFrame, k: int) -> DataFrame:
    """The k best of both legs for each query, with what is known of them."""
    queries = query_set(v)
    found = fuse(sparse_leg(queries, items), dense_leg(queries, items))
    best = top_k(found, ["query_id"], [F.desc("rrf_score"), F.desc("item_id")], k, "place")
    known = best.join(items.drop("project_id", "emb", "exc_text"), "item_id").join(labels(v), "item_id", "left")
    return known.join(queries.select("query_id", F.col("template_ids").alias("q_t"), F.col("error_hash").alias("q_hash"), F.col("exception_fp").alias("q_fp")), "query_id").withColumn("jaccard_templates", F.round(jaccard(F.col("q_t"), F.col("template_ids")), 6))


COSINE_SQL = "round(list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))), 6)"
JACCARD_SQL = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
TRIGRAMS_SQL = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


SALIENT_SQL = "list_concat(list_concat(CASE WHEN exc_text = '' THEN [] ELSE [exc_text] END, list_slice(list_filter(regexp_split_to_array(msg_text, '[ \\t\\n\\r]+'), lambda w: w <> ''), 1, 24)), list_transform({0}, lambda c: concat('HTTP_', c)))"
LEXEMES_SQL = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}_]+(?:\\.[\\p{{L}}\\p{{N}}_]+)*')"


def hybrid_sql(predicate: str, k: int) -> str:
    """CTEs up to ``best``: (query_id, item_id, sparse_rank, dense_rank, lex_score, cosine, rrf_score, place) and ``known``."""
    return f"""
WITH q AS (SELECT item_id AS query_id, project_id, emb AS q_emb, template_ids AS q_t, msg_text, exc_text, error_hash AS q_hash, exception_fp AS q_fp, status_codes AS q_codes FROM v_signature WHERE item_id % 50 = 0),
qw AS (SELECT query_id, project_id, unnest({SALIENT_SQL.format("q_codes")}) AS word, generate_subscripts({SALIENT_SQL.format("q_codes")}, 1) AS ord FROM q),
qg AS (SELECT query_id, project_id, word, count(*) FILTER (WHERE lower(word) = 'or') OVER (PARTITION BY query_id ORDER BY ord) AS grp FROM qw),
ql AS (SELECT DISTINCT query_id, project_id, grp, starts_with(word, '-') AS barred, unnest({LEXEMES_SQL.format("word")}) AS term FROM qg WHERE lower(word) <> 'or'),
qt AS (SELECT query_id, project_id, grp, term FROM ql WHERE NOT barred),
qn AS (SELECT query_id, grp, count(*) AS n FROM qt GROUP BY query_id, grp),
ev AS (SELECT s.*, i.issue_type, i.launch_id, i.launch_name, i.launch_number, i.test_case_hash FROM v_signature s JOIN v_item i USING (project_id, item_id) WHERE {predicate}),
il AS (SELECT project_id, item_id, {LEXEMES_SQL.format("exc_text")} AS l1, {LEXEMES_SQL.format("concat_ws(' ', msg_text, array_to_string(list_transform(status_codes, lambda c: concat('HTTP_', c)), ' '))")} AS l2, {LEXEMES_SQL.format("frames_text")} AS l3, {LEXEMES_SQL.format("tmpl_text")} AS l4 FROM ev),
iu AS (SELECT project_id, item_id, unnest(list_concat(list_concat(l1, l2), list_concat(l3, l4))) AS term, unnest(range(1, len(l1) + len(l2) + len(l3) + len(l4) + 1)) AS ord, len(l1) AS n1, len(l1) + len(l2) AS n2, len(l1) + len(l2) + len(l3) AS n3 FROM il),
iw AS (SELECT project_id, item_id, term, least(ord, 16383) AS pos, CASE WHEN ord <= n1 THEN 1.0 WHEN ord <= n2 THEN 0.4 WHEN ord <= n3 THEN 0.2 ELSE 0.1 END::DOUBLE AS weight FROM iu QUALIFY row_number() OVER (PARTITION BY project_id, item_id, term ORDER BY ord) <= 255),
mt AS (SELECT query_id, grp, item_id, qt.project_id FROM qt JOIN iw USING (project_id, term) JOIN qn USING (query_id, grp) WHERE query_id <> item_id GROUP BY query_id, grp, item_id, qt.project_id, n HAVING count(DISTINCT term) = n),
mg AS (SELECT mt.* FROM mt WHERE NOT EXISTS (SELECT 1 FROM ql JOIN iw USING (project_id, term) WHERE ql.barred AND ql.query_id = mt.query_id AND ql.grp = mt.grp AND iw.item_id = mt.item_id)),
en AS (SELECT DISTINCT mg.query_id, mg.item_id, pos, weight, iw.term FROM (SELECT DISTINCT query_id, item_id, project_id FROM mg) mg JOIN qt ON qt.query_id = mg.query_id JOIN iw ON iw.item_id = mg.item_id AND iw.term = qt.term AND iw.project_id = mg.project_id),
ge AS (SELECT mg.query_id, mg.grp, mg.item_id, en.pos, en.term FROM mg JOIN qt ON qt.query_id = mg.query_id AND qt.grp = mg.grp JOIN en ON en.query_id = mg.query_id AND en.item_id = mg.item_id AND en.term = qt.term),
la AS (SELECT e.query_id, e.grp, e.item_id, e.pos, o.term, max(o.pos) AS last FROM ge e JOIN ge o ON o.query_id = e.query_id AND o.grp = e.grp AND o.item_id = e.item_id AND o.pos <= e.pos GROUP BY ALL),
sp0 AS (SELECT query_id, grp, item_id, pos AS z, min(last) AS a FROM la JOIN qn USING (query_id, grp) GROUP BY query_id, grp, item_id, pos, n HAVING count(*) = n),
sp1 AS (SELECT DISTINCT query_id, item_id, a, z FROM (SELECT query_id, grp, item_id, a, min(z) AS z FROM sp0 GROUP BY query_id, grp, item_id, a)),
cv AS (SELECT * FROM sp1 x WHERE NOT EXISTS (SELECT 1 FROM sp1 y WHERE y.query_id = x.query_id AND y.item_id = x.item_id AND y.a >= x.a AND y.z <= x.z AND (y.a > x.a OR y.z < x.z))),
cd AS (SELECT cv.query_id, cv.item_id, count(*) / sum(1 / weight) / (1 + CASE WHEN z - a - count(*) + 1 < 0 THEN (count(*) - 1) // 2 ELSE z - a - count(*) + 1 END) AS part FROM cv JOIN en ON en.query_id = cv.query_id AND en.item_id = cv.item_id AND en.pos BETWEEN a AND z GROUP BY cv.query_id, cv.item_id, a, z),
lx AS (SELECT query_id, item_id, round(sum(part), 6) AS lex_score FROM cd GROUP BY query_id, item_id HAVING round(sum(part), 6) > 0),
tq AS (SELECT query_id, project_id, {TRIGRAMS_SQL.format("exc_text")} AS a FROM q WHERE exc_text <> '' AND query_id NOT IN (SELECT query_id FROM lx)),
ti AS (SELECT project_id, item_id, {TRIGRAMS_SQL.format("exc_text")} AS b FROM ev WHERE exc_text <> ''),
tg AS (SELECT query_id, item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS lex_score FROM tq JOIN ti USING (project_id) WHERE query_id <> item_id AND lex_score >= 0.3),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex_score DESC, item_id DESC) AS sparse_rank FROM (SELECT * FROM lx UNION ALL SELECT * FROM tg) QUALIFY sparse_rank <= 50),
dc AS (SELECT query_id, item_id, {COSINE_SQL.format("q_emb", "emb")} AS cosine FROM q JOIN ev USING (project_id) WHERE query_id <> item_id),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id DESC) AS dense_rank FROM dc QUALIFY dense_rank <= 50),
fu AS (SELECT query_id, item_id, sparse_rank, dense_rank, lex_score, cosine, round(coalesce(1.0 / (60 + sparse_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 9) AS rrf_score FROM sp FULL JOIN de USING (query_id, item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id DESC) AS place FROM fu QUALIFY place <= {k}),
lb AS (SELECT item_id, {SOURCES_SQL} AS label_source, ts AS label_ts FROM v_label_event QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1),
known AS (SELECT b.*, ev.issue_type, ev.launch_id, ev.launch_name, ev.launch_number, ev.test_case_hash, ev.error_hash, ev.exception_fp, ev.msg_text, q.q_hash, q.q_fp, lb.label_source, lb.label_ts, round({JACCARD_SQL.format("q_t", "template_ids")}, 6) AS jaccard_templates
  FROM best b JOIN ev USING (item_id) JOIN q USING (query_id) LEFT JOIN lb USING (item_id))"""


@query("r1_hybrid_rrf", hybrid_sql(LABELLED, 20) + " SELECT query_id, item_id, CAST(sparse_rank AS INTEGER) AS sparse_rank, CAST(dense_rank AS INTEGER) AS dense_rank, lex_score, cosine, rrf_score, issue_type, label_source, jaccard_templates FROM known")
def r1(v: Views) -> DataFrame:
    """Lexical (or trigram) and dense top 50 of labelled history for each query item, fused, with evidence; the 20 best."""
    return hybrid(v, evidence(v), 20).select("query_id", "item_id", "sparse_rank", "dense_rank", "lex_score", "cosine", "rrf_score", "issue_type", "label_source", "jaccard_templates")


TI = "issue_group = 'ti' AND launch_id % 2 = 0"


@query("r2_ti_search", hybrid_sql(TI, 20) + " SELECT query_id, item_id, lex_score, cosine, rrf_score FROM known WHERE coalesce(cosine, 0) >= 0.75 OR coalesce(lex_score, 0) > 0")
def r2(v: Views) -> DataFrame:
    """Like failures that wait for a label, in the allowed launches (the even ones), that pass the search gate."""
    found = hybrid(v, evidence(v, TI), 20)
    return found.where("coalesce(cosine, 0) >= 0.75 OR coalesce(lex_score, 0) > 0").select("query_id", "item_id", "lex_score", "cosine", "rrf_score")


@query("r4_trigram_fallback", f"""
WITH q AS (SELECT item_id AS query_id, project_id, {TRIGRAMS_SQL.format("exc_text")} AS a FROM v_signature WHERE item_id % 50 = 0 AND exc_text <> ''), i AS (SELECT item_id, project_id, {TRIGRAMS_SQL.format("exc_text")} AS b FROM v_signature WHERE exc_text <> '')
SELECT query_id, item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS lex_score FROM q JOIN i USING (project_id) WHERE query_id <> item_id AND lex_score >= 0.3""")
def r4(v: Views) -> DataFrame:
    from ..operators.retrieval import trigram_hits

    return trigram_hits(query_set(v), v("v_signature"))


@query("r5_dense_top", f"""
WITH q AS (SELECT item_id AS query_id, project_id, emb AS q FROM v_signature WHERE item_id % 50 = 0), c AS (SELECT query_id, item_id, {COSINE_SQL.format("q", "emb")} AS cosine FROM q JOIN v_signature USING (project_id) WHERE query_id <> item_id)
SELECT query_id, item_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id DESC) AS INTEGER) AS dense_rank FROM c QUALIFY dense_rank <= 50""")
def r5(v: Views) -> DataFrame:
    return dense_leg(query_set(v), v("v_signature").select("project_id", "item_id", "emb"))


@query("r5_dense_probes", python=True)
def r5_probes(v: Views) -> DataFrame:
    """What asking the nearest lists alone finds: of each query's 50 nearest how many, and with how many vectors it is compared."""
    queries = query_set(v)
    index = build_index(v("v_signature").select("project_id", "item_id", "emb"))
    exact = search(index, queries).select("query_id", "item_id")
    probes = probes_for(index, queries)
    found = search(index, queries, probes=probes, exact=False).select("query_id", "item_id")
    recall = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return recall.join(comparisons(index, queries, probes), "query_id")


@query("r9_exact_hash", "SELECT a.item_id, b.item_id AS match_id FROM v_signature a JOIN v_signature b USING (project_id, error_hash) WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id DESC) <= 10")
def r9(v: Views) -> DataFrame:
    s = v("v_signature").select("project_id", "error_hash", "item_id")
    # the eleven newest of each hash, of which the asking item may be one
    heads = top_k(s.withColumnRenamed("item_id", "match_id"), ["project_id", "error_hash"], [F.desc("match_id")], 11)
    pairs = s.where("item_id % 50 = 0").join(heads, ["project_id", "error_hash"]).where("item_id <> match_id").drop("rank")
    return top_k(pairs, ["item_id"], [F.desc("match_id")], 10).select("item_id", "match_id")


# stage C: scope, boosts, evidence. The mode goes round with the query's number.

MODES = ("", "ALL", "LAUNCH_NAME", "CURRENT_AND_THE_SAME_NAME")
_MODE_SQL = "CASE (query_id // 50) % 4 WHEN 0 THEN '' WHEN 1 THEN 'ALL' WHEN 2 THEN 'LAUNCH_NAME' ELSE 'CURRENT_AND_THE_SAME_NAME' END"
_ANALYZE_SQL = "CASE WHEN mode = 'CURRENT_AND_THE_SAME_NAME' THEN CASE WHEN same_launch THEN 1.1 ELSE 1.0 END WHEN mode = '' THEN (CASE WHEN same_name THEN 1.1 ELSE 1.0 END) * (CASE WHEN same_launch THEN 1.1 ELSE 1.0 END) ELSE 1.0 END::DOUBLE"
STAGE_C_SQL = hybrid_sql(LABELLED, 60) + f""",
a AS (SELECT k.*, {_MODE_SQL} AS mode, k.launch_name = qi.launch_name AS same_name, k.launch_id = qi.launch_id AS same_launch, qi.test_case_hash = k.test_case_hash AS same_test_case, q_hash = k.error_hash AS same_error_hash, q_fp = k.exception_fp AS same_exception_fp,
  abs(qi.launch_number - k.launch_number) AS launch_distance FROM known k JOIN v_item qi ON qi.item_id = k.query_id),
b AS (SELECT *, round(rrf_score * ({_ANALYZE_SQL}), 9) AS boosted FROM a WHERE CASE mode WHEN 'ALL' THEN NOT same_launch WHEN 'LAUNCH_NAME' THEN same_name AND NOT same_launch WHEN 'CURRENT_AND_THE_SAME_NAME' THEN same_name ELSE TRUE END),
stage_c AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, item_id DESC) AS place, CASE WHEN label_ts IS NULL THEN 3650.0 ELSE round(greatest(0, epoch(TIMESTAMP '{AS_OF}' - CAST(label_ts AS TIMESTAMP)) / 86400.0), 6) END AS age_days FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, item_id DESC) <= 20)"""


def stage_c(v: Views) -> DataFrame:
    """The 20 best candidates of each query within its scope, with all evidence, in order of ``place``."""
    asking = v("v_item").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("launch_id").alias("q_launch"), F.col("launch_name").alias("q_name"), F.col("launch_number").alias("q_number"), F.col("test_case_hash").alias("q_test"))
    rows = hybrid(v, evidence(v), 60).drop("place").join(asking, "query_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), ((F.floor(F.col("query_id") / 50) % 4) + 1).cast("int"))
    rows = rows.withColumn("mode", mode).where(in_scope(F.col("mode"), F.col("launch_id"), F.col("launch_name"), F.col("q_launch"), F.col("q_name"), F.col("q_launch") - 1))
    boost = analyze_boost(F.col("mode"), F.col("launch_name") == F.col("q_name"), F.col("launch_id") == F.col("q_launch"))
    rows = top_k(rows.withColumn("boosted", F.round(F.col("rrf_score") * boost, 9)), ["query_id"], [F.desc("boosted"), F.desc("item_id")], 20, "place")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("label_ts").cast("timestamp"))) / 86_400_000_000.0)
    return rows.select(
        "query_id", "item_id", "place", "lex_score", "cosine", "rrf_score", "boosted", "jaccard_templates", "issue_type", "label_source", "msg_text", F.when(F.col("label_ts").isNull(), 3650.0).otherwise(F.round(age, 6)).alias("age_days"),
        (F.col("q_test") == F.col("test_case_hash")).alias("same_test_case"), (F.col("q_hash") == F.col("error_hash")).alias("same_error_hash"), (F.col("q_fp") == F.col("exception_fp")).alias("same_exception_fp"),
        F.abs(F.col("q_number") - F.col("launch_number")).alias("launch_distance"),
    )


@query("r13_stage_c", STAGE_C_SQL + " SELECT query_id, item_id, CAST(place AS INTEGER) AS place, boosted, age_days, same_test_case, same_error_hash, same_exception_fp, launch_distance FROM stage_c")
def r13(v: Views) -> DataFrame:
    return stage_c(v).select("query_id", "item_id", "place", "boosted", "age_days", "same_test_case", "same_error_hash", "same_exception_fp", "launch_distance")


_PAIRS_SQL = "SELECT i.item_id, m.mode, i.launch_name = 'nightly-0' AS same_name, i.launch_id = 5 AS same_launch, i.launch_id = 4 AS previous FROM v_item i, (VALUES (''), ('ALL'), ('LAUNCH_NAME'), ('CURRENT_LAUNCH'), ('PREVIOUS_LAUNCH'), ('CURRENT_AND_THE_SAME_NAME')) AS m(mode)"


def _pairs(v: Views) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("", "ALL", "LAUNCH_NAME", "CURRENT_LAUNCH", "PREVIOUS_LAUNCH", "CURRENT_AND_THE_SAME_NAME")])
    return v("v_item").select("item_id", F.explode(modes).alias("mode"), (F.col("launch_name") == "nightly-0").alias("same_name"), (F.col("launch_id") == 5).alias("same_launch"), (F.col("launch_id") == 4).alias("previous"))


@query("r14_analyze_boost", f"WITH p AS ({_PAIRS_SQL}) SELECT item_id, mode, round({_ANALYZE_SQL}, 6) AS boost FROM p")
def r14(v: Views) -> DataFrame:
    """What the history of launch 5, a nightly-0, is multiplied by where it is analysed."""
    return _pairs(v).select("item_id", "mode", F.round(analyze_boost(F.col("mode"), F.col("same_name"), F.col("same_launch")), 6).alias("boost"))


@query("r15_suggest_boost", f"""
WITH p AS ({_PAIRS_SQL}) SELECT item_id, mode, round(CAST(CASE WHEN mode IN ('LAUNCH_NAME', 'ALL') THEN (CASE WHEN same_name THEN 1.1 ELSE 1.0 END) / (CASE WHEN same_launch THEN 1.1 ELSE 1.0 END) WHEN mode = 'PREVIOUS_LAUNCH' THEN CASE WHEN previous THEN 1.1 ELSE 1.0 END
ELSE (CASE WHEN same_name THEN 1.1 ELSE 1.0 END) * (CASE WHEN same_launch THEN 1.1 ELSE 1.0 END) END AS DOUBLE), 6) AS boost FROM p""")
def r15(v: Views) -> DataFrame:
    return _pairs(v).select("item_id", "mode", F.round(suggest_boost(F.col("mode"), F.col("same_name"), F.col("same_launch"), F.col("previous")), 6).alias("boost"))


@query("r16_salient_terms", "SELECT item_id, list_concat(list_concat(CASE WHEN exc_text = '' THEN [] ELSE [exc_text] END, list_slice(list_filter(regexp_split_to_array(msg_text, '[ \\t\\n\\r]+'), lambda w: w <> ''), 1, 24)), list_transform(status_codes, lambda c: concat('HTTP_', c))) AS terms FROM v_signature WHERE item_id % 50 = 0")
def r16(v: Views) -> DataFrame:
    return v("v_signature").where("item_id % 50 = 0").select("item_id", salient().alias("terms"))
