"""Cleaning, masking, signatures, template mining, grouping and streams over the domain views."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chains, cleaning, text
from ..operators.grouping import group_failures, mine_templates, unique_logs
from ..operators.indexing import TABLES, index_batch
from ..sources.published import Published
from ..sources.shared import shared_dir
from ..streaming.history import daily_rollup, flakiness
from ..streaming.miner import PROVIDER, match_templates, mined, trie
from .registry import QUERIES, Views, query


def _column(name: str, f, sql: str | None = None) -> None:
    """A query that applies a column function to every log."""

    def run(v: Views) -> DataFrame:
        return v("v_log").select("item_id", "pos", f(F.col("message")).alias("out"))

    query(name, sql and f"SELECT item_id, pos, {sql} AS out FROM v_log")(run)


def _replaced(pairs: list[tuple[str, str]], start: str = "message") -> str:
    """The same replacements in DuckDB's dialect."""
    for pattern, mark in pairs:
        quoted = pattern.replace("'", "''")
        mark = re.sub(r"\$(\d)", r"\\\1", mark).replace("\n", "' || chr(10) || '")
        start = f"regexp_replace({start}, '{quoted}', '{mark}', 'g')"
    return start


def _removed(patterns: list[str], start: str = "message") -> str:
    return _replaced([(p, "") for p in patterns], start)


_LINES = "string_split(message, chr(10))"
_column("t4_datetime", cleaning.without_datetime, _removed(cleaning.DATETIMES))
_column("t5_level", cleaning.without_level, _removed(cleaning.LEVELS))
_column("t6_thread", cleaning.without_thread, _removed(cleaning.THREAD_IDS + cleaning.THREAD_NAMES))
_column("t7_blank_lines", cleaning.without_blank_lines, f"array_to_string(list_filter({_LINES}, lambda x: regexp_matches(x, '\\S')), chr(10))")
_column("t8_line_endings", lambda c: cleaning.unified_spaces(cleaning.unified_line_endings(c)), _replaced([(f"[{cleaning.BLANKS}]*\\r?\\n", "\n"), (f"[{cleaning.BLANKS}]+", " "), (f"[{cleaning.BLANKS}]*\\n[{cleaning.BLANKS}]*", "\n")]))
_column("t9_unify_ids", cleaning.unified_ids, _replaced(cleaning.IDS))
_column("t10_hex", cleaning.unified_hex, _replaced(cleaning.HEX))
_column("t11_tokens", cleaning.without_tokens, _replaced(cleaning.TOKENS))
_column("t12_url_decoded", cleaning.url_decoded)
_column("t13_generated", cleaning.without_generated)
_column("t14_separators", cleaning.delimited, _replaced(cleaning.SEPARATORS))
_column("t15_driver_info", lambda c: cleaning.removed(cleaning.without_driver_info(c), [cleaning.MARKDOWN]), _removed([*cleaning.DRIVER_INFO, cleaning.MARKDOWN]))
_column("t17_unique_lines", cleaning.unique_lines)
_column("t1_basic", cleaning.basic)
_column("t2_clean", cleaning.clean)
_column("t3_unified", lambda c: cleaning.unified(cleaning.basic(c)))
_column("t18_brackets", cleaning.without_brackets, _removed(["\\[[^\\]]*\\]|\\([^)]*\\)|\\{[^}]*\\}"]))
_column("t19_special", lambda c: cleaning.without_special(cleaning.stacked_colons(c)), _replaced([(cleaning.SPECIAL, " ")], "replace(message, ':', ' : ')"))
_column("t20_remove_numbers", cleaning.without_numbers, _replaced([("\\b\\d+\\b", "SPECIALNUMBER"), ("\\d+", "")]))
_column("t21_first_lines", lambda c: F.substring_index(c, "\n", 2), f"array_to_string(list_slice({_LINES}, 1, 2), chr(10))")
_column("t22_words", cleaning.words)
_column("t24_only_numbers", cleaning.only_numbers)
_column("t26_status_codes", lambda c: F.array_join(cleaning.status_codes(c), " "))
_column("t27_urls", lambda c: cleaning.without_urls(c, cleaning.urls(c)))
_column("t28_paths", lambda c: F.array_join(cleaning.paths(c), "\n"))
_column("t29_quoted", lambda c: F.array_join(cleaning.quoted(c), "\n"))
_column("t30_credentials", lambda c: F.transform(cleaning.urls(c), cleaning.without_credentials))
_column("t31_stack_lines", lambda c: F.size(F.filter(cleaning.lines_of(c), cleaning.stack_line)))
_column("t32_python_log", cleaning.python_log)
_column("t34_description_stack", cleaning.parts)
_column("t37_similarity_tokens", cleaning.similarity_tokens)
_column("t38_cleaned_log", cleaning.cleaned_log)
_column("t40_masks", text.mask)
_column("m9_masked_message", chains.masked_message)


@query("t16_html_text")
def t16(v: Views) -> DataFrame:
    return v("pages").select("page_id", cleaning.without_html(F.col("html")).alias("body"))


@query("t25_exceptions")
def t25(v: Views) -> DataFrame:
    return v("v_signature").select("item_id", cleaning.exceptions(F.concat_ws(" ", "exc_text", "msg_text")).alias("found"))


# signatures


def signed_logs(v: Views) -> DataFrame:
    """Every error log's normalised text and if it has a stack, with the item's text and a stack made up for every third item."""
    logs = v("v_log").where("log_level >= 40000").select("item_id", "pos", "message")
    s = v("v_signature").select("item_id", "exc_text")
    stack = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("\n\tat org.shop.Cart$1.total(Cart.java:7)\n\tat org.junit.Run.go(Run.java:1)\n\tat app.Main.run(Main.java:"), F.col("item_id").cast("string"), F.lit(")"))).otherwise("")
    whole = F.concat(F.coalesce("exc_text", F.lit("")), F.lit(": "), F.col("message"), stack)
    rows = logs.join(s, "item_id", "left").select("item_id", "pos", cleaning.normalized(whole).alias("text"))
    return rows.withColumn("has_stack", cleaning.has_stack(F.col("text")))


def signatures(v: Views) -> DataFrame:
    """(item_id, classes, frames, msg_text, templates, codes, has_stack, is_assertion, document) of every item, from its primary
    log: the last one with a stack, else the last. Only that log of an item is kept, by an aggregate."""
    primary = signed_logs(v).groupBy("item_id").agg(F.max_by("text", F.struct("has_stack", "pos")).alias("text")).select("item_id", cleaning.record(F.col("text")).alias("log"))
    templates = v("v_signature").select("item_id", F.col("template_ids").cast("array<string>").alias("templates"))
    rows = primary.join(templates, "item_id", "left").withColumn("templates", F.coalesce("templates", F.array().cast("array<string>")))
    made = rows.select("item_id", "templates", chains.exception_chain(F.col("log.exceptions"), F.col("log.unified")).alias("classes"), chains.frames(F.col("log.stack_raw")).alias("frames"), chains.masked_message(F.col("log.msg")).alias("msg_text"), F.col("log.status_codes").alias("codes"), F.col("log.has_stacktrace").alias("has_stack"), chains.is_assertion(F.col("log.msg")).alias("is_assertion"))
    return made.withColumn("document", chains.document(F.concat(F.lit("test "), F.col("item_id").cast("string")), F.col("classes"), F.col("msg_text"), F.col("frames"), F.col("templates"), F.col("codes")))


def raw_rows(v: Views) -> DataFrame:
    """What an index run takes: every item with its logs, or with none."""
    logs = v("v_log").select("item_id", "pos", "log_level", "message")
    rows = v("v_item").join(v("v_signature").select("item_id", "exc_text"), "item_id").join(logs, "item_id", "left")
    log_time = F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("pos").cast("int"))
    return rows.select("project_id", "launch_id", "launch_name", "item_id", F.col("test_case_hash").cast("long").alias("test_case_hash"), F.concat(F.lit(" "), F.upper("issue_type")).alias("issue_type"), "start_time", (F.col("item_id") * 1000 + F.col("pos")).alias("log_id"), "log_level", log_time.alias("log_time"), F.concat("exc_text", F.lit(": "), "message").alias("message"))


def indexed(v: Views, table: str) -> DataFrame:
    """A table that an index run publishes; the run is made twice, of which the second does nothing."""
    rows = raw_rows(v)
    published = Published(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/published-{uuid.uuid4().hex}", TABLES)
    for _ in range(2):
        index_batch(rows, published, "first")
    return published.read(table)


@query("s5_published_items", """
WITH l AS (SELECT item_id, min(pos) FILTER (WHERE log_level >= 40000) AS first_error, max(pos) AS last_pos FROM v_log GROUP BY item_id)
SELECT project_id, i.item_id, launch_id, nullif(test_case_hash, 0)::BIGINT AS test_case_hash, issue_type, i.item_id * 1000 + first_error AS error_log_id, start_time + last_pos * INTERVAL '1' SECOND AS last_log, coalesce(start_time + last_pos * INTERVAL '1' SECOND, start_time) AS seen_at FROM v_item i LEFT JOIN l USING (item_id)""", python=True)
def s5_items(v: Views) -> DataFrame:
    return indexed(v, "items").select("project_id", "item_id", "launch_id", "test_case_hash", "issue_type", "error_log_id", "last_log", "seen_at")


@query("s5_published_signatures", python=True)
def s5_signatures(v: Views) -> DataFrame:
    return indexed(v, "signatures")


@query("m12_primary_log")
def m12(v: Views) -> DataFrame:
    return signed_logs(v).groupBy("item_id").agg(F.max_by("pos", F.struct("has_stack", "pos")).alias("pos"))


@query("m13_item_signatures", python=True)
def m13(v: Views) -> DataFrame:
    rows = signatures(v).withColumn("exception_fp", F.coalesce(chains.xxh3(chains.fingerprint_text(F.col("classes"), F.col("frames"))), F.lit(0).cast("long")))
    return rows.withColumn("error_hash", chains.xxh3(chains.error_hash_text(F.col("exception_fp"), F.col("templates"))))


@query("m11_documents")
def m11(v: Views) -> DataFrame:
    return signatures(v).select("item_id", "document")


@query("m10_context")
def m10(v: Views) -> DataFrame:
    """The warnings before an item's first error, folded into its message."""
    logs = v("v_log").select("item_id", "pos", "log_level", "message")
    first = logs.where("log_level >= 40000").groupBy("item_id").agg(F.min("pos").alias("first_error"))
    before = logs.where("log_level >= 30000 AND log_level < 40000").join(first, "item_id").where("pos < first_error")
    from ..operators.relational import top_k

    last = top_k(before, ["item_id"], [F.desc("pos")], chains.CONTEXT_LINES)
    return last.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "message"))).alias("m")).select("item_id", chains.folded_context(F.col("m.message")).alias("context"))


@query("m15_canonical_identity", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN -1 ELSE error_hash END AS error_hash, item_id % 4 = 0 AS stored FROM v_signature")
def m15(v: Views) -> DataFrame:
    """A stored identity (every fourth item's) wins over what is computed again."""
    stored = v("v_signature").where("item_id % 4 = 0").select("item_id", F.lit(-1).cast("long").alias("kept"))
    return v("v_signature").select("item_id", "error_hash").join(stored, "item_id", "left").select("item_id", F.coalesce("kept", "error_hash").alias("error_hash"), F.col("kept").isNotNull().alias("stored"))


@query("m16_discriminants", "SELECT item_id, error_hash, list_sort(list_distinct(status_codes)) AS codes, list_sort(list_distinct(list_filter(regexp_split_to_array(msg_text, '[ \\t\\n\\r]+'), lambda w: w <> ''))) AS tokens FROM v_signature")
def m16(v: Views) -> DataFrame:
    words = F.array_sort(F.array_distinct(F.filter(F.split("msg_text", "[ \\t\\n\\r]+"), lambda w: w != "")))
    return v("v_signature").select("item_id", "error_hash", F.array_sort(F.array_distinct("status_codes")).alias("codes"), words.alias("tokens"))


@query("m14_template_text", "WITH p AS (SELECT item_id, unnest(template_ids) AS template_id, unnest(range(len(template_ids))) AS pos FROM v_signature), t AS (SELECT template_id, min(pattern) AS pattern FROM v_template GROUP BY template_id) SELECT item_id, string_agg(pattern, ' ' ORDER BY pos) AS tmpl_text FROM p JOIN t USING (template_id) GROUP BY item_id")
def m14(v: Views) -> DataFrame:
    parts = v("v_signature").select("item_id", F.posexplode("template_ids").alias("pos", "template_id"))
    patterns = v("v_template").groupBy("template_id").agg(F.min("pattern").alias("pattern"))
    found = parts.join(patterns, "template_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "pattern"))).alias("p"))
    return found.select("item_id", F.array_join(F.col("p.pattern"), " ").alias("tmpl_text"))


# hashes


@query("h1_xxh3", python=True)
def h1(v: Views) -> DataFrame:
    signed = chains.xxh3(F.col("msg_text"))
    rows = v("v_signature").select("item_id", signed.alias("signed"))
    return rows.select("item_id", "signed", F.when(F.col("signed") < 0, F.col("signed").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("signed").cast("decimal(20,0)")).cast("string").alias("unsigned"))


@query("h2_error_hash", "SELECT item_id, md5(concat(exc_text, '#')) AS exception_fp, md5(concat(md5(concat(exc_text, '#')), '#', array_to_string(template_ids, '|'))) AS error_hash FROM v_signature WHERE exc_text <> ''")
def h2(v: Views) -> DataFrame:
    """The texts that are hashed, named here by a digest that SQL has too."""
    print_ = F.md5(chains.fingerprint_text(F.array("exc_text"), F.array().cast("array<string>")).cast("binary"))
    rows = v("v_signature").where("exc_text <> ''").select("item_id", print_.alias("exception_fp"), "template_ids")
    return rows.select("item_id", "exception_fp", F.md5(chains.error_hash_text(F.col("exception_fp"), F.col("template_ids").cast("array<string>")).cast("binary")).alias("error_hash"))


@query("h4_template_hash", python=True)
def h4(v: Views) -> DataFrame:
    signed = chains.xxh3(F.col("pattern"))
    return v("v_template").select("pattern").distinct().select("pattern", signed.alias("template_id")).select("pattern", "template_id", F.lpad(F.lower(F.hex("template_id")), 16, "0").alias("template_hash"))


@query("h5_cluster_ids", python=True)
def h5(v: Views) -> DataFrame:
    placed = v("v_signature").select("project_id", "item_id", "error_hash").join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    return placed.select("item_id", chains.xxh3(F.concat_ws(":", "project_id", "launch_id", "error_hash")).alias("h")).select("item_id", chains.cluster_id(F.col("h")).alias("cluster_id"))


@query("h6_template_sets", "SELECT item_id, md5(concat(exception_fp, '#', array_to_string(list_sort(template_ids), ','))) AS template_set FROM v_signature")
def h6(v: Views) -> DataFrame:
    return v("v_signature").select("item_id", F.md5(chains.template_set_text(F.col("exception_fp"), F.col("template_ids")).cast("binary")).alias("template_set"))


@query("h7_prompt_keys", "SELECT event_id, sha256(concat(role, chr(10), project_id, chr(10), item_id)) AS cache_key FROM v_llm_event")
def h7(v: Views) -> DataFrame:
    return v("v_llm_event").select("event_id", F.sha2(F.concat_ws("\n", "role", "project_id", "item_id"), 256).alias("cache_key"))


# mining and grouping


@query("m1_templates", python=True)
def m1(v: Views) -> DataFrame:
    return mine_templates(error_lines(v), "project_id", ["item_id", "pos", "line"], "line")


def error_lines(v: Views) -> DataFrame:
    """(project_id, item_id, pos, line): the first masked lines of logs that are no stack."""
    lines = v("v_log").select((F.col("item_id") % 8).alias("project_id"), "item_id", "pos", F.explode(F.slice(F.split(text.mask(F.col("message")), "\n"), 1, 40)).alias("line"))
    return lines.where(~cleaning.stack_line(F.col("line")))


@query("m2_template_matches", python=True)
def m2(v: Views) -> DataFrame:
    """The warnings' lines with the templates that the errors' lines were mined to."""
    errors = error_lines(lambda name: v(name).where("log_level >= 40000"))
    mined_ = mine_templates(errors, "project_id", ["item_id", "pos", "line"], "line").groupBy("project_id", "template").agg(F.sum("n").alias("n"))
    lines = error_lines(lambda name: v(name).where("log_level < 40000"))
    return match_templates(lines, trie(mined_))


@query("g1_launch_groups", python=True)
def g1(v: Views) -> DataFrame:
    items = v("v_signature").select("project_id", "item_id", "exception_fp", "emb", "template_ids").join(v("v_item").select("project_id", "item_id", "launch_id"), ["project_id", "item_id"])
    return group_failures(items)


@query("f2_near_duplicate_logs", python=True)
def f2(v: Views) -> DataFrame:
    return unique_logs(v("v_log"))


# streams


def _streamed(run, mode: str, last, settings: dict[str, str] | None = None):
    """A query that sends a table of events through a stream and returns what the stream has told. Each batch is written under its
    number in the shared folder, so a batch that is repeated replaces itself; the stream's state is kept there too."""

    def go(spark, sf_dir: str) -> DataFrame:
        from ..shipping import ship

        ship(spark)
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
        home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        told = run(source)
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{home}/out/epoch={epoch}")
        before = {k: spark.conf.get(k, None) for k in settings or {}}
        try:
            for k, x in (settings or {}).items():
                spark.conf.set(k, x)
            told.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, x in before.items():
                spark.conf.unset(k) if x is None else spark.conf.set(k, x)
        names = told.columns
        return last(spark.read.schema(T.StructType(told.schema.fields).add("epoch", "long")).parquet(f"{home}/out")).select(*names)

    return go


def _x2(source: DataFrame) -> DataFrame:
    return flakiness(source.select(F.col("user_id").alias("test_case_hash"), "event_id", (F.col("event_type") == "error").alias("failed"), "ts"))


def _last_of_test(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test_case_hash").agg(F.max_by(F.struct(*rows.columns), F.struct("runs", "epoch")).alias("r")).select("r.*")


def _last_of_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "event_type").agg(F.max_by(F.struct(*rows.columns), "epoch").alias("r")).select("r.*")


def _x1(source: DataFrame) -> DataFrame:
    said = F.regexp_replace("props", "[^A-Za-z0-9.]+", " ")
    return mined(source.select((F.col("user_id") % 8).alias("project_id"), F.col("event_id").alias("at"), F.concat_ws(" ", "event_type", said, F.col("value").cast("string")).alias("line")))


def _last_of_cluster(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "cluster").agg(F.max_by(F.struct(*rows.columns), F.struct("version", "epoch")).alias("r")).select("r.*")


QUERIES["x1_mined_stream"] = _streamed(_x1, "update", _last_of_cluster, dict([PROVIDER]))
QUERIES["x2_flakiness_stream"] = _streamed(_x2, "update", _last_of_test)
QUERIES["x4_daily_stream"] = _streamed(daily_rollup, "update", _last_of_day)
