"""The index run: from the raw logs of a batch of launches to published items and signatures.

Everything between is one plan over the batch: logs are put in order and cleaned, templates are mined from the errors' lines, the
primary log of an item gives its exceptions, frames and message, and those give its identity. A project whose rows can't be taken
is left out with its reason, and the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chains, cleaning
from ..functions.text import mask
from ..shipping import ship
from ..sources.published import Published
from ..sources.shared import Scratch
from ..streaming.miner import match_templates, trie
from .grouping import mine_templates
from .relational import upsert

RAW = "project_id long, launch_id long, launch_name string, item_id long, test_case_hash long, issue_type string, start_time timestamp, log_id long, log_level int, log_time timestamp, message string"
TABLES = {
    "items": ("project_id long, item_id long, launch_id long, launch_name string, test_case_hash long, issue_type string, start_time timestamp, error_log_id long, last_log timestamp, seen_at timestamp", ["project_id", "item_id"]),
    "signatures": ("project_id long, item_id long, error_log_id long, exceptions array<string>, frames array<string>, msg_text string, templates array<string>, codes array<string>, exception_fp long, error_hash long", ["project_id", "item_id"]),
    "templates": ("project_id long, template_hash string, template string, n long", ["project_id", "template_hash"]),
    "history": ("project_id long, test_case_hash long, runs long, failures long, last_seen timestamp", ["project_id", "test_case_hash"]),
    "found": ("project_id long, log_id long, exceptions array<string>", ["project_id", "log_id"]),
    "status": ("project_id long, change string, failed boolean, reason string, items long", ["project_id"]),
}
ERROR, LINES = 40_000, 40


@dataclass
class Run:
    """Whether the batch was published now, and its (project_id, failed, reason, items)."""

    published: bool
    status: DataFrame


def faults(raw: DataFrame) -> DataFrame:
    """(project_id, reason) of projects with a row that can't be taken: no item, a log without a level, or an item of two launches."""
    row = F.when(F.col("item_id").isNull(), "a row names no item").when(F.col("log_id").isNotNull() & F.col("log_level").isNull(), "a log has no level").when(F.col("launch_id").isNull(), "an item has no launch")
    rows = raw.select("project_id", row.alias("reason")).where("reason IS NOT NULL")
    spread = raw.where("item_id IS NOT NULL").groupBy("project_id", "item_id").agg(F.min("launch_id").alias("a"), F.max("launch_id").alias("b")).where("a <> b").select("project_id", F.lit("an item is in two launches").alias("reason"))
    return rows.union(spread).groupBy("project_id").agg(F.min("reason").alias("reason"))


def projected(raw: DataFrame) -> DataFrame:
    """The items: issue type trimmed, lowered and null where empty, test 0 null, the first error's log, the last log's time, and when
    the item counts as seen: at its last log, else at its start, else null."""
    failed = (F.col("log_level") >= ERROR) & (F.trim(F.coalesce("message", F.lit(""))) != "")
    first = lambda c: F.max_by(c, F.struct("start_time", "log_id")).alias(c)  # noqa: E731  (an item's rows agree on it)
    rows = raw.groupBy("project_id", "item_id").agg(*[first(c) for c in ("launch_id", "launch_name", "test_case_hash", "issue_type", "start_time")], F.min_by(F.when(failed, F.col("log_id")), F.when(failed, F.struct("log_time", "log_id"))).alias("error_log_id"), F.max("log_time").alias("last_log"))
    return rows.select("project_id", "item_id", "launch_id", "launch_name", F.nullif("test_case_hash", F.lit(0)).alias("test_case_hash"), F.nullif(F.lower(F.trim("issue_type")), F.lit("")).alias("issue_type"), "start_time", "error_log_id", "last_log", F.coalesce("last_log", "start_time").alias("seen_at"))


def index_batch(raw: DataFrame, published: Published, change: str) -> Run:
    """Indexes RAW rows and publishes the outcome as ``change``; the same change again does nothing.

    Logs of one item are taken by time and id, whatever order they come in. A row with a null log is an item without logs. Errors are
    logs of level 40,000 and above with a message. A repeated row counts once. A signature keeps the log it was found in where the new
    one names none; a test's history counts each item of the batch once as a failed run.
    """
    spark = raw.sparkSession
    ship(spark)
    space = Scratch(spark, "index-run")
    rows = space.write(raw.select(*[c.split()[0] for c in RAW.split(", ")]).distinct(), "rows")
    bad = space.write(faults(rows), "faults")
    good = rows.join(bad.select("project_id"), "project_id", "left_anti").where("project_id IS NOT NULL")
    items = space.write(projected(good), "items")
    errors = good.where(F.col("log_id").isNotNull() & (F.col("log_level") >= ERROR) & (F.trim(F.coalesce("message", F.lit(""))) != ""))
    logs = errors.select("project_id", "item_id", "log_time", "log_id", cleaning.cleaned_log(F.col("message")).alias("log"))
    logs = space.write(logs, "logs")
    lines = logs.select("project_id", "item_id", "log_time", "log_id", F.posexplode(F.slice(F.split(mask(F.col("log.msg")), "\n"), 1, LINES)).alias("place", "line"))
    lines = lines.where(~cleaning.stack_line(F.col("line")) & (F.trim("line") != ""))
    mined = mine_templates(lines, "project_id", ["log_time", "log_id", "place", "line"], "line").groupBy("project_id", "template", "template_hash").agg(F.sum("n").alias("n"))
    mined = space.write(mined, "templates")
    placed = match_templates(lines.select("project_id", "item_id", "log_time", "log_id", "place", "line"), trie(mined)).where("template IS NOT NULL")
    order = F.struct("log_time", "log_id", "place")
    firsts = placed.groupBy("project_id", "item_id", "template").agg(F.min(order).alias("at"))
    templates = firsts.groupBy("project_id", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "template"))), lambda t: F.md5(t["template"].cast("binary"))).alias("templates"))
    primary = logs.groupBy("project_id", "item_id").agg(F.max_by(F.struct("log", "log_id"), F.struct(F.col("log.has_stacktrace"), "log_time", "log_id")).alias("p"))
    signed = primary.join(templates, ["project_id", "item_id"], "left").select("project_id", "item_id", F.col("p.log_id").alias("error_log_id"), chains.exception_chain(F.col("p.log.exceptions"), F.col("p.log.unified")).alias("exceptions"), chains.frames(F.col("p.log.stack_raw")).alias("frames"), chains.masked_message(F.col("p.log.msg")).alias("msg_text"), F.coalesce("templates", F.array().cast("array<string>")).alias("templates"), F.col("p.log.status_codes").alias("codes"))
    signed = signed.withColumn("exception_fp", F.coalesce(chains.xxh3(chains.fingerprint_text(F.col("exceptions"), F.col("frames"))), F.lit(0).cast("long")))
    signed = signed.withColumn("error_hash", chains.xxh3(chains.error_hash_text(F.col("exception_fp"), F.col("templates"))))
    history = items.where("test_case_hash IS NOT NULL").groupBy("project_id", "test_case_hash").agg(F.count("*").alias("runs"), F.count("*").alias("failures"), F.max("seen_at").alias("last_seen"))
    counts = items.groupBy("project_id").agg(F.count("*").alias("items"))
    status = rows.select("project_id").distinct().join(bad, "project_id", "left").join(counts, "project_id", "left")
    status = status.where("project_id IS NOT NULL").select("project_id", F.lit(change).alias("change"), F.col("reason").isNotNull().alias("failed"), "reason", F.coalesce("items", F.lit(0)).cast("long").alias("items"))
    new = {"items": items, "signatures": signed, "templates": mined.select("project_id", "template_hash", "template", "n"), "history": history, "found": logs.select("project_id", "log_id", F.col("log.exceptions").alias("exceptions")), "status": status}
    done = published.apply(change, new, {"signatures": lambda old, fresh: upsert(old, fresh, ["project_id", "item_id"], ("error_log_id",)), "templates": _added("n", TABLES["templates"][1]), "history": _counted})
    if done:
        status = published.read("status")
    space.remove(*space.paths)
    return Run(done, published.read("status") if done else published.read("status").where(F.col("change") == change))


def _added(count: str, keys: list[str]):
    """A merge that adds up a count; of the other columns the new row's stay."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
        rest = [c for c in old.columns if c not in (*keys, count)]
        return both.groupBy(*keys).agg(F.sum(count).alias(count), *[F.max_by(c, "side").alias(c) for c in rest])

    return merge


def _counted(old: DataFrame, new: DataFrame) -> DataFrame:
    latest: Column = F.max("last_seen").alias("last_seen")
    return old.unionByName(new).groupBy("project_id", "test_case_hash").agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"), latest)
