"""Failure modes from the log of what was done to them.

The log is a table LOG with a row for each step, in order of ``seq`` (unique in a project):

* ``spawn`` makes ``mode_id`` with a status and a label. ``other_id`` names the mode that it was split from, whose label of that time it
  takes if it has none of its own. A split is a spawn and the adds of each part, and a ``retire`` of the mode that was split.
* ``add`` links ``item_id`` with a score and by what it was matched; linked again, the new score and match hold.
* ``merge`` moves the members of ``mode_id`` to ``other_id`` and retires it. An item that is there already keeps how it was matched and
  takes the greater score. A mode can get members again after that and be merged again. A merge with itself does nothing.
* ``status`` sets a status, and a label unless that is null; ``retire`` sets the status retired.

Nothing is replayed step by step. A mode between two merges is a node; each merge is an edge from the node that it ends to the node of the
other mode at that time. Paths over edges are found by pointer jumping, so a chain of n merges takes log2(n) rounds over the table of
merges, and then every add goes down its path at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch

LOG = "project_id long, seq long, op string, mode_id long, other_id long, item_id long, score double, matched_by string, status string, label string"


def _merges(log: DataFrame) -> DataFrame:
    rows = log.where("op = 'merge' AND mode_id <> other_id")
    return rows.select("project_id", "seq", F.col("mode_id").alias("src"), F.col("other_id").alias("dst"))


def _ends(merges: DataFrame) -> DataFrame:
    """(project_id, mode_id, ends): when each mode's nodes end; as many as it was merged away."""
    return merges.groupBy("project_id", F.col("src").alias("mode_id")).agg(F.sort_array(F.collect_list("seq")).alias("ends"))


def _node(rows: DataFrame, ends: DataFrame, mode: str, node: str) -> DataFrame:
    """``rows`` with ``node``: (mode, number of its merges before ``seq``)."""
    before = F.size(F.filter(F.coalesce("ends", F.array().cast("array<long>")), lambda e: e < F.col("seq")))
    return rows.join(ends.withColumnRenamed("mode_id", mode), ["project_id", mode], "left").withColumn(node, F.struct(F.col(mode).alias("mode"), before.alias("nth"))).drop("ends")


def merge_paths(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(project_id, node, path, last) of nodes that end: the nodes that its members come to, as (node, at), and the last of them."""
    merges = _merges(log)
    ends = _ends(merges)
    edges = _node(_node(merges, ends, "src", "node"), ends, "dst", "next")
    paths = scratch.write(edges.select("project_id", "node", F.array(F.struct(F.col("next").alias("node"), F.col("seq").alias("at"))).alias("path"), F.col("next").alias("last")), "paths")
    while True:
        on = paths.select("project_id", F.col("node").alias("last"), F.col("path").alias("more"), F.col("last").alias("end"))
        longer = paths.join(on, ["project_id", "last"], "left")
        paths, before = scratch.write(longer.select("project_id", "node", F.concat("path", F.coalesce("more", F.array().cast(paths.schema["path"].dataType))).alias("path"), F.coalesce("end", "last").alias("last"), F.col("end").isNotNull().alias("grew")), "paths"), paths
        grew = paths.where("grew").limit(1).count()
        paths = paths.select(*before.columns)
        if not grew:
            return paths


def members(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(project_id, mode_id, item_id, score, matched_by) after all of ``log``.

    An add holds unless its item was linked anew with a mode on its way after it had come there. Of the adds that hold the greatest score
    is taken, and the match of that which was first in the last mode; of those that came by one merge, of that which was first in the mode
    before, and so on. Rows without item or mode are left out; an empty log has no members.
    """
    adds = log.where("op = 'add' AND item_id IS NOT NULL AND mode_id IS NOT NULL").select("project_id", "mode_id", "item_id", "seq", "score", "matched_by")
    placed = _node(adds, _ends(_merges(log)), "mode_id", "node")
    # of an item's adds to one node the last holds
    own = scratch.write(placed.groupBy("project_id", "item_id", "node").agg(F.max("seq").alias("seq"), F.max_by(F.struct("score", "matched_by"), "seq").alias("link")), "own")
    paths = merge_paths(log, scratch)
    here = F.struct(F.col("node").alias("node"), F.col("seq").alias("at"))
    ways = own.join(paths, ["project_id", "node"], "left").withColumn("way", F.when(F.col("path").isNull(), F.array(here)).otherwise(F.concat(F.array(here), "path")))
    ways = scratch.write(ways.select("project_id", "item_id", "seq", "link", "way"), "ways")
    # steps on which an add meets a newer one of its item
    steps = ways.where(F.size("way") > 1).select("project_id", "item_id", "seq", F.explode(F.slice("way", F.lit(2), F.size("way") - 1)).alias("s"))
    steps = steps.select("project_id", "item_id", "seq", F.col("s.node").alias("node"), F.col("s.at").alias("at"))
    newer = own.select("project_id", "item_id", "node", F.col("seq").alias("new"))
    lost = steps.join(newer, ["project_id", "item_id", "node"]).where("new > at").select("project_id", "item_id", "seq").distinct()
    kept = ways.join(lost, ["project_id", "item_id", "seq"], "left_anti")
    came = F.reverse(F.transform("way", lambda s: s["at"]))
    kept = kept.select("project_id", F.element_at("way", -1)["node"]["mode"].alias("mode_id"), "item_id", "link", came.alias("came"))
    return kept.groupBy("project_id", "mode_id", "item_id").agg(F.max("link.score").alias("score"), F.min_by("link.matched_by", "came").alias("matched_by"))


def modes(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(project_id, mode_id, status, label) of every mode that was spawned. A mode that was split off takes the label that its ancestors
    had when it, or the one between, was split off; the nearest that had one gives it."""
    steps = log.where("op IN ('spawn', 'status', 'retire') OR op = 'merge' AND mode_id <> other_id")
    status = F.when(F.col("op").isin("retire", "merge"), "retired").otherwise(F.col("status"))
    state = steps.groupBy("project_id", "mode_id").agg(F.max_by(status, "seq").alias("status"), F.max(F.col("op") == "spawn").alias("spawned")).where("spawned").drop("spawned")
    # ancestors by pointer jumping: (ancestor, the time up to which its labels count)
    up = log.where("op = 'spawn' AND other_id IS NOT NULL").select("project_id", "mode_id", F.array(F.struct(F.col("other_id").alias("mode"), F.col("seq").alias("until"))).alias("line"), F.col("other_id").alias("oldest"))
    up = scratch.write(up, "lines")
    while True:
        on = up.select("project_id", F.col("mode_id").alias("oldest"), F.col("line").alias("more"), F.col("oldest").alias("older"))
        longer = up.join(on, ["project_id", "oldest"], "left")
        new = scratch.write(longer.select("project_id", "mode_id", F.concat("line", F.coalesce("more", F.array().cast(up.schema["line"].dataType))).alias("line"), F.coalesce("older", "oldest").alias("oldest"), F.col("older").isNotNull().alias("grew")), "lines")
        grew = new.where("grew").limit(1).count()
        up = new.drop("grew")
        if not grew:
            break
    said = log.where("op IN ('spawn', 'status') AND label IS NOT NULL").select("project_id", F.col("mode_id").alias("ancestor"), F.col("seq").alias("at"), "label")
    own = state.select("project_id", "mode_id", F.col("mode_id").alias("ancestor"), F.lit(0).alias("far"), F.lit(None).cast("long").alias("until"))
    far = up.select("project_id", "mode_id", F.posexplode("line").alias("k", "a")).select("project_id", "mode_id", F.col("a.mode").alias("ancestor"), (F.col("k") + 1).alias("far"), F.col("a.until").alias("until"))
    labels = own.unionByName(far).join(said, ["project_id", "ancestor"]).where("until IS NULL OR at < until")
    labels = labels.groupBy("project_id", "mode_id").agg(F.max_by("label", F.struct(-F.col("far"), F.col("at"))).alias("label"))
    return state.join(labels, ["project_id", "mode_id"], "left")


def purity(found: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, mode_id, members, support, purity) of ``members`` and items (project_id, item_id, issue_type): how many members have a
    label, and the share of the most common one; 0 without labels."""
    rows = found.join(items, ["project_id", "item_id"], "left").groupBy("project_id", "mode_id", "issue_type").agg(F.count("*").alias("n"))
    known = F.when(F.col("issue_type").isNotNull(), F.col("n"))
    rows = rows.groupBy("project_id", "mode_id").agg(F.sum("n").alias("members"), F.coalesce(F.sum(known), F.lit(0)).alias("support"), F.max(known).alias("most"))
    return rows.select("project_id", "mode_id", "members", "support", F.coalesce(F.col("most") / F.nullif("support", F.lit(0)), F.lit(0.0)).alias("purity"))
