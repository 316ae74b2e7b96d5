"""What a batch of defect updates changes: labels of items, the log of labels, purity of modes, outcomes of suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_group
from .relational import latest

SOURCE = "rp_defect_update"


@dataclass
class Effects:
    """Tables as they are to be written: ``items`` (project_id, item_id, issue_type) that get another label, ``events`` (project_id,
    item_id, old_label, new_label, source) to append, ``unknown`` (project_id, item_id) to reply with, ``purity`` (project_id, mode_id,
    labelled, purity) of the modes that hold a relabelled item, ``outcomes`` (suggestion_id, outcome) that are settled."""

    items: DataFrame
    events: DataFrame
    unknown: DataFrame
    purity: DataFrame
    outcomes: DataFrame


def feedback(updates: DataFrame, items: DataFrame, members: DataFrame, suggestions: DataFrame) -> Effects:
    """``updates`` (project_id, item_id, issue_type, at) are taken in order of ``at``, then of the label.

    Labels are trimmed and lowered. An item that isn't in ``items`` (project_id, item_id, issue_type) changes nothing and is told
    back. Each update of a known item is an event whose old label is what the one before it left; the last one is the item's label.
    Purity is the largest label's share of a mode's labelled ``members`` (project_id, mode_id, item_id) after that. A pending one of
    ``suggestions`` (suggestion_id, project_id, item_id, predicted_label, outcome) is accepted if the last label is of its group.
    """
    label = F.lower(F.trim(F.coalesce("issue_type", F.lit(""))))
    asked = updates.select("project_id", "item_id", label.alias("new_label"), "at")
    stored = items.select("project_id", "item_id", F.col("issue_type").alias("stored"))
    known = asked.join(stored, ["project_id", "item_id"])
    unknown = asked.select("project_id", "item_id").distinct().join(stored, ["project_id", "item_id"], "left_anti")
    # the label before each update, in one pass over an item's updates
    order = Window.partitionBy("project_id", "item_id").orderBy("at", "new_label")
    events = known.select("project_id", "item_id", F.coalesce(F.lag("new_label").over(order), F.col("stored")).alias("old_label"), "new_label", F.lit(SOURCE).alias("source"), "at")
    last = latest(known.withColumn("issue_type", F.col("new_label")), ["project_id", "item_id"], ["at", "new_label"], ["issue_type"])
    touched = members.join(last.select("project_id", "item_id"), ["project_id", "item_id"], "left_semi").select("project_id", "mode_id").distinct()
    now = stored.join(last, ["project_id", "item_id"], "left").select("project_id", "item_id", F.nullif(F.coalesce("issue_type", "stored"), F.lit("")).alias("label")).where("label IS NOT NULL")
    counts = members.join(touched, ["project_id", "mode_id"]).join(now, ["project_id", "item_id"]).groupBy("project_id", "mode_id", "label").agg(F.count("*").alias("n"))
    purity = counts.groupBy("project_id", "mode_id").agg(F.sum("n").alias("labelled"), (F.max("n") / F.sum("n")).alias("purity"))
    settled = suggestions.where("outcome = 'pending'").join(last, ["project_id", "item_id"])
    same = base_group(F.col("predicted_label")) == base_group(F.col("issue_type"))
    outcomes = settled.select("suggestion_id", F.when(F.coalesce(same, F.lit(False)), "accepted").otherwise("corrected").alias("outcome"))
    return Effects(last, events, unknown, purity, outcomes)
