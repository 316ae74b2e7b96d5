"""Template mining as keyed state of a stream, and matching of lines with stored templates, in a stream or a table."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.grouping import MAX_CHILDREN, SIMILARITY, WILDCARD, TemplateTree

#: The state store that keyed processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "project_id long, cluster long, template string, template_hash string, n long, version long"


def stored(tree: TemplateTree, counts: dict[int, int]) -> str:
    """A tree and its clusters' sizes as text; the order of templates is that of their use."""
    return json.dumps({
        "templates": [[c, t, counts.get(c, 0)] for c, t in tree.templates.items()], "next": tree.next,
        "leaves": [[list(p), [c for c in ids if c in tree.templates]] for p, ids in tree.leaves.items()], "children": [[list(p), sorted(names)] for p, names in tree.children.items()],
    })


def loaded(text: str | None) -> tuple[TemplateTree, dict[int, int]]:
    tree, counts = TemplateTree(), {}
    if text:
        state = json.loads(text)
        tree.templates, tree.next = OrderedDict((c, t) for c, t, _ in state["templates"]), state["next"]
        tree.leaves, tree.children = {tuple(p): ids for p, ids in state["leaves"]}, {tuple(p): set(names) for p, names in state["children"]}
        counts = {c: n for c, _, n in state["templates"]}
    return tree, counts


class Miner(StatefulProcessor):
    """Holds a project's tree of templates; the one used longest ago goes when there are too many. Of each batch it tells the clusters
    that took a line, with the version of the tree, which is the number of batches that it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tree", "tree string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, version = self.state.get() if self.state.exists() else (None, 0)
        tree, counts = loaded(text)
        touched: set[int] = set()
        # a batch's lines of a project, in order
        for line in pd.concat(rows).sort_values(["at", "line"])["line"]:
            if isinstance(line, str) and line.strip():
                cluster, _ = tree.add(line)
                counts[cluster] = counts.get(cluster, 0) + 1
                touched.add(cluster)
        self.state.update((stored(tree, counts), version + 1))
        out = [(key[0], c, t, hashlib.md5(t.encode()).hexdigest(), counts[c], version + 1) for c in sorted(touched) if c in tree.templates for t in [" ".join(tree.templates[c])]]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def mined(lines: DataFrame) -> DataFrame:
    """OUT of a stream (project_id, at, line): its clusters as they change. A batch's lines are taken in order of ``at`` and ``line``,
    so a stream gives what one pass over all lines gives if its batches come in that order."""
    return lines.select("project_id", "at", "line").groupBy("project_id").transformWithStateInPandas(Miner(), OUT, "Update", "None")


# matching


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.translate(line, "_|", "  "), "(?U)\\s+"), lambda w: w != "")


def trie(templates: DataFrame) -> DataFrame:
    """(project_id, length, head, leaf, known) of stored templates (project_id, template, n): the leaves of a tree that holds each as a
    template of its own, most frequent first. ``known`` are the heads that the tree tells apart at that length."""
    rows = templates.where(F.trim("template") != "").withColumn("tokens", _tokens(F.col("template"))).withColumn("length", F.size("tokens"))
    first = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    rows = rows.withColumn("first", F.when(first.rlike("[0-9]"), WILDCARD).otherwise(first))
    use = [F.desc("n"), F.asc("template")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "length").orderBy(*use)))
    # heads get children of their own in order of their first use, as far as there is room
    heads = rows.groupBy("project_id", "length", "first").agg(F.min("place").alias("place"))
    heads = heads.withColumn("child", F.row_number().over(Window.partitionBy("project_id", "length").orderBy("place"))).where(F.col("child") <= MAX_CHILDREN)
    known = heads.groupBy("project_id", "length").agg(F.collect_list("first").alias("known"))
    placed = rows.join(known, ["project_id", "length"])
    head = F.when(F.array_contains("known", F.col("first")), F.col("first")).otherwise(WILDCARD)
    leaves = placed.groupBy("project_id", "length", head.alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "template", "tokens"))).alias("leaf"))
    return leaves.join(known, ["project_id", "length"])


def match_templates(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """``lines`` (project_id, line, ...) with ``template``: the stored template that each belongs to, or null; nothing is learnt.

    A line meets the leaf of its length and first word in a plain equi-join, so a stream is matched like a table. Of a leaf's templates
    the most similar is taken, of equals that of most wildcards, then the most frequent; it must be similar enough or cover the line.
    """
    kept = lines.columns
    rows = lines.withColumn("m_tokens", _tokens(F.col("line"))).withColumn("m_length", F.size("m_tokens"))
    first = F.coalesce(F.get("m_tokens", F.lit(0)), F.lit(""))
    rows = rows.withColumn("m_first", F.when(first.rlike("[0-9]"), WILDCARD).otherwise(first))
    known = leaves.select(F.col("project_id").alias("k_project"), F.col("length").alias("k_length"), "known").distinct()
    rows = rows.join(known, (F.col("project_id") == F.col("k_project")) & (F.col("m_length") == F.col("k_length")), "left")
    rows = rows.withColumn("m_head", F.when(F.array_contains("known", F.col("m_first")), F.col("m_first")).otherwise(WILDCARD))
    at = leaves.select(F.col("project_id").alias("l_project"), F.col("length").alias("l_length"), F.col("head").alias("l_head"), "leaf")
    rows = rows.join(at, (F.col("project_id") == F.col("l_project")) & (F.col("m_length") == F.col("l_length")) & (F.col("m_head") == F.col("l_head")), "left")

    def judged(t: Column) -> Column:
        same = F.size(F.filter(F.zip_with(t["tokens"], F.col("m_tokens"), lambda a, b: (a == b) & (a != WILDCARD)), lambda x: x))
        wild = F.size(F.filter(t["tokens"], lambda a: a == WILDCARD))
        covers = F.forall(F.zip_with(t["tokens"], F.col("m_tokens"), lambda a, b: (a == b) | (a == WILDCARD)), lambda x: x)
        return F.struct(same.alias("same"), wild.alias("wild"), (-t["place"]).alias("place"), (covers | (same / F.greatest(F.col("m_length"), F.lit(1)) >= SIMILARITY)).alias("fits"), t["template"].alias("template"))

    best = F.array_max(F.transform("leaf", judged))
    return rows.withColumn("m_best", best).select(*kept, F.when(F.col("m_best.fits"), F.col("m_best.template")).alias("template"))
