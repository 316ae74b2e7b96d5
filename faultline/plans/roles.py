"""Queries around a text model, and similarity of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.cleaning import similarity_tokens
from ..operators.grouping import term_vectors
from .registry import Views, query


@query("t41_sanitized")
def t41(v: Views) -> DataFrame:
    return v("v_log").select("item_id", "pos", prompts.sanitized(F.concat(F.lit("user: "), "message")).alias("out"))


@query("t42_line_pairs")
def t42(v: Views) -> DataFrame:
    pairs = prompts.line_pairs(F.col("message"))
    nonce = F.substring(F.md5(F.concat_ws(":", "item_id", "pos").cast("binary")), 1, 8)
    return v("v_log").select("item_id", "pos", pairs.alias("pairs"), prompts.enveloped(prompts.sanitized(F.col("message")), nonce).alias("envelope"))


@query("t46_without_thinking", "SELECT item_id, pos, message AS out FROM v_log")
def t46(v: Views) -> DataFrame:
    """What a model thought before its answer goes."""
    return v("v_log").select("item_id", "pos", prompts.without_thinking(F.concat(F.lit("<think>so\nso</think>\n"), "message")).alias("out"))


_VALUES = ", ".join(f"({k}, '{r}', '{label}', '{bucket}', {prompts.BUCKETS[bucket]}::DOUBLE)" for k, (r, label, bucket, _) in enumerate(prompts.RUBRIC))


@query("l16_rubric_agreement", f"WITH r(place, rule, label, bucket, confidence) AS (VALUES {_VALUES}) SELECT suggestion_id, rule, label, r.confidence, substr(predicted_label, 1, 2) = label AS agrees FROM v_suggestion JOIN r ON place = suggestion_id % 14")
def l16(v: Views) -> DataFrame:
    """What rule a model named (here the 14 in turn), the label and confidence that rule gives, and if the label agrees."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(label).alias("label"), F.lit(prompts.BUCKETS[b]).alias("confidence")) for r, label, b, _ in prompts.RUBRIC])
    rows = v("v_suggestion").select("suggestion_id", "predicted_label", F.get(rules, (F.col("suggestion_id") % 14).cast("int")).alias("r"))
    return rows.select("suggestion_id", "r.rule", "r.label", "r.confidence", (F.substring("predicted_label", 1, 2) == F.col("r.label")).alias("agrees"))


@query("a35_rubric_rows", f"WITH r(place, rule, label, bucket, confidence) AS (VALUES {_VALUES}) SELECT place, rule, label, bucket FROM r")
def a35(v: Views) -> DataFrame:
    """The rules in the order in which the first that fits decides."""
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(r).alias("rule"), F.lit(label).alias("label"), F.lit(b).alias("bucket")) for k, (r, label, b, _) in enumerate(prompts.RUBRIC)])
    return v("region").limit(1).select(F.inline(rows))


def text_similarity(rows: DataFrame) -> DataFrame:
    """(id, other, similarity, both_empty) of rows (id, base, others array<struct<other, text>>): the cosine of word and word pair
    counts of prepared texts. Texts that say nothing are alike only if they are equal and not blank. A null base is like none."""
    prepared = lambda c: F.array_join(similarity_tokens(c), " ")
    x = rows.where("base IS NOT NULL").select("id", "base", prepared(F.col("base")).alias("p"), F.transform("others", lambda o: F.struct(o.other.alias("other"), o.text.alias("text"), prepared(o.text).alias("p"))).alias("others"))

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                usual = [(o, k) for k, o in enumerate(row.others) if row.p and o["p"] and o["p"] != row.p]
                m = term_vectors([row.p, *[o["p"] for o, _ in usual]], False) if usual else None
                near = {k: float(m[0] @ m[1 + n]) for n, (_, k) in enumerate(usual)} if m is not None else {}
                for k, o in enumerate(row.others):
                    empty = not row.p and not o["p"] and not row.base.strip() and not (o["text"] or "").strip()
                    same = float(o["p"] == row.p) if row.p and o["p"] else float(not row.p and not o["p"] and not empty and row.base == o["text"])
                    out.append((row.id, o["other"], near.get(k, same), empty))
            yield pd.DataFrame(out, columns=["id", "other", "similarity", "both_empty"])

    return x.mapInPandas(run, "id long, other long, similarity double, both_empty boolean")


@query("r18_text_similarity", python=True)
def r18(v: Views) -> DataFrame:
    """An item's first message against its other ones (a conversation's, so few)."""
    logs = v("v_log").select("item_id", "pos", "message")
    rows = logs.groupBy("item_id").agg(F.min_by("message", "pos").alias("base"), F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("other"), F.col("message").alias("text")))).alias("others"))
    return text_similarity(rows.withColumnRenamed("item_id", "id")).withColumn("similarity", F.round("similarity", 6))
