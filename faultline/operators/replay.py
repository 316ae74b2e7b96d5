"""Each decision of a model taken twice: as the launch left it, and as if the item had been alone in its launch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import band
from .boosting import Boosted, predict

# What is known of an item's launch when the item comes first.
SINGLETON = {"group_dominance": 1.0, "co_failure_group_size": math.log1p(1) / math.log1p(200), "launch_fail_fraction": 0.0, "si_prior": 0.0}


def overridden(features: Column, names: list[str], values: dict[str, float]) -> Column:
    """An array of features with those of ``values`` set, wherever ``names`` has them; the others stay as they are."""
    at = {k: values[n] for k, n in enumerate(names) if n in values}

    def one(x: Column, k: Column) -> Column:
        out = x
        for place, value in at.items():
            out = F.when(k == place, F.lit(value)).otherwise(out)
        return out

    return F.transform(features, one)


def paired(model: Boosted, rows: DataFrame, names: list[str], values: dict[str, float] = SINGLETON) -> DataFrame:
    """``rows`` (with ``features``, an array in order of ``names``) and finish_label, finish_conf, early_label, early_conf, label_flipped,
    band_changed. Both decisions are taken in one pass over the rows; pairs are never joined. Rows without features are left out."""
    kept = [c for c in rows.columns if c != "features"]
    finish = predict(model, rows.where("features IS NOT NULL")).withColumnsRenamed({"guess": "finish_label", "max_prob": "finish_conf"}).drop("probs")
    both = predict(model, finish.withColumn("features", overridden(F.col("features"), names, values))).withColumnsRenamed({"guess": "early_label", "max_prob": "early_conf"})
    flipped = F.col("finish_label") != F.col("early_label")
    moved = band(F.col("finish_conf")) != band(F.col("early_conf"))
    return both.select(*kept, "finish_label", "finish_conf", "early_label", "early_conf", flipped.alias("label_flipped"), moved.alias("band_changed"))


def report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: n, the rates of flips and band moves, how often from what to what, and the mean and greatest shift of
    confidence. Pairs are counted first, so the maps are made of as many rows as there are pairs of labels and bands."""
    shift = F.abs(F.col("finish_conf") - F.col("early_conf"))
    to = lambda changed, a, b: F.when(F.col(changed), F.concat(a, F.lit("->"), b))
    rows = pairs.withColumn("flip", to("label_flipped", F.col("finish_label"), F.col("early_label"))).withColumn("move", to("band_changed", band(F.col("finish_conf")), band(F.col("early_conf"))))
    counted = rows.groupBy(*keys, "flip", "move").agg(F.count("*").alias("rows"), F.sum(shift).alias("all"), F.max(shift).alias("most"))

    def times(name: str) -> Column:
        """{pair: n} of counted rows, of which several may have one pair."""
        entries = F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("pair"), F.col("rows").alias("rows"))))
        pairs_ = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["pair"])))
        return F.map_from_arrays(pairs_, F.transform(pairs_, lambda p: F.aggregate(F.filter(entries, lambda e: e["pair"] == p), F.lit(0).cast("long"), lambda s, e: s + e["rows"])))

    total = F.sum("rows")
    rate = lambda name: F.round(F.coalesce(F.sum(F.when(F.col(name).isNotNull(), F.col("rows"))), F.lit(0)) / total, 4)
    return counted.groupBy(*keys).agg(
        total.alias("n"), rate("flip").alias("label_flip_rate"), times("flip").alias("label_flips"), rate("move").alias("band_change_rate"), times("move").alias("band_changes"),
        F.round(F.sum("all") / total, 4).alias("mean_abs_conf_delta"), F.round(F.max("most"), 4).alias("max_abs_conf_delta"),
    )
