"""Projection of vectors, training of models with pyspark.ml, and calibration of their scores."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boosting
from .registry import Views, query


def project(vectors: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, x) of (item_id, emb): centred principal components, each with its greatest loading positive.

    The covariance is summed over partitions; only its matrix, of the vectors' width, comes to the driver.
    """
    wide = vectors.select("item_id", "emb", F.size("emb").alias("d")).where("d > 0")
    means = wide.select(F.posexplode("emb").alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    center = F.array(*[F.lit(r.m) for r in sorted(means)])  # as many as a vector is wide
    rows = wide.select("item_id", array_to_vector(F.zip_with(F.col("emb").cast("array<double>"), center, lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, c]).argmax(), c] >= 0 else -1.0 for c in range(k)]
    out = vector_to_array(F.col("p"))
    return model.transform(rows).select("item_id", F.array(*[F.round(out[c] * signs[c], 6) for c in range(k)]).alias("x"))


#: Scores are counted on a grid of so many steps, so what one fit holds is bounded whatever the number of rows.
STEPS = 10_000
LEAST_ROWS = 300


def isotonic(counts: DataFrame) -> DataFrame:
    """(scope, knots) of (scope, x, n, hits): for each scope the rising step values nearest to the shares of hits, as points."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        pools: list[list[float]] = []  # first x, last x, n, hits
        for x, n, hits in zip(frame["x"], frame["n"], frame["hits"], strict=True):
            pools.append([x, x, n, hits])
            while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        knots = [(x, h / n) for first, last, n, h in pools for x in ((first, last) if last > first else (first,))]
        return pd.DataFrame([(frame["scope"].iloc[0], [{"x": x, "y": y} for x, y in knots])], columns=["scope", "knots"])

    return counts.groupBy("scope").applyInPandas(fit, f"scope {counts.schema['scope'].dataType.simpleString()}, knots array<struct<x:double,y:double>>")


def between(x: Column, knots: Column) -> Column:
    """The straight line between the knots around x; flat beyond them."""
    low, high = F.filter(knots, lambda k: k.x <= x), F.filter(knots, lambda k: k.x > x)
    a, b = F.get(low, F.size(low) - 1), F.get(high, F.lit(0))
    return F.when(a.isNull(), b.y).when(b.isNull(), a.y).otherwise(a.y + (x - a.x) * (b.y - a.y) / (b.x - a.x))


def calibrate(scored: DataFrame, project: str, score: str, hit: str) -> DataFrame:
    """The rows with ``calibrated``: by the fit of their project, if it has 300 known hits or more, else by that of all, else the
    score as it is. ``hit`` is null where it isn't known."""
    grid = (F.round(F.col(score) * STEPS) / STEPS).alias("x")
    known = scored.where(F.col(hit).isNotNull()).groupBy(F.col(project).cast("string").alias("scope"), grid).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(hit)).cast("double").alias("hits"))
    every = known.groupBy(F.lit("*").alias("scope"), "x").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    both = known.unionByName(every.select("scope", "x", "n", "hits"))
    enough = both.groupBy("scope").agg(F.sum("n").alias("rows")).where(F.col("rows") >= LEAST_ROWS).select("scope")
    knots = isotonic(both.join(enough, "scope"))
    own = knots.where("scope <> '*'").select(F.col("scope").alias("own_scope"), F.col("knots").alias("own"))
    install = knots.where("scope = '*'").select(F.col("knots").alias("install"))  # a row at most
    rows = scored.join(own, F.col(project).cast("string") == F.col("own_scope"), "left").join(F.broadcast(install), F.lit(True), "left")
    picked = F.coalesce("own", "install")
    return rows.withColumn("calibrated", F.when(picked.isNull(), F.col(score)).otherwise(between(F.col(score), picked))).drop("own_scope", "own", "install")


def train(rows: DataFrame, rounds: int = 200, depth: int = 5, rate: float = 0.05, least: int = 50) -> dict[str, object]:
    """A boosted one-against-the-rest model for each group of rows (features array<double>, label), rows weighted so that groups
    count alike; none with fewer than ``least`` rows or two groups. There are four groups at most."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total < least or len(counts) < 2:
        return {}
    weight = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (len(counts) * n))])
    base = rows.select(array_to_vector(F.col("features")).alias("v"), "label", weight[F.col("label")].alias("w"))
    fit = lambda k: GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42, cacheNodeIds=False).fit(base.withColumn("y", (F.col("label") == k).cast("double")))
    return {k: fit(k) for k in sorted(counts)}


def predict(models: dict[str, object], rows: DataFrame) -> DataFrame:
    """The rows (features, ...) with ``probs`` (a map over groups, summing to 1), ``guess`` and ``max_prob``; of equals the first
    group by name."""
    out = rows.withColumn("v", array_to_vector(F.col("features")))
    for k, model in models.items():
        model = model.copy().setPredictionCol(f"p_{k}").setRawPredictionCol(f"r_{k}").setProbabilityCol(f"s_{k}")
        out = model.transform(out).withColumn(f"q_{k}", vector_to_array(F.col(f"s_{k}"))[1]).drop(f"p_{k}", f"r_{k}", f"s_{k}")
    names = list(models)
    total = reduce(lambda a, b: a + b, [F.col(f"q_{k}") for k in names])
    shares = F.array(*[F.col(f"q_{k}") / total for k in names])
    labels = F.array(*[F.lit(k) for k in names])
    out = out.withColumn("shares", shares)
    top = F.array_position("shares", F.array_max("shares")).cast("int")
    kept = [c for c in rows.columns]
    return out.select(*kept, F.map_from_arrays(labels, F.col("shares")).alias("probs"), F.element_at(labels, top).alias("guess"), F.array_max("shares").alias("max_prob"))


def out_of_fold(rows: DataFrame, fold: str, folds: int = 5, **settings) -> DataFrame:
    """Each row scored by a model that hasn't seen its fold."""
    parts = [predict(m, rows.where(F.col(fold) == k)) for k in range(folds) if (m := train(rows.where(F.col(fold) != k), **settings))]
    return reduce(DataFrame.unionByName, parts)


@query("r21_projection")
def r21(v: Views) -> DataFrame:
    return project(v("v_signature").select("item_id", "emb"))


@query("l6_calibration", python=True)
def l6(v: Views) -> DataFrame:
    hit = F.when(F.col("outcome") != "pending", F.col("outcome") == "accepted")
    rows = v("v_suggestion").select("suggestion_id", "project_id", "confidence", hit.alias("hit"))
    return calibrate(rows, "project_id", "confidence", "hit").select("suggestion_id", F.round("calibrated", 6).alias("calibrated"))


@query("l4_trained_model", python=True)
def l4(v: Views) -> DataFrame:
    """A small multiclass model over the whole vectors of labelled items, applied to all of them (L5)."""
    placed = v("v_signature").select("project_id", "item_id", F.transform("emb", lambda x: x.cast("double")).alias("features")).join(v("v_item").select("project_id", "item_id", "issue_group"), ["project_id", "item_id"])
    labelled = placed.where(F.col("issue_group").isin("pb", "ab", "si", "nd"))
    model = boosting.boost(labelled.select("features", F.col("issue_group").alias("label")), boosting.Settings(rounds=4, leaves=8, rate=0.3, bins=31))
    return boosting.predict(model, placed.where("size(features) > 0").select("item_id", "features")).select("item_id", "guess", F.round("max_prob", 6).alias("max_prob"))


@query("h19_label_probabilities", """
WITH r AS (SELECT suggestion_id, model_ver, confidence AS p, [0.4 + (suggestion_id % 7) / 20.0, 0.1 + (suggestion_id % 3) / 20.0, 0.05, 0.1]::DOUBLE[] AS raw FROM v_suggestion),
n AS (SELECT suggestion_id, p, model_ver, list_transform(raw, lambda x: x / list_sum(raw)) AS q FROM r), g AS (SELECT *, list_max(q) AS m FROM n)
SELECT suggestion_id, CASE WHEN model_ver LIKE 'gbm%' THEN round(p, 6) END AS p_top, CASE WHEN model_ver LIKE 'gbm%' THEN round(q[2] * (1 - p) / (1 - m), 6) END AS p_second FROM g""")
def h19(v: Views) -> DataFrame:
    """The group of the highest raw probability has the calibrated one, the others share the rest in their raw ratio; unknown
    (null) where no model stands behind the suggestion."""
    s = F.col("suggestion_id")
    raw = F.array(0.4 + (s % 7) / 20.0, 0.1 + (s % 3) / 20.0, F.lit(0.05), F.lit(0.1))
    rows = v("v_suggestion").select("suggestion_id", "confidence", "model_ver", raw.alias("raw"))
    rows = rows.withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)).withColumn("q", F.transform("raw", lambda x: x / F.col("total")))
    top = F.array_max("q")
    share = lambda k: F.when(F.col("q")[k] == top, F.col("confidence")).otherwise(F.col("q")[k] * (1 - F.col("confidence")) / (1 - top))
    known = F.col("model_ver").startswith("gbm")
    return rows.select("suggestion_id", F.when(known, F.round(share(0), 6)).alias("p_top"), F.when(known, F.round(share(1), 6)).alias("p_second"))
