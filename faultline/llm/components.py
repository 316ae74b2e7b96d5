"""Connected components by hash-min propagation with pointer jumping, all in DataFrames.

Every round is a written table, so the lineage stays short and a lost executor repeats one round at most. Labels only fall, and
reach the least id of each component; only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """``links``: (a, b) of any order, repeats and self-links allowed. Returns (id, component) for all linked ids."""
    both = space.write(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = space.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        lower = space.write(labels.join(heard, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")), "lower")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("jumped"))
        labels = space.write(lower.join(jump, "label", "left").select("id", "old", F.least(F.col("label"), F.coalesce("jumped", "label")).alias("label")), "labels")
        if not labels.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")
