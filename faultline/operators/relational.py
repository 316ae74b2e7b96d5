"""Keyed state, lookups and ranking as DataFrame rewrites.

Every operator is a plain plan: aggregates combine before the shuffle, and latest-row lookups are aggregates rather than windows,
so that a key with very many rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The ``columns`` of the row that is greatest by ``order``, for each key."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """``new`` replaces ``old`` by key; of the ``keep_old`` columns a null keeps the old value."""
    o, n = old.select(F.struct("*").alias("o"), *keys), new.select(F.struct("*").alias("n"), *keys)
    both = o.join(n, keys, "full_outer")
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old or c in keys else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


def delete_matching(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` isn't true; a null condition keeps the row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Catalyst limits each partition's groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """For each left row the right row of its key that is last at or before ``at`` (ties by ``tie``), or nulls.

    A union sorted by time with a running last value needs one shuffle by key and no pairs of rows.
    """
    value = F.struct(*columns)
    l_rows = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct("*").alias("__left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__right"))
    r_rows = right.select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), value.alias("__right"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = l_rows.union(r_rows).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__left.*", *[F.col(f"__last.{c}").alias(c) for c in columns])
