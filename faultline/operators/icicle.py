"""Templates as a tree of their first words, laid out as nested intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch

# a fixed value: how many words of a template are told apart
MAX_TOKENS = 4


def offsets(df: DataFrame, scratch: Scratch, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its keys that come before it; ``order`` must tell rows apart.

    Rows are ordered over all tasks and summed within each task's share, then shares of the same keys are added up, so no key's rows
    come to one task however many they are; the second step has a row for each key and share. The shares are written, as the bounds
    between them are drawn from a sample.
    """
    shares = scratch.write(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("share", F.spark_partition_id()), "shares")
    inside = F.sum(value).over(Window.partitionBy("share", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = shares.groupBy("share", *keys).agg(F.sum(value).alias("all"))
    earlier = F.sum("all").over(Window.partitionBy(*keys).orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("share", *keys, F.coalesce(earlier, F.lit(0)).alias("earlier"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("share", *keys)]
    rows = shares.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("a").join(sums.alias("b"), same)
    return rows.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("inside") + F.col("earlier")).alias("before"))


def icicle(templates: DataFrame, scratch: Scratch, tree: str) -> DataFrame:
    """(tree, depth, path, name, value, x0, x1, y0, y1) of templates (tree, pattern, n): a cell for each distinct beginning of up to
    MAX_TOKENS words, in fractions of the tree's box.

    A cell without longer ones counts the templates that end in it, one with such only 1 and theirs; a template of no uses (or a null
    number) counts once. Children start where their parent does, the largest first, of equals that of the most used template, then of
    the least pattern; the parent's own 1 is left over at its end. A null pattern is an empty one, whose word is empty; a pattern that
    is there several times counts each time; a null tree is one of its own; no templates, no cells.
    """
    words = F.slice(F.split(F.coalesce("pattern", F.lit("")), "\\s+"), 1, MAX_TOKENS)
    n = F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("n")).cast("long")
    # siblings differ in their words, so a pattern's first words and the sign behind them order them as whole patterns do
    head = F.regexp_extract(F.coalesce("pattern", F.lit("")), f"^\\S*(?:\\s+\\S*){{0,{MAX_TOKENS - 1}}}\\s?", 0)
    rows = templates.select(F.col(tree).alias("tree"), F.struct((-n).alias("n"), head.alias("pattern")).alias("first"), n.alias("n"), words.alias("words"))
    begun = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("words"))))
    cells = begun.groupBy("tree", F.slice("words", F.lit(1), F.col("depth")).alias("path")).agg(F.sum("n").alias("n"), F.max(F.size("words") > F.col("depth")).alias("inner"), F.min("first").alias("first"))
    cells = scratch.write(cells.select("tree", "path", "first", F.when(F.col("inner"), 1).otherwise(F.col("n")).cast("long").alias("own")), "cells")
    ups = F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d))
    value = cells.select("tree", "own", F.explode(ups).alias("path")).groupBy("tree", "path").agg(F.sum("own").alias("value"))
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    valued = cells.alias("c").join(value.alias("v"), same("c", "v", "tree", "path")).select("c.tree", "c.path", "c.first", "value")
    valued = valued.withColumn("parent", F.slice("path", F.lit(1), F.size("path") - 1))
    placed = offsets(valued, scratch, ["tree", "parent"], [F.desc("value"), F.asc("first"), F.asc("path")], "value")
    placed = scratch.write(placed.select("tree", "path", "value", "before"), "placed")
    # a cell starts where its ancestors and their earlier siblings end
    starts = placed.select("tree", F.col("path").alias("cell"), F.explode(ups).alias("path")).alias("s").join(placed.alias("p"), same("s", "p", "tree", "path"))
    starts = starts.groupBy("s.tree", "cell").agg(F.sum("before").alias("start"))
    whole = placed.groupBy("tree").agg((F.sum(F.when(F.size("path") == 1, F.col("value"))) + 1).alias("total"), (F.max(F.size("path")) + 1).alias("bands"))
    rows = placed.alias("p").join(starts.alias("s"), [F.col("p.tree").eqNullSafe(F.col("s.tree")), F.col("p.path") == F.col("s.cell")]).join(whole.alias("w"), same("p", "w", "tree"))
    depth = F.size("path").cast("long")
    return rows.select(
        F.col("p.tree").alias(tree), depth.alias("depth"), F.array_join("path", " ").alias("path"), F.element_at("path", -1).alias("name"), "value",
        (F.col("start") / F.col("total")).alias("x0"), ((F.col("start") + F.col("value")) / F.col("total")).alias("x1"), (depth / F.col("bands")).alias("y0"), ((depth + 1) / F.col("bands")).alias("y1"),
    )
