"""Mixing sources to target weights by entropy balancing.

Document rates are those closest to 1, in relative entropy over documents, that meet the token constraint of each source and stay
below the most copies: exp(tilt * size), cut off there. The convex dual has a tilt for each source. Its gradient and curvature
are sums over documents, which Spark takes over the counts of each (source, size); all sources take their Newton step at once,
inside a bracket that a step which doesn't help halves. Rates are rounded to copies by error feedback: within a bucket of a
source, longest documents first, each takes the copies that keep the words taken nearest to the words due. Buckets are cut by hash
so that no task holds more than a bounded part of a source, and only ids and sizes travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import words
from .storage import Workspace

#: Documents in a bucket, about; a source has one bucket for each so many.
BUCKET = 2_000


@dataclass(frozen=True)
class Mix:
    """Sources by code point, null last, get ``weights`` in turn, repeating, and share ``percent`` of all tokens; no source gets
    more than ``most`` times its tokens, and no document is taken more than ``most`` times."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2
    #: How near, relative to its target, a source's expected tokens must come.
    tolerance: float = 1e-9


def source_targets(sizes: DataFrame, mix: Mix, space: Workspace) -> DataFrame:
    """(source, n, source_size, target) of (source, size): the targets with their excess reshared."""
    sums = space.write(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "sums")
    # ranks by range partitions: only a count for each partition comes to the driver
    ranged = space.write(sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "ranged")
    before, starts = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):
        starts.append((r["part"], before))
        before += r["count"]
    offsets = F.coalesce(*[F.when(F.col("part") == p, F.lit(b)) for p, b in starts], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + offsets
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.pmod(rank, F.lit(len(mix.weights))) + 1).cast("int"))
    rows = space.write(ranged.select("source", "n", "source_size", weight.cast("double").alias("weight")), "weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * mix.percent / 100
    capped, share = -1, 0.0
    while True:  # at most one round for each source that reaches its cap; two or three in practice
        at_cap = F.col("weight") * share >= F.col("source_size") * mix.most
        s = rows.agg(F.sum(F.when(at_cap, F.col("source_size") * mix.most)).alias("fixed"), F.sum(F.when(~at_cap, F.col("weight"))).alias("w"), F.count_if(at_cap).alias("k")).first()
        if s is None or not s["w"] or s["k"] == capped:
            break
        capped, share = s["k"], (total - (s["fixed"] or 0)) / s["w"]
    target = F.least(F.col("weight") * share, F.col("source_size") * float(mix.most))
    return space.write(rows.select("source", "n", "source_size", target.cast("double").alias("target")), "targets")


def rate_of(size: Column, tilt: Column, mean: Column, most: int) -> Column:
    """A document's rate; the tilt of a source that gets all it can is infinite, and null for one that gets nothing."""
    # the exponent is cut where the rate is cut, so it can't overflow
    free = F.exp(F.least(tilt * (size / mean), F.lit(math.log(most))))
    return F.when(tilt.isNull() | mean.isNull(), F.when(size > 0, 0.0).otherwise(1.0)).when(tilt == float("inf"), float(most)).otherwise(F.least(free, F.lit(float(most))))


def tilts(sizes: DataFrame, targets: DataFrame, mix: Mix, space: Workspace) -> DataFrame:
    """(source, n, source_size, target, mean, tilt): the dual's solution, in units of the source's mean size."""
    counts = space.write(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("m")), "counts")
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n"))
    full = F.col("target") >= F.col("source_size") * float(mix.most) * (1 - mix.tolerance)
    none = F.lit(None).cast("double")
    start = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.when(full, F.lit(float("inf"))).otherwise(0.0))
    state = targets.withColumn("mean", mean).withColumn("tilt", start)
    state = state.select("*", none.alias("low"), none.alias("high"), none.alias("before"), (F.col("tilt").isNull() | (F.col("tilt") == float("inf"))).alias("done"))
    state, step = space.write(state, "state-0"), 0
    while state.where("NOT done").limit(1).count():
        open_ = state.where("NOT done").select(F.col("source").alias("of"), "tilt", "mean")
        placed = counts.join(open_, F.col("source").eqNullSafe(F.col("of")))
        rate = rate_of(F.col("size"), F.col("tilt"), F.col("mean"), mix.most)
        placed = placed.select("of", (F.col("m") * F.col("size")).alias("tokens"), (F.col("size") / F.col("mean")).alias("x"), rate.alias("rate"))
        # the gradient and the curvature of the dual
        sums = placed.groupBy("of").agg(F.sum(F.col("tokens") * F.col("rate")).alias("got"), F.sum(F.when(F.col("rate") < mix.most, F.col("tokens") * F.col("x") * F.col("rate"))).alias("slope"))
        s = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("error", F.col("got") - F.col("target"))
        s = s.withColumn("low", F.when(F.col("error") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("error") > 0, F.col("tilt")).otherwise(F.col("high")))
        # beyond the bracket known so far a step at most doubles the tilt
        reach = F.greatest(F.lit(1.0), F.abs("tilt"))
        newton = F.col("tilt") - F.greatest(-reach, F.least(reach, F.coalesce(F.col("error") / F.col("slope"), F.signum("error") * reach)))
        middle = (F.col("low") + F.col("high")) / 2
        slow = F.abs("error") * 2 > F.col("before")
        moved = F.when(middle.isNotNull() & (slow | (newton <= F.col("low")) | (newton >= F.col("high"))), middle).otherwise(newton)
        near = (F.abs("error") <= F.col("target") * mix.tolerance) | (moved == F.col("tilt"))
        moved = F.when(F.col("done") | near, F.col("tilt")).otherwise(moved)
        s = s.select("source", "n", "source_size", "target", "mean", moved.alias("tilt"), "low", "high", F.abs("error").alias("before"), (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"))
        step += 1
        state = space.write(s, f"state-{step}")
        space.remove(f"state-{step - 1}")
    return state.select("source", "n", "source_size", "target", "mean", "tilt")


def _rounded(most: int):
    """Of rows (bucket, row, tie, size, rate) in order of bucket: (row, copies)."""

    def copies(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rows, ties, sizes, rates = (t[c].to_numpy() for c in ("row", "tie", "size", "rate"))
        order = np.lexsort((rows, ties, -sizes))
        due, taken, out = 0.0, 0, []
        for s, rate in zip(sizes[order].tolist(), rates[order].tolist(), strict=True):
            due += rate * s
            c = min(most, max(0, round((due - taken) / s)))
            taken += c * s
            out.append(c)
        return pa.RecordBatch.from_arrays([pa.array(rows[order]), pa.array(out, pa.int32())], ["row", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b[x] != last:
                    yield copies(held)
                    held = []
                last = b[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield copies(held)

    return run


def _taken(rows: DataFrame, mix: Mix, space: Workspace) -> DataFrame:
    """(row, key, size, source_size, target, copies) of written rows (row, key, text, source)."""
    whole = F.coalesce("text", F.lit(""))
    sizes = rows.select("row", F.col("key").cast("long").alias("key"), F.col("source").cast("string").alias("source"), F.size(words(whole)).cast("long").alias("size"), F.xxhash64("key", whole).alias("tie"))
    sizes = space.write(sizes, "sizes")
    found = tilts(sizes, source_targets(sizes, mix, space), mix, space)
    # the table of sources joins by broadcast while it is small, else by a shuffle that may split a large source
    joined = sizes.join(found.withColumnRenamed("source", "of"), sizes["source"].eqNullSafe(F.col("of")), "left").drop("of")
    joined = joined.withColumn("rate", rate_of(F.col("size"), F.col("tilt"), F.col("mean"), mix.most))
    worded = joined.where("size > 0")
    # rows of one id and text are dealt together, so that reruns agree, unless they are too many for a bucket
    repeats = sizes.where("size > 0").groupBy("tie").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET)
    salt = F.pmod("row", F.ceil(F.coalesce("rows", F.lit(1)) / BUCKET))
    bucket = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.pmod(F.xxhash64("tie", salt), F.ceil(F.col("n") / BUCKET)))
    dealt = worded.join(repeats, "tie", "left").select(bucket.alias("bucket"), "row", "tie", "size", "rate")
    copies = space.write(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_rounded(mix.most), "row long, copies int"), "copies")
    copies = joined.join(copies, "row", "left").select("row", "key", "size", "source_size", "target", F.coalesce("copies", F.lit(1)).alias("copies"))
    return copies


def mix_sources(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, copies) for each row of ``docs``.

    A document's size is the number of words of its text (null: 0). A null source is a source of its own. Documents without words
    are taken once. Repeated rows count each for itself. Reruns agree, as rounding depends on ids, texts and sizes only, but for
    rows of one id and text that are more than a bucket holds. An empty table gives an empty table; other columns are left out.
    """
    space = Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in ((key, "key"), (text, "text"), (source, "source"))])
    # the rows are numbered where their sizes are written, and not again
    return _taken(rows, mix, space).drop("row").withColumnRenamed("key", key)


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, by the rules of ``mix_sources``; all columns are kept."""
    space, names = Workspace(docs.sparkSession, "mixed"), docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    whole = space.write(whole, "numbered")
    taken = _taken(whole.select("row", *[F.col(f"doc.`{c}`").alias(n) for c, n in ((key, "key"), (text, "text"), (source, "source"))]), mix, space)
    taken = taken.where("copies > 0").select("row", "copies")
    return whole.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
