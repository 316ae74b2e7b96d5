"""An inverted-file index for the nearest vectors by cosine.

Centroids are fitted on a bounded sample; every vector is posted to the list of its nearest centroid. A list is cut into blocks
that one row holds as a matrix, so a search is a join of rows (block, queries) and a product of two matrices for each, wherever
the index lies. A hot list is many blocks.

A search asks the nearest lists of a query first. An approximate one ends there. An exact one then asks all other blocks that may
still hold one of the k best: a block knows the least and greatest angle between its vectors and their centroid, so the angle of
the query to the centroid bounds every cosine in it from above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.shared import Scratch
from .relational import top_k

#: Vectors that the centroids are fitted on, about; centroids at most; rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Vectors of a block, about, and queries that meet it in one row.
BLOCK, ASKED = 4096, 2048
#: Vectors that a task compares with all centroids at once, and rows (query, list) that it makes at once.
SLICE, ROWS = 1024, 16_384
#: Visits of blocks that a task gets, about.
VISITS = 16_384
#: Lists that a search asks first.
PROBES = 8
#: Below a bound by so much a cosine is surely less: products of floats are rounded.
SLACK = 1e-5


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means from evenly spread rows; a centroid that is left alone keeps its place."""
    x = x[np.lexsort(x.T[:2])]
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + SLICE] @ c.T).argmax(1) for i in range(0, len(x), SLICE)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _fit(lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0)) for b in batches if b.num_rows]
        if parts:
            c = fitted(unit(np.concatenate(parts)), lists)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(list(c), pa.list_(pa.float64()))], ["list", "centroid"])

    return run


def _posted(centroids: np.ndarray):
    """(project_id, item_id, emb, list, angle) of (project_id, item_id, emb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                near = unit(matrix(b.column(2))) @ centroids.T
                own = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angle)], ["project_id", "item_id", "emb", "list", "angle"])

    return run


def _packed(rows: pa.Table) -> pa.Table:
    angle = rows.column("angle").to_numpy()
    first = {c: [rows.column(c)[0].as_py()] for c in ("project_id", "list", "block")}
    ids, vectors = rows.column("item_id").to_numpy().astype("<i8").tobytes(), matrix(rows.column("emb")).astype("<f8").tobytes()
    return pa.table({"project_id": pa.array(first["project_id"], pa.int64()), "list": pa.array(first["list"], pa.int32()), "block": pa.array(first["block"], pa.int64()), "n": pa.array([len(angle)], pa.int64()), "least": [float(angle.min())], "most": [float(angle.max())], "ids": [ids], "vectors": [vectors]})


def _ordered(centroids: np.ndarray, probes: int):
    """(query_id, project_id, emb, list, angle, place) of (query_id, project_id, emb) for all lists, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, most = ["query_id", "project_id", "emb", "list", "angle", "place"], max(1, ROWS // min(probes, len(centroids)))
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                angle = np.arccos(np.clip(unit(matrix(part.column(2))) @ centroids.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
                flat = order.ravel()
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns), pa.array(flat.astype(np.int32)), pa.array(angle[np.repeat(np.arange(part.num_rows), order.shape[1]), flat]), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), part.num_rows))], names)

    return run


def _scored(k: int):
    """Of rows (ids, vectors, asked as query_id, emb, bar): (query_id, item_id, cosine) of each query's k best of the block, without
    those that are surely under its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[r].as_buffer(), "<i8")
                x = np.frombuffer(batch.column(1)[r].as_buffer(), "<f8").reshape(len(ids), -1)
                asked = batch.column(2)[r].values
                queries, q, bar = asked.field("query_id").to_numpy(), matrix(asked.field("emb")), asked.field("bar").to_numpy() - SLACK
                size, q_size = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i in range(0, len(q), 256):
                    cosine = (q[i : i + 256] @ x.T) / (q_size[i : i + 256, None] * size)
                    shown = np.round(cosine, 6)
                    for row, query in enumerate(queries[i : i + 256].tolist()):
                        good = np.flatnonzero((ids != query) & (cosine[row] >= bar[i + row]))
                        s = shown[row, good]
                        if len(good) > k:
                            some = s >= np.partition(s, len(s) - k)[len(s) - k]
                            good, s = good[some], s[some]
                        best = good[np.lexsort((-ids[good], -s))[:k]]
                        out.append((np.full(len(best), query), ids[best], cosine[row, best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["query_id", "item_id", "cosine"])

    return run


@dataclass
class VectorIndex:
    """Written blocks (project_id, list, block, n, least, most, ids, vectors), each item's list, and the centroids; None where there
    is no vector."""

    blocks: DataFrame
    lists: DataFrame
    centroids: np.ndarray | None
    space: Scratch


def with_direction(rows: DataFrame) -> DataFrame:
    """Rows whose vector has a length and no null or non-finite component."""
    size = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where((size > 0) & (size < math.inf))


def build_index(items: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> VectorIndex:
    """Indexes every row (project_id, item_id, emb); vectors that are null, zero, or hold a null or non-finite component have no
    direction and are left out. ``sample`` is about how many vectors the centroids are fitted on; by default there are as many
    lists as the root of the number of vectors, MOST_LISTS at most."""
    ship(items.sparkSession)
    space = Scratch(items.sparkSession, "vector-index")
    rows = with_direction(items.select(F.col("project_id").cast("long").alias("project_id"), F.col("item_id").cast("long").alias("item_id"), "emb"))
    n = rows.count()
    lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
    few = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(max(n, 1)).cast("long")) < sample).select("emb")
    found = few.repartition(1).mapInArrow(_fit(lists), "list int, centroid array<double>").collect()
    centroids = np.array([r["centroid"] for r in sorted(found)]) if found else None
    schema = rows.schema["emb"].dataType.simpleString()
    if centroids is None:
        empty = rows.select("project_id", F.lit(0).alias("list"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"), F.lit(b"").alias("ids"), F.lit(b"").alias("vectors"))
        return VectorIndex(empty.limit(0), rows.select("item_id", F.lit(0).alias("list")).limit(0), None, space)
    posted = space.write(rows.mapInArrow(_posted(centroids), f"project_id long, item_id long, emb {schema}, list int, angle double"), "posted")
    sizes = posted.groupBy("project_id", "list").agg(F.count("*").alias("n"))
    dealt = posted.join(sizes, ["project_id", "list"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / BLOCK)).cast("long"))
    packed = dealt.select("project_id", "list", "block", "item_id", "emb", "angle").groupBy("project_id", "list", "block").applyInArrow(_packed, "project_id long, list int, block long, n long, least double, most double, ids binary, vectors binary")
    blocks = space.write(packed, "blocks")
    return VectorIndex(blocks, posted.select("item_id", "list"), centroids, space)


def _visited(index: VectorIndex, visits: DataFrame, n: int, lists: int, k: int) -> DataFrame:
    """(query_id, item_id, cosine): the best of each visited block, of (query_id, emb, bar, project_id, list, block) of n queries that
    visit so many lists each. Visits are more than queries by the number of lists, so tasks grow with them."""
    keys = ["project_id", "list", "block"]
    tasks = max(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * lists // VISITS)
    asked = visits.repartition(tasks, *keys).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // ASKED))).cast("long")))
    asked = asked.groupBy(*keys, "part").agg(F.collect_list(F.struct("query_id", "emb", "bar")).alias("asked"))
    met = index.blocks.select(*keys, "ids", "vectors").join(asked, keys).select("ids", "vectors", "asked")
    return met.mapInArrow(_scored(k), "query_id long, item_id long, cosine double")


def search(index: VectorIndex, queries: DataFrame, k: int = 50, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(query_id, item_id, cosine, dense_rank): the k nearest other items of the project for each query (query_id, project_id, emb),
    equal cosines (of six digits) by descending id. ``exact`` asks all blocks that may hold one of them, else only the ``probes``
    nearest lists are asked."""
    spark = queries.sparkSession
    if index.centroids is None:
        return spark.createDataFrame([], "query_id long, item_id long, cosine double, dense_rank int")
    n = queries.count()
    space, order = index.space, [F.desc("cosine"), F.desc("item_id")]
    emb = queries.schema["emb"].dataType.simpleString()
    asked = with_direction(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("project_id").cast("long").alias("project_id"), "emb"))
    near = lambda rows, most: rows.mapInArrow(_ordered(index.centroids, most), f"query_id long, project_id long, emb {emb}, list int, angle double, place int")
    heads = index.blocks.select("project_id", "list", "block", "least", "most")
    visits = near(asked, probes).join(heads, ["project_id", "list"]).select("query_id", "emb", F.lit(-2.0).alias("bar"), "project_id", "list", "block")
    found = space.write(_visited(index, visits, n, probes, k), "found")
    if exact:
        # the k-th best so far; none where there are fewer
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("cosine"), asc=False), k)).alias("bar"))
        angles = near(asked, len(index.centroids)).where(F.col("place") >= probes)
        apart = F.greatest(F.lit(0.0), F.col("angle") - F.col("most"), F.col("least") - F.col("angle"))
        more = angles.join(heads, ["project_id", "list"]).join(least, "query_id", "left").where(F.col("bar").isNull() | (F.cos(apart) + SLACK >= F.col("bar")))
        found = found.union(_visited(index, more.select("query_id", "emb", F.coalesce("bar", F.lit(-2.0)).alias("bar"), "project_id", "list", "block"), n, len(index.centroids), k))
    return top_k(found.withColumn("cosine", F.round("cosine", 6)), ["query_id"], order, k, "dense_rank")


def probes_for(index: VectorIndex, queries: DataFrame, k: int = 50, recall: float = 0.93, sample: int = 64) -> int:
    """The fewest lists in which ``recall`` of the k nearest lie, measured by exact search for about ``sample`` queries: vectors that
    lie in groups need few lists, vectors without any need most."""
    if index.centroids is None:
        return PROBES
    n = queries.count()
    few = queries.select("query_id", "project_id", "emb").where(F.pmod(F.xxhash64("query_id"), F.lit(max(n, 1)).cast("long")) < sample)
    emb = queries.schema["emb"].dataType.simpleString()
    places = with_direction(few).mapInArrow(_ordered(index.centroids, len(index.centroids)), f"query_id long, project_id long, emb {emb}, list int, angle double, place int").select("query_id", "list", "place")
    at = search(index, few, k).join(index.lists, "item_id").join(places, ["query_id", "list"]).agg(F.percentile("place", recall)).first()[0]
    return PROBES if at is None else math.ceil(at) + 1


def comparisons(index: VectorIndex, queries: DataFrame, probes: int = PROBES) -> DataFrame:
    """(query_id, compared): with how many vectors a search of so many lists compares each query."""
    emb = queries.schema["emb"].dataType.simpleString()
    asked = with_direction(queries.select("query_id", "project_id", "emb"))
    near = asked.mapInArrow(_ordered(index.centroids, probes), f"query_id long, project_id long, emb {emb}, list int, angle double, place int")
    return near.join(index.blocks.select("project_id", "list", "n"), ["project_id", "list"]).groupBy("query_id").agg(F.sum("n").alias("compared"))
