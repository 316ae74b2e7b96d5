"""Near duplicates of embeddings by lattice hashing.

Unit vectors are projected at random onto blocks of eight dimensions, shifted and decoded to the nearest point of the E8 lattice;
the points of a table's blocks are its cell. A vector is stored in its own cell of each table and also probes the neighbouring
cells whose points are next nearest. Vectors that meet in a cell are compared by cosine. Equal vectors are one class, so copies
meet as one. Cells in which nothing meets go before any vector is moved; large ones are compared in blocks, and a task emits one
row for each linked vector, not for each pair. Links are then counted inside the components found, again block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix
from .storage import Workspace

_U = np.uint64
#: Vectors of a cell or component that one side of a task holds at most.
BLOCK = 2048
#: A block holds so many times the root of its group, but so many vectors at least: cells tell a row for each visit of a linked
#: vector, so theirs are larger; components tell one number a vector.
OF_CELLS, OF_COMPONENTS = (4, 128), (2, 64)


def blocks(n: Column, times: int, least: int) -> Column:
    """Into how many blocks a group of n vectors is cut: a block grows with the root of the group, so that neither one task nor
    the number of visits of a vector grows as the group does, until blocks are full."""
    return F.ceil(n / F.least(F.lit(BLOCK), F.greatest(F.lit(least), F.ceil(times * F.sqrt(n))))).cast("int")


@dataclass(frozen=True)
class Lattice:
    """``tables`` of ``blocks`` E8 blocks each, ``probes`` neighbouring cells a table; ``scale`` stretches the unit vectors'
    projections. The defaults find 0.99 of the pairs at cosine 0.9 and all but a few at 0.95 and more."""

    tables: int = 8
    blocks: int = 2
    probes: int = 3
    scale: float = 3.0
    seed: int = 17


def roots() -> np.ndarray:
    """The 240 least vectors of E8, by the rule that makes them."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(whole + halves, float)


ROOTS = roots()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: where rounding gives an odd sum, the worst coordinate goes the other way."""
    near = np.rint(y)
    error = y - near
    worst = np.abs(error).argmax(1)
    rows = np.arange(len(y))
    odd = near.sum(1) % 2 != 0
    near[rows, worst] += np.where(odd, np.where(error[rows, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: integers of even sum, or those shifted by one half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Keys of shape (vectors, tables, 1 + probes), the own cell first."""
    n, d = unit.shape
    rng = np.random.default_rng((lattice.seed, d))
    out = np.empty((n, lattice.tables, 1 + lattice.probes), _U)
    for t in range(lattice.tables):
        turn = rng.normal(size=(d, 8 * lattice.blocks)) / np.sqrt(d) * lattice.scale
        y = unit @ turn + rng.uniform(size=8 * lattice.blocks)
        points = np.concatenate([nearest(y[:, i : i + 8]) for i in range(0, y.shape[1], 8)], 1)
        weight = mix(np.arange(1, y.shape[1] + 1, dtype=_U) + _U(1000 * (t + 1)) + _U(d) * _U(0x9E3779B97F4A7C15))
        twice = (2 * points).astype(np.int64).view(_U)
        out[:, t, 0] = (twice * weight).sum(1) + weight[0]
        # how much farther each neighbour of each block's point lies
        farther = np.concatenate([2 - 2 * ((y[:, i : i + 8] - points[:, i : i + 8]) @ ROOTS.T) for i in range(0, y.shape[1], 8)], 1)
        best = np.argpartition(farther, lattice.probes, 1)[:, : lattice.probes]
        for k in range(lattice.probes):
            block, root = np.divmod(best[:, k], len(ROOTS))
            step = (2 * ROOTS[root]).astype(np.int64).view(_U)
            out[:, t, 1 + k] = out[:, t, 0] + (step * weight.reshape(-1, 8)[block]).sum(1)
    return mix(out)


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a batch's lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(lengths))), values


def _by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length in a batch."""
    at, values = _vectors(column)
    lengths = np.diff(at)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        v = values[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d).astype(float)
        v /= np.abs(v).max(1, keepdims=True)
        yield rows, v / np.sqrt((v * v).sum(1, keepdims=True))


def _keys(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in _by_length(batch.column(1)) if batch.num_rows else ():
                ids = batch.column(0).to_numpy()[rows]
                for i in range(0, len(ids), 2048):
                    k = cells(unit[i : i + 2048], lattice)
                    per = k.shape[1] * k.shape[2]
                    own = np.zeros(k.shape, bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(own.reshape(-1)), pa.array(np.repeat(ids[i : i + 2048], per))], ["key", "own", "id"])

    return run


def _groups(handle: Callable[[pa.Table], pa.RecordBatch | None]):
    """Applies ``handle`` to the rows of each (key, i, j); rows come in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and tuple(at[x]) != last:
                    if (out := handle(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = tuple(at[x])
                held.append(batch.slice(x, y - x))
        if held and (out := handle(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, i, j, unit vectors) of a group; its vectors have one length."""
    unit = np.empty((0, 0))
    for _, unit in _by_length(t.column("v")):
        pass
    return t.column("block").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py(), unit


def _linked(least: float):
    """Of a cell's rows (key, i, j, block, own, id, v): (a, b) that join every linked vector to the least of its component here."""

    def handle(t: pa.Table) -> pa.RecordBatch | None:
        block, i, j, unit = _sides(t)
        own, ids = t.column("own").to_numpy(), t.column("id").to_numpy()
        pairs = [(np.flatnonzero(~own & (block == x)), np.flatnonzero(own & (block == y))) for x, y in ([(i, j)] if i == j else [(i, j), (j, i)])]
        # vectors stored in the same cell meet too
        pairs.append((np.flatnonzero(own & (block == i)), np.flatnonzero(own & (block == j))))
        label = ids.copy()
        met = [(p, q, (unit[p] @ unit[q].T >= least) & (ids[p][:, None] != ids[q][None, :])) for p, q in pairs if len(p) and len(q)]
        met = [(p, q, m) for p, q, m in met if m.any()]
        if not met:
            return None
        most = np.iinfo(np.int64).max
        while True:
            before = label.copy()
            for p, q, m in met:
                label[p] = np.minimum(label[p], np.where(m, label[q][None, :], most).min(1))
                label[q] = np.minimum(label[q], np.where(m, label[p][:, None], most).min(0))
            if (label == before).all():
                break
        out = np.flatnonzero(label != ids)
        return pa.RecordBatch.from_arrays([pa.array(label[out]), pa.array(ids[out])], ["a", "b"])

    return _groups(handle)


def _counted(least: float):
    """Of a component's rows (key, i, j, block, id, copies, v): (id, n), the linked vectors between its blocks i and j."""

    def handle(t: pa.Table) -> pa.RecordBatch | None:
        block, i, j, unit = _sides(t)
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        m = (unit[p] @ unit[q].T >= least) & (ids[p][:, None] != ids[q][None, :])
        rows = [(ids[p], m @ copies[q])] + ([(ids[q], copies[p] @ m)] if i != j else [])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in rows])), pa.array(np.concatenate([n for _, n in rows]))], ["id", "n"])

    return _groups(handle)


def _dealt(rows: DataFrame, sizes: DataFrame, *names: str) -> DataFrame:
    """Rows (key, id, ...) dealt over pairs of blocks of their key."""
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *names)


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, lattice: Lattice = Lattice(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    Two vectors link at a cosine of ``cosine`` or more, in double precision; n_links is the number of other rows linked directly,
    component_id the least key reachable by links, and kept if that is the row's own. A vector that is null, empty or zero, or
    holds a null or a component that isn't finite, links with nothing. Vectors of different lengths don't link. Rows of one key
    are vectors of their own; a null key counts as the least and is returned as null. An empty table gives an empty table; other
    columns are left out. Links never join vectors below ``cosine``; a component may miss a link that no table brings together.
    """
    space = Workspace(vectors.sparkSession, "embedding-dedup")
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("id"), F.when(usable, F.col(f"`{vector}`")).alias("v"))
    rows = rows.select("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.xxhash64(F.lit("vector"), "v").alias("h2"), "v")
    classes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # a class is named by its place in this table; least keys come back at the end
    classes = space.write(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "rep", "copies", "v"), "classes")
    keys = space.write(classes.select("id", "v").mapInArrow(_keys(lattice), "key long, own boolean, id long"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("stored")).where("n > 1 AND stored > 0")
    sizes = space.write(sizes.select("key", blocks(F.col("n"), *OF_CELLS).alias("blocks")), "sizes")
    dealt = _dealt(keys, sizes, "own", "id").join(classes.select("id", "v"), "id").select("key", "i", "j", "block", "own", "id", "v")
    links = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked(cosine), "a long, b long").distinct()
    linked = components(space.write(links, "links"), space)
    members = space.write(linked.withColumnRenamed("component", "key"), "members")
    sizes = space.write(members.groupBy("key").agg(blocks(F.count("*"), *OF_COMPONENTS).alias("blocks")), "sizes")
    inside = _dealt(members, sizes, "id").join(classes.select("id", "copies", "v"), "id").select("key", "i", "j", "block", "id", "copies", "v")
    counts = inside.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_counted(cosine), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    named = members.join(classes.select("id", "rep"), "id").groupBy("key").agg(F.min("rep").alias("component"))
    named = members.join(space.write(named, "named"), "key").select("id", "component")
    known = classes.drop("v").join(space.write(counts, "counts"), "id", "left").join(space.write(named, "components"), "id", "left")
    known = space.write(known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "known")
    found = rows.drop("v").join(known, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    shown: Callable[[Column], Column] = lambda c: F.when(c != -(2**63), c)
    return found.select(shown(F.col("id")).alias(key), "n_links", shown(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
