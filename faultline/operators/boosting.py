"""Multiclass gradient boosting by distributed histograms.

Features are binned once, at quantiles. A round grows a tree for each class on the gradients of the softmax loss. A pass over the
rows sums gradients and curvatures by (class, leaf, feature, bin) inside each partition, and one aggregate adds up the partitions'
histograms; the driver sees these sums only, whose number depends on leaves, features and bins and not on rows. Trees grow by
leaves: in each pass those of the greatest gain are split, ``batch`` at a time (1: strictly the best first). Rows are routed
through the trees of the round as they are read, and their scores are written once a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.shared import Scratch


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    leaves: int = 31
    rate: float = 0.05
    bins: int = 63
    least_rows: int = 1  # of a leaf
    least_curvature: float = 1e-3
    ridge: float = 1.0
    batch: int = 8


@dataclass
class Tree:
    """Splits as (leaf, feature, bin): rows of the leaf above the bin become a new leaf, whose number is one more than the last's."""

    splits: list[tuple[int, int, int]] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for k, (leaf, feature, cut) in enumerate(self.splits):
            at[(at == leaf) & (bins[:, feature] > cut)] = k + 1
        return at


@dataclass
class Boosted:
    """Classes, the edges of each feature's bins, the first scores, and for each round a tree for each class."""

    classes: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        scores = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                scores[:, k] += tree.values[tree.leaf(bins)]
        return softmax(scores)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    k = scores.shape[1]
    return g * weight[:, None], p * (1 - p) * weight[:, None] * (k / (k - 1))


def best_split(histogram: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a leaf's histogram [feature, bin, (g, h, n)]; the first of equals."""
    left = histogram.cumsum(1)
    total = left[:, -1:, :]
    right = total - left
    part = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.ridge)
    gain = part(left) + part(right) - part(total)
    ok = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows) & (left[..., 1] >= s.least_curvature) & (right[..., 1] >= s.least_curvature)
    gain = np.round(np.where(ok, gain, 0.0), 9)
    at = int(gain.argmax())
    return None if gain.flat[at] <= 0 else (float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1])


def grown(tree: Tree, found: dict[int, tuple[float, int, int] | None], s: Settings) -> list[int]:
    """Splits the leaves of the greatest gain; the leaves that have no histogram now."""
    order = sorted((-f[0], leaf) for leaf, f in found.items() if f)
    fresh = []
    for _, leaf in order[: min(s.batch, s.leaves - 1 - len(tree.splits))]:
        _, feature, cut = found.pop(leaf)
        tree.splits.append((leaf, feature, cut))
        fresh += [leaf, len(tree.splits)]
    return fresh


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), np.float64)
            bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(edges)), int)
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.uint8).tobytes() for r in bins], pa.binary()), *b.columns[1:]], ["bins", "label", "weight", "scores"])

    return run


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int64)
    return bins, b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), np.float64)


def _histograms(trees: list[Tree], wanted: list[list[int]], width: int):
    """(class, leaf, histogram) of a partition's rows, for the wanted leaves of each class's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            bins, label, weight, scores = _rows(b)
            g, h = gradients(scores, label, weight)
            n_features = bins.shape[1]
            cell = bins + np.arange(n_features) * width
            for k, tree in enumerate(trees):
                leaf = tree.leaf(bins) if wanted[k] else None
                for at in wanted[k]:
                    own = leaf == at
                    flat = cell[own].ravel()
                    one = [np.bincount(flat, np.repeat(x, n_features), n_features * width) for x in (g[own, k], h[own, k], np.ones(int(own.sum())))]
                    sums[k, at] = sums.get((k, at), 0) + np.stack(one, 1)
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([x for _, x in keys], pa.int32()), pa.array([sums[x].ravel() for x in keys], pa.list_(pa.float64()))], ["class", "leaf", "histogram"])

    return run


def _stepped(trees: list[Tree]):
    """The rows with the scores after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, _, _, scores = _rows(b)
                scores = scores + np.stack([t.values[t.leaf(bins)] for t in trees], 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(scores), pa.list_(pa.float64()))], ["bins", "label", "weight", "scores"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (class, leaf, part, histogram) in order: one row for each (class, leaf, part). Holds one histogram."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["class", "leaf", "part", "histogram"])

    for b in batches:
        for k in range(b.num_rows):
            at = tuple(b.column(c)[k].as_py() for c in range(3))
            one = b.column(3)[k].values.to_numpy()
            if at != key:
                if key is not None:
                    yield out()
                key, total = at, np.zeros(len(one))
            total = total + one
    if key is not None:
        yield out()


#: Into how many sums the partitions' histograms are added up first.
PARTS = 64


def _summed(rows: DataFrame, trees: list[Tree], wanted: list[list[int]], shape: tuple[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """The histograms of all rows: those of the partitions are added up in parts, then the parts."""
    schema, keys = "class int, leaf int, part int, histogram array<double>", ("class", "leaf", "part")
    found = rows.mapInArrow(_histograms(trees, wanted, shape[1]), "class int, leaf int, histogram array<double>")
    found = found.select("class", "leaf", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"), "histogram")
    for _ in range(2):
        found = found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, schema).select("class", "leaf", F.lit(0).alias("part"), "histogram")
    return {(r["class"], r["leaf"]): np.array(r["histogram"]).reshape(*shape, 3) for r in found.collect()}


def boost(rows: DataFrame, settings: Settings = Settings()) -> Boosted | None:
    """Fits (features array<double>, label string); classes by name, weighted so that they count alike. None with fewer than two
    classes. Rows without features or label are left out; the number of classes, features and bins is bounded, that of rows isn't."""
    ship(rows.sparkSession)
    known = rows.where("label IS NOT NULL AND size(features) > 0").select("features", "label")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    if len(classes) < 2:
        return None
    space, s = Scratch(rows.sparkSession, "boosting"), settings
    steps = [k / (s.bins + 1) for k in range(1, s.bins + 1)]
    cuts = known.select(F.posexplode("features").alias("f", "x")).groupBy("f").agg(F.percentile_approx("x", steps, 10_000).alias("cuts")).collect()
    edges = [np.unique(np.array(r["cuts"], float)) for r in sorted(cuts)]
    width = max(len(e) for e in edges) + 1
    total = sum(counts.values())
    number = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)])[F.col("label")]
    weight = F.create_map(*[F.lit(x) for c in classes for x in (c, total / (len(classes) * counts[c]))])[F.col("label")]
    model = Boosted(classes, edges, np.zeros(len(classes)), [])
    start = F.array(*[F.lit(0.0)] * len(classes))
    prepared = known.select("features", number.cast("long").alias("label"), weight.alias("weight"), start.alias("scores"))
    schema = "bins binary, label long, weight double, scores array<double>"
    state = space.write(prepared.mapInArrow(_binned(edges), schema), "state-0")
    for turn in range(1, s.rounds + 1):
        trees = [Tree() for _ in classes]
        wanted, found, sums = [[0] for _ in classes], [{} for _ in classes], {}
        while any(wanted):
            fresh = _summed(state, trees, wanted, (len(edges), width))
            sums |= fresh
            for k, leaf in fresh:
                found[k][leaf] = best_split(fresh[k, leaf], s)
            wanted = [grown(t, f, s) for t, f in zip(trees, found, strict=True)]
            # leaves that no longer grow need no histogram but their sums, which their last pass gives
        for k, tree in enumerate(trees):
            of = [sums[k, leaf][0].sum(0) for leaf in range(len(tree.splits) + 1)]
            tree.values = np.array([-s.rate * x[0] / (x[1] + s.ridge) for x in of])
        model.rounds.append(trees)
        if turn < s.rounds:
            state = space.write(state.mapInArrow(_stepped(trees), schema), f"state-{turn}")
            space.remove(f"state-{turn - 1}")
    space.remove(*space.paths)
    return model


def predict(model: Boosted, rows: DataFrame) -> DataFrame:
    """The rows with ``probs`` (a map over classes, summing to 1), ``guess`` and ``max_prob``; of equals the first class by name."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def shares(features: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in features:
            yield pa.array(list(model.probabilities(_matrix(batch, np.float64))) if len(batch) else [], pa.list_(pa.float64()))

    labels = F.array(*[F.lit(c) for c in model.classes])
    top = F.array_position("shares", F.array_max("shares")).cast("int")
    return rows.withColumn("shares", shares("features")).select(*rows.columns, F.map_from_arrays(labels, F.col("shares")).alias("probs"), F.element_at(labels, top).alias("guess"), F.array_max("shares").alias("max_prob"))
