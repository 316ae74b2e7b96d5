"""Jaccard self-join of documents on word shingles by parity sketches.

A document's shingles are dealt by hash over the segments of its size band's sketch; each shingle XORs its bit pattern into the
word of its segment. Two sets that differ in d shingles differ in at most d words, and in at most d bits of a one-bit-a-shingle
sketch, so a similarity bound gives a bound D on both for each size band. Pigeonhole: of m words at least m - D agree, so any
D + 1 words taken in an order that both documents share hold an equal one. The order takes the words of most shingles first,
which are the rarest. Candidates that share a word are checked by the Hamming distance of bit sketches, then on the sets. A
sketch grows with its set, as one of far fewer bits than shingles tells nothing: else any two long documents with a passage in
common would be checked on their sets, and those pairs grow with the square of the documents.

Sets that are equal are one class, represented by its least id. In a bucket of documents with an equal word, each is first
compared with one member only; components of these links then leave few pairs, those of different components, to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix, shingle_sets
from .storage import Workspace

_U = np.uint64
#: Bits of the sketch whose Hamming distance is compared in buckets, where a document stands once a key: the least and the most.
SKETCH_BITS, MOST_BITS = 512, 4096
#: Larger buckets are compared in blocks of about so many members.
BLOCK = 2048


class Bands:
    """Size bands, each half as wide again as the one before, and the bound of each on the symmetric difference."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 3 // 2))

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, D) of the bands in which a set of n shingles meets others: its own, and those whose largest sets it may match."""
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        found = []
        for band in range(own, -1, -1):
            most = self.lows[band + 1] - 1
            if band < own and n * self.similarity > most:
                break
            # the smaller set has at most `most` shingles: D is largest where it lies in one of most / similarity
            found.append((band, int(most * (1 - self.similarity) / self.similarity)))
        return found


def signature(s: np.ndarray, band: int, d: int) -> np.ndarray:
    """The D + 1 keys of a set (sorted hashes) in a band."""
    m = d + 1 + (3 * (d + 1) + 9) // 10
    segment = ((s >> _U(32)) * _U(m)) >> _U(32)  # rises with the hash, so a segment's shingles lie together
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    counts = np.diff(np.append(starts, len(s)))
    word = np.zeros(m, _U)
    number = np.zeros(m, np.int64)
    at = segment[starts].astype(np.int64)
    word[at] = np.bitwise_xor.reduceat(mix(s ^ _U(0x5851F42D4C957F2D)), starts)
    number[at] = counts
    key = mix(mix(word + _U(band) * _U(0x9E3779B97F4A7C15)) + np.arange(m, dtype=_U))
    return key[np.lexsort((key, -number))[: d + 1]]


def sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch of a power of two of bits, one a shingle or more."""
    n = max(SKETCH_BITS, 1 << max(len(s) - 1, 0).bit_length())
    bits = np.bincount((mix(s ^ _U(0x2545F4914F6CDD1D)) >> _U(32)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).view(_U)


def folded(sketches: np.ndarray, k: int) -> np.ndarray:
    """Sketches (in the last axis) as those of k words that the same sets have."""
    return np.bitwise_xor.reduce(sketches.reshape(*sketches.shape[:-1], -1, k), axis=-2)


def _aligned(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of as many words as the shortest has."""
    words = np.array([len(x) // 8 for x in sketches])
    k = int(words.min())
    rows = np.empty((len(sketches), k), _U)
    for n in np.unique(words):
        at = np.flatnonzero(words == n)
        rows[at] = folded(np.frombuffer(b"".join([sketches[i] for i in at]), _U).reshape(len(at), n), k)
    return rows


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, h1, h2, sk, wide = [], [], [], [], []
                for s in shingle_sets(batch.column(1), width):
                    n.append(len(s))
                    m = mix(s)
                    h1.append(int((m.sum() + _U(len(s))).astype(np.int64)) if len(s) else 0)
                    h2.append(int(np.bitwise_xor.reduce(mix(m + _U(77))).astype(np.int64)) if len(s) else 0)
                    whole = sketch(s)
                    k = min(max(len(whole) // 2, SKETCH_BITS // 64), MOST_BITS // 64)
                    sk.append(folded(whole, k).tobytes())
                    wide.append(whole.tobytes() if k < len(whole) else None)
                columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in (n, h1, h2)], *[pa.array(c, pa.binary()) for c in (sk, wide)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "sketch", "wide"])

    return run


def _signatures(width: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for batch in batches:
            keys, owners = [], []
            for s in shingle_sets(batch.column(1), width) if batch.num_rows else ():
                if len(s):
                    own = mix(s).sum() + _U(len(s))
                    for band, d in bands.of(len(s)):
                        if d:  # with D = 0 only equal sets match
                            keys.append(signature(s, band, d))
                            owners.append(np.full(d + 1, own, _U))
            if keys:
                k, o = np.concatenate(keys), np.concatenate(owners)
                order = np.lexsort((o, k))  # copies within the batch are one row
                k, o = k[order], o[order]
                new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
                k, o = k[new].view(np.int64), o[new].view(np.int64)
                for i in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(o[i : i + (1 << 16)])], ["key", "h1"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, h1) in order: (key, first, h1) of the keys with two values of h1 or more. Holds one row between batches."""
    key = first = last = None
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate(([key is None or k[0] != key or c[0] != last], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        k, c = k[new], c[new]
        if not len(k):
            continue
        if key is not None and not told:
            k, c = np.concatenate(([key], k)), np.concatenate(([first], c))
        elif key is not None and k[0] == key:
            # the run goes on and its first rows have been told
            k, c = np.concatenate(([key], k)), np.concatenate(([first], c))
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(k)))
        firsts = np.repeat(c[starts], sizes)
        many = np.repeat(sizes > 1, sizes)
        skip = 1 if told and key is not None and k[0] == key else 0
        out = np.flatnonzero(many)
        out = out[out >= skip]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(firsts[out]), pa.array(c[out])], ["key", "first", "h1"])
        key, first, last, told = k[-1], firsts[-1], c[-1], bool(many[-1])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], ["id", "s"])

    return run


def _near(p: int, q: int):
    """Of rows (a, b, na, nb, wa, wb): the pairs (a, b) whose sizes and whole sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in (2, 3)), batch.column(4), batch.column(5), strict=True):
                near = p * max(n, m) <= q * min(n, m)
                if near:
                    x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                    k = min(len(x), len(y))
                    near = int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum()) * (q + p) <= (q - p) * (n + m)
                good.append(near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(p: int, q: int):
    """Of rows (a, b, sa, sb): the pairs (a, b) with q * intersection >= p * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(q * same >= p * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _crossing(p: int, q: int, forest: bool):
    """Of rows (key, i, j, block, a, component, n, sketch) in order of (key, i, j): pairs of different components in the blocks
    i and j whose sizes and sketches allow a link. For a forest, a pair counts as a link at once, so that further pairs of what
    it joins are left out."""

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        i, j, block, a, comp, n = (t.column(c).to_numpy() for c in ("i", "j", "block", "a", "component", "n"))
        comp = comp.copy()
        bits = _aligned(t.column("sketch").to_pylist())
        left = np.flatnonzero(block == i[0])
        right = np.flatnonzero(block == j[0])
        found = []
        for x in left:
            r = right[right > x] if i[0] == j[0] else right
            r = r[(comp[r] != comp[x]) & (p * np.maximum(n[r], n[x]) <= q * np.minimum(n[r], n[x]))]
            if len(r):
                # |A ^ B| <= (q - p) / (q + p) * (|A| + |B|)
                apart = np.bitwise_count(bits[r] ^ bits[x]).sum(1)
                near = apart.astype(np.int64) * (q + p) <= (q - p) * (n[r] + n[x])
                r, apart = r[near], apart[near]
                if len(r) and forest:
                    r = r[np.argsort(apart, kind="stable")]
                    r = r[np.unique(comp[r], return_index=True)[1]]  # the nearest of each component
                    comp[np.isin(comp, comp[r])] = comp[x]
                if len(r):
                    found.append(np.stack((np.minimum(a[r], a[x]), np.maximum(a[r], a[x])), 1))
        if found:
            ab = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])
        return None

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
                    if (out := pairs(held)) is not None:
                        yield out
                    held = []
                last = tuple(at[x])
                held.append(batch.slice(x, y - x))
        if held and (out := pairs(held)) is not None:
            yield out

    return run


def ngram_join(docs: DataFrame, similarity: Fraction = Fraction(4, 5), width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``: groups of documents linked by their shingles' Jaccard similarity.

    Shingles are ``width`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a shorter text's words are one shingle. Two documents
    link if |A & B| / |A | B| >= ``similarity``, which is decided exactly on 64-bit shingle hashes. A text that is null or has no
    words has an empty set and links with nothing; its component is its own id. Rows of one id are one document, which links if any of
    its texts does; each row is returned. Rows of a null id are such a document, of an id below all others (null again in the
    result). An empty table gives an empty table; other columns are left out.
    """
    space = Workspace(docs.sparkSession, "ngram-join")
    p, q = similarity.numerator, similarity.denominator
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = space.write(rows.mapInArrow(_fingerprints(width), "id long, n long, h1 long, h2 long, sketch binary, wide binary"), "prints")
    classes = space.write(prints.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide")), "classes")
    signatures = rows.mapInArrow(_signatures(width, similarity), "key long, h1 long")
    shared = space.write(signatures.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(_shared, "key long, first long, h1 long"), "shared")
    # one class a hash in practice; should two classes have the same, both become candidates
    by_hash = classes.select("h1", "rep")
    stars = shared.where("first <> h1").select("first", "h1").distinct()
    stars = stars.join(by_hash.withColumnRenamed("rep", "b"), "h1").join(by_hash.select(F.col("h1").alias("first"), F.col("rep").alias("a")), "first")
    twins = classes.groupBy("h1").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    stars = space.write(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(twins).distinct(), "stars")
    repeated_ids = bool(prints.groupBy("id").count().where("count > 1").limit(1).count())

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, written. Sets are made and moved for those pairs only whose sketches allow a link."""
        wide = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("wide", "sketch").alias(f"w{c}"))
        near = pairs.join(wide("a"), "a").join(wide("b"), "b").select("a", "b", "na", "nb", "wa", "wb")
        near = space.write(near.mapInArrow(_near(p, q), "a long, b long").distinct(), "near")
        involved = space.write(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "involved")
        sets = _sets_of(rows, involved, width)
        if repeated_ids:  # repeated rows give one set
            sets = sets.groupBy("id", F.xxhash64("s").alias("h")).agg(F.first("s").alias("s"))
        sets = space.write(sets, "sets")
        both = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        found = space.write(both.select("a", "b", "sa", "sb").mapInArrow(_verified(p, q), "a long, b long"), name)
        space.remove("near", "involved", "sets")
        return found

    links = verified(stars, "links")
    if repeated_ids:  # the texts of one id are one document, so their classes are linked
        of_id = prints.where("n > 0").select("id", "n", "h1", "h2").distinct().join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("id", "rep")
        least = of_id.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a")
        links = links.union(space.write(of_id.join(least, "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "same-id"))
    linked = components(links, space)
    # pairs in a bucket that are in different components still: first a forest of the nearest, which joins most that can be
    # joined, then all that are left
    tried = stars
    for forest in (True, False):
        members = shared.select("key", "h1").join(classes.select("h1", F.col("rep").alias("a")), "h1").join(linked.withColumnRenamed("id", "a"), "a", "left")
        members = space.write(members.select("key", "h1", "a", F.coalesce("component", "a").alias("component")), "members")
        mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y")
        mixed = space.write(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
        # sketches are fetched last, so that one shuffle moves them
        dealt = members.join(mixed, "key").join(classes.select("h1", F.col("rep").alias("a"), "n", "sketch"), ["h1", "a"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "component", "n", "sketch")
        crossing = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_crossing(p, q, forest), "a long, b long").distinct()
        crossing = space.write(crossing.join(tried, ["a", "b"], "left_anti"), "crossing")
        tried = tried.union(crossing)
        space.remove("members", "mixed")
        links = links.union(verified(crossing, "more"))
        linked = components(links, space)
    groups = space.write(classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")), "groups")
    found = prints.join(groups, ["n", "h1", "h2"], "left")
    shown = lambda c: F.when(c != -(2**63), c)
    return found.select(shown(F.col("id")).alias(key), F.col("n").alias("n_shingles"), shown(F.coalesce("component", "id")).alias("component_id"))


def _sets_of(rows: DataFrame, involved: DataFrame, width: int) -> DataFrame:
    """(id, s) of the involved ids. Spark broadcasts the ids while they are small, and else joins by a shuffle."""
    return rows.join(involved, "id", "left_semi").select("id", "text").mapInArrow(_sets(width), "id long, s binary")
