"""Removal of repeated substrings by ranks of chosen positions, in place of the rounds of prefix doubling.

Prefix doubling sorts the rank pairs of all open positions at growing offsets, round after round; ``prefix_doubling`` below is that
form. It moves every position of the corpus up to nine times for 400 bytes (measured on 2.5 MB of text: 12.1 million ranked rows and
91 s), which no budget of disk bears, so ``suffix_dedup`` finds the same strings with few positions (same text: 9,085 spans, 25,051
positions and 15 s; the tests hold both against each other). What it keeps is the ranking: equal ranks are brought together by Spark,
unique ones go, and the rest is ranked again over a longer span.

Ranks are 64-bit fingerprints, so they can be named where the text is. The first are of half the threshold, for one position of each
window of as many: the window's least local hash, which equal windows choose alike. Each position of a repeated substring is bound to
the choice of its own window, so no repeat is missed. Chosen positions whose half is repeated are ranked over the whole span of the
positions bound to them; where that is repeated too, all of them are, and only the borders of repeats are ranked position by position
at the full length. There a task sends a rank that many of its positions share once.

The same is done, in the same sorts, over the sequence of words: a passage of so many words that stands elsewhere is reported
even where its bytes are fewer than the threshold of removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import BYTES, chunks, mix, powers, texts, word_hashes
from .storage import Workspace

_U = np.uint64
#: Symbols that the local hash of a position covers, for bytes and for words.
LOCAL = (16, 4)
#: The kinds of symbols; a row's number is even for its bytes and odd for its words.
OF_BYTES, OF_WORDS = 0, 1


def symbols(kind: int, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of some texts' symbols, side by side, and where each text begins and the last ends."""
    if kind == OF_BYTES:
        return BYTES[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    values, cuts = word_hashes(offsets, data)
    return values + _U(0x9E3779B97F4A7C15), cuts


class Ranks:
    """Fingerprints of the substrings of some texts' symbols."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(_U))


def least_of(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values side by side, by doubling."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def chosen(values: np.ndarray, cuts: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen position, first, last position bound to it) for texts that lie in ``values`` between ``cuts``.

    Position p, where ``length`` symbols of its text begin, is bound to the position of the least local hash (the first of
    equals; it covers ``reach`` symbols) among p, ..., p + length // 2.
    """
    width = length - length // 2 + 1
    none = np.zeros(0, np.int64)
    if len(values) < length:
        return none, none, none
    local, span = values, 1
    while span < reach:  # ranks of pairs at growing offsets
        local = mix(local[:-span] * _U(0x9E3779B97F4A7C15) + local[span:])
        span *= 2
    bits = max(len(values) - 1, 1).bit_length()
    least = least_of((local >> _U(bits) << _U(bits)) | np.arange(len(local), dtype=_U), width)
    at = (least & _U((1 << bits) - 1)).astype(np.int64)
    lengths = np.diff(cuts)
    ends = np.repeat(cuts[1:], lengths)[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) + length <= ends)
    if not len(p):
        return none, none, none
    a = at[p]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    return a[new], p[new], p[np.append(new[1:], len(p)) - 1]


def _chosen_rows(column, lengths: tuple[int, int]):
    """(kind, text numbers, chosen position, first, last within the text, rank of the half, rank of the span)."""
    offsets, data = texts(column)
    for i, j in chunks(offsets):
        for kind, length in enumerate(lengths):
            if not length:
                continue
            values, cuts = symbols(kind, offsets[i : j + 1], data)
            a, lo, hi = chosen(values, cuts, length, LOCAL[kind])
            if len(a):
                ranks = Ranks(values)
                half = ranks(a, a + length // 2)
                # positions bound to different places of equal spans must not meet
                whole = mix(ranks(lo, hi + length) + (a - lo).astype(_U) * _U(0xD6E8FEB86659FD93) + (hi - lo).astype(_U))
                doc = np.searchsorted(cuts, a, "right") - 1
                base = cuts[doc]
                yield kind, doc + i, a - base, lo - base, hi - base, half, whole


def _halves(lengths: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (found := [x[5] for x in _chosen_rows(batch.column(1), lengths)]):
                rank, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(n)], ["half", "n"])

    return run


def _spans(lengths: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).to_numpy()
                for kind, doc, _, lo, hi, half, whole in _chosen_rows(batch.column(1), lengths):
                    yield pa.RecordBatch.from_arrays([pa.array(half.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rows[doc] + kind), pa.array(lo), pa.array((hi - lo).astype(np.int32))], ["half", "whole", "row", "lo", "more"])

    return run


#: Positions that are ranked before repeats among them are looked for.
RANKED = 1 << 20


def _positions(lengths: tuple[int, int]):
    """Of rows (row, text, spans as kind, lo, more): (rank, row, p, sure) at the full length. Of positions that share a rank with
    another one ranked here all are sure to be repeats and are dealt anyhow, and one more row stands for them under their rank; so a
    rank that very many positions have is few rows."""

    def told(ranks: list[np.ndarray], rows: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rank, row, p = (np.concatenate(x) for x in (ranks, rows, places))
        _, first, at, n = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
        many = n[at] > 1
        one = np.concatenate((np.flatnonzero(~many), first[n > 1]))  # alone, or standing for others
        rank = np.concatenate((rank[one], mix((row[many] ^ (p[many] << 20)).view(_U)).view(np.int64)))
        row, p, sure = np.concatenate((row[one], row[many])), np.concatenate((p[one], p[many])), np.concatenate((np.zeros(len(one), np.int8), np.ones(int(many.sum()), np.int8)))
        for i in range(0, len(rank), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (rank, row, p, sure)], ["rank", "row", "p", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            offsets, data = texts(batch.column(1))
            for k, (row, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                of = spans.values.field("kind").to_numpy()
                for kind in np.unique(of).tolist():
                    ranks = Ranks(symbols(kind, offsets[k : k + 2], data)[0])
                    lo = spans.values.field("lo").to_numpy()[of == kind]
                    n = spans.values.field("more").to_numpy()[of == kind].astype(np.int64) + 1
                    for i in range(0, len(lo), 1024):  # a long text's spans at a time
                        m = n[i : i + 1024]
                        p = np.repeat(lo[i : i + 1024] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
                        for x, new in zip(held, (ranks(p, p + lengths[kind]).view(np.int64), np.full(len(p), row + kind), p), strict=True):
                            x.append(new)
                        size += len(p)
                        if size >= RANKED:
                            yield from told(*held)
                            held, size = ([], [], []), 0
        if size:
            yield from told(*held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (rank, row, p, sure) in order of rank: (row, p) of those that are sure, and of ranks with two other rows or more. Holds
    one row between batches."""
    held, told = None, True
    for batch in batches:
        sure = batch.filter(pa.compute.equal(batch.column(3), 1))
        if sure.num_rows:
            yield sure.select(["row", "p"])
        batch = batch.filter(pa.compute.equal(batch.column(3), 0))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        rank = batch.column(0).to_numpy()
        same = rank[1:] == rank[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if held is not None and told:
            many[0] = False
        out = batch.filter(pa.array(many))
        if out.num_rows:
            yield out.select(["row", "p"])
        told = bool(many[-1]) or (len(rank) == 1 and held is not None and told)
        held = batch.slice(batch.num_rows - 1, 1)


def _covered(lo: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Which of n symbols lie in the spans."""
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(z, minlength=n + 1))[:n] > 0


def _kept(name: str):
    """Of rows (key, text, spans as kind, lo, z): (key, n_bytes, n_removed, n_spans, kept, n_passage_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(1))
            rows: list[tuple] = []
            for k, spans in enumerate(batch.column(2)):
                b = data[offsets[k] : offsets[k + 1]]
                if not spans.is_valid or not len(spans.values):
                    rows.append((len(b), 0, 0, b.tobytes(), 0))
                    continue
                kind, lo, z = (spans.values.field(c).to_numpy() for c in ("kind", "lo", "z"))
                words = kind == OF_WORDS
                in_passages = int(_covered(lo[words], z[words], int(z[words].max())).sum()) if words.any() else 0
                gone = _covered(lo[~words], z[~words], len(b))
                runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(b), int(gone.sum()), runs, b[~gone].tobytes(), in_passages))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], [name, "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, passage_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, n_passage_words) for each row of ``docs``; ``kept`` is the bytes left, joined.

    A byte goes if a string of ``length`` bytes that covers it also begins anywhere else, in this text or another, overlapping
    or not; all is judged on the texts as given. Texts are their UTF-8 bytes (null: none) and strings never cross texts.
    n_passage_words counts the words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) that stand in ``passage_words`` words in a row which
    also begin anywhere else; they are reported, not removed (0 for ``passage_words`` leaves them out: 0 words are reported).
    ``length`` is 32 at least, ``passage_words`` 8 or 0. Repeated rows are texts of their own, so a repeated row of ``length``
    bytes or more loses all. Null keys are kept; an empty table gives an empty table; other columns are left out. A row is known
    by a 63-bit hash of its key and text, whatever the order or the file splits it is read in; rows of equal key and text have
    equal results. Equality of strings is that of 64-bit fingerprints.
    """
    if length < 2 * LOCAL[OF_BYTES] or passage_words and passage_words < 2 * LOCAL[OF_WORDS]:
        raise ValueError(f"length must be {2 * LOCAL[OF_BYTES]} at least, passage_words {2 * LOCAL[OF_WORDS]} or 0")
    space, lengths = Workspace(docs.sparkSession, "suffix-dedup"), (length, passage_words)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    named = named.select(F.xxhash64("key", "text").bitwiseAND(-2).alias("row"), "text", "key")
    rows = named.select("row", "text")
    halves = rows.mapInArrow(_halves(lengths), "half long, n long").groupBy("half").agg(F.sum("n").alias("n")).where("n > 1").select("half")
    halves = space.write(halves, "halves")
    spans = rows.mapInArrow(_spans(lengths), "half long, whole long, row long, lo long, more int").join(halves, "half")
    spans = space.write(spans.select("half", "whole", "row", "lo", "more"), "spans")
    space.remove("halves")
    wholes = spans.groupBy("half", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "more")).alias("first"))
    wholes = space.write(wholes, "wholes")
    size = F.when(F.col("row").bitwiseAND(1) == OF_WORDS, passage_words).otherwise(length)
    repeated = spans.join(wholes.where("n > 1").select("half", "whole"), ["half", "whole"])
    settled = space.write(repeated.select("row", "lo", (F.col("lo") + F.col("more") + size).alias("z")), "settled")
    space.remove("spans")
    # borders: spans of their own kind, and one of each repeated kind they may share single positions with
    open_halves = space.write(wholes.groupBy("half").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("half"), "open")
    base, kind = F.col("row").bitwiseAND(-2).alias("row"), F.col("row").bitwiseAND(1).cast("int").alias("kind")
    asked = wholes.join(open_halves, "half").select("first.row", "first.lo", "first.more").select(base, F.struct(kind, "lo", "more").alias("span"))
    asked = space.write(asked.groupBy("row").agg(F.collect_set("span").alias("spans")), "asked")
    space.remove("wholes", "open")
    positions = rows.join(asked, "row").select("row", "text", "spans").mapInArrow(_positions(lengths), "rank long, row long, p long, sure byte")
    positions = space.write(positions.repartition("rank").sortWithinPartitions("rank").mapInArrow(_repeated, "row long, p long"), "positions")
    gone = settled.union(positions.select("row", F.col("p").alias("lo"), (F.col("p") + size).alias("z"))).select(base, F.struct(kind, "lo", "z").alias("span"))
    # rows of one id and text have one number, under which a span counts once however many they are
    gone = space.write(gone.groupBy("row").agg(F.collect_set("span").alias("spans")), "gone")
    space.remove("settled", "asked", "positions")
    schema = T.StructType([T.StructField(key, named.schema["key"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("n_passage_words", T.LongType())])
    return named.join(gone, "row", "left").select("key", "text", "spans").mapInArrow(_kept(key), schema)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, p, rank) of every byte of (row, text)."""
    for batch in batches:
        offsets, data = texts(batch.column(1))
        rows = batch.column(0).to_numpy()
        for i, j in chunks(offsets, 1 << 17):
            n = np.diff(offsets[i : j + 1])
            p = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[i:j], n)), pa.array(p), pa.array(BYTES[data[offsets[i] : offsets[j]]].view(np.int64))], ["row", "p", "rank"])


def prefix_doubling(rows: DataFrame, length: int, space: Workspace) -> tuple[DataFrame, list[int]]:
    """The plain form, without the choice of positions: (row, p) of every string of ``length`` bytes of (row, text) that begins
    elsewhere too, and how many positions each round ranked. A position's rank and that of the position L further on make its rank at
    2L; one whose rank is unique is settled and goes, and so does one whose partner has gone, until the length is reached. Exact, and
    every round moves all open positions; ``suffix_dedup`` gives the same strings and ranks few positions."""
    state, sizes, at = space.write(rows.mapInArrow(_single, "row long, p long, rank long"), "ranked"), [], 1
    while at < length:
        step = min(at, length - at)
        partner = state.select("row", (F.col("p") - step).alias("p"), F.col("rank").alias("next"))
        pairs = state.join(partner, ["row", "p"]).select("row", "p", F.xxhash64("rank", "next").alias("rank"))
        shared = pairs.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
        sizes.append(state.count())
        state, at = space.write(pairs.join(shared, "rank").select("row", "p", "rank"), "ranked"), at + step
    return state.select("row", "p"), sizes
