"""Ranked lexical search by Block-Max WAND over a document-partitioned index.

Documents are dealt as they are read into shards of bounded size, each with its own inverted lists, so a term that a third of all
documents hold is a short list in every shard and nothing of the corpus is shuffled by term. A list is cut into blocks of
``BLOCK`` postings, bit-packed by the widths that the block needs, and each block stores its last document and the greatest
impact of a posting in it. Impacts depend on the counts of the whole corpus, which are taken first.

A search reads the lists of its terms only. In a shard, the pointers of a query's terms move over the borders of blocks without
decompressing any (shallow moves): between two borders each pointer stands in one block, and the sum of the weighted impacts of
these blocks bounds the score of all documents there. Where the bound is below the score of the query's k-th document so far, the
pointers go on; only blocks under pointers that stop are unpacked, once for all queries of a shard. Runs of borders are treated
at once, each run four times as long as the one before, so that the threshold rises early.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import NULL_ID
from .shingles import IN_TERMS, chunks, texts, word_hashes
from .storage import Workspace, columns
from .tokens import gathered

#: Postings of a block; a list's last block may hold fewer.
BLOCK = 128
#: Bytes of text of a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Queries that one task answers over one shard.
QUERY_BLOCK = 512
#: Borders of the first run.
FIRST_RUN = 16
INDEX = "shard long, term long, df int, last array<int>, top array<int>, bits array<int>, data binary, lengths binary"


def _terms(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes of the terms of the texts i to j, how many each has), in chunks."""
    offsets, data = texts(column)
    for i, j in chunks(offsets):
        hashes, first = word_hashes(offsets[i : j + 1], data, IN_TERMS)
        yield i, j, hashes, np.diff(first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = total = 0
        for _, _, _, n in _terms(batch.column(0)) if batch.num_rows else ():
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "terms"])


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's part of the score before the term's weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + 50 * length.astype(np.int64) * docs // total))


def widths(most: np.ndarray) -> np.ndarray:
    """The bits of each number."""
    return np.where(most > 0, np.floor(np.log2(np.maximum(most, 1))).astype(np.int64) + 1, 0)


def inverted(hashes: np.ndarray, lengths: np.ndarray, docs: int, total: int) -> dict[str, list | np.ndarray]:
    """The lists of a shard whose documents' term hashes lie side by side."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    tf = np.diff(np.append(starts, len(h)))
    h, d = h[starts], d[starts]
    score = impacts(tf, lengths[d], docs, total)
    list_at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    df = np.diff(np.append(list_at, len(h)))
    within = np.arange(len(h)) - np.repeat(list_at, df)
    block_at = np.flatnonzero(within % BLOCK == 0)
    sizes = np.diff(np.append(block_at, len(h)))
    gap = np.diff(d, prepend=0) - 1
    gap[list_at] = d[list_at]
    gap_bits = widths(np.maximum.reduceat(gap, block_at))
    tf_bits = widths(np.maximum.reduceat(tf, block_at) - 1)
    width = gap_bits + tf_bits
    # blocks of one width are packed together, each padded to whole bytes
    padded = -(-sizes // 8) * 8
    nbytes = padded * width // 8
    at = np.cumsum(nbytes) - nbytes
    packed = np.zeros(int(nbytes.sum()), np.uint8)
    value = gap | (tf - 1) << np.repeat(gap_bits, sizes)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        place = np.cumsum(padded[some]) - padded[some]
        v = np.zeros(int(padded[some].sum()), np.int64)
        v[np.repeat(place - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(int(sizes[some].sum()))] = gathered(value, block_at[some], sizes[some])
        bits = np.packbits((v[:, None] >> np.arange(w)[None] & 1).astype(np.uint8))
        packed[np.repeat(at[some] - np.cumsum(nbytes[some]) + nbytes[some], nbytes[some]) + np.arange(len(bits))] = bits
    blocks_of = -(-df // BLOCK)
    first_block = np.append(np.cumsum(blocks_of) - blocks_of, len(block_at))
    byte_at = np.append(at, len(packed))[first_block]
    last, top = d[np.append(block_at[1:], len(d)) - 1], np.maximum.reduceat(score, block_at)
    return {"term": h[list_at], "df": df, "blocks": first_block, "last": last, "top": top, "bits": gap_bits * 64 + tf_bits, "bytes": byte_at, "packed": packed}


def _lists(x: dict, a: int, z: int, shard: int) -> pa.RecordBatch:
    """Lists a to z as rows."""
    cut = x["blocks"][a : z + 1]
    of = lambda name: pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(x[name][cut[0] : cut[-1]].astype(np.int32)))
    places = x["bytes"][a : z + 1]
    data = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((places - places[0]).astype(np.int32).tobytes()), pa.py_buffer(x["packed"][places[0] : places[-1]].tobytes())])
    n = z - a
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(x["term"][a:z].view(np.int64)), pa.array(x["df"][a:z].astype(np.int32)), of("last"), of("top"), of("bits"), data, pa.nulls(n, pa.binary())], [c.split()[0] for c in INDEX.split(", ")])


def _indexed(docs: int, total: int, shard_bytes: int):
    """Of (id, text): rows of INDEX; the row of a shard without a term holds the ids and lengths of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def built() -> Iterator[pa.RecordBatch]:
            ids, hashes, lengths = (np.concatenate([h[k] for h in held]) for k in range(3))
            some = lengths > 0
            ids, lengths = ids[some], lengths[some]
            if not len(ids):
                return
            x = inverted(hashes, lengths, docs, total)
            row = [pa.array([shard]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), *[pa.nulls(1, pa.list_(pa.int32()))] * 3, pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in INDEX.split(", ")])
            for a in range(0, len(x["term"]), 1 << 15):
                yield _lists(x, a, min(a + (1 << 15), len(x["term"])), shard)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = batch.column(0).to_numpy(), texts(batch.column(1))[0]
            for i, j, hashes, n in _terms(batch.column(1)):
                more = int(ends[j] - ends[i])
                if held and size + more > shard_bytes:
                    yield from built()
                    held, size, shard = [], 0, shard + 1
                held.append((ids[i:j], hashes, n))
                size += more
        if held:
            yield from built()

    return run


@dataclass
class Index:
    """A written index, and the counts of documents that hold a term and of all terms with repeats."""

    lists: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Indexes every row of ``docs``. Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII of the
    whole text, A-Z lowered; a null text has none. Each row is a document of its own, whatever its id; a null id is kept."""
    space = Workspace(docs.sparkSession, "ranked-search")
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_counts, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    lists = space.write(rows.mapInArrow(_indexed(*counted, shard_bytes), INDEX), "index")
    return Index(lists, *counted)


class Shard:
    """The lists of some terms in one shard."""

    def __init__(self, lists: pa.Table, ids: np.ndarray, lengths: np.ndarray, docs: int, total: int):
        self.ids, self.lengths, self.docs, self.total = ids, lengths, docs, total
        column = lambda name: lists.column(name).combine_chunks()
        self.row_of = {t: k for k, t in enumerate(column("term").to_pylist())}
        df = column("df").to_numpy().astype(np.int64)
        self.weight = column("weight").to_numpy().astype(np.int64)
        blocks = -(-df // BLOCK)
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        self.last, self.top, bits = (column(n).flatten().to_numpy().astype(np.int64) for n in ("last", "top", "bits"))
        self.gap_bits, self.tf_bits = bits >> 6, bits & 63
        self.size = np.full(int(blocks.sum()), BLOCK)
        self.size[self.first[1:] - 1] = df - (blocks - 1) * BLOCK
        # where a block's gaps are counted from
        self.base = np.concatenate(([-1], self.last[:-1]))
        self.base[self.first[:-1]] = -1
        self.nbytes = -(-self.size // 8) * (self.gap_bits + self.tf_bits)
        self.byte_at = np.cumsum(self.nbytes) - self.nbytes
        self.packed = np.frombuffer(b"".join(column("data").to_pylist()), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.doc, self.impact = np.zeros(int(self.size.sum()), np.int64), np.zeros(int(self.size.sum()), np.int64)
        self.unpacked = np.zeros(len(self.size), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.unpacked[blocks]]
        self.unpacked[blocks] = True
        for w in np.unique(self.gap_bits[blocks] * 64 + self.tf_bits[blocks]).tolist():
            gap_bits, tf_bits = w >> 6, w & 63
            some = blocks[(self.gap_bits[blocks] == gap_bits) & (self.tf_bits[blocks] == tf_bits)]
            size, padded, n = self.size[some], -(-self.size[some] // 8) * 8, gap_bits + tf_bits
            real = np.arange(int(padded.sum())) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(size, padded)
            value = np.zeros(int(size.sum()), np.int64)
            if n:
                bits = np.unpackbits(gathered(self.packed, self.byte_at[some], self.nbytes[some])).reshape(-1, n)[real]
                for k in range(n):
                    value |= bits[:, k].astype(np.int64) << k
            begin = np.cumsum(size) - size
            steps = np.cumsum((value & ((1 << gap_bits) - 1)) + 1)
            doc = steps - np.repeat(steps[begin] - (value[begin] & ((1 << gap_bits) - 1)) - 1, size) + np.repeat(self.base[some], size)
            place = np.repeat(self.at[some] - begin, size) + np.arange(len(doc))
            self.doc[place] = doc
            self.impact[place] = impacts((value >> gap_bits) + 1, self.lengths[doc], self.docs, self.total)

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k documents of greatest score above 0, equal ones by id."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = [self.row_of[t] for t in terms if t in self.row_of and self.weight[self.row_of[t]] > 0]
        if not rows:
            return ids, scores
        lists = [self.last[self.first[r] : self.first[r + 1]] for r in rows]
        stops = np.unique(np.concatenate(lists))
        # the block under each term's pointer at each stop; the last of a list stays there with no impact
        under = np.stack([np.searchsorted(x, stops) for x in lists])
        over = under >= np.array([len(x) for x in lists])[:, None]
        under += np.array([self.first[r] for r in rows])[:, None]
        under[over] = 0
        weight = self.weight[rows]
        bound = (np.where(over, 0, self.top[under]) * weight[:, None]).sum(0)
        a, run, least = 0, FIRST_RUN, 1
        while a < len(stops):
            z = min(a + run, len(stops))
            live = np.flatnonzero(bound[a:z] >= least) + a
            a, run = z, run * 4
            if not len(live):
                continue
            low, high = (0 if live[0] == 0 else int(stops[live[0] - 1]) + 1), int(stops[live[-1]])
            under_live = [np.unique(under[t, live][~over[t, live]]) for t in range(len(rows))]
            blocks, of = np.concatenate(under_live), np.repeat(weight, [len(u) for u in under_live])
            self.unpack(blocks)
            doc = gathered(self.doc, self.at[blocks], self.size[blocks])
            part = gathered(self.impact, self.at[blocks], self.size[blocks]) * np.repeat(of, self.size[blocks])
            inside = (doc >= low) & (doc <= high)
            # whole numbers far below 2**53
            score = np.bincount(doc[inside] - low, part[inside], high - low + 1).astype(np.int64)
            begins = np.where(live > 0, stops[live - 1] + 1, 0) - low
            seen = np.zeros(high - low + 2, np.int64)
            np.add.at(seen, begins, 1)
            np.add.at(seen, stops[live] - low + 1, -1)
            good = np.flatnonzero((np.cumsum(seen)[:-1] > 0) & (score >= least))
            if len(good):
                ids, scores = np.concatenate((ids, self.ids[good + low])), np.concatenate((scores, score[good]))
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                if len(ids) == k:
                    least = int(scores[-1])  # an equal score may still win by its id
        return ids, scores


def _answered(docs: int, total: int, k: int):
    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if lists.num_rows and asked.num_rows:
            read = lambda name: np.frombuffer(asked.column(name)[0].as_buffer(), "<i8").astype(np.int64)
            shard = Shard(lists, read("ids"), read("sizes"), docs, total)
            for query in asked.column("queries")[0].as_py():
                ids, scores = shard.best(query["terms"], k)
                found.append((np.full(len(ids), query["query"]), ids, scores))
        parts = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({"query": pa.array(parts[0], pa.int64()), "id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.int64())})

    return run


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            terms = []
            for _, _, hashes, n in _terms(batch.column(2)):
                cuts = np.concatenate(([0], np.cumsum(n)))
                terms += [np.unique(hashes[a:z]).view(np.int64) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], ["query", "item", "terms"])


def ranked_search(index: Index, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text", doc_key: str = "doc_id", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(key, rank, doc_key, score): for each row of ``items`` the k documents of highest score above 0 (all, if fewer), equal
    scores by ascending id (a null id is the least).

    With N documents that hold a term, L terms in all, n terms in a document, df documents that hold a term and tf occurrences in
    the document, a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 50 + 50nN div L, and its score is
    the sum of weight * (10**9 * tf div (1000 * tf + 20m)) over the item's distinct terms. Each row of ``items`` is a query of
    its own, so a repeated id or row is answered as often; a null text or one without terms has no rows. Queries are dealt in
    blocks of ``query_block``, each searched in all shards. Terms are compared by 64-bit hashes.
    """
    space = Workspace(items.sparkSession, "ranked-search")
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = space.write(rows.mapInArrow(_distinct_terms, f"query long, item {items.schema[key].dataType.simpleString()}, terms array<long>").where("size(terms) > 0"), "queries")
    n_blocks = max(1, -(-asked.count() // query_block))
    ranged = asked.select("query", F.pmod(F.xxhash64("query"), F.lit(n_blocks).cast("long")).alias("block"), "terms")
    wanted = space.write(ranged.select("block", F.explode("terms").alias("term")).distinct(), "wanted")
    lists = index.lists.where("term IS NOT NULL").drop("lengths").join(wanted.select("term").distinct(), "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("n") + 1))).cast("long")
    weights = space.write(df.select("term", weight.alias("weight")).join(wanted, "term"), "weights")
    found = index.lists.where("term IS NOT NULL").join(weights, "term").select("shard", "block", "term", "df", "last", "top", "bits", "data", "weight")
    batches = ranged.groupBy("block").agg(F.collect_list(F.struct("query", "terms")).alias("queries"))
    shards = index.lists.where("term IS NULL").select(F.col("shard").alias("of"), F.col("data").alias("ids"), F.col("lengths").alias("sizes"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    tasks = shards.join(batches, "block").select("of", F.col("block").alias("part"), "ids", "sizes", "queries")
    best = found.groupBy("shard", "block").cogroup(tasks.groupBy("of", "part")).applyInArrow(_answered(index.docs, index.terms, k), "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = ranked.join(columns(asked, "query", "item"), "query")
    return named.select(F.col("item").alias(key), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NULL_ID, F.col("id")).alias(doc_key), "score")
