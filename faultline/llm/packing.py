"""Best-fit packing of documents into sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens, of which only (id, piece, length) travel. Partitions pack their pieces
best-fit, longest first, and emit the bins that are nearly full; the underfull bins go on as items of their fill, and their small
pieces as items of their own, and are merged by best-fit again over fewer partitions, until one task holds them. A bin that went
on is a node of a tree: each item keeps the bin it lies in and its offset there, and the tree's levels are joined back at the end.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace
from .tokens import WordTokens, vocabulary

#: Items that one task packs.
NODE_ITEMS = 100_000


def _pieces(path: str, capacity: int, last_id: int):
    end = np.array([last_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(path)
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), tokens.of_texts(batch.column(1)), strict=True) if batch.num_rows else ():
                ids = np.concatenate((ids, end))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["key", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """For items (length, name), longest first: (name, bin, offset), each in the fullest bin that holds it."""
    open_bins: list[tuple[int, int]] = []  # (room, bin) in order
    placed = []
    bins = 0
    for length, name in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect.bisect_left(open_bins, (length, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, bins
            bins += 1
        placed.append((name, b, capacity - room))
        if room > length:
            bisect.insort(open_bins, (room - length, b))
    return placed


def _pack(capacity: int, slack: int, last: bool):
    """Of rows (node, item, length) in order of node: (item, node, bin, offset, fill, goes, small).

    ``bin`` is null for an item that is not packed here but goes on as it is. ``goes`` is true for items that go on and for the
    bins that do; all other bins are done. An underfull bin keeps its large items and gives its small ones back, so that they can
    fill bins of other nodes, unless more than half of the items would go on: then bins go on whole. Of bins over half full, which
    only fit with others, the emptiest go on, so that half of the items go on in all.
    """

    def packed(node: int, items: list[tuple[int, int]]) -> pa.RecordBatch:
        lengths = {name: length for length, name in items}
        bins: dict[int, list[tuple[int, int]]] = {}
        for name, b, offset in best_fit(items, capacity):
            bins.setdefault(b, []).append((name, offset))
        fills = {b: sum(lengths[name] for name, _ in inside) for b, inside in bins.items()}
        alone: list[int] = []
        going: set[int] = set()
        if not last:
            under = [b for b, fill in fills.items() if fill < capacity - slack]
            small = lambda name: lengths[name] * 2 <= capacity
            loose = {b: [name for name, _ in bins[b] if small(name)] for b in under}
            if sum(len(x) + 1 for x in loose.values()) * 2 <= len(items):
                for b in under:
                    # longest first, so a bin's small items lie behind its large ones
                    bins[b] = [x for x in bins[b] if not small(x[0])]
                    fills[b] = sum(lengths[name] for name, _ in bins[b])
                    alone += loose[b]
            under = sorted((b for b in under if bins[b]), key=lambda b: (fills[b], b))
            light = [b for b in under if fills[b] * 2 <= capacity]
            heavy = [b for b in under if fills[b] * 2 > capacity]
            going = {*light, *heavy[: max(len(items) // 2 - len(light) - len(alone), 0)]}
        rows = [(name, node, b, offset, fills[b], b in going) for b, inside in bins.items() for name, offset in inside] + [(name, node, None, 0, lengths[name], True) for name in alone]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["item", "node", "bin", "offset", "fill", "goes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, items = None, []
        for batch in batches:
            for n, item, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if n != node:
                    if items:
                        yield packed(node, items)
                    node, items = n, []
                items.append((length, item))
        if items:
            yield packed(node, items)

    return run


def pack(docs: DataFrame, capacity: int = 2048, slack: int = 16, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, last_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``.

    A document is its text's ids (null: none) and ``last_id``. Only longer ones are cut, into pieces of ``capacity`` tokens, the
    last of which may be shorter. Sequences hold at most ``capacity`` tokens, without gaps from 0. A bin with at most ``slack``
    tokens of room (half of that in the first round) is full and goes no further up the tree. What goes up a level is at most half of what came in, so the tree is
    as high as the logarithm of the pieces. Repeated rows are packed each for itself, null keys too; an empty table gives an
    empty table; other columns are left out.
    """
    space = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer or vocabulary(), capacity, last_id), "key long, piece int, start long, length long, ids_crc32 long")
    # written once: items are named by their place in this table from here on
    pieces = space.write(pieces.select(F.monotonically_increasing_id().alias("item"), "key", "piece", "start", "length", "ids_crc32"), "pieces")
    items = pieces.where(F.col("length") < capacity).select("item", "length")
    level, up = 0, []
    n = items.count()
    while n:
        nodes = max(1, -(-n // NODE_ITEMS))
        dealt = items.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(nodes)).cast("int").alias("node"), "item", "length")
        placed = dealt.repartition(nodes, "node").sortWithinPartitions("node").mapInArrow(_pack(capacity, slack if level else slack // 2, nodes == 1), "item long, node int, bin long, offset long, fill long, goes boolean")
        # a bin's name: its level, node and number; an item that goes on as it is keeps its own
        name = F.lit(level + 1).cast("long") * F.lit(1 << 58) + F.col("node").cast("long") * F.lit(1 << 30) + F.col("bin")
        placed = space.write(placed.select("item", F.coalesce(name, "item").alias("bin"), "offset", "fill", "goes"), f"level-{level}")
        up.append(placed)
        if nodes == 1:
            break
        items = space.write(placed.where("goes").select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct(), f"items-{level}")
        n, level = items.count(), level + 1
    found = None
    for k, placed in reversed(list(enumerate(up))):  # from the top: (item, sequence, offset) of each level
        own = placed.select("item", "bin", "offset")
        if found is not None:
            own = own.join(found.select(F.col("item").alias("bin"), F.col("sequence_id").alias("s"), F.col("offset").alias("o")), "bin", "left")
            own = own.select("item", F.coalesce("s", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))
        else:
            own = own.select("item", F.col("bin").alias("sequence_id"), "offset")
        found = space.write(own, f"tree-{k}")
        space.remove(f"level-{k}", f"items-{k}", f"tree-{k + 1}")
    if found is None:
        packed = pieces.select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    else:
        packed = pieces.join(found, "item", "left").select("key", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    return packed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
