"""Repair of the structure of conversations by signature deduplication.

A conversation's rows in order are encoded as a compact string, its signature: a letter for each row, which tells the initial of
the row's role and the row's fault. Each distinct signature is solved once, by memoised recursion over its halves: for any state
in which a reader may come to the rows and any in which it may leave them, the cheapest edits. The answers (audits, a letter for
each edit) are joined back to all conversations of that signature, and replayed on their rows.

A conversation may hold any share of all rows. Rows are put in order by range partitions, never by one task for a conversation,
and a conversation longer than a segment is several segments. Costs between states are combined like matrices, so a tree of them
finds the states at the borders of segments; audits and texts are never combined in one place.

States: nothing read yet (0), after a system turn (1), after a user's turn (2), after an assistant's (3). Equally cheap edits that
lead from the same rows and state to different states never begin with each other, as both end with the edit of the last row;
so the least of two in order of their letters is decided where they differ first, whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import NULL_ID
from .shingles import texts
from .storage import Workspace

#: Rows and bytes of text that a segment holds at most; a row longer than that is a segment of its own.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20
#: Nodes that are combined into one at each level of the tree.
FANOUT = 256
#: Identical rows of one turn from which on they travel as one row and a count.
MANY = 1000
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Where a turn of each initial leads, by state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What is inserted by state to come to the end, and the roles by initial.
ENDING, ROLES = ("", "II", "I", ""), {"u": "user", "a": "assistant"}
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Letters of a signature by initial, for rows without a fault and for truncated ones; a row that must go is a dash.
INITIALS, WHOLE, TRUNK = "suax", b"suax", b"SUAX"

Answers = tuple[tuple["tuple[int, str] | None", ...], ...]


def _inserts(state: int) -> Iterator[tuple[int, int]]:
    """(how many turns are inserted, the state after them): more than two only come back to a state."""
    yield 0, state
    for k in (1, 2):
        state = NEXT[state]["u" if "u" in NEXT[state] else "a"]
        yield k, state


def _of_row(letter: str) -> Answers:
    answers = []
    for q in range(4):
        best: list[tuple[int, str] | None] = [None] * 4

        def offer(state: int, cost: int, audit: str, best=best) -> None:
            if best[state] is None or (cost, audit) < best[state]:
                best[state] = (cost, audit)

        for k, p in _inserts(q):
            before, cost = "I" * k, k * INSERT
            offer(p, cost + DELETE, before + "D")
            if letter != "-":
                cut = CUT if letter.isupper() else 0
                for initial, state in NEXT[p].items():
                    if initial == letter.lower():
                        offer(state, cost + cut, before + "K")
                    if initial in ROLES:
                        offer(state, cost + cut + REROLE, before + "R")
        answers.append(tuple(best))
    return tuple(answers)


@lru_cache(maxsize=4096)
def solved(signature: str) -> Answers:
    """``solved(s)[q][r]``: (cost, audit) of the cheapest edits of the rows ``s`` that lead from state q to r, the least audit of
    equally cheap ones; None where there are none. Turns are inserted before a row, never behind the last."""
    if len(signature) == 1:
        return _of_row(signature)
    middle = 1 << ((len(signature) - 1).bit_length() - 1)
    left, right = solved(signature[:middle]), solved(signature[middle:])
    answers = []
    for q in range(4):
        ways = [[(a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := left[q][m]) and (b := right[m][r])] for r in range(4)]
        answers.append(tuple(min(w) if w else None for w in ways))
    return tuple(answers)


def ended(answers: tuple, state: int = 0) -> tuple[int, str]:
    """The cheapest (cost, audit) from a state to the end of the conversation."""
    return min((a[0] + INSERT * len(e), a[1] + e) for a, e in zip(answers[state], ENDING, strict=True) if a)


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            rows = []
            for signature in batch.column(0).slice(i, 64).to_pylist():
                answers = solved(signature)
                flat = [a for of in answers for a in of]
                ranks = [sum(1 for b in of if a and b and b[1] < a[1]) for of in answers for a in of]
                rows.append((signature, *ended(answers), [-1 if a is None else a[0] for a in flat], ranks, [None if a is None else a[1] for a in flat]))
            types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["signature", "whole_cost", "whole_audit", "cost", "rank", "audit"])


def _segments(most: int):
    """Of rows (conv, known, turn, h1, h2, n, initial, fault, role, text) in order: segments, cut where a conversation, a batch or
    a segment's bounds end. Holds the key of one row between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, known, turn, h1, h2, n, initial, fault = (batch.column(k).to_numpy() for k in range(8))
            role, text = batch.column(8), batch.column(9)
            key = np.stack((conv, known, turn, h1, h2), 1)
            same = np.concatenate(([last is not None and (key[0] == last).all()], (key[1:] == key[:-1]).all(1)))
            last = key[-1]
            fault = np.where(same & (fault != BLANK), DUPLICATE, fault)
            letter = np.choose(fault, (np.frombuffer(WHOLE, np.uint8)[initial], 45, 45, np.frombuffer(TRUNK, np.uint8)[initial]))
            new = np.concatenate(([True], conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            size = (texts(text)[0][1:] - texts(text)[0][0]) // SEGMENT_BYTES
            begins = np.flatnonzero(new | (at % most == 0) | np.concatenate(([False], size[1:] != size[:-1])))
            ends = np.append(begins[1:], len(conv)) - 1
            place = np.concatenate(([0], np.cumsum(n)))
            letters = np.full(place[-1], 45, np.uint8)
            letters[place[:-1]] = letter
            pair = initial[:-1] * 4 + initial[1:]
            bad = np.concatenate(([False], ~np.isin(pair, LEGAL)))
            bad[begins] = False
            total = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), begins), pa.int64())  # noqa: E731, B023
            signature = pa.StringArray.from_buffers(len(begins), pa.py_buffer(place[np.append(begins, len(conv))].astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))
            rows = pa.ListArray.from_arrays(pa.array(np.append(begins, len(conv)).astype(np.int32)), pa.StructArray.from_arrays([role, text, pa.array(n, pa.int64())], ["role", "text", "n"]))
            numbers = pa.array(np.arange(len(begins)) + number, pa.int64())
            number += len(begins)
            columns = [pa.array(conv[begins]), numbers, signature, total(np.where(fault == BLANK, n, 0)), total(np.where(fault == DUPLICATE, n, np.where(fault == BLANK, 0, n - 1))), total(fault == TRUNCATED), total(bad + n - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(initial[begins], pa.int32()), pa.array(initial[ends], pa.int32()), rows], SEGMENT.replace(" long", "").split(", ")[:7] + ["first", "last", "rows"])

    return run


SEGMENT = "conv long, segment long, signature, blank long, duplicate long, truncated long, illegal long"
SEGMENT_SCHEMA = SEGMENT.replace("signature", "signature string") + ", first int, last int, rows array<struct<role:string,text:string,n:long>>"
#: The pairs of initials su, ua and au, as numbers.
LEGAL = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")]


def _route(nodes: list[tuple[list[int], list[int]]], q: int, r: int) -> tuple[int, list[int]] | None:
    """(cost, states after each node) of the cheapest way from q to r through nodes (costs, ranks), the least of equal ones."""
    costs: list[list[int | None]] = [[0 if s == r else None for s in range(4)]]
    for cost, _ in reversed(nodes):
        costs.append([min((cost[s * 4 + t] + c for t, c in enumerate(costs[-1]) if c is not None and cost[s * 4 + t] >= 0), default=None) for s in range(4)])
    costs.reverse()
    if costs[0][q] is None:
        return None
    states, s = [], q
    for k, (cost, rank) in enumerate(nodes):
        s = min((cost[s * 4 + t] + c, rank[s * 4 + t], t) for t, c in enumerate(costs[k + 1]) if c is not None and cost[s * 4 + t] >= 0)[2]
        states.append(s)
    return costs[0][q], states


def _nodes(rows: pd.DataFrame) -> list[tuple[list[int], list[int]]]:
    return [(list(c), list(r)) for c, r in zip(rows["cost"], rows["rank"], strict=True)]


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """One node of the nodes of one parent."""
    rows = rows.sort_values("idx")
    nodes = _nodes(rows)
    costs, ranks = [], []
    for q in range(4):
        ways = [_route(nodes, q, r) for r in range(4)]
        # two ways part at some node, whose ranks tell their order; before it they are in the same state
        order = [None if w is None else [nodes[k][1][(w[1][k - 1] if k else q) * 4 + w[1][k]] for k in range(len(nodes))] for w in ways]
        costs += [-1 if w is None else w[0] for w in ways]
        ranks += [sum(1 for b in order if a is not None and b is not None and b < a) for a in order]
    return pd.DataFrame({"conv": [rows["conv"].iloc[0]], "idx": [rows["parent"].iloc[0]], "cost": [costs], "rank": [ranks]})


def _descended(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    q, r = int(rows["q"].iloc[0]), int(rows["r"].iloc[0])
    states = _route(_nodes(rows), q, r)[1]
    return pd.DataFrame({"conv": rows["conv"], "idx": rows["idx"], "q": [q, *states[:-1]], "r": states})


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv, segment, parts, q, audit, rows): the lines left, as structs of role and text."""
    for batch in batches:
        kept = []
        for q, audit, rows in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            state, edits, lines = q, iter(audit), []

            def insert(lines=lines):
                nonlocal state
                initial = "a" if state == 2 else "u"
                lines.append({"role": ROLES[initial], "text": ""})
                state = NEXT[state][initial]

            for row in rows:
                for _ in range(row["n"]):
                    while (edit := next(edits)) == "I":
                        insert()
                    if edit == "D":
                        continue
                    initial = row["role"][:1] if edit == "K" else "a" if state == 2 else "u"
                    lines.append({"role": row["role"] if edit == "K" else ROLES[initial], "text": row["text"]})
                    state = NEXT[state][initial]
            for _ in edits:  # the ending
                insert()
            kept.append(lines)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(kept, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], ["conv", "segment", "parts", "audit", "lines"])


@dataclass
class Repair:
    """``summary``: a row for each conversation (conv, gaps, blank, duplicate, truncated, illegal, cost). ``pieces``: a row for each
    segment (conv, segment, parts, audit, lines) in order of ``segment``; ``parts`` is how many the conversation has, ``lines``
    the structs (role, text) that are left of it or inserted there. ``conv`` is NULL_ID for null."""

    summary: DataFrame
    pieces: DataFrame


def _flagged(rows: DataFrame, many: int, space: Workspace) -> DataFrame:
    """The rows with hashes, initial and fault; those that stand ``many`` times in one turn once, with their number n."""
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "role", "text").alias("h2")]
    slim = rows.select("conv", "known", "turn", *hashes).groupBy("conv", "known", "turn", "h1", "h2").agg(F.count("*").alias("m"))
    twins = slim.groupBy("conv", "h1", "h2").agg(F.min(F.struct("known", "turn")).alias("first"), F.count("*").alias("turns"), F.max("m").alias("m"))
    twins = space.write(twins.where(f"turns > 1 OR m >= {many}"), "twins")
    known = rows.select("*", *hashes).join(twins, ["conv", "h1", "h2"], "left").withColumn("n", F.lit(1).cast("long"))
    if twins.where(f"m >= {many}").limit(1).count():
        heap = known.where(f"m >= {many}").groupBy("conv", "h1", "h2", "known", "turn").agg(*[F.first(c).alias(c) for c in ("role", "text", "first")], F.count("*").alias("n"))
        names = ["conv", "h1", "h2", "known", "turn", "role", "text", "first", "n"]
        known = known.where(f"m IS NULL OR m < {many}").select(*names).union(heap.select(*names))
    inner = F.regexp_extract("text", "(?s)^.*([^ \\t-\\r])", 1)  # the last character that is no white space
    again = F.col("first").isNotNull() & (F.struct("known", "turn") != F.col("first"))
    fault = F.when(inner == "", BLANK).when(again, DUPLICATE).when(~inner.isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    return known.select("conv", "known", "turn", "h1", "h2", "n", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"), "role", "text")


def _borders(segments: DataFrame, answers: DataFrame, fanout: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Of conversations of several segments: (conv, segment, q, r, ending) and (conv, cost, bad), the pairs at borders being bad
    where they are illegal."""
    order = Window.partitionBy("conv").orderBy("segment")
    pair = F.lag("last").over(order) * 4 + F.col("first")
    indexed = segments.select("conv", "segment", "signature", (F.row_number().over(order) - 1).cast("long").alias("idx"), (~pair.isin(LEGAL)).cast("int").alias("bad"), (F.lead("segment").over(order)).isNull().alias("ends"))
    indexed = space.write(indexed, "indexed")
    nodes = space.write(indexed.join(answers.select("signature", "cost", "rank"), "signature").select("conv", "idx", "cost", "rank"), "nodes")
    levels = [nodes]
    while nodes.where("idx > 0").limit(1).count():
        nodes = nodes.withColumn("parent", F.expr(f"idx DIV {fanout}")).groupBy("conv", "parent").applyInPandas(_combined, "conv long, idx long, cost array<long>, rank array<int>")
        nodes = space.write(nodes, "nodes")
        levels.append(nodes)
    ways = [F.struct((F.col("cost")[r] + INSERT * len(e)).alias("cost"), F.col("rank")[r].alias("rank"), F.lit(r).alias("r"), (F.col("cost")[r] < 0).alias("none")) for r, e in enumerate(ENDING)]
    way = F.array_min(F.filter(F.array(*ways), lambda w: ~w["none"]))
    top = nodes.select("conv", "idx", way.alias("way")).select("conv", F.col("idx").alias("parent"), "way.cost", F.lit(0).alias("q"), "way.r")
    top = space.write(top, "top")
    chosen = top.drop("cost")
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.expr(f"idx DIV {fanout}")).join(chosen, ["conv", "parent"])
        chosen = below.groupBy("conv", "parent").applyInPandas(_descended, "conv long, idx long, q int, r int")
        chosen = space.write(chosen, "chosen").withColumnRenamed("idx", "parent")
    chosen = chosen.withColumnRenamed("parent", "idx")
    at_borders = indexed.groupBy("conv").agg(F.sum("bad").alias("bad"))
    return indexed.join(chosen, ["conv", "idx"]).select("conv", "segment", "q", "r", "ends"), top.select("conv", "cost").join(at_borders, "conv")


def repair_conversations(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = SEGMENT_ROWS, fanout: int = FANOUT, many: int = MANY
) -> Repair:
    """Finds the cheapest edits after which each conversation's roles are an optional system turn and then a user's and an
    assistant's in turn, or nothing at all.

    Rows are taken in order of turn (nulls first), then role and text. A null role or text is one space. A row's first fault
    counts: blank (no character but white space), duplicate (role and text stand earlier in the conversation), truncated (the
    last character that is no white space is none of ``.!?``). To keep a row costs 0, to give it another role 3, to delete it 4,
    which blank and duplicate rows must be; an inserted turn without text costs 3; a truncated row that stays 3 more. Of equally
    cheap edits those whose initials are the least string are taken.

    Rows of a null conversation are one conversation. Repeated rows are duplicates. Texts may have any length; role and text are
    compared by 128 bits of hashes. An empty table gives empty tables; other columns are left out. How rows are cut into segments
    (``segment_rows``), how many nodes of the tree become one (``fanout``) and from which number on identical rows of one turn
    travel as one (``many``) change no result.
    """
    space = Workspace(table.sparkSession, "conversation-repair")
    column = lambda c: F.col(f"`{c}`")
    filled: Column = F.coalesce(column(conv).cast("long"), F.lit(NULL_ID)).alias("conv")
    words = [F.coalesce(column(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    when = column(turn).cast("long")
    rows = table.select(filled, when.isNotNull().cast("long").alias("known"), F.coalesce(when, F.lit(0)).alias("turn"), *words)
    # rows of one turn are in one task only if they begin alike
    keys = ["conv", "known", "turn", "role", F.substring("text", 1, 64)]
    ordered = _flagged(rows, many, space).repartitionByRange(*keys).sortWithinPartitions("conv", "known", "turn", "role", "text")
    segments = space.write(ordered.mapInArrow(_segments(segment_rows), SEGMENT_SCHEMA), "segments")
    slim = segments.drop("rows")
    answers = space.write(slim.select("signature").distinct().mapInArrow(_solutions, "signature string, whole_cost long, whole_audit string, cost array<long>, rank array<int>, audit array<string>"), "answers")
    counts = ("blank", "duplicate", "truncated", "illegal")
    sums = space.write(slim.groupBy("conv").agg(F.count("*").alias("parts"), *[F.sum(c).alias(c) for c in counts]), "sums")
    slim = slim.join(sums.select("conv", "parts"), "conv")
    single = slim.where("parts = 1").join(answers, "signature")
    edits = single.select("conv", "segment", "parts", F.lit(0).alias("q"), F.col("whole_audit").alias("audit"), F.col("whole_cost").alias("cost"))
    parted = space.write(slim.where("parts > 1"), "parted")
    costs = None
    if parted.limit(1).count():
        states, costs = _borders(parted, answers, fanout, space)
        ending = F.when(F.col("ends"), F.element_at(F.array(*[F.lit(e) for e in ENDING]), F.col("r") + 1)).otherwise("")
        audit = F.concat(F.element_at(answers["audit"], F.col("q") * 4 + F.col("r") + 1), ending)
        several = parted.select("conv", "segment", "parts", "signature").join(states, ["conv", "segment"]).join(answers, "signature")
        edits = edits.union(several.select("conv", "segment", "parts", "q", audit.alias("audit"), F.lit(0).cast("long").alias("cost")))
    edits = space.write(edits, "edits")
    together = segments.select("conv", "segment", "rows").join(edits, ["conv", "segment"]).select("conv", "segment", "parts", "q", "audit", "rows")
    pieces = together.mapInArrow(_replayed, "conv long, segment long, parts long, audit string, lines array<struct<role:string,text:string>>")
    turns = rows.select("conv", F.when(F.col("known") == 1, F.col("turn")).alias("turn")).distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    summary = sums.join(edits.groupBy("conv").agg(F.sum("cost").alias("cost")), "conv").join(turns, "conv")
    bad = F.lit(0)
    if costs is not None:
        summary = summary.join(costs.select("conv", F.col("cost").alias("long_cost"), "bad"), "conv", "left").withColumn("cost", F.coalesce("long_cost", "cost"))
        bad = F.coalesce("bad", F.lit(0))
    summary = summary.select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + bad).alias("illegal"), "cost")
    return Repair(space.write(summary, "summary"), pieces)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv, audit, text, lines) in order: (conv, audit, sha256 of all texts joined by \\n). Holds one digest between batches."""
    conv, audit, digest, some = None, [], None, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    for batch in batches:
        for c, a, t, n in zip(*(batch.column(k) for k in range(4)), strict=True):
            if digest is None or c.as_py() != conv:
                if digest is not None:
                    yield out()
                conv, audit, digest, some = c.as_py(), [], hashlib.sha256(), False
            audit.append(a.as_py())
            if n.as_py():
                if some:
                    digest.update(b"\n")
                digest.update(t.as_buffer())
                some = True
    if digest is not None:
        yield out()


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of a Repair's pieces: the hash of the lines ``role:text``, joined by \\n. The pieces of a long
    conversation are made in many tasks; one reads them in order, as the hash demands, and holds one at a time."""
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("text")
    pieces = pieces.select("conv", "segment", "parts", "audit", text, F.size("lines").alias("n"))
    whole = pieces.where("parts = 1").select("conv", "audit", F.sha2(F.encode("text", "UTF-8"), 256).alias("repaired_sha256"))
    parted = pieces.where("parts > 1").repartition("conv").sortWithinPartitions("conv", "segment").select("conv", "audit", "text", "n")
    return whole.union(parted.mapInArrow(_streamed, "conv long, audit string, repaired_sha256 string"))
