"""A positional index of weighted fields, searched with web queries and ranked by cover density.

Rows are dealt as they are read into shards with inverted lists of their own: a lexeme that a third of all rows hold is a list in
every shard, and no list is moved to be scored. A search reads the lists of its lexemes only, starts from the rarest of each
conjunction, and scores a row that holds all of it only if as many covers as its lexemes occur could lift it among the best.

A row's score is the sum over its covers, the least spans of positions that satisfy the query: the harmonic mean of the weights of
the query's lexemes in the span, divided by one more than the positions in it that hold none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.shared import Scratch
from .relational import top_k

# Weights of the fields in order, the greatest position, and how many positions of a lexeme a row keeps.
WEIGHTS = {"exc_text": 1.0, "msg_text": 0.4, "frames_text": 0.2, "tmpl_text": 0.1}
LAST_POSITION, MOST_POSITIONS = 16383, 255
#: Words, which may hold dots: names of classes, hosts, versions.
LEXEME = "[\\p{L}\\p{N}_]+(?:\\.[\\p{L}\\p{N}_]+)*"
#: Lexemes of a shard, about, and queries that one task answers over one shard.
SHARD_LEXEMES, QUERY_BLOCK = 1_000_000, 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 42
INDEX = "shard long, term long, rows binary, counts binary, places binary"

#: A conjunction: lexemes that must be there, phrases of such, and lexemes that mustn't.
Conjunction = tuple[list[str], list[list[str]], list[str]]


def lexemes(text: Column) -> Column:
    """The lexemes of a text in order, A-Z lowered."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LEXEME), F.lit(0))


def python_lexemes(text: str) -> list[str]:
    return re.findall(r"[^\W]+(?:\.[^\W]+)*", text.translate(str.maketrans(UPPER, LOWER)))


def websearch(text: str) -> list[Conjunction]:
    """The alternatives of a web query: words are required, ``"quoted words"`` stand in a row, ``-word`` mustn't be there, and a bare
    ``or`` parts alternatives. Whatever a word holds besides lexemes is left out."""
    found: list[Conjunction] = [([], [], [])]
    for quoted, word in re.findall(r'"([^"]*)"?|([^\s"]+)', text):
        needed, phrases, barred = found[-1]
        if word.lower() == "or":
            found.append(([], [], []))
        elif quoted:
            words = python_lexemes(quoted)
            needed += words
            phrases += [words] if len(words) > 1 else []
        elif word.startswith("-"):
            barred += python_lexemes(word)
        else:
            needed += python_lexemes(word)
    return [c for c in found if c[0]]


@lru_cache(QUERY_BLOCK)
def _parsed(text: str) -> list[Conjunction]:
    """``websearch``: a task asks the same queries of many shards."""
    return websearch(text)


def covers(places: list[tuple[int, int, int]], satisfied: Callable[[list[tuple[int, int, int]]], bool]) -> Iterator[tuple[int, int]]:
    """(first, last) indexes of the least spans of ``places``, in order, that are satisfied."""
    begin, end = 0, -1
    while begin < len(places):
        end = next((e for e in range(max(begin, end), len(places)) if satisfied(places[begin : e + 1])), None)
        if end is None:
            return
        begin = next(b for b in range(end, begin - 1, -1) if satisfied(places[b : end + 1]))
        yield begin, end
        begin += 1


def holding_covers(places: list[tuple[int, int, int]], needed: list[set[int]]) -> Iterator[tuple[int, int]]:
    """``covers`` for spans that must hold all lexemes of one of ``needed``: one pass, with counts of the lexemes in the span."""
    counts: dict[int, int] = {}
    of = [[c for c, terms in enumerate(needed) if t in terms] for *_, t in places]
    lacking, whole, begin = [len(terms) for terms in needed], 0, 0
    for end, (*_, t) in enumerate(places):
        counts[t] = counts.get(t, 0) + 1
        if counts[t] > 1:
            continue
        for c in of[end]:
            lacking[c] -= 1
            whole += not lacking[c]
        if not whole:
            continue
        while whole:
            first = places[begin][2]
            counts[first] -= 1
            if not counts[first]:
                for c in of[begin]:
                    whole -= not lacking[c]
                    lacking[c] += 1
            begin += 1
        yield begin - 1, end


def density(places: list[tuple[int, int, int]], satisfied: Callable[[list[tuple[int, int, int]]], bool]) -> float:
    """The score of a row whose (position, field, lexeme) of the query's lexemes are ``places``, in order."""
    return _summed(places, covers(places, satisfied))


def _summed(places: list[tuple[int, int, int]], found: Iterable[tuple[int, int]], weights: tuple[float, ...] = tuple(WEIGHTS.values())) -> float:
    score = 0.0
    for a, z in found:
        span = places[a : z + 1]
        noise = span[-1][0] - span[0][0] - (z - a)
        # many lexemes share the last position: half of the span counts as noise
        noise = (z - a) // 2 if noise < 0 else noise
        score += len(span) / sum(1 / weights[f] for _, f, _ in span) / (1 + noise)
    return score


@lru_cache(1 << 16)
def _key(word: str) -> int:
    k = xxhash.xxh64_intdigest(word.encode(), SEED)
    return k - (1 << 64) if k >> 63 else k


def _lists(hashes: list[tuple[np.ndarray, np.ndarray]], n: int) -> dict:
    """Inverted lists of n rows; for each field the lexemes' hashes of all rows and how many each row has."""
    start = np.zeros(n, np.int64)
    term, row, place = [], [], []
    for field, (h, count) in enumerate(hashes):
        r = np.repeat(np.arange(n), count)
        position = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + start[r] + 1
        term.append(h)
        row.append(r)
        place.append(np.minimum(position, LAST_POSITION) << 2 | field)
        start = np.minimum(start + count, LAST_POSITION)
    t, r, p = np.concatenate(term), np.concatenate(row), np.concatenate(place)
    order = np.lexsort((p, r, t))
    t, r, p = t[order], r[order], p[order]
    pair = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])))) if len(t) else np.zeros(0, np.int64)
    within = np.arange(len(t)) - np.repeat(pair, np.diff(np.append(pair, len(t))))
    good = within < MOST_POSITIONS
    count = np.minimum(np.diff(np.append(pair, len(t))), MOST_POSITIONS)
    lists = np.flatnonzero(np.concatenate(([True], t[pair][1:] != t[pair][:-1]))) if len(t) else np.zeros(0, np.int64)
    return {"term": t[pair][lists], "lists": np.append(lists, len(pair)), "rows": r[pair].astype("<i4"), "counts": count.astype("<i4"), "at": np.concatenate(([0], np.cumsum(count))), "places": p[good].astype("<i4")}


def _indexed(shard_lexemes: int):
    """Of (project_id, item_id, a list of hashes for each field): rows of INDEX; the row of a shard without a term holds its rows'
    items and projects."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def built(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        fields = []
        for c in range(2, 2 + len(WEIGHTS)):
            column = table.column(c).combine_chunks()
            fields.append((column.flatten().to_numpy(), np.asarray(column.value_lengths(), np.int64)))
        x = _lists(fields, table.num_rows)
        items, projects = (table.column(c).to_numpy().astype("<i8").tobytes() for c in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.int64()), pa.array([items]), pa.array([projects]), pa.nulls(1, pa.binary())], names)
        for i in range(0, len(x["term"]), 1 << 14):
            rows = []
            for k in range(i, min(i + (1 << 14), len(x["term"]))):
                a, z = x["lists"][k], x["lists"][k + 1]
                rows.append((x["rows"][a:z].tobytes(), x["counts"][a:z].tobytes(), x["places"][x["at"][a] : x["at"][z]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), pa.array(x["term"][i : i + len(rows)]), *[pa.array([r[c] for r in rows], pa.binary()) for c in range(3)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                held.append(batch.slice(i, 1000))
                size += sum(int(np.asarray(held[-1].column(c).value_lengths()).sum()) for c in range(2, 2 + len(WEIGHTS)))
                if size >= shard_lexemes:
                    yield from built(shard, held)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield from built(shard, held)

    return run


def build_index(items: DataFrame, shard_lexemes: int = SHARD_LEXEMES) -> DataFrame:
    """The written index of rows (project_id, item_id, a column for each of WEIGHTS). Positions run on through the fields; those
    beyond the last position count as the last, and a row keeps a lexeme's first MOST_POSITIONS."""
    ship(items.sparkSession)
    hashed = [F.transform(lexemes(F.col(c)), lambda w: F.xxhash64(w)).alias(c) for c in WEIGHTS]
    rows = items.select(F.col("project_id").cast("long"), F.col("item_id").cast("long"), *hashed)
    return Scratch(items.sparkSession, "lexical-index").write(rows.mapInArrow(_indexed(shard_lexemes), INDEX), "index")


class Shard:
    """The lists of some lexemes in one shard."""

    def __init__(self, lists: pa.Table, items: np.ndarray, projects: np.ndarray):
        self.items, self.projects = items, projects
        self.row_of = {t: k for k, t in enumerate(lists.column("term").to_pylist())}
        column = lambda name: [np.frombuffer(x.as_buffer(), "<i4") for x in lists.column(name)]
        self.rows, self.counts, self.places = column("rows"), column("counts"), column("places")
        self.ends = [np.cumsum(c) for c in self.counts]
        self.scored = 0

    def holding(self, terms: list[int]) -> np.ndarray:
        """Rows with all of the terms, from the rarest on."""
        if not all(t in self.row_of for t in terms):
            return np.zeros(0, np.int32)
        at = sorted((len(self.rows[self.row_of[t]]), self.row_of[t]) for t in set(terms))
        rows = self.rows[at[0][1]]
        for _, k in at[1:]:
            if len(rows):
                rows = rows[np.isin(rows, self.rows[k], assume_unique=True)]
        return rows

    def of_row(self, term: int, row: int) -> np.ndarray:
        """The places of a term in a row."""
        k = self.row_of.get(term)
        if k is None:
            return np.zeros(0, np.int32)
        at = int(np.searchsorted(self.rows[k], row))
        if at == len(self.rows[k]) or self.rows[k][at] != row:
            return np.zeros(0, np.int32)
        return self.places[k][self.ends[k][at] - self.counts[k][at] : self.ends[k][at]]

    def best(self, project: int, item: int, query: list[Conjunction], k: int) -> list[tuple[float, int]]:
        """(score, item) of the k best rows of a project but for the asking item, equal scores by descending item."""
        keys = [([_key(w) for w in needed], [[_key(w) for w in p] for p in phrases], [_key(w) for w in barred]) for needed, phrases, barred in query]
        rows = np.zeros(0, np.int32)
        for needed, _, barred in keys:
            some = self.holding(needed)
            for t in barred:
                if t in self.row_of:
                    some = some[~np.isin(some, self.rows[self.row_of[t]])]
            rows = np.union1d(rows, some)
        rows = rows[(self.projects[rows] == project) & (self.items[rows] != item)].astype(int)
        if not len(rows):
            return []
        terms = sorted({t for needed, *_ in keys for t in needed})
        sets, in_order = [set(needed) for needed, *_ in keys], any(phrases for _, phrases, _ in keys)

        def satisfied(span: list[tuple[int, int, int]]) -> bool:
            there = {t for *_, t in span}
            if not any(there.issuperset(needed) for needed, *_ in keys):
                return False
            at = {(p, t) for p, _, t in span}
            in_a_row = lambda phrase: any(all((p + i, t) in at for i, t in enumerate(phrase)) for p, t0 in at if t0 == phrase[0])
            return any(there.issuperset(needed) and all(map(in_a_row, phrases)) for needed, phrases, _ in keys)

        strongest = list(WEIGHTS.values())
        found: list[tuple[float, int]] = []
        for row in rows.tolist():
            places = sorted((int(p) >> 2, int(p) & 3, t) for t in terms for p in self.of_row(t, row).tolist())
            # each cover begins at another place, and none weighs more than its strongest field
            if len(found) == k and len(places) * max(strongest[f] for _, f, _ in places) < found[-1][0]:
                continue
            self.scored += 1
            score = round(density(places, satisfied) if in_order else _summed(places, holding_covers(places, sets)), 6)
            if score > 0:
                found = sorted([*found, (score, int(self.items[row]))], key=lambda x: (-x[0], -x[1]))[:k]
        return found


def _answered(k: int):
    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if lists.num_rows and asked.num_rows:
            read = lambda name: np.frombuffer(asked.column(name)[0].as_buffer(), "<i8")
            shard = Shard(lists, read("items"), read("projects"))
            for q in asked.column("queries")[0].as_py():
                out += [(q["query_id"], item, score) for score, item in shard.best(q["project_id"], q["query_id"], _parsed(q["terms"]), k)]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "item_id": pa.array([o[1] for o in out], pa.int64()), "lex_score": pa.array([o[2] for o in out], pa.float64())})

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term) of rows (part, terms): the lexemes that a query's conjunctions name."""
    for batch in batches:
        rows = [(part, _key(w)) for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for needed, _, barred in _parsed(text or "") for w in (*needed, *barred)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["part", "term"])


def search(index: DataFrame, queries: DataFrame, k: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, item_id, lex_score, sparse_rank): the k best other rows of its project for each web query (query_id, project_id,
    terms), equal scores by descending item. A query without a lexeme has none."""
    ship(queries.sparkSession)
    n_blocks = max(1, -(-queries.count() // query_block))
    asked = queries.select(F.col("query_id").cast("long"), F.col("project_id").cast("long"), F.coalesce("terms", F.lit("")).alias("terms"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks).cast("long")).alias("part"))
    wanted = asked.select("part", "terms").mapInArrow(_asked, "part long, term long").distinct()
    lists = index.where("term IS NOT NULL").join(wanted, "term").select("shard", "part", "term", "rows", "counts", "places")
    batches = asked.groupBy("part").agg(F.collect_list(F.struct("query_id", "project_id", "terms")).alias("queries"))
    heads = index.where("term IS NULL").select(F.col("shard").alias("of"), F.col("rows").alias("items"), F.col("counts").alias("projects"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("part"))
    tasks = heads.join(batches, "part").select("of", F.col("part").alias("in_part"), "items", "projects", "queries")
    # a task gets few shards, however many there are
    pairs = n_blocks * index.where("term IS NULL").count()
    if pairs > int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        lists, tasks = lists.repartition(pairs, "shard", "part"), tasks.repartition(pairs, "of", "in_part")
    found = lists.groupBy("shard", "part").cogroup(tasks.groupBy("of", "in_part")).applyInArrow(_answered(k), "query_id long, item_id long, lex_score double")
    return top_k(found, ["query_id"], [F.desc("lex_score"), F.desc("item_id")], k, "sparse_rank")

