"""What may grow in memory and what may not, with brute force beside it."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from faultline.operators import retrieval, vector_index
from faultline.operators.grouping import TemplateTree, mine_templates
from faultline.operators.icicle import icicle
from faultline.operators.lexical_index import covers, holding_covers
from faultline.operators.relational import top_k
from faultline.plans import registry, relational
from faultline.sources.shared import Scratch
from tests.test_queries import PATH


def logical(df):
    """The operators of the optimised plan from the top down."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_pairs_are_not_aggregated(spark):
    plan = logical(registry.QUERIES["j13_array_overlap"](spark, PATH))
    assert plan.index("Join") < plan.index("Aggregate")  # sets are made before pairs, and nothing gathers pairs


def test_overlapping_pairs_in_shares(spark):
    sets = {i: sorted({i % 3, i % 5, i % 4}) for i in range(120)}
    rows = [(1 + i % 2, i, t, [x for x in s if x < t]) for i, s in sets.items() for t in s]
    parts = spark.createDataFrame(rows, "project_id int, item_id long, t int, less array<int>")
    got = sorted((r.item_id, r.other_id) for r in relational._meeting(parts, len(sets), 7).collect())
    assert got == [(a, b) for a in range(0, 120, 50) for b in range(120) if a != b and a % 2 == b % 2 and set(sets[a]) & set(sets[b])]


def test_trigram_leg_meets_few_items_of_a_text(spark, written):
    items = written([(1 + i % 2, i, f"a.b.Fault{i % 3}Error" if i % 7 else "") for i in range(900)] + [(1, 4, "a.b.Fault1Error")], "project_id int, item_id long, exc_text string")
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    order = ["query_id"], [F.desc("lex_score"), F.desc("item_id")], 5
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "item_id", "lex_score", "rank").collect())
    best = retrieval.trigram_best(queries, items, 5)
    assert rows(top_k(best, *order)) == rows(top_k(retrieval.trigram_hits(queries, items), *order))
    assert best.count() <= queries.count() * 7  # not the 300 items of each like text


def test_covers_of_lexemes_in_one_pass():
    rng = random.Random(4)
    for _ in range(500):
        places = [(p, 0, rng.randrange(5)) for p in sorted(rng.choices(range(40), k=rng.randint(0, 30)))]
        needed = [set(rng.sample(range(5), rng.randint(1, 3))) for _ in range(rng.randint(1, 2))]
        places = [p for p in places if any(p[2] in n for n in needed)]
        satisfied = lambda span: any({t for *_, t in span} >= n for n in needed)  # noqa: E731, B023
        assert list(holding_covers(places, needed)) == list(covers(places, satisfied))


def test_visits_give_no_row_under_the_bar():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(3, 8))
    cosine = vector_index.unit(q) @ vector_index.unit(x).T
    bars = [-2.0, float(np.sort(cosine[1])[-4]), 2.0]
    asked = [[{"query_id": i, "emb": list(q[i]), "bar": bars[i]} for i in range(3)]]
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("emb", pa.list_(pa.float64())), ("bar", pa.float64())]))
    row = pa.RecordBatch.from_arrays([pa.array([np.arange(200, 400, dtype="<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()]), pa.array(asked, kind)], ["ids", "vectors", "asked"])
    got = [b.to_pydict()["query_id"] for b in vector_index._scored(50)([row])][0]
    assert [got.count(i) for i in range(3)] == [50, 4, 0]


def test_few_rows_are_made_at_once():
    lists = vector_index._ordered(vector_index.unit(np.random.default_rng(1).normal(size=(1024, 4))), 1024)
    rows = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([1] * 100), pa.array([[1.0, 0.0, 2.0, 1.0]] * 100)], ["query_id", "project_id", "emb"])
    sizes = [b.num_rows for b in lists([rows])]
    assert sum(sizes) == 100 * 1024 and max(sizes) <= vector_index.ROWS


def test_icicle_holds_first_words_only(spark, written):
    tails = ["", " ", "\tx", "\x01", "c", "  y", "\n", " z" * 4000]
    rows = [(t, 1) for a in ("a b c d", "a b", " a", "a  b c d", "a\tb c e", "") for t in (a + x for x in tails)]
    held = []

    class Space(Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            held.append((name, out))
            return out

    got = icicle(written(rows, "pattern string, n long").withColumn("t", F.lit(1)), Space(spark, "icicle"), "t").collect()
    cells = next(df for name, df in held if name == "cells")
    assert cells.agg(F.max(F.length("first.pattern"))).first()[0] < 20
    whole: dict = {}
    for text, n in rows:  # the least pattern of each cell
        words = spark_words(text)
        for d in range(1, len(words) + 1):
            whole[words[:d]] = min(whole.get(words[:d], text), text)
    for a in got:
        for b in got:
            pa_, pb = tuple(a.path.split(" ")), tuple(b.path.split(" "))
            if len(pa_) == a.depth and len(pb) == b.depth and a.depth == b.depth and pa_[:-1] == pb[:-1] and pa_ != pb and a.value == b.value:
                assert (a.x0 < b.x0) == (whole[pa_] < whole[pb])


def spark_words(text):
    import re

    return tuple(re.split("[ \\t\\n\\x0b\\f\\r]+", text)[:4])


def test_mining_takes_lines_in_batches(spark, written):
    """A shard's lines are streamed in order, so the outcome doesn't depend on how many are sent at once."""
    rows = [(1 + i % 2, i // 3, f"w{i * 7 % 5} opens door {i % 11} of v{i % 13}x house{i % 4}") for i in range(400)]
    lines = written(rows, "p long, pos long, line string", 3)
    want: dict = {}
    for p in (1, 2):
        shard: dict = {}
        of = {r.pos: r.s for r in lines.select("pos", F.pmod(F.xxhash64("pos"), F.lit(4)).alias("s")).collect()}
        for _, pos, line in sorted(r for r in rows if r[0] == p):
            tree, counts = shard.setdefault(of[pos], (TemplateTree(), {}))
            c, _ = tree.add(line)
            counts[c] = counts.get(c, 0) + 1
        found: dict = {}
        for tree, counts in shard.values():
            for c, t in tree.templates.items():
                found[" ".join(t)] = found.get(" ".join(t), 0) + counts[c]
        whole, counts = TemplateTree(), {}
        for t, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            c, _ = whole.add(t)
            counts[c] = counts.get(c, 0) + n
        for c, t in whole.templates.items():
            want[p, " ".join(t)] = want.get((p, " ".join(t)), 0) + counts[c]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        mined = mine_templates(lines, "p", ["pos", "line"], "line", 4)
        assert "MapInPandas" in logical(mined)
        assert {(r.p, r.template): r.n for r in mined.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_leaf_forgets_templates_that_are_gone(monkeypatch):
    from faultline.operators import grouping

    monkeypatch.setattr(grouping, "MAX_CLUSTERS", 3)
    tree = TemplateTree()
    for i in range(50):
        tree.add(f"start {chr(97 + i % 26)}{chr(97 + i // 26)} {chr(98 + i % 24)}x {chr(99 + i % 23)}y {chr(100 + i % 22)}z")
    assert sum(map(len, tree.leaves.values())) <= 4
