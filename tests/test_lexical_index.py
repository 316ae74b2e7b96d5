import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.lexical_index import WEIGHTS, _key, build_index, density, lexemes, python_lexemes, search, websearch

SCHEMA = "project_id long, item_id long, " + ", ".join(f"{c} string" for c in WEIGHTS)


def brute_density(tokens, satisfied):
    """All spans of (position, field, word) that are satisfied and hold no smaller one."""
    good = [(a, z) for a in range(len(tokens)) for z in range(a, len(tokens)) if satisfied(tokens[a : z + 1])]
    least = [x for x in good if not any(y != x and y[0] >= x[0] and y[1] <= x[1] for y in good)]
    weights = list(WEIGHTS.values())
    score = 0.0
    for a, z in least:
        span = tokens[a : z + 1]
        score += (len(span) / math.fsum(1 / weights[f] for _, f, _ in span)) / (1 + (span[-1][0] - span[0][0]) - (z - a))
    return score


def test_web_queries():
    assert websearch('a "b c" -d or E.f-g') == [(["a", "b", "c"], [["b", "c"]], ["d"]), (["e.f", "g"], [], [])]
    assert websearch("or or -x ...") == [] and websearch('"open end') == [(["open", "end"], [["open", "end"]], [])]


def test_lexemes_are_those_of_the_queries(spark):
    texts = ["java.lang.NullPointerException: x", "ÄÖ é.ü_1 straße 中文.v2", "a..b .c. d-e HTTP_500 'q' \"r\"", "", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexemes(F.col("t")).alias("l")).withColumn("h", F.transform("l", lambda w: F.xxhash64(w)))
    for r in df.collect():
        assert r.l == python_lexemes(r.t) and r.h == [_key(w) for w in r.l]


def test_cover_density():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
        tokens = [(p, rng.randrange(4), w) for p, w in zip(sorted(rng.sample(range(1, 30), len(words))), words, strict=True)]
        query = rng.choice([[{"a", "b"}], [{"a"}], [{"a", "b", "c"}], [{"a", "b"}, {"c", "d"}]])
        satisfied = lambda span: any({w for *_, w in span} >= q for q in query)  # noqa: E731, B023
        tokens = [t for t in tokens if any(t[2] in q for q in query)]
        assert abs(density(tokens, satisfied) - brute_density(tokens, satisfied)) < 1e-9


@pytest.mark.parametrize("shard_lexemes,query_block", [(4_000_000, 512), (60, 3)])
def test_search(spark, written, shard_lexemes, query_block):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(14)] + ["org.shop.Fault", "or", "HTTP_500"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=rng.randint(0, n)))
    rows = [(1 + i % 3 // 2, i, text(2), text(14), text(4), text(4)) for i in range(300)] + [(1, 900, None, "", None, "w1 w2"), (1, 901, "W1", "w2", "", "")]
    asks = ["w1 w2", "w1 -w3 w4", '"w1 w2" w3', "w1 w2 or w3 w4 w5", "org.shop.fault HTTP_500", "absent w1", "", None, "w1", "or w7", "w1 w1 w2"]
    queries = [(i * 7, 1 + i % 2, a) for i, a in enumerate(asks + asks)]
    index = build_index(written(rows, SCHEMA, 3), shard_lexemes)
    for k in (50, 4):
        want = {}
        for query, project, ask in queries:
            groups = websearch(ask or "")
            found = []
            for p, item, *fields in rows:
                words = [(f, w) for f, t in enumerate(fields) for w in python_lexemes(t or "")]
                tokens = [(at + 1, f, w) for at, (f, w) in enumerate(words)]
                there = {w for *_, w in tokens}
                if p != project or item == query or not any(there.issuperset(g[0]) and not there & set(g[2]) for g in groups):
                    continue

                def satisfied(span, groups=groups):
                    at, names = {(pos, w) for pos, _, w in span}, {w for *_, w in span}
                    return any(names.issuperset(g[0]) and all(any(all((pos + i, w) in at for i, w in enumerate(ph)) for pos, _, _ in span) for ph in g[1]) for g in groups)

                score = round(brute_density([t for t in tokens if any(t[2] in g[0] for g in groups)], satisfied), 6)
                if score > 0:
                    found.append((-score, -item))
            want |= {(query, r + 1): (-i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
        got = {(r.query_id, r.sparse_rank): (r.item_id, r.lex_score) for r in search(index, written(queries, "query_id long, project_id long, terms string", 2), k, query_block).collect()}
        assert got.keys() == want.keys() and len(want) > 40
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1.1e-6 for x in want)


def test_many_rows_are_passed_unscored(written):
    """A row whose lexemes occur too seldom to be among the best is not scored."""
    import numpy as np
    import pyarrow as pa

    from faultline.operators.lexical_index import Shard, _lists

    texts = [["w1", "w2"] * 10] * 5 + [["w1", "x", "x", "w2"]] * 500
    hashes = np.array([_key(w) for t in texts for w in t], np.int64)
    none = (np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    x = _lists([none, (hashes, np.array([len(t) for t in texts])), none, none], len(texts))
    lists = [(t, x["rows"][a:z].tobytes(), x["counts"][a:z].tobytes(), x["places"][x["at"][a] : x["at"][z]].tobytes()) for t, a, z in zip(x["term"].tolist(), x["lists"][:-1], x["lists"][1:], strict=True)]
    shard = Shard(pa.table({n: [r[k] for r in lists] for k, n in enumerate(("term", "rows", "counts", "places"))}), np.arange(len(texts)), np.ones(len(texts), int))
    assert [i for _, i in shard.best(1, -1, websearch("w1 w2"), 5)] == [4, 3, 2, 1, 0] and shard.scored == 5
