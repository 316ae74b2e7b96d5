import numpy as np
import pytest

from faultline.operators.vector_index import build_index, comparisons, probes_for, search

SCHEMA = "project_id long, item_id long, emb array<float>"


def rows_of(seed, n, spread):
    """Vectors around a few directions, copies, vectors without a direction, and two projects of which one is small."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 24))
    rows = [(1 + (i % 10 == 0), i, (heads[i % 12] + spread * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1, n + i, rows[3][2]) for i in range(90)]
    return rows + [(1, 5000, None), (1, 5001, [0.0] * 24), (1, 5002, [float("nan")] * 24), (2, 5003, [float("inf")] + [1.0] * 23)]


def expected(rows, asked, k):
    ok = [(p, i, np.array(e, float)) for p, i, e in rows if e is not None and 0 < np.linalg.norm(e) < np.inf]
    out = {}
    for p, q, e in ok:
        if q in asked:
            near = sorted((-round(float(e @ x / (np.linalg.norm(e) * np.linalg.norm(x))), 6), -i) for o, i, x in ok if o == p and i != q)[:k]
            out |= {(q, rank + 1): (-i, -c) for rank, (c, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("spread,k,probes", [(0.2, 50, 3), (3.0, 50, 2), (0.5, 400, 1)])
def test_exact_search(spark, written, spread, k, probes):
    rows = rows_of(1, 900, spread)
    asked = {i for _, i, _ in rows if i % 50 == 0}
    items = written(rows, SCHEMA, 3)
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.dense_rank): (r.item_id, r.cosine) for r in search(build_index(items, sample=300), queries, k, probes).collect()}
    want = expected(rows, asked, k)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_few_lists_find_most(spark, written):
    """Measured recall against brute force, and comparisons that are a part of all pairs."""
    rows = rows_of(2, 1500, 0.3)
    items = written(rows, SCHEMA, 3)
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    index = build_index(items, sample=500)
    want = {(q, i) for (q, _), (i, _) in expected(rows, {i for _, i, _ in rows if i % 50 == 0}, 50).items()}
    probes = probes_for(index, queries, 50)
    found = {(r.query_id, r.item_id) for r in search(index, queries, 50, probes, exact=False).collect()}
    assert len(found & want) >= 0.9 * len(want)
    compared = [r.compared for r in comparisons(index, queries, probes).collect()]
    assert sum(compared) < 0.2 * len(compared) * len(rows)


def test_nothing_to_index(spark, written):
    none = written([(1, 1, None)], SCHEMA, 1)
    assert search(build_index(none), none.withColumnRenamed("item_id", "query_id")).count() == 0


def test_query_reaches_its_recall(spark):
    import os

    from faultline.plans import registry, triage  # noqa: F401

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = registry.QUERIES["r5_dense_probes"](spark, path).collect()
    assert sum(r.recall for r in rows) >= 0.9 * len(rows) > 0
