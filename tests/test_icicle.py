import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators.icicle import icicle, offsets
from faultline.sources.shared import Scratch


def laid_out(templates):
    """Cells of one tree by recursion: {path: (value, x0, x1)} in fractions of the whole, and the tree's height."""
    templates = [(pattern or "", n or 1) for pattern, n in templates]

    def build(prefix):
        below = [(re.split(r"\s+", p)[:4], p, n) for p, n in templates if re.split(r"\s+", p)[:4][: len(prefix)] == prefix]
        longer = [w for w, _, _ in below if len(w) > len(prefix)]
        children = [build(prefix + [w]) for w in sorted({w[len(prefix)] for w in longer})]
        children.sort(key=lambda c: (-c["value"], c["first"]))
        own = 1 if children else sum(n for _, _, n in below)
        return {"prefix": prefix, "value": own + sum(c["value"] for c in children), "first": min((-n, p) for _, p, n in below), "children": children}

    root, cells = build([]), {}

    def walk(node, at):
        for c in node["children"]:
            cells[tuple(c["prefix"])] = (c["value"], at / root["value"], (at + c["value"]) / root["value"])
            walk(c, at)
            at += c["value"]

    walk(root, 0)
    return cells, max(map(len, cells))


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_are_those_of_a_recursive_layout(spark, written, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), rng.choice([0, 1, 1, 2, 9, None])) for _ in range(120)]
    rows += [(1, None, 3), (1, "", 2), (2, " a  b", 1), (2, "a\tb c", 4), (3, "only", 7), (3, "only", 7), (4, "x " * 5000, 1)]
    df = written(rows, "tree long, pattern string, n long", 3)
    got = {}
    for r in icicle(df, Scratch(spark, "t"), "tree").collect():
        got.setdefault(r.tree, {})[tuple(r.path.split(" "))] = r
    assert set(got) == {1, 2, 3, 4, None}
    for tree, cells in got.items():
        want, height = laid_out([r[1:] for r in rows if r[0] == tree])
        assert {p: (r.value, r.x0, r.x1) for p, r in cells.items()} == want
        for p, r in cells.items():
            assert (r.depth, r.name, r.y0, r.y1) == (len(p), p[-1], len(p) / (height + 1), (len(p) + 1) / (height + 1))
            # children lie in their parent and don't overlap
            inner = sorted((c.x0, c.x1) for q, c in cells.items() if q[:-1] == p)
            assert all(a[1] <= b[0] for a, b in zip(inner, inner[1:])) and (not inner or inner[0][0] == r.x0 and inner[-1][1] < r.x1)


def test_no_templates_no_cells(spark, written):
    assert icicle(written([], "tree long, pattern string, n long", 1), Scratch(spark, "t"), "tree").count() == 0


def test_a_key_with_most_rows_is_summed_in_shares(spark, written):
    rng = random.Random(3)
    rows = [("hot" if k % 5 else rng.choice("ab"), k, rng.randint(0, 9)) for k in range(3000)] + [(None, 1, 2), (None, 2, 3)]
    df = written(rows, "key string, place long, v long", 4).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scratch = Scratch(spark, "t")
        got = {(r.key, r.place): r.before for r in offsets(df, scratch, ["key"], [F.desc("place")], "v").collect()}
        shares = spark.read.parquet(scratch.paths["shares"][0])
        assert shares.where("key = 'hot'").select("share").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for key in ("hot", "a", "b", None):
        at = 0
        for _, place, v in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            assert got[key, place] == at
            at += v
