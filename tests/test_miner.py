import random

import pytest

from faultline.operators.grouping import TemplateTree
from faultline.streaming.miner import PROVIDER, loaded, match_templates, mined, stored, trie

SCHEMA = "project_id long, at long, line string"


def log_lines(seed, n):
    rng = random.Random(seed)
    kinds = ["user {} did open in room {}", "step {} of job_{} done", "close socket", "retry {} failed: timeout", "a b c d e {}", "42 items", "{} | {}", ""]
    return [(rng.choice([1, 1, 2]), k, rng.choice(kinds).format(rng.randint(0, 30), rng.choice("xyz"))) for k in range(n)]


def sequential(lines):
    """One tree a project over all lines in order: {(project, cluster): (template, n)}."""
    out = {}
    for project in {p for p, *_ in lines}:
        tree, counts = TemplateTree(), {}
        for _, _, line in sorted((r for r in lines if r[0] == project), key=lambda r: r[1:]):
            if line.strip():
                c, _ = tree.add(line)
                counts[c] = counts.get(c, 0) + 1
        out |= {(project, c): (" ".join(t), counts[c]) for c, t in tree.templates.items()}
    return out


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def test_stream_agrees_with_one_pass_and_goes_on_after_a_restart(spark, rocks, tmp_path):
    lines = log_lines(1, 300)
    told = {}

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")

        def keep(batch, epoch):
            for r in batch.collect():
                assert r.version > told.get((r.project_id, r.cluster), (None, None, 0))[2]
                told[r.project_id, r.cluster] = (r.template, r.n, r.version)

        mined(source).writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()

    # the second run starts from the state that the first left
    for a, z in ((0, 120), (120, 300)):
        run(lines[a:z])
        assert {k: v[:2] for k, v in told.items() if k in sequential(lines[:z])} == sequential(lines[:z])


def test_trees_are_stored_whole():
    tree, counts = TemplateTree(), {}
    for _, _, line in log_lines(2, 200):
        c, _ = tree.add(line)
        counts[c] = counts.get(c, 0) + 1
    again, n = loaded(stored(tree, counts))
    assert n == counts and list(again.templates.items()) == list(tree.templates.items())
    for _, _, line in log_lines(3, 200):
        assert again.match(line) == tree.match(line) and again.add(line) == tree.add(line)


def test_matches_are_those_of_a_tree(spark, written):
    lines, stored_rows = log_lines(4, 250), []
    for project in (1, 2):
        tree, counts = TemplateTree(), {}
        for p, _, line in lines[:120]:
            if p == project and line.strip():
                c, _ = tree.add(line)
                counts[c] = counts.get(c, 0) + 1
        stored_rows += [(project, " ".join(t), counts[c]) for c, t in tree.templates.items()]
    asked = lines + [(3, 1, "close socket"), (1, 2, None), (1, 3, "   "), (2, 4, "nothing like that here")]
    leaves = trie(written(stored_rows, "project_id long, template string, n long", 1))
    got = {(r.project_id, r["at"], r.line): r.template for r in match_templates(written(asked, SCHEMA, 3), leaves).collect()}
    for p, at, line in asked:
        order = sorted(((-n, t) for q, t, n in stored_rows if q == p))
        assert got[p, at, line] == (TemplateTree.of([t for _, t in order]).match(line) if line and line.strip() else None), (p, line)


def test_a_stream_is_matched_like_a_table(spark, written, tmp_path):
    leaves = trie(written([(1, "close socket", 3), (1, "step <*> done", 2)], "project_id long, template string, n long", 1))
    rows = [(1, 1, "step 7 done"), (1, 2, "close socket"), (2, 3, "close socket")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/in")
    got = []
    stream = match_templates(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), leaves)
    stream.writeStream.foreachBatch(lambda b, e: got.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r["at"]: r.template for r in got} == {1: "step <*> done", 2: "close socket", 3: None}
