import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import chains, cleaning, labels, text
from faultline.operators.grouping import TemplateTree, drop_near_duplicates, group_failures, mine_templates
from faultline.operators.relational import as_of, delete_matching, latest, upsert


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_masks(spark):
    line = "GET https://a.b/c?d from 10.0.0.1:80 id 123e4567-e89b-12d3-a456-426614174000 at 0xDEADbeef in /usr/lib/x.so took 12.5 of v2"
    assert one(spark, line, text.mask) == "GET <URL> from <IP> id <UUID> at <HEX> in <PATH> took <NUM> of v2"
    assert one(spark, None, text.mask) is None


def test_chains(spark):
    message = "java.lang.NullPointerException: x\nCaused by: a.b.Io$1Failure, status code: 503"
    chain = one(spark, message, lambda c: chains.exception_chain(cleaning.exceptions(F.replace(c, F.lit("$1"), F.lit(""))), c))
    assert chain == ["a.b.IoFailure", "java.lang.NullPointerException"]
    assert one(spark, "", lambda c: chains.exception_chain(cleaning.exceptions(c), c)) == []
    assert one(spark, "a.B$$Lambda$12.run", chains.normal_class) == "a.B"


def test_frames(spark):
    stack = " at java.util.List.get(List.java:1)\n at a.b.C$1.d(C.java:1)\n at a.b.C.d(C.java:2)\n  File \"lib/x.py\", line 3, in run\n at org.junit.R.r(R.java:9)\nno frame\n at z.y.X.w(X.java:5)"
    assert one(spark, stack, chains.frames) == ["a.b.C.d", "x.run", "z.y.X.w"]
    assert one(spark, stack, lambda c: chains.frames(c, F.array(F.lit("z.y")))) == ["z.y.X.w", "a.b.C.d", "x.run"]
    assert one(spark, None, chains.frames) == []


def test_messages(spark):
    assert one(spark, "expected: 5 but was: 7\nrow 12", chains.masked_message) == "expected <VAL> row <NUM>"
    assert one(spark, "actual 12 rows", chains.masked_message) == "actual <NUM> rows"
    assert one(spark, "\n".join(f"l{i}" for i in range(12)), chains.masked_message) == " ".join(f"l{i}" for i in range(8))
    got = spark.range(1).select(chains.folded_context(F.array(*[F.lit(f"slow  query {i}\nx") for i in range(7)], F.lit(" "))).alias("c")).first().c
    assert got == " ".join(["ctx slow query <NUM>"] * 4)


def test_documents(spark):
    lit = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    doc = lambda m, n: spark.range(1).select(chains.document(F.lit("t"), lit("E"), F.lit(m), lit("f.g"), lit(*[f"t{i}" for i in range(n)]), lit("503")).alias("d")).first().d
    assert doc("", 0) == "TEST: t\nEXC: E\nMSG: <no message>\nFRAMES: f.g\nCODES: HTTP_503"
    assert doc("m", 40).count(" t") == 31 and len(doc("m" * 1900, 30)) <= 2000
    long = doc("m" * 5000, 5)
    assert len(long) == 2000 and long.endswith("TEMPLATES: t0 t1 t2 t3 t4\nCODES: HTTP_503")


def test_xxh3(spark):
    import xxhash

    rows = spark.createDataFrame([("a",), ("",), (None,), ("é" * 50,)], "x string").select("x", chains.xxh3(F.col("x")).alias("h")).collect()
    assert all((r.h is None) if r.x is None else r.h % (1 << 64) == xxhash.xxh3_64_intdigest(r.x.encode()) for r in rows)


@pytest.mark.parametrize(("label", "group"), [("PB001", "pb"), ("ab_x", "ab"), ("ti001", None), ("", None), (None, None), ("nd", "nd")])
def test_base_group(spark, label, group):
    assert one(spark, label, labels.base_group) == group


def test_numbers(spark):
    row = spark.range(1).select(labels.clamp01(F.lit(float("nan"))).alias("a"), labels.clamp01(F.lit(3.0)).alias("b"), labels.decay(F.lit(90.0)).alias("c"), labels.decay(F.lit(-1.0)).alias("d"), labels.band(F.lit(0.75)).alias("e"), labels.band(F.lit(0.4499)).alias("f")).first()
    assert (row.a, row.b, row.d, row.e, row.f) == (0.0, 1.0, 1.0, "auto", "abstain") and abs(row.c - 0.5) < 1e-9


def test_jaccard_of_empty_sets(spark):
    a = F.array().cast("array<int>")
    row = spark.range(1).select(text.jaccard(a, a).alias("zero"), text.jaccard(a, a, 1.0).alias("one"), text.jaccard(F.lit(None).cast("array<int>"), F.array(F.lit(1))).alias("none")).first()
    assert (row.zero, row.one, row.none) == (0.0, 1.0, 0.0)


def test_latest_upsert_delete(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert sorted(map(tuple, latest(rows, ["k"], ["t"], ["v"]).collect())) == [(1, "b"), (2, None)]
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, e int")
    new = spark.createDataFrame([(2, None, None), (3, "c", 7)], "k int, v string, e int")
    assert sorted(map(tuple, upsert(old, new, ["k"], ("e",)).collect())) == [(1, "a", 5), (2, None, 6), (3, "c", 7)]
    assert [r.k for r in delete_matching(rows, F.col("v") == "a").collect()] == [1, 2]


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "k string, id int, at int")
    right = spark.createDataFrame([("a", 10, 1, "x"), ("a", 10, 2, "y"), ("a", 15, 3, None), ("b", 6, 4, "z")], "k string, ts int, tie int, v string")
    got = {r.id: (r.tie, r.v) for r in as_of(left, right, ["k"], "at", "ts", "tie", ["tie", "v"]).collect()}
    assert got == {1: (2, "y"), 2: (3, None), 3: (None, None)}


def test_templates():
    tree = TemplateTree()
    ids = [tree.add(x)[0] for x in ("open file alpha now", "open file beta now", "close socket", "open file gamma now")]
    assert ids[0] == ids[1] == ids[3] != ids[2] and tree.add("open file delta now")[1] == "open file <*> now"


def test_templates_are_found_again():
    tree = TemplateTree()
    lines = [f"user {k} did {w} in room {k % 5}" for k in range(50) for w in ("open", "close")] + [f"error at step {k}" for k in range(20)]
    names = [tree.add(x)[1] for x in lines]
    again = TemplateTree.of([" ".join(t) for t in tree.templates.values()])
    assert sum(again.match(x) is not None for x in lines) >= 0.95 * len(lines) and again.match("nothing like that here at all") is None and len(set(names)) > 1


def test_mined_templates(spark):
    rows = spark.createDataFrame([(1, i, f"step {w} done") for i, w in enumerate(("one", "two", "three"))] + [(2, 0, "step one done")], "p long, pos int, line string")
    got = {(r.p, r.template): r.n for r in mine_templates(rows, "p", ["pos"], "line").collect()}
    assert got == {(1, "step <*> done"): 3, (2, "step one done"): 1}


def test_groups(spark):
    e = np.eye(3)
    rows = [(1, 1, 7, e[0].tolist(), [1]), (1, 2, 7, e[0].tolist(), [1]), (1, 3, 0, (e[0] + 0.1 * e[1]).tolist(), [2]), (1, 4, 0, e[2].tolist(), [3]), (2, 5, 0, e[0].tolist(), [1])]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 1, 9, 7, e[2].tolist(), [1])], "project_id long, launch_id long, item_id long, exception_fp int, emb array<double>, template_ids array<int>")
    got = {r.item_id: (r.launch_id, r.group_no) for r in group_failures(df).collect()}
    assert got[1] == got[2] == got[3] and got[4] != got[1] and got[5] == (2, 0) and got[9] == (1, 0)


def test_near_duplicate_logs_give_way_to_the_last():
    assert drop_near_duplicates(["a b c", "x y", "a b c", "", ""]) == [1, 2, 3, 4]
    assert drop_near_duplicates(["", ""]) == [0, 1] and drop_near_duplicates(["a"]) == [0]
    # 0 is near 1, 1 is near 2, 0 isn't near 2: 1 has been given way to, so it stays
    texts = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in (0, 2, 4)]
    assert drop_near_duplicates(texts, 0.91) == [1, 2]


def test_streams(spark, tmp_path):
    from faultline.streaming.history import flakiness, parsed

    rows = pd.DataFrame({"test_case_hash": [1, 1, 1, 2], "event_id": [1, 2, 3, 4], "failed": [False, True, False, True], "ts": pd.to_datetime(["2024-01-01"] * 4)})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("test_case_hash long, event_id long, failed boolean, ts timestamp").parquet(f"{tmp_path}/in")
    flakiness(source).writeStream.format("memory").queryName("flaky").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r.test_case_hash: (r.runs, r.failures, r.flips, round(r.flakiness, 6)) for r in spark.table("flaky").collect()}
    assert got == {1: (3, 1, 2, 0.19), 2: (1, 1, 0, 0.0)}
    good, bad = parsed(spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1
