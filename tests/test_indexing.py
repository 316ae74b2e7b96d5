import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.operators.indexing import RAW, TABLES, index_batch
from faultline.sources.published import Published

DAY = dt.datetime(2024, 3, 1)
STACK = "java.lang.IllegalStateException: cart is empty\n\tat org.shop.Cart.total(Cart.java:7)\n\tat org.shop.Pay.run(Pay.java:9)\n\tat org.shop.Main.go(Main.java:1)"


def raw(project, item, logs, launch=1, test=11, issue=" PB001 "):
    """Rows of one item: logs as (id, level, seconds, message)."""
    head = (project, launch, "nightly", item, test, issue, DAY)
    return [(*head, i, level, DAY + dt.timedelta(seconds=s), m) for i, level, s, m in logs] or [(*head, None, None, None, None)]


def batch(spark, rows):
    return spark.createDataFrame(rows, RAW).repartition(3)


@pytest.fixture
def published(spark, tmp_path):
    return Published(spark, f"file://{tmp_path}/published", TABLES)


def content(published):
    return {t: sorted(map(repr, published.read(t).collect())) for t in TABLES}


def test_a_batch_twice_changes_nothing(spark, published):
    rows = raw(1, 1, [(5, 40000, 2, "step 1 failed: timeout"), (4, 40000, 1, STACK), (3, 30000, 0, "a warning")]) + raw(1, 2, [], test=0, issue="") + raw(2, 3, [(9, 50000, 4, "step 7 failed: timeout"), (10, 40000, 5, "  ")])
    assert index_batch(batch(spark, rows + rows[:2]), published, "b1").published
    items = {r.item_id: r for r in published.read("items").collect()}
    assert (items[1].issue_type, items[1].error_log_id, items[1].last_log) == ("pb001", 4, DAY + dt.timedelta(seconds=2))
    assert (items[2].issue_type, items[2].test_case_hash, items[2].error_log_id, items[2].seen_at) == (None, None, None, DAY)
    signatures = {r.item_id: r for r in published.read("signatures").collect()}
    assert set(signatures) == {1, 3} and signatures[1].error_log_id == 4 and signatures[1].exceptions == ["java.lang.IllegalStateException"] and signatures[1].frames[0].startswith("org.shop.Cart.total")
    assert len(signatures[1].templates) == 2 and signatures[3].templates == [hashlib.md5(b"step <NUM> failed: timeout").hexdigest()] and signatures[3].templates[0] in signatures[1].templates
    assert signatures[1].exception_fp != 0 == signatures[3].exception_fp and signatures[1].error_hash != signatures[3].error_hash
    assert {(r.test_case_hash, r.runs) for r in published.read("history").collect()} == {(11, 1)}
    assert {r.log_id: r.exceptions for r in published.read("found").collect()} == {4: ["java.lang.IllegalStateException"], 5: [], 9: []}
    before, number = content(published), published.manifest()["number"]
    again = index_batch(batch(spark, rows), published, "b1")
    assert not again.published and content(published) == before and published.manifest()["number"] == number


def test_a_poisoned_project_leaves_the_others(spark, published):
    good = raw(1, 1, [(4, 40000, 1, STACK)])
    poisoned = [*raw(2, 5, [(8, 40000, 1, STACK)]), (2, 1, "nightly", None, 1, "pb001", DAY, 6, 40000, DAY, "x")]
    spread = raw(3, 6, [(11, 40000, 1, "a b")], launch=1) + raw(3, 6, [(12, 40000, 1, "a b")], launch=2)
    level = raw(4, 7, [(13, None, 1, "a b")])
    run = index_batch(batch(spark, good + poisoned + spread + level), published, "b1")
    status = {r.project_id: (r.failed, r.reason, r["items"]) for r in run.status.collect()}
    assert status == {1: (False, None, 1), 2: (True, "a row names no item", 0), 3: (True, "an item is in two launches", 0), 4: (True, "a log has no level", 0)}
    assert {r.project_id for r in published.read("items").collect()} == {1} == {r.project_id for r in published.read("signatures").collect()}
    # mended, the project comes in, and what was there stays
    index_batch(batch(spark, raw(2, 5, [(8, 40000, 1, STACK)])), published, "b2")
    assert {(r.project_id, r.item_id) for r in published.read("items").collect()} == {(1, 1), (2, 5)}


def test_a_later_batch_replaces_items_and_counts_on(spark, published):
    index_batch(batch(spark, raw(1, 1, [(4, 40000, 1, STACK)]) + raw(1, 2, [(6, 40000, 1, "disk full")])), published, "b1")
    index_batch(batch(spark, raw(1, 1, [(7, 40000, 9, "disk full")], issue="AB001")), published, "b2")
    items = {r.item_id: r.issue_type for r in published.read("items").collect()}
    assert items == {1: "ab001", 2: "pb001"}
    assert {r.item_id: r.error_log_id for r in published.read("signatures").collect()} == {1: 7, 2: 6}
    assert [(r.test_case_hash, r.runs, r.failures) for r in published.read("history").collect()] == [(11, 3, 3)]
    assert {r.template: r.n for r in published.read("templates").collect()}["disk full"] == 2


def test_readers_see_all_of_a_change_or_nothing(spark, published):
    index_batch(batch(spark, raw(1, 1, [(4, 40000, 1, STACK)])), published, "b1")
    before = content(published)

    def broken(old, new):
        return new.withColumn("runs", F.raise_error(F.lit("lost")).cast("long"))

    rows = spark.createDataFrame([(1, 11, 1, 1, DAY)], TABLES["history"][0])
    items = published.read("items").withColumn("issue_type", F.lit("zz"))
    with pytest.raises(Exception, match="lost"):
        published.apply("b2", {"items": items, "history": rows}, {"history": broken})
    assert content(published) == before
    # of two writers that start from one manifest the second is told to run again
    stale = published.manifest()
    index_batch(batch(spark, raw(1, 9, [])), published, "b3")
    with pytest.raises(RuntimeError, match="run this one again"):
        published._switch({**stale, "number": stale["number"] + 1})


def test_empty_batch(spark, published):
    assert index_batch(batch(spark, []), published, "none").published and all(published.read(t).count() == 0 for t in TABLES)
