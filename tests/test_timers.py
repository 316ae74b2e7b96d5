import os
import random
from datetime import datetime, timedelta

import pytest

from faultline.streaming.miner import PROVIDER
from faultline.streaming.timers import orphans, retrain_requests

T0 = datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def streamed(spark, tmp_path, batches, schema, operator):
    """The rows that a stream gives for batches that come one after the other, each in a run of its own."""
    got = []
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        run = operator(source).writeStream.foreachBatch(lambda d, e: got.extend(tuple(r) for r in d.collect())).option("checkpointLocation", f"file://{tmp_path}/state")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return got


def minutes(m):
    return T0 + timedelta(minutes=m)


EVENTS = "model string, at timestamp, kind string"


def decisions(rows, end, threshold=100):
    """What is decided up to ``end``, minute by minute, from the rules: no timers, no state but plain variables."""
    out, shipped, failed, cold, asked, new, want = [], None, None, False, None, 0, False

    def free(reason, at):
        held = shipped is not None and at - shipped < timedelta(hours=1)
        held |= failed is not None and at - failed < timedelta(minutes=5) and (reason == "events" or not cold)
        return not held and not (asked is not None and at - asked < timedelta(hours=1))

    by_time = {}
    for _, t, k in rows:
        by_time.setdefault(t, []).append(k)
    at = rows[0][1]
    while at < end:
        if at.hour == 2 and at.minute == 0 and at > rows[0][1]:
            ok = free("nightly", at)
            out.append((at, "nightly", "train" if ok else "debounced"))
            asked, want = (at, False) if ok else (asked, want)
        if want and free("events", at):
            out.append((at, "events", "train"))
            asked, want = at, False
        kinds = sorted(by_time.get(at, []))
        for kind in dict.fromkeys(kinds):
            if kind == "label":
                new += kinds.count("label")
                enough = shipped is None or new >= threshold
                if enough and free("events", at):
                    out.append((at, "events", "train"))
                    asked, want = at, False
                else:
                    want |= enough
            elif kind == "route":
                ok = free("route", at)
                out.append((at, "route", "train" if ok else "debounced"))
                asked, want = (at, False) if ok else (asked, want)
            elif kind == "shipped":
                shipped, failed, cold, asked, new, want = at, None, False, None, 0, False
            else:
                failed, cold, asked = at, kind == "cold", None
        at += timedelta(minutes=1)
    return out


def test_trainings_debounce_cool_down_and_run_at_night(spark, rocks, tmp_path):
    rows = [("m", minutes(0), "label"), ("m", minutes(3), "cold"), ("m", minutes(4), "label"), ("m", minutes(5), "route"), ("m", minutes(6), "shipped")]
    rows += [("m", minutes(20), "label")] * 99 + [("m", minutes(30), "label"), ("m", minutes(40), "route"), ("m", minutes(70), "rejected"), ("m", minutes(71), "route")]
    rows += [("m", minutes(100), "shipped"), ("m", minutes(3000), "label")]
    got = streamed(spark, tmp_path, [rows[:5], rows[5:80], rows[80:]], EVENTS, retrain_requests)
    assert sorted(r[1:] for r in got if r[1] < minutes(2000)) == sorted([
        (minutes(0), "events", "train"), (minutes(5), "route", "train"), (minutes(40), "route", "debounced"),
        # a hundred labels had come while the model was new
        (minutes(66), "events", "train"), (minutes(71), "route", "debounced"), (minutes(840), "nightly", "train"),
    ])


@pytest.mark.parametrize("seed", [1, 2])
def test_trainings_are_those_of_a_clock_whatever_the_batches(spark, rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for model in ("a", "b"):
        at = 0
        for _ in range(140):
            at += rng.choice([0, 1, 2, 5, 17, 60])
            rows += [(model, minutes(at), kind) for kind in [rng.choice(["label"] * 5 + ["route", "shipped", "rejected", "cold"])] for _ in range(rng.choice([1, 30]) if kind == "label" else 1)]
    rows.sort(key=lambda r: r[1])
    # the last row only lets time go on
    end = rows[-1][1] + timedelta(days=1)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    got = streamed(spark, tmp_path, [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :] + [("z", end, "route")]], EVENTS, retrain_requests)
    until = end - timedelta(minutes=11)
    for model in ("a", "b"):
        want = decisions([r for r in rows if r[0] == model], until)
        assert sorted(r[1:] for r in got if r[0] == model) == sorted(want)


def test_a_training_row_that_is_too_late_is_not_counted(spark, rocks, tmp_path):
    batches = [[("m", minutes(0), "shipped"), ("m", minutes(90), "label")] + [("m", minutes(91), "label")] * 98, [("m", minutes(60), "label"), (None, minutes(95), "label"), ("m", None, "label")], [("m", minutes(300), "route")], [("z", minutes(400), "route")]]
    got = streamed(spark, tmp_path, batches, EVENTS, retrain_requests)
    assert [r for r in got if r[0] == "m"] == [("m", minutes(300), "route", "train")]


ITEMS = "project_id long, item_id long, at timestamp, kind string"


def days(d):
    return T0 + timedelta(days=d)


def reaped(rows, end, grace=30):
    """Mark, unmark and sweep after each row, for rows in order of time."""
    out = []
    for key in {r[:2] for r in rows}:
        present, labels, marked = False, 0, None
        for _, _, at, kind in [*(r for r in rows if r[:2] == key), (0, 0, end, "")]:
            if marked is not None and grace > 0 and marked + timedelta(days=grace) < at:
                out.append((*key, marked + timedelta(days=grace), "swept", labels))
                marked, labels = None, 0
            labels += kind == "label"
            present = {"item": True, "gone": False}.get(kind, present)
            if kind and marked is None and labels and not present:
                marked = at
                out.append((*key, at, "marked", labels))
            elif kind and marked is not None and present:
                marked = None
                out.append((*key, at, "unmarked", labels))
    return sorted(out)


@pytest.mark.parametrize("grace", [30, 0])
def test_orphans_are_marked_unmarked_and_swept(spark, rocks, tmp_path, grace):
    rng = random.Random(7)
    rows = sorted({(1, rng.randint(1, 6), days(rng.randint(0, 300)), rng.choice(["label", "label", "item", "gone"])) for _ in range(120)}, key=lambda r: (r[2], {"item": 0, "label": 1, "gone": 2}[r[3]]))
    got = streamed(spark, tmp_path, [rows[:50], rows[50:70], [*rows[70:], (9, 9, days(500), "item")]], ITEMS, lambda s: orphans(s, grace))
    assert sorted(got) == reaped(rows, days(499), grace)
    assert ("swept" in {r[3] for r in got}) == (grace > 0)


def test_late_rows_of_items_count(spark, rocks, tmp_path):
    batches = [
        # 1 is marked on day 0, as its item is missing; 2 has its item
        [(1, 1, days(0), "label"), (1, 2, days(0), "item"), (1, 2, days(1), "label"), (1, 3, days(0), "item"), (1, 8, days(10), "label")],
        # late: item 1 was there all the time; of item 2's a deletion that is older than its writing; an old label of a missing item
        [(1, 1, days(2), "item"), (1, 2, days(0) - timedelta(days=3), "gone"), (1, 4, days(-90), "label")],
        [(1, None, days(3), "label"), (1, 5, days(3), "other"), (1, 9, days(39), "item")],
        [(1, 9, days(41), "item")],
    ]
    seen = days(10) - timedelta(hours=1)
    got = streamed(spark, tmp_path, batches, ITEMS, orphans)
    assert sorted(got) == sorted([
        (1, 1, days(0), "marked", 1), (1, 1, seen, "unmarked", 1), (1, 4, seen, "marked", 1), (1, 8, days(10), "marked", 1),
        (1, 4, seen + timedelta(days=30), "swept", 1), (1, 8, days(40), "swept", 1),
    ])


PATH = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no test tables")
def test_queries_give_what_the_rules_give(spark):
    from faultline.plans.registry import QUERIES
    from faultline.plans import service  # noqa: F401

    events = sorted(spark.read.parquet(f"{PATH}/events.parquet").collect(), key=lambda r: r.ts)
    rows = []
    for r in events:
        kind = ("shipped", "rejected", "cold")[r.event_id % 3] if r.event_id % 37 == 0 else "route" if r.event_id % 50 == 1 else "label"
        rows.append((f"project-{r.user_id % 2}", r.ts.replace(second=0, microsecond=0), kind))
    got = [tuple(r) for r in QUERIES["l9_training_requests"](spark, PATH).collect()]
    for model in ("project-0", "project-1"):
        want = decisions([r for r in rows if r[0] == model], rows[-1][1] - timedelta(minutes=10))
        # a row's decision is told when its minute is over
        assert sorted(r[1:] for r in got if r[0] == model and r[1] < rows[-1][1] - timedelta(minutes=12)) == sorted(w for w in want if w[0] < rows[-1][1] - timedelta(minutes=12))
        assert len(want) > 30
    kinds = {"signup": "item", "error": "gone"}
    items = [(1 + r.user_id % 2, r.user_id, r.ts.replace(microsecond=0), kinds.get(r.event_type, "label")) for r in events]
    items.sort(key=lambda r: (r[2], {"item": 0, "label": 1, "gone": 2}[r[3]]))
    got = [tuple(r) for r in QUERIES["l12_orphan_sweeps"](spark, PATH).collect()]
    assert sorted(got) == reaped(items, items[-1][2] - timedelta(hours=1), 3) and {r[3] for r in got} == {"marked", "unmarked", "swept"}
