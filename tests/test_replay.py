import random
from collections import Counter

import numpy as np
import pytest

from faultline.operators.boosting import Settings, boost
from faultline.operators.replay import SINGLETON, paired, report

NAMES = ["other", "si_prior", "group_dominance", "launch_fail_fraction", "co_failure_group_size", "more"]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        x = [rng.random() for _ in NAMES]
        rows.append((x, "si" if x[1] > 0.6 else "pb" if x[0] + x[2] / 4 > 0.7 else "ab"))
    path = f"file://{tmp_path_factory.mktemp('rows')}/t"
    spark.createDataFrame(rows, "features array<double>, label string").write.parquet(path)
    return boost(spark.read.parquet(path), Settings(rounds=6, leaves=6, rate=0.3, bins=15))


def of(confidence):
    return "auto" if confidence >= 0.75 else "suggest" if confidence >= 0.45 else "abstain"


def test_pairs_are_those_of_two_calls_of_the_model(spark, written, model):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2]), k, [rng.random() for _ in NAMES]) for k in range(200)]
    df = written([*rows, (1, 999, None)], "project_id long, item_id long, features array<double>", 3)
    pairs = paired(model, df, NAMES)
    got = {r.item_id: r for r in pairs.collect()}
    assert set(got) == {r[1] for r in rows}
    stats = {1: [], 2: []}
    for project, item, x in rows:
        early = [SINGLETON.get(n, v) for n, v in zip(NAMES, x)]
        a, b = model.probabilities(np.array([x]))[0], model.probabilities(np.array([early]))[0]
        want = (model.classes[a.argmax()], a.max(), model.classes[b.argmax()], b.max())
        r = got[item]
        assert (r.finish_label, r.early_label) == (want[0], want[2]) and r.finish_conf == pytest.approx(want[1], abs=1e-12) and r.early_conf == pytest.approx(want[3], abs=1e-12)
        assert (r.label_flipped, r.band_changed) == (want[0] != want[2], of(want[1]) != of(want[3]))
        stats[project].append(want)
    for r in report(pairs, ["project_id"]).collect():
        s = stats[r.project_id]
        flips, moves = Counter(f"{a}->{c}" for a, _, c, _ in s if a != c), Counter(f"{of(b)}->{of(d)}" for _, b, _, d in s if of(b) != of(d))
        assert flips and moves and (r.n, r.label_flips, r.band_changes) == (len(s), dict(flips), dict(moves))
        assert r.label_flip_rate == round(flips.total() / len(s), 4) and r.band_change_rate == round(moves.total() / len(s), 4)
        shifts = [abs(b - d) for _, b, _, d in s]
        assert r.mean_abs_conf_delta == pytest.approx(sum(shifts) / len(s), abs=1e-4) and r.max_abs_conf_delta == pytest.approx(max(shifts), abs=1e-4)


def test_a_model_without_launch_features_decides_the_same_twice(spark, written, model):
    df = written([(1, 1, [0.1] * 6), (1, 2, [0.9] * 6)], "project_id long, item_id long, features array<double>", 1)
    rows = paired(model, df, ["a", "b", "c", "d", "e", "f"]).collect()
    assert [r.finish_conf == r.early_conf and not r.label_flipped for r in rows] == [True, True]


def test_no_decisions_no_report(spark, written, model):
    df = written([], "project_id long, item_id long, features array<double>", 1)
    assert report(paired(model, df, NAMES), ["project_id"]).count() == 0


def test_a_pass_has_no_join(spark, written, model):
    df = written([(1, 1, [0.1] * 6)], "project_id long, item_id long, features array<double>", 1)
    assert "Join" not in paired(model, df, NAMES)._jdf.queryExecution().executedPlan().toString()
