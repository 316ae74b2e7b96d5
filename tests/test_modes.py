import random

import pytest

from faultline.operators.modes import LOG, members, merge_paths, modes, purity
from faultline.sources.shared import Scratch


def replayed(log):
    """Members and modes by doing one step after the other."""
    links, status, label = {}, {}, {}
    for _, op, mode, other, item, score, by, st, lb in sorted(r[1:] for r in log):
        if op == "spawn":
            links.setdefault(mode, {})
            status[mode], label[mode] = st, lb if lb is not None else label.get(other)
        elif op == "add":
            links.setdefault(mode, {})[item] = (score, by)
        elif op == "merge" and mode != other:
            to = links.setdefault(other, {})
            for i, (s, b) in links.get(mode, {}).items():
                to[i] = (max(to[i][0], s), to[i][1]) if i in to else (s, b)
            links[mode], status[mode] = {}, "retired"
        elif op == "status":
            status[mode], label[mode] = st, lb if lb is not None else label.get(mode)
        elif op == "retire":
            status[mode] = "retired"
    return {(m, i): x for m, found in links.items() for i, x in found.items()}, {m: (s, label.get(m)) for m, s in status.items()}


def some_log(seed, project, n, n_items):
    rng = random.Random(seed)
    log, known, seq = [], [], 0

    def step(op, mode, other=None, item=None, score=None, by=None, status=None, label=None):
        nonlocal seq
        seq += rng.randint(1, 3)
        log.append((project, seq, op, mode, other, item, score, by, status, label))

    def spawn(parent=None):
        known.append(len(known) + 1)
        step("spawn", known[-1], parent, status="candidate", label=rng.choice([None, None, "pb001", "ab001"]))

    for _ in range(4):
        spawn()
    for _ in range(n):
        mode, what = rng.choice(known), rng.random()
        if what < 0.6:
            step("add", mode, item=rng.randint(1, n_items), score=rng.randint(0, 20) / 20, by=rng.choice(["human", "centroid", "hash"]))
        elif what < 0.8:
            step("merge", mode, rng.choice(known))
        elif what < 0.9:
            step("status", mode, status=rng.choice(["confirmed", "candidate"]), label=rng.choice([None, "si001", "nd001"]))
        else:
            for _ in range(2):
                spawn(mode)
                step("add", known[-1], item=rng.randint(1, n_items), score=1.0, by="human")
            step("retire", mode)
    return log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_modes_are_those_of_a_replay(spark, written, seed):
    logs = {1: some_log(seed, 1, 150, 5), 2: some_log(seed + 10, 2, 60, 40)}
    df = written([r for log in logs.values() for r in log], LOG, 3)
    found, state = members(df, Scratch(spark, "t")).collect(), modes(df, Scratch(spark, "t")).collect()
    for project, log in logs.items():
        links, known = replayed(log)
        assert {(r.mode_id, r.item_id): (r.score, r.matched_by) for r in found if r.project_id == project} == links
        assert {r.mode_id: (r.status, r.label) for r in state if r.project_id == project} == known


def test_a_long_chain_of_merges_is_one_path(spark, written):
    n = 40
    log = [(1, k, "spawn", k, None, None, None, None, "candidate", None) for k in range(n)] + [(1, 100, "add", 0, None, 7, 0.5, "hash", None, None)]
    log += [(1, 200 + k, "merge", k, k + 1, None, None, None, None, None) for k in range(n - 1)]
    df, scratch = written(log, LOG, 2), Scratch(spark, "t")
    paths = {r.node.mode: [s.node.mode for s in r.path] for r in merge_paths(df, scratch).collect()}
    assert paths == {k: list(range(k + 1, n)) for k in range(n - 1)}
    assert len(scratch.paths["paths"]) <= 8
    assert [tuple(r) for r in members(df, Scratch(spark, "t")).collect()] == [(1, n - 1, 7, 0.5, "hash")]


def test_merges_back_and_forth_and_with_itself(spark, written):
    add = lambda seq, mode, item, score, by: (1, seq, "add", mode, None, item, score, by, None, None)
    merge = lambda seq, a, b: (1, seq, "merge", a, b, None, None, None, None, None)
    log = [add(1, 1, 5, 0.9, "a"), add(2, 2, 5, 0.4, "b"), merge(3, 1, 2), merge(4, 2, 1), add(5, 2, 5, 0.1, "c"), merge(6, 1, 2), merge(7, 2, 2), (1, 8, "add", 2, None, None, 0.3, "d", None, None)]
    assert [tuple(r) for r in members(written(log, LOG, 2), Scratch(spark, "t")).collect()] == [(1, 2, 5, 0.9, "c")]


def test_an_empty_log(spark, written):
    df = written([], LOG, 1)
    assert members(df, Scratch(spark, "t")).count() == 0 and modes(df, Scratch(spark, "t")).count() == 0


def test_purity_counts_labelled_members(spark, written):
    found = written([(1, 1, i, 1.0, "h") for i in range(5)] + [(1, 2, 9, 1.0, "h")], "project_id long, mode_id long, item_id long, score double, matched_by string", 2)
    items = written([(1, 0, "pb001"), (1, 1, "pb001"), (1, 2, "ab001"), (1, 3, None)], "project_id long, item_id long, issue_type string", 1)
    assert sorted(tuple(r) for r in purity(found, items).collect()) == [(1, 1, 5, 3, 2 / 3), (1, 2, 1, 0, 0.0)]
