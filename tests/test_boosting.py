import numpy as np
import pytest

from faultline.operators.boosting import Settings, boost, predict

CLASSES = ("ab", "nd", "pb", "si")


def data(seed, n, width=64):
    """Four groups that only several features together tell apart, of unequal sizes."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    kind = (x[:, 0] > 0).astype(int) * 2 + ((x[:, 1] > 0.4) ^ (x[:, 2] > 0)).astype(int)
    flip = rng.random(n) < 0.05
    kind[flip] = rng.integers(0, 4, flip.sum())
    return x, [CLASSES[k] for k in kind]


def plain(x, labels, edges, s):
    """The same trees, one row and one cut at a time."""
    n, classes = len(x), sorted(set(labels))
    y = [classes.index(c) for c in labels]
    w = [n / (len(classes) * labels.count(c)) for c in labels]
    scores = [[0.0] * len(classes) for _ in range(n)]
    for _ in range(s.rounds):
        step = []
        p = [np.exp(np.array(r) - max(r)) / np.exp(np.array(r) - max(r)).sum() for r in scores]
        for k in range(len(classes)):
            g = [w[i] * (p[i][k] - (y[i] == k)) for i in range(n)]
            h = [4 / 3 * w[i] * p[i][k] * (1 - p[i][k]) for i in range(n)]
            part = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + s.ridge)  # noqa: E731, B023

            def split(rows, part=part, h=h):
                best = None
                for f in range(x.shape[1]):
                    for b, e in enumerate([*edges[f], np.inf]):
                        left, right = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                        if left and right and min(sum(h[i] for i in left), sum(h[i] for i in right)) >= s.least_curvature:
                            gain = round(part(left) + part(right) - part(rows), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, b, left, right)
                return best

            leaves = [list(range(n))]
            found = {0: split(leaves[0])}
            while len(leaves) < s.leaves and any(found.values()):
                at = min((-f[0], leaf) for leaf, f in found.items() if f)[1]
                _, _, _, leaves[at], right = found[at]
                leaves.append(right)
                found[at], found[len(leaves) - 1] = split(leaves[at]), split(right)
            step.append([(rows, -s.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + s.ridge)) for rows in leaves])
        for k, leaves in enumerate(step):
            for rows, value in leaves:
                for i in rows:
                    scores[i][k] += value
    return [np.exp(np.array(r) - max(r)) / np.exp(np.array(r) - max(r)).sum() for r in scores]


def test_equals_a_plain_version(spark, written):
    x, labels = data(1, 160, 3)
    s = Settings(rounds=2, leaves=5, rate=0.3, bins=7, batch=1)
    df = written([(i, r.tolist(), c) for i, (r, c) in enumerate(zip(x, labels, strict=True))], "i long, features array<double>, label string", 3)
    model = boost(df, s)
    want = plain(x, labels, model.edges, s)
    got = {r.i: r for r in predict(model, df).collect()}
    for i, p in enumerate(want):
        assert np.allclose([got[i].probs[c] for c in CLASSES], p, atol=1e-7)
        assert got[i].guess == CLASSES[int(np.argmax(p))] and abs(got[i].max_prob - max(p)) < 1e-7


def macro_f1(pairs):
    out = []
    for c in CLASSES:
        hit = sum(a == b == c for a, b in pairs)
        out.append(2 * hit / max(1, sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs)))
    return sum(out) / len(out)


def test_beats_one_against_the_rest(spark, written):
    """Held-out macro F1 on 64 features, against four models of pyspark.ml with as many trees of as many leaves, on groups that no one
    feature tells from the rest."""
    from faultline.plans import learning

    x = np.random.default_rng(3).normal(size=(1600, 64))
    labels = [CLASSES[k] for k in np.digitize(x[:, :6].sum(1), (-1.6, 0.0, 1.6))]  # sums in a row: the middle groups have both others beside them
    rows = [(i, r.tolist(), c) for i, (r, c) in enumerate(zip(x, labels, strict=True))]
    train = written(rows[:1200], "i long, features array<double>, label string", 4)
    held = written(rows[1200:], "i long, features array<double>, label string", 2)
    ours = macro_f1([(r.label, r.guess) for r in predict(boost(train, Settings(rounds=10, leaves=8, rate=0.8, bins=31, least_rows=5)), held).collect()])
    # half the rate, as those models' labels are twice as far apart
    others = macro_f1([(r.label, r.guess) for r in learning.predict(learning.train(train.select("features", "label"), rounds=10, depth=3, rate=0.4), held).collect()])
    assert ours > 0.6 and ours > others, (ours, others)


@pytest.mark.parametrize("rows", [[], [([1.0], "pb")], [([1.0], None), (None, "pb"), ([2.0], "pb")]])
def test_too_little_to_learn(written, rows):
    assert boost(written(rows, "features array<double>, label string", 1)) is None
