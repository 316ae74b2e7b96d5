"""Features and guards against plain Python over small candidates."""

import math
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators.features import ERROR_CLASSES, FAILING_LAYERS, FEATURES, features, vector

C_SCHEMA = "query_id long, place int, cosine double, rrf_score double, jaccard_templates double, issue_type string, label_source string, age_days double, same_test_case boolean, same_error_hash boolean, same_exception_fp boolean, msg_text string"
X_SCHEMA = (
    "query_id long, kb_score double, kb_purity double, kb_support long, kb_same_fp boolean, seed_label string, seed_confidence double, flakiness double, runs long, failures long, flips long, test_age double, group_size long, "
    "launch_failures long, launch_items long, si_prior double, log_count long, has_stack boolean, is_assertion boolean, is_merged boolean, n_exceptions int, failing_layer string, error_class string, codes array<int>, message string, "
    "hash_codes array<int>, hash_message string, gate_blocked boolean"
)
CANDIDATES = [
    (1, 1, 0.97, 0.03, 0.5, "pb001", "rp", 10.0, True, True, False, "com.shop.Cart failed getTotal"), (1, 2, 0.9, 0.02, 0.2, "PB_custom", "human", 100.0, False, False, True, "x"), (1, 3, None, 0.01, 0.0, "si001", None, None, False, False, False, "y"),
    (1, 4, 0.5, 0.01, 0.0, "ti001", "ai_suggested", 3650.0, False, False, False, "z"), (1, 5, 0.4, 0.01, 0.0, "nd001", "seed", -3.0, False, False, False, "z"), (1, 6, 0.3, 0.01, 0.0, "ab001", "odd", 5.0, False, False, False, "z"),
    (2, 1, -0.2, 0.0, 0.0, "zz", None, None, False, False, False, ""), (4, 1, 0.8, 0.1, 1.0, "si001", "human", 90.0, False, True, True, "null because of it"),
]
CONTEXT = [
    (1, 0.8, 0.97, 40, True, "SI", 0.75, 0.3, 10, 4, 3, 30.0, 12, 20, 25, 0.95, 7, True, False, True, 2, "app_code", "timeout", [500, 503, 500], "com.shop.Cart broke in getTotal", [503, 500], "com.shop.Cart other", False),
    (2, None, None, None, None, None, None, None, 0, 0, None, None, None, None, None, None, None, None, None, None, None, "nonsense", None, [], None, None, None, None),
    (3, 2.0, float("nan"), 5000, False, "ti", 0.4, 7.0, 4, 9, 100, 9000.0, 900, 0, 0, -1.0, 90, False, True, False, 9, None, "other", [404], "plain words only", [], "plain words only", True),
    (4, None, None, None, None, None, None, 0.1, 1, 1, 0, -5.0, 1, 1, 1, 0.2, 1, False, False, False, 0, None, None, [], "words", None, None, False),
]


def expected(context, rows):
    c = lambda x: 0.0 if x is None or x != x or abs(x) == math.inf else max(0.0, min(1.0, x))
    out = dict(FEATURES)
    base = lambda t: t[:2].lower() if t and t[:2].lower() in ("pb", "ab", "si", "nd") else None
    decay = lambda d: 1.0 if d <= 0 else math.exp(-math.log(2) * d / 90)
    weight = lambda s: {"rp": 1.0, "human": 0.9, "ai_suggested": 0.3, "seed": 0.6}.get(s, 0.3)
    ids = lambda m: {t for t in (m or "").split() if re.search(r"\.|::|[a-z][A-Z]", t)}
    if rows:
        cos = [r[2] or 0.0 for r in rows]
        out["top1_cosine"], out["top1_rrf"], out["top1_jaccard"] = c(cos[0]), max(0.0, rows[0][3]), c(rows[0][4])
        out["margin_cos"], out["mean_top5_cosine"], out["n_candidates"] = c(cos[0] - (cos[1] if len(cos) > 1 else 0)), c(sum(cos[:5]) / len(cos[:5])), c(len(cos) / 20)
        bases = [base(r[5]) for r in rows]
        known = [b for b in bases if b]
        p = [known.count(b) / len(known) for b in set(known)]
        out["label_hist_entropy"] = c(-sum(x * math.log(x) for x in p) / math.log(4)) if known else 1.0
        out["top1_label_frac"] = known.count(bases[0]) / len(known) if known and bases[0] else 0.0
        for k, n in ((8, "same_test_case"), (9, "same_error_hash"), (10, "same_exception_fp")):
            out[f"{n}_top1"] = float(rows[0][k])
        out["recency_top1"], out["src_weight_top1"] = c(decay(rows[0][7] or 0.0)), weight(rows[0][6])
        w = [max(0, x) * decay(r[7] or 0.0) * weight(r[6]) for x, r in zip(cos, rows, strict=True)]
        for b in ("pb", "ab", "si", "nd"):
            out[f"hist_{b}"] = c(sum(x for x, y in zip(w, bases, strict=True) if y == b) / sum(w)) if sum(w) > 0 else 0.0
    x = dict(zip([f.split()[0] for f in X_SCHEMA.split(", ")], context, strict=True))
    logs = lambda n, most: c(math.log1p(max(0, n)) / math.log1p(most))
    if x["kb_score"] is not None:
        out |= {"kb_top1_score": c(x["kb_score"]), "kb_purity": c(x["kb_purity"]), "kb_support": logs(x["kb_support"], 1000), "kb_same_fp": float(x["kb_same_fp"])}
    if x["seed_label"]:
        out["kb_prior_conf"] = c(x["seed_confidence"])
        if base(x["seed_label"]):
            out[f"seed_{base(x['seed_label'])}"] = 1.0
    if x["flakiness"] is not None:
        out["flakiness_score"] = c(x["flakiness"])
    if x["runs"]:
        out["test_fail_rate_30d"] = c(x["failures"] / x["runs"])
    out["flips_30d"], out["co_failure_group_size"] = logs(x["flips"] or 0, 20), logs(1 if x["group_size"] is None else x["group_size"], 200)
    if x["launch_failures"]:
        out["group_dominance"] = c(x["group_size"] / x["launch_failures"])
    if x["launch_items"]:
        out["launch_fail_fraction"] = c(x["launch_failures"] / x["launch_items"])
    out["si_prior"] = max(0.0, min(0.9, x["si_prior"] or 0.0))
    if x["test_age"] is not None:
        out["test_age_days"] = logs(min(x["test_age"], 365), 365)
    out |= {"item_log_count": c((x["log_count"] or 0) / 20), "exception_count": min(x["n_exceptions"] or 0, 5) / 5}
    out |= {k: float(bool(x[v])) for k, v in (("has_stacktrace", "has_stack"), ("is_assertion", "is_assertion"), ("is_merged_small_logs", "is_merged"), ("hash_gate_blocked", "gate_blocked"), ("status_codes_present", "codes"))}
    for name, levels, value in (("llm_failing_layer", FAILING_LAYERS, x["failing_layer"]), ("llm_error_class", ERROR_CLASSES, x["error_class"])):
        for k in levels:
            out[f"{name}_{k}"] = float(k == (value if value in levels else "unknown"))
    mine = ids(x["message"])
    out["identifiers_present"] = float(bool(mine))
    other = None
    if x["hash_message"] is not None:
        other, out["ident_jaccard_source"] = ids(x["hash_message"]), 1.0
        out["status_codes_match_top1"] = float(bool(x["codes"]) and set(x["codes"]) == set(x["hash_codes"]))
    elif rows:
        other, out["ident_jaccard_source"] = ids(rows[0][11]), 0.5
    if other is not None and (mine or other):
        out["identifier_jaccard_top1"] = len(mine & other) / len(mine | other)
    return out


def test_features(spark):
    out = {r.query_id: r.asDict() for r in features(spark.createDataFrame(CANDIDATES, C_SCHEMA), spark.createDataFrame(CONTEXT, X_SCHEMA)).collect()}
    assert len(FEATURES) == 64 and set(out) == {1, 2, 3, 4}
    for x in CONTEXT:
        want = expected(x, [r for r in CANDIDATES if r[0] == x[0]])
        for n in FEATURES:
            assert out[x[0]][n] == pytest.approx(want[n], abs=1e-9), (x[0], n)


def test_vector_takes_defaults(spark):
    row = spark.createDataFrame([(0.5,)], "top1_cosine double").select(vector(["top1_cosine", "gone"], {"gone": 0.25}).alias("v")).first()
    assert row.v == [0.5, 0.25]


def test_identifier_gate(spark):
    from faultline.functions.evidence import discriminant_agrees

    cases = [
        ([500], "cannot invoke Session.userId", [500], "cannot invoke Region.rate", False), ([500], "call a.B now", [500, 500], "see a.B here", True), ([500], "same words", [503], "same words", False), ([], "", [], "", True), ([], "a b c", [], "a b c d e f g", False), ([], "has x.y", [], "plain", False),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "a array<int>, m string, b array<int>, n string")
    assert [r.ok for r in df.select(discriminant_agrees(F.col("a"), F.col("m"), F.col("b"), F.col("n")).alias("ok")).collect()] == [c[4] for c in cases]


def test_seed_modes(spark):
    from faultline.functions.evidence import seed_mode
    from faultline.plans.decision import check_catalog
    from faultline.functions.seeds import SEED_MODES

    cases = [
        (["java.lang.OutOfMemoryError"], "", "oom_java"), ([], "pod OOMKilled", "oom_killed_container"), ([], "line one\nASSERT x == 1", "assertion_pytest"), (["myassertionerror"], "", None), ([], "TimeoutError in selenium", None), ([], "TimeoutError: 30s", "generic_timeout"),
        ([], "status code: 503", "http_5xx"), (["KeyError"], "", "index_key_error"), ([], None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "c array<string>, m string")
    assert [r.s.key if r.s else None for r in df.select(seed_mode(F.col("c"), F.col("m")).alias("s")).collect()] == [c[2] for c in cases]
    with pytest.raises(ValueError):
        check_catalog(SEED_MODES[:49])


def test_calibration(spark):
    from faultline.plans.learning import calibrate

    rows = [(k, 1, (k % 20) / 20, (k * 7 % 20) < k % 20) for k in range(400)] + [(1000 + k, 2, (k % 10) / 10, None if k % 2 else k % 10 > 4) for k in range(100)]
    out = {r.id: r.calibrated for r in calibrate(spark.createDataFrame(rows, "id int, p int, s double, h boolean"), "p", "s", "h").collect()}
    assert len(out) == 500

    def fitted(points):  # the greatest of all lower averages, which is what pooling comes to
        xs = sorted(points)
        total = lambda a, b: sum(points[x][0] for x in xs[a : b + 1]) / sum(points[x][1] for x in xs[a : b + 1])
        return {x: max(min(total(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}

    own, every = {}, {}
    for _, p, s, h in rows:
        if h is not None:
            for d in ([own] if p == 1 else []) + [every]:
                n = d.get(s, (0, 0))
                d[s] = (n[0] + h, n[1] + 1)
    own, every = fitted(own), fitted(every)
    for i, p, s, _ in rows:
        assert out[i] == pytest.approx((own if p == 1 else every)[s]), (i, p, s)
    few = spark.createDataFrame(rows[:20], "id int, p int, s double, h boolean")
    assert all(r.calibrated == r.s for r in calibrate(few, "p", "s", "h").collect())


def test_models_learn_what_divides(spark):
    from faultline.plans.learning import out_of_fold, predict, train

    rows = [([float(k % 4), float(k % 7)], ("ab", "nd", "pb", "si")[k % 4], k // 4 % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "features array<double>, label string, fold int")
    out = predict(train(df, rounds=2, depth=2, rate=0.5), df).collect()
    assert all(r.guess == r.label and abs(sum(r.probs.values()) - 1) < 1e-9 and r.max_prob == max(r.probs.values()) for r in out)
    assert train(df.limit(20)) == {} and train(df.where("label = 'ab'").union(df.where("label = 'ab'")).union(df.where("label = 'ab'"))) == {}
    assert sum(r.guess == r.label for r in out_of_fold(df, "fold", 2, rounds=1, depth=2, rate=0.5, least=20).collect()) == 80
