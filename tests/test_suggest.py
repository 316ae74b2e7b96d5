"""What is shown of a decision, facts for a text model, and what its answers change."""

import random

from pyspark.sql import functions as F

from faultline.plans.suggest import cache_plan, cold_start_rows, judged, label_conflict, shown


def naive(d, candidates, declined, chosen):
    """The rows of one decision, one after the other."""
    floor = 0.3 if declined else 0.45
    who = {"ai_suggested": "auto-analyzed", "rp": "human-confirmed", "human": "human-confirmed", "seed": "seed"}
    candidates = sorted(candidates, key=lambda c: c["place"])
    best = d["confidence"] or (min(1.0, candidates[0]["cosine"] or 0.0) if candidates else 0.0)
    if best < floor:
        return []
    rows = []
    has = d["label"] != "ti" and d["relevant_item_id"] is not None
    if has:
        rows.append((d["relevant_item_id"], d["issue_type"], d["confidence"], 0.0, "kb-mode" if d["method"] == "kb" else who.get(d["label_source"], "unlabeled")))
    for c in candidates:
        if not (has and c["item_id"] == d["relevant_item_id"]) and c["issue_type"]:
            rows.append((c["item_id"], c["issue_type"], min(1.0, c["cosine"] or 0.0), c["rrf_score"], who.get(c["label_source"], "unlabeled")))
    rows = [r for r in rows if r[2] >= floor]
    if not rows:
        return []
    if d["action"] != "auto":
        rows.sort(key=lambda r: r[0] != chosen)
    high, low = [r for r in rows if r[2] >= 0.45], [r for r in rows if r[2] < 0.45]
    if declined and d["abstain_reason"] == "gbm_below_suggest" and 0.3 <= d["confidence"] < 0.45:
        seen = {r[0] for r in rows}
        for c in candidates:
            if c["item_id"] not in seen and (c["issue_type"] or "")[:2] == d["guess"]:
                low.append((c["item_id"], c["issue_type"], d["confidence"], c["rrf_score"], who.get(c["label_source"], "unlabeled")))
                break
    low = low[:2]
    high = high[: max(0, 3 - len(low)) if low and d["label"] == "ti" else 3]
    out = []
    for k, r in enumerate(high + low):
        own = d["label"] != "ti" and r[0] == d["relevant_item_id"]
        band = "below_suggest" if r[2] < 0.45 else "auto" if d["action"] == "auto" and own else "suggest"
        why = "model probability stayed below the suggest threshold" if band == "below_suggest" and k == len(high) and d["abstain_reason"] == "gbm_below_suggest" else None
        out.append((d["query_id"], k, r[0], r[1], round(r[2] * 100, 2), round(r[3], 6), band, r[4], round(d["confidence"], 4) if own and d["confidence"] > 0 else None, why))
    return out


def test_shown_suggestions(spark):
    rng = random.Random(5)
    decisions, candidates, chosen = [], [], {}
    for q in range(120):
        label = rng.choice(["pb", "ti", "ti"])
        confidence = rng.choice([0.0, 0.35, 0.4, 0.5, 0.9, 0.2])
        reason = rng.choice(["gbm_below_suggest", "gbm_below_suggest", None]) if label == "ti" else None
        decisions.append(dict(query_id=q, label=label, confidence=confidence, method=rng.choice(["hash", "kb", "gbm"]), action=rng.choice(["auto", "suggest"]) if label != "ti" else "abstain", abstain_reason=reason, issue_type=label + "001", relevant_item_id=rng.choice([None, 1, 2, 50]) if label != "ti" else None, label_source=rng.choice([None, "rp", "ai_suggested"]), guess=rng.choice(["pb", "ab", None])))
        for place in range(1, rng.choice([1, 2, 5, 9])):
            candidates.append(dict(query_id=q, item_id=place * 7 % 10, place=place, issue_type=rng.choice(["pb001", "ab001", "pb_custom", None]), cosine=rng.choice([None, 0.1, 0.31, 0.44, 0.45, 0.8, 1.0]), rrf_score=place / 64, label_source=rng.choice([None, "human", "seed"])))
        if rng.random() < 0.5:
            chosen[q] = rng.randrange(10)
    d = spark.createDataFrame([tuple(x.values()) for x in decisions], "query_id long, label string, confidence double, method string, action string, abstain_reason string, issue_type string, relevant_item_id long, label_source string, guess string")
    c = spark.createDataFrame([tuple(x.values()) for x in candidates], "query_id long, item_id long, place int, issue_type string, cosine double, rrf_score double, label_source string")
    j = spark.createDataFrame(list(chosen.items()), "query_id long, item_id long")
    for declined in (False, True):
        want = [r for x in decisions for r in naive(x, [y for y in candidates if y["query_id"] == x["query_id"]], declined, chosen.get(x["query_id"]))]
        assert sorted(tuple(r) for r in shown(d, c, declined, j).collect()) == sorted(want)
    assert len(want) > 100 and shown(d.limit(0), c, True, j).count() == 0


def test_conflicts(spark):
    rows = [(1, ["pb001", None], ["ab001", "pb001"]), (2, [], ["si001"]), (3, [], [])]
    got = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", label_conflict(F.col("a"), F.col("b")).alias("o")).collect()
    assert {r.k: r.o for r in got} == {1: "evidence splits across labels: pb001, ab001", 2: "only weak same-label evidence: si001", 3: None}


def test_cache_plan(spark):
    at = "2024-02-01 00:00:00"
    cache = spark.createDataFrame([(1, False, "2020-01-01"), (2, True, "2024-01-25 00:00:01"), (3, True, "2024-01-25 00:00:00")], "k int, negative boolean, t string").select("k", "negative", F.col("t").cast("timestamp").alias("created_at"))
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "k int")
    assert {r.k: r.plan for r in cache_plan(asked, cache, ["k"], at).collect()} == {1: "hit", 2: "negative", 3: "ask", 4: "ask"}
    assert cache_plan(asked, cache, ["k"], at).count() == 4


def test_answers(spark):
    answers = spark.createDataFrame([(1, "R3", "ab001", "high", "Matches R3, the element was missing."), (2, "none", "pb001", "low", "R3."), (3, "R2", "ab001", "high", None)], "item_id long, rule string, label string, bucket string, reason string")
    got = {r.item_id: (r.confidence, r.model_ver, r.rule_name, r.explanation) for r in cold_start_rows(answers, "m").collect()}
    assert got == {1: (0.65, "rubric+m", "Element not found on the page", "The element was missing."), 2: (0.46, "rubric+m", "", None), 3: (0.55, "rubric+m", "Setup or test data failed", None)}
    verdicts = spark.createDataFrame([(1, "candidate_2"), (2, "none"), (3, "abstain"), (4, "candidate_9")], "query_id long, choice string")
    candidates = spark.createDataFrame([(q, p, q * 10 + p) for q in (1, 2, 3, 4) for p in (1, 2)], "query_id long, place int, item_id long")
    assert {r.query_id: r.chosen_item_id for r in judged(verdicts, candidates).collect()} == {1: 12, 2: None, 4: None}
