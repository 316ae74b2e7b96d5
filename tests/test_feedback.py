import random

from faultline.operators.feedback import feedback


def test_effects_are_those_of_one_update_after_the_other(written):
    rng = random.Random(4)
    labels = ["pb001", "ab001", " PB001", "SI001 ", "", None, "ti001", "pb_custom"]
    items = [(p, i, rng.choice(["pb001", "ab001", None, ""])) for p in (1, 2) for i in range(40)]
    updates = [(rng.choice((1, 2)), rng.randint(0, 60), rng.choice(labels), at) for at in range(120)]
    members = [(p, i % 5, i) for p, i, _ in items if i % 3]
    suggestions = [(k, rng.choice((1, 2)), rng.randint(0, 60), rng.choice(["pb001", "ab001", "xx", None]), rng.choice(["pending", "accepted"])) for k in range(90)]
    made = feedback(written(updates, "project_id long, item_id long, issue_type string, at long"), written(items, "project_id long, item_id long, issue_type string"), written(members, "project_id long, mode_id long, item_id long"), written(suggestions, "suggestion_id long, project_id long, item_id long, predicted_label string, outcome string"))

    now = {(p, i): label for p, i, label in items}
    events, unknown, touched = [], set(), {}
    for p, i, label, at in updates:
        new = (label or "").strip().lower()
        if (p, i) not in now:
            unknown.add((p, i))
            continue
        events.append((p, i, now[p, i], new, "rp_defect_update", at))
        now[p, i] = touched[p, i] = new
    assert sorted(map(repr, (tuple(r) for r in made.events.collect()))) == sorted(map(repr, events))
    assert {tuple(r) for r in made.unknown.collect()} == unknown and {(r.project_id, r.item_id): r.issue_type for r in made.items.collect()} == touched
    purity = {}
    for p, mode in {(p, m) for p, m, i in members if (p, i) in touched}:
        held = [now[q, i] for q, m, i in members if (q, m) == (p, mode) and now[q, i]]
        if held:
            purity[p, mode] = (len(held), max(map(held.count, held)) / len(held))
    assert {(r.project_id, r.mode_id): (r.labelled, r.purity) for r in made.purity.collect()} == purity
    group = lambda x: x[:2] if x and x[:2] in ("pb", "ab", "si", "nd") else None
    outcomes = {k: "accepted" if group(guess) and group(guess) == group(touched[p, i]) else "corrected" for k, p, i, guess, o in suggestions if o == "pending" and (p, i) in touched}
    assert {r.suggestion_id: r.outcome for r in made.outcomes.collect()} == outcomes
