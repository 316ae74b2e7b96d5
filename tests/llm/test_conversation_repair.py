import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from faultline.llm import queries
from faultline.llm.conversation_repair import digests, ended, repair_conversations, solved

LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """The least (cost, audit) by best-first search over (rows read, last initial), rows as (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last) in seen:
            continue
        seen.add((i, last))
        steps = [(3, "I", i, r) for r in "ua" if (last, r) in LEADS]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append((4, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps += [(more, "K", i + 1, initial)] if (last, initial) in LEADS else []
                steps += [(3 + more, "R", i + 1, r) for r in "ua" if (last, r) in LEADS]
        for c, letter, k, r in steps:
            heapq.heappush(heap, (cost + c, audit + letter, k, last if r is None else r))


def expected(rows):
    """{conversation: digest columns} of damaged rows (conversation, turn, role, text)."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in of.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        seen, coded = set(), []
        for _, _, role, text in turns:
            inner = re.sub("[ \t-\r]+$", "", text)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, audit = cheapest(coded)
        lines, last, k = [], "", 0
        for letter in audit:
            if letter == "D":
                k += 1
                continue
            role = turns[k][2] if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if letter == 'I' else turns[k][3]}")
            last, k = role[0], k + (letter != "I")
        known = [t for some, t, *_ in turns if some]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        n = lambda f: sum(x[1] == f for x in coded)  # noqa: E731, B023
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_signatures():
    rng = random.Random(1)
    faults = {"-": "blank"}
    for _ in range(800):
        s = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(1, 12)))
        assert ended(solved(s)) == cheapest([("" if c == "-" else c.lower(), faults.get(c, "truncated" if c.isupper() else "")) for c in s])


def conversation_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", None, "Done. \n", "ünd so.", "a" * 70 + "1.", "a" * 70 + "2."]
    rows = []
    for _ in range(n):
        conv = rng.choice([1, 2, 3, 4, 5, None, 77, 77, 77, 77])
        rows.append((conv, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment_rows,fanout,many", [(1024, 256, 1000), (3, 4, 1000), (5, 2, 3)])
def test_segments_change_nothing(written, segment_rows, fanout, many):
    """A conversation that holds a third of all rows, rows that stand many times, nulls everywhere and clashing columns."""
    rows = conversation_rows(5, 400) + [(77, 9, "user", "The same.")] * 25 + [(None, None, "user", " ")] * 12
    df = written([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, fault string", 5)
    found = repair_conversations(df, segment_rows=segment_rows, fanout=fanout, many=many)
    got = {r.conv: tuple(r[n] for n in NAMES) for r in found.summary.join(digests(found.pieces), "conv").collect()}
    assert {None if k == -(2**63) else k: v for k, v in got.items()} == expected(rows)


def test_empty_table(written):
    found = repair_conversations(written([], "conv_id long, turn long, role string, text string", 1))
    assert found.summary.count() == 0 and found.pieces.count() == 0


def test_query(spark, tmp_path):
    rows = conversation_rows(8, 300) + [(100 + k, t, r, x) for k in range(60) for t, r, x in ((0, "user", "Hello there."), (1, "assistant", "Good day! How are you?"), (2, "user", "Fine."), (3, "assistant", f"Right {k}."))]
    rows += [(501, 0, "user", "word " * 200_000 + "."), (501, 1, "assistant", "y." * 100_000)]
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        damaged += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    want = expected(damaged)
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op12_conversation_repair(spark, path).collect()}
    assert got == want
