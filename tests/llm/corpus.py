"""Small tables with what operators must withstand."""

import random

SCHEMA = "doc_id long, text string, source string, row long, h1 long, id string, quality string, n_lines string, license int, secrets int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(seed=3):
    """Nulls, empty and long texts, copies, near copies, shared lines, white space of all kinds and text beyond ASCII."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    passage, line = prose(rng, 90), "A line that Many documents share."
    texts = [None, "", " \t\n", "one", "One two", "\n\n", "ab\r\ncd\x0bef\x0cgh", "ñandú ÉCOLE straße 中文 " * 30, "x" * 1000, "repeat me now " * 50, passage]
    texts += base + base[:4] + [base[0], base[0]]
    for b in base[:6]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}")
        texts.append(f"{prose(rng, 70)}\n  {line.upper()}\t\n{line}\n{prose(rng, 3)}")
    texts.append("\n".join(prose(rng, 12) for _ in range(3000)))
    return [(i, t, None if i % 7 == 0 else f"s{i % 4}", 1, 2, "x", "q", "l", 5, 6) for i, t in enumerate(texts)]
