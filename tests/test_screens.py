"""Test names, prepared logs, excerpts, screens of a model's text and its schema."""

import json
import re

from pyspark.sql import functions as F

from faultline.functions import cleaning, prompts


def column(spark, texts, f):
    """f over texts, in their order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_names_of_tests(spark):
    names = ["MyClass.shouldDoThing_case", "com.shop.CartTest.addItem", "HTTPServer-loginTest", "", "a.b.cd"]
    want = ["MyClass.shouldDoThing should Do Thing case", "com.shop.CartTest.addItem CartTest.addItem addItem add Item", "HTTP Server login Test", "", "a.b.cd cd"]
    assert column(spark, names, cleaning.name_words) == want
    lines = ["at com.shop.CartTest.addItem(x)\nx.com.shop.CartTest.addItem", "a.b.cd and p.q$r.longer"]
    got = column(spark, lines, cleaning.with_methods)
    assert got[0] == "at com.shop.CartTest.addItem CartTest.addItem addItem (x)\nx.com.shop.CartTest.addItem CartTest.addItem addItem "
    assert got[1].startswith("a.b.cd and ")


def test_methods_in_text(spark):
    texts = ["in com.shop.CartTest.add(1) and LoginSteps.open:3", "see cart.spec.ts here", "FooTest.BarException", "none", "FooTests."]
    assert column(spark, texts, cleaning.test_methods) == [["LoginSteps.open", "com.shop.CartTest.add"], ["a", "c"], [], [], ["FooTests."]]


def test_prepared_log(spark):
    (got,) = column(spark, ["Failed 12 with java.io.IOException at https://shop.example/cart status code: 503"], cleaning.prepared_log)
    assert got.urls and "SPECIALURL" in got.no_urls and "https" not in got.no_urls and "503" in got.status_codes.split() and "java.io.IOException" in got.exceptions.split()


def naive_excerpt(text, budget):
    """Takes a line away at a time."""
    est = lambda t: -(-len(t) * 11 // 40)
    if est(text) <= budget:
        return text
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if re.match(r"(?i)\s*Caused by:", x)][-1:] or [i for i, x in enumerate(lines) if re.match(r"\s*[\w.$]*(Exception|Error|Throwable)\b", x)][:1]
    root = []
    for i in range(at[0], min(at[0] + 40, len(lines))) if at else ():
        if i > at[0] and not lines[i].strip():
            break
        root.append(i)
    head, tail = list(range(min(15, len(lines)))), 10
    heads = 15
    while True:
        keep = {*head[:heads], *range(max(0, len(lines) - tail), len(lines)), *root}
        out, gap = [], 0
        for i, x in enumerate(lines):
            if i in keep:
                if gap and out:
                    out.append(f"... [{gap} lines elided by analyzer] ...")
                out.append(x)
                gap = 0
            else:
                gap += 1
        if est("\n".join(out)) <= budget or not (tail or heads or len(root) > 1):
            return "\n".join(out)
        if tail:
            tail -= 1
        elif heads:
            heads -= 1
        else:
            root.pop()


def test_excerpts(spark):
    stack = [f"  at shop.Cart.run(Cart.java:{i})" for i in range(60)]
    texts = ["short", "\n".join(f"line {i}" for i in range(400)), "\n".join([*(f"a{i}" for i in range(90)), "java.io.IOException: x", *stack, "", "Caused by: y.Error: z", *stack[:20], "", *(f"z{i}" for i in range(50))]), "x" * 9000, "", "e.FooError " + "y" * 5000 + "\n" + "\n".join(stack)]
    for budget in (1, 40, 200, 500):
        assert column(spark, [*texts, None], lambda c, budget=budget: prompts.excerpt(c, budget)) == [*[naive_excerpt(t, budget) for t in texts], None]


def test_rule_ids(spark):
    cases = {
        "Rule R3 applies.": "", "The element was missing, matching R3. Retry helps.": "The element was missing. Retry helps.", "Matches R12, the failure passed on retry": "The failure passed on retry", "No rule here at all.": "No rule here at all.",
        "The gateway (R7) gave 502!": "The gateway gave 502!", None: "", "R15 isn't a rule.": "R15 isn't a rule.", "  ": "",
    }
    assert column(spark, list(cases), prompts.without_rule_ids) == list(cases.values())


def test_cut_fields(spark):
    def complete(t):
        core = t.rstrip().rstrip(prompts.CLOSERS)
        return not core or core[-1] in prompts.TERMINALS

    def opened(t):
        core = t.rstrip().rstrip(prompts.CLOSERS)
        return bool(core) and core[-1] in prompts.OPEN_ENDS

    texts = ["All done.", "the exception is a", "Unable to locate element: {", "First. Then: {", "said \"so.\"", "", "  \n", "\")]", "ends with dash –  ", "word", "one two {[", "{", "終わり。", "x = y \\"]
    for finish in ("length", "stop", None):
        want = []
        for t in texts:
            cut = opened(t) or finish == "length" and not complete(t)
            base = t.rstrip()
            if opened(t):
                ends = [base.rfind(c) for c in prompts.TERMINALS]
                bare = base.rstrip(prompts.OPEN_ENDS + " \t")
                clip = base[: max(ends) + 1] if max(ends) >= 0 else (bare[: bare.rfind(" ")] if bare.rfind(" ") > 0 else bare).rstrip()
                base = clip or base
            want.append(base + prompts.CUT_MARK if cut else t)
        assert column(spark, texts, lambda c: prompts.marked_cut(c, F.lit(finish))) == want  # noqa: B023
    assert column(spark, [None], lambda c: prompts.looks_cut(c, F.lit("length"))) == [False]


SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["rule", "tags"],
    "properties": {"rule": {"enum": ["R1", "none", 3, None]}, "reason": {"type": ["string", "null"], "maxLength": 5}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "integer"}}, "share": {"type": "number"}, "on": {"type": "boolean"}},
}


def test_schema(spark):
    fits = ['{"rule":"R1","tags":[]}', '{"rule":3,"tags":[1,2],"reason":null}', '{"rule":null,"tags":[1],"share":1.5,"on":true}', '{"rule":"none","tags":[],"share":2,"reason":"fünf5"}']
    not_fits = ['{"rule":"R2","tags":[]}', '{"rule":"R1"}', '{"rule":"R1","tags":[1,2,3]}', '{"rule":"R1","tags":["1"]}', '{"rule":"R1","tags":[true]}', '{"rule":"R1","tags":[],"x":1}', '{"rule":"R1","tags":[],"reason":"sixsix"}', '{"rule":"R1","tags":[],"on":1}', '{"rule":"R1","tags":{}}', "[]", '"x"', "null", "{", None, '{"rule":"R1","tags":[1.5]}', '{"rule":"R1","tags":[],"share":"1"}']
    assert column(spark, fits + not_fits, lambda c: prompts.fits_schema(F.try_parse_json(c), SCHEMA)) == [True] * len(fits) + [False] * len(not_fits)
    assert all(json.loads(t) for t in fits)
