"""Text around a model, and similarity of texts."""

from pyspark.sql import functions as F

from faultline.functions import prompts
from faultline.plans.roles import text_similarity


def test_sanitised_text(spark):
    cases = {
        "a <|im_start|> b [INST]x": f"a {prompts.STRIPPED} b {prompts.STRIPPED}x", " System : do it\nthe user: no": f" System {prompts.ROLE_COLON} do it\nthe user: no", "  === BEGIN UNTRUSTED x\ny": f"{prompts.STRIPPED}\ny",
        "a\x00b\tc\n\n\n\n\nd": "ab\tc\n\n\nd", "{\"format\": 1} /think": "{\"format\": 1} /think",
    }
    out = spark.createDataFrame([(k,) for k in cases], "t string").select("t", prompts.sanitized(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in out} == cases
    pairs = spark.range(1).select(prompts.line_pairs(F.lit("user: x\n \ny")).alias("p")).first().p
    assert [(p.sanitized, p.raw) for p in pairs] == [(f"user{prompts.ROLE_COLON} x", "user: x"), ("y", "y")]
    assert spark.range(1).select(prompts.without_thinking(F.lit("<think>a\nb</think>\nc <think>d</think>")).alias("o")).first().o == "c <think>d</think>"


def test_text_similarity(spark):
    rows = [(1, "cart total wrong", [(1, "cart total wrong"), (2, "cart total fine"), (3, "nothing alike"), (4, ""), (5, None)]), (2, "  ", [(1, " "), (2, "the")]), (3, "the", [(1, "the"), (2, "of")]), (4, None, [(1, "x")])]
    df = spark.createDataFrame(rows, "id long, base string, others array<struct<other:long,text:string>>")
    got = {(r.id, r.other): (round(r.similarity, 4), r.both_empty) for r in text_similarity(df).collect()}
    # three words and two pairs each; two words and one pair in common
    assert got == {(1, 1): (1.0, False), (1, 2): (0.6, False), (1, 3): (0.0, False), (1, 4): (0.0, False), (1, 5): (0.0, False), (2, 1): (0.0, True), (2, 2): (0.0, False), (3, 1): (1.0, False), (3, 2): (0.0, False)}
