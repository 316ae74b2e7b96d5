import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.sources import messages
from faultline.streaming.dispatch import dispatched, sending, sent, serve


def line(key, body, reply_to=None, cid=None):
    return json.dumps({"routing_key": key, "reply_to": reply_to, "correlation_id": cid, "headers": {"h": "1"}, "body": body}) + "\n"


def value(name):
    return F.get_json_object("body", f"$.{name}")


HANDLERS = {
    # fails for negative numbers, tried twice again
    "analyze": lambda m: m.select("message_id", F.when(value("n") == "0", "[]").otherwise(F.concat(F.lit("["), value("n"), F.lit("]"))).alias("reply"), F.when(value("n").cast("int") < 0, F.lit("ValueError: below zero")).alias("error"), F.lit(2).alias("retries")),
    "train_models": lambda m: m.select("message_id", F.lit(None).alias("reply"), F.lit(None).alias("error")),
    "suggest": lambda m: m.select("message_id", F.lit("[1]").alias("reply"), F.lit(None).alias("error")),
}


def expected(lines):
    """What is sent for envelopes, one after the other: sorted (sink, destination, correlation id, body, error, key, retries)."""
    out = []
    for text in lines:
        try:
            m = json.loads(text)
            key, body = m["routing_key"], m["body"]
        except (ValueError, KeyError, TypeError):
            out.append(("dead", None, None, text.rstrip("\n"), "EnvelopeError: the line is no envelope", "", 0))
            continue
        try:
            n = json.loads(body).get("n")
        except ValueError:
            out.append(("dead", None, None, body, "JSONDecodeError: the body is no JSON", key or "", 0))
            continue
        reply = {"analyze": "[]" if n == 0 else f"[{n}]", "suggest": "[1]"}.get(key)
        if key == "analyze" and n < 0:
            out.append(("dead", None, None, body, "ValueError: below zero", key, 2))
        elif reply is not None and m["reply_to"]:
            out.append(("reply", m["reply_to"], m["correlation_id"], reply, None, None, None))
        elif reply not in (None, "[]") and key == "analyze":
            out.append(("result", "results", m["correlation_id"], reply, None, None, None))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.sink, r.destination, r.correlation_id, r.body, r.x_error, r.x_routing_key, r.x_retries) for r in df.collect()], key=repr)


def some_lines(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = rng.choice(['{"n": %d}' % rng.randint(-2, 3), '{"n": 1, "pad": "%s"}' % ("ü" * rng.randint(0, 90)), '{"n": ', "", "nix"])
        out.append(rng.choice([line(rng.choice(["analyze", "suggest", "train_models", "other", "analyze"]), body, rng.choice([None, "", "q1"]), f"c{k}")] * 9 + ["no envelope\n", '{"body": 3\n', "{}\n"]))
    return out


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 20])
def test_every_line_is_read_once_however_segments_are_cut(spark, tmp_path, piece):
    messages.register(spark)
    lines = ["a", "", "bb" * 30, "ü" * 9, "x", "   ", "last"]
    (tmp_path / "one.log").write_text("\n".join(lines) + "\nnot ended")
    (tmp_path / "two.log").write_text("")
    (tmp_path / "_hidden").write_text("z\n")
    rows = spark.read.format("messages").option("pieceBytes", piece).load(str(tmp_path)).collect()
    text = (tmp_path / "one.log").read_bytes()
    assert sorted((r.position, r.value) for r in rows) == [(text.index(x.encode() + b"\n"), x) for x in lines if x.strip()]


def test_an_empty_folder_has_no_messages(spark, tmp_path):
    messages.register(spark)
    df = spark.read.format("messages").load(str(tmp_path))
    assert df.columns == ["segment", "position", "value"] and df.count() == 0
    assert spark.read.format("messages").load(f"{tmp_path}/missing").count() == 0


def test_answers_go_where_they_belong(spark, tmp_path):
    messages.register(spark)
    lines = some_lines(1, 200)
    (tmp_path / "s").write_text("".join(lines))
    taken = messages.opened(spark.read.format("messages").option("pieceBytes", 500).load(str(tmp_path)))
    assert found(dispatched(taken, HANDLERS)) == expected(lines)
    assert {r.sink for r in dispatched(taken, HANDLERS, None).collect()} == {"dead", "reply"}
    assert {r.x_error.split(":")[0] for r in dispatched(taken, {}).collect()} == {"EnvelopeError", "JSONDecodeError"}


def test_a_stream_goes_on_in_growing_segments_and_sends_nothing_twice(spark, tmp_path):
    lines = some_lines(2, 90)
    home, out = tmp_path / "in", f"file://{tmp_path}/out"
    home.mkdir()

    def run():
        serve(spark, str(home), HANDLERS, out, f"file://{tmp_path}/state").awaitTermination()

    (home / "a").write_text("".join(lines[:20]) + lines[20][:9])
    run()
    assert found(sent(spark, out)) == expected(lines[:20])
    with open(home / "a", "a") as f:
        f.write(lines[20][9:] + "".join(lines[21:40]))
    (home / "b").write_text("".join(lines[40:90]))
    run()
    run()
    assert found(sent(spark, out)) == expected(lines)


def test_a_repeated_batch_takes_the_place_of_its_first_attempt(spark, tmp_path):
    messages.register(spark)
    lines, out = some_lines(3, 60), f"file://{tmp_path}/out"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("".join(lines))
    batch = messages.opened(spark.read.format("messages").load(str(tmp_path / "in")))
    send = sending(HANDLERS, out)
    send(batch.limit(20), 0)
    send(batch, 0)
    assert found(sent(spark, out)) == expected(lines)


def test_a_handler_that_raises_loses_nothing(spark, tmp_path):
    lines, out = some_lines(4, 30), f"file://{tmp_path}/out"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("".join(lines))

    def broken(m):
        raise RuntimeError("no model yet")

    with pytest.raises(Exception, match="no model yet"):
        serve(spark, str(tmp_path / "in"), HANDLERS | {"suggest": broken}, out, f"file://{tmp_path}/state").awaitTermination()
    serve(spark, str(tmp_path / "in"), HANDLERS, out, f"file://{tmp_path}/state").awaitTermination()
    assert found(sent(spark, out)) == expected(lines)
