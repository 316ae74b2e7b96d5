"""Cleaning of log messages, case by case."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import cleaning as c

CASES = [
    ("without_datetime", "2024-01-02 10:11:12.345 - boom", "boom"), ("without_datetime", "1/2/2024 10:11:12 | boom", "boom"), ("without_datetime", "[10:11:12] x", "x"), ("without_datetime", "[2024-01-02 10:11:12,5] x", "x"), ("without_datetime", "v 10:11:12", "v 10:11:12"),
    ("without_level", "ERROR - boom", "ERROR - boom".replace("ERROR - ", "")), ("without_level", "[WARN] boom", "boom"), ("without_level", "(INFO) boom", "boom"), ("without_level", "ERRORS boom", "ERRORS boom"),
    ("without_thread", "123 --- [main] boom", "boom"), ("without_thread", "[pool-1] - boom", "boom"), ("without_blank_lines", "a\n \n\nb\n", "a\nb"), ("line_count", "a\n\n b", 2),
    ("unified_line_endings", "a \t\r\nb\u00a0\nc", "a\nb\nc"), ("unified_spaces", "a\u2003\u3000b \n\t c", "a b\nc"), ("unified_ids", "id 123e4567-e89b-12d3-a456-426614174000.", "id SPECIALUUID."), ("unified_ids", "0123456789abcdef0123 x", "SPECIALUUID x"),
    ("unified_ids", "123e4567-e89b-12d3-a456-node7", "SPECIALUUID node7"), ("unified_hex", "at 0x00007f1234ab!", "at SPECIALHEX!"), ("without_tokens", '{"access_token": "abc.def", "a": 1}', '{"access_token": "SPECIALTOKEN", "a": 1}'), ("without_tokens", "authorization: bearer abc def\nx", "authorization: bearerSPECIALTOKEN\nx"),
    ("url_decoded", "a%20b(c)", "a b c "), ("url_decoded", "1+1 (x) 100%", "1+1 (x) 100%"), ("url_decoded", "a+b%2Fc%zz", "a+b/c zz"), ("without_generated", "a\n at com.X$$Enh$$ab12.f(<generated>) z\nb", "a\nb"), ("without_generated", "com.A$B$C.run(x)", "com.A.B.C.run(x)"), ("without_generated", "com.shop.Cart@1f2e3d ok", "com.shop.Cart ok"), ("without_generated", "x\n... 12 more lines", "x"),
    ("delimited", "a\n-----\nb", "a TEXTDELIMITER\nb"), ("delimited", "===\nb", " TEXTDELIMITER\nb"), ("delimited", "a ``` b", "a TEXTDELIMITER b"), ("without_driver_info", "x\nDriver info: driver.version: y\nBuild info: version: '1', revision: 'a'", "x: y"), ("without_driver_info", "a\nCapabilities {browser: x, y}", "a"),
    ("without_html", "a <b>1</b>\n<html lang=\"x\">\n<p>t</p>&amp;\n</html>\nb", "a <b>1</b>\n   \n t  \n \nb".replace("\n   \n", "\n").replace("\n \n", "\n")), ("without_html", "<html><body>x</body>", "<html><body>x</body>"),
    ("unique_lines", " a\na \nb\nFor documentation on this Error please visit x\na", " a\nb"), ("words", "The Cart.total failed, with cart.total. and x", ["cart.total", "failed", "x"]), ("exceptions", "NullPointerException in my error: a.b.IOFailure NullPointerException, xerror", ["NullPointerException", "a.b.IOFailure"]),
    ("only_numbers", "a 12 b3.4 12", "12 3.4 12"), ("status_codes", "Status: 404\nExpected: 200 Actual: 503\nport 8080\nGET /x -> 500", ["404", "503", "200", "500"]), ("status_codes", '{"statusCode": "418"} HTTP/1.1 301', ["418", "301"]), ("status_codes", "response_code = 201, then 502", ["201", "502"]), ("status_codes", "retry 404", []),
    ("urls", "see https://a.b/c?d=1. and ftp://x/y!", ["https://a.b/c?d=1", "ftp://x/y"]), ("without_credentials", "https://u:p@h.org/x", "https://h.org/x"), ("without_credentials", "https://h.org/x@y", "https://h.org/x@y"),
    ("paths", "in /usr/lib/x.so and C:\\a b\\c.txt, '/tmp/q", ["/usr/lib/x.so", "C:\\a b\\c.txt,", "'/tmp/q"]), ("quoted", "got 'a b' here", ["a b"]), ("quoted", 'x "y z".', ["y z"]),
    ("stack_line", "  at org.x.Y.run(Y.java:12)", True), ("stack_line", "  org.x.Y.run(Unknown)", True), ("stack_line", 'File "x.py", line 3, in f', True), ("stack_line", "cart failed", False), ("stack_line", "to 10.0.0.1:80", True), ("stack_line", "connect 10.0.0.1:80", False), ("stack_line", "all is well", False), ("stack_line", "at 1:1", False),
    ("python_log", "a.py b.py", True), ("python_log", "a.py b.js", False), ("without_special", "a/b_c", "a b c"), ("stacked_colons", "a:b", "a : b"), ("without_brackets", "a[b](c){d}e", "ae"), ("without_numbers", "a1 22 b", "a SPECIALNUMBER b"),
    ("similarity_tokens", "XMLHttpRequest.sendNow the data", ["xml", "http", "request", "send", "data"]),
]


def test_cases(spark):
    names = sorted({n for n, *_ in CASES})
    for n in names:
        rows = [(k, t) for k, (m, t, _) in enumerate(CASES) if m == n]
        got = {r.k: r.out for r in spark.createDataFrame(rows, "k int, t string").select("k", getattr(c, n)(F.col("t")).alias("out")).collect()}
        for k, t in rows:
            assert got[k] == CASES[k][2], (n, t, got[k])


def test_parts_and_record(spark):
    java = "2024-01-02 10:11:12 ERROR boom status: 503\norg.x.CartException: bad https://a.b/c in /tmp/x/y\n\tat org.x.A.f(A.java:10)\n\tat org.x.B.g(B.java:20)"
    python = "it failed\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\nValueError: bad\nmore"
    rows = spark.createDataFrame([(0, java), (1, python), (2, "one line (A.java:1)"), (3, None), (4, "at x.A.f(A.java:1)\nat x.B.f(B.java:1)\nat x.C.f(C.java:1)")], "k int, m string")
    got = {r.k: r.r for r in rows.select("k", c.cleaned_log(F.col("m")).alias("r")).collect()}
    assert got[0].msg == "boom status: 503\norg.x.CartException: bad https://a.b/c in /tmp/x/y" and got[0].has_stacktrace and got[0].status_codes == ["503"] and got[0].exceptions == ["org.x.CartException"]
    assert got[0].urls == ["https://a.b/c"] and got[0].paths == ["/tmp/x/y"] and got[0].stack == "at org.x.A.f\nat org.x.B.g"
    assert got[1].msg == "it failed\nValueError: bad\nmore" and got[1].stack_raw.startswith("Traceback") and got[1].exceptions == ["ValueError"]
    assert got[2].msg == "one line (A.java:1)" and not got[2].has_stacktrace
    assert got[3].unified == "" and got[3].exceptions == [] and not got[3].has_stacktrace
    assert got[4].msg == "at x.A.f(A.java:1)" and got[4].stack_raw.count("\n") == 1


def test_urls_become_marks(spark):
    df = spark.createDataFrame([("go http://a.b/c d and http%3A//a.b/c%20e http://a.b/c/x", ["http://a.b/c", "http://a.b/c/x", "http://a.b/c e"])], "t string, u array<string>")
    assert df.select(c.without_urls(F.col("t"), F.col("u")).alias("o")).first().o == "go SPECIALURL d and SPECIALURL SPECIALURL"
    assert df.select(c.without_pieces(F.lit("abc ab"), F.array(F.lit("ab"), F.lit("abc"))).alias("o")).first().o == "   "


@pytest.mark.parametrize("n", [0, 2])
def test_words_of_a_length(spark, n):
    assert spark.range(1).select(c.words(F.lit("a bb a ccc"), unique=False, least=n).alias("w")).first().w == (["bb", "ccc"] if n else ["bb", "ccc"])
