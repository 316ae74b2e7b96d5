"""Cleaning of raw log messages, in its fixed order, as column expressions.

Patterns run in a mode where letters and blanks are Unicode's and only a line feed ends a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MODE = "(?dU)"

# What is removed or unified, in order, and what stands in its place.
EU_DATE, TIME, US_DATE = "\\d+-\\d+-\\d+", "\\d+:\\d+:\\d+(?:[.,]\\d+)?", "\\d+/\\d+/\\d+"
DELIMITER = "(?:(?:\\s*-\\s*)|(?:\\s*\\|\\s*))?"
DATETIMES = [f"^{x}{DELIMITER}\\s*" for x in (f"{EU_DATE}\\s+{TIME}", f"{US_DATE}\\s+{TIME}", TIME, f"\\[{TIME}\\]", f"\\[{EU_DATE}\\s+{TIME}\\]")]
LEVEL = "(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\\s?"
LEVELS = [f"^{x}{DELIMITER}\\s+" for x in (LEVEL, f"\\[{LEVEL}\\]", f"\\({LEVEL}\\)")]
THREAD_IDS = [f"^\\d+\\s+-+\\s*{DELIMITER}\\s+"]
THREAD_NAMES = [f"^\\[[^\\]]*\\]{DELIMITER}\\s+"]
BLANKS = "\\x{20}\\x{09}\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
MARKDOWN = "!!!MARKDOWN_MODE!!!\\s*"
SEPARATOR = "(?:-{3,}=+|={3,}-+|`{3}|-{3,}|={3,}|_{3,})"
SEPARATORS = [
    (f"\\n{SEPARATOR}\\n", " TEXTDELIMITER\n"), (f"^{SEPARATOR}\\n", " TEXTDELIMITER\n"), (f"\\s*{SEPARATOR}\\n", " TEXTDELIMITER\n"), (f"\\n{SEPARATOR}\\s+", "\nTEXTDELIMITER "),
    (f"\\s+{SEPARATOR}\\s+", " TEXTDELIMITER "), (f"^{SEPARATOR}\\s*", "TEXTDELIMITER "), (f"\\s+{SEPARATOR}$", " TEXTDELIMITER"), (f"{SEPARATOR}$", " TEXTDELIMITER"),
]
DRIVER_INFO = [
    "(?:\\s*-*>\\s*)?Webdriver screenshot captured: [^/\\x00\\n.]+\\.\\w+", "\\s*Screenshot: file:/(?:[^/\\x00\\n]+/)*[^/\\x00\\n]+", "\\s*Page source: file:/(?:[^/\\x00\\n]+/)*[^/\\x00\\n]+",
    "\\s*Build info: version: '[^']+', revision: '[^']+'", "\\s*Driver info: [\\w.]+", "\\s*System info: (?:[\\w.]+: '[^']+', )+[\\w.]+: '[^']+'", "\\s*Capabilities \\{\\w+: [^\\n]+",
]
GENERATED = [
    ("\\s*(?:at\\s*)?(?:[a-zA-Z0-9_-]+\\.)+(?:[a-zA-Z0-9_-]+\\$\\$)+[0-9a-f]+\\.(?:[a-zA-Z0-9_-]+\\$|\\.)*[a-zA-Z0-9_-]+\\(<generated>\\).*", ""),
    ("\\b((?:[a-zA-Z0-9_-]+/|\\\\)+)([a-zA-Z0-9_-]+)\\$([a-zA-Z0-9_-]+\\.class)\\b", "$1$2.$3"), ("(?<=[.$])([a-zA-Z0-9_-]+)\\$(?=[a-zA-Z0-9_-]+[.$(@])", "$1."),
    ("\\b((?:[a-zA-Z0-9_-]+\\.)+)([a-zA-Z0-9_-]+)@[0-9a-f]+\\b", "$1$2"), ("\\s*\\.\\.\\. \\d+ more.*", ""),
]
IDS = [
    ("\\b[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\\b", "SPECIALUUID"), ("\\b[0-9a-fA-F]{16,48}|[0-9a-fA-F]{10,48}\\.\\.\\.\\b", "SPECIALUUID"),
    ("\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-(\\w+)\\b", "SPECIALUUID $1"),
]
HEX = [("\\b0x[0-9a-fA-F]{12}\\b", "SPECIALHEX")]
TOKENS = [
    ('(?i)("(?:access|refresh|biometric|jwt)_?token"\\s*:\\s*")[^"]+', "$1SPECIALTOKEN"),
    ("(?i)(Authorization\\s*:\\s*(?:Bearer|Basic|Digest|HOBA|Mutual|Negotiate|NTLM|VAPID|SCRAM|AWS4-HMAC-SHA256)) .*", "$1SPECIALTOKEN"),
]
HTML_OPEN = '<html(?:\\s+\\S+\\s*=\\s*"[^"]*")*\\s*>'
HTML = [
    ('<style(?:\\s+\\S+\\s*=\\s*"[^"]*")*\\s*>[^<]*</style>', " "), ('<script(?:\\s+\\S+\\s*=\\s*"[^"]*")*\\s*>[^<]*</script>', " "),
    ('</?\\w+(?:\\s+[^>\\s]+\\s*=\\s*"[^"]*"\\s?|\\s+[^>\\s]+\\s*)*>|&([a-zA-Z0-9]+|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});', " "),
]
EXTENSIONS = ("java", "php", "cpp", "cs", "c", "h", "js", "swift", "rb", "py", "scala")
HTTP_CODE = "[1-5]\\d{2}"
#: Pattern and number of groups.
STATUS_CODES = [
    *[(f"(?i){x}[^\\w.]+({HTTP_CODE})\\D*({HTTP_CODE})?|{x}[^\\w.]+({HTTP_CODE})?$", 3) for x in ("\\bcode", "\\w+_code", "\\bstatus", "\\w+_status")],
    (f"(?i)\\bcode\\W+expected[:.\\s-]+[\"'`]?({HTTP_CODE})\\D*({HTTP_CODE})?|\\bcode\\W+expected[:.\\s-]+[\"'`]?({HTTP_CODE})[\"'`]?$", 3),
    (f'(?i)"(?:statusCode|status_code|httpCode|http_code|responseCode|response_code)":\\s*"?({HTTP_CODE})\\b', 1),
    *[(f"(?i)\\b{x}\\b[:=\\s]*[\"'`]?({HTTP_CODE})\\b", 1) for x in ("actual", "expected", "statuscode")], (f"(?i)\\bhttp/\\d(?:\\.\\d)?\\s+({HTTP_CODE})\\b", 1), (f"->\\s*({HTTP_CODE})\\b", 1),
]
URL = "(?i)\\b[\\w+]+:/\\S+\\b"
PATH = "(?:^|\\s|\"|'|`)[A-Za-z]:\\\\(?:[^:\\\\\\r\\n]+\\\\)*[^\\s\\\\:\\r\\n]+|(?:^|\\s|\"|'|`)/(?:(?:\\\\.|[^/\\s\\r\\n])+/)*(?:\\\\.|[^/\\s\\r\\n])+"
PUNCTUATION = "!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~"
SPECIAL = "[/?&=#@:.*!$%^+~\\\\|,;<>\\[\\]{}()`\"'_]"
SIMILARITY_SPECIAL = "[.:/\\\\{}()\\[\\]\"',\\-+=!@#$%^&*<>?|~`;_]"
STOP_WORDS = """
    a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn couldn't d did didn didn't
    do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having he he'd he'll her here hers herself
    he's him himself his how i i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn mightn't more most mustn mustn't my myself needn
    needn't no nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she she'd she'll she's should shouldn shouldn't should've so
    some such t than that that'll the their theirs them themselves then there these they they'd they'll they're they've this those through to too under until up ve very was
    wasn wasn't we we'd we'll we're were weren weren't we've what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll your you're yours
    yourself yourselves you've
""".split()


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, MODE + p[0], p[1]), pairs, text)


def removed(text: Column, patterns: list[str]) -> Column:
    return replaced(text, [(p, "") for p in patterns])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def without_level(text: Column) -> Column:
    return removed(text, LEVELS)


def without_datetime(text: Column) -> Column:
    return removed(text, DATETIMES)


def without_thread(text: Column) -> Column:
    return removed(removed(text, THREAD_IDS), THREAD_NAMES)


def without_blank_lines(text: Column) -> Column:
    return joined(F.filter(lines_of(text), lambda x: x.rlike("(?U)\\S")))


def line_count(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: x.rlike("(?U)\\S")))


def unified_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANKS}]*\\r?\\n", "\n")


def unified_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{BLANKS}]+", " "), f"[{BLANKS}]*\\n[{BLANKS}]*", "\n")


def basic(message: Column) -> Column:
    """Without level, date, thread and the like at the start; line ends unified, blank lines dropped."""
    t = without_level(without_datetime(without_level(strip(message))))
    t = without_level(without_thread(t))
    return without_blank_lines(removed(unified_line_endings(t), [MARKDOWN]))


def delimited(text: Column) -> Column:
    return replaced(text, SEPARATORS)


def without_driver_info(text: Column) -> Column:
    return removed(text, DRIVER_INFO)


def url_decoded(text: Column) -> Column:
    """Decoded where it holds encoded characters, and then without brackets and percent signs; a plus stays one."""
    def of(t: Column) -> Column:
        safe = F.regexp_replace(F.replace(t, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        decoded = let(F.coalesce(F.try_url_decode(safe), t), lambda d: F.when(d == t, t).otherwise(F.regexp_replace(d, "[(){}#%]", " ")))
        return F.when(t.contains("%"), decoded).otherwise(t)

    return let(text, of)


def without_generated(text: Column) -> Column:
    return replaced(text, GENERATED)


def unified_ids(text: Column) -> Column:
    return replaced(text, IDS)


def unified_hex(text: Column) -> Column:
    return replaced(text, HEX)


def without_tokens(text: Column) -> Column:
    return replaced(text, TOKENS)


def without_html(text: Column) -> Column:
    """Tags and entities go inside ``<html>`` spans, which go from a line that opens one to the line that closes it."""
    state = "struct<done:array<string>,part:array<string>,open:boolean>"
    empty = F.from_json(F.lit('{"done":[],"part":[],"open":false}'), state)

    def step(s: Column, line: Column) -> Column:
        opened = s.open | line.rlike(MODE + HTML_OPEN)
        part = F.when(opened, F.concat(s.part, F.array(line))).otherwise(s.part)
        done = F.when(opened, s.done).otherwise(F.concat(s.done, F.array(line)))
        closed = line.contains("</html>")
        none = F.array().cast("array<string>")
        return F.struct(F.when(closed, F.concat(done, F.array(replaced(joined(part), HTML)))).otherwise(done).alias("done"), F.when(closed, none).otherwise(part).alias("part"), (opened & ~closed).alias("open"))

    cleaned = lambda t: F.aggregate(lines_of(t), empty, step, lambda s: joined(F.concat(s.done, s.part)))
    return without_blank_lines(let(text, lambda t: F.when(t.contains("html>") | t.contains("<html"), cleaned(t)).otherwise(t)))


def clean(text: Column) -> Column:
    """The second pass over a basic message."""
    t = url_decoded(F.replace(without_driver_info(delimited(text)), F.lit("\t"), F.lit("\n")))
    t = unified_hex(without_tokens(unified_ids(without_generated(t))))
    return without_blank_lines(without_html(t))


def unique_lines(text: Column) -> Column:
    """The first of each line that is the same but for blanks at its ends, as written; lines that point to documentation go."""
    manual = lambda x: F.lower(x).contains("documentation") & F.lower(x).contains("error") & F.lower(x).contains("visit")
    lines = F.filter(lines_of(text), lambda x: ~manual(x))
    return let(lines, lambda ls: let(F.transform(ls, strip), lambda keys: joined(F.filter(ls, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))))


def unified(text: Column) -> Column:
    return unique_lines(clean(text))


def words(text: Column, lower: bool = True, unique: bool = True, least: int = 0) -> Column:
    """Words between blanks and punctuation (dots inside stay), without stop words."""
    t = F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, " " * len(PUNCTUATION))
    parts = F.transform(F.split(F.lower(t) if lower else t, "(?U)\\s+"), lambda w: F.btrim(w, F.lit(".")))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(parts, lambda w: (w != "") & (F.length(w) >= least) & ~F.array_contains(stop, w))
    return F.array_distinct(kept) if unique else kept


def exceptions(text: Column) -> Column:
    """Words that end in error, exception or failure after three characters or more, in order of first sight."""
    t = F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, " " * len(PUNCTUATION))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    ends = F.filter(F.transform(F.split(t, "(?U)\\s+"), lambda w: F.btrim(w, F.lit("."))), lambda w: F.lower(w).rlike("\\S{3,}(error|exception|failure)(\\s|$)"))
    return F.array_distinct(F.filter(ends, lambda w: ~F.array_contains(stop, w)))


def only_numbers(text: Column) -> Column:
    return F.array_join(words(F.regexp_replace(text, "(?U)[^\\d ._]", ""), unique=False), " ")


def status_codes(text: Column, unique: bool = True) -> Column:
    """HTTP codes in the places where logs name them: of each line, the first find of each pattern."""
    def of(line: Column) -> Column:
        return F.array(*[F.regexp_extract(line, MODE + p, g) for p, n in STATUS_CODES for g in range(1, n + 1)])

    # a code is a number, so a line without a digit has none
    lines = F.filter(lines_of(F.coalesce(text, F.lit(""))), lambda x: x.rlike("(?U)\\d"))
    found = F.filter(F.flatten(F.transform(lines, of)), lambda c: c != "")
    return F.array_distinct(found) if unique else found


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MODE + URL), F.lit(0))


def _longest_first(pieces: Column) -> Column:
    return F.transform(F.array_sort(F.transform(pieces, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s.p)


def without_urls(text: Column, found: Column) -> Column:
    """Each URL, as it is or encoded, becomes a mark; longer ones first."""
    def encoded(u: Column) -> Column:
        e = F.replace(F.replace(F.url_encode(u), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
        return F.replace(F.replace(e, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    def step(t: Column, u: Column) -> Column:
        return F.replace(F.replace(t, u, F.lit("SPECIALURL")), encoded(u), F.lit("SPECIALURL"))

    return F.aggregate(_longest_first(found), text, step)


def without_pieces(text: Column, pieces: Column) -> Column:
    return F.aggregate(_longest_first(F.filter(pieces, lambda p: p != "")), text, lambda t, p: F.replace(t, p, F.lit(" ")))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*://)[^:/?#]+:[^@/?#]*@", "$1")


def paths(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(MODE + PATH), F.lit(0)), strip)
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def quoted(text: Column) -> Column:
    """What stands in quotes."""
    found = F.regexp_extract_all(text, F.lit(MODE + "(^|\\W)('.*'|\".*\")(\\W|$)"), F.lit(2))
    inner = F.transform(found, lambda q: strip(F.regexp_extract(strip(q), "[^'\"]+", 0)))
    return F.array_distinct(F.filter(inner, lambda q: q != ""))


def stack_line(line: Column) -> Column:
    """If a line is a frame: ``file:12``, ``line 12``, a source file's name, ``at x(y)`` or ``a.b(c)``. A line that begins like a
    message with its place isn't; by a quirk that is kept, so is none that begins with an extension's letters."""
    extensions = "|".join(EXTENSIONS[1:-1])
    begins = line.rlike(f"{MODE}^(?:\\w*\\s*\\(\\s*.*\\.{EXTENSIONS[0]}|{extensions}|{EXTENSIONS[-1]}:\\d+\\s*\\))")
    marks = [
        "\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}:\\d+", "(?<=[^\\s\\d]:)\\d+(?=\\)?\\]?(\\n|$))", "(?i)line\\s*\\d+\\s*(?:(?=, in)|(?=,in)|(?=\\n)|(?=$))",
        "(?i)(?:" + "|".join(f"\\.{e}(?!\\.)\\b" for e in EXTENSIONS) + ")", "^\\s*at\\s[^(]*\\([^)]*\\)\\s*$", "^\\s*\\w+([./]\\s*\\w+)+\\s*\\(.*?\\)\\s*$",
    ]
    return ~begins & reduce(lambda a, p: a | line.rlike(MODE + p), marks[1:], line.rlike(MODE + marks[0]))


def python_log(text: Column) -> Column:
    """If .py is the only source extension in it."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{MODE}\\.({'|'.join(EXTENSIONS)})(?!\\.)\\b"), F.lit(1)))
    return (F.size(found) == 1) & F.array_contains(found, "py")


def _parted(message: Column, trace: Column, spare: int) -> Column:
    """Lines of the message and of the trace; without a message, the trace's last (or first) line is it."""
    n = F.size(trace)
    one = F.slice(trace, n if spare < 0 else F.lit(1), 1)
    rest = F.slice(trace, F.lit(1) if spare < 0 else F.lit(2), F.greatest(n - 1, F.lit(0)))
    none = (F.size(message) == 0) & (n > 0)
    return F.struct(joined(F.when(none, one).otherwise(message)).alias("description"), joined(F.when(none, rest).otherwise(trace)).alias("stack"))


def _python_parts(text: Column) -> Column:
    """A trace goes from a line that says so to the next one that names an exception."""
    empty = F.from_json(F.lit('{"m":[],"t":[],"trace":false}'), "struct<m:array<string>,t:array<string>,trace:boolean>")

    def step(s: Column, line: Column) -> Column:
        begins = F.lower(line).rlike("stacktrace|stack trace|stack-trace|traceback|trace back")
        trace = F.when(begins, True).when(F.size(exceptions(line)) > 0, False).otherwise(s.trace)
        return F.struct(F.when(trace, s.m).otherwise(F.concat(s.m, F.array(line))).alias("m"), F.when(trace, F.concat(s.t, F.array(line))).otherwise(s.t).alias("t"), trace.alias("trace"))

    return F.aggregate(lines_of(text), empty, step, lambda s: _parted(s.m, s.t, -1))


def parts(text: Column) -> Column:
    """A struct of description and stack; a message of two lines or less is all description."""
    judged = F.transform(lines_of(text), lambda x: F.struct(x.alias("line"), stack_line(x).alias("frame")))
    other = let(judged, lambda js: _parted(F.filter(js, lambda j: ~j.frame)["line"], F.filter(js, lambda j: j.frame)["line"], 1))
    short = F.struct(text.alias("description"), F.lit("").alias("stack"))
    return F.when(line_count(text) <= 2, short).when(python_log(text), _python_parts(text)).otherwise(other)


def without_special(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, " ")


def stacked_colons(text: Column) -> Column:
    return F.replace(text, F.lit(":"), F.lit(" : "))


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, "\\[[^\\]]*\\]|\\([^)]*\\)|\\{[^}]*\\}", "")


def without_numbers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\b\\d+\\b", "SPECIALNUMBER"), "(?U)\\d+", "")


def similarity_tokens(text: Column) -> Column:
    """Lower-case words split at signs and humps, without stop words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), SIMILARITY_SPECIAL, " ")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(t, "(?U)\\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def normalized(message: Column) -> Column:
    """A log's text, basic and unified; a null message is an empty one."""
    return unified(basic(F.coalesce(message, F.lit(""))))


def has_stack(u: Column) -> Column:
    """If a normalised log has a stack."""
    return parts(u).stack.rlike("(?U)\\S")


def record(u: Column) -> Column:
    """The record of a normalised log: description, stack as it is and cleaned, exceptions, codes, URLs, paths, if it has a stack."""
    return let(parts(u), lambda p: let(urls(p.description), lambda found: F.struct(
        u.alias("unified"), p.description.alias("msg"), p.stack.alias("stack_raw"), without_numbers(without_brackets(p.stack)).alias("stack"), exceptions(u).alias("exceptions"),
        status_codes(p.description).alias("status_codes"), found.alias("urls"), paths(without_urls(p.description, F.array_distinct(found))).alias("paths"), p.stack.rlike("(?U)\\S").alias("has_stacktrace"),
    )))


def cleaned_log(message: Column) -> Column:
    """The record of a log as it came."""
    return let(normalized(message), record)


def humps(word: Column) -> Column:
    """The word cut before each capital that begins a hump."""
    return F.regexp_extract_all(word, F.lit("[A-Z][^A-Z]+|(?:[^A-Z]|[A-Z](?![^A-Z]))+"), F.lit(0))


def _segments(word: Column) -> Column:
    return F.split(word, "\\.")


def with_methods(text: Column) -> Column:
    """After each dotted name of three parts and more whose last has four characters: its last two parts, and its last."""
    def step(line: Column, name: Column) -> Column:
        parts_ = _segments(name)
        longer = F.concat(name, F.lit(" "), F.element_at(parts_, -2), F.lit("."), F.element_at(parts_, -1), F.lit(" "), F.element_at(parts_, -1), F.lit(" "))
        alone = F.concat(F.lit("(?U)\\b(?<!\\.)\\Q"), name, F.lit("\\E(?!\\.)\\b"))
        return F.regexp_replace(line, alone, F.regexp_replace(longer, "([\\\\$])", "\\\\$1"))

    def of(line: Column) -> Column:
        names = F.filter(words(line, lower=False), lambda w: (F.size(_segments(w)) > 2) & (F.length(F.element_at(_segments(w), -1)) > 3))
        short_first = F.array_sort(F.transform(names, lambda w, i: F.struct(F.size(_segments(w)).alias("n"), i.alias("i"), w.alias("w"))))
        return F.aggregate(short_first, line, lambda x, n: step(x, n.w))

    return joined(F.transform(lines_of(text), of))


def name_words(name: Column) -> Column:
    """A test's name as words: humps apart, dotted names with their class and method."""
    def of(w: Column) -> Column:
        dotted = F.concat(F.filter(F.split(with_methods(w), " "), lambda x: x != ""), humps(F.element_at(_segments(w), -1)))
        return F.when(F.instr(w, ".") == 0, humps(w)).otherwise(dotted)

    found = F.flatten(F.transform(words(F.translate(name, "-_", "  "), lower=False, unique=False), of))
    return F.array_join(F.filter(F.transform(found, strip), lambda x: x != ""), " ")


def test_methods(text: Column) -> Column:
    """Names of test methods and spec files, sorted, without those that hold an exception. By a quirk that is kept, a spec file
    gives the first two characters of its name, each for itself."""
    methods = F.regexp_extract_all(text, F.lit("(?U)\\b[^\\s()/\\\\:]+(?:Test|Step)s?\\.[^\\s()/\\\\:]*"), F.lit(0))
    specs = F.regexp_extract_all(text, F.lit("(?U)\\b[^\\s()/\\\\:]+\\.(?:spec|cy)\\.[jt]s\\b"), F.lit(0))
    chars = F.filter(F.flatten(F.transform(specs, lambda s: F.array(F.substr(s, F.lit(1), F.lit(1)), F.substr(s, F.lit(2), F.lit(1))))), lambda c: strip(c) != "")
    return F.array_sort(F.array_distinct(F.filter(F.concat(methods, chars), lambda m: F.size(exceptions(m)) == 0)))


def prepared_log(message: Column) -> Column:
    """Views of a log's message half: its trace, URLs, the text without them, paths, codes, exceptions after numbers are gone."""
    return let(cleaned_log(message), lambda r: F.struct(
        r.msg.alias("exception_message"), r.stack_raw.alias("stacktrace"), r.urls.alias("urls"), without_urls(r.msg, F.array_distinct(r.urls)).alias("no_urls"), F.array_join(r.paths, " ").alias("paths"),
        F.array_join(r.status_codes, " ").alias("status_codes"), F.array_join(exceptions(without_numbers(r.msg)), " ").alias("exceptions"),
    ))
