"""Signatures of failures: exception chains, frames, masked messages, hashes and documents as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .cleaning import let, lines_of, stack_line, strip
from .text import mask

MAX_CLASSES, MAX_FRAMES, MESSAGE_LINES, MAX_TEMPLATES, DOCUMENT_CHARS, CONTEXT_LINES = 4, 3, 8, 30, 2000, 5
# Patterns and prefixes that decide identity.
CHAIN_MARKERS = "(?i)caused by:|during handling of the above exception|the above exception was the direct cause"
ASSERTION = "(?i)expected.*(but was|received|actual)"
ASSERTED = "(?i)\\b(expected|but was|actual|received)\\b\\s*[:=]?\\s*[^,\\n]+"
FRAMES = ("\\bat\\s+([\\w$.]+)\\s*\\(", "^\\s*([\\w$.]+)\\([^)]*\\)\\s*$", "File\\s+\"([^\"]+)\",\\s*line\\s+\\d+,\\s*in\\s+(\\S+)")
CLASS_SUFFIXES = ("\\$\\$Lambda.*", "\\$\\$EnhancerBy\\w+.*", "\\$Proxy\\d+", "\\.\\.EnhancerBySpring.*", "\\$\\d+")
FRAMEWORKS = ("java.", "javax.", "jdk.", "org.springframework.", "org.apache.", "com.google.", "io.netty.", "okhttp3.", "requests.", "urllib3.", "selenium.", "org.openqa.", "node_modules")
DROPPED = ("jdk.internal.", "sun.reflect.", "java.lang.reflect.", "org.junit.", "org.testng.", "pytest", "unittest", "reflect.")
NO_MESSAGE = "<no message>"


def normal_class(name: Column) -> Column:
    """Without what proxies and lambdas add to a class or frame."""
    return reduce(lambda n, p: F.regexp_replace(n, p, ""), CLASS_SUFFIXES, name)


def exception_chain(found: Column, message: Column) -> Column:
    """The root cause first: in a chained message the last exception comes to the front."""
    n = F.size(found)
    turned = F.concat(F.slice(found, F.greatest(n, F.lit(1)), 1), F.slice(found, 1, F.greatest(n - 1, F.lit(0))))
    classes = F.transform(F.when(message.rlike(CHAIN_MARKERS) & (n > 1), turned).otherwise(found), normal_class)
    return F.slice(F.array_distinct(F.filter(classes, lambda c: c != "")), 1, MAX_CLASSES)


def frame(line: Column) -> Column:
    """The frame of a stack's line: Java's, a bare one, or a Python file and function; empty for none."""
    java, bare = F.regexp_extract(line, "(?U)" + FRAMES[0], 1), F.regexp_extract(line, "(?U)" + FRAMES[1], 1)
    name, method = F.regexp_extract(line, FRAMES[2], 1), F.regexp_extract(line, FRAMES[2], 2)
    module = F.regexp_replace(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), "\\.\\w+$", "")
    return F.when(java != "", java).when(bare != "", bare).when(method != "", F.concat(module, F.lit("."), method)).otherwise("")


def _begins(x: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | x.startswith(p), prefixes, F.lit(False))


def frames(stack: Column, in_app: Column | None = None) -> Column:
    """The first three frames in order of lines: those of the application first (of ``in_app``'s package prefixes, where given),
    then others; frames of frameworks never."""
    parsed = F.transform(F.filter(lines_of(F.coalesce(stack, F.lit(""))), stack_line), lambda x: normal_class(frame(x)))
    parsed = F.array_distinct(F.filter(parsed, lambda f: (f != "") & ~_begins(f, DROPPED) & ~_begins(f, FRAMEWORKS)))
    if in_app is None:
        return F.slice(parsed, 1, MAX_FRAMES)
    own = lambda f: F.array_contains(in_app, F.substring_index(f, ".", 2)) | F.array_contains(in_app, F.substring_index(f, ".", 3))
    return let(parsed, lambda p: F.slice(F.concat(F.filter(p, own), F.filter(p, lambda f: ~own(f))), 1, MAX_FRAMES))


def is_assertion(message: Column) -> Column:
    return message.rlike(ASSERTION)


def masked_message(message: Column) -> Column:
    """The first lines, in one line, variable parts masked; in an assertion, so are the values."""
    head = F.substring_index(message, "\n", MESSAGE_LINES)
    values = F.when(is_assertion(message), F.regexp_replace(head, ASSERTED, "$1 <VAL>")).otherwise(head)
    return strip(F.replace(mask(values), F.lit("\n"), F.lit(" ")))


def folded_context(messages: Column) -> Column:
    """The first lines of the last messages before the first error, masked, each behind a marker; empty for none."""
    n = F.size(messages)
    last = F.slice(messages, F.greatest(n - CONTEXT_LINES + 1, F.lit(1)), CONTEXT_LINES)
    masked = F.filter(F.transform(last, lambda m: strip(F.regexp_replace(mask(F.substring_index(m, "\n", 1)), "(?U)\\s+", " "))), lambda m: m != "")
    return F.array_join(F.transform(masked, lambda m: F.concat(F.lit("ctx "), m)), " ")


@F.arrow_udf(LongType())
def xxh3(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """XXH3-64 of a text, folded into a signed number; null for null."""
    import xxhash

    for batch in texts:
        values = [None if t is None else xxhash.xxh3_64_intdigest(t.encode()) for t in batch.to_pylist()]
        yield pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def fingerprint_text(classes: Column, top: Column) -> Column:
    """What an exception's fingerprint is the hash of; null where there is neither class nor frame."""
    text = F.concat(F.array_join(classes, "|"), F.lit("#"), F.array_join(top, "|"))
    return F.when((F.size(classes) > 0) | (F.size(top) > 0), text)


def error_hash_text(print_: Column, templates: Column) -> Column:
    return F.concat(print_.cast("string"), F.lit("#"), F.array_join(templates, "|"))


def template_set_text(print_: Column, templates: Column) -> Column:
    """What names a set of templates whatever their order."""
    return F.concat(print_.cast("string"), F.lit("#"), F.array_join(F.transform(F.array_sort(templates), lambda t: t.cast("string")), ","))


def cluster_id(hashed: Column) -> Column:
    """A hash cut to what a double holds exactly."""
    return hashed.bitwiseAND(F.lit((1 << 53) - 1).cast("long"))


def _cut(value: Column, chars: Column) -> Column:
    return F.regexp_replace(F.left(value, F.greatest(chars, F.lit(0))), "(?U)\\s+$", "")


def document(test: Column, classes: Column, message: Column, top: Column, templates: Column, codes: Column) -> Column:
    """The signature document, a line a section; over its length the message is cut first, then templates, then frames."""
    names = ("TEST", "EXC", "MSG", "FRAMES", "TEMPLATES", "CODES")
    joined = lambda a: F.array_join(a, " ")
    first = F.struct(
        F.coalesce(test, F.lit("")).alias("TEST"), joined(classes).alias("EXC"), F.when(F.coalesce(message, F.lit("")) == "", NO_MESSAGE).otherwise(message).alias("MSG"), joined(top).alias("FRAMES"),
        joined(F.slice(templates, 1, MAX_TEMPLATES)).alias("TEMPLATES"), joined(F.transform(codes, lambda c: F.concat(F.lit("HTTP_"), c.cast("string")))).alias("CODES"),
    )
    text = lambda s: F.array_join(F.filter(F.array(*[F.when(s[n] != "", F.concat(F.lit(f"{n}: "), s[n])) for n in names]), lambda x: x.isNotNull()), "\n")

    def trimmed(s: Column, key: str) -> Column:
        over = F.length(text(s)) - DOCUMENT_CHARS
        return F.struct(*[(F.when(over > 0, _cut(s[n], F.length(s[n]) - over)).otherwise(s[n]) if n == key else s[n]).alias(n) for n in names])

    return let(first, lambda a: let(trimmed(a, "MSG"), lambda b: let(trimmed(b, "TEMPLATES"), lambda c: let(trimmed(c, "FRAMES"), lambda d: F.left(text(d), F.lit(DOCUMENT_CHARS))))))
