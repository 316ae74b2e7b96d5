"""Column functions that mask log text and compare texts as sets. Patterns that identify things are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked, in order, and what masked text says in its place.
MASKS = (
    ("<URL>", "https?://[^\\s\"'<>]+"),
    ("<IP>", "\\b(?:\\d{1,3}\\.){3}\\d{1,3}(?::\\d{1,5})?\\b"),
    ("<UUID>", "\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b"),
    ("<HEX>", "\\b0[xX][0-9a-fA-F]+\\b|\\b[0-9a-fA-F]{16,}\\b"),
    ("<PATH>", "(?:[A-Za-z]:)?(?:[\\\\/][\\w.\\-]+){2,}"),
)
MASKED_NUMBER = "(?<![\\w.])[-+]?\\d+(?:\\.\\d+)?(?![\\w.])"


def mask(message: Column) -> Column:
    """Variable parts in a fixed order: addresses before numbers, as they hold numbers."""
    for mark, pattern in MASKS:
        message = F.regexp_replace(message, pattern, mark)
    return F.regexp_replace(message, MASKED_NUMBER, "<NUM>")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of lower-cased words, each with two blanks before and one after."""
    padded = F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; ``empty`` if both are empty or null."""
    a, b = F.coalesce(a, F.array()), F.coalesce(b, F.array())
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
