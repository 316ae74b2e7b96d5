"""Column expressions that several operators share. White space and letters' case are ASCII everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null, in order."""

    def inner(parts: Column) -> Column:  # white space at either end leaves an empty part there
        first = F.when(parts[0] == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return let(F.split(text, "[ \\t-\\r]+"), inner)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; a text of ASCII characters only takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
