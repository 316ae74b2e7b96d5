"""Column functions on candidates: scope boosts, discriminants, seed modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeds import SEED_MODES, SeedMode
from .text import jaccard

BOOST = 1.1
#: Tokens that name things: dotted paths, scope resolution, camel humps.
IDENTIFIER = "\\.|::|[a-z][A-Z]"
LEAST_JACCARD = 0.5


def _if(condition: Column) -> Column:
    return F.when(condition, F.lit(BOOST)).otherwise(F.lit(1.0))


def analyze_boost(mode: Column, same_name: Column, same_launch: Column) -> Column:
    """What a candidate's score is multiplied by where a launch is analysed; most modes only filter."""
    m = F.upper(F.trim(mode))
    known = m.isin("LAUNCH_NAME", "CURRENT_LAUNCH", "PREVIOUS_LAUNCH", "ALL")
    return F.when(m == "CURRENT_AND_THE_SAME_NAME", _if(same_launch)).when(known, F.lit(1.0)).otherwise(_if(same_name) * _if(same_launch))


def suggest_boost(mode: Column, same_name: Column, same_launch: Column, previous: Column) -> Column:
    """What a candidate's score is multiplied by where suggestions are asked for; no mode filters there."""
    m = F.upper(F.trim(mode))
    return F.when(m.isin("LAUNCH_NAME", "ALL"), _if(same_name) / _if(same_launch)).when(m == "PREVIOUS_LAUNCH", _if(previous)).otherwise(_if(same_name) * _if(same_launch))


def tokens(message: Column) -> Column:
    return F.array_distinct(F.filter(F.split(message, "\\s+"), lambda w: w != ""))


def identifiers(of: Column) -> Column:
    return F.filter(of, lambda w: w.rlike(IDENTIFIER))


def identifier_jaccard(a: Column, b: Column) -> Column:
    """Of identifier tokens if either side has any, else of all tokens; two empty sets are equal."""
    i, j = identifiers(a), identifiers(b)
    return F.when((F.size(i) > 0) | (F.size(j) > 0), jaccard(i, j, 1.0)).otherwise(jaccard(a, b, 1.0))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def discriminant_agrees(codes: Column, message: Column, other_codes: Column, other_message: Column) -> Column:
    """The gate before a label is inherited: equal sets of status codes, and names in common."""
    return same_set(codes, other_codes) & (identifier_jaccard(tokens(message), tokens(other_message)) >= LEAST_JACCARD)


def _like(pattern: str):
    return lambda c: c.rlike(pattern)


def _fits(mode: SeedMode, classes: Column, message: Column, lowered: Column) -> Column:
    found = F.lit(False)
    for p in mode.exceptions:
        found = found | F.exists(classes, _like(p))
    for p in mode.messages:
        found = found | message.rlike(f"(?im){p}")
    for w in mode.words:
        found = found | lowered.contains(w)
    return found


def seed_mode(classes: Column, message: Column, templates: Column | None = None) -> Column:
    """The first seed mode that fits, as a struct of key, label and confidence; null for none. Classes are matched as written,
    the message and the template texts line by line in any case, words as pieces of any of them."""
    texts = F.filter(F.concat(F.array(F.coalesce(message, F.lit(""))), templates if templates is not None else F.array().cast("array<string>")), lambda x: x != "")
    whole = F.array_join(texts, "\n")
    lowered = F.lower(F.array_join(F.concat(texts, classes), "\n"))
    out = None
    for m in SEED_MODES:
        value = F.struct(F.lit(m.key).alias("key"), F.lit(m.label).alias("label"), F.lit(m.confidence).alias("confidence"))
        out = F.when(_fits(m, classes, whole, lowered), value) if out is None else out.when(_fits(m, classes, whole, lowered), value)
    return out
