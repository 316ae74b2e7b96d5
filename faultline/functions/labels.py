"""Column functions on labels, evidence and confidence. Thresholds are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTO, SUGGEST = 0.75, 0.45
SOURCE_WEIGHTS = {"rp_defect_update": 1.0, "human_ui": 0.9, "seed": 0.6}
OTHER_SOURCE_WEIGHT = 0.3
HALF_LIFE_DAYS = 90


def base_group(label: Column) -> Column:
    """pb, ab, si or nd from a locator's two leading letters; null for anything else."""
    lead = F.lower(F.substring(F.trim(label), 1, 2))
    return F.when(lead.isin("pb", "ab", "si", "nd"), lead)


def shown_group(label: Column) -> Column:
    lead = F.substring(label, 1, 2)
    return F.when(label.isNull() | (label == ""), "none").when(lead.isin("pb", "ab", "si", "nd", "ti"), lead).otherwise("other")


def band(confidence: Column) -> Column:
    return F.when(confidence >= AUTO, "auto").when(confidence >= SUGGEST, "suggest").otherwise("abstain")


def source_weight(source: Column) -> Column:
    out = F.lit(OTHER_SOURCE_WEIGHT)
    for name, weight in SOURCE_WEIGHTS.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def decay(days: Column) -> Column:
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.exp(-F.log(F.lit(2.0)) * days / HALF_LIFE_DAYS))


def clamp01(x: Column) -> Column:
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / 86_400_000_000.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a proportion; n is over 0."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def difference_lower(hits: Column, n: Column, base_hits: Column, base_n: Column) -> Column:
    """The lower bound of the difference of two proportions, from both Wilson intervals."""
    (low, _), (_, high) = wilson(hits, n), wilson(base_hits, base_n)
    p, q = hits / n, base_hits / base_n
    return p - q - F.sqrt((p - low) * (p - low) + (high - q) * (high - q))
