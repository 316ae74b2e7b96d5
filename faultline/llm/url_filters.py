"""Pattern rules for URLs, indexed by their rarest literal token, in DataFrame functions only.

A URL's tokens fetch candidate rules from the index, and only those run their regular expressions. The index holds a row for
each rule under the literal token that fewest URLs have, so a rule's common tokens (``com``) fetch nothing where it has a rarer
one. Rows travel once, grouped by (id, url), so a URL that a third of all rows share collapses before the shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import LOWER, UPPER

#: Up to so many rules the index is broadcast (about 200 bytes a rule); beyond, it is joined by a shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` (a Java regular expression) is searched in host + path + rest of the URL, A-Z lowered (a listed
    rule is searched without lowering the path). ``literals`` are
    tokens ``[a-z0-9]+`` that stand whole in every URL that fits; a rule without any is tried on every URL. Of the rules that
    fit, the one of highest ``weight`` decides, then the first by name."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = field(default=())
    weight: int = 0
    listed: bool = False


def _lowered(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def host_rule(verdict: str, rule: str) -> UrlRule:
    """A rule ``host/path``: it fits the host and its subdomains if the URL's path starts with the rule's. Longer ones win."""
    host, slash, rest = rule.partition("/")
    host, literal = _lowered(host), _lowered(rest)  # a URL's tokens are lowered, a path's case is kept for the pattern
    whole = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+(?=[^a-z0-9])", literal)
    return UrlRule(rule, verdict, f"^([^/?#]*\\.)?{re.escape(host)}{re.escape(slash + rest)}", tuple(dict.fromkeys(whole)), 1_000_000 + len(rule), True)


#: Words of hosts and paths that the method blocks by itself.
BLOCKED_WORDS = ("casino", "poker", "betting", "porn", "xxx", "viagra", "warez", "torrent")
#: Pages of a site that hold no text of their own.
BLOCKED_PATHS = ("login", "signin", "logout", "cart", "checkout", "wp-admin")

PATTERN_RULES = tuple(UrlRule(f"word:{w}", "block", f"(^|[^a-z0-9]){w}([^a-z0-9]|$)", (w,)) for w in BLOCKED_WORDS) + tuple(
    UrlRule(f"page:{p}", "block", f"/{re.escape(p)}(\\.[a-z]+)?/?([?#].*)?$", tuple(re.findall("[a-z0-9]+", p))) for p in BLOCKED_PATHS
)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lowered; empty for a null or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where the host's rule says so."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rows(spark, rows: list[tuple], names: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """A table of literals: a short one is made inside the JVM, a long one is sent to it."""
    if len(rows) > 500:
        return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows])))


def url_filters(pages: DataFrame, rules: list[UrlRule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """A row (key, url, host, path, rule, verdict, matched) for each row of ``pages``.

    ``rule`` is the listed rule that decides, else null; ``matched`` is the name of any rule that decides; ``verdict`` is its
    verdict, else ``default``. Null or empty URLs have an empty host and path and fit no rule with a literal. Null keys and
    repeated rows are kept, row for row; an empty table gives an empty table; other columns are left out.
    """
    spark = pages.sparkSession
    ordered = sorted(rules, key=lambda r: (r.weight, [-ord(c) for c in r.name]))
    ranked = list(enumerate(ordered))  # the highest rank decides
    # salted by the input partition, so that no count exceeds a partition's rows
    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u"), F.spark_partition_id().alias("p")).groupBy("k", "u", "p").agg(F.count("*").cast("int").alias("n"))
    target = F.concat(host_of(F.col("u")), F.coalesce(F.regexp_extract(_after_scheme(F.col("u")), "^[^/?#]*([\\s\\S]*)", 1), F.lit("")))
    lowered = F.translate(target, UPPER, LOWER)
    tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))
    literals = sorted({x for r in ordered for x in r.literals})
    counts = {}
    if literals:
        asked = _rows(spark, [(x,) for x in literals], ("t",), ("string",))
        asked = F.broadcast(asked) if len(literals) <= BROADCAST_RULES else asked
        # every row's tokens count; at most a row for each literal comes back
        counts = {r.t: r.c for r in pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{url}`"), F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))).alias("t")).join(asked, "t").groupBy("t").agg(F.count("*").alias("c")).collect()}
    rarest = [(min(r.literals, key=lambda x: (counts.get(x, 0), x)), rank, r.pattern, r.listed) for rank, r in ranked if r.literals]
    index = _rows(spark, rarest, ("t", "rank", "pattern", "listed"), ("string", "int", "string", "boolean"))
    index = F.broadcast(index) if len(rarest) <= BROADCAST_RULES else index
    found = rows.withColumn("target", target).withColumn("lowered", lowered).withColumn("t", F.explode_outer(tokens)).join(index, "t", "left")
    # a listed rule's path keeps its case
    hit = F.when(F.regexp_like(F.when(F.col("listed"), F.col("target")).otherwise(F.col("lowered")), F.col("pattern")), F.col("rank"))
    always = F.greatest(F.lit(-1), F.lit(-1), *[F.when((F.col("target") if r.listed else F.col("lowered")).rlike(r.pattern), rank).otherwise(-1) for rank, r in ranked if not r.literals])
    best = found.groupBy("k", "u", "p").agg(F.max("n").alias("n"), F.max(F.greatest(F.coalesce(hit, F.lit(-1)), always)).alias("rank"))
    names = _rows(spark, [(rank, r.name, r.verdict, r.listed) for rank, r in ranked], ("rank", "name", "v", "listed"), ("int", "string", "string", "boolean"))
    names = F.broadcast(names) if len(ranked) <= BROADCAST_RULES else names
    out = best.join(names, "rank", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(
        F.col("k").alias(key), F.col("u").alias(url), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"),
        F.when(F.col("listed"), F.col("name")).alias("rule"), F.coalesce(F.col("v"), F.lit(default)).alias("verdict"), F.col("name").alias("matched"),
    )
