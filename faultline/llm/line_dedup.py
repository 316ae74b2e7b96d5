"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded as (hash, document) and counted by hash with partial aggregation, so a line that a third of all documents
hold is one row a task. The duplicated hashes are a written table, joined to the exploded lines (a skewed side is split by
adaptive execution). Only the positions to drop travel back; texts move once, to be reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import ascii_lower, let, strip
from .storage import Workspace

#: What a null id counts as: the least id.
NULL_ID = -(2**63)


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text without its dropped lines, and the columns n_lines and n_dropped (long).

    A line's key is the line stripped of white space and with A-Z lowered. A key of at least ``min_chars`` code points that at
    least ``min_docs`` documents hold loses all its lines except in the smallest id that holds it. A null or empty text is one
    empty line and becomes an empty text. A null id counts as the least id. Repeated rows are one document: both keep or lose
    the same lines. An empty table gives an empty table. Columns named n_lines or n_dropped are replaced.
    """
    space = Workspace(docs.sparkSession, "line-dedup")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = [F.coalesce(F.col(f"`{key}`"), F.lit(NULL_ID)).alias("id"), F.xxhash64(whole).alias("text_hash")]

    def exploded() -> DataFrame:
        lines = docs.select(*ident, F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
        lines = lines.select("id", "text_hash", "pos", ascii_lower(strip(F.col("line"))).alias("line")).where(F.char_length("line") >= min_chars)
        # two hashes of 64 bits that start from different seeds
        return lines.select("id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))

    if min_docs <= 2:
        held = exploded().groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("other"))
        shared = held.where(F.col("keeper") < F.col("other")) if min_docs == 2 else held
    else:
        shared = exploded().select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = space.write(shared.select("h1", "h2", "keeper"), "shared")
    drops = exploded().join(shared, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
    drops = space.write(drops.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop")), "drops")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *ident).join(drops, ["id", "text_hash"], "left")
    lines = F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n")
    rows = rows.select("row", "drop", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).otherwise(_without(lines, F.col("drop"))).alias("kept"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def _without(lines, drop):
    return let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: x[i]), "\n"))
