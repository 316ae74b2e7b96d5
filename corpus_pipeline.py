"""A training corpus from raw documents: clean, deduplicate, mix and pack."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.line_dedup import line_dedup
from faultline.llm.mixing import mixed
from faultline.llm.ngram_join import ngram_join
from faultline.llm.packing import pack
from faultline.llm.quality_rules import quality_rules
from faultline.llm.storage import Workspace, workspaces
from faultline.shipping import ship

#: Packing needs a tokenizer, which SQL can't express.
ORACLE_SQL = None


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars again the length of the text."""
    count = lambda c: F.length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema[c].dataType).alias(c)
    return df.select(*[count(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _held(docs: DataFrame) -> DataFrame:
    """Id and text, with the rest of the row in a struct, so that no column of it can clash with one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("pipeline_row"))


def _let_go(df: DataFrame, text: Column, docs: DataFrame) -> DataFrame:
    """The rows held, with another text."""
    return _as_documents(df.select(*[text.alias(c) if c == "text" else F.col(f"pipeline_row.`{c}`").alias(c) for c in docs.columns]), docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and documents that the quality rules reject. A null or empty text is rejected; repeated rows and null
    ids are judged row by row; an empty table gives an empty table; other columns pass through."""
    return _let_go(quality_rules(_held(docs)).where("quality.kept"), F.col("quality.clean_text"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds, and documents that lose all their words by it.

    A null text is an empty one, which loses nothing and stays. Repeated rows are one document to the line dedup and stay both. A
    null id counts as the least. An empty table gives an empty table; other columns pass through.
    """
    kept = line_dedup(_held(docs))
    return _let_go(kept.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]")), F.col("text"), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8): that of the least id, a null one being the least.

    Every row is a document of its own here, whatever its id: repeated rows are near duplicates, and rows of a null id needn't be.
    A text without words is like no other and stays, each row of it.
    """
    ship(spark)
    row = "row"
    while row in map(str.lower, docs.columns):
        row += "_"
    # written, so that all later reads see the same numbers
    space = Workspace(spark, "pipeline-rows")
    numbered = space.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with workspaces() as made:
        groups = ngram_join(numbered, Fraction(4, 5), 5, key=row).select(row, "component_id")
        ids = numbered.select(row, F.col("doc_id").alias("id"))
        # structs compare a null as the least
        kept = ids.join(groups, row).groupBy("component_id").agg(F.min(F.struct("id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
        kept = space.write(kept, "kept")
    for w in made:  # the rows to keep are written; the join's tables needn't stand beside the result
        w.remove()
    return _as_documents(numbered.join(kept, row, "left_semi"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source's words come to its target. A null source is one of its own, a document
    without words is taken once, repeated rows count each for itself; an empty table gives an empty table; all columns are kept."""
    ship(spark)
    return _as_documents(mixed(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens. A null text is its end token alone; null ids and repeated rows
    are packed each for itself; an empty table gives an empty table; columns but the id are left out."""
    ship(spark)
    return pack(docs)


STAGES = [("quality_rules", clean_lines), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("mixing", mix), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote on its way goes when its result is written."""
    space = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with workspaces() as made:
            docs = space.write(stage(spark, docs, sf_dir), name)
        for w in made:
            w.remove()
        if before:
            space.remove(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
