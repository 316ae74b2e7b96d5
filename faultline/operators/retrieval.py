"""Hybrid retrieval: a lexical and a dense ranking, fused by reciprocal ranks.

Queries are a stated set that grows with the items. The dense leg asks an inverted-file index of vectors,
exactly; the lexical leg asks a positional index, and trigrams of exceptions where that has nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..sources.shared import Scratch
from . import lexical_index
from .relational import top_k
from .vector_index import build_index, search

LEG = 50
RRF_K = 60
LEAST_TRIGRAM = 0.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_leg(queries: DataFrame, items: DataFrame, k: int = LEG) -> DataFrame:
    """(query_id, item_id, cosine, dense_rank): the k nearest other items of the query's project, exactly."""
    return search(build_index(items.select("project_id", "item_id", "emb")), queries, k)


def lexical_hits(queries: DataFrame, items: DataFrame, k: int = LEG) -> DataFrame:
    """(query_id, item_id, lex_score): the k best rows of the query's project that hold what its web query asks for, by cover
    density over four weighted fields. A row's status codes are words of its message."""
    codes = F.transform("status_codes", lambda c: F.concat(F.lit("HTTP_"), c.cast("string")))
    rows = items.select("project_id", "item_id", "exc_text", F.concat_ws(" ", "msg_text", codes).alias("msg_text"), "frames_text", "tmpl_text")
    return lexical_index.search(lexical_index.build_index(rows), queries.select("query_id", "project_id", "terms"), k).drop("sparse_rank")


def _near_texts(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, asked, exc_text, lex_score): like exception texts by trigrams. Distinct texts of a project meet over a shared
    trigram, so an exception that very many items have is one row there."""
    texts = lambda df: df.where("exc_text <> ''").select("project_id", "exc_text").distinct().withColumn("t", trigrams(F.col("exc_text")))
    exploded = lambda df: df.select("project_id", "exc_text", F.size("t").alias("n"), F.explode("t").alias("t"))
    a = exploded(texts(queries)).select("project_id", F.col("exc_text").alias("asked"), F.col("n").alias("n_asked"), "t")
    both = a.join(exploded(texts(items)), ["project_id", "t"]).groupBy("project_id", "asked", "n_asked", "exc_text", "n").agg(F.count("*").alias("both"))
    return both.withColumn("lex_score", F.round(F.col("both") / (F.col("n_asked") + F.col("n") - F.col("both")), 6)).where(F.col("lex_score") >= LEAST_TRIGRAM).select("project_id", "asked", "exc_text", "lex_score")


def trigram_hits(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id, lex_score) of all items with a like exception text."""
    asked = queries.select("query_id", "project_id", F.col("exc_text").alias("asked")).join(_near_texts(queries, items), ["project_id", "asked"])
    return asked.join(items.select("project_id", "item_id", "exc_text"), ["project_id", "exc_text"]).where("query_id <> item_id").select("query_id", "item_id", "lex_score")


def trigram_best(queries: DataFrame, items: DataFrame, k: int = LEG) -> DataFrame:
    """Of ``trigram_hits`` at least the k best of each query, equal scores by descending item. A text's items have one score, so its
    k + 1 greatest, of which the query may be one, are enough, and of those the k + 1 best of each text that is asked: a query
    meets no more however many items share its exception."""
    near = _near_texts(queries, items)
    heads = _first(items.where("exc_text <> ''").select("project_id", "exc_text", "item_id"), ["project_id", "exc_text"], [F.desc("item_id")], k + 1)
    best = _first(near.join(heads, ["project_id", "exc_text"]), ["project_id", "asked"], [F.desc("lex_score"), F.desc("item_id")], k + 1)
    asked = queries.select("query_id", "project_id", F.col("exc_text").alias("asked")).join(best, ["project_id", "asked"])
    return asked.where("query_id <> item_id").select("query_id", "item_id", "lex_score")


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The rows of each key that hold one of its k first values of ``order``; repeated rows are all there."""
    return rows.withColumn("first", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("first") <= k).drop("first")


def sparse_leg(queries: DataFrame, items: DataFrame, k: int = LEG) -> DataFrame:
    """(query_id, item_id, lex_score, sparse_rank): the lexical hits, or for queries without any those by trigrams."""
    hits = Scratch(queries.sparkSession, "lexical").write(lexical_hits(queries, items, k), "hits")
    rest = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return top_k(hits.union(trigram_best(rest, items, k)), ["query_id"], [F.desc("lex_score"), F.desc("item_id")], k, "sparse_rank")


def fuse(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    both = sparse.join(dense, ["query_id", "item_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf_score", F.round(part("sparse_rank") + part("dense_rank"), 9))
