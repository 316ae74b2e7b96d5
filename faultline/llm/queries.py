"""The queries of the operators, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .conversation_repair import digests, repair_conversations
from .embedding_dedup import embedding_dedup
from .license_scan import license_scan
from .line_dedup import NULL_ID, line_dedup
from .mixing import mix_sources
from .ngram_join import ngram_join
from .oracle import CONVERSATION_REPAIR, LINE_DEDUP, RANKED_SEARCH, WARC, quality_rules_sql, url_filters_sql
from .packing import pack
from .quality_rules import quality_rules
from .ranked_search import build_index, ranked_search
from .secret_scan import secret_scan
from .storage import Workspace, columns
from .suffix_dedup import suffix_dedup
from .url_filters import PATTERN_RULES, host_rule, url_filters
from .warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")
    return judged.select("doc_id", "quality").select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), 400, 50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words", (F.col("n_passage_words") > 0).alias("has_repeated_passage"))


#: The host rules of the URL query.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(v, r) for v, r in HOST_RULES] + list(PATTERN_RULES)
    return url_filters(columns(table(spark, sf_dir, "pages"), "page_id", "url"), rules).drop("url", "matched")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), Fraction(85, 100), 4)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[F.col(f"license.{n}").alias(n) for n in names])


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    sha = F.sha2(F.encode(F.col("secrets.base"), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *[F.col(f"secrets.{n}").alias(n) for n in ("n_assign", "n_access", "n_hex")], sha, F.col("secrets.spans").alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_sources(columns(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").path + "/archives"
    write_archives(columns(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of the rows, by the hash of their place; nulls become one space."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, how = F.coalesce("text", F.lit(" ")), F.crc32(place) % 20
    rows = conversations.select("conv_id", "turn", how.alias("how"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "how", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("how") == 3, 1).otherwise(0)))).select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(conversations))
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv")).distinct()
    rows = every.join(found.summary, "conv", "left").join(digests(found.pieces), "conv", "left")
    numbers = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv = F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id")
    return rows.select(conv, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return ranked_search(index, columns(table(spark, sf_dir, "benchmark"), "item_id", "text"), 50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_suffix_dedup, op3_url_filters, op4_ngram_join, op5_line_dedup, op6_license_scan, op7_embedding_dedup, op8_secret_scan, op9_mixing, op10_packing,
        op11_warc, op12_conversation_repair, op13_ranked_search,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules_sql(), "op3_url_filters": url_filters_sql(HOST_RULES), "op5_line_dedup": LINE_DEDUP,
    "op11_warc": WARC, "op12_conversation_repair": CONVERSATION_REPAIR, "op13_ranked_search": RANKED_SEARCH,
}
