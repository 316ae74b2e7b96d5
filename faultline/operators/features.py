"""The features of a decision: one row of 64 numbers for each query, from its ranked candidates and what is known of its item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import identifiers, same_set, tokens
from ..functions.labels import base_group, clamp01, decay
from ..functions.text import jaccard

BASES = ("pb", "ab", "si", "nd")
# The levels of the two categories that a text model may know of an item.
FAILING_LAYERS = ("unknown", "test_code", "app_code", "infrastructure", "environment")
ERROR_CLASSES = (
    "unknown", "assertion", "timeout", "connection", "http_4xx", "http_5xx", "null_reference", "not_found", "permission", "data_format", "resource_exhausted", "config",
    "concurrency", "other",
)
# The features in order with their defaults.
FEATURES: dict[str, float] = {
    "top1_cosine": 0.0, "top1_rrf": 0.0, "top1_jaccard": 0.0, "margin_cos": 0.0, "mean_top5_cosine": 0.0, "n_candidates": 0.0, "label_hist_entropy": 1.0, "top1_label_frac": 0.0,
    "same_test_case_top1": 0.0, "same_error_hash_top1": 0.0, "same_exception_fp_top1": 0.0, "recency_top1": 0.0, "src_weight_top1": 0.0, "hist_pb": 0.0, "hist_ab": 0.0, "hist_si": 0.0, "hist_nd": 0.0,
    "kb_top1_score": 0.0, "kb_purity": 0.0, "kb_support": 0.0, "kb_same_fp": 0.0, "kb_prior_conf": 0.0, "seed_pb": 0.0, "seed_ab": 0.0, "seed_si": 0.0, "seed_nd": 0.0,
    "flakiness_score": 0.5, "test_fail_rate_30d": 0.5, "flips_30d": 0.0, "co_failure_group_size": 0.0, "group_dominance": 0.0, "launch_fail_fraction": 0.0, "si_prior": 0.0, "test_age_days": 0.0,
    "item_log_count": 0.0, "has_stacktrace": 0.0, "is_assertion": 0.0, "is_merged_small_logs": 0.0, "exception_count": 0.0, "status_codes_present": 0.0, "status_codes_match_top1": 0.0,
    "identifier_jaccard_top1": 0.0, "hash_gate_blocked": 0.0, "identifiers_present": 0.0, "ident_jaccard_source": 0.0,
    **{f"llm_failing_layer_{x}": float(x == "unknown") for x in FAILING_LAYERS}, **{f"llm_error_class_{x}": float(x == "unknown") for x in ERROR_CLASSES},
}
_SOURCES = {"rp": 1.0, "human": 0.9, "ai_suggested": 0.3, "seed": 0.6}


def candidate_source_weight(source: Column) -> Column:
    out = F.lit(0.3)
    for name, weight in _SOURCES.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _log_share(n: Column, most: float) -> Column:
    return clamp01(F.log1p(F.greatest(F.lit(0.0), n.cast("double"))) / F.log1p(F.lit(most)))


def of_candidates(candidates: DataFrame) -> DataFrame:
    """The features of each query's candidates (query_id, place from 1, cosine, rrf_score, jaccard_templates, issue_type,
    label_source, age_days, same_test_case, same_error_hash, same_exception_fp, msg_text). A query has few, so all is one
    aggregate."""
    cos = F.coalesce("cosine", F.lit(0.0))
    c = candidates.withColumn("cos", cos).withColumn("base", base_group(F.col("issue_type"))).withColumn("age", F.coalesce("age_days", F.lit(0.0)))
    c = c.withColumn("weight", F.greatest(F.lit(0.0), F.col("cos")) * decay(F.col("age")) * candidate_source_weight(F.col("label_source")))
    first = lambda x: F.max(F.when(F.col("place") == 1, x))
    counts = [F.count_if(F.col("base") == b).alias(f"n_{b}") for b in BASES]
    masses = [F.sum(F.when(F.col("base") == b, F.col("weight")).otherwise(0.0)).alias(f"m_{b}") for b in BASES]
    a = c.groupBy("query_id").agg(
        F.count("*").alias("n"), first(F.col("cos")).alias("cos1"), F.max(F.when(F.col("place") == 2, F.col("cos"))).alias("cos2"), first(F.col("rrf_score")).alias("rrf1"), first(F.col("jaccard_templates")).alias("jac1"),
        F.sum(F.when(F.col("place") <= 5, F.col("cos"))).alias("cos5"), first(F.col("base")).alias("base1"), first(F.col("age")).alias("age1"), first(candidate_source_weight(F.col("label_source"))).alias("src1"),
        *[first(_flag(F.col(f"same_{x}"))).alias(f"same_{x}") for x in ("test_case", "error_hash", "exception_fp")], first(F.col("msg_text")).alias("msg1"), F.sum("weight").alias("mass"), *counts, *masses,
    )
    labelled = sum((F.col(f"n_{b}") for b in BASES[1:]), F.col("n_pb"))
    part = lambda b: F.col(f"n_{b}") / labelled
    entropy = sum((F.when(F.col(f"n_{b}") > 0, -part(b) * F.log(part(b))).otherwise(0.0) for b in BASES), F.lit(0.0)) / F.log(F.lit(4.0))
    same_label = sum((F.when(F.col("base1") == b, F.col(f"n_{b}")).otherwise(0) for b in BASES), F.lit(0))
    return a.select(
        "query_id", "msg1", clamp01(F.col("cos1")).alias("top1_cosine"), F.greatest(F.lit(0.0), F.col("rrf1")).alias("top1_rrf"), clamp01(F.col("jac1")).alias("top1_jaccard"),
        clamp01(F.col("cos1") - F.coalesce("cos2", F.lit(0.0))).alias("margin_cos"), clamp01(F.col("cos5") / F.least(F.col("n"), F.lit(5))).alias("mean_top5_cosine"), clamp01(F.col("n") / 20.0).alias("n_candidates"),
        F.when(labelled > 0, clamp01(entropy)).otherwise(1.0).alias("label_hist_entropy"), F.when(labelled > 0, clamp01(same_label / labelled)).otherwise(0.0).alias("top1_label_frac"),
        *[F.col(f"same_{x}").alias(f"same_{x}_top1") for x in ("test_case", "error_hash", "exception_fp")], clamp01(decay(F.col("age1"))).alias("recency_top1"), F.col("src1").alias("src_weight_top1"),
        *[F.when(F.col("mass") > 0, clamp01(F.col(f"m_{b}") / F.col("mass"))).otherwise(0.0).alias(f"hist_{b}") for b in BASES],
    )


def features(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, the 64 features) for each row of ``context``: a query with kb_score, kb_purity, kb_support, kb_same_fp,
    seed_label, seed_confidence, flakiness, runs, failures, flips, test_age, group_size, launch_failures, launch_items, si_prior,
    log_count, has_stack, is_assertion, is_merged, n_exceptions, failing_layer, error_class, codes, message, hash_codes,
    hash_message (null where no other item has the hash) and gate_blocked. What is null takes its default."""
    x = context.join(of_candidates(candidates), "query_id", "left")
    ids = identifiers(tokens(F.coalesce("message", F.lit(""))))
    has_hash = F.col("hash_message").isNotNull()
    neighbour = F.when(has_hash, F.col("hash_message")).otherwise(F.col("msg1"))
    other = identifiers(tokens(neighbour))
    codes = F.coalesce(F.size("codes"), F.lit(0)) > 0
    level = lambda c, levels: F.when(F.col(c).isin(*levels), F.col(c)).otherwise("unknown")
    value: dict[str, Column] = {
        "kb_top1_score": clamp01(F.col("kb_score")), "kb_purity": clamp01(F.col("kb_purity")), "kb_support": F.when(F.col("kb_support").isNotNull(), _log_share(F.col("kb_support"), 1000.0)), "kb_same_fp": _flag(F.col("kb_same_fp")),
        "kb_prior_conf": clamp01(F.col("seed_confidence")), **{f"seed_{b}": _flag(base_group(F.col("seed_label")) == b) for b in BASES},
        "flakiness_score": F.when(F.col("flakiness").isNotNull(), clamp01(F.col("flakiness"))), "test_fail_rate_30d": F.when(F.col("runs") > 0, clamp01(F.col("failures") / F.col("runs"))), "flips_30d": _log_share(F.coalesce("flips", F.lit(0)), 20.0),
        "co_failure_group_size": _log_share(F.coalesce("group_size", F.lit(1)), 200.0), "group_dominance": F.when(F.col("launch_failures") > 0, clamp01(F.col("group_size") / F.col("launch_failures"))),
        "launch_fail_fraction": F.when(F.col("launch_items") > 0, clamp01(F.col("launch_failures") / F.col("launch_items"))), "si_prior": F.greatest(F.lit(0.0), F.least(F.lit(0.9), F.coalesce("si_prior", F.lit(0.0)))),
        "test_age_days": F.when(F.col("test_age").isNotNull(), _log_share(F.least(F.col("test_age"), F.lit(365.0)), 365.0)), "item_log_count": clamp01(F.coalesce("log_count", F.lit(0)) / 20.0), "has_stacktrace": _flag(F.col("has_stack")),
        "is_assertion": _flag(F.col("is_assertion")), "is_merged_small_logs": _flag(F.col("is_merged")), "exception_count": F.least(F.coalesce("n_exceptions", F.lit(0)), F.lit(5)) / 5.0,
        "status_codes_present": _flag(codes), "status_codes_match_top1": _flag(has_hash & codes & same_set(F.col("codes"), F.col("hash_codes"))),
        "identifier_jaccard_top1": F.when(neighbour.isNotNull(), clamp01(jaccard(ids, other, 0.0))), "hash_gate_blocked": _flag(F.col("gate_blocked")), "identifiers_present": _flag(F.size(ids) > 0),
        "ident_jaccard_source": F.when(has_hash, 1.0).when(F.col("msg1").isNotNull(), 0.5),
        **{f"llm_failing_layer_{k}": _flag(level("failing_layer", FAILING_LAYERS) == k) for k in FAILING_LAYERS}, **{f"llm_error_class_{k}": _flag(level("error_class", ERROR_CLASSES) == k) for k in ERROR_CLASSES},
    }
    return x.select("query_id", *[F.coalesce(value.get(n, F.col(n) if n in x.columns else F.lit(None)), F.lit(d)).cast("double").alias(n) for n, d in FEATURES.items()])


def vector(names: list[str], defaults: dict[str, float]) -> Column:
    """A model's own list of features as an array; what a row hasn't or a snapshot lacks takes its default, else 0."""
    return F.array(*[F.coalesce(F.col(n), F.lit(defaults.get(n, 0.0))) if n in FEATURES else F.lit(defaults.get(n, 0.0)) for n in names])
