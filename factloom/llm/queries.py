"""The queries that apply this subpackage's operators to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.fingerprint import compare_with_edits
from factloom.llm.forest import near_duplicates
from factloom.llm.html import extract_main_text
from factloom.llm.mixing import label_domains, mix
from factloom.llm.packing import pack
from factloom.llm.passages import repeated_passages
from factloom.llm.quality import classify
from factloom.llm.secrets import described, scan_secrets
from factloom.llm.suffix import remove_repeats
from factloom.llm.topk import exact_topk

TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}


def tokenizer_path() -> str:
    """Where the word tokenizer's file lies, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", "quality_text", "quality_meta", "quality_score", F.col("is_quality").cast("int").alias("is_quality"))


def op2_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(described(base), 256).alias("base_sha256"), described(F.col("secret_spans")).alias("spans"))


def op5_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS, keep=["doc_id"])
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return mixed.select("doc_id", "tokens", *shares, "rate")


def op7_bwt_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_co_training_quality, op2_wrapper_extraction, op3_multiset_fingerprints, op4_secret_scan, op5_segment_topk, op6_soft_mixing, op7_bwt_suffix_dedup, op8_compact_windows, op9_nnls_packing, op10_lsh_forest_join)}
ORACLE: dict[str, str] = {"op5_segment_topk": OP5_SQL}
