"""From raw documents to packed training sequences: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialize, table
from factloom.llm.forest import class_heads, text_key
from factloom.llm.mixing import label_domains, mix
from factloom.llm.packing import pack
from factloom.llm.quality import classify
from factloom.llm.queries import tokenizer_path
from factloom.llm.secrets import redact, scan_secrets

#: Low quality has gone before the mixing, so it has no share there.
TARGETS = {"clean": 0.99, "toxic": 0.01}


def whole(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, if they are there, and each row as it is in ``document``: columns of any name pass."""
    return docs.select(*(c for c in needed if c in docs.columns), F.struct(*docs.columns).alias("document"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    scored = classify(whole(docs, "doc_id", "text", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"), keep=["document"])
    return scored.where("is_quality").select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id. Rows without an id stay; of repeated rows one stays,
    and different texts under one id are told apart."""
    heads = class_heads(docs)
    keyed = whole(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("t", text_key(F.col("text"))).drop("text")
    kept = keyed.join(heads, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    return kept.select("document.*").unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars, where it is there, follows the new text."""
    found = scan_secrets(whole(docs, "text"), keep=["document"])
    text = redact(F.col("document.text"), F.col("secret_spans"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("secret_spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars"))
    return found.select(*(new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to their rates: below one by a hash of id and text, from one on for certain, and each once.

    So the share of toxic text comes down to about its target, and what is clean stays: its rate is one or more.
    """
    mixed, _ = mix(whole(docs, "doc_id", "text"), label_domains(table(spark, sf_dir, "labels")), TARGETS, keep=["document"])
    chance = F.pmod(F.xxhash64(F.lit("mix"), "document.doc_id", "document.text"), F.lit(1_000_000)) / 1_000_000
    return mixed.where(chance < F.col("rate")).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]


#: Each stage takes any columns besides doc_id and text (lang, source and n_chars are used where they are there), nulls in all
#: of them, empty and very long texts, ties, repeated rows and empty tables; all but the last return the columns they got.
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs


#: Classifiers, min-hashes and least squares have no SQL; the tests hold what each stage does against plain Python.
ORACLE_SQL: str | None = None
