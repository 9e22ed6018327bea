"""Retention: what a vacuum keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.schema import KEY


def survivors(facts: DataFrame, boundary: int) -> DataFrame:
    """All events after commit ``boundary``, and of each chain and valid time the last one up to it, deletions included.

    Every state seen from ``boundary`` or later stays the same.
    """
    by = [*KEY, "valid_from"]
    rest = [c for c in facts.columns if c not in by]
    old = facts.where(F.col("commit_seq") <= boundary).groupBy(*by).agg(F.max_by(F.struct(*rest), "commit_seq").alias("_w"))
    base = old.select(*(c if c in by else F.col(f"_w.{c}").alias(c) for c in facts.columns))
    return facts.where(F.col("commit_seq") > boundary).unionByName(base)
