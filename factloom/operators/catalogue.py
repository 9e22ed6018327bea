"""The catalogue of properties: definitions by id and epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_properties(properties: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """Of each property the definition of its greatest epoch; as of a commit, if ``properties`` has commit_seq."""
    rows = properties if commit_seq is None else properties.where(F.col("commit_seq") <= commit_seq)
    rest = [c for c in properties.columns if c != "property_id"]
    return rows.groupBy("property_id").agg(F.max_by(F.struct(*rest), "schema_epoch").alias("_p")).select("property_id", "_p.*")


def lookup_properties(requests: DataFrame, properties: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """``requests`` (property_id, schema_epoch; null: the latest one) with found, name, entity_kind and physical_type."""
    rows = properties if commit_seq is None else properties.where(F.col("commit_seq") <= commit_seq)
    kept = ["name", "entity_kind", "physical_type"]
    latest = latest_properties(rows).select("property_id", F.col("schema_epoch").alias("_latest"))
    asked = requests.join(latest, "property_id", "left").withColumn("_epoch", F.coalesce("schema_epoch", "_latest"))
    known = rows.select("property_id", F.col("schema_epoch").alias("_epoch"), F.lit(True).alias("_there"), *kept)
    return asked.join(known, ["property_id", "_epoch"], "left").select(*requests.columns, F.coalesce("_there", F.lit(False)).alias("found"), *kept)
