"""Fact tables as Parquet: partitioned by family and property, sorted by chain inside, with a bloom filter on the entity."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from factloom.errors import InvalidArgument
from factloom.schema import FACTS, canonical_order, conform


def write_facts(facts: DataFrame, path: str, partitions: int | None = None, codec: str = "zstd", mode: str = "errorifexists", bloom: bool = True) -> None:
    """Writes ``facts``; chains are kept together, so that later reads by entity prune row groups and pages."""
    rows = conform(facts)
    dealt = rows.repartitionByRange(partitions, "fact_family", "property_id", "part_id", "entity_id") if partitions else rows
    writer = dealt.sortWithinPartitions("fact_family", "property_id", *canonical_order()).write.mode(mode).option("compression", codec)
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#entity_id", "true")
    writer.partitionBy("fact_family", "property_id").parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """Where tables can be written that all executors read: ``spark.checkpoint.dir``; without it a temporary folder, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise InvalidArgument("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="factloom-")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The fact table under ``path``."""
    return conform(spark.read.schema(FACTS).parquet(path))


def changes(facts: DataFrame, after: int, to: int | None = None) -> DataFrame:
    """The change feed: one row for each commit in (after, to], with the facts that it wrote, in canonical order."""
    from pyspark.sql import functions as F

    rows = facts.where(F.col("commit_seq") > after)
    if to is not None:
        rows = rows.where(F.col("commit_seq") <= to)
    keys = F.struct("part_id", "fact_family", "property_id", "entity_id", (-F.col("valid_from")).alias("newest_first"), "operation")
    return rows.groupBy("commit_seq").agg(F.count("*").alias("n_facts"), F.array_sort(F.collect_list(keys)).alias("facts"))
