"""Structured Streaming over fact tables: reading commits as they arrive, appending them, and keeping the latest state.

Valid times may arrive in any order and nothing is ever late, so there are no watermarks: what counts as seen is the
commit number, a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factloom.schema import FACTS, KEY, conform, validated


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the facts in Parquet files that appear under ``path``."""
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def append_stream(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of facts to the table under ``path``; invalid ones stop it. A batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        validated(conform(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(facts: DataFrame) -> DataFrame:
    """A stream of changes: of each chain that new facts arrive for its last event by valid time, then commit, with all of its
    columns. The state is one event for each chain; deletions stay in it, so that late facts don't bring a chain back."""
    rest = [c for c in facts.columns if c not in KEY]
    last = facts.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("valid_from", "commit_seq")).alias("_w"))
    return last.select(*KEY, "_w.*")


def since(facts: DataFrame, commit_seq: int) -> DataFrame:
    """Facts of commits after ``commit_seq``, for readers that poll."""
    return facts.where(F.col("commit_seq") > commit_seq)
