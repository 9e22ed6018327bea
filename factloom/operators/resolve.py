"""Bitemporal resolution: which event of a chain holds at a valid time, seen from a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schema import KEY, Operation

TIME = ["valid_from", "commit_seq"]


def seen(facts: DataFrame, commit_seq: int | None) -> DataFrame:
    """The events of commits up to ``commit_seq`` (None: all)."""
    return facts if commit_seq is None else facts.where(F.col("commit_seq") <= commit_seq)


def winners(facts: DataFrame, valid_time: int, commit_seq: int | None = None, key: list[str] | None = None) -> DataFrame:
    """One event of each chain: the latest valid time up to ``valid_time``, of that the latest commit; deletions too.

    The maximum is taken in each task before the shuffle, so a chain of any length arrives as one row for each task.
    """
    key = key or KEY
    rest = [c for c in facts.columns if c not in key]
    early = seen(facts, commit_seq).where(F.col("valid_from") <= valid_time)
    return early.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*TIME)).alias("_w")).select(*(c if c in key else F.col(f"_w.{c}").alias(c) for c in facts.columns))


def resolve(facts: DataFrame, valid_time: int, commit_seq: int | None = None, key: list[str] | None = None) -> DataFrame:
    """The events that hold: winners that aren't deletions. Operations are looked at last, or deleted facts would rise again."""
    return winners(facts, valid_time, commit_seq, key).where(F.col("operation") == int(Operation.PUT))


def boundaries(facts: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """One event for each chain and valid time: that of the latest commit."""
    by = [*KEY, "valid_from"]
    rest = [c for c in facts.columns if c not in by]
    latest = seen(facts, commit_seq).groupBy(*by).agg(F.max_by(F.struct(*rest), "commit_seq").alias("_w"))
    return latest.select(*(c if c in by else F.col(f"_w.{c}").alias(c) for c in facts.columns))


def intervals(facts: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """Boundaries with ``valid_to``: the next boundary of the chain, exclusive; null on the last."""
    by_time = Window.partitionBy(*KEY).orderBy("valid_from")
    return boundaries(facts, commit_seq).withColumn("valid_to", F.lead("valid_from").over(by_time))


def neighborhood(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """For each chain with events: the observed boundary at ``valid_time`` (maybe a deletion), and those strictly before and after."""
    vf = F.col("valid_from")
    early = vf <= valid_time
    at = F.max_by(F.when(early, F.struct("valid_from", "commit_seq", "operation")), F.when(early, F.struct(*TIME)))
    grouped = seen(facts, commit_seq).groupBy(*KEY).agg(at.alias("_at"), F.max(F.when(vf < valid_time, vf)).alias("predecessor"), F.min(F.when(vf > valid_time, vf)).alias("successor"))
    return grouped.select(*KEY, F.col("_at.valid_from").alias("observed"), F.col("_at.commit_seq").alias("observed_commit"), F.col("_at.operation").alias("observed_operation"), "predecessor", "successor")


def as_of_join(probes: DataFrame, facts: DataFrame, time: str = "valid_time", commit_seq: int | None = None, buckets: int = 1) -> DataFrame:
    """Each probe (the chain's key columns and ``time``) with the event that holds at its own time, as columns ``f_...``; outer.

    Probes and boundaries meet in one sorted pass over each chain: no range join, no pairs. ``buckets`` above one cuts the
    time axis of every chain into as many equal parts, so that one long chain is worked on by several tasks; each part
    starts from the last boundary before it.
    """
    edges = boundaries(facts, commit_seq)
    rest = [c for c in facts.columns if c not in KEY]
    names = [c for c in probes.columns if c not in KEY]
    low, high = edges.agg(F.min("valid_from"), F.max("valid_from")).first() if buckets > 1 else (0, 0)
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    part = lambda c: F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col(c) - (low or 0)) / width)))
    event = edges.select(*KEY, F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_f"), F.lit(None).cast(probes.select(F.struct(*names)).schema[0].dataType).alias("_p"), part("valid_from").alias("_b"))
    if buckets > 1:
        # The last boundary of each part opens all later parts up to the next one that has its own.
        last = event.groupBy(*KEY, "_b").agg(F.max_by(F.struct("_t", "_f"), "_t").alias("_e"))
        following = Window.partitionBy(*KEY).orderBy("_b")
        spread = last.withColumn("_n", F.coalesce(F.lead("_b").over(following), F.lit(buckets - 1))).where("_n > _b").select(*KEY, "_e", F.explode(F.sequence(F.col("_b") + 1, F.col("_n"))).alias("_b"))
        event = event.unionByName(spread.select(*KEY, F.col("_e._t").alias("_t"), F.lit(0).alias("_kind"), F.col("_e._f").alias("_f"), F.lit(None).cast(event.schema["_p"].dataType).alias("_p"), "_b"))
    asked = probes.select(*KEY, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(event.schema["_f"].dataType).alias("_f"), F.struct(*names).alias("_p"), part(time).alias("_b"))
    so_far = Window.partitionBy(*KEY, "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = event.unionByName(asked).withColumn("_f", F.last("_f", ignorenulls=True).over(so_far)).where("_kind = 1")
    live = F.when(F.col("_f.operation") == int(Operation.PUT), F.col("_f"))
    return met.withColumn("_f", live).select(*KEY, *(F.col(f"_p.{c}").alias(c) for c in names), *(F.col(f"_f.{c}").alias(f"f_{c}") for c in rest))


def lane(value_type: int) -> Column:
    """The value column of a type; strings as strings."""
    from factloom.schema import LANES, ValueType

    column = F.col(LANES[ValueType(value_type)][0])
    return column.cast("string") if value_type == ValueType.STRING else column
