"""Validation of optimistic transactions, as joins between what was staged or read and what was committed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.resolve import boundaries
from factloom.schema import KEY


def capture(requests: DataFrame, facts: DataFrame, commit_seq: int | None = None, time: str = "valid_from") -> DataFrame:
    """``requests`` (the key and ``time``) with observed, observed_commit, predecessor and successor of their chains at ``time``.

    Boundaries and requests meet in sorted passes over each chain, one up and one down: no request is paired with the events
    of its chain. Chains that nobody asks for are dropped before.
    """
    asked = requests.select(*KEY).distinct()
    events = boundaries(facts.join(asked, KEY, "left_semi").select(*KEY, "valid_from", "commit_seq"), commit_seq)
    names = [c for c in requests.columns if c not in KEY]
    row = F.struct(*names)
    both = events.select(*KEY, F.col("valid_from").alias("_t"), F.struct(F.col("valid_from").alias("vf"), F.col("commit_seq").alias("cs")).alias("_e"), F.lit(None).cast(requests.select(row).schema[0].dataType).alias("_r"))
    both = both.unionByName(requests.select(*KEY, F.col(time).alias("_t"), F.lit(None).cast("struct<vf:bigint,cs:bigint>").alias("_e"), row.alias("_r")))
    up, down = Window.partitionBy(*KEY).orderBy("_t"), Window.partitionBy(*KEY).orderBy(F.desc("_t"))
    here = F.max("_e").over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max("_e.vf").over(up.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("_e.vf").over(down.rangeBetween(Window.unboundedPreceding, -1))
    met = both.withColumns({"_at": here, "predecessor": before}).withColumn("successor", after).where("_r IS NOT NULL")
    return met.select(*(F.col(c) if c in KEY else F.col(f"_r.{c}").alias(c) for c in requests.columns), F.col("_at.vf").alias("observed"), F.col("_at.cs").alias("observed_commit"), "predecessor", "successor")


def write_conflicts(staged: DataFrame, facts: DataFrame) -> DataFrame:
    """Staged writes (key, valid_from, snapshot_seq, predecessor, successor) that a later commit touches.

    A conflict is an event after the snapshot, on the same chain, from the predecessor (inclusive) up to the successor
    (exclusive); an end that isn't there is open. That a correction exactly at the predecessor counts is this library's
    reading of "half-open".

    Later events are first counted by the gap between the snapshot's boundaries into which they fall, in one sorted pass over
    each chain. A staged range is one gap, or two if it is at a boundary: so writes and gaps meet by equality.
    """
    views = staged.select(*KEY, "snapshot_seq").distinct()
    events = facts.select(*KEY, F.col("valid_from").alias("_vf"), F.col("commit_seq").alias("_cs")).join(views, KEY)
    old = F.col("_cs") <= F.col("snapshot_seq")
    chain = [*KEY, "snapshot_seq"]
    so_far = Window.partitionBy(*chain).orderBy("_vf").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = events.withColumn("_gap", F.max(F.when(old, F.col("_vf"))).over(so_far)).where(~old)
    gaps = later.groupBy(*chain, "_gap").agg(F.min("_cs").alias("_first"), F.count("*").alias("_n"))
    starts = F.array_distinct(F.array("predecessor", "valid_from"))
    asked = staged.select(*chain, "valid_from", F.explode(starts).alias("_gap"))
    left, right = asked.alias("a"), gaps.alias("g")
    on = F.col("a._gap").eqNullSafe(F.col("g._gap"))
    for c in chain:
        on = on & (F.col(f"a.{c}") == F.col(f"g.{c}"))
    hit = left.join(right, on).select(*(F.col(f"a.{c}").alias(c) for c in [*chain, "valid_from"]), "_first", "_n")
    return hit.groupBy(*KEY, "valid_from", "snapshot_seq").agg(F.min("_first").alias("first_conflict"), F.sum("_n").alias("events"))


def strict_conflicts(reads: DataFrame, facts: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """Reads (key, valid_time, and what capture() saw) whose observed event or neighbours are others at ``commit_seq``."""
    kept = ["observed", "observed_commit", "predecessor", "successor"]
    renamed = reads.select(*KEY, "valid_time", *(F.col(c).alias(f"was_{c}") for c in kept))
    now = capture(renamed, facts, commit_seq, time="valid_time")
    changed = F.lit(False)
    for c in kept:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return now.where(changed)


def footprints(staged: DataFrame, buckets: int = 16) -> DataFrame:
    """Of each transaction: chains, how many it writes (at any valid time), shared, how many of them an earlier transaction
    writes too, and after, the last such transaction: it can't share a commit group with it. ``staged``: txn_id and key.

    Neighbours on a chain are looked at, not pairs. The transactions of a chain are dealt into ``buckets`` of their order, so
    that one that very many write isn't one task's work.
    """
    keys = staged.select("txn_id", *KEY).distinct()
    low, high = keys.agg(F.min("txn_id"), F.max("txn_id")).first()
    width = ((high or 0) - (low or 0)) // buckets + 1
    dealt = keys.withColumn("_b", F.floor((F.col("txn_id") - (low or 0)) / width))
    inside = dealt.withColumn("_before", F.lag("txn_id").over(Window.partitionBy(*KEY, "_b").orderBy("txn_id")))
    last = dealt.groupBy(*KEY, "_b").agg(F.max("txn_id").alias("_last"))
    earlier = last.select(*KEY, "_b", F.lag("_last").over(Window.partitionBy(*KEY).orderBy("_b")).alias("_earlier"))
    met = inside.join(earlier, [*KEY, "_b"]).withColumn("_before", F.coalesce("_before", "_earlier"))
    return met.groupBy("txn_id").agg(F.count("*").alias("chains"), F.count("_before").alias("shared"), F.max("_before").alias("after"))


def blind_appends(staged: DataFrame) -> DataFrame:
    """Transactions that need no validation: only PUTs, no identities, no strict reads, no neighbours.

    ``staged``: txn_id, fact_family, operation, predecessor, successor, strict.
    """
    plain = (F.col("operation") == 1) & (F.col("fact_family") != 3) & ~F.col("strict") & F.col("predecessor").isNull() & F.col("successor").isNull()
    return staged.groupBy("txn_id").agg(F.bool_and(plain).alias("blind"))
