"""Lookups beyond one chain: exact keys, several ranges, values, age, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.errors import InvalidArgument
from factloom.operators.scan import Range, ScanSpec, event_scan
from factloom.schema import KEY

EXACT = [*KEY, "valid_from", "commit_seq"]


def exact_facts(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """The facts of the given full keys: chain, valid time and commit."""
    return facts.join(keys.select(*EXACT).distinct(), EXACT, "left_semi")


def multi_range_scan(facts: DataFrame, spec: ScanSpec, ranges: list[Range], commit_seq: int | None = None) -> DataFrame:
    """Events of entities in any of the inclusive ranges: one scan with a disjunction, which prunes like a single range."""
    if not ranges or any(low is None or high is None or low > high for low, high in ranges):
        raise InvalidArgument("ranges have two ends in order")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("entity_id").between(low, high)
    return event_scan(facts.where(inside), spec, commit_seq)


def entities_by_value(state: DataFrame, lane: str, low, high) -> DataFrame:
    """part_id, entity_id of resolved facts whose value lies in the inclusive range: a secondary lookup, after resolution."""
    return state.where(F.col(lane).between(low, high)).select("part_id", "entity_id")


def unexpired(facts: DataFrame, now: int, ttl: int) -> DataFrame:
    """Facts whose valid time is at most ``ttl`` before ``now``; zero or less keeps all."""
    return facts if ttl <= 0 else facts.where(F.col("valid_from") > now - ttl)


def without_empty_values(facts: DataFrame) -> DataFrame:
    """Facts but those that hold an empty string or binary."""
    return facts.where(F.col("bytes_value").isNull() | (F.length("bytes_value") > 0))


def nearest(vectors: DataFrame, probe: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of least squared distance to ``probe``, ties to the smaller key; every task keeps k."""
    if k <= 0:
        raise InvalidArgument("k is one at least")
    pairs = F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in probe)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    distance = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return vectors.where(F.size(vector) == len(probe)).select(key, distance.alias("distance")).orderBy("distance", key).limit(k)
