"""Scans: the history and the state of one (part, family, property), with inclusive ranges and projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.errors import InvalidArgument, NotSupported
from factloom.operators.resolve import resolve, seen
from factloom.schema import FACTS, canonical_order, check_family

Range = tuple[int | None, int | None]


@dataclass(frozen=True)
class ScanSpec:
    """What to scan. Ranges include both ends; None leaves an end open. ``valid_time`` counts for state scans only."""

    family: int
    property_id: int = 0
    part_id: int = 0
    valid_time: int | None = None
    entity: Range = (None, None)
    valid_from: Range = (None, None)
    commit_seq: Range = (None, None)
    batch_rows: int = 1024

    def check(self) -> None:
        check_family(self.family, self.property_id)
        if self.batch_rows <= 0:
            raise InvalidArgument("a batch has at least one row")
        for name in ("entity", "valid_from", "commit_seq"):
            low, high = getattr(self, name)
            if low is not None and high is not None and low > high:
                raise InvalidArgument(f"{name} range {low} to {high} is inverted")


def within(df: DataFrame, column: str, bounds: Range) -> DataFrame:
    low, high = bounds
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def chain_rows(facts: DataFrame, spec: ScanSpec) -> DataFrame:
    """Rows of the spec's part, family, property and entities: conditions on plain columns, which reach the Parquet scan."""
    rows = facts.where((F.col("part_id") == spec.part_id) & (F.col("fact_family") == spec.family) & (F.col("property_id") == spec.property_id))
    return within(rows, "entity_id", spec.entity)


def event_scan(facts: DataFrame, spec: ScanSpec, commit_seq: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """All events, PUT and DELETE, in the ranges; ``spec.valid_time`` is ignored."""
    spec.check()
    rows = within(within(seen(chain_rows(facts, spec), commit_seq), "valid_from", spec.valid_from), "commit_seq", spec.commit_seq)
    return rows if columns is None else rows.select(*checked_columns(columns, state=False))


def state_scan(facts: DataFrame, spec: ScanSpec, commit_seq: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The event that holds at ``spec.valid_time`` on each live chain. Entities narrow the chains; the other ranges filter what
    was resolved and never change it. Edges are raw states: endpoints aren't looked at."""
    spec.check()
    if spec.valid_time is None:
        raise InvalidArgument("a state scan has a valid time")
    live = resolve(chain_rows(facts, spec), spec.valid_time, commit_seq)
    rows = within(within(live, "valid_from", spec.valid_from), "commit_seq", spec.commit_seq).drop("storage_sequence")
    return rows if columns is None else rows.select(*checked_columns(columns, state=True))


def checked_columns(columns: list[str], state: bool) -> list[str]:
    """The projection, in the order asked for: not empty, without duplicates, of columns that such a scan has."""
    if not columns or len(set(columns)) != len(columns):
        raise InvalidArgument("a projection names each of its columns once, and one at least")
    unknown = [c for c in columns if c not in FACTS.fieldNames()]
    if unknown:
        raise InvalidArgument(f"no such columns: {unknown}")
    if state and "storage_sequence" in columns:
        raise NotSupported("a state has no storage sequence")
    return columns


def ordered(df: DataFrame) -> DataFrame:
    """In canonical order; only for callers that need it, since it is a full sort."""
    return df.orderBy(*canonical_order())


def in_batches(df: DataFrame, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of at most ``rows`` and of the schema of ``df``, one partition after the other; stopping early reads no further ones."""
    if rows <= 0:
        raise InvalidArgument("a batch has at least one row")
    names, schema = df.columns, to_arrow_schema(df.schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=schema)
        held.clear()
        return made

    for row in df.toLocalIterator():
        held.append(tuple(row))
        if len(held) == rows:
            yield batch()
    if held:
        yield batch()


def visit(df: DataFrame, visitor: Callable[[pa.RecordBatch], bool], rows: int = 1024) -> bool:
    """Calls ``visitor`` with each batch until it returns False; whether it saw all. Empty batches aren't delivered."""
    if visitor is None:
        raise InvalidArgument("no visitor")
    return all(visitor(b) is not False for b in in_batches(df, rows))
