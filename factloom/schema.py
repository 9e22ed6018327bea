"""The fact table: columns, families, and what a valid fact is.

A fact is an event on a chain, (part, family, property, entity): a PUT or a DELETE, valid from a time on, recorded by a
commit. All facts are one wide table of typed value columns.
"""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.errors import InvalidArgument


class Family(IntEnum):
    VERTEX_STATE = 1
    VERTEX_PROPERTY = 2
    EDGE_IDENTITY = 3
    EDGE_STATE = 4
    EDGE_PROPERTY = 5


class Operation(IntEnum):
    PUT = 1
    DELETE = 2


class ValueType(IntEnum):
    BOOL = 1
    INT32 = 2
    INT64 = 3
    FLOAT32 = 4
    FLOAT64 = 5
    TIMESTAMP64 = 6
    STRING = 7
    BINARY = 8


PROPERTY_FAMILIES = (Family.VERTEX_PROPERTY, Family.EDGE_PROPERTY)
#: The value column of each type, and its type in Spark. Strings and binaries share one.
LANES = {
    ValueType.BOOL: ("bool_value", T.BooleanType()),
    ValueType.INT32: ("int32_value", T.IntegerType()),
    ValueType.INT64: ("int64_value", T.LongType()),
    ValueType.FLOAT32: ("float32_value", T.FloatType()),
    ValueType.FLOAT64: ("float64_value", T.DoubleType()),
    ValueType.TIMESTAMP64: ("timestamp64_value", T.LongType()),
    ValueType.STRING: ("bytes_value", T.BinaryType()),
    ValueType.BINARY: ("bytes_value", T.BinaryType()),
}
KEY = ["part_id", "fact_family", "property_id", "entity_id"]
VALUES = list(dict.fromkeys(name for name, _ in LANES.values()))
EDGE_ENDS = ["source_part_id", "source_vertex_id", "target_part_id", "target_vertex_id", "edge_type"]
FACTS = T.StructType(
    [
        T.StructField("part_id", T.LongType()),
        T.StructField("fact_family", T.IntegerType()),
        T.StructField("property_id", T.IntegerType()),
        T.StructField("entity_id", T.LongType()),
        T.StructField("valid_from", T.LongType()),
        T.StructField("commit_seq", T.LongType()),
        T.StructField("storage_sequence", T.LongType()),
        T.StructField("operation", T.IntegerType()),
        T.StructField("schema_epoch", T.LongType()),
        T.StructField("physical_type", T.IntegerType()),
        *(T.StructField(n, t) for n, t in dict(LANES.values()).items()),
        *(T.StructField(n, T.LongType()) for n in EDGE_ENDS),
    ]
)
PROPERTIES = "property_id int, schema_epoch long, name string, entity_kind int, physical_type int, blob_threshold_bytes long"
MAX_VALUE_BYTES, MAX_NAME_BYTES, MAX_PROPERTY_ID, MAX_PART_ID = 16 << 20, 4096, 65535, 2**32 - 1


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of the fact table; those that are missing are null, ids of nothing are zero."""
    zero = {"part_id", "property_id", "schema_epoch", "physical_type", "valid_from"}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(0 if f.name in zero else None)).cast(f.dataType).alias(f.name) for f in FACTS.fields))


def chain_key(family: Family, part_id: str | Column, entity_id: str | Column, property_id: int = 0) -> list[Column]:
    """The key columns of the chains of a family: a vertex, an edge in its home part, or a property of one of them."""
    check_family(family, property_id)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    values = (column(part_id).cast("long"), F.lit(int(family)), F.lit(property_id), column(entity_id).cast("long"))
    return [v.alias(k) for v, k in zip(values, KEY)]


def canonical_order() -> list[Column]:
    """Chains ascending, and on a chain the newest valid time, then the newest commit, first."""
    return [*(F.col(c).asc() for c in KEY), F.col("valid_from").desc(), F.col("commit_seq").desc()]


def check_family(family: int, property_id: int) -> None:
    """Property families have a property id, the others have none."""
    if family not in set(Family):
        raise InvalidArgument(f"unknown family {family}")
    if (family in PROPERTY_FAMILIES) != (0 < property_id <= MAX_PROPERTY_ID) or property_id < 0:
        raise InvalidArgument(f"family {Family(family).name} with property id {property_id}")


def invalid_reason() -> Column:
    """Why a row isn't a valid fact, or null."""
    family, prop, op, kind = (F.col(c) for c in ("fact_family", "property_id", "operation", "physical_type"))
    is_property = family.isin(*map(int, PROPERTY_FAMILIES))
    present = sum(F.when(F.col(v).isNotNull(), 1).otherwise(0) for v in VALUES)
    put = op == int(Operation.PUT)
    lane = F.lit(False)
    for value_type, (name, _) in LANES.items():
        lane = lane | ((kind == int(value_type)) & F.col(name).isNotNull())
    ends = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in EDGE_ENDS)
    identity = family == int(Family.EDGE_IDENTITY)
    rules = [
        (~family.between(1, 5), "unknown family"),
        (~op.isin(1, 2), "unknown operation"),
        (F.col("entity_id") <= 0, "zero entity id"),
        (~F.col("part_id").between(0, MAX_PART_ID), "part id out of range"),
        (F.col("commit_seq") <= 0, "zero commit"),
        (F.col("valid_from") < 0, "negative valid time"),
        (is_property & ~prop.between(1, MAX_PROPERTY_ID), "property without id"),
        (~is_property & (prop != 0), "state with property id"),
        (is_property & (F.col("schema_epoch") <= 0), "property without epoch"),
        (~is_property & (F.col("schema_epoch") != 0), "state with epoch"),
        (is_property & put & ((present != 1) | ~lane), "put without one value of its type"),
        (~(is_property & put) & ((present != 0) | (kind != 0)), "value where none belongs"),
        (F.length("bytes_value") > MAX_VALUE_BYTES, "value too large"),
        (identity & (~put | (F.col("valid_from") != 0) | (ends != 5)), "incomplete edge identity"),
        (identity & (F.col("source_part_id") != F.col("part_id")), "edge away from its source's part"),
        (identity & ((F.col("source_vertex_id") <= 0) | (F.col("target_vertex_id") <= 0) | (F.col("edge_type") <= 0)), "zero endpoint or type"),
        (~identity & (ends != 0), "endpoints where none belong"),
    ]
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, text).otherwise(reason)
    return reason


def validated(facts: DataFrame) -> DataFrame:
    """``facts`` with a check in every row: reading an invalid one raises an error that says why."""
    reason = invalid_reason()
    return facts.where(F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("invalid fact: "), reason)).cast("boolean")).otherwise(True))
