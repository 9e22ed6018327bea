"""Values: comparison, and views of one property with its type and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import LANES, VALUES, ValueType


def same_value(a: str, b: str) -> Column:
    """Whether two fact structs hold equal values: type and content, by IEEE rules, under which NaN equals nothing."""
    x, y = F.col(a), F.col(b)
    same = F.lit(False)
    for kind in ValueType:
        lane = LANES[kind][0]
        equal = x[lane] == y[lane]
        if kind in (ValueType.FLOAT32, ValueType.FLOAT64):
            equal = equal & ~F.isnan(x[lane]) & ~F.isnan(y[lane])
        same = same | ((x["physical_type"] == int(kind)) & (y["physical_type"] == int(kind)) & F.coalesce(equal, F.lit(False)))
    return same


def typed_view(state: DataFrame, properties: DataFrame | None, property_id: int, name: str, value_type: int) -> DataFrame:
    """part_id, entity_id, valid_from and the value under the property's name; strings as strings."""
    lane = F.col(LANES[ValueType(value_type)][0])
    value = lane.cast("string") if value_type == ValueType.STRING else lane
    return state.where((F.col("property_id") == property_id) & (F.col("physical_type") == value_type)).select("part_id", "entity_id", "valid_from", value.alias(name))


def value_text() -> Column:
    """Whatever value a row holds, as text; bytes as hexadecimal digits."""
    return F.coalesce(*(F.lower(F.hex(v)) if v == "bytes_value" else F.col(v).cast("string") for v in VALUES))


def fixed_prefix(key: str | Column, size: int) -> Column:
    """The first ``size`` bytes of a binary or string; null if it is shorter, as it then has no such prefix."""
    column = (F.col(key) if isinstance(key, str) else key).cast("binary")
    return F.when(F.length(column) >= size, F.substring(column, 1, size))


def capped_prefix(key: str | Column, size: int) -> Column:
    """The first ``size`` bytes of a binary or string, or all of it."""
    return F.substring((F.col(key) if isinstance(key, str) else key).cast("binary"), 1, size)
