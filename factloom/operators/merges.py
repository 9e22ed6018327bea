"""Merge aggregates: how operands of one key, in order, become one value."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_uint64(value: str | Column) -> Column:
    """Sum modulo 2^64, as a decimal; operands are taken modulo 2^64 too, nulls count as zero."""
    wide = F.lit(Decimal(2**64)).cast("decimal(38,0)")
    operand = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("decimal(20,0)")
    return F.pmod(F.coalesce(F.sum(F.pmod(operand, wide)), F.lit(0)).cast("decimal(38,0)"), wide).cast("decimal(20,0)")


def max_bytes(value: str) -> Column:
    """Bytewise greatest operand."""
    return F.max(F.col(value).cast("binary"))


def last_put(value: str, sequence: str) -> Column:
    """The operand of the highest sequence."""
    return F.max_by(value, sequence)


def _ordered(value: str, sequence: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(sequence).alias("s"), F.col(value).alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def append_strings(value: str, sequence: str, delimiter: str = ",") -> Column:
    """Operands joined in order."""
    return F.array_join(_ordered(value, sequence), delimiter)


def sort_lists(value: str) -> Column:
    """Comma-separated lists of integers, merged into one sorted list."""
    parts = F.flatten(F.collect_list(F.split(value, ",")))
    return F.array_join(F.transform(F.array_sort(F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("long"))), lambda x: x.cast("string")), ",")


def xor_bytes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``value``: the operands' XOR; the tail of a longer one stays. By words of eight bytes, so it combines in each
    task and a key of any number of operands is as many rows as its longest operand has words."""
    digits = F.hex(value)
    words = F.transform(F.regexp_extract_all(digits, F.lit(".{1,16}"), F.lit(0)), lambda w: F.conv(F.rpad(w, 16, "0"), 16, -10).cast("long"))
    cells = df.select(*keys, F.length(digits).alias("_size"), F.posexplode_outer(words).alias("_at", "_word"))
    cells = cells.groupBy(*keys, "_at").agg(F.bit_xor("_word").alias("_word"), F.max("_size").alias("_size"))
    rows = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_word")))).alias("_r"), F.max("_size").alias("_size"))
    text = F.array_join(F.transform("_r", lambda r: F.lpad(F.hex(r["_word"]), 16, "0")), "")
    return rows.select(*keys, F.unhex(F.substring(text, F.lit(1), F.col("_size"))).alias(value))


#: Named aggregates: from the names of the value and sequence columns to an aggregate.
NAMED: dict[str, Callable[[str, str], Column]] = {"sum": lambda v, s: F.try_sum(v), "max": lambda v, s: F.max(v), "min": lambda v, s: F.min(v), "last": F.max_by, "count": lambda v, s: F.count(v)}


def named_aggregate(df: DataFrame, keys: list[str], name: str, value: str, sequence: str, registry: dict[str, Callable[[str, str], Column]] | None = None) -> DataFrame:
    """``keys`` and ``value``: each key's operands, merged by the aggregate that its last operand names in the column ``name``.

    Aggregates are looked up in ``registry`` (default NAMED); an unknown name gives null, and so does a sum beyond the type. All of them are taken in one pass,
    in each task before the shuffle, and the one that is named is picked at the end.
    """
    known = NAMED if registry is None else registry
    kind = df.schema[value].dataType
    made = [f(value, sequence).cast(kind).alias(f"_{n}") for n, f in known.items()]
    merged = df.groupBy(*keys).agg(F.max_by(name, sequence).alias("_name"), *made)
    picked = F.lit(None).cast(kind)
    for n in known:
        picked = F.when(F.col("_name") == n, F.col(f"_{n}")).otherwise(picked)
    return merged.select(*keys, picked.alias(value))
