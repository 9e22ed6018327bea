"""Latency histograms with fixed buckets, and integer moving averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bounds of the buckets, in microseconds; the last bucket is open.
BOUNDS = (10, 50, 100, 250, 500, 1000, 2000, 5000, 10000, 25000, 50000, 100000)


def bucket_of(latency: str | Column) -> Column:
    """Number of the bucket, from 0: the first whose bound isn't exceeded."""
    value = F.col(latency) if isinstance(latency, str) else latency
    out = F.lit(len(BOUNDS))
    for i, bound in reversed(list(enumerate(BOUNDS))):
        out = F.when(value <= bound, i).otherwise(out)
    return out


def percentiles(df: DataFrame, keys: list[str], latency: str, wanted: list[int]) -> DataFrame:
    """``keys``, percentile, value: the upper bound of the bucket in which the rank ceil(count * p / 100), at least 1, falls; in the
    last bucket the largest latency."""
    buckets = df.select(*keys, F.col(latency).alias("_l"), bucket_of(latency).alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.max("_l").alias("_m"))
    own = Window.partitionBy(*keys)
    summed = buckets.select(*keys, "_b", F.sum("_n").over(own.orderBy("_b")).alias("_to"), F.sum("_n").over(own).alias("_all"), F.max("_m").over(own).alias("_max"))
    asked = summed.withColumn("percentile", F.explode(F.array(*(F.lit(p) for p in wanted))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("_all") * F.col("percentile") / 100))
    first = asked.where(F.col("_to") >= rank).groupBy(*keys, "percentile").agg(F.min(F.struct("_b", "_max")).alias("f"))
    bound = F.get(F.array(*(F.lit(b) for b in BOUNDS)), F.col("f._b")).cast("long")
    return first.select(*keys, "percentile", F.coalesce(bound, F.col("f._max").cast("long")).alias("value"))


def moving_average(samples: Column) -> Column:
    """Of an ordered array of integers: the average that moves by an eighth, in integer arithmetic; zero starts anew."""
    return F.aggregate(samples, F.lit(0).cast("long"), lambda old, s: F.when(old == 0, s.cast("long")).otherwise(old - F.floor(old / 8) + F.floor(s / 8)))


def moving_averages(df: DataFrame, keys: list[str], order: str, sample: str) -> DataFrame:
    """``keys`` and average: moving_average() of each key's samples in their order; null counts as zero.

    The samples of a key pass by one after the other, sorted; none of them are kept, however many there are.
    """
    names = [f.name for f in df.select(*keys).schema.fields]
    out = T.StructType([*df.select(*keys).schema.fields, T.StructField("average", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, average = None, 0
        for b in batches:
            done = []
            for row in zip(*(b[c] for c in names), b["_sample"]):
                if row[:-1] != key:
                    if key is not None:
                        done.append((*key, average))
                    key, average = row[:-1], 0
                average = row[-1] if average == 0 else average - average // 8 + row[-1] // 8
            yield pd.DataFrame(done, columns=[*names, "average"])
        if key is not None:
            yield pd.DataFrame([(*key, average)], columns=[*names, "average"])

    rows = df.select(*keys, F.coalesce(F.col(sample).cast("long"), F.lit(0)).alias("_sample"), F.col(order).alias("_order"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_order").drop("_order").mapInPandas(run, out)
