"""Facts from star-schema tables: a property chain for each user of ``events``, and a graph of customers and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import Family, Operation, ValueType, conform

DAY = 86_400_000_000
CUSTOMER_PART, ORDER_PART = 1, 2


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def day_micros(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def events_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float property of each user: PUT of the value by day, DELETE on errors. Commits arrive out of order on purpose."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    put = F.col("event_type") != "error"
    rows = events.select(
        F.lit(0).alias("part_id"),
        F.lit(int(Family.VERTEX_PROPERTY)).alias("fact_family"),
        F.lit(1).alias("property_id"),
        (F.col("user_id") + 1).alias("entity_id"),
        day_micros("ts").alias("valid_from"),
        (F.pmod(F.col("event_id") * 7919, F.lit(n)) + 1).alias("commit_seq"),
        F.when(put, int(Operation.PUT)).otherwise(int(Operation.DELETE)).alias("operation"),
        F.lit(1).alias("schema_epoch"),
        F.when(put, int(ValueType.FLOAT64)).otherwise(0).alias("physical_type"),
        F.when(put, F.col("value")).alias("float64_value"),
    )
    return conform(rows)


def orders_as_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of customers and orders, an edge from each order to its customer, and the order's price on the edge.

    Each table is read once: a row gives all its events by an explode, without joins.
    """
    state = lambda part, family, entity, at, seq, op: F.struct(
        F.lit(part).cast("long").alias("part_id"), F.lit(int(family)).alias("fact_family"), entity.alias("entity_id"), at.cast("long").alias("valid_from"), F.lit(seq).cast("long").alias("commit_seq"), F.lit(int(op)).alias("operation")
    )
    put, delete = Operation.PUT, Operation.DELETE
    key = F.col("c_custkey")
    vertex = lambda at, seq, op: state(CUSTOMER_PART, Family.VERTEX_STATE, key + 1, F.lit(at), seq, op)
    gone, back = 883_612_800_000_000, 915_148_800_000_000  # 1998-01-01 and 1999-01-01
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.explode(F.array_compact(F.array(vertex(0, 1, put), F.when(key % 7 == 0, vertex(gone, 3, delete)), F.when(key % 14 == 0, vertex(back, 4, put))))).alias("e")
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") + 1).alias("id"), (F.col("o_custkey") + 1).alias("customer"), "o_orderstatus", "o_totalprice", micros("o_orderdate").alias("at"))
    order = lambda family, at, seq, op: state(ORDER_PART, family, F.col("id"), at, seq, op)
    status = F.col("o_orderstatus")
    events = [
        order(Family.VERTEX_STATE, F.col("at"), 2, put),
        F.when(status == "F", order(Family.VERTEX_STATE, F.col("at") + 90 * DAY, 5, delete)),
        order(Family.EDGE_IDENTITY, F.lit(0), 2, put),
        order(Family.EDGE_STATE, F.col("at"), 2, put),
        F.when(status == "P", order(Family.EDGE_STATE, F.col("at") + 30 * DAY, 6, delete)),
        order(Family.EDGE_PROPERTY, F.col("at"), 2, put),
    ]
    exploded = orders.select("id", "customer", "o_totalprice", F.explode(F.array_compact(F.array(*events))).alias("e"))
    family = F.col("e.fact_family")
    identity, priced = family == int(Family.EDGE_IDENTITY), family == int(Family.EDGE_PROPERTY)
    edges = exploded.select(
        "e.*",
        F.when(priced, 1).otherwise(0).alias("property_id"),
        F.when(priced, 1).otherwise(0).alias("schema_epoch"),
        F.when(priced, int(ValueType.FLOAT64)).otherwise(0).alias("physical_type"),
        F.when(priced, F.col("o_totalprice")).alias("float64_value"),
        F.when(identity, ORDER_PART).alias("source_part_id"),
        F.when(identity, F.col("id")).alias("source_vertex_id"),
        F.when(identity, CUSTOMER_PART).alias("target_part_id"),
        F.when(identity, F.col("customer")).alias("target_vertex_id"),
        F.when(identity, 1).alias("edge_type"),
    )
    return conform(customers.select("e.*")).unionByName(conform(edges))
