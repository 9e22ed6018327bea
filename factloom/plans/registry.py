"""Queries over facts derived from the star-schema tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.latency import moving_averages, percentiles
from factloom.functions.values import capped_prefix, fixed_prefix, same_value
from factloom.operators import catalogue, conflicts, graph, lookups, merges, resolve, retention, scan
from factloom.schema import KEY, VALUES, Family, canonical_order, chain_key, conform, invalid_reason
from factloom.sources.derive import DAY, events_as_facts, orders_as_graph
from factloom.sources.layout import changes, read_facts, scratch_folder, write_facts

T0 = 1_705_276_800_000_000  # 2024-01-15
#: Snapshots and boundaries are shares of all commits, so that queries see as large a part of tables of any size.
S0, S1, OLD, BOUNDARY = 60, 65, 15, 40
G_TIME = 896_659_200_000_000  # 1998-06-01
USERS = scan.ScanSpec(Family.VERTEX_PROPERTY, 1, 0, valid_time=T0)

EVENTS = """
events_n AS (SELECT count(*) AS n FROM events),
facts AS (
  SELECT CAST(0 AS BIGINT) AS part_id, 2 AS fact_family, 1 AS property_id, user_id + 1 AS entity_id,
    epoch_us(date_trunc('day', ts)::TIMESTAMP) AS valid_from, (event_id * 7919) % n + 1 AS commit_seq,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS operation, CAST(1 AS BIGINT) AS schema_epoch,
    CASE WHEN event_type = 'error' THEN 0 ELSE 5 END AS physical_type,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS float64_value
  FROM events, events_n
)"""
GRAPH = f"""
vertex_facts AS (
  SELECT CAST(1 AS BIGINT) AS part_id, c_custkey + 1 AS entity_id, CAST(0 AS BIGINT) AS valid_from, CAST(1 AS BIGINT) AS commit_seq, 1 AS operation FROM customer
  UNION ALL SELECT 1, c_custkey + 1, 883612800000000, 3, 2 FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 1, c_custkey + 1, 915148800000000, 4, 1 FROM customer WHERE c_custkey % 14 = 0
  UNION ALL SELECT 2, o_orderkey + 1, epoch_us(o_orderdate::TIMESTAMP), 2, 1 FROM orders
  UNION ALL SELECT 2, o_orderkey + 1, epoch_us(o_orderdate::TIMESTAMP) + {90 * DAY}, 5, 2 FROM orders WHERE o_orderstatus = 'F'
), edge_facts AS (
  SELECT CAST(2 AS BIGINT) AS part_id, o_orderkey + 1 AS entity_id, epoch_us(o_orderdate::TIMESTAMP) AS valid_from, CAST(2 AS BIGINT) AS commit_seq, 1 AS operation FROM orders
  UNION ALL SELECT 2, o_orderkey + 1, epoch_us(o_orderdate::TIMESTAMP) + {30 * DAY}, 6, 2 FROM orders WHERE o_orderstatus = 'P'
), identity AS (
  SELECT CAST(2 AS BIGINT) AS part_id, o_orderkey + 1 AS entity_id, CAST(2 AS BIGINT) AS source_part_id, o_orderkey + 1 AS source_vertex_id,
    CAST(1 AS BIGINT) AS target_part_id, o_custkey + 1 AS target_vertex_id, CAST(1 AS BIGINT) AS edge_type, CAST(2 AS BIGINT) AS commit_seq FROM orders
), price AS (
  SELECT CAST(2 AS BIGINT) AS part_id, o_orderkey + 1 AS entity_id, epoch_us(o_orderdate::TIMESTAMP) AS valid_from, CAST(2 AS BIGINT) AS commit_seq, o_totalprice FROM orders
)"""


def _at(percent: int) -> str:
    """That share of the commits, in SQL."""
    return f"(SELECT n * {percent} // 100 FROM events_n)"


def _seq(spark: SparkSession, sf_dir: str, percent: int) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() * percent // 100


CHAIN = "part_id, fact_family, property_id, entity_id"


def _state_sql(t: int, s: int | str, source: str = "facts") -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {CHAIN} ORDER BY valid_from DESC, commit_seq DESC) AS rn FROM {source} WHERE valid_from <= {t} AND commit_seq <= {s}) WHERE rn = 1 AND operation = 1"


def _live_sql(source: str, t: int, s: int) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY part_id, entity_id ORDER BY valid_from DESC, commit_seq DESC) AS rn FROM {source} WHERE valid_from <= {t} AND commit_seq <= {s}) WHERE rn = 1 AND operation = 1)"


def _visible_sql(t: int, s: int) -> str:
    v = _live_sql("vertex_facts", t, s)
    return f"""(SELECT e.part_id, e.entity_id, i.source_part_id, i.source_vertex_id, i.target_part_id, i.target_vertex_id, i.edge_type, e.valid_from
      FROM {_live_sql("edge_facts", t, s)} e JOIN identity i ON i.part_id = e.part_id AND i.entity_id = e.entity_id AND i.commit_seq <= {s}
      WHERE EXISTS (SELECT 1 FROM {v} v WHERE v.part_id = i.source_part_id AND v.entity_id = i.source_vertex_id)
        AND EXISTS (SELECT 1 FROM {v} v WHERE v.part_id = i.target_part_id AND v.entity_id = i.target_vertex_id))"""


ROW = [*KEY, "valid_from", "commit_seq", "operation", "float64_value"]
ROW_SQL = ", ".join(ROW)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM facts WHERE commit_seq <= {_at(S0)}")
def event_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.event_scan(events_as_facts(spark, sf_dir), USERS, _seq(spark, sf_dir, S0), ROW)


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM facts WHERE commit_seq <= {_at(S0)} AND entity_id BETWEEN 10 AND 60 AND valid_from BETWEEN {T0 - 5 * DAY} AND {T0} AND commit_seq BETWEEN {_at(1)} AND {_at(50)}")
def event_scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = scan.ScanSpec(Family.VERTEX_PROPERTY, 1, 0, entity=(10, 60), valid_from=(T0 - 5 * DAY, T0), commit_seq=(_seq(spark, sf_dir, 1), _seq(spark, sf_dir, 50)))
    return scan.event_scan(events_as_facts(spark, sf_dir), spec, _seq(spark, sf_dir, S0), ROW)


@query(f"WITH {EVENTS} SELECT entity_id, valid_from, commit_seq FROM facts")
def event_scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.event_scan(events_as_facts(spark, sf_dir), USERS, None, ["entity_id", "valid_from", "commit_seq"])


@query(f"WITH {EVENTS} {_state_sql(T0, _at(S0)).replace('SELECT * EXCLUDE (rn)', f'SELECT {ROW_SQL}', 1)}")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.state_scan(events_as_facts(spark, sf_dir), USERS, _seq(spark, sf_dir, S0), ROW)


@query(f"WITH {EVENTS} {_state_sql(T0, _at(OLD)).replace('SELECT * EXCLUDE (rn)', f'SELECT {ROW_SQL}', 1)}")
def state_as_of_old_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.state_scan(events_as_facts(spark, sf_dir), USERS, _seq(spark, sf_dir, OLD), ROW)


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM ({_state_sql(T0, _at(S0))}) WHERE entity_id BETWEEN 5 AND 120 AND valid_from BETWEEN {T0 - 3 * DAY} AND {T0} AND commit_seq BETWEEN 1 AND {_at(55)}")
def state_scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = scan.ScanSpec(Family.VERTEX_PROPERTY, 1, 0, T0, (5, 120), (T0 - 3 * DAY, T0), (1, _seq(spark, sf_dir, 55)))
    return scan.state_scan(events_as_facts(spark, sf_dir), spec, _seq(spark, sf_dir, S0), ROW)


@query(
    f"WITH {EVENTS} SELECT entity_id, schema_epoch, physical_type, CAST(NULL AS BOOLEAN) AS bool_value, CAST(NULL AS INTEGER) AS int32_value, CAST(NULL AS BIGINT) AS int64_value, CAST(NULL AS FLOAT) AS float32_value, float64_value, CAST(NULL AS BIGINT) AS timestamp64_value, CAST(NULL AS BIGINT) AS source_vertex_id FROM ({_state_sql(T0, _at(S0))})"
)
def state_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["entity_id", "schema_epoch", "physical_type", "bool_value", "int32_value", "int64_value", "float32_value", "float64_value", "timestamp64_value", "source_vertex_id"]
    return scan.state_scan(events_as_facts(spark, sf_dir), USERS, _seq(spark, sf_dir, S0), columns)


@query(f"WITH {GRAPH} SELECT part_id, entity_id FROM {_live_sql('vertex_facts', G_TIME, 6)}")
def exists_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.live_vertices(orders_as_graph(spark, sf_dir), G_TIME, 6)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer and edge, by position, with ids that aren't there in between."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    vertex = F.struct((F.col("o_orderkey") * 2).alias("pos"), F.lit(1).cast("long").alias("part_id"), F.lit(1).alias("fact_family"), (F.col("o_custkey") + 1 + F.when(F.col("o_orderkey") % 5 == 0, 100_000_000).otherwise(0)).alias("entity_id"))
    edge = F.struct((F.col("o_orderkey") * 2 + 1).alias("pos"), F.lit(2).cast("long").alias("part_id"), F.lit(4).alias("fact_family"), (F.col("o_orderkey") + 1).alias("entity_id"))
    return orders.select(F.explode(F.array(vertex, edge)).alias("r")).select("r.*")


@query(
    f"""WITH {GRAPH}, requests AS (
      SELECT o_orderkey * 2 AS pos, CAST(1 AS BIGINT) AS part_id, 1 AS fact_family, o_custkey + 1 + CASE WHEN o_orderkey % 5 = 0 THEN 100000000 ELSE 0 END AS entity_id FROM orders
      UNION ALL SELECT o_orderkey * 2 + 1, 2, 4, o_orderkey + 1 FROM orders
    ), live AS (
      SELECT part_id, entity_id, 1 AS fact_family FROM {_live_sql("vertex_facts", G_TIME, 6)}
      UNION ALL SELECT part_id, entity_id, 4 FROM {_visible_sql(G_TIME, 6)}
    )
    SELECT r.pos, r.part_id, r.fact_family, r.entity_id, l.entity_id IS NOT NULL AS exists
    FROM requests r LEFT JOIN live l ON l.part_id = r.part_id AND l.fact_family = r.fact_family AND l.entity_id = r.entity_id"""
)
def multi_exists_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.multi_exists(orders_as_graph(spark, sf_dir), _requests(spark, sf_dir), G_TIME, 6)


@query(f"WITH {EVENTS} SELECT entity_id, float64_value FROM ({_state_sql(T0, _at(S0))}) WHERE entity_id IN (1, 7, 42, 99, 100000)")
def get_vertex_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = events_as_facts(spark, sf_dir).where(F.col("entity_id").isin(1, 7, 42, 99, 100000))
    return scan.state_scan(wanted, USERS, _seq(spark, sf_dir, S0), ["entity_id", "float64_value"])


@query(
    f"""WITH {EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY {CHAIN}, valid_from ORDER BY commit_seq DESC) AS rn FROM facts WHERE commit_seq <= {_at(S0)})
    SELECT {CHAIN}, max(valid_from) FILTER (valid_from <= {T0}) AS observed, arg_max(commit_seq, valid_from) FILTER (valid_from <= {T0}) AS observed_commit,
      arg_max(operation, valid_from) FILTER (valid_from <= {T0}) AS observed_operation, max(valid_from) FILTER (valid_from < {T0}) AS predecessor, min(valid_from) FILTER (valid_from > {T0}) AS successor
    FROM b WHERE rn = 1 GROUP BY {CHAIN}"""
)
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.neighborhood(events_as_facts(spark, sf_dir), T0, _seq(spark, sf_dir, S0))


@query(
    f"""WITH {EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY {CHAIN}, valid_from ORDER BY commit_seq DESC) AS rn FROM facts WHERE commit_seq <= {_at(S0)})
    SELECT {ROW_SQL}, lead(valid_from) OVER (PARTITION BY {CHAIN} ORDER BY valid_from) AS valid_to FROM b WHERE rn = 1"""
)
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.intervals(events_as_facts(spark, sf_dir), _seq(spark, sf_dir, S0)).select(*ROW, "valid_to")


@query(
    f"""WITH {EVENTS}, probes AS (SELECT event_id, user_id + 1 AS entity_id, epoch_us(ts::TIMESTAMP) - {DAY} AS valid_time FROM events),
    ranked AS (SELECT p.event_id, p.valid_time, f.entity_id, f.valid_from, f.commit_seq, f.operation, f.float64_value,
        row_number() OVER (PARTITION BY p.event_id ORDER BY f.valid_from DESC NULLS LAST, f.commit_seq DESC) AS rn
      FROM probes p LEFT JOIN facts f ON f.entity_id = p.entity_id AND f.valid_from <= p.valid_time AND f.commit_seq <= {_at(S0)})
    SELECT event_id, valid_time, CASE WHEN operation = 1 THEN valid_from END AS f_valid_from, CASE WHEN operation = 1 THEN commit_seq END AS f_commit_seq, CASE WHEN operation = 1 THEN float64_value END AS f_float64_value
    FROM ranked WHERE rn = 1"""
)
def temporal_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources.derive import micros

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    probes = events.select(F.lit(0).cast("long").alias("part_id"), F.lit(2).alias("fact_family"), F.lit(1).alias("property_id"), (F.col("user_id") + 1).alias("entity_id"), "event_id", (micros("ts") - DAY).alias("valid_time"))
    return resolve.as_of_join(probes, events_as_facts(spark, sf_dir), commit_seq=_seq(spark, sf_dir, S0), buckets=4).select("event_id", "valid_time", "f_valid_from", "f_commit_seq", "f_float64_value")


@query(f"WITH {GRAPH} SELECT * FROM identity WHERE commit_seq <= 6")
def edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_identity(orders_as_graph(spark, sf_dir), 6)


@query(f"WITH {GRAPH} SELECT part_id, entity_id, valid_from, commit_seq FROM {_live_sql('edge_facts', G_TIME, 6)}")
def edge_state_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_states(orders_as_graph(spark, sf_dir), G_TIME, 6).select("part_id", "entity_id", "valid_from", "commit_seq")


@query(f"WITH {GRAPH} SELECT * FROM {_visible_sql(G_TIME, 6)}")
def edges_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_edges(orders_as_graph(spark, sf_dir), G_TIME, 6)


@query(f"WITH {GRAPH} SELECT * FROM {_visible_sql(G_TIME + 365 * DAY, 6)}")
def edges_visible_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_edges(orders_as_graph(spark, sf_dir), G_TIME + 365 * DAY, 6)


@query(f"WITH {GRAPH} SELECT p.part_id, p.entity_id, p.o_totalprice AS float64_value FROM price p JOIN {_visible_sql(G_TIME, 6)} e ON e.part_id = p.part_id AND e.entity_id = p.entity_id WHERE p.valid_from <= {G_TIME}")
def edge_property_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_properties(orders_as_graph(spark, sf_dir), G_TIME, 6).select("part_id", "entity_id", "float64_value")


@query(f"WITH {GRAPH} SELECT source_part_id AS part_id, source_vertex_id AS vertex_id, count(*) AS degree FROM {_visible_sql(G_TIME, 6)} GROUP BY 1, 2")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.out_edges(orders_as_graph(spark, sf_dir), G_TIME, 6))


@query(f"WITH {GRAPH} SELECT target_part_id AS part_id, target_vertex_id AS vertex_id, count(*) AS degree FROM {_visible_sql(G_TIME, 6)} GROUP BY 1, 2")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.in_edges(orders_as_graph(spark, sf_dir), G_TIME, 6))


_SURVIVORS = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {CHAIN}, valid_from, commit_seq <= {_at(BOUNDARY)} ORDER BY commit_seq DESC) AS rn FROM facts) WHERE commit_seq > {_at(BOUNDARY)} OR rn = 1"


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM ({_SURVIVORS})")
def vacuum_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.survivors(events_as_facts(spark, sf_dir), _seq(spark, sf_dir, BOUNDARY)).select(*ROW)


@query(f"WITH {EVENTS} {_state_sql(T0, _at(S0)).replace('SELECT * EXCLUDE (rn)', f'SELECT {ROW_SQL}', 1)}")
def state_after_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.state_scan(retention.survivors(events_as_facts(spark, sf_dir), _seq(spark, sf_dir, BOUNDARY)), USERS, _seq(spark, sf_dir, S0), ROW)


@query(f"WITH {EVENTS} SELECT commit_seq, count(*) AS n_facts, min(entity_id) AS first_entity FROM facts WHERE commit_seq > {_at(20)} AND commit_seq <= {_at(30)} GROUP BY commit_seq")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(events_as_facts(spark, sf_dir), _seq(spark, sf_dir, 20), _seq(spark, sf_dir, 30)).select("commit_seq", "n_facts", F.col("facts")[0]["entity_id"].alias("first_entity"))


def _staged(facts: DataFrame, first: int, last: int) -> DataFrame:
    """Writes staged from the commits after ``first`` up to ``last``, as if begun at ``first``, a day later than what was written."""
    return facts.where((F.col("commit_seq") > first) & (F.col("commit_seq") <= last)).select(*KEY, (F.col("valid_from") + DAY).alias("valid_from")).distinct()


_CAPTURED = f"""staged AS (SELECT DISTINCT {CHAIN}, valid_from + {DAY} AS valid_from FROM facts WHERE commit_seq > {_at(S0)} AND commit_seq <= {_at(64)}),
captured AS (SELECT s.*, max(f.valid_from) FILTER (f.valid_from < s.valid_from) AS predecessor, min(f.valid_from) FILTER (f.valid_from > s.valid_from) AS successor
  FROM staged s LEFT JOIN facts f ON f.entity_id = s.entity_id AND f.commit_seq <= {_at(S0)} GROUP BY ALL)"""


@query(
    f"""WITH {EVENTS}, {_CAPTURED} SELECT c.part_id, c.fact_family, c.property_id, c.entity_id, c.valid_from, CAST({_at(S0)} AS BIGINT) AS snapshot_seq, min(f.commit_seq) AS first_conflict, count(*) AS events
    FROM captured c JOIN facts f ON f.entity_id = c.entity_id AND f.commit_seq > {_at(S0)} AND (c.predecessor IS NULL OR f.valid_from >= c.predecessor) AND (c.successor IS NULL OR f.valid_from < c.successor) GROUP BY ALL"""
)
def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = events_as_facts(spark, sf_dir)
    begun = _seq(spark, sf_dir, S0)
    captured = conflicts.capture(_staged(facts, begun, _seq(spark, sf_dir, 64)), facts, begun).withColumn("snapshot_seq", F.lit(begun).cast("long"))
    return conflicts.write_conflicts(captured, facts)


def _seen_sql(seq: str) -> str:
    return f"""SELECT {CHAIN}, max(valid_from) FILTER (valid_from <= {T0}) AS observed, arg_max(commit_seq, valid_from) FILTER (valid_from <= {T0}) AS observed_commit, max(valid_from) FILTER (valid_from < {T0}) AS predecessor, min(valid_from) FILTER (valid_from > {T0}) AS successor
      FROM (SELECT *, row_number() OVER (PARTITION BY {CHAIN}, valid_from ORDER BY commit_seq DESC) AS rn FROM facts WHERE commit_seq <= {seq}) WHERE rn = 1 GROUP BY {CHAIN}"""


@query(
    f"""WITH {EVENTS}, reads AS (SELECT DISTINCT {CHAIN} FROM facts), was AS ({_seen_sql(_at(S0))}), now AS ({_seen_sql(_at(S1))})
    SELECT r.entity_id, n.observed, n.observed_commit, w.observed AS was_observed FROM reads r LEFT JOIN was w ON w.entity_id = r.entity_id LEFT JOIN now n ON n.entity_id = r.entity_id
    WHERE (w.observed, w.observed_commit, w.predecessor, w.successor) IS DISTINCT FROM (n.observed, n.observed_commit, n.predecessor, n.successor)"""
)
def strict_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = events_as_facts(spark, sf_dir)
    reads = conflicts.capture(facts.select(*KEY).distinct().withColumn("valid_time", F.lit(T0)), facts, _seq(spark, sf_dir, S0), time="valid_time")
    return conflicts.strict_conflicts(reads, facts, _seq(spark, sf_dir, S1)).select("entity_id", "observed", "observed_commit", "was_observed")


@query(
    f"""WITH {EVENTS}, s AS (SELECT DISTINCT (commit_seq - 1) // 10 AS txn_id, {CHAIN} FROM facts), b AS (SELECT *, lag(txn_id) OVER (PARTITION BY {CHAIN} ORDER BY txn_id) AS before FROM s)
    SELECT txn_id, count(*) AS chains, count(before) AS shared, max(before) AS after FROM b GROUP BY txn_id"""
)
def footprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.footprints(events_as_facts(spark, sf_dir).withColumn("txn_id", F.expr("(commit_seq - 1) div 10")))


@query(
    f"""WITH {GRAPH} SELECT entity_id AS txn_id, bool_and(operation = 1) AS blind FROM vertex_facts GROUP BY entity_id"""
)
def blind_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each vertex id as one transaction; nothing was captured or read."""
    facts = orders_as_graph(spark, sf_dir).where(F.col("fact_family") == int(Family.VERTEX_STATE))
    none = F.lit(None).cast("long")
    return conflicts.blind_appends(facts.select(F.col("entity_id").alias("txn_id"), "fact_family", "operation", none.alias("predecessor"), none.alias("successor"), F.lit(False).alias("strict")))


_PROPERTIES_SQL = "properties AS (SELECT p_size AS property_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS schema_epoch, p_brand AS name, CAST(p_partkey % 2 + 1 AS INTEGER) AS entity_kind, CAST(p_partkey % 8 + 1 AS INTEGER) AS physical_type FROM part)"


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a definition of the property of its size; later parts are later epochs."""
    epoch = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).cast("long")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("property_id"), epoch.alias("schema_epoch"), F.col("p_brand").alias("name"), (F.col("p_partkey") % 2 + 1).cast("int").alias("entity_kind"), (F.col("p_partkey") % 8 + 1).cast("int").alias("physical_type"))


@query(f"WITH {_PROPERTIES_SQL} SELECT property_id, schema_epoch, name, entity_kind, physical_type FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY schema_epoch DESC) AS rn FROM properties) WHERE rn = 1")
def schema_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.latest_properties(_properties(spark, sf_dir))


@query(
    f"""WITH {_PROPERTIES_SQL}, asked AS (SELECT o_orderkey AS request, CAST(o_orderkey % 60 + 1 AS INTEGER) AS property_id, nullif(o_orderkey % 12, 0) AS schema_epoch FROM orders),
    latest AS (SELECT property_id, max(schema_epoch) AS newest FROM properties GROUP BY property_id)
    SELECT a.request, a.property_id, a.schema_epoch, p.property_id IS NOT NULL AS found, p.name, p.entity_kind, p.physical_type
    FROM asked a LEFT JOIN latest l ON l.property_id = a.property_id LEFT JOIN properties p ON p.property_id = a.property_id AND p.schema_epoch = coalesce(a.schema_epoch, l.newest)"""
)
def property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by id and epoch, or of the latest epoch; some aren't there."""
    key = F.col("o_orderkey")
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("request"), (key % 60 + 1).cast("int").alias("property_id"), F.nullif(key % 12, F.lit(0)).alias("schema_epoch"))
    return catalogue.lookup_properties(asked, _properties(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT entity_id, valid_from, commit_seq, row_number() OVER (PARTITION BY {CHAIN} ORDER BY valid_from DESC, commit_seq DESC) AS position FROM facts")
def canonical_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event on its chain in canonical order."""
    order = Window.partitionBy(*KEY).orderBy(*canonical_order()[len(KEY) :])
    return events_as_facts(spark, sf_dir).select("entity_id", "valid_from", "commit_seq", F.row_number().over(order).cast("long").alias("position"))


@query(
    f"""WITH {EVENTS}, l AS (SELECT entity_id, commit_seq, physical_type, float64_value, lag(physical_type) OVER w AS t, lag(float64_value) OVER w AS v FROM facts WINDOW w AS (PARTITION BY {CHAIN} ORDER BY commit_seq))
    SELECT entity_id, commit_seq, coalesce(physical_type = 5 AND t = 5 AND float64_value = v AND NOT isnan(v), FALSE) AS same FROM l WHERE t IS NOT NULL"""
)
def value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event of a chain has the value of the one that was committed before it."""
    value = F.struct("physical_type", *VALUES)
    before = Window.partitionBy(*KEY).orderBy("commit_seq")
    rows = events_as_facts(spark, sf_dir).select("entity_id", "commit_seq", value.alias("own"), F.lag(value).over(before).alias("last"))
    return rows.where("last IS NOT NULL").select("entity_id", "commit_seq", same_value("own", "last").alias("same"))


@query("SELECT event_id AS commit_seq, user_id + 1 AS entity_id FROM events WHERE CASE WHEN event_type = 'error' THEN '' ELSE props END <> '' OR props IS NULL AND event_type <> 'error'")
def non_empty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "").otherwise(F.col("props"))
    facts = conform(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("commit_seq"), (F.col("user_id") + 1).alias("entity_id"), text.cast("binary").alias("bytes_value")))
    return lookups.without_empty_values(facts).select("commit_seq", "entity_id")


@query("SELECT CASE WHEN user_id = 0 THEN 'zero entity id' WHEN event_type <> 'error' AND value IS NULL THEN 'put without one value of its type' WHEN event_type = 'error' AND value IS NOT NULL THEN 'value where none belongs' ELSE 'valid' END AS reason, count(*) AS facts FROM events GROUP BY 1")
def invalid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why facts aren't valid, if deletions keep their value and ids begin at zero."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    put = F.col("event_type") != "error"
    facts = conform(events.select(F.lit(2).alias("fact_family"), F.lit(1).alias("property_id"), F.col("user_id").alias("entity_id"), F.lit(1).alias("commit_seq"), F.when(put, 1).otherwise(2).alias("operation"), F.lit(1).alias("schema_epoch"), F.when(put, 5).otherwise(0).alias("physical_type"), F.col("value").alias("float64_value")))
    return facts.select(F.coalesce(invalid_reason(), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("facts"))


@query(f"WITH {EVENTS} {_state_sql(T0, _at(S0)).replace('SELECT * EXCLUDE (rn)', f'SELECT {ROW_SQL}', 1)}")
def persisted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts written in the library's layout, and the state read from it: partitions and row groups are pruned."""
    path = f"{scratch_folder(spark)}/facts-{uuid.uuid4().hex}"
    write_facts(events_as_facts(spark, sf_dir), path, partitions=8)
    return scan.state_scan(read_facts(spark, path), USERS, _seq(spark, sf_dir, S0), ROW)


@query(
    """WITH l AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS us, CASE WHEN floor(value * 100) <= 10 THEN 0 WHEN floor(value * 100) <= 50 THEN 1 WHEN floor(value * 100) <= 100 THEN 2 WHEN floor(value * 100) <= 250 THEN 3
        WHEN floor(value * 100) <= 500 THEN 4 WHEN floor(value * 100) <= 1000 THEN 5 WHEN floor(value * 100) <= 2000 THEN 6 WHEN floor(value * 100) <= 5000 THEN 7 WHEN floor(value * 100) <= 10000 THEN 8 WHEN floor(value * 100) <= 25000 THEN 9
        WHEN floor(value * 100) <= 50000 THEN 10 WHEN floor(value * 100) <= 100000 THEN 11 ELSE 12 END AS b FROM events WHERE value IS NOT NULL),
    n AS (SELECT event_type, b, count(*) AS n, max(us) AS m FROM l GROUP BY 1, 2),
    c AS (SELECT event_type, b, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total, max(m) OVER (PARTITION BY event_type) AS most FROM n),
    p AS (SELECT event_type, percentile, min(b) AS b, any_value(most) AS most FROM c, (VALUES (50), (95), (99)) AS w(percentile) WHERE upto >= greatest(1, ceil(total * percentile / 100.0)) GROUP BY 1, 2)
    SELECT event_type, percentile, CAST(CASE WHEN b = 12 THEN most ELSE [10, 50, 100, 250, 500, 1000, 2000, 5000, 10000, 25000, 50000, 100000][b + 1] END AS BIGINT) AS value FROM p"""
)
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_type", F.floor(F.col("value") * 100).alias("us"))
    return percentiles(events, ["event_type"], "us", [50, 95, 99])


@query("WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) AS v FROM events), r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a FROM (SELECT DISTINCT user_id FROM s) UNION ALL SELECT r.user_id, s.i, CASE WHEN a = 0 THEN v ELSE a - a // 8 + v // 8 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, arg_max(a, i) AS average FROM r GROUP BY user_id")
def ewma_eighth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("sample"))
    return moving_averages(events, ["user_id"], "event_id", "sample")


@query("SELECT user_id, CAST(sum(18446744073709551615::HUGEINT - event_id) % 18446744073709551616::HUGEINT AS VARCHAR) AS total FROM events GROUP BY user_id")
def merge_uint64add(spark: SparkSession, sf_dir: str) -> DataFrame:
    operand = F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)") - F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(merges.add_uint64(operand).cast("string").alias("total"))


@query("SELECT user_id, max(event_type || '-' || props) AS greatest_text FROM events GROUP BY user_id")
def merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.concat("event_type", F.lit("-"), "props"))
    return rows.groupBy("user_id").agg(merges.max_bytes("v").cast("string").alias("greatest_text"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def merge_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(merges.last_put("event_type", "event_id").alias("last_type"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def merge_stringappend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(merges.append_strings("event_type", "event_id").alias("types"))


@query("SELECT user_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS sorted_list FROM (SELECT user_id, event_id AS x FROM events UNION ALL SELECT user_id, user_id FROM events) GROUP BY user_id")
def merge_sortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.concat_ws(",", "event_id", "user_id"))
    return rows.groupBy("user_id").agg(merges.sort_lists("v").alias("sorted_list"))


@query("SELECT user_id, lpad(upper(to_hex(bit_xor(event_id % 65536))), 4, '0') AS xored FROM events GROUP BY user_id")
def merge_bytesxor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.unhex(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0")))
    return merges.xor_bytes(rows, ["user_id"], "v").select("user_id", F.hex("v").alias("xored"))


@query("SELECT user_id, CASE arg_max(event_id, event_id) % 3 WHEN 0 THEN sum(event_id) WHEN 1 THEN max(event_id) ELSE count(*) END::BIGINT AS merged FROM events GROUP BY user_id")
def merge_named_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("sum"), F.lit("max"), F.lit("count")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", name.alias("function"), F.col("event_id").alias("merged"))
    return merges.named_aggregate(rows, ["user_id"], "function", "merged", "event_id")


@query(f"WITH {EVENTS}, own AS (SELECT * FROM facts WHERE commit_seq <= {_at(S0)} UNION ALL SELECT part_id, fact_family, property_id, entity_id, {T0}, {_at(S0)} + 1, 1, schema_epoch, 5, -1.0 FROM (SELECT DISTINCT part_id, fact_family, property_id, entity_id, schema_epoch FROM facts WHERE operation = 2 AND valid_from > {T0})) {_state_sql(T0, _at(S0) + ' + 1', 'own').replace('SELECT * EXCLUDE (rn)', 'SELECT entity_id, valid_from, float64_value', 1)}")
def read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows over the base, resolved together (an extension)."""
    facts = events_as_facts(spark, sf_dir)
    seq = _seq(spark, sf_dir, S0)
    staged = facts.where((F.col("operation") == 2) & (F.col("valid_from") > T0)).select(*KEY).distinct().withColumns({"valid_from": F.lit(T0), "commit_seq": F.lit(seq + 1), "operation": F.lit(1), "schema_epoch": F.lit(1), "physical_type": F.lit(5), "float64_value": F.lit(-1.0)})
    both = resolve.seen(facts, seq).unionByName(conform(staged))
    return scan.state_scan(both, USERS, seq + 1, ["entity_id", "valid_from", "float64_value"])


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM facts WHERE operation = 2")
def exact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of full keys that are taken from the history, with keys that aren't there among them."""
    facts = events_as_facts(spark, sf_dir)
    keys = facts.where("operation = 2").select(*lookups.EXACT)
    return lookups.exact_facts(facts, keys.unionByName(keys.withColumn("valid_from", F.col("valid_from") + 1))).select(*ROW)


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM facts WHERE (entity_id BETWEEN 3 AND 9 OR entity_id BETWEEN 50 AND 55 OR entity_id BETWEEN 120 AND 140) AND commit_seq <= {_at(S0)}")
def multi_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.multi_range_scan(events_as_facts(spark, sf_dir), USERS, [(3, 9), (50, 55), (120, 140)], _seq(spark, sf_dir, S0)).select(*ROW)


@query("SELECT CASE WHEN strlen(c_name) >= 12 THEN substr(c_name, 1, 12) END AS prefix, substr(c_mktsegment, 1, 4) AS segment, count(*) AS customers FROM customer GROUP BY 1, 2")
def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the first bytes of their names and segments."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(fixed_prefix("c_name", 12).cast("string").alias("prefix"), capped_prefix("c_mktsegment", 4).cast("string").alias("segment"))
    return rows.groupBy("prefix", "segment").agg(F.count("*").alias("customers"))


@query(
    f"""WITH {GRAPH}, asked AS (SELECT DISTINCT CAST(2 AS BIGINT) AS part_id, l_orderkey + 1 AS entity_id FROM lineitem)
    SELECT a.entity_id, e.valid_from FROM asked a JOIN {_live_sql("edge_facts", G_TIME, 6)} e ON e.part_id = a.part_id AND e.entity_id = a.entity_id"""
)
def constructed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of edges whose keys are made from the line items of their orders."""
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*chain_key(Family.EDGE_STATE, F.lit(2), F.col("l_orderkey") + 1)).distinct()
    facts = orders_as_graph(spark, sf_dir)
    return resolve.resolve(facts.join(keys, KEY, "left_semi"), G_TIME, 6).select("entity_id", "valid_from")


@query(f"WITH {EVENTS} SELECT part_id, entity_id FROM ({_state_sql(T0, _at(S0))}) WHERE float64_value BETWEEN 20 AND 60")
def entities_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.entities_by_value(scan.state_scan(events_as_facts(spark, sf_dir), USERS, _seq(spark, sf_dir, S0)), "float64_value", 20, 60)


@query(f"WITH {EVENTS} SELECT {ROW_SQL} FROM facts WHERE valid_from > {T0 - 2 * DAY}")
def ttl_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.unexpired(events_as_facts(spark, sf_dir), T0, 2 * DAY).select(*ROW)


@query("SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS d FROM embeddings WHERE len(embedding) = 64) ORDER BY d, vec_id LIMIT 10")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), [0.0] * 64, 10).select("vec_id")
