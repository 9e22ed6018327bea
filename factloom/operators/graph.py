"""Edges: identity, raw state, visibility through both endpoints, and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.resolve import resolve, seen
from factloom.schema import EDGE_ENDS, Family

EDGE = ["part_id", "entity_id"]


def of_family(facts: DataFrame, family: Family) -> DataFrame:
    return facts.where(F.col("fact_family") == int(family))


def edge_identity(facts: DataFrame, commit_seq: int | None = None) -> DataFrame:
    """part_id, entity_id and ends of each edge known at the commit: its first identity."""
    rows = seen(of_family(facts, Family.EDGE_IDENTITY), commit_seq)
    return rows.groupBy(*EDGE).agg(F.min_by(F.struct(*EDGE_ENDS, "commit_seq"), "commit_seq").alias("i")).select(*EDGE, *(F.col(f"i.{c}").alias(c) for c in EDGE_ENDS), F.col("i.commit_seq").alias("commit_seq"))


def live_vertices(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    return resolve(of_family(facts, Family.VERTEX_STATE).select("part_id", "entity_id", "valid_from", "commit_seq", "operation"), valid_time, commit_seq, EDGE).select(*EDGE)


def edge_states(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """Edges whose own state holds; endpoints aren't looked at."""
    return resolve(of_family(facts, Family.EDGE_STATE).select("part_id", "entity_id", "valid_from", "commit_seq", "operation"), valid_time, commit_seq, EDGE)


def live_edges(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """part_id, entity_id, ends and valid_from of edges whose own state holds and whose identity is known.

    State and identity come out of one pass and one shuffle.
    """
    rows = seen(facts.where(F.col("fact_family").isin(int(Family.EDGE_STATE), int(Family.EDGE_IDENTITY))), commit_seq)
    state = (F.col("fact_family") == int(Family.EDGE_STATE)) & (F.col("valid_from") <= valid_time)
    identity = F.col("fact_family") == int(Family.EDGE_IDENTITY)
    held = F.max_by(F.when(state, F.struct("valid_from", "operation")), F.when(state, F.struct("valid_from", "commit_seq")))
    ends = F.min_by(F.when(identity, F.struct(*EDGE_ENDS)), F.when(identity, F.col("commit_seq")))
    met = rows.groupBy(*EDGE).agg(held.alias("_s"), ends.alias("_i")).where((F.col("_s.operation") == 1) & F.col("_i").isNotNull())
    return met.select(*EDGE, "_i.*", "_s.valid_from")


def with_live_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Those of ``edges`` of which both ends are among ``vertices`` (part_id, entity_id): one join for both ends."""
    columns = edges.columns
    end = lambda which: F.struct(F.col(f"{which}_part_id").alias("part_id"), F.col(f"{which}_vertex_id").alias("entity_id"))
    rows = edges.select(F.struct(*columns).alias("_e"), F.explode(F.array(end("source"), end("target"))).alias("_v")).select("_e", "_v.*")
    met = rows.join(vertices, EDGE, "left_semi").groupBy(*(F.col(f"_e.{c}").alias(c) for c in EDGE)).agg(F.count("*").alias("_n"), F.first("_e").alias("_e"))
    return met.where("_n = 2").select("_e.*")


def visible_edges(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """Edges with ends that can be seen: the state holds, the identity is known, and both vertices live, all at one time.

    A vertex is named by part and id together. Nothing cascades: an edge hides while an endpoint is gone and shows again.
    """
    return with_live_ends(live_edges(facts, valid_time, commit_seq), live_vertices(facts, valid_time, commit_seq)).select(*EDGE, *EDGE_ENDS, "valid_from")


def edge_properties(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """Property events that hold, of edges that can be seen."""
    live = resolve(of_family(facts, Family.EDGE_PROPERTY), valid_time, commit_seq)
    return live.join(visible_edges(facts, valid_time, commit_seq).select(*EDGE), EDGE, "left_semi")


def multi_exists(facts: DataFrame, requests: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """``requests`` (pos, part_id, fact_family 1 or 4, entity_id; duplicates allowed) with ``exists``; edges count when they can
    be seen. Only the chains that are asked for, and those of the ends of requested edges, are resolved."""
    wanted = requests.select("fact_family", *EDGE).distinct()
    of = lambda family: wanted.where(F.col("fact_family") == int(family)).select(*EDGE)
    edges = live_edges(facts.where(F.col("fact_family").isin(int(Family.EDGE_STATE), int(Family.EDGE_IDENTITY))).join(of(Family.EDGE_STATE), EDGE, "left_semi"), valid_time, commit_seq)
    end = lambda which: F.struct(F.col(f"{which}_part_id").alias("part_id"), F.col(f"{which}_vertex_id").alias("entity_id"), F.col("part_id").alias("_part"), F.col("entity_id").alias("_edge"))
    ends = edges.select(F.explode(F.array(end("source"), end("target"))).alias("_v")).select("_v.*")
    # Who asks for each vertex: itself, or an edge; those that live are told apart by it again.
    asked = of(Family.VERTEX_STATE).withColumns({"_part": F.lit(None).cast("long"), "_edge": F.lit(None).cast("long")}).unionByName(ends)
    states = of_family(facts, Family.VERTEX_STATE).join(asked.select(*EDGE).distinct(), EDGE, "left_semi")
    live = asked.join(live_vertices(states, valid_time, commit_seq), EDGE, "left_semi")
    edge = F.col("_edge").isNotNull()
    found = live.groupBy(F.when(edge, int(Family.EDGE_STATE)).otherwise(int(Family.VERTEX_STATE)).alias("fact_family"), F.when(edge, F.col("_part")).otherwise(F.col("part_id")).alias("part_id"), F.when(edge, F.col("_edge")).otherwise(F.col("entity_id")).alias("entity_id")).agg(F.count("*").alias("_n"))
    found = found.where((F.col("fact_family") == int(Family.VERTEX_STATE)) | (F.col("_n") == 2)).withColumn("_live", F.lit(True)).drop("_n")
    return requests.join(found, ["part_id", "fact_family", "entity_id"], "left").select("pos", "part_id", "fact_family", "entity_id", F.coalesce("_live", F.lit(False)).alias("exists"))


def out_edges(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """Visible edges by source vertex (an extension)."""
    e = visible_edges(facts, valid_time, commit_seq)
    return e.select(F.col("source_part_id").alias("part_id"), F.col("source_vertex_id").alias("vertex_id"), "edge_type", F.col("part_id").alias("edge_part_id"), F.col("entity_id").alias("edge_id"), F.col("target_part_id").alias("other_part_id"), F.col("target_vertex_id").alias("other_id"))


def in_edges(facts: DataFrame, valid_time: int, commit_seq: int | None = None) -> DataFrame:
    """Visible edges by target vertex (an extension)."""
    e = visible_edges(facts, valid_time, commit_seq)
    return e.select(F.col("target_part_id").alias("part_id"), F.col("target_vertex_id").alias("vertex_id"), "edge_type", F.col("part_id").alias("edge_part_id"), F.col("entity_id").alias("edge_id"), F.col("source_part_id").alias("other_part_id"), F.col("source_vertex_id").alias("other_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges of each vertex, from out_edges() or in_edges()."""
    return edges.groupBy("part_id", "vertex_id").agg(F.count("*").alias("degree"))
