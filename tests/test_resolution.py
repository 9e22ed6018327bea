import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom import errors
from factloom.operators import conflicts, graph, resolve, retention, scan
from factloom.schema import Family, conform, invalid_reason, validated

from .histories import event, frame, neighbours, resolved


def value_at(df):
    rows = df.collect()
    assert len(rows) <= 1
    return rows[0].valid_from if rows else None


def test_late_correction_wins_only_at_its_own_valid_time(spark):
    facts = frame(spark, [event(10, 1), event(30, 2), event(20, 3, "D"), event(20, 4)])
    for t, s, wanted in [(25, 1, 10), (25, 3, None), (25, 4, 20), (35, 4, 30)]:
        assert value_at(resolve.resolve(facts, t, s)) == wanted


def test_state_scan_filters_after_resolving(spark):
    facts = frame(spark, [event(10, 1, entity=8), event(10, 2), event(20, 3, "D"), event(30, 4)])
    spec = scan.ScanSpec(Family.VERTEX_STATE, valid_time=35, valid_from=(10, 10))
    assert [r.entity_id for r in scan.state_scan(facts, spec).collect()] == [8]


def test_event_scan_has_deletions_ranges_and_order(spark):
    facts = frame(spark, [event(10, 1, part=7), event(20, 2, "D", part=7), event(30, 3, part=7)])
    rows = scan.ordered(scan.event_scan(facts, scan.ScanSpec(Family.VERTEX_STATE, part_id=7), 2)).collect()
    assert [r.commit_seq for r in rows] == [2, 1]
    assert scan.state_scan(facts, scan.ScanSpec(Family.VERTEX_STATE, part_id=7, valid_time=35), 2).isEmpty()
    three = frame(spark, [event(v, c, entity=e) for e, v, c in [(8, 10, 1), (9, 20, 2), (10, 30, 3)]])
    spec = scan.ScanSpec(Family.VERTEX_STATE, entity=(9, 10), valid_from=(20, 30), commit_seq=(2, 2))
    assert [r.entity_id for r in scan.event_scan(three, spec).collect()] == [9]


@pytest.mark.parametrize(
    "spec",
    [scan.ScanSpec(1, property_id=1, valid_time=1), scan.ScanSpec(2, valid_time=1), scan.ScanSpec(1, valid_time=1, entity=(2, 1)), scan.ScanSpec(1, valid_time=1, batch_rows=0), scan.ScanSpec(9, valid_time=1), scan.ScanSpec(1)],
)
def test_bad_specs_are_refused(spark, spec):
    with pytest.raises(errors.InvalidArgument):
        scan.state_scan(frame(spark, []), spec)


def test_projections(spark):
    facts, spec = frame(spark, [event(10, 1)]), scan.ScanSpec(Family.VERTEX_STATE, valid_time=10)
    assert scan.state_scan(facts, spec, columns=["commit_seq", "entity_id"]).columns == ["commit_seq", "entity_id"]
    with pytest.raises(errors.NotSupported):
        scan.state_scan(facts, spec, columns=["storage_sequence"])
    for bad in ([], ["entity_id", "entity_id"], ["nothing"]):
        with pytest.raises(errors.InvalidArgument):
            scan.state_scan(facts, spec, columns=bad)


def test_batches_stop_early(spark):
    facts = frame(spark, [event(1, i + 1, entity=i + 1) for i in range(10)])
    rows = scan.event_scan(facts, scan.ScanSpec(Family.VERTEX_STATE))
    assert [b.num_rows for b in scan.in_batches(rows, 4)] == [4, 4, 2]
    assert len({b.schema for b in scan.in_batches(rows, 1)}) == 1  # also of batches in which a column is null
    seen = []
    assert not scan.visit(rows, lambda b: seen.append(b) or False, 4)
    assert len(seen) == 1


def test_neighbourhood_of_out_of_order_commits(spark):
    rows = [event(30, 1), event(10, 2), event(20, 3)]
    facts = frame(spark, rows)
    for t in (0, 10, 15, 20, 25, 30, 35):
        r = resolve.neighborhood(facts, t, 3).first()
        assert (r.observed, r.predecessor, r.successor) == neighbours(rows, t, 3)
    deleted = resolve.neighborhood(frame(spark, [event(10, 1), event(20, 2, "D"), event(30, 3)]), 25).first()
    assert (deleted.observed, deleted.observed_operation, deleted.predecessor, deleted.successor) == (20, 2, 20, 30)


histories = st.lists(st.tuples(st.integers(0, 6), st.sampled_from("PPD"), st.integers(1, 3)), min_size=1, max_size=14)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(histories)
def test_random_histories_follow_the_oracle(spark, history):
    rows = [event(v, i + 1, op, entity=e) for i, (v, op, e) in enumerate(history)]
    facts = frame(spark, rows).cache()
    last = len(rows)
    for t, s in itertools.product((0, 3, 6), (last // 2, last)):
        got = {r.entity_id: (r.valid_from, r.commit_seq) for r in resolve.resolve(facts, t, s).collect()}
        wanted = {e: resolved([r for r in rows if r["entity_id"] == e], t, s) for e in (1, 2, 3)}
        assert got == {e: (w["valid_from"], w["commit_seq"]) for e, w in wanted.items() if w}
    kept = retention.survivors(facts, last // 2)
    for t in (1, 5):
        before, after = ({(r.entity_id, r.valid_from, r.commit_seq) for r in resolve.resolve(f, t, last).collect()} for f in (facts, kept))
        assert before == after
    facts.unpersist()


@pytest.mark.parametrize("buckets", [1, 3])
def test_as_of_join(spark, buckets):
    rows = [event(v, c, op, entity=e) for e, v, c, op in [(1, 10, 1, "P"), (1, 20, 2, "D"), (1, 40, 3, "P"), (2, 5, 4, "P"), (2, 5, 5, "P")]]
    probes = [(0, 1, 0, e, t) for e in (1, 2, 3) for t in range(0, 60, 5)]
    asked = spark.createDataFrame(probes, "part_id long, fact_family int, property_id int, entity_id long, valid_time long")
    got = {(r.entity_id, r.valid_time): r.f_commit_seq for r in resolve.as_of_join(asked, frame(spark, rows), buckets=buckets).collect()}
    for e, t in got:
        w = resolved([r for r in rows if r["entity_id"] == e], t, 9)
        assert got[e, t] == (w and w["commit_seq"])
    assert len(got) == len(probes)


def edge_history():
    ends = dict(source_part_id=0, source_vertex_id=1, target_part_id=0, target_vertex_id=2, edge_type=7)
    edge = lambda v, c, op="P": event(v, c, op, entity=9, family=Family.EDGE_STATE)
    return [event(10, 1, entity=1), event(10, 1, entity=2), edge(10, 1), event(0, 1, entity=9, family=Family.EDGE_IDENTITY, **ends), event(10, 1, entity=9, family=Family.EDGE_PROPERTY, prop=7, value=99.0),
            event(20, 2, "D", entity=1), event(30, 3, entity=1), event(40, 4, "D", entity=2), event(45, 5, entity=2), edge(50, 6, "D")]


def test_edges_hide_with_their_endpoints(spark):
    facts = frame(spark, edge_history()).cache()
    seen = [not graph.visible_edges(facts, t).isEmpty() for t in (15, 25, 35, 42, 47, 55)]
    assert seen == [True, False, True, False, True, False]
    assert not graph.visible_edges(facts, 55, 1).isEmpty()
    assert graph.edge_properties(facts, 15).first().float64_value == 99 and graph.edge_properties(facts, 25).isEmpty()
    assert not graph.edge_states(facts, 25).isEmpty()  # the raw state doesn't look at endpoints
    assert graph.degrees(graph.out_edges(facts, 15)).first().degree == 1
    facts.unpersist()


def test_same_number_in_two_parts_is_two_entities(spark):
    facts = frame(spark, [event(10, 1, part=1, entity=1), event(10, 2, part=2, entity=1), event(20, 3, "D", part=1, entity=1)])
    assert [r.part_id for r in resolve.resolve(facts, 25).collect()] == [2]


def test_retention_keeps_baselines(spark):
    facts = frame(spark, [event(10, 1), event(20, 2), event(10, 3, "D"), event(10, 4)])
    assert sorted((r.valid_from, r.commit_seq) for r in retention.survivors(facts, 3).collect()) == [(10, 3), (10, 4), (20, 2)]
    gone = retention.survivors(frame(spark, [event(10, 1), event(10, 2, "D")]), 2)
    assert [(r.commit_seq, r.operation) for r in gone.collect()] == [(2, 2)]


def test_invalid_facts_say_why(spark):
    prop = dict(family=Family.VERTEX_PROPERTY, prop=3)
    bad = [event(1, 1, entity=0), event(1, 1, prop=3, family=Family.VERTEX_STATE), event(1, 1, value=None, **prop), event(1, 1, "D", **prop) | {"float64_value": 1.0}, event(1, 1, value=1.0, **prop) | {"schema_epoch": 0},
           event(0, 1, family=Family.EDGE_IDENTITY), event(1, 0), event(1, 1) | {"operation": 3}]
    assert all(r.why for r in frame(spark, bad).select(invalid_reason().alias("why")).collect())
    good = [event(1, 1), event(1, 1, "D", **prop), event(1, 1, value=2.0, **prop), *edge_history()]
    assert validated(conform(frame(spark, good))).count() == len(good)
    with pytest.raises(Exception, match="zero entity"):
        validated(frame(spark, bad[:1])).collect()


def test_entity_ranges_reach_the_scan_and_values_stay_above(spark, tmp_path):
    from factloom.sources.layout import read_facts, write_facts

    facts = frame(spark, [event(i % 5, i + 1, entity=i % 50 + 1, family=Family.VERTEX_PROPERTY, prop=1, value=float(i)) for i in range(500)])
    write_facts(facts, str(tmp_path / "facts"), partitions=2)
    stored = read_facts(spark, str(tmp_path / "facts"))
    assert stored.count() == 500
    spec = scan.ScanSpec(Family.VERTEX_PROPERTY, 1, valid_time=4, entity=(10, 20), valid_from=(2, 4))
    plan = scan.state_scan(stored, spec)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[-1].split("ReadSchema")[0]
    assert "entity_id,10" in pushed and "valid_from,2" not in pushed and "fact_family" in plan.split("PartitionFilters")[-1].split("PushedFilters")[0]


def test_captured_neighbours_and_conflicts_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [event(rng.randrange(40), c, rng.choice("PPD"), entity=rng.choice([1, 1, 1, 2, 3])) for c in range(1, 121)]
    facts = frame(spark, rows).repartition(3)
    writes = sorted({(rng.choice([1, 2, 3, 4]), rng.randrange(-1, 42), rng.choice([50, 80])) for _ in range(60)})
    key = ["CAST(0 AS BIGINT) AS part_id", "1 AS fact_family", "0 AS property_id", "entity_id"]
    found = None
    for base in (50, 80):
        mine = spark.createDataFrame([w for w in writes if w[2] == base], "entity_id long, valid_from long, snapshot_seq long").selectExpr(*key, "valid_from", "snapshot_seq")
        part = conflicts.capture(mine, facts, base)
        found = part if found is None else found.unionByName(part)
    seen = {(r.entity_id, r.valid_from, r.snapshot_seq): r for r in found.collect()}
    assert set(seen) == set(writes)
    wanted = {}
    for w, r in seen.items():
        entity, t, base = w
        chain = [x for x in rows if x["entity_id"] == entity]
        assert (r.observed, r.predecessor, r.successor) == neighbours(chain, t, base)
        last = max(((x["valid_from"], x["commit_seq"]) for x in chain if x["valid_from"] <= t and x["commit_seq"] <= base), default=(None, None))
        assert (r.observed, r.observed_commit) == last
        hit = [x["commit_seq"] for x in chain if x["commit_seq"] > base and (r.predecessor is None or x["valid_from"] >= r.predecessor) and (r.successor is None or x["valid_from"] < r.successor)]
        if hit:
            wanted[w] = (min(hit), len(hit))
    got = {(r.entity_id, r.valid_from, r.snapshot_seq): (r.first_conflict, r.events) for r in conflicts.write_conflicts(found, facts).collect()}
    assert got == wanted


def test_one_edge_is_looked_up_by_its_own_chains(spark, tmp_path):
    from factloom.sources.database import Database
    from factloom.schema import Family

    db = Database(spark, str(tmp_path / "db"))
    t = db.begin()
    for v in (1, 2, 3):
        t.assert_vertex(0, v, 10)
    t.assert_edge(0, 9, 10, (0, 1, 0, 2, 7))
    t.commit()
    with db.snapshot() as s:
        assert s.exists(Family.EDGE_STATE, 0, 9, 10) and not s.exists(Family.EDGE_STATE, 0, 9, 5) and not s.exists(Family.EDGE_STATE, 0, 8, 10)
        requests = spark.createDataFrame([(1, 0, 4, 9), (2, 0, 1, 3), (3, 0, 1, 4), (4, 0, 4, 9)], "pos int, part_id long, fact_family int, entity_id long")
        assert [r.exists for r in s.multi_exists(requests, 10).orderBy("pos").collect()] == [True, True, False, True]
    db.close()
