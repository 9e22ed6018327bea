import random

from pyspark.sql import functions as F

from factloom.functions.latency import moving_average, moving_averages, percentiles
from factloom.functions.values import same_value, typed_view, value_text
from factloom.operators import conflicts, merges
from factloom.schema import KEY, Family, ValueType

from .histories import event, frame

LANES = [("bool_value", 1, True), ("int32_value", 2, -7), ("int64_value", 3, -9), ("float32_value", 4, 1.5), ("float64_value", 5, -2.25), ("timestamp64_value", 6, 42), ("bytes_value", 7, b"maple"), ("bytes_value", 8, b"a\0b")]


def test_all_value_lanes(spark):
    rows = [event(10, 1, part=7, family=Family.VERTEX_PROPERTY, prop=i, kind=i, lane=lane, value=value) for lane, i, value in LANES]
    facts = frame(spark, rows)
    got = {r.property_id: r for r in facts.collect()}
    assert all(got[i][lane] == value and sum(got[i][n] is not None for n, _, _ in LANES[:7]) == 1 for lane, i, value in LANES)
    assert typed_view(facts, None, 7, "name", ValueType.STRING).first().name == "maple"
    assert {r.t for r in facts.select(value_text().alias("t")).collect()} >= {"true", "-7", "42", "610062"}


def test_nan_equals_nothing(spark):
    prop = dict(family=Family.VERTEX_PROPERTY, prop=1)
    pairs = [(float("nan"), float("nan"), False), (0.0, -0.0, True), (1.0, 1.0, True), (1.0, 2.0, False)]
    for a, b, wanted in pairs:
        x, y = (frame(spark, [event(1, 1, value=v, **prop)]).select(F.struct("*").alias(n)) for v, n in ((a, "x"), (b, "y")))
        assert x.crossJoin(y).select(same_value("x", "y").alias("e")).first().e is wanted


def test_percentiles_by_bucket_bounds(spark):
    df = spark.createDataFrame([(0, x) for x in (1, 11, 60, 101, 10**6)], "k int, us long")
    got = {r.percentile: r.value for r in percentiles(df, ["k"], "us", [0, 50, 80, 100]).collect()}
    assert got == {0: 10, 50: 100, 80: 250, 100: 10**6}


def test_moving_average(spark):
    got = spark.range(1).select(moving_average(F.array(*(F.lit(x) for x in (0, 80, 160, 8)))).alias("a")).first().a
    assert got == 80 - 10 + 20 - (80 - 10 + 20) // 8 + 1


def test_moving_averages_equal_those_of_arrays(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 0, rng.randrange(10**6)])) for k in range(7) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(3)
    wanted = {}
    for k, _, v in sorted(rows, key=lambda r: r[:2]):
        old, v = wanted.get(k, 0), v or 0
        wanted[k] = v if old == 0 else old - old // 8 + v // 8
    assert {r.k: r.average for r in moving_averages(df, ["k"], "i", "v").collect()} == wanted
    assert moving_averages(df.limit(0), ["k"], "i", "v").count() == 0


def test_merges(spark):
    df = spark.createDataFrame([(1, 2**62, "b", b"\x01\x02", "3,1"), (2, 2**62, "a", b"\xff", "2"), (3, 2**62, None, b"", ""), (4, 2**62, "c", None, None)], "seq int, n long, s string, x binary, l string")
    r = df.groupBy().agg(merges.add_uint64("n").alias("n"), merges.last_put("s", "seq").alias("p"), merges.append_strings("s", "seq").alias("a"), merges.max_bytes("s").cast("string").alias("m"), merges.sort_lists("l").alias("l")).first()
    assert (int(r.n), r.p, r.a, r.m, r.l) == (0, "c", "b,a,c", "c", "1,2,3")
    assert bytes(merges.xor_bytes(df.withColumn("k", F.lit(1)), ["k"], "x").first().x) == b"\xfe\x02"
    named = df.select(F.lit(1).alias("k"), F.lit("max").alias("f"), "n", "seq")
    assert merges.named_aggregate(named, ["k"], "f", "n", "seq").first().n == 2**62
    own = {"double": lambda v, s: 2 * F.max_by(v, s)}
    assert merges.named_aggregate(df.select("seq", F.lit("double").alias("f"), (F.col("n") / 2**60).cast("long").alias("n")), ["f"], "f", "n", "seq", own).first().n == 8
    assert merges.named_aggregate(named.withColumn("f", F.lit("none of them")), ["k"], "f", "n", "seq").first().n is None


def test_bytes_xor_of_any_length(spark):
    rng = random.Random(2)
    rows = [(k, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 30])))) for k in range(6) for _ in range(8)] + [(9, None)]
    wanted = {}
    for k, x in rows:
        if x is not None:
            a = wanted.get(k, b"")
            n = max(len(a), len(x))
            wanted[k] = bytes(p ^ q for p, q in zip(a.ljust(n, b"\0"), x.ljust(n, b"\0")))
    got = {r.k: None if r.x is None else bytes(r.x) for r in merges.xor_bytes(spark.createDataFrame(rows, "k int, x binary"), ["k"], "x").collect()}
    assert {k: got[k] for k in wanted} == wanted and not got[9]


def test_groups_and_blind_appends(spark):
    rows = [(1, 0, 1, 0, 5), (2, 0, 1, 0, 5), (3, 0, 1, 0, 6)]
    staged = spark.createDataFrame(rows, ["txn_id", *KEY])
    assert [tuple(r) for r in conflicts.footprints(staged).orderBy("txn_id").collect()] == [(1, 1, 0, None), (2, 1, 1, 1), (3, 1, 0, None)]
    rng = random.Random(3)
    rows = [(rng.randrange(200), 0, 1, 0, rng.choice([1, 1, 1, rng.randrange(30)])) for _ in range(400)]
    chains: dict = {}
    for txn, *key in sorted(set(rows)):
        chains.setdefault(tuple(key), []).append(txn)
    wanted: dict = {}
    for txns in chains.values():
        for before, txn in zip([None, *txns], txns):
            n, shared, after = wanted.get(txn, (0, 0, None))
            wanted[txn] = (n + 1, shared + (before is not None), max((x for x in (after, before) if x is not None), default=None))
    got = {r.txn_id: (r.chains, r.shared, r.after) for r in conflicts.footprints(spark.createDataFrame(rows, ["txn_id", *KEY])).collect()}
    assert got == wanted
    kinds = spark.createDataFrame([(1, 1, 1, None, None, False), (2, 1, 2, None, None, False), (3, 1, 1, 5, None, False)], "txn_id int, fact_family int, operation int, predecessor long, successor long, strict boolean")
    assert {r.txn_id: r.blind for r in conflicts.blind_appends(kinds).collect()} == {1: True, 2: False, 3: False}
