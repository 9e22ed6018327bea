from factloom.operators.resolve import resolve
from factloom.schema import Family
from factloom.sources.layout import changes
from factloom.streaming.feed import append_stream, latest_state, read_stream, since

from .histories import event, frame


def test_stream_keeps_late_facts_and_follows_the_latest(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    prop = dict(family=Family.VERTEX_PROPERTY, prop=1)
    first = [event(30, 1, value=3.0, **prop), event(10, 2, value=1.0, **prop)]
    late = [event(20, 3, value=2.0, **prop), event(30, 4, "D", **prop)]
    frame(spark, first).write.parquet(f"{source}/a")
    append_stream(read_stream(spark, source), table, str(tmp_path / "c1")).awaitTermination()
    frame(spark, late).write.parquet(f"{source}/b")
    append_stream(read_stream(spark, source), table, str(tmp_path / "c1")).awaitTermination()
    stored = spark.read.parquet(f"{table}/*")
    assert stored.count() == 4 and since(stored, 2).count() == 2
    assert resolve(stored, 25).first().float64_value == 2.0 and resolve(stored, 30).isEmpty()
    feed = {r.commit_seq: r.n_facts for r in changes(stored, 1, 3).collect()}
    assert feed == {2: 1, 3: 1}
    query = latest_state(read_stream(spark, source)).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.sql("SELECT * FROM latest ORDER BY valid_from DESC, commit_seq DESC").first()
    assert (last.valid_from, last.commit_seq, last.operation) == (30, 4, 2)
