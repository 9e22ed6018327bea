"""The pipeline's stages on their own input, and the registered queries that have SQL."""

import duckdb
import pytest

import corpus_pipeline
from factloom.llm import queries
from tests.conftest import MEDIUM, SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_keep_columns_and_only_what_came(stages):
    docs, kept, unique, redacted, mixed, packed = stages
    for before, after in ((docs, kept), (kept, unique), (unique, redacted), (redacted, mixed)):
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()
    assert 0 < mixed.count() <= redacted.count() == unique.count() < kept.count() <= docs.count()
    assert unique.select("text").distinct().count() == unique.count()
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, rate string, secret_spans string, quality_score string, label string, t string, document string"


def odd_rows():
    good = "The committee met again on Tuesday and read the letter, which had come late. Nobody answered it at first."
    other = "A storm came down from the hills in the night, and in the morning the road was gone, with both of its bridges."
    clash = ("a", "b", "c", "d", "e", "f")
    rows = [
        (None, None, None, None, None), (None, good, "en", "s", 9), (1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (1, other, None, None, None),
        (2, "", "en", "s", 0), (3, None, None, "s", None), (4, f"{other} password=hunter2hunter2", "en", None, 7), (5, f"{good} Then they all went home. " * 800, "en", "s", -1), (6, "x", "xx", "", 1),
    ]
    return [r + clash for r in rows]


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, shared ids, clashing names; and empty tables."""
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    plain = sorted(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns, name
        rows = got.collect()
        if name in ("quality", "mixing"):  # whole rows of what came, as often
            assert not [r for r in set(map(str, rows)) if sorted(map(str, rows)).count(r) > plain.count(r)]
        assert all((r.rate, r.secret_spans, r.quality_score, r.label, r.t, r.document) == ("a", "b", "c", "d", "e", "f") for r in rows)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in unique) == sorted((d or 0, len(t or "")) for d, t in {(r[0], r[1]) for r in odd_rows()} if d not in (3, 4))  # empty like 2, near to 1
    redacted = corpus_pipeline.redact_secrets(spark, docs, SMALL).collect()
    assert len(redacted) == len(plain) and not [r for r in redacted if "hunter2" in (r.text or "")]
    assert [r.n_chars for r in redacted if r.doc_id == 4] == [len(r.text) for r in redacted if r.doc_id == 4] and [r.n_chars for r in redacted if r.doc_id == 5] == [-1]
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id is None) >= 2 and sum(r.start == 0 for r in packed) == len(plain)
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SMALL).count() == 0


def test_stages_need_no_more_than_id_and_text(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more of it, {i} times over") for i in range(12)], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SMALL).columns == ["doc_id", "text"]


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = stages[0].join(labels.where("quality = 1"), "doc_id")
    lost = clean.join(stages[1], "doc_id", "left_anti").count()
    assert lost <= 0.05 * clean.count()  # some 60 labels for the fit
    junk = stages[0].join(labels.where("quality = 0"), "doc_id")
    assert junk.join(stages[1], "doc_id", "left_semi").count() <= 0.1 * junk.count()


def test_mixing_takes_from_the_toxic_and_not_from_the_clean(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    share = lambda toxic: (lambda a: a.join(stages[4], "doc_id", "left_semi").count() / max(1, a.count()))(stages[3].join(labels.where(f"toxic = {toxic}"), "doc_id"))
    assert share(0) > 0.95 and share(1) < 0.6


def test_secrets_are_gone(spark, stages):
    from factloom.llm.secrets import scan_secrets

    again = scan_secrets(stages[3]).where("size(filter(secret_spans, s -> s.kind < 3)) > 0")
    assert again.isEmpty()
    assert stages[3].where("n_chars <> length(text)").isEmpty()


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{MEDIUM}/{t}.parquet'")
    got = queries.QUERIES[name](spark, MEDIUM)
    wanted = con.sql(queries.ORACLE[name])
    at = [wanted.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in wanted.fetchall())
