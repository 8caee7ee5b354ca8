"""Bucketed tables, indexes, meters, and what the engine reports beside hits."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.errors import Conflict
from lodestone.functions import text
from lodestone.meters import Meters
from lodestone.operators import evaluation, fusion, lexical, vectors
from lodestone.sources.tables import Tables

JOB = "id string, tenant_id string, kind string, state string, processed int, total int, errors array<string>, created_at timestamp, updated_at timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}", 4)


def jobs(spark, rows):
    return spark.createDataFrame([(i, "t", "k", s, 0, 0, [], None, None) for i, s in rows], JOB)


def test_only_touched_buckets_are_written(spark, tables):
    tables.upsert("jobs", jobs(spark, [(str(i), "a") for i in range(40)]))
    before = tables.versions("jobs")
    assert set(before) == {0, 1, 2, 3} and tables.read("jobs").count() == 40
    tables.upsert("jobs", jobs(spark, [("7", "b"), ("7", "b")]))
    after = tables.versions("jobs")
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and changed == tables.touched(spark.createDataFrame([("7",)], "id string"))
    assert {r.id: r.state for r in tables.read("jobs").collect()} == {str(i): "b" if i == 7 else "a" for i in range(40)}
    assert tables.read("jobs", changed).where("id = '7'").count() == 1
    tables.append_missing("jobs", jobs(spark, [("7", "c"), ("99", "c")]))
    assert {r.state for r in tables.read("jobs").where("id IN ('7', '99')").collect()} == {"b", "c"}
    tables.delete("jobs", spark.createDataFrame([(str(i),) for i in range(40)], "id string"))
    assert [r.id for r in tables.read("jobs").collect()] == ["99"]
    # the number of buckets is that of the folder
    assert Tables(spark, tables.root, 9).buckets == 4


def test_second_writer_fails(spark, tables):
    tables.upsert("jobs", jobs(spark, [("1", "a")]))
    held = tables.versions("jobs")
    tables.upsert("jobs", jobs(spark, [("1", "b")]))
    with pytest.raises(Conflict):
        tables._replace("jobs", jobs(spark, [("1", "c")]), list(held), held)
    assert tables.read("jobs").first().state == "b"


def test_old_versions_go(spark, tables):
    for s in "abcde":
        tables.upsert("jobs", jobs(spark, [("1", s)]))
    kept = sorted(p.rpartition("=")[2] for p in tables._names(f"{tables.root}/jobs/b=*/v=*"))
    assert kept == ["3", "4"] and tables.read("jobs").first().state == "e"


def test_index_reads_only_its_buckets(spark, tables):
    grams = lexical.trigram_table(spark.createDataFrame([("1", "nation and notion"), ("2", "other")], "chunk_id string, content string"))
    tables.append("trigrams", grams)
    tables.append("trigrams", grams.where("chunk_id = '2'"))
    found = tables.lookup("trigrams", ["ion", "nat"])
    assert {(r.chunk_id, r.gram) for r in found.collect()} == {("1", "ion"), ("1", "nat")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    tables.compact("trigrams", spark.createDataFrame([("2",)], "id string"))
    assert {r.chunk_id for r in tables.read("trigrams").collect()} == {"2"}
    assert tables.read("trigrams").count() == grams.where("chunk_id = '2'").count()


def test_fuzzy_with_and_without_index(spark):
    texts = ["a national park", "nothing of the kind", "rations for the nation", "NATION!", None, "notion ration"]
    rows = spark.createDataFrame(list(map(lambda x: (str(x[0]), x[1]), enumerate(texts))), "chunk_id string, content string")
    terms = [("q", "nation"), ("r", "ration"), ("r", "of")]
    want = {}
    for q, t in terms:
        for i, x in enumerate(texts):
            if len(t) >= 4 and (s := text.word_similarity(t, x or "")) >= 0.4:
                want[q, str(i)] = max(want.get((q, str(i)), 0), round(s, 9))
    for grams in (None, lexical.trigram_table(rows)):
        got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in lexical.fuzzy_hits(rows, grams, terms, 0.4).collect()}
        assert got == want


def test_nearest_in_blocks(spark, monkeypatch):
    """Several blocks of queries, ties, other lengths, nulls and zeros."""
    made = [(str(i), 0, [math.sin(i * j + 1) for j in range(5)]) for i in range(60)] + [("dup", 0, [math.sin(j * 3 + 1) for j in range(5)]), ("zero", 0, [0.0] * 5), ("null", 0, None), ("short", 0, [1.0, 2.0]), ("nan", 0, [float("nan")] * 5)]
    rows = spark.createDataFrame(made, "chunk_id string, ordinal int, embedding array<float>")
    asked = spark.createDataFrame([(i, made[i][2]) for i in range(10)] + [(50, [0.0] * 5), (51, None), (52, [1.0, 1.0])], "query_id int, q array<float>")
    one = {(r.query_id, r.chunk_id): round(r.score, 6) for r in vectors.nearest(rows, asked, 4).collect()}
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "ROWS", 2)
    assert {(r.query_id, r.chunk_id): round(r.score, 6) for r in vectors.nearest(rows, asked, 4).collect()} == one
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    good = [(c, v) for c, _, v in made if v and len(v) == 5 and any(v) and v[0] == v[0]]
    for q in range(10):
        best = sorted(((-round(cosine(v, made[q][2]), 6), c) for c, v in good))[:4]
        assert sorted(best) == sorted((-s, c) for (i, c), s in one.items() if i == q)
    assert {c for q, c in one if q == 52} == {"short"} and not [q for q, _ in one if q in (50, 51)]


def test_detail_budget(spark):
    fused = spark.createDataFrame([("q", f"c{i}", 0, 1.0 / (i + 1), 1 if i % 3 == 0 else None) for i in range(12)], "query_id string, chunk_id string, ordinal int, score double, lexical_rank int")
    assert {r.chunk_id for r in fusion.within_budget(fused, 2, ["query_id"]).collect()} == {"c0", "c3", "c6", "c9", "c1", "c2"}


def test_report_names_failures(spark):
    cases = spark.createDataFrame([("1", "menu", ["a"], 1), ("2", "door", ["b"], 3)], "case_id string, query string, expect array<string>, max_rank int")
    results = spark.createDataFrame([("1", 1, "x"), ("1", 2, "a"), ("1", 3, "y"), ("1", 4, "z"), ("2", 1, "b")], "case_id string, position int, external_key string")
    got = evaluation.report(evaluation.case_ranks(cases, results)).first()
    assert got.failures == ["menu expected a got x,a,y"] and not got.meets


def test_vector_literal(spark):
    shown = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<double>").select(text.vector_literal(F.col("v")).alias("x")).collect()
    assert [r.x for r in shown] == ["[1.5,-2.0]", None]
    for bad in ([], [float("nan")], [float("inf")], [None]):
        with pytest.raises(Exception, match="finite numbers"):
            spark.createDataFrame([(bad,)], "v array<double>").select(text.vector_literal(F.col("v"))).collect()


def test_meters():
    m = Meters("x")
    m.count("calls", mode='a"b')
    m.count("calls", 2, mode='a"b')
    m.gauge("depth", 4)
    m.took("search", 0.5)
    assert 'x_calls_total{mode="a\\"b"} 3' in m.text() and "x_depth 4" in m.text() and "# TYPE x_search_seconds_sum counter" in m.text()
