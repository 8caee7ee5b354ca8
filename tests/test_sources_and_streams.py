from pyspark.sql import functions as F

from lodestone.sources.documents import from_bodies, golden_sets, json_documents, markdown_folder
from lodestone.streaming import windows


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "tr" / "deep").mkdir(parents=True)
    (tmp_path / "tr" / "deep" / "menu.md").write_text("---\nTitle: \"Menüler\"\nsection: a\nsection: b\n---\n# Başlık\n\nMetin")
    (tmp_path / "tr" / "plain.md").write_text("# First heading\n\ntext")
    (tmp_path / "loose.md").write_text("skipped")
    (tmp_path / "bad tag").mkdir()
    (tmp_path / "bad tag" / "x.md").write_text("skipped")
    got = {r.external_key: r for r in markdown_folder(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"menu", "plain"}
    assert (got["menu"].title, got["menu"].locale, got["menu"].metadata, got["menu"].content) == ("Menüler", "tr", '{"section":"b"}', "# Başlık\n\nMetin")
    assert got["plain"].title == "First heading" and got["menu"].source_uri == "tr/deep/menu.md"


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"externalKey":"k","locale":"en","content":"c","metadata":{"a":1}}\n')
    row = json_documents(spark, str(tmp_path / "d.json")).first()
    assert (row.title, row.metadata) == ("k", '{"a":1}')
    (tmp_path / "g.json").write_text('{"collection":"c","locale":"tr","cases":[{"query":"q","expect":["k"]},{"query":"r","expect":["k"],"maxRank":1}]}')
    assert [(r.case_id, r.max_rank) for r in golden_sets(spark, str(tmp_path / "g.json")).collect()] == [(0, 3), (1, 1)]
    assert from_bodies(spark.createDataFrame([], "externalKey string, locale string, title string, content string, sourceUri string, metadata string, sourceLocale string, sourceContentHash string")).count() == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = windows.request_counts(stream, width="6 hours", late="1 day")
    q = counted.writeStream.format("memory").queryName("requests").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("requests").agg(F.sum("requests")).first()[0] == events.count()
    seen = []
    worker = windows.start_backlog_worker(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    worker.awaitTermination(120)
    assert sum(seen) == events.count()
