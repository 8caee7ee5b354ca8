"""Lexical queries against their SQL on texts with more places of a lexeme, and beyond more words, than a stored index keeps."""

import re

import duckdb
import pytest

from lodestone.functions.normalise import Registry
from lodestone.functions.stemming import lexeme
from lodestone.operators import lexical
from lodestone.plans.queries import ORACLES, QUERIES
from test_queries import plain


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    far = "word " * 16_500
    texts = ["the with " * 300, "the with " * 400, far + "with of the with the", "of it " * 300 + "of the", far + "de la", "with the", "of the with", "of a the"]
    rows = [(i, s, "en", "s", len(s)) for i, s in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    assert len(want) and plain(got).equals(plain(want))


def test_single_term_counts_every_place(spark, long_texts):
    same_as_sql(spark, long_texts, "lexical_single_term")


def test_phrase_is_found_at_any_place(spark, long_texts):
    same_as_sql(spark, long_texts, "lexical_phrase")


def test_mixed_query_finds_phrases_at_any_place(spark, long_texts):
    same_as_sql(spark, long_texts, "lexical_mixed")


def test_top10_ranks_by_every_place(spark, long_texts):
    same_as_sql(spark, long_texts, "lexical_top10")


def test_stored_index_carries_no_text_and_deals_nothing(spark):
    """Token arrays copied into the row of each token made the work grow with the square of a text."""
    rows = [("1", "en", "The cats and dogs were running, cats run. " * 200), ("2", "de", "und die Katze"), ("3", "en", ""), ("4", "en", "the word " * 9_000 + "far away")]
    chunks = spark.createDataFrame([(i, loc, s, s, "h") for i, loc, s in rows], "chunk_id string, locale string, source string, content string, normalizer_hash string")
    made = lexical.stored_postings(chunks, Registry(), keep=("normalizer_hash",))
    grams = lexical.stored_trigrams(chunks)
    for df in (made, grams):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "ArrowEvalPython" not in plan
    got = {(r.chunk_id, r.lexeme): [(e.place, e.weight) for e in r.entries] for r in made.collect()}
    want = {}
    for i, loc, s in rows:
        for at, w in enumerate(re.findall(r"[a-z]+", s.lower()), 1):
            if (w := lexeme(w, "english" if loc == "en" else None)) is not None:
                want.setdefault((i, w), []).append((min(at, 16_383), "A"))
    assert got == {k: v[:256] for k, v in want.items()}
    assert {tuple(r) for r in grams.collect()} == {tuple(r) for r in lexical.trigram_table(chunks).collect()}
    assert grams.count() == grams.distinct().count()
