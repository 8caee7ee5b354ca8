"""Every query with an SQL equivalent against DuckDB on the smallest tables, apart from the corpus operators."""

import collections
import hashlib
import math
import re

import duckdb
import pytest

import __spark_entry__
from lodestone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].round(6) if df[c].dtype.kind == "f" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))
    else:
        assert len(got)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10


def test_chunk_headings_against_greedy_sections(spark):
    """Plain paragraphs under headings, grouped greedily section by section; conversations with markdown in them are left out."""
    marker = re.compile(r"^\s{0,3}([-+*>#=`~_<|]|\d{1,9}[.)])|^(    |\t)", re.MULTILINE)
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    got = collections.defaultdict(list)
    for r in QUERIES["chunk_headings"](spark, SF).collect():
        got[r.conv_id].append((r.ordinal, r.path, r.content_hash))
    plain_ones = [c for c, rows in turns.items() if not any(marker.search(text) for _, _, text in rows) and len({t for t, _, _ in rows}) == len(rows)]
    assert len(plain_ones) > 10
    for conv in plain_ones:
        want = []
        for turn, role, text in sorted(turns[conv]):
            groups = []
            for block in (b.rstrip() for b in re.split(r"\n\s*\n", text) if b.strip()):
                block = block.lstrip("\n")
                if groups and math.ceil(len(f"{groups[-1]}\n\n{block}") / 3.5) <= 400:
                    groups[-1] = f"{groups[-1]}\n\n{block}"
                else:
                    groups.append(block)
            heads = [f"conv {conv}", f"{turn} {role}"]
            want += [(" > ".join(heads), hashlib.sha256(("\x1f".join(heads) + "\n" + g).encode()).hexdigest()) for g in groups]
        assert [(p, h) for _, p, h in sorted(got[conv])] == want
