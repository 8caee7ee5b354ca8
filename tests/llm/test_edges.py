"""Defined results of the corpus operators for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import ann, chat, common, decontam, langid, linededup, packing, quality, simhash, suffixdedup, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of columns that the operators use within, now or earlier.
CLASHING = """_score _text_hash fp runs h kept label row row_key n_dropped _n_dropped _n_lines _runs _lines _row_key mark n_hit _mark _n_hit
    d th k1 k2 spans done _repeats _difference _text _m _group id keep_id keep_hash _keep_id _keep_hash text_hash n a u1 u2 _label _lang _fold""".split()
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank, long, repeated and tied rows, and extra columns named like internal ones."""
    rows = [
        (1, None, "en", None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t", None, "a", 5),
        (4, "The cat sat on the mat. İΣ ﷽ 😀", "en", "a", 1),
        (4, "The cat sat on the mat. İΣ ﷽ 😀", "en", "a", 1),
        (5, "The cat sat on the mat. İΣ ﷽ 😀", "fr", "b", 1),
        (None, "no id here, but a text", "fr", None, 1),
        (6, LONG, "en", "a", 1),
        (7, "!!! 123 ???", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"{n} AS {c}" for n, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, None), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_language_id(odd, none):
    got = langid.op2_language_id(odd).collect()
    assert len(got) == 9
    for r in got:
        text_is_odd = r.doc_id in (1, 2, 3, 7)
        assert (r.lang_pred == "und") == text_is_odd and 0 <= r.score <= 1
    assert langid.op2_language_id(none).count() == 0


@pytest.mark.parametrize("op", [toxicity.op3_toxicity, quality.op10_quality])
def test_scores(odd, none, labels, no_labels, op):
    for given in (labels, no_labels):
        got = op(odd, given).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert op(none, given).count() == 0


def same_values(kept, odd):
    """All rows are rows of odd, clashing columns included, apart from their texts."""
    had = {tuple(r) for r in odd.drop("text").collect()}
    got = kept.drop("text").collect()
    return kept.columns == odd.columns and all(tuple(r) in had for r in got)


def test_filters_keep_columns(odd, labels, monkeypatch):
    kept = toxicity.filter_toxic(odd, labels)
    assert same_values(kept, odd)
    monkeypatch.setattr(toxicity, "SENT", 0)
    assert sorted(map(str, toxicity.filter_toxic(odd, labels).collect())) == sorted(map(str, kept.collect()))
    scored = toxicity.score(odd, toxicity.learn(odd, labels))
    assert scored.columns == [*odd.columns, "_score_"] and scored.count() == 9


def test_packing(odd, none):
    got = packing.op4_packing(odd, WORD_BPE).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r.doc_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.op4_packing(none, WORD_BPE).count() == 0


def test_line_dedup(spark, odd, none):
    assert sorted(r.n_lines for r in linededup.op5_line_dedup(odd).collect()) == [1] * 8 + [2]
    assert linededup.op5_line_dedup(none).count() == 0
    out = linededup.line_dedup(odd)
    assert out.columns == [*odd.columns, "_n_lines_", "_n_dropped_"] and same_values(out.select(*odd.columns), odd)
    line = "a line of more than forty characters, repeated here"
    made = [(i, f"{line}\nown {i}\n  {line.upper()}\t", "en", "a", 1) for i in (1, 2, 3, 4, 9, 9)] + [(None, line, "en", "a", 1)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op5_line_dedup(spark.createDataFrame(made, DOCS)).collect()}
    assert got[1] == (3, 2, hashlib.sha256(b"own 1").hexdigest())
    assert got[9][:2] == (3, 0) and got[None][:2] == (1, 1)


def test_line_dedup_streams_sorted_ranges(spark, odd):
    """The sort of each range stays in the plan, under the window, with one exchange beneath."""
    made = spark.createDataFrame([(i, "a line of more than forty characters, repeated here") for i in range(6)], "doc_id long, text string")
    seen = []
    keep = linededup.materialise
    linededup.materialise = lambda df, name: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1]
    try:
        assert linededup.op5_line_dedup(made).agg({"n_dropped": "sum"}).first()[0] == 5
    finally:
        linededup.materialise = keep
    plan = dict(seen)["common-lines"]
    below = plan[plan.index("Window") :]
    assert below.index("Sort [h") < below.index("rangepartitioning(h") and below.count("Exchange") == 1


@pytest.mark.parametrize("few", [500_000, -1])
def test_line_dedup_hot_lines(spark, monkeypatch, few):
    """Hot and other lines by broadcast and by shuffle."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", few)
    hot, warm = "the line that all of the documents hold, word for word", "a line that only a third of the documents hold here"
    made = [(i, f"{hot}\n{i}\n" + (warm if i % 3 == 0 else "")) for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in linededup.op5_line_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: (i != 59) + (i % 3 == 0 and i != 57) for i in range(60)}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "The CAT sat"), (2, None), (None, ""), (3, "mat"), (3, "mat"), (4, "nothing of the kind")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.op6_decontamination(odd, items).collect()}
    assert (got[4].n_words, got[4].n_hit, got[4].n_items, got[4].contaminated) == (9, 4, 2, True)
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (0, 0, False)
    assert decontam.op6_decontamination(none, items).count() == 0
    assert decontam.op6_decontamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontam.decontaminate(odd, items)
    assert same_values(kept, odd) and 4 not in {r.doc_id for r in kept.collect()}
    cut = decontam.decontaminate(odd, items, share=1, spans=True).where("doc_id = 4").first()
    assert cut is not None and "cat" not in cut.text and "mat" not in cut.text.split(".")[0]


def test_decontamination_blocks(odd, spark, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat", "sat on", "lorem ipsum", "mat"])], "item_id long, text string")
    whole = sorted(map(str, rows(decontam.op6_decontamination(odd, items))))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 3)
    assert sorted(map(str, rows(decontam.op6_decontamination(odd, items)))) == whole
    assert same_values(decontam.decontaminate(odd, items), odd)


def test_suffix_dedup(spark, odd, none):
    got = sorted(rows(suffixdedup.op8_suffix_dedup(odd)), key=str)
    assert len(got) == 9 and sum(r[2] > 0 for r in got) == 1  # the long text repeats itself
    assert suffixdedup.op8_suffix_dedup(none).count() == 0
    out = suffixdedup.remove_repeats(odd)
    assert out.columns == [*odd.columns, "_repeats_"] and same_values(out.select(*odd.columns), odd)
    text = "".join(random.Random(1).choices("abcdef ", k=900))
    twice = spark.createDataFrame([(2, text, "en", "a", 1), (1, "x" + text, "en", "a", 1), (None, None, None, None, None)], DOCS)
    assert {r.doc_id: r.n_removed for r in suffixdedup.op8_suffix_dedup(twice).collect()} == {1: 900, 2: 900, None: 0}
    first = suffixdedup.remove_repeats(twice, 400, keep_first=True)
    assert {r.doc_id: r._repeats.n_removed for r in first.collect()} == {1: 0, 2: 900, None: 0}


def test_simhash(odd, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash(odd).collect()}
    assert (1, "0" * 16, 1) in got and (2, "0" * 16, 1) in got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}
    assert simhash.op9_simhash(none).count() == 0
    kept = simhash.keep_one(odd)
    assert same_values(kept, odd) and [r.doc_id for r in kept.collect()].count(4) == 1


def test_keep_one_without_ids(spark):
    """Components whose rows have no id, or share one, are still told apart."""
    a, b, c, d = (" ".join(random.Random(i).choices(["".join(random.Random(j).choices("abcdefgh", k=6)) for j in range(500)], k=60)) for i in range(4))
    made = [(None, a, "en", "a", 1), (None, a, "en", "a", 1), (None, b, "en", "a", 1), (None, None, "en", "a", 0), (9, c, "en", "a", 1), (9, d, "en", "a", 1), (None, d, "en", "a", 1)]
    kept = simhash.keep_one(spark.createDataFrame(made, DOCS)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, a), (None, b), (None, None), (9, c), (9, d)], key=str)


def test_ann(spark):
    v = [1.0, 0.0, 0.5]
    made = [(0, v), (50, v), (7, v), (8, [2.0, 0.0, 1.0]), (100, None), (150, [0.0, 0.0, 0.0]), (200, [1.0, None, 0.0]), (250, [float("nan"), 1.0, 1.0]), (9, [1.0]), (None, v), (3, [-1.0, 1.0, 0.0]), (3, [-1.0, 1.0, 0.0]), (300, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").selectExpr("*", "1 AS part", "2 AS q", "3 AS v")
    got = {}
    for r in ann.op7_ann(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 50} and set(got[0]) == {50, 7, 8, 3} and got[0][0] == 7 and got[50][0] == 0
    assert ann.op7_ann(df.limit(0)).count() == 0
    # queries of other dimensions than the vectors' commonest take no part, however many they are
    more = spark.createDataFrame([(50 * i, [1.0, float(i)]) for i in range(1, 6)], "vec_id long, embedding array<double>")
    both = df.where("vec_id % 50 = 0").select("vec_id", "embedding").unionByName(more)
    assert {r.query_id for r in ann.search(df, both).collect()} == {0, 50}
    # scaled copies tie: the smaller ids win
    ties = spark.createDataFrame([(i, [float(i + 1), 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.op7_ann(ties).where("query_id = 50").orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_chat(spark):
    made = [(1, 0, "user", None), (1, 1, "assistant", "ok <|end|> <\\|x <\\\\| 😀"), (1, 1, "assistant", "ok <|end|> <\\|x <\\\\| 😀"), (None, None, None, "lost"), (2, 0, "assistant", ""), (3, 5, "assistant", LONG)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS ids")
    got = {r.conv_id: r for r in chat.op1_chat_format(df, BYTE_BPE).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    said = "ok <|end|> <\\|x <\\\\| 😀"
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[3].loss_chars == len(LONG)
    assert got[-7].loss_sha256 == hashlib.sha256(chat.EXTRA_TEXT.encode()).hexdigest()
    assert {r.conv_id for r in chat.op1_chat_format(df.limit(0), BYTE_BPE).collect()} == {-7}


def test_chat_escape_round_trip():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("<|\\>endturx ") for _ in range(rng.randrange(30)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and "<|" not in escaped


def test_chat_blocks_equal_whole():
    turns = [("user", "Hello there"), ("assistant", "  leading space\n\n"), ("assistant", "x"), ("user", "<|end|>")]
    enc = chat.encoder(BYTE_BPE)
    whole, spans = chat.render(turns)
    parts = [chat.render([t])[0] for t in turns]
    assert "".join(parts) == whole and sum((enc.encode(p, add_special_tokens=False).ids for p in parts), []) == enc.encode(whole, add_special_tokens=False).ids
    offsets = np.array(enc.encode(whole, add_special_tokens=False).offsets)
    flat = chat.covered(offsets, chat.loss_tokens(spans, offsets))
    assert [tuple(x) for x in np.array(flat).reshape(-1, 2)] == spans
