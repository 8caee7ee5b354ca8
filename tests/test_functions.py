"""Single functions: what goes in and what must come out."""

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import chunking, snippets, text, tsquery
from lodestone.functions.normalise import Registry, RuleError, RuleSet, drop_tokens, lower_simple, map_chars, map_sequences
from lodestone.operators import fusion, metadata


@pytest.fixture(scope="module")
def registry():
    return Registry()


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("tag", "given", "want"),
    [
        ("tr", "İSTANBUL", "istanbul"),
        ("tr", "Menümü nasıl yayınlarım", "menumu yayinlarim"),
        ("*", "Straße", "strasse"),
        ("*", "Ærø", "aero"),
        ("*", "Łódź", "lodz"),
        ("fa", "می‌رود", "رود"),
        ("ar", "٢٠٢٦", "2026"),
        ("he", "מלך", "מלכ"),
        ("*", "ΟΔΟΣ", "οδοσ"),
        ("*", "a b\t c ", "a b c"),
    ],
)
def test_rule_sets_agree_in_both_forms(spark, registry, tag, given, want):
    rules = registry.sets[tag]
    assert rules.normalise(given) == want == one(spark, given, rules.column)
    assert rules.normalise(want) == want


def test_operations(spark):
    assert one(spark, "ab", lambda c: map_chars(c, {"a": "b", "b": "c"})) == "bc"
    assert one(spark, "ab", lambda c: map_chars(c, {"a": "bb", "b": "c"})) == "bbc"
    assert one(spark, "aaaab abc", lambda c: map_sequences(c, {"aa": "X", "ab": "y", "abc": "3"})) == "XXb 3"
    assert one(spark, "İΣ", lower_simple) == "İσ"
    assert one(spark, "x ve, ve y", lambda c: drop_tokens(c, ["ve"])) == "x ve, y"


def test_prefixes_and_resolution(spark, registry):
    tr = registry.resolve("tr-TR")
    assert tr.tag == "tr" and registry.resolve("de").tag == registry.resolve(None).tag == "*"
    assert tr.prefixes("bir iki menu menular menulu") == "menu" == one(spark, "bir iki menu menular menulu", tr.prefix_column)


def test_rules_are_refused_with_all_faults():
    with pytest.raises(RuleError) as e:
        RuleSet("x", [{"op": "normalizeForm"}, {"op": "mapChars", "map": {"ab": "c"}}], "bad config", 2)
    for part in ("normalizeForm", "mapChars", "searchConfig", "stemPrefixLength", "self tests"):
        assert part in str(e.value)
    with pytest.raises(RuleError):
        Registry(specs=[])


def test_locales():
    assert text.normalise_locale(" TR_tr ") == "tr-tr" and text.is_locale("tr-tr") and not text.is_locale("t") and not text.is_locale("not a tag")
    assert text.locale_chain("tr", {"tr": ["en"], "en": ["fr"]}) == ["tr", "en"] and text.locale_chain(None, {}) == []
    assert text.fallback_cycles({"a": ["b"], "b": ["a"], "c": ["a"]}) == [["a", "b"]]


def test_synonyms():
    groups = {"tr": [["karekod", "qr kod", "qr"], ["yayinla", "yayinlama"]]}
    assert text.expand("qr kod nerede", ["tr"], groups) == ["karekod"]
    assert text.expand("kod", ["tr"], groups) == [] and text.expand("qr", ["en"], groups) == []


def test_similarity():
    assert text.word_similarity("word", "two words") == pytest.approx(0.8)
    assert text.word_similarity("word", "") == 0 and text.word_similarity("word", "word") == 1
    embed = lambda t: text.hash_embed(t, 128)
    assert embed("")[0] == 1 and embed("menu")[57] != 0
    assert text.decode_vector(text.encode_vector([1.0, -0.5])) == [1.0, -0.5]
    assert text.fnv1a64("") == 0xCBF29CE484222325


def test_queries():
    assert tsquery.parse("a b or c") == ["or", ["and", ["term", "a"], ["term", "b"]], ["term", "c"]]
    assert tsquery.parse('"a b" -c') == ["and", ["phrase", "a", "b"], ["not", ["term", "c"]]]
    assert tsquery.parse("& ! ( ) : *") is None and tsquery.parse('"unclosed') == ["term", "unclosed"]
    places = {"a": [1, 7], "b": [2], "c": [9]}
    assert tsquery.evaluate(tsquery.parse('"a b"'), places) and not tsquery.evaluate(tsquery.parse('"b a"'), places)
    assert not tsquery.needs_term(tsquery.parse("-a or b")) and tsquery.needs_term(tsquery.parse("-a b"))


def test_cover_density():
    rank = lambda q, e: tsquery.rank_cover(tsquery.parse(q), e)
    assert rank("a", {"a": [(1, "A"), (5, "A"), (9, "D")]}) == pytest.approx(2.1)
    assert rank("a b", {"a": [(1, "A")], "b": [(2, "A")]}) == pytest.approx(1.0)
    assert rank("a b", {"a": [(1, "A")], "b": [(4, "A")]}) == pytest.approx(1 / 3)


def test_snippets(registry):
    tr = registry.sets["tr"]
    assert snippets.emphasise("**Şifremi unuttum** bağlantısı.", ["sifremi"], tr) == "**<em>Şifremi</em> unuttum** bağlantısı."
    assert snippets.emphasise("ne için", ["ne"], tr) == "ne için"
    made = snippets.excerpt("kelime " * 80 + "sifre " + "kelime " * 80, ["sifre"], tr)
    assert made.startswith("…") and made.endswith("…") and "<em>sifre</em>" in made
    content = "bir sifre daha sifre"
    for at, n in snippets.highlights(snippets.emphasise(content, ["sifre"], tr), content):
        assert content[at : at + n] == "sifre"
    assert len(snippets.excerpt("x" * 400 + " sifre", ["sifre"], tr)) < 330


def test_chunks():
    o = chunking.Options()
    assert chunking.chunk("  ") == []
    got = chunking.chunk("# Menus\n\nIntro.\n\n## Publishing\n\nOne.\n\n## Troubleshooting\n\nTwo.")
    assert [c["heading_path"] for c in got] == [["Menus"], ["Menus", "Publishing"], ["Menus", "Troubleshooting"]] and [c["ordinal"] for c in got] == [0, 1, 2]
    assert len(chunking.chunk("```\n" + "code line\n" * 200 + "```", chunking.Options(target_tokens=60))) == 1
    assert len(chunking.chunk("|a|b|\n|-|-|\n" + "|1|2|\n" * 80, chunking.Options(target_tokens=60))) == 1
    assert len(chunking.chunk("\n\n".join(["p" * 700] * 6))) > 1
    two = "aaaaaaaaaa\n\nbbbbbbbbbb"
    assert [len(chunking.chunk(two, chunking.Options(target_tokens=t, chars_per_token=1))) for t in (24, 21)] == [1, 2]
    assert chunking.overlap_of("First one. Second one. Third one.", 35) == "Third one." and chunking.overlap_of("short", 15) == ""
    deep = chunking.chunk("# T\n\nintro\n\n### Deep\n\nmore")
    assert len(deep) == 1 and deep[0]["heading_path"] == ["T"] and "### Deep" in deep[0]["body"]
    assert [o.tokens("x" * n) for n in (1, 4, 7, 8, 350)] == [1, 2, 2, 3, 100]
    assert len(chunking.chunk("\n\n".join(f"## h{i}\n\nbody" for i in range(20)), chunking.Options(max_chunks=3))) == 3


def test_fusion(spark):
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, ordinal int, score double, rank int")
    got = {r.chunk_id: r for r in fusion.fuse(rows(("a", 0, 9.0, 1), ("b", 1, 8.0, 2)), rows(("b", 1, 0.9, 1), ("a", 0, 0.8, 2))).collect()}
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 62) == got["b"].score
    assert (got["a"].lexical_rank, got["a"].vector_rank, got["b"].vector_score) == (1, 2, 0.9)
    with pytest.raises(ValueError):
        fusion.fuse(rows(("a", 0, 1.0, 1)), rows(("a", 0, 1.0, 1)), 0)


@pytest.mark.parametrize(
    ("wanted", "held"),
    [({}, True), ({"a": {"b": 1}}, True), ({"b": 1}, False), ({"tags": ["y", "x"]}, True), ({"tags": ["z"]}, False), ({"a": {"b": 1.0}}, True), ({"n": None}, True), ({"s": "1"}, False), ({"t": True}, True), ({"o'k": 1}, True)],
)
def test_metadata_containment(spark, wanted, held):
    doc = '{"a":{"b":1,"c":2},"tags":["x","y"],"n":null,"s":1,"t":true,"o\'k":1}'
    assert one(spark, doc, lambda c: metadata.contains(c, wanted)) is held


def test_settings_report_all_faults():
    faults = Settings(rrf_k=0, mode="odd", fallback={"a b": []}, vector_min_similarity=2).faults()
    assert len(faults) == 4 and Settings().faults() == []
