"""The pipeline against slow stages one after the other, on odd rows and on empty tables."""

import collections
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import packing, toxicity
from lodestone.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = " \t\n\x0b\f\r"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slow_lines(docs):
    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in text.split("\n"):
            holders[lower(line.strip(SPACE))].add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, "\n".join(x for x in text.split("\n") if common.get(lower(x.strip(SPACE)), i) == i)) for i, text in docs]


def slow_fingerprint(text):
    words = bytes(lower(text), "utf-8").split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_near(docs):
    prints = {i: slow_fingerprint(t) for i, t in docs}
    group = {i: i for i in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return [(i, t) for i, t in docs if find(i) == i]


def slow_clean(docs, items):
    windows = set()
    for text in items:
        words = WORD.findall(lower(text or ""))
        n = min(13, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    out = []
    for i, text in docs:
        words = WORD.findall(lower(text))
        hit = np.zeros(len(words), dtype=bool)
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) in windows:
                    hit[at : at + n] = True
        if not (hit.any() and 20 * hit.sum() >= len(words)):
            out.append((i, text))
    return out


def ids_by_document(pieces):
    held = collections.defaultdict(dict)
    for p in pieces:
        held[p.doc_id][p.start] = bytes(p.ids)
    return {i: b"".join(parts[s] for s in sorted(parts)) for i, parts in held.items()}


def test_against_slow_stages(spark):
    docs = table(spark, SMALL, "documents")
    toxic = {r.doc_id for r in toxicity.op3_toxicity(docs, table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in toxic]
    left = slow_clean(slow_near(slow_lines(left)), [r.text for r in table(spark, SMALL, "benchmark").collect()])
    whole = packing.encoder(WORD_BPE).whole
    want = {i: whole(t) + b"\x01\0\0\0" for i, t in left}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert len(want) < docs.count() and ids_by_document(pieces) == want
    ends = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += len(p.ids) // 4


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, labels, benchmark):
        for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, runs int, _score int, row int, fp int"),
            ("labels", labels, "doc_id long, quality int, toxic int, text string"),
            ("benchmark", benchmark, "item_id long, text string, mark int"),
        ):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_odd_rows(spark, folder):
    line = "one line of more than forty characters which many documents share"
    texts = {1: None, 2: "", 3: "  \n\t", 4: f"{line}\nfour", 5: f"{line}\nfive", 6: f"{line}\nsix", 7: f"{line}\nseven", 8: f"{line}\neight", 9: "lorem ipsum dolor " * 20_000}
    rows = [(i, t, None, "a", 1, 1, 2, 3, 4) for i, t in texts.items()] + [(None, "no id", "en", None, None, None, None, None, None), (8, texts[8], None, "a", 1, 1, 2, 3, 4)]
    sf_dir = folder(rows, [(4, 1, 0, ""), (5, 1, None, ""), (None, None, 1, "")], [(1, None, 0), (None, "", 0), (2, "a benchmark item that none has", 0)])
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == table(spark, sf_dir, "documents").columns
    got = ids_by_document(corpus_pipeline.run(spark, sf_dir).collect())
    # 1, 2, 3 have no words, 8 is there twice, and 4 to 7 lose their line: one of each group stays
    whole = packing.encoder(WORD_BPE).whole
    want = {1: "", 4: "four", 5: "five", 6: "six", 7: "seven", 8: texts[8], 9: texts[9], None: "no id"}
    assert got == {i: whole(t) + b"\x01\0\0\0" for i, t in want.items()}


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [], [])).count() == 0


def test_packing_leaves_no_words_in_its_workers(spark):
    """Stages before and after it in a pipeline run in the same processes."""
    arrow = pa.schema([("words", pa.int64()), ("again", pa.int64())])

    def kept(batches):
        for _ in batches:
            pass
        enc = packing.encoder(WORD_BPE)
        yield pa.RecordBatch.from_pydict({"words": [len(enc.words) + len(enc.pieces)], "again": [packing.encoder.cache_info().hits]}, schema=arrow)

    packing.pack(table(spark, SMALL, "documents").repartition(8), WORD_BPE).collect()
    rows = spark.range(8, numPartitions=8).mapInArrow(kept, "words long, again long").collect()
    assert any(r.again for r in rows) and not any(r.words for r in rows)


def test_packing_remembers_a_word_once():
    enc = packing.Encoder(WORD_BPE)
    enc.encode("plain words, Plain twice")
    assert set(enc.words) == {"plain", "words,", "Plain", "twice"} and not {"twice"} & set(enc.pieces)
