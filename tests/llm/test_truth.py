"""The corpus operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import ann, common, decontam, langid, packing, quality, simhash, suffixdedup, toxicity
from lodestone.llm.common import letter_words, table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def test_packing_covers_every_token_once(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack(docs, WORD_BPE).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.collect():
        want = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        got = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in got) == want and got[0].doc_tokens == len(want) // 4
        assert [p.start for p in got] == list(np.cumsum([0, *(len(p.ids) // 4 for p in got)])[:-1])
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert 2048 - packing.PADDING <= at <= 2048 or at & (at - 1) == 0


def test_ids_of_all_code_points():
    """Each code point between letters, alone, doubled and before a contraction; Unicode tables may differ, ids may not."""
    enc = packing.Encoder(WORD_BPE)
    points = [*range(0x3100), *range(0x3100, 0xD800, 61), *range(0xE000, 0x110000, 997), *range(0x10D40, 0x10D90)]
    for c in points:
        text = f"Xa{chr(c)}b {chr(c)} {chr(c) * 2}'s 1{chr(c)}"
        assert enc.encode(text) == enc.whole(text), hex(c)


def test_ids_of_mixed_texts():
    enc, rng = packing.Encoder(WORD_BPE), random.Random(4)
    pool = [chr(c) for lo, hi in [(0, 0x600), (0x1100, 0x1120), (0x2000, 0x2070), (0x1F600, 0x1F610)] for c in range(lo, hi)] + ["<|endoftext|>", "'s", "'LL", " ", "\n"] * 60
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randrange(1, 25)))
        assert enc.encode(text) == enc.whole(text)


class SlowPacker:
    """Every level tried, the sum of squares of partially filled windows computed anew each time."""

    def __init__(self, size):
        self.size, self.levels, self.closed = size, [], []  # open windows: (tokens, documents)

    def place(self, document, n):
        def cost(windows):
            return sum(v * v for v in collections.Counter(t for t, _ in windows if t < self.size).values())

        tries = []
        for h in range(self.size - n, -1, -1):
            at = next((i for i in range(len(self.levels) - 1, -1, -1) if self.levels[i][0] == h), None)
            if h and at is None:
                continue
            rest = self.levels if not h else self.levels[:at] + self.levels[at + 1 :]
            tries.append((cost([*rest, (h + n, ())]), -h, at))
        _, h, at = min(tries)
        t, held = self.levels.pop(at) if h else (0, ())
        window = (t + n, (*held, document))
        (self.closed if t + n == self.size else self.levels).append(window)


def test_placement_against_a_slow_packer():
    rng = np.random.default_rng(9)
    for size, n in ((8, 150), (32, 150), (64, 60)):
        packer, slow, closed = packing.Packer(size), SlowPacker(size), []
        for i in range(n):
            length = int(rng.integers(1, size))
            closed += list(packer.add(i, b"\0" * 4 * length))
            slow.place(i, length)
            assert packer.count.tolist() == [sum(t == h for t, _ in slow.levels) for h in range(size)]
        assert [tuple(p[0] for p in w) for w in closed] == [held for _, held in slow.closed]


@pytest.mark.parametrize("most", [3, 8192])
def test_windows_stand_as_placed(monkeypatch, most):
    """Each id is in one piece; only the emptiest windows are cut anew; padding is small; open windows are bounded."""
    monkeypatch.setattr(packing, "OPEN_WINDOWS", most)
    packer, out = packing.Packer(64), []
    rng = np.random.default_rng(1)
    ids = {i: np.arange(int(rng.integers(1, 150)), dtype="<u4") + 1000 * i for i in range(300)}
    for i, x in ids.items():
        out += list(packer.add(i, x.tobytes()))
        assert packer.held <= most + 1
    out += list(packer.finish())
    assert packer.held == 0
    got = {i: {} for i in ids}
    for w in out:
        total = sum(len(p[2]) // 4 for p in w)
        assert 64 - packing.PADDING <= total <= 64 or total & (total - 1) == 0
        for i, start, part in w:
            assert start not in got[i]
            got[i][start] = part
    for i, x in ids.items():
        assert b"".join(got[i][s] for s in sorted(got[i])) == x.tobytes()
    if most > 300:
        assert sum(len(v) for v in got.values()) < 1.25 * sum(-(-len(x) // 64) for x in ids.values())


def removed_by_all_windows(texts, size, keep_first):
    """(removed mask) of each text; texts in corpus order."""
    seen = collections.defaultdict(list)
    for n, b in enumerate(texts):
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]].append((n, i))
    marks = [np.zeros(len(b), dtype=bool) for b in texts]
    for places in seen.values():
        for n, i in places[1 if keep_first else 0 :] if len(places) > 1 else []:
            marks[n][i : i + size] = True
    return marks


@pytest.mark.parametrize(("most", "hot"), [(4096, 1000), (1, 1000), (4096, 1), (1, 1)])
def test_suffix_dedup_against_all_windows(docs, monkeypatch, most, hot):
    """With the suffix arrays, without them, and with all keys hot."""
    monkeypatch.setattr(suffixdedup, "MAX_STRETCHES", most)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    marks = removed_by_all_windows([b for _, b in texts], 400, False)
    got = {r.doc_id: r for r in suffixdedup.op8_suffix_dedup(docs).collect()}
    for (doc_id, b), mark in zip(texts, marks, strict=True):
        r = got[doc_id]
        spans = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~mark])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r.text.encode().replace("\ufffd".encode(), b"") in (kept, kept.decode(errors="ignore").encode())


@pytest.mark.parametrize("keep_first", [True, False])
def test_suffix_dedup_of_periodic_texts(spark, keep_first):
    """Short periods, whose equal stretches follow each other, copies, and passages in different surroundings."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, other = word(60), word(45)
    texts = ["ab" * 70, word(30) + "abc" * 50, "abc" * 50 + word(9), passage + word(20), word(31) + passage, other, other, word(25) + other + word(3), "short", "x" * 41, "x" * 39, "x" * 200]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r["_repeats"].kept) for r in suffixdedup.remove_repeats(made, 40, keep_first).collect()}
    marks = removed_by_all_windows([t.encode() for t in texts], 40, keep_first)
    assert got == {i: bytes(np.frombuffer(t.encode(), dtype=np.uint8)[~m]) for i, (t, m) in enumerate(zip(texts, marks, strict=True))}


def test_long_texts_are_cut_without_losing_windows():
    data = np.random.default_rng(3).integers(97, 101, 1_300_000).astype(np.uint8).tobytes()
    covered = np.zeros(len(data), dtype=np.int64)
    for pieces in suffixdedup._pieces(iter([(0, b"short"), (1, data)]), 400):
        documents, first, last, times, *_ = suffixdedup.anchors_of(pieces, 400)
        assert set(documents) <= {1}
        for a, b, n in zip(first, last, times, strict=True):
            covered[a : a + n * (b - a + 1)] += 1
    assert (covered[: len(data) - 399] == 1).all() and not covered[len(data) - 399 :].any()


def test_factors_against_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(120):
        size, letters = int(rng.integers(2, 21)), [[0, 1], [97, 98], [0, 255, 3]][trial % 3]
        strings = [bytes(rng.choice(letters, int(rng.integers(size, 50))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        strings += strings[:1] * int(rng.integers(0, 2))
        depth = suffixdedup.SuffixOrder(strings, size).depth
        places = [(s, i) for s in strings for i in range(len(s) - size + 1)]

        def common_prefix(x, y):
            a, b = x[0][x[1] :][:depth], y[0][y[1] :][:depth]
            return next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))

        at, previous, later = suffixdedup.factors(strings, size)
        assert len(at) == len(places)
        for n, p in enumerate(places):
            assert previous[n] == max((common_prefix(p, q) for q in places[:n]), default=0)
            assert later[n] == max((common_prefix(p, q) for q in places[n + 1 :]), default=0)


def test_simhash_against_all_pairs(docs):
    def slow(text):
        words = bytes(text or "", "utf-8").lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {r.doc_id: slow(r.text) for r in docs.collect()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("small", [2048, 2])
def test_simhash_hot_buckets(spark, monkeypatch, small):
    """A ball of fingerprints, once in small buckets and once through the finer keys."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre}
    for _ in range(150):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(12, int(rng.integers(1, 4)), replace=False)))
    values |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(sorted(values))], "fp long, label long")
    got = {r.fp: r.label for r in simhash.components(simhash.links(nodes.select("fp")), nodes).collect()}
    label = {v: i for i, v in enumerate(sorted(values))}
    groups = [{v} for v in values]
    merged = True
    while merged:
        merged = False
        for i, g in enumerate(groups):
            for h in groups[i + 1 :]:
                if any((a ^ b).bit_count() <= 3 for a in g for b in h):
                    g |= h
                    groups.remove(h)
                    merged = True
                    break
            if merged:
                break
    want = {v: min(label[x] for x in g) for g in groups if len(g) > 1 for v in g}
    assert got == want


def test_chain_of_links(spark):
    n = 300
    nodes = spark.createDataFrame([(i, (i * 7919) % 1009) for i in range(n)], "fp long, label long")
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)], "a long, b long")
    got = {r.label for r in simhash.components(edges, nodes).collect()}
    assert got == {min((i * 7919) % 1009 for i in range(n))}


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 9000)] + 0.4 * rng.normal(size=(9000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in ann.op7_ann(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    truth = ann.brute_force(list(range(9000)), [np.float32(v) for v in x])
    assert np.mean([len(set(truth[q]) & set(found[q])) / 5 for q in truth]) >= 0.9
    rows = ann.usable(df)
    router = ann.learn(rows, 5)
    assert router.parts >= 16 and router.probes < router.parts / 2
    held = [r["n"] for r in rows.groupBy(ann._home(spark, router)("v").alias("p")).count().withColumnRenamed("count", "n").collect()]
    assert max(held) <= 1.6 * 9000 / router.parts


def test_ann_recall_of_the_test_table(spark):
    """The shipped settings on vectors that hardly cluster: several parts, and recall of nine in ten and more."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    vectors = df.select("vec_id", "embedding").collect()
    found = collections.defaultdict(list)
    for r in ann.op7_ann(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    truth = ann.brute_force([r.vec_id for r in vectors], [r.embedding for r in vectors])
    assert set(found) == set(truth) and ann.learn(ann.usable(df), 5).parts >= 8
    assert np.mean([len(set(truth[q]) & set(found[q])) / 5 for q in truth]) >= 0.9


def test_automaton_against_windows():
    rng = np.random.default_rng(8)
    words = [b"a", b"b", b"c"]
    for _ in range(60):
        items = [(str(i), [words[j] for j in rng.integers(0, 3, rng.integers(0, 9))]) for i in range(5)]
        text = [words[j] for j in rng.integers(0, 3, 40)]
        machine = decontam.Automaton(items, 5)
        mark, names = np.zeros(len(text), dtype=bool), set()
        for name, ws in items:
            n = min(5, len(ws))
            for i in range(len(ws) - n + 1) if n else []:
                for j in range(len(text) - n + 1):
                    if text[j : j + n] == ws[i : i + n]:
                        mark[j : j + n] = True
                        names.add(name)
        runs, found = machine.hits(text)
        got = np.zeros(len(text), dtype=bool)
        for a, b in runs:
            assert not got[max(0, a - 1) : b].any()
            got[a:b] = True
        assert (got == mark).all() and {machine.names[k] for k in found} == names


def test_recency_codes():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        want = []
        for i, w in enumerate(words):
            before = [j for j in range(i) if words[j] == w]
            want.append(min(quality.CODES - 1, (i - before[-1]).bit_length()) if before else 0)
        assert quality.recency_codes(words).tolist() == want


def test_quality_against_slow_votes(spark):
    """Cosines, neighbours and votes of the shipped sample, one document and one voter at a time."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    voters = quality.learn(docs, labels)
    scores = {r.doc_id: r.score for r in quality.op10_quality(docs, labels).collect()}
    assert len(voters.vectors) == common.with_labels(docs.where(~common.held_out()), labels, "quality").where("length(text) > 0").count()
    for r in docs.limit(60).collect():
        counts = quality.term_counts(r.text)
        data = (r.text or "").encode()
        grams = collections.Counter(int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32 >> 20 for i in range(len(data) - 2))
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts[: quality.BUCKETS])} == grams
        x = (np.log1p(counts) * voters.idf).astype(float)
        parts = [x[: quality.BUCKETS], x[quality.BUCKETS :]]
        x = np.concatenate([w * v / (np.linalg.norm(v) or 1) for w, v in zip((1, quality.RECENCY_WEIGHT), parts, strict=True)]) @ voters.project
        cosine = [max(0.0, float(x @ v) / (np.linalg.norm(x) * np.linalg.norm(v) or 1)) for v in voters.vectors]
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weights = [cosine[i] * voters.weight[i] for i in near]
        want = sum(w for w, i in zip(weights, near, strict=True) if voters.labels[i]) / sum(weights) if sum(weights) else voters.share
        assert scores[r.doc_id] == pytest.approx(want, abs=2e-3)


def test_language_against_slow_compression(spark):
    """The smallest of all languages' outputs, each made by a compressor of its own; dictionaries are whole texts."""
    import zstandard as z

    docs = table(spark, SMALL, "documents")
    dictionaries = langid.learn(docs.where(~common.held_out()))
    assert set(dictionaries) == {"en", "de", "fr", "es"}
    texts = {b" ".join(letter_words(r.text)) for r in docs.where(~common.held_out()).collect()}
    assert all(len(d) <= langid.DICTIONARY_BYTES and any(d.startswith(t) for t in texts if t) for d in dictionaries.values())
    got = {r.doc_id: r for r in langid.identify(docs, dictionaries).select("doc_id", "text", "_lang").collect()}
    for r in got.values():
        data, sizes = b" ".join(letter_words(r.text)), {}
        for lang, d in dictionaries.items():
            made = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
            sizes[lang] = len(made.compress(data))
        if data:
            best, second = sorted(sizes.values())[:2]
            assert r["_lang"].lang == min(sorted(sizes), key=sizes.get) and r["_lang"].rejected == ((second - best) / best < 0.01)
        else:
            assert r["_lang"].lang == "und"


def _accuracy(scored, labels, column):
    got = scored.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return np.mean([r[0] == r[1] for r in got]), sum(r[0] and r[1] for r in got) / max(1, sum(r[1] for r in got))


def test_held_out_accuracy(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    right, caught = _accuracy(toxicity.op3_toxicity(docs, labels), labels, "toxic")
    assert right >= 0.93 and caught >= 0.7
    assert _accuracy(quality.op10_quality(docs, labels), labels, "quality")[0] >= 0.93
    lang = langid.op2_language_id(docs).where("held_out").join(docs.selectExpr("doc_id", "lang AS truth"), "doc_id").select("lang_pred", "truth").collect()
    assert np.mean([a == b for a, b in lang]) >= 0.97


def slow_kneser_ney(rows, left_out):
    """Log ratios of the conditional probabilities of chains, by the formulas alone. rows: (fold, label, text)."""
    n, size = collections.Counter(), collections.Counter()
    for f, y, text in rows:
        if f != left_out:
            links = set()
            for w in set(letter_words(text)):
                t, before = w.decode(), ""
                for x in [*(t[:k] + "*" for k in (5, 6, 7) if len(t) > k), t]:
                    links.add((before, x))
                    before = x
            n.update((y, *link) for link in links)
    for (y, p, _), c in n.items():
        size[y, p] += c
    own = {}
    for p, x in {k[1:] for k in n}:
        c, t = [n[y, p, x] for y in (0, 1)], [size[y, p] + 0.5 for y in (0, 1)]
        both, share = sum(c), [ty / sum(t) for ty in t]
        odds = [toxicity.MARGIN * share[y] / (toxicity.MARGIN * share[y] + share[1 - y]) for y in (0, 1)]
        off = toxicity.DEVIATIONS * math.sqrt(both * share[0] * share[1]) + toxicity.DISCOUNT
        got = [max(c[y] - odds[y] * both - off, 0) for y in (0, 1)]
        if any(got):
            own[p, x] = got
    left = {p: [1 - sum(o[y] for (q, _), o in own.items() if q == p) / max(1, size[y, p]) for y in (0, 1)] for p in {p for p, _ in own}}
    shared_total = {p: sum(size[y, p] for y in (0, 1)) - sum(sum(o) for (q, _), o in own.items() if q == p) for p in left}
    event, after = {}, {p: math.log(v[1] / v[0]) for p, v in left.items()}
    for (p, x), o in own.items():
        shared = (n[0, p, x] + n[1, p, x] - sum(o)) / shared_total[p]
        q = [o[y] / max(1, size[y, p]) + left[p][y] * shared for y in (0, 1)]
        event[x] = math.log(q[1] / q[0])
    return event, after


@pytest.mark.parametrize("hot", [1000, 1])
def test_toxicity_against_slow_models(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = common.with_labels(docs.select("doc_id", "text").where(~common.held_out()), labels, "toxic").where("text IS NOT NULL")
    made = [(zlib.crc32(str(r.doc_id).encode()) % 4, int(r["_label"] > 0), r.text) for r in rows.collect()]
    got = toxicity.ratios(rows).toArrow()
    for m in (-1, 0, 3):
        event, after = slow_kneser_ney(made, m)
        model = toxicity.Ratios(got, m)
        assert after and {k.decode() for k in model.after if model.after[k]} == {k for k in after if after[k]}
        for x, v in event.items():
            assert model.event[x.encode()] == pytest.approx(v, abs=1e-9)
        for p, v in after.items():
            assert model.after[p.encode()] == pytest.approx(v, abs=1e-9)
        # an expression without own counts in this model differs by the backoff weights only
        for x in set(model.event) - {k.encode() for k in event}:
            parents = [toxicity.chain(x)[-2:-1] or [b""]] if not x.endswith(b"*") else [[b""] if len(x.decode()) == 6 else [x.decode()[:-2].encode() + b"*"]]
            assert model.event[x] == pytest.approx(after.get(parents[0][0].decode(), 0.0), abs=1e-9)


def test_toxicity_keeps_rare_expressions(spark):
    """An expression of eight toxic documents counts, however many others both classes have."""
    rng = np.random.default_rng(6)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:100]
    made = []
    for n, i in enumerate(ids):
        words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (7_500 if n < 80 else 30_000, 9))]
        made.append((i, " ".join([*words, *["vexing"] * (n >= 92)])))
    docs = spark.createDataFrame([*made, (1000, "vexing"), (1001, "unseen")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n >= 80)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.op3_toxicity(docs, labels).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001]


def test_toxicity_shuffled_equals_sent(spark, monkeypatch):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    docs = docs.unionByName(docs.where("doc_id % 50 = 0").withColumn("text", F.lit(None).cast("string")))
    sent = toxicity.filter_toxic(docs, labels)
    scores = sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.op3_toxicity(docs, labels).collect())
    monkeypatch.setattr(toxicity, "SENT", 0)
    monkeypatch.setattr(toxicity, "GROUP", 50)
    assert sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.op3_toxicity(docs, labels).collect()) == scores
    kept = toxicity.filter_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, sent.collect()))


def test_held_out_is_crc32(docs):
    for r in langid.op2_language_id(docs).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
