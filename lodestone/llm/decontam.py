"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Words of the test items become numbers; one suffix automaton holds all items of a block. Training words are streamed
through it and the longest match ending at each word is tracked; a match of at least `window` words marks the words it
covers, an item with fewer words than the window counts where it occurs whole. Only stretches of words that all occur in
some item reach the automaton.

The automaton is broadcast, so its size is bounded: items are dealt into blocks of at most BLOCK_WORDS words, and each
further block is another pass over the rows, written with the marks so far; one automaton is in memory at a time.
Normally there is one block, one pass and nothing written. No row is shuffled.

Nulls: null texts and null items have no words; items with a null id are named by the empty text. Repeated items count
once by id. Very long texts are streamed whole; an item longer than a block is a block of its own. Runs that touch or
overlap are one. Empty tables are fine. Other columns of the documents, whatever their names, are kept by
decontaminate().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import materialise, packed, unpacked

#: Words of the test items in one automaton, at most (about 500 bytes of memory a word).
BLOCK_WORDS = 400_000

#: What a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD = re.compile(WORD)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# the same in UTF-8 bytes: word bytes stay, A-Z are lower-cased, all else parts words
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state that can end a window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        ends: list[list[int]] = [[]]
        short: dict[int, list[int]] = {}
        self.names = [name for name, _ in items]
        self.least = window
        for k, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if not ids:
                continue
            self.least = min(self.least, len(ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
                while len(ends) < len(self.len):
                    ends.append([])
                if not ends[last] or ends[last][-1] != k:
                    ends[last].append(k)
            if len(ids) < window:
                short.setdefault(last, []).append(k)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        # a state whose strings include one of `window` words gathers the items of all that extend it
        size = len(self.len)
        self.items: list[tuple[int, ...]] = [()] * size
        gathered: list[set[int] | None] = [None] * size
        for s in order:
            own = gathered[s] or set()
            own.update(ends[s])
            gathered[s] = None
            if self.len[s] >= window:
                up = self.link[s]
                if self.len[up] < window:
                    self.items[s] = tuple(sorted(own))
                else:
                    if gathered[up] is None:
                        gathered[up] = set()
                    gathered[up] |= own
        # from each state: where its window-long suffix lives, and the whole short items that are suffixes of it
        self.home = list(range(size))
        self.short: list[tuple[tuple[int, int], ...]] = [()] * size
        for s in reversed(order):
            up = self.link[s]
            if self.len[s] >= window and self.len[up] >= window:
                self.home[s] = self.home[up]
            own = tuple((self.len[s], k) for k in short.get(s, ()))
            self.short[s] = own + self.short[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the numbers of the items that occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= self.least:
                self._stream(ids[a:b].tolist(), a, runs, found)
        return runs, found

    def _stream(self, ids: list[int], at: int, runs: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state, matched = 0, 0
        for i, c in enumerate(ids, at + 1):
            step = nxt[state].get(c)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = nxt[state].get(c)
            if step is None:
                matched = 0
                continue
            state = step
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                home = self.home[state]
                # the state may be longer than what matched; its window-long suffix is the same
                found.update(self.items[home])
            for n, k in self.short[state]:
                if n <= matched:
                    found.add(k)
                    reach = max(reach, n)
            if reach:
                if runs and runs[-1][1] >= i - reach:
                    start = runs[-1][0]
                    while len(runs) > 1 and runs[-2][1] >= i - reach:
                        runs.pop()
                        start = runs[-1][0]
                    runs[-1] = (min(start, i - reach), i)
                else:
                    runs.append((i - reach, i))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id as text, words) in blocks of bounded size; one block is in the driver's memory at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text")).orderBy("name")
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row["name"], words))
        held += len(words)
    yield block


def _marks(sent, schema: str):
    """UDF: text -> n_words, runs (flat list of starts and ends), names of occurring items."""

    @arrow_udf(schema)
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton: Automaton = sent.value
        for batch in batches:
            counts, runs, names = [], [], []
            for at in range(0, len(batch), 256):
                for text in batch.slice(at, 256).to_pylist():
                    words = words_of(text)
                    hit, found = automaton.hits(words)
                    counts.append(len(words))
                    runs.append([x for r in hit for x in r])
                    names.append(sorted({automaton.names[k] for k in found}))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["n_words", "runs", "names"])

    return mark.asNondeterministic()


_SCHEMA = "struct<n_words:long,runs:array<long>,names:array<string>>"


def _merge_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for lists in batch.to_pylist():
            merged: list[int] = []
            for a, b in sorted(p for x in lists for p in zip(x[::2], x[1::2], strict=True)):
                if merged and a <= merged[-1]:
                    merged[-1] = max(merged[-1], b)
                else:
                    merged += [a, b]
            out.append(merged)
        yield pa.array(out, pa.list_(pa.int64()))


def mark_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """row (the document's columns) and mark: n_words, runs of hit words, names of the items that occur; and n_hit."""
    sc = docs.sparkSession.sparkContext
    marked, sent = packed(docs), None
    for block in item_blocks(benchmark):
        if sent is not None:  # the pass before ends here, and its automaton goes
            marked = materialise(marked, "marked")
            sent.destroy()
        sent = sc.broadcast(Automaton(block, window))
        found = _marks(sent, _SCHEMA)(F.col("row").getField("text").cast("string"))
        if "mark" not in marked.columns:
            marked = marked.select("row", found.alias("mark"))
            continue
        merge = arrow_udf(_merge_runs, "array<long>")
        both = marked.select("row", F.col("mark").alias("one"), found.alias("two"))
        runs = merge(F.array("one.runs", "two.runs"))
        marked = both.select("row", F.struct(F.col("one.n_words"), runs.alias("runs"), F.array_sort(F.array_union("one.names", "two.names")).alias("names")).alias("mark"))
    hit = F.aggregate(F.col("mark.runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda acc, x: F.struct((acc["n"] + x * acc["s"]).alias("n"), (-acc["s"]).alias("s")), lambda acc: acc["n"])
    return marked.select("row", "mark", hit.alias("n_hit"))


def contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("mark.n_words"))


def remove_spans(text: str | None, runs: list[int]) -> str | None:
    """The text without the hit words and the white space before each removed span."""
    if not text or not runs:
        return text
    folded = text.lower() if text.isascii() else text.translate(_UPPER)
    spans = [m.span() for m in _WORD.finditer(folded)]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[at : spans[a][0]].rstrip())
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, spans: bool = False) -> DataFrame:
    """The documents, with all their columns, that are not contaminated: hit words under 1/share of the words.

    With spans the hit spans of the documents that stay are cut out of their texts as well.
    """
    kept = mark_documents(docs, benchmark, window).where(~contaminated(share))
    text = F.col("row").getField("text")
    if spans:

        @arrow_udf("string")
        def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
            return pa.array([remove_spans(t, r) for t, r in zip(text.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

        text = cut(text.cast("string"), F.col("mark.runs"))
    return kept.select(*unpacked(docs.columns, text))


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    marked = mark_documents(docs.select("doc_id", "text"), benchmark)
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("mark.n_words").alias("n_words"),
        "n_hit",
        F.size("mark.names").cast("long").alias("n_items"),
        F.sha2(F.array_join("mark.names", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT r, s.n, i, array_to_string(ws[i:i + s.n - 1], ' ') AS gram
  FROM d, sizes s, LATERAL (SELECT unnest(generate_series(1, len(ws) - s.n + 1)) AS i) WHERE len(ws) >= s.n
), m AS (SELECT g.r, g.i, g.n, w.item_id FROM g JOIN w ON g.gram = w.gram AND g.n = w.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
