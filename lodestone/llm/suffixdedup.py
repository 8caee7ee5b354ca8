"""Removal of long repeated byte strings by suffix arrays and longest-previous-factor arrays.

A string of `min_bytes` bytes that starts at two places is a repeat. A suffix array over a whole corpus doesn't fit any
machine, so suffixes first meet where they can match at all:

1. Each string of min_bytes (a window) picks its smallest hashed piece of half its length, the leftmost of equals, as its
   anchor. Equal windows have equal anchors at equal places, whatever surrounds them. Neighbouring windows mostly share
   their anchor, so a document is covered by one row for every hundred bytes or so: anchor hash, range of window starts,
   and the 128-bit digest of the whole stretch of bytes that those windows cover. Adjacent rows with one anchor and one
   digest (a text that repeats itself with a short period) are one row with a count.
2. Anchors that occur once have no repeat. Of those that share their stretch too (copies), one stands for all: a later
   copy's longest previous factor is the stretch. They are counted with pre-aggregation, so hot passages are a row a task.
3. Where one anchor has several different stretches, blocks of whole anchors get a suffix array (prefix doubling), and from
   it the longest-previous-factor array: in suffix order, the previous and the next smaller position of a window are the
   candidates with the longest common prefix, and the larger of the two lengths is its factor. The same with larger
   positions gives the longest later factor. Lengths are exact up to the first power of two times 7 bytes that is not
   under min_bytes. Positions are in corpus order.
4. An anchor with more than MAX_STRETCHES different stretches would be too much for one task; its windows are hashed (128
   bits) and counted in a shuffle instead, which finds the same windows.

With keep_first the earliest copy (by doc_id, then 128-bit hash of the text, then place) stays and later ones go;
without, every copy goes. Strings are judged on the input and never cross documents. Joins on anchors and on stretches
send the hottest keys by broadcast, at most 65,536 of them, so that no task gets all rows of one.

Nulls: a null text is empty; a null doc_id sorts first. Repeated rows repeat each other's bytes, and rows with equal
doc_id and text fare alike (with keep_first they count as one place). Ties in the order of anchors go to the leftmost.
Very long texts are cut into overlapping pieces of 512 KiB, with each window in exactly one. Empty tables give no rows.
Other columns stay, whatever their names; if there is a column _repeats already, the result's is _repeats_.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, hot_join, materialise, packed, unpacked

#: Different stretches of one anchor that a suffix array takes, at most (600 bytes each).
MAX_STRETCHES = 4096
#: Bytes of a batch that one suffix array is built over (beyond one anchor's).
BATCH_BYTES = 1 << 19
#: Rows that may be broadcast to find the texts of stretches; beyond it the join is shuffled.
BROADCAST_ROWS = 400_000

_BUFFER = 1 << 19
_PLACE = np.uint64((1 << 21) - 1)
_NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Random values of bytes for the hash of anchors, powers of an odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(20240229)
    values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15 | 5
    inverse = pow(base, -1, 1 << 64)
    n = _BUFFER + (1 << 16)
    power, back = np.full(n, base, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    power[0] = back[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(back)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, in linear time by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(pieces: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, ...]:
    """Anchors of pieces (document, offset, bytes): document, first and last window start of the first stretch, how many
    equal stretches follow each other, anchor hash, and the two halves of the stretch's digest."""
    k = size // 2
    w = size - k + 1
    joined = b"".join(p[2] for p in pieces)
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    if n < size:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    lengths = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(lengths)
    values, power, back = _tables()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[:n], out=sums[1:])
    grams = (sums[k:] - sums[:-k]) * back[: n - k + 1]
    order = (_mix(grams) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_min(order, w) & _PLACE).astype(np.int64)  # anchor of the window that starts here
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + size <= ends[piece])
    if not len(starts):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    at = least[starts]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    at = at[new]
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    digests = b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (last + size).tolist(), strict=True)])
    u = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
    a = _mix(grams[at] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
    owner = piece[first]
    follows = (owner[1:] == owner[:-1]) & (first[1:] == last[:-1] + 1) & (a[1:] == a[:-1]) & (u[1:] == u[:-1]).all(1)
    head = np.flatnonzero(np.concatenate(([True], ~follows)))
    times = np.diff(np.append(head, len(first)))
    offset = (np.array([p[1] for p in pieces]) - (ends - lengths))[owner[head]]
    return np.array([p[0] for p in pieces])[owner[head]], first[head] + offset, last[head] + offset, times, a[head], u[head, 0], u[head, 1]


def _pieces(documents: Iterator[tuple[int, bytes]], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of pieces of bounded size; pieces of a long document overlap so that each window is in exactly one."""
    batch, held = [], 0
    for i, data in documents:
        step = _BUFFER - size
        for a in range(0, max(1, len(data) - size + 1), step):
            part = data[a : a + step + size - 1]
            if len(part) < size:
                continue
            if held + len(part) > _BUFFER:
                if batch:
                    yield batch
                batch, held = [], 0
            batch.append((i, a, part))
            held += len(part)
    if batch:
        yield batch


_KEY = ("d", "k1", "k2")  # a row: its doc_id and 128 bits of its text
_STRETCH = ("u1", "u2")


def _anchors(docs: DataFrame, size: int) -> DataFrame:
    names = [*_KEY, "s0", "s1", "times", "a", *_STRETCH]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            texts = ((i, batch.column(3)[i].as_py()) for i in range(batch.num_rows))
            for pieces in _pieces(((i, t) for i, t in texts if t), size):
                rows, *found = anchors_of(pieces, size)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*(k[rows] for k in keys), *found)], schema=schema)

    return _keyed(docs).where(F.octet_length("text") >= size).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _keyed(docs: DataFrame) -> DataFrame:
    """The row's key and the bytes of its text."""
    text = F.col("text").cast("string")
    return docs.select(*_row_key(F.col("doc_id"), text), text.cast("binary").alias("text"))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("again"), text).alias("k2")]


class SuffixOrder:
    """Order of the suffixes of strings, each ending with its string, by their first `depth` bytes (at least `size`).

    Prefix doubling from 7-byte words, whose eighth byte tells how many of them are in the string; the ranks of each step
    are kept for longest common prefixes.
    """

    def __init__(self, strings: list[bytes], size: int):
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        lengths = np.array([len(x) for x in strings])
        n = len(data)
        self.rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # bytes up to the string's end
        padded = np.zeros(n + 8, dtype=np.uint8)
        padded[:n] = data
        words = np.ndarray((n,), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
        held = np.minimum(self.rest, 7).astype(np.uint64)
        words &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - held) % np.uint64(64))) - np.uint64(1))
        self.words = words | held
        rank = np.unique(self.words, return_inverse=True)[1]
        self.steps = [(7, rank.astype(np.int32))]
        depth = 7
        while depth < size:
            ahead = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(self.rest > depth)
            ahead[inside] = rank[inside + depth] + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1]
            depth *= 2
            self.steps.append((depth, rank.astype(np.int32)))
        self.rank, self.depth = rank, depth

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, up to the order's depth; -1 for either is no suffix."""
        out = np.zeros(len(i), dtype=np.int64)
        live = np.flatnonzero((i >= 0) & (j >= 0))
        i, j = i[live], j[live]
        for depth, rank in reversed(self.steps):
            same = rank[i] == rank[j]
            step = np.where(same, np.minimum(depth, self.rest[i]), 0)
            out[live] += step
            on = (step < self.rest[i]) & (step < self.rest[j]) & (out[live] < self.depth)
            live, i, j = live[on], (i + step)[on], (j + step)[on]
        differ = self.words[i] ^ self.words[j]
        rest = np.minimum(np.minimum(self.rest[i], self.rest[j]), 7)
        for k in range(7):  # what is left differs within one word
            out[live] += (k < rest) & (differ >> np.uint64(56 - 8 * k) == 0)
        return np.minimum(out, self.depth)


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value of each, or -1, by pointer jumping: what lies between is always larger."""
    before = np.arange(len(x)) - 1
    on = np.flatnonzero(before >= 0)
    while len(on):
        on = on[x[before[on]] >= x[on]]
        before[on] = before[before[on]]
        on = on[before[on] >= 0]
    return before


def factors(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, previous, later) of all windows of `size` bytes, in the order of the strings run together: the longest
    previous and the longest later factor of each, as lengths up to the depth of the suffix order."""
    order = SuffixOrder(strings, size)
    at = np.flatnonzero(order.rest >= size)
    suffixes = at[np.lexsort((at, order.rank[at]))]  # the suffix array of the windows
    n = len(suffixes)

    def longest(values: np.ndarray) -> np.ndarray:
        below, above = nearest_smaller(values), n - 1 - nearest_smaller(values[::-1])[::-1]
        left = np.where(below >= 0, suffixes[below], -1)
        right = np.where(above < n, suffixes[np.minimum(above, n - 1)], -1)
        return np.maximum(order.common(suffixes, left), order.common(suffixes, right))

    previous, later = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    where = np.argsort(suffixes)
    previous[:] = longest(suffixes)[where]
    later[:] = longest(-suffixes)[where]
    return at, previous, later


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return list(zip(starts[np.concatenate(([0], cut))].tolist(), starts[np.concatenate((cut - 1, [len(starts) - 1]))].tolist(), strict=True))


_SPANS = pa.schema([(c, pa.int64()) for c in (*_KEY, "b", "e")])
_SPAN_TYPE = ", ".join(f"{c} long" for c in _SPANS.names)


def _by_factors(stretches: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """Spans of windows whose factors are long enough; an anchor's stretches meet in one block, in corpus order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, key = 0, None
        seen: set = set()

        def close() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            at, previous, later = factors([r[1] for r in held], size)
            hit = at[previous >= size] if keep_first else at[np.maximum(previous, later) >= size]
            begins = np.cumsum([0, *(len(r[1]) for r in held)])
            owner = np.searchsorted(begins, hit, side="right") - 1
            cuts = np.flatnonzero(np.diff(owner)) + 1
            out = []
            for windows, i in zip(np.split(hit, cuts), owner[np.concatenate(([0], cuts))] if len(hit) else [], strict=False):
                *row, s0 = held[i][0]
                out += [(*row, s0 + x, s0 + y + size) for x, y in _runs(windows - begins[i])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SPANS)], schema=_SPANS)

        for batch in batches:
            for a, u1, u2, d, k1, k2, s0, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != key:
                    if total >= BATCH_BYTES:
                        yield close()
                        total = 0
                    key, seen = a, set()
                if (u1, u2) in seen:  # rows with equal doc_id and text
                    continue
                seen.add((u1, u2))
                held.append(((d, k1, k2, s0), data))
                total += len(data)
        if held:
            yield close()

    placed = stretches.repartition("a").sortWithinPartitions("a")
    return placed.select("a", *_STRETCH, *_KEY, "s0", "bytes").mapInArrow(run, _SPAN_TYPE)


def _by_hashes(stretches: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """The same spans by 128-bit hashes of windows, for anchors with too many stretches."""
    schema = pa.schema([("w", pa.binary()), *((c, pa.int64()) for c in (*_KEY, "s"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *row, s0, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - size + 1
                hashes = [xxhash.xxh3_128_digest(data[i : i + size]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *(pa.array([x] * n, pa.int64()) for x in row), pa.array(range(s0, s0 + n), pa.int64())], schema=schema)

    windows = stretches.dropDuplicates(["a", *_STRETCH]).select(*_KEY, "s0", "bytes").mapInArrow(run, "w binary, " + ", ".join(f"{c} long" for c in (*_KEY, "s")))
    windows = materialise(windows, "hot-windows")
    repeated = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "s")).alias("first")).where(F.col("n") > 1)
    hits = hot_join(windows, materialise(repeated, "hot-repeats"), ["w"], windows.count())
    if keep_first:
        hits = hits.where(F.struct(*_KEY, "s") != F.col("first"))
    return hits.select(*_KEY, F.col("s").alias("b"), (F.col("s") + size).alias("e"))


def repeated_spans(docs: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """Spans (d, k1, k2, b, e) of bytes to remove, which may overlap, by row."""
    anchors = materialise(_anchors(docs, size), "anchors")
    repeated = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("all")).where("all > 1").select("a", "n")
    found = materialise(hot_join(anchors, materialise(repeated, "repeats"), ["a"], anchors.count()).drop("n"), "repeated-anchors")
    place = F.struct(*_KEY, "s0", "s1")
    classes = found.groupBy("a", *_STRETCH).agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("all"), F.min(place).alias("first"))
    classes = materialise(classes, "stretches")
    copies = materialise(classes.where("all > 1").select("a", *_STRETCH, "n", F.col("first").alias("earliest")), "copies")
    copied = hot_join(found, copies, ["a", *_STRETCH], found.count())
    step = F.col("s1") - F.col("s0") + 1
    begin = F.col("s0")
    if keep_first:
        earliest = place == F.col("earliest")
        copied = copied.where(~earliest | (F.col("times") > 1))
        begin = F.when(earliest, F.col("s0") + step).otherwise(F.col("s0"))
    spans = copied.select(*_KEY, begin.alias("b"), (F.col("s0") + step * F.col("times") - 1 + size).alias("e"))
    several = materialise(classes.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    needed = hot_join(classes.select("a", *_STRETCH, "first"), several, ["a"], classes.count())
    needed = materialise(needed.select("a", *_STRETCH, "n", "first.*"), "different-stretches")
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    bytes_ = F.substring("text", F.col("s0").cast("int") + 1, (F.col("s1") - F.col("s0")).cast("int") + size)
    fetched = _keyed(docs).join(side, [*_KEY]).select("a", *_STRETCH, "n", *_KEY, "s0", bytes_.alias("bytes"))
    fetched = materialise(fetched, "stretch-bytes")
    spans = spans.unionByName(_by_factors(fetched.where(F.col("n") <= MAX_STRETCHES), size, keep_first))
    if not several.where(F.col("n") > MAX_STRETCHES).isEmpty():
        spans = spans.unionByName(_by_hashes(fetched.where(F.col("n") > MAX_STRETCHES), size, keep_first))
    return spans


def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    for texts, begins, ends in batches:
        rows = []
        for i in range(len(texts)):
            data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            if begins[i].is_valid:
                for b, e in sorted(zip(begins[i].as_py(), ends[i].as_py(), strict=True)):
                    if runs and b <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([b, e])
            kept, at = [], 0
            for b, e in runs:
                kept.append(data[at:b])
                at = e
            left = b"".join([*kept, data[at:]])
            rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])


def remove_repeats(docs: DataFrame, min_bytes: int = 400, keep_first: bool = True) -> DataFrame:
    """The documents with a struct column _repeats: n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    spans = repeated_spans(docs.select("doc_id", "text"), min_bytes, keep_first)
    by_doc = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    cut = arrow_udf(_cut, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>").asNondeterministic()
    joined = packed(docs, *_row_key(F.col("doc_id"), F.col("text").cast("string"))).join(by_doc, [*_KEY], "left")
    text = F.col("row").getField("text").cast("string")
    return joined.select(*unpacked(docs.columns), cut(text, F.col("spans.b"), F.col("spans.e")).alias(fresh(docs, "_repeats")))


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the text that is left (bytes of characters that were cut in two are replaced)."""
    done = remove_repeats(docs.select("doc_id", "text"), 400, keep_first=False)
    return done.select("doc_id", *[F.col(f"_repeats.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")], F.make_valid_utf8(F.col("_repeats.kept").cast("string")).alias("text"))
