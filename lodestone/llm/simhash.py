"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, connected components.

Fingerprints within `distance` bits link. Distinct fingerprints only are compared, so exact copies cost one row. Bits
are cut into blocks such that linked fingerprints agree on all but `distance` of them; one key per choice of agreeing
blocks. A bucket of fingerprints with one key is verified in place and yields a spanning forest, not all its pairs.
Buckets with more than SMALL members are dealt anew under finer keys that leave 4 bits per differing block free, so no
such bucket can hold more than 2 ** (4 * distance) fingerprints.

Rows meet the component of their fingerprint in a join that broadcasts the hottest fingerprints.

Nulls: a null text has no words, fingerprint 0. Repeated rows keep their rows. An empty table gives no rows. Very long
texts are shingled whole, hashes in a row of numbers. The component id is the smallest non-null doc_id of the component,
null if it has none; keep_one() goes by components, so two components without ids, or with one id, keep a row each; of
rows that tie in id and text one is kept. Extra columns are ignored, or kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, hot_join, materialise, packed, unpacked

#: Members of a bucket that are compared at once.
SMALL = 2048

_POWERS = (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased, ASCII white space between words; no words: 0."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts)
    if n < words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(view[a:b], seed) for a, b in spans), dtype=np.uint64, count=n - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * counts > len(hashes)].sum(dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts: list) -> dict[str, list]:
    return {"fp": [_signed(fingerprint(t)) for t in texts]}


def fingerprint_udf(column: str):
    return batch_udf(_fingerprints, "struct<fp:long>", {"fp": pa.int64()})(column)


def block_masks(blocks: int, distance: int) -> list[int]:
    """64-bit masks, one for each choice of blocks - distance agreeing blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints that lie within distance bits of each other."""
    left, edges = np.arange(len(values)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(at, int(x)) for x in found]
                front += found.tolist()
    return edges


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("b")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.b")


def _bucket_edges(keyed: DataFrame, distance: int, most: int) -> DataFrame:
    """Edges within buckets of 2 to `most` fingerprints."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            src, dst = [], []
            for members in group["members"]:
                values = np.asarray(members, dtype=np.int64)
                for a, b in forest(values.view(np.uint64), distance):
                    src.append(values[a])
                    dst.append(values[b])
            yield pd.DataFrame({"a": np.array(src, dtype=np.int64), "b": np.array(dst, dtype=np.int64)})

    sizes = keyed.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    sizes = sizes.where((F.col("n") > 1) & (F.col("n") <= most))
    pairs = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(F.bit_count(F.expr("a ^ b")) <= distance)
    more = keyed.join(sizes.where("n > 2").select("k", "b"), ["k", "b"]).groupBy("k", "b").agg(F.array_sort(F.collect_list("fp")).alias("members"))
    return pairs.unionByName(more.select("members").mapInPandas(run, "a long, b long"))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect what the links of the distinct fingerprints fp connect."""
    coarse = _keyed(fps, block_masks(2 * distance, distance))
    edges = _bucket_edges(coarse, distance, SMALL)
    hot = coarse.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("k", "b")
    hot = materialise(coarse.join(hot, ["k", "b"]).select("fp").distinct(), "hot-fingerprints")
    if not hot.isEmpty():
        edges = edges.unionByName(_bucket_edges(_keyed(hot, block_masks(16, distance)), distance, 1 << 4 * distance))
    return edges


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest label of each node's component. nodes: (fp, label), edges: (a, b); rows (fp, label, r) of nodes with edges,
    r one fingerprint for all of a component.

    Hooks each root onto the smallest neighbouring root and halves paths, so rounds grow with the logarithm of a
    component's width. Each round is written to the shared folder.
    """
    edges = materialise(edges, "links")  # read in both directions below, so the links must be the same each time
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    pairs = materialise(both, "edges")
    if pairs.isEmpty():
        return nodes.limit(0).withColumn("r", F.col("fp"))
    root = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("r"))
    root = materialise(root.select(F.col("a").alias("fp"), "r"), "roots")
    while True:
        of_a = root.select(F.col("fp").alias("a"), F.col("r").alias("ra"))
        of_b = root.select(F.col("fp").alias("b"), F.col("r").alias("rb"))
        cross = pairs.join(of_a, "a").join(of_b, "b").where("ra > rb").groupBy(F.col("ra").alias("fp")).agg(F.min("rb").alias("to"))
        cross = materialise(cross, "hooks")
        if cross.isEmpty():
            break
        hooked = root.join(cross, "fp", "left").select("fp", F.least("r", F.coalesce("to", "r")).alias("r"))
        for _ in range(2):
            up = hooked.select(F.col("fp").alias("r"), F.col("r").alias("rr"))
            hooked = hooked.join(up, "r", "left").select("fp", F.coalesce("rr", "r").alias("r"))
        root = materialise(hooked, "roots")
    top = root.join(nodes, "fp").groupBy("r").agg(F.min("label").alias("label"))
    return root.join(top, "r").select("fp", "label", "r")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """Per document: doc_id, text_hash (xxhash64 of the text, null: of the empty text), fp long, component_id, component (never null)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fingerprint_udf("text").alias("x"))
    rows = materialise(rows.select("doc_id", "text_hash", "x.fp"), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    linked = components(links(nodes.select("fp"), distance), nodes.select("fp", "label"))
    named = nodes.join(linked.withColumnRenamed("label", "lower"), "fp", "left")
    named = materialise(named.select("fp", "n", F.coalesce("lower", "label").alias("component_id"), F.coalesce("r", "fp").alias("component")), "components")
    return hot_join(rows, named, ["fp"], rows.count()).select("doc_id", "text_hash", "fp", "component_id", "component")


def op9_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The documents, one of each component: its smallest doc_id, and of rows that share that id the smallest text hash."""
    found = near_duplicates(docs, distance)
    keep = found.groupBy("component").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), "text_hash", "doc_id")).alias("m"))
    keep = keep.select(F.col("m.doc_id").alias("keep_id"), F.col("m.text_hash").alias("keep_hash")).distinct()
    hashed = packed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    kept = hashed.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")), "left_semi")
    return kept.groupBy("id", "text_hash").agg(F.first("row").alias("row")).select(*unpacked(docs.columns))
