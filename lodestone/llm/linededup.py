"""Line deduplication by keys of trimmed, lower-cased lines, in DataFrame functions only.

Hashes (128 bits) of line keys are range-partitioned together with their document and sorted by hash, document and
position within each range; a window over (hash, document) streams through them and numbers the occurrences, so the first
of a document is told from the rest. How many documents hold a hash, and which one keeps it, is then summed up, one row a
range for a hot line, however many ranges its documents fill. Hashes are written once, so texts are read twice in all.
Dropped positions come back as run-length compressed keep bitmaps, one row per document with drops, and only they meet
the texts again. Common lines are joined to their places by broadcast if few, otherwise the hottest by broadcast and the
rest in a shuffle.

Nulls: a null text is one empty line; a null doc_id counts as one document below all others. Rows with equal doc_id and
text are one document and fare alike; rows that share only the doc_id are told apart, though they count as one document
for a line. Very long texts are split in place; only their hashes are shuffled one by one. Empty tables give no rows.
Other columns, whatever their names, are kept by line_dedup(); its own _n_lines and _n_dropped get underscores after them
where the documents have such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hot_join, materialise, packed, unpacked

#: Upper and lower case of A-Z; the white space bytes 20 and 09 to 0D.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"

_NO_ID = -(1 << 63)

#: Common lines up to this many are broadcast (24 bytes each) to find their places; beyond it that join is shuffled.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by doc_id and text."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))).cast("binary")))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() where it can't touch another letter, as translate() is slow."""
    plain = F.octet_length(c) == F.length(c)
    caseless = c.rlike(r"^[\x00-\x7F\p{Ll}\p{Lo}\p{Nd}\p{P}\p{Z}]*$")
    return F.when(plain | caseless, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def drop_maps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Compressed keep bitmaps: row_key, n_dropped, runs (start, length of dropped lines; the rest is kept)."""
    # the row's key is made before lines are, else it would be made again for each of them
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), _row_key(F.col("doc_id"), F.col("text")).alias("row_key"), _lines(F.col("text")).alias("lines"))
    lines = ids.select("doc", "row_key", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    keys = lines.select("doc", "row_key", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    hashes = materialise(keys.select(F.unhex(F.md5(lower_ascii(F.col("key")).cast("binary"))).alias("h"), "doc", "row_key", "pos"), "line-hashes")
    ranged = hashes.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "pos")
    # the ranges and their order are what the window needs: it adds neither an exchange nor a sort
    first = F.row_number().over(Window.partitionBy("h", "doc").orderBy("pos")) == 1
    held = ranged.select("h", "doc", first.alias("first")).groupBy("h")
    common = held.agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    common = materialise(common.select("h", "n", "keeper"), "common-lines")
    few = common.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    found = hashes.join(F.broadcast(common), "h") if few else hot_join(hashes, common, ["h"], hashes.count())
    dropped = found.where(F.col("doc") != F.col("keeper"))
    per_row = dropped.groupBy("row_key").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get(F.col("at"), i - 1) != x - 1))
    last = F.filter("at", lambda x, i: F.coalesce(F.get(F.col("at"), i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return per_row.select("row_key", F.size("at").cast("long").alias("n_dropped"), runs.alias("runs"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with their columns, text without the dropped lines, plus n_lines and n_dropped as _n_lines, _n_dropped.

    A text of which nothing is dropped, null included, stays as it is.
    """
    maps = drop_maps(docs, min_chars, min_docs)
    joined = packed(docs, _row_key(F.col("doc_id"), F.col("text")).alias("row_key")).join(maps, "row_key", "left")
    text = F.col("row").getField("text")
    joined = joined.select("row", "runs", "n_dropped", _lines(text).alias("lines"))
    # kept stretches lie between dropped runs: slices, so the cost is linear in the lines
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))), "\n")
    return joined.select(
        *unpacked(docs.columns, F.when(F.col("runs").isNull(), text).otherwise(kept)),
        F.size("lines").cast("long").alias(fresh(docs, "_n_lines")),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias(fresh(docs, "_n_dropped")),
    )


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    done = line_dedup(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, i - 1 AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i)
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (c.key IS NOT NULL AND l.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos)
              FILTER (c.key IS NULL OR l.doc_id = c.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN common c USING (key)
GROUP BY l.r, l.doc_id
"""
