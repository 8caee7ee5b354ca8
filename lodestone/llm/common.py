"""Shared plumbing of the corpus operators: inputs, scratch tables, label joins and batch UDFs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..runtime import spread

#: Label rows up to this many are broadcast (16 bytes each); beyond it the join is shuffled.
BROADCAST_LABELS = 2_000_000

#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and executors may be lost.

    The files are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a shuffled join may bring into one task; keys with more rows, and a 65,536th of all, are broadcast.
HOT_ROWS = 1_000


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows (total of them) with table, which has each key once, with how many of the rows hold it as n.

    A key with more than total / 65,536 rows is hot. There are fewer than 65,536 of those, whatever the data, so their
    side of the join is broadcast and their rows stay where they are. Both tables are read twice: give materialised ones.
    """
    cut = max(HOT_ROWS, total >> 16)
    hot = table.where(F.col("n") > F.lit(cut))
    if hot.isEmpty():
        return rows.join(table, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col("n") <= F.lit(cut)), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def packed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """The documents' columns as one struct, row, beside more columns: whatever names they have, none clash."""
    return docs.select(F.struct("*").alias("row"), *more)


def unpacked(columns: list[str], text: Column | None = None) -> list[Column]:
    """The columns of row again, with another text if one is given."""
    return [text.alias(c) if text is not None and c == "text" else F.col("row").getField(c).alias(c) for c in columns]


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it differ from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 2


def sample_hash(doc_id: str = "doc_id") -> Column:
    """A fixed pseudo-random order of documents, for bounded samples that don't depend on partitioning."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample"))


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled doc_id; of repeated rows the largest label holds, null labels don't count."""
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg(F.max(F.col(column)).cast("int").alias("_label"))
    )


def with_labels(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Inner join of documents with their label as _label; labels are broadcast only if few enough."""
    rows = label_rows(labels, column)
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.join(F.broadcast(rows) if small else rows, F.col("doc_id") == F.col("_label_id")).drop("_label_id")


def batch_udf(work: Callable[[list], dict[str, list]], schema: str, types: dict[str, pa.DataType], state: Callable[[], object] | None = None):
    """An Arrow UDF of one column. work takes up to SLICE_ROWS values (with state() first, built once a task) and returns columns."""

    @arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = state() if state else None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            for at in range(0, len(batch), SLICE_ROWS):
                values = batch.slice(at, SLICE_ROWS).to_pylist()
                for k, v in (work(held, values) if state else work(values)).items():
                    out[k].extend(v)
            yield pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    return apply.asNondeterministic()  # evaluated once, never copied into a filter


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MARKS = re.compile(rb"\xe2\x80.|\xe2\x81.|\xe3\x80.|\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xc3[\x97\xb7]", re.DOTALL)


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters as UTF-8; ASCII, Latin-1 and general punctuation and spaces part them."""
    if not text:
        return []
    data = text.lower().encode("utf-8", "replace")
    if not text.isascii():
        data = _MARKS.sub(b" ", data)
    return data.translate(_LETTERS).split()


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
