"""Nearest neighbours by learned partitions.

On a bounded sample of vectors the graph of nearest neighbours is partitioned into balanced parts: balanced clustering
to start with, then nodes move to the part most of their neighbours are in while capacities hold. A softmax classifier
learns which parts a vector's neighbours lie in. Every vector is indexed under its most probable part; biases of the parts
are set, in a few passes that count the whole table's vectors by part, so that parts are balanced there as well. A query
probes its most probable parts, as many as it takes to hold RECALL of the true neighbours of sampled vectors that the
classifier was not fitted on, and what it finds is reranked exactly: cosine of the original vectors in double precision.

The number of parts grows with the square root of the table, up to one for every 32 vectors of the largest sample. A
part's vectors and queries are cut into cells of bounded size, and each pair of cells is one small task, so parts that
grow beyond that mean more tasks, not larger ones. Of identical vectors only the k + 1 smallest ids can be among anyone's
k nearest, so no others are searched; identical queries are searched once.

Left out are null vectors, zero vectors, vectors with null or non-finite components, null ids, and vectors and queries that
don't have the commonest dimension of the vectors (ties: the smaller one). Repeated rows (same id and vector) count once;
rows that share an id only are separate candidates but never each other's. Equal scores go to the smaller id. Empty
tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import materialise

#: Vectors that the parts and the classifier are learned from, at least (if there are as many) and at most.
SAMPLE = 8_192
LARGEST_SAMPLE = 32_768
#: Parts for the square root of the number of vectors.
PARTS_A_ROOT = 0.18
#: The largest part may be so many times the mean before biases are set again, in at most so many passes.
UNBALANCED = 1.25
PASSES = 4
#: Neighbours of a node of the sample's graph.
DEGREE = 10
#: Share of true neighbours of sampled vectors, apart from those fitted on, that the probed parts must hold.
RECALL = 0.97
#: Rows and queries of a cell.
CELL_ROWS = 4_096
CELL_QUERIES = 2_048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<double>) that take part, of any dimension."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def dimension(rows: DataFrame) -> int:
    """The commonest length of v; 0 without rows."""
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return top["d"] if top else 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest of each row (or of those that `of` names), itself aside."""
    of = np.arange(len(x)) if of is None else of
    out = np.empty((len(of), k), dtype=np.int64)
    for at in range(0, len(of), 1024):
        rows = of[at : at + 1024]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _deal(scores: np.ndarray, capacity: int) -> np.ndarray:
    """Each row to its best column with room; rows with the largest gap to their second choice go first."""
    n, parts = scores.shape
    top = np.partition(scores, parts - min(2, parts), axis=1)[:, -min(2, parts) :]
    order = np.argsort(top[:, 0] - top[:, -1], kind="stable")
    room = np.full(parts, capacity)
    out = np.empty(n, dtype=np.int64)
    ranked = np.argsort(-scores, axis=1, kind="stable")
    for i in order:
        for p in ranked[i]:
            if room[p]:
                room[p] -= 1
                out[i] = p
                break
    return out


class Router:
    """Balanced parts of a sample's neighbour graph and the classifier that routes vectors to them."""

    def __init__(self, sample: np.ndarray, parts: int, k: int):
        x = _unit(sample.astype(np.float64)).astype(np.float32)
        n = len(x)
        parts = max(1, min(parts, n // 32))
        self.parts, self.probes, self.k = parts, 1, k
        self.weights = np.zeros((x.shape[1] + 1, parts), dtype=np.float32)
        self.bias = np.zeros(parts, dtype=np.float32)
        self.sample = x
        self.fitted = np.random.default_rng(7).permutation(n) % 4 > 0  # a quarter is kept for setting the probes
        if parts == 1:
            return
        x = x[self.fitted]
        n = len(x)
        rng = np.random.default_rng(7)
        capacity = int(np.ceil(1.1 * n / parts))
        centres = x[rng.choice(n, parts, replace=False)]
        for _ in range(8):
            part = _deal(x @ centres.T, capacity)
            sums = np.zeros_like(centres)
            np.add.at(sums, part, x)
            centres = _unit(sums + 1e-9)
        graph = _neighbours(x, min(DEGREE, n - 1))
        for _ in range(6):
            votes = np.zeros((n, parts), dtype=np.float32)
            np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
            moved = _deal(votes + 0.01 * (x @ centres.T), capacity)
            if (moved == part).mean() > 0.995:
                break
            part = moved
        votes = np.zeros((n, parts), dtype=np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        target = (votes + (np.arange(parts) == part[:, None])) / (graph.shape[1] + 1)
        self._fit(x, target)
        for _ in range(30):
            self.rebalance(np.bincount(self.home(self.sample), minlength=parts))

    def rebalance(self, counts: np.ndarray) -> None:
        """Moves the biases against parts that hold more vectors than the mean."""
        self.bias -= (0.3 * np.log((counts + 1) / (counts.mean() + 1))).astype(np.float32)

    def set_probes(self) -> None:
        """As many parts as hold RECALL of the nearest neighbours, within the sample, of its vectors that weren't fitted."""
        if self.parts > 1:
            held = np.flatnonzero(~self.fitted)
            near = _neighbours(self.sample, min(self.k, len(self.sample) - 1), held)
            order = np.argsort(-self.logits(self.sample[held]), axis=1)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(self.parts)[None, :].repeat(len(held), 0), 1)
            needed = np.take_along_axis(rank, self.home(self.sample)[near], 1)
            share = np.array([(needed < m).mean() for m in range(1, self.parts + 1)])
            self.probes = int(np.argmax(share >= RECALL)) + 1
        self.sample = self.fitted = np.zeros(0)  # not sent to executors

    def _fit(self, x: np.ndarray, target: np.ndarray, steps: int = 120, rate: float = 0.3) -> None:
        a = np.hstack([x * np.float32(np.sqrt(x.shape[1])), np.ones((len(x), 1), dtype=np.float32)])
        w = np.zeros((a.shape[1], target.shape[1]), dtype=np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = a @ w
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = a.T @ (p - target) / len(a) + 1e-4 * w
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1, 2 * (1 - step / (steps + 1)))
        self.weights = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x * np.float32(np.sqrt(x.shape[1]))) @ self.weights[:-1] + self.weights[-1] + self.bias

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def route(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def learn(rows: DataFrame, k: int) -> Router:
    """The router of a bounded sample; its parts are balanced over all rows."""
    n = rows.count()
    if not n:
        return Router(np.ones((1, 1)), 1, k)
    parts = max(1, round(PARTS_A_ROOT * n**0.5))
    size = min(LARGEST_SAMPLE, max(SAMPLE, 64 * parts))
    spread = 1 << 30
    part = min(spread, int(spread * 0.95 * size / n))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(spread)) < F.lit(part)).select("vec_id", "v").limit(size).toArrow().sort_by("vec_id")
    x = np.array(some["v"].to_pylist(), dtype=np.float64).reshape(some.num_rows, -1)
    router = Router(np.unique(x, axis=0) if len(x) else np.ones((1, 1)), parts, k)
    for _ in range(PASSES if router.parts > 1 else 0):
        counts = np.zeros(router.parts, dtype=np.int64)
        for r in rows.groupBy(_home(rows.sparkSession, router)("v").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["part"]] = r["n"]
        if counts.max() <= UNBALANCED * counts.mean():
            break
        router.rebalance(counts)
    router.set_probes()
    return router


def _home(spark: SparkSession, router: Router):
    sent = spark.sparkContext.broadcast((router.weights, router.bias))

    @arrow_udf("int")
    def home(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.int32())
        x = _unit(np.array(column.to_pylist(), dtype=np.float64)).astype(np.float32)
        weights, bias = sent.value
        return pa.array(((x * np.float32(np.sqrt(x.shape[1]))) @ weights[:-1] + weights[-1] + bias).argmax(1), pa.int32())

    return home


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k nearest found of each query (rows vec_id, embedding), itself aside."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = dimension(rows)
    rows = rows.where(F.size("v") == width).distinct()
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = materialise(rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("vec_id", "v"), "vectors")
    asked = usable(queries).where(F.size("v") == width).distinct()
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    router = learn(rows, k)
    sent = spark.sparkContext.broadcast(router)
    home = _home(spark, router)

    @arrow_udf("array<int>")
    def route(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        x = _unit(np.array(column.to_pylist(), dtype=np.float64))
        return pa.array(sent.value.route(x.astype(np.float32)).tolist(), pa.list_(pa.int32()))

    indexed = materialise(rows.withColumn("part", home("v")), "index")
    routed = materialise(distinct.withColumn("part", F.explode(route("v"))), "routes")
    # how many cells of vectors and of queries a part has: one small row a part
    held = indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("row_cells"))
    put = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("query_cells"))
    cells = F.broadcast(held.join(put, "part"))
    left = indexed.join(cells, "part").select("part", F.pmod(F.xxhash64("vec_id"), F.col("row_cells")).alias("rc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_cells").cast("long") - 1)).alias("qc"), "vec_id", "v")
    right = routed.join(cells, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_cells").cast("long") - 1)).alias("rc"), F.pmod(F.xxhash64("q"), F.col("query_cells")).alias("qc"), "q", "v")
    most = k + 1

    def near(one: pa.Table, two: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        ids, asks = one["vec_id"].to_numpy(), two["q"].to_numpy()
        x, y = np.array(one["v"].to_pylist(), dtype=np.float64), np.array(two["v"].to_pylist(), dtype=np.float64)
        nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
        out = []
        take = min(len(ids), most)
        for at in range(0, len(asks), 256):
            s = (y[at : at + 256] @ x.T) / nx
            least = np.partition(s, len(ids) - take, axis=1)[:, -take]
            least -= 1e-9 * np.abs(s).max(1)  # the products' rounding; ties are all taken and settled exactly
            for i, row in enumerate(s, at):
                b = np.flatnonzero(row >= least[i - at])
                exact = np.einsum("ij,j->i", x[b], y[i]) / (nx[b] * ny[i])
                order = np.lexsort((ids[b], -exact))[:most]
                out.append((np.full(len(order), asks[i]), ids[b][order], exact[order]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    found = left.groupBy("part", "rc", "qc").cogroup(right.groupBy("part", "rc", "qc")).applyInArrow(near, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("q", "vec_id", "score")
    names = asked.join(distinct.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), "q")
    mine = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    out = names.join(found, "q").where(F.col("query_id") != F.col("vec_id")).withColumn("rank", F.row_number().over(mine).cast("int"))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))


def brute_force(ids: list[int], vectors: list, k: int = 5) -> dict[int, list[int]]:
    """Exact neighbours for tests: ids divisible by 50 against all."""
    x = np.array(vectors, dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = np.array(ids)
    out = {}
    for i in np.flatnonzero(at % 50 == 0):
        s = x @ x[i]
        order = np.lexsort((at, -s))
        out[int(at[i])] = [int(at[j]) for j in order if at[j] != at[i]][:k]
    return out
