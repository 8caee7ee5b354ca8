"""Toxicity by class-conditional Kneser-Ney models of words as chains of beginnings.

Two models, of toxic and of ordinary labelled documents, give a word the product of conditional probabilities along
its chain: its first 5 letters, 6 given 5, 7 given 6, and the word given its longest beginning. Counts are continuation
counts with documents as contexts: n(p, x) is in how many documents of the class p goes on as x, however often. Where
the classes' shares of the documents that hold p make s * n of them expected, the discount of a class is MARGIN times
those odds, plus DEVIATIONS standard deviations, plus DISCOUNT:

    own(x) = max(n(p, x) - discount, 0)              counts that tell the classes apart
    left(p) = 1 - sum of own(x) / sum of n(p, x)     the backoff weight of the class
    shared(x) = what was discounted from both classes, as a share of all that was discounted under p
    P(x | p) = own(x) / sum of n(p, .) + left(p) * shared(x)

Discounted counts go to one shared backoff that both models use, so a rare expression, or one that is about as frequent in
both classes, has probabilities that differ by the backoff weights only. Longer contexts (the word before) were tried and
gave worse results, as copies of labelled documents then decide.

Counts cover every labelled document outside the held-out fold, as tables that grow with them; contexts with very many
continuations are joined by broadcast of their totals, so no task gets all of them. Every expression with own counts is
used. Up to SENT of them are broadcast; beyond that, documents are dealt into groups, and each group is sent, through a
join with the table, those that its texts hold.

A text's log-likelihoods are normalised by its length; a word that it holds n times counts 1 + log2(n) times in both, as
junk repeats words. The score is a logistic function of their difference (damped by arcsinh), less that of a word with no
own counts. Its two parameters are fitted on about CALIBRATION labelled documents at most, each scored by models
that have not seen its fold.

Nulls: a null or empty text has no words and gets the score of difference 0. Unlabelled documents and null labels are
not learned from; of several labels of one document the largest holds. With one class only, every score is that class.
Repeated rows count repeatedly. Very long texts are scored whole. Empty tables are fine. Columns of other names are
kept; score() adds _score, with underscores after it where the documents have such a column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, fresh, held_out, hot_join, letter_words, logistic_fit, materialise, packed, sample_hash, unpacked, with_labels

#: Expressions that are broadcast; more go through a shuffle.
SENT = 1 << 20
#: Documents of a group that is scored with the expressions of its own texts.
GROUP = 500
#: The discount: MARGIN x the expected odds, DEVIATIONS standard deviations, DISCOUNT.
MARGIN = 1.5
DEVIATIONS = 1.0
DISCOUNT = 1.0
#: Letters of the beginnings in a word's chain.
BEGINNINGS = (5, 6, 7)
#: Labelled documents that the score's parameters are fitted on, at most.
CALIBRATION = 6_000
#: Folds of labelled documents: remainders 0, 1, 3 of the crc32 of the id.
FOLDS = (0, 1, 3)
#: Neutral words that every text is lengthened by, so that one word does not decide on a text of two.
PSEUDO_WORDS = 10
THRESHOLD = 0.3

_FLUSH = 150_000
#: Words whose chains, or values, a task remembers: about 400 and 150 bytes each.
_CHAINS = 60_000
_MEMO = 200_000
_COLUMNS = [f"c{y}{f}" for y in (0, 1) for f in FOLDS]
#: The model of all folds (-1) and those without a fold.
_MODELS = (-1, *FOLDS)


def chain(word: bytes) -> list[bytes]:
    """The beginnings of a word, marked by a star, and the word."""
    text = word.decode("utf-8", "replace")
    return [*(text[:n].encode() + b"*" for n in BEGINNINGS if len(text) > n), word]


def _parent(e: Column) -> Column:
    """The longest beginning that e goes on from; empty for the first link of a chain."""
    letters = F.when(F.endswith(e, F.lit("*")), F.length(e) - 1).otherwise(F.length(e))
    out = F.lit("")
    for n in BEGINNINGS:
        out = F.when(letters > n, F.concat(F.substring(e, 1, n), F.lit("*"))).otherwise(out)
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """Documents that hold an expression, by class and fold, with its parent p."""
    arrow = pa.schema([("e", pa.string()), *((c, pa.int64()) for c in _COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in _COLUMNS]
        links: dict[bytes, list[bytes]] = {}

        def flush() -> pa.RecordBatch:
            names = list(set().union(*held))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in held)], schema=arrow)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text, label, f in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found: set[bytes] = set()
                    for w in set(letter_words(text)):
                        if (c := links.get(w)) is None:
                            if len(links) >= _CHAINS:
                                links.clear()
                            c = links[w] = chain(w)
                        found.update(c)
                    held[label * len(FOLDS) + FOLDS.index(f)].update(found)
                if sum(map(len, held)) >= _FLUSH:
                    yield flush()
        if any(held):
            yield flush()

    counted = rows.select(F.col("text").cast("string"), F.col("_label"), fold().cast("int").alias("f")).mapInArrow(run, "e string, " + ", ".join(f"{c} long" for c in _COLUMNS))
    summed = counted.groupBy("e").agg(*[F.sum(c).alias(c) for c in _COLUMNS])
    return summed.withColumn("p", _parent(F.col("e")))


def _of(prefix: str, m: int) -> list[Column]:
    """Sums over the folds of model m, by class, as doubles."""
    return [reduce(add, [F.col(f"{prefix}{y}{f}") for f in FOLDS if f != m]).cast("double") for y in (0, 1)]


def _own(m: int) -> list[Column]:
    c, total = _of("c", m), [x + F.lit(0.5) for x in _of("t", m)]
    n = c[0] + c[1]
    deviation = F.sqrt(n * total[0] * total[1]) / (total[0] + total[1])
    share = [F.lit(MARGIN) * total[y] / (total[1 - y] + F.lit(MARGIN) * total[y]) for y in (0, 1)]
    return [F.greatest(c[y] - share[y] * n - F.lit(DEVIATIONS) * deviation - F.lit(DISCOUNT), F.lit(0.0)) for y in (0, 1)]


def _log_ratio(top: Column, bottom: Column) -> Column:
    return F.log(F.greatest(top, F.lit(1e-9)) / F.greatest(bottom, F.lit(1e-9)))


def ratios(rows: DataFrame) -> DataFrame:
    """Per expression e: r<m>, the log ratio of its conditional probabilities in model m where it has own counts, and
    l<m>, that of the backoff weights after it where something that goes on from it has. rows: doc_id, text, _label."""
    counts = materialise(_counts(rows), "toxic-counts")
    totals = counts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t{c[1:]}") for c in _COLUMNS])
    totals = materialise(totals, "toxic-contexts")
    known = hot_join(counts, totals, ["p"], counts.count()).drop("n")
    events = materialise(known.where(reduce(or_, [o > 0 for m in _MODELS for o in _own(m)])), "toxic-expressions")
    own = {(m, y): o for m in _MODELS for y, o in enumerate(_own(m))}
    used = events.groupBy("p").agg(F.count(F.lit(1)).alias("n"), *[F.sum(o).alias(f"u{y}_{m + 1}") for (m, y), o in own.items()])
    used = materialise(used, "toxic-own")
    right, left = [], []
    for m in _MODELS:
        c, t, u = _of("c", m), _of("t", m), [F.col(f"u{y}_{m + 1}") for y in (0, 1)]
        size = [F.greatest(x, F.lit(1.0)) for x in t]
        weight = [1 - u[y] / size[y] for y in (0, 1)]
        shared = (c[0] + c[1] - own[m, 0] - own[m, 1]) / F.greatest(t[0] + t[1] - u[0] - u[1], F.lit(1e-9))
        p = [own[m, y] / size[y] + weight[y] * shared for y in (0, 1)]
        has = (own[m, 0] > 0) | (own[m, 1] > 0)
        backoff = _log_ratio(weight[1], weight[0])
        right.append(F.when(has, _log_ratio(p[1], p[0])).otherwise(backoff).alias(f"r{m + 1}"))
        left.append(backoff.alias(f"l{m + 1}"))
    with_used = hot_join(events, used, ["p"], events.count()).select("e", *right)
    contexts = totals.drop("n").join(used, "p").select(F.col("p").alias("e"), *left)
    return materialise(with_used.join(contexts, "e", "full"), "toxic-ratios")


class Ratios:
    """The log ratios of one model, of some or all expressions."""

    def __init__(self, table: pa.Table, m: int):
        names = table["e"].cast(pa.binary()).to_pylist()
        self.event, self.after = ({e: x for e, x in zip(names, table[f"{kind}{m + 1}"].to_pylist(), strict=True) if x is not None} for kind in "rl")
        self.base = self.after.get(b"", 0.0)
        self.memo: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        """Toxic minus ordinary log-probability of a word, less that of one without own counts."""
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            got, p = -self.base, b""
            for e in chain(w):
                x = self.event.get(e)
                got += self.after.get(p, 0.0) if x is None else x
                p = e
            self.memo[w] = got
        return got

    def difference(self, text: str | None) -> float:
        """Toxic minus ordinary log-likelihood, per word."""
        words = letter_words(text)
        if not words or not self.event:
            return 0.0
        total, length = 0.0, float(PSEUDO_WORDS)
        known = self.memo
        for w, n in Counter(words).items():
            x = known.get(w)
            if x is None:
                x = self.word(w)
            times = 1.0 if n == 1 else 1 + math.log2(n)
            total += times * x
            length += times
        return total / length


class Model:
    """The table of ratios, few enough to be sent out."""

    def __init__(self, table: pa.Table):
        self.table = table

    def differences(self, docs: DataFrame, text: Column, m: Column | None = None) -> DataFrame:
        """docs with _difference, by the model that m names (default: of all folds)."""
        sent = docs.sparkSession.sparkContext.broadcast(self.table)
        if m is not None:

            @arrow_udf("double")
            def unseen(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                by = {k: Ratios(sent.value, k) for k in _MODELS}
                for texts, models in batches:
                    yield pa.array([by[k].difference(t) for t, k in zip(texts.to_pylist(), models.to_pylist(), strict=True)], pa.float64())

            return docs.withColumn("_difference", unseen(text, m))

        @arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = Ratios(sent.value, -1)
            for batch in batches:
                out: list[float] = []
                for at in range(0, len(batch), 256):
                    out += [held.difference(t) for t in batch.slice(at, 256).to_pylist()]
                yield pa.array(out, pa.float64())

        return docs.withColumn("_difference", run.asNondeterministic()(text))


class Table:
    """The same ratios as a table that is too large to send out."""

    def __init__(self, table: DataFrame):
        self.table = table

    def differences(self, docs: DataFrame, text: Column, m: Column | None = None) -> DataFrame:
        """As Model does. Groups are dealt by the text, with its place among equal ones as salt, and a group asks for an
        expression once, so neither a common word nor a common text makes a hot key."""
        groups = max(1, -(-docs.count() // GROUP))
        dealt = docs.withColumn("_text", text).withColumn("_m", F.lit(-1) if m is None else m)
        dealt = materialise(dealt.withColumn("_group", F.pmod(F.xxhash64(F.col("_text"), F.monotonically_increasing_id()), F.lit(groups))), "toxic-groups")
        arrow = pa.schema([("_group", pa.int64()), ("e", pa.string())])

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part, found = batch.slice(at, 64), set()
                    for g, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        found.add((g, b""))
                        found.update((g, e) for w in set(letter_words(t)) for e in chain(w))
                    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int64()), pa.array([e for _, e in found], pa.binary()).cast(pa.string())], schema=arrow)

        def run(texts: pa.Table, some: pa.Table) -> pa.Table:
            by: dict[int, Ratios] = {}
            out = []
            for t, k in zip(texts["_text"].to_pylist(), texts["_m"].to_pylist(), strict=True):
                if k not in by:
                    by[k] = Ratios(some, k)
                out.append(by[k].difference(t))
            return texts.drop_columns(["_group", "_text", "_m"]).append_column("_difference", pa.array(out, pa.float64()))

        asked = dealt.select("_group", "_text").mapInArrow(held, "_group long, e string").distinct()
        answers = asked.join(self.table, "e").select("_group", *self.table.columns)
        schema = StructType([*docs.schema.fields, StructField("_difference", DoubleType())])
        return dealt.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(run, schema)


def _feature(difference: np.ndarray) -> np.ndarray:
    return np.arcsinh(100 * difference)


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[Model | Table, np.ndarray] | float:
    """The models and the logistic weights; the share of the one class if there is one only."""
    rows = with_labels(docs.select("doc_id", "text").where(~held_out()), labels.select("doc_id", column), column)
    rows = rows.withColumn("_label", (F.col("_label") > 0).cast("int"))
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(sizes.get(1, 0) > 0)
    table = ratios(rows)
    few = table.limit(SENT + 1).count() <= SENT
    model = Model(table.toArrow().sort_by("e")) if few else Table(table)
    spread = 1 << 30
    part = min(spread, int(spread * CALIBRATION / sum(sizes.values())))
    some = rows.where(F.pmod(sample_hash(), F.lit(spread)) < F.lit(part)).select(F.col("text").cast("string").alias("text"), fold().cast("int").alias("f"), F.col("_label").alias("y"))
    fit = model.differences(some, F.col("text"), F.col("f")).select(F.col("_difference").alias("x"), "y").toArrow()
    y = fit["y"].to_numpy().astype(float)
    if not len(y) or not 0 < y.mean() < 1:
        return float(sizes[1] / sum(sizes.values()))
    x = _feature(fit["x"].to_numpy())
    w = logistic_fit(x[:, None], y)
    return model, np.array([max(1e-3, w[0]), w[1]])


def score(docs: DataFrame, learned: tuple[Model | Table, np.ndarray] | float) -> DataFrame:
    """The documents with a column _score."""
    name = fresh(docs, "_score")
    if isinstance(learned, float):
        return docs.select("*", F.lit(learned).alias(name))
    model, w = learned

    done = model.differences(packed(docs), F.col("row").getField("text").cast("string"))
    z = F.lit(float(w[0])) * F.asinh(F.lit(100.0) * F.col("_difference")) + F.lit(float(w[1]))
    return done.select(*unpacked(docs.columns), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias(name))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score under the threshold."""
    name = fresh(docs, "_score")
    return score(docs, learn(docs, labels)).where(F.col(name) < threshold).drop(name)
