"""Lexical and fuzzy search over postings.

postings() lists, for each chunk, its lexemes with their places: full tokens with weight A, stem prefixes after the last
place with weight D. A query's lexemes are a small table; candidates come from an equi-join on the lexeme, so only chunks
that hold one of them are evaluated. Queries that a chunk without any of their lexemes could match take all chunks.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import tsquery
from ..functions.normalise import Registry
from ..functions.stemming import lexeme
from ..functions.text import WORD, word_similarity

#: Of stored postings: places beyond this count as this one; a lexeme keeps so many places.
MAX_PLACE = 16_383
MAX_PLACES = 256
#: Words whose trigrams a task remembers.
MEMO = 500_000
#: Chunks whose postings are passed on at once.
PART = 128


def words_of(folded: Column) -> Column:
    """The words of a text, lower-cased one by one, unless the text is in lower case already, as most rule sets leave it."""
    found = F.regexp_extract_all(folded, F.lit(f"({WORD})"), 1)
    return F.when(F.lower(folded) == folded, found).otherwise(F.transform(found, F.lower))


def _placed(chunks: DataFrame, registry: Registry, keep: tuple[str, ...]) -> DataFrame:
    """chunk_id, keep, locale, w (the tokens), s (the stem prefixes, whose places follow those of the tokens)."""
    folded = chunks.withColumn("folded", registry.by_locale(F.col("locale"), lambda r: r.column(F.col("source"))))
    folded = folded.withColumn("stems", registry.by_locale(F.col("locale"), lambda r: r.prefix_column(F.col("folded"))))
    return folded.select("chunk_id", *keep, "locale", words_of(F.col("folded")).alias("w"), words_of(F.col("stems")).alias("s"))


def postings(chunks: DataFrame, registry: Registry, only: set[str] | None = None, keep: tuple[str, ...] = (), last: int | None = MAX_PLACE, most: int | None = MAX_PLACES) -> DataFrame:
    """chunk_id, locale, lexeme, entries (array of place, weight). chunks: chunk_id, locale, source (text to index).

    keep: further columns of the chunks. only: the lexemes asked for; all others go before they are put together.
    last: the place as which all beyond it count; most: how many places of a lexeme are kept. None: each as it is, and all of them.
    """
    placed = _placed(chunks, registry, keep)
    # the number of tokens is taken before they become rows: else each row would carry the chunk's whole array
    placed = placed.select("chunk_id", *keep, "locale", F.size("w").alias("tokens"), F.concat("w", "s").alias("all"))
    rows = placed.select("chunk_id", *keep, "locale", "tokens", F.posexplode("all").alias("at", "lexeme"))
    if only is not None:
        rows = rows.where(F.col("lexeme").isin(sorted(only)))
    rows = rows.select("chunk_id", *keep, "locale", "lexeme", (F.col("at") + 1 if last is None else F.least(F.col("at") + 1, F.lit(last))).alias("place"), F.when(F.col("at") < F.col("tokens"), "A").otherwise("D").alias("weight"))
    lists = rows.groupBy("chunk_id", *keep, "locale", "lexeme").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("entries"))
    return lists if most is None else lists.withColumn("entries", F.slice("entries", 1, most))


def stored_postings(chunks: DataFrame, registry: Registry, keep: tuple[str, ...] = ()) -> DataFrame:
    """postings() with stems for an index, of chunks whose ids are unique: each chunk's lexemes are put together within its row.

    Full tokens of locales with the English search configuration are stemmed and its stop words left out. Nothing is shuffled,
    and a task holds the tokens of one batch and the postings of PART chunks.
    """
    english = registry.by_locale(F.col("locale"), lambda r: F.lit(r.config == "english"))
    rows = _placed(chunks, registry, keep).select("chunk_id", *keep, "locale", english.alias("english"), "w", "s")
    same = ", ".join(f"{c} string" for c in ("chunk_id", *keep, "locale", "lexeme"))
    entry = pa.struct([("place", pa.int32()), ("weight", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                if len(known) > MEMO:
                    known.clear()
                row, names, ends, places, weights = array("q"), [], array("i", [0]), array("i"), []
                for i, (is_english, words, stems) in enumerate(zip(batch.column("english").to_pylist(), batch.column("w"), batch.column("s"), strict=True)):
                    words, held = words.as_py() or [], {}
                    for at, w in enumerate(words, 1):
                        if is_english:
                            if w not in known:
                                known[w] = lexeme(w, "english")
                            w = known[w]
                        if w is not None:
                            held.setdefault(w, []).append((min(at, MAX_PLACE), "A"))
                    for at, w in enumerate(stems.as_py() or [], len(words) + 1):
                        held.setdefault(w, []).append((min(at, MAX_PLACE), "D"))
                    for w, entries in held.items():
                        row.append(i)
                        names.append(w)
                        for p, weight in entries[:MAX_PLACES]:
                            places.append(p)
                            weights.append(weight)
                        ends.append(len(places))
                of = pa.array(row, pa.int64())
                values = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(weights, pa.string())], fields=list(entry))
                made = [batch.column(c).take(of) for c in ("chunk_id", *keep, "locale")] + [pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
                yield pa.RecordBatch.from_arrays(made, ["chunk_id", *keep, "locale", "lexeme", "entries"])

    return rows.mapInArrow(run, f"{same}, entries array<struct<place:int,weight:string>>")


def query_tree(locale: str, registry: Registry, alternatives: list[str], config: str | None = None) -> list | None:
    """The tree of a query's alternatives in a search configuration, or-ed with that of their stem prefixes."""
    rules = registry.resolve(locale)
    full = tsquery.map_terms(tsquery.parse(" OR ".join(alternatives)), lambda w: lexeme(w, config))
    stems = tsquery.parse(" OR ".join(p for a in alternatives if (p := rules.prefixes(a))))
    return tsquery.either(full, stems)


def search(chunks: DataFrame, registry: Registry, queries: list[tuple[str, list | None]], most: int | None = None) -> DataFrame:
    """lexical_hits() of chunks that have no stored postings: those of the queries' lexemes are made on the way.

    Every place counts as it is, and all of a lexeme's do, unless only the first `most` are to.
    """
    only = {term for _, t in queries if t is not None for term in tsquery.all_terms(t)}
    return lexical_hits(postings(chunks, registry, only=only, last=None, most=most), chunks, queries)


def lexical_hits(posts: DataFrame, chunks: DataFrame, queries: list[tuple[str, list | None]]) -> DataFrame:
    """query_id, chunk_id, score of every match. chunks: the searchable chunk ids (live, current, filtered)."""
    spark = posts.sparkSession
    trees = {q: t for q, t in queries if t is not None}
    wanted = [(q, term) for q, t in trees.items() for term in sorted(tsquery.all_terms(t))]
    lexemes = spark.createDataFrame(wanted, "query_id string, lexeme string")
    # the lexemes reach the scan as a filter; the join is with a table of the queries' terms
    found = posts.where(F.col("lexeme").isin(sorted({t for _, t in wanted})) if wanted else F.lit(False))
    found = found.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(F.broadcast(lexemes), "lexeme")
    held = found.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("lexeme", "entries")).alias("held"))
    free = [q for q, t in trees.items() if not tsquery.needs_term(t)]
    if free:
        every = chunks.select("chunk_id").withColumn("query_id", F.explode(F.array(*[F.lit(q) for q in free])))
        held = every.join(held, ["query_id", "chunk_id"], "left").unionByName(held.where(~F.col("query_id").isin(free)))
    plan = json.dumps(trees)

    @arrow_udf("struct<hit:boolean,score:double>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trees = json.loads(plan)
        for ids, lists in batches:
            hits, scores = [], []
            for q, terms in zip(ids.to_pylist(), lists, strict=True):  # a row at a time: a batch's places as objects would take much memory
                entries = {t["lexeme"]: [(e["place"], e["weight"]) for e in t["entries"]] for t in terms.as_py() or []}
                hit = tsquery.evaluate(trees[q], {t: [p for p, _ in e] for t, e in entries.items()})
                hits.append(hit)
                scores.append(tsquery.rank_cover(trees[q], entries) if hit else 0.0)
            yield pa.StructArray.from_arrays([pa.array(hits, pa.bool_()), pa.array(scores, pa.float64())], ["hit", "score"])

    judged = held.withColumn("j", judge.asNondeterministic()("query_id", "held"))
    return judged.where("j.hit").select("query_id", "chunk_id", F.col("j.score").alias("score"))


def stored_trigrams(chunks: DataFrame) -> DataFrame:
    """trigram_table() of chunks whose ids are unique: within each row, without a shuffle."""
    padded = F.split(padded_words(F.col("content")), "\n")
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    words = F.rlike(F.col("content"), F.lit(WORD))
    return chunks.where(words).select("chunk_id", F.explode(F.array_distinct(grams)).alias("gram"))


def trigram_table(chunks: DataFrame) -> DataFrame:
    """chunk_id, gram: distinct trigrams of each chunk's words, for blocking."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("content"), F.lit(f"({WORD})"), 1), F.lower))
    padded = chunks.select("chunk_id", F.explode(words).alias("w")).select("chunk_id", F.concat(F.lit("  "), "w", F.lit(" ")).alias("p"))
    grams = F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3)))
    return padded.select("chunk_id", F.explode(grams).alias("gram")).distinct()


def padded_words(content: Column) -> Column:
    """The words of a text, lower-cased and padded as for trigrams, one after the other with line breaks between."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(f"({WORD})"), 1), F.lower))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" "))), "\n")


def fuzzy_hits(chunks: DataFrame, grams: DataFrame | None, terms: list[tuple[str, str]], threshold: float = 0.3) -> DataFrame:
    """query_id, chunk_id, score: the best word similarity of a query's terms of 4 letters and more, if it reaches the threshold.

    Blocking: a chunk must share at least threshold of a term's distinct trigrams, which any extent that reaches it does.
    They are looked up in a stored trigram table, or without one counted in each chunk, row by row.
    """
    from ..functions.text import trigrams

    spark = chunks.sparkSession
    terms = sorted({(q, t) for q, t in terms if len(t) >= 4})
    if grams is None:
        least = lambda t: F.lit(threshold) * F.lit(len(set(trigrams(t))))
        common = lambda t: sum((F.contains("padded", F.lit(g)).cast("int") for g in sorted(set(trigrams(t)))), F.lit(0))
        shared = [F.when(common(t) >= least(t), F.struct(F.lit(q).alias("query_id"), F.lit(t).alias("term"))) for q, t in terms]
        rows = chunks.select("chunk_id", "content", padded_words(F.col("content")).alias("padded"))
        found = rows.select("chunk_id", "content", F.explode(F.array_compact(F.array(*shared))).alias("x")) if shared else rows.select("chunk_id", "content", F.struct(F.lit("").alias("query_id"), F.lit("").alias("term")).alias("x")).limit(0)
        pairs = found.select("x.query_id", "x.term", "chunk_id", "content")
    else:
        rows = [(q, t, g, len(set(trigrams(t)))) for q, t in terms for g in set(trigrams(t))]
        wanted = F.broadcast(spark.createDataFrame(rows, "query_id string, term string, gram string, n int"))
        close = grams.where(F.col("gram").isin(sorted({g for _, _, g, _ in rows}))).join(wanted, "gram")
        close = close.groupBy("query_id", "term", "chunk_id", "n").agg(F.count_distinct("gram").alias("common")).where(F.col("common") >= F.lit(threshold) * F.col("n"))
        pairs = close.select("query_id", "term", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for b in batches:
            if len(known) > MEMO:
                known.clear()
            yield pd.DataFrame({"query_id": b["query_id"], "chunk_id": b["chunk_id"], "score": [word_similarity(t, c, threshold, known) for t, c in zip(b["term"], b["content"], strict=True)]})

    scored = pairs.select("query_id", "chunk_id", "term", "content").mapInPandas(run, "query_id string, chunk_id string, score double")
    return scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).where(F.col("score") >= threshold)
