"""The engine's operators as queries over the test tables, each with its DuckDB equivalent where SQL can express it.

Mapping: documents are documents of the collection `source` in the locale `lang`, deleted where doc_id divides by 17, with
the labels as metadata; embeddings are chunk vectors; events are requests, provider calls, backlog rows and jobs;
conversations are markdown with headings; benchmark passages are golden queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..config import Settings
from ..engine import Engine
from ..functions import normalise, snippets, text, tsquery
from ..functions.chunking import chunk_table
from ..functions.normalise import Registry
from ..functions.rulesets import LIGATURES, UNMARK
from ..runtime import spread
from ..operators import backlog, evaluation, fusion, ingest, lexical, metadata, reads, vectors
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


NOW = "2024-01-20 00:00:00"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the engine's columns; each has one revision and, as its texts have no blank line, one chunk."""
    labels = t(spark, sf, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("metadata"))
    rows = t(spark, sf, "documents").join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("number"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("collection_id"),
        F.col("doc_id").cast("string").alias("external_key"),
        F.col("lang").alias("locale"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.lit(1).alias("current_revision"),
        F.when(F.col("doc_id") % 17 == 0, now()).alias("deleted_at"),
        text.document_hash(F.substring_index("text", "\n", 1), F.col("text")).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("revision"), F.lit(0).alias("ordinal"), F.col("text").alias("content"))


_D = """d AS (SELECT doc_id AS number, CAST(doc_id AS VARCHAR) AS id, source AS collection_id, CAST(doc_id AS VARCHAR) AS external_key, lang AS locale,
  string_split(text, chr(10))[1] AS title, text AS content, doc_id % 17 = 0 AS deleted, quality, toxic,
  sha256(CAST(length(string_split(text, chr(10))[1]) AS VARCHAR) || chr(31) || string_split(text, chr(10))[1] || text) AS content_hash
  FROM documents LEFT JOIN labels USING (doc_id))"""

# --- normalisation -----------------------------------------------------------------------------------------------

_UP, _LOW = normalise.UPPER, normalise.LOWER
_FROM, _TO = "".join(UNMARK), "".join(UNMARK.values())


def _folded(name: str, build: Callable[[Column], Column], sql: str) -> None:
    @query(name, f"SELECT doc_id, CAST(length({sql}) AS INT) AS n, sha256({sql}) AS digest FROM documents")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = build(F.col("text"))
        return t(spark, sf, "documents").select("doc_id", out.alias("x")).select("doc_id", F.length("x").alias("n"), digest(F.col("x")).alias("digest"))


_SPACED = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
_DROPPED = ["the", "of", "and", "la", "de", "der", "die", "que"]
_in = ", ".join(f"'{w}'" for w in _DROPPED)

_folded("norm_ascii_lower", normalise.lower_ascii, f"translate(text, '{_UP}', '{_LOW}')")
_folded("norm_fold_map", lambda c: normalise.map_chars(c, UNMARK), f"translate(text, '{_FROM}', '{_TO}')")
_folded("norm_map_expand", lambda c: normalise.map_chars(c, {"ß": "ss", "e": "3"}), "replace(replace(text, 'ß', 'ss'), 'e', '3')")
_folded("norm_strip_marks", lambda c: normalise.strip_categories(c, ["DecimalDigitNumber", "OtherPunctuation"]), r"regexp_replace(text, '[\p{Nd}\p{Po}]', '', 'g')")
_folded("norm_collapse_ws", normalise.collapse_whitespace, _SPACED.format("text"))
_folded("norm_drop_tokens", lambda c: normalise.drop_tokens(c, _DROPPED), f"array_to_string(list_filter(string_split({_SPACED.format('text')}, ' '), lambda w: w NOT IN ({_in})), ' ')")
_star = "lower(text)"
for _a, _b in LIGATURES.items():
    _star = f"replace({_star}, '{_a}', '{_b}')"
_STAR = _SPACED.format(f"translate({_star}, '{_FROM}', '{_TO}')")
_folded("norm_pipeline_star", lambda c: Registry().sets["*"].column(c), _STAR)


@query("norm_map_sequences", "SELECT doc_id, sha256(replace(text, 'tion', 'X')) AS digest FROM documents")
def norm_map_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", normalise.map_sequences(F.col("text"), {"tion": "X"}).alias("x")).select("doc_id", digest(F.col("x")).alias("digest"))


@query(
    "norm_by_locale",
    f"""SELECT doc_id, sha256({_STAR}) AS digest FROM documents""",
)
def norm_by_locale(spark: SparkSession, sf: str) -> DataFrame:
    reg = Registry()
    return t(spark, sf, "documents").select("doc_id", digest(reg.by_locale(F.col("lang"), lambda r: r.column(F.col("text")))).alias("digest"))


@query(
    "stem_prefixes",
    f"""WITH w AS (SELECT doc_id, list_transform(list_filter(string_split({_SPACED.format('text')}, ' '), lambda x: length(x) > 4), lambda x: substring(x, 1, 4)) AS p FROM documents),
  f AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM w) GROUP BY doc_id, x),
  g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM f GROUP BY doc_id)
  SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, sha256(coalesce(s, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)""",
)
def stem_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    out = t(spark, sf, "documents").select("doc_id", normalise.prefixes(F.col("text"), 4).alias("x"))
    return out.select("doc_id", F.when(F.col("x") == "", 0).otherwise(F.size(F.split("x", " "))).alias("n"), digest(F.col("x")).alias("digest"))


# --- identifiers, hashes, checks ---------------------------------------------------------------------------------


@query(
    "locale_normalize_wellformed",
    r"""SELECT doc_id, replace(lower(trim(raw)), '_', '-') AS locale, regexp_full_match(replace(lower(trim(raw)), '_', '-'), '[a-z]{2,3}(-[a-z0-9]{2,8})*') AND length(trim(raw)) <= 35 AS ok
    FROM (SELECT doc_id, '  ' || upper(lang) || '_' || CASE doc_id % 4 WHEN 0 THEN upper(source) WHEN 1 THEN 'x' WHEN 2 THEN 'a_bc' ELSE 'GB_oxendict' END AS raw FROM documents)""",
)
def locale_normalize_wellformed(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 4
    raw = F.concat(F.lit("  "), F.upper("lang"), F.lit("_"), F.when(m == 0, F.upper("source")).when(m == 1, "x").when(m == 2, "a_bc").otherwise("GB_oxendict"))
    return t(spark, sf, "documents").select("doc_id", text.locale_column(raw).alias("locale")).withColumn("ok", text.is_locale_column(F.col("locale")))


@query("model_slug", r"SELECT doc_id, substring(trim(regexp_replace(lower('Model ' || source || ' / ' || lang || ' (v.' || doc_id || ')!'), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug FROM documents")
def model_slug(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("Model "), "source", F.lit(" / "), "lang", F.lit(" (v."), F.col("doc_id").cast("string"), F.lit(")!"))
    return t(spark, sf, "documents").select("doc_id", text.model_slug(raw).alias("slug"))


@query(
    "identifier_checks",
    r"""SELECT page_id, regexp_full_match(name, '[a-z_][a-z0-9_]{0,62}') AS sql_ok, regexp_full_match(url, '[A-Za-z0-9\-_.:]{1,128}') AS correlation_ok
    FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '9' ELSE '' END || 'table_' || page_id AS name FROM pages)""",
)
def identifier_checks(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "9").otherwise(""), F.lit("table_"), F.col("page_id").cast("string"))
    return t(spark, sf, "pages").select("page_id", text.is_sql_identifier(name).alias("sql_ok"), text.is_correlation_id(F.col("url")).alias("correlation_ok"))


_BODIES = """b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN repeat('k', 129) ELSE CAST(doc_id AS VARCHAR) END AS external_key,
  CASE WHEN doc_id % 7 = 0 THEN 'not a tag' ELSE lang END AS locale, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS content, CASE WHEN doc_id % 19 = 0 THEN '{broken' ELSE '{}' END AS metadata FROM documents)"""


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    return t(spark, sf, "documents").select(
        "doc_id",
        F.when(n % 11 == 0, "  ").when(n % 13 == 0, "k" * 129).otherwise(n.cast("string")).alias("external_key"),
        F.when(n % 7 == 0, "not a tag").otherwise(F.col("lang")).alias("locale"),
        F.lit(None).cast("string").alias("title"),
        F.when(n % 5 == 0, " ").otherwise(F.col("text")).alias("content"),
        F.when(n % 19 == 0, "{broken").otherwise("{}").alias("metadata"),
    )


@query(
    "key_validation",
    f"""WITH {_BODIES}, e AS (SELECT doc_id, CASE WHEN trim(external_key) = '' THEN 'external key is blank' WHEN length(external_key) > 128 THEN 'external key is longer than 128'
    WHEN locale = 'not a tag' THEN 'locale is not well formed' WHEN trim(content) = '' THEN 'content is blank' WHEN metadata <> '{{}}' THEN 'metadata is not JSON' END AS error FROM b)
    SELECT doc_id, CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS INT) AS status, coalesce(error, '') AS error FROM e""",
)
def key_validation(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validated(_bodies(spark, sf)).select("doc_id", "status", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "bulk_tally",
    f"""WITH {_BODIES} SELECT CAST(CASE WHEN trim(external_key) = '' OR length(external_key) > 128 OR locale = 'not a tag' OR trim(content) = '' OR metadata <> '{{}}' THEN 400 ELSE 200 END AS INT) AS status, count(*) AS n FROM b GROUP BY 1""",
)
def bulk_tally(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validated(_bodies(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("doc_hash", f"WITH {_D} SELECT number, content_hash FROM d")
def doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("number", "content_hash")


@query("chunk_hash", "SELECT doc_id, sha256(source || chr(31) || lang || chr(10) || text) AS h, sha256(chr(10) || text) AS no_path FROM documents")
def chunk_hash(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.chunk_hash(F.array("source", "lang"), F.col("text")).alias("h"), text.chunk_hash(F.array().cast("array<string>"), F.col("text")).alias("no_path"))


@query("cache_keys", "SELECT doc_id, sha256('chunk' || text) AS chunk_key, sha256('query' || text) AS query_key FROM documents")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.embedding_key(F.col("text")).alias("chunk_key"), text.query_key(F.col("text")).alias("query_key"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS INT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


# --- full text ---------------------------------------------------------------------------------------------------

_TOK = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
_P = f"w AS (SELECT doc_id, lang, {_TOK.format(_STAR)} AS ws FROM documents)"


def _searchable(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where(F.col("doc_id") % 17 != 0).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("locale"), F.col("text").alias("source"), F.col("text").alias("content"))


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("locale"), F.col("text").alias("source"))


@query("tokenize_postings", f"WITH {_P} SELECT doc_id, lexeme, least(count(*), 256) AS n, CAST(least(min(place), 16383) AS INT) AS first_place FROM (SELECT doc_id, unnest(ws) AS lexeme, generate_subscripts(ws, 1) AS place FROM w) GROUP BY 1, 2")
def tokenize_postings(spark: SparkSession, sf: str) -> DataFrame:
    posts = lexical.postings(_all(spark, sf), Registry())
    posts = posts.select(F.col("chunk_id").cast("long").alias("doc_id"), "lexeme", F.size("entries").cast("long").alias("n"), F.col("entries")[0]["place"].alias("first_place"))
    return posts


def _lexical(name: str, text_query: str, where: str, rank: str | None = None) -> None:
    score = f", {rank} AS score" if rank else ""

    @query(name, f"WITH {_P} SELECT doc_id{score} FROM w WHERE doc_id % 17 <> 0 AND {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _searchable(spark, sf)
        hits = lexical.search(rows, Registry(), [("q", tsquery.parse(text_query))])
        return hits.select(F.col("chunk_id").cast("long").alias("doc_id"), *([F.round("score", 6).alias("score")] if rank else []))


_lexical("lexical_single_term", "with", "list_contains(ws, 'with')", "CAST(list_count(list_filter(ws, lambda x: x = 'with')) AS DOUBLE)")
_lexical("lexical_and", "with from", "list_contains(ws, 'with') AND list_contains(ws, 'from')")
_lexical("lexical_or", "with or mit", "(list_contains(ws, 'with') OR list_contains(ws, 'mit'))")
_lexical("lexical_not", "with -from", "list_contains(ws, 'with') AND NOT list_contains(ws, 'from')")
_lexical("lexical_only_not", "-the", "NOT list_contains(ws, 'the')")
_lexical("lexical_phrase", '"of the"', "contains(' ' || array_to_string(ws, ' ') || ' ', ' of the ')")
_lexical("lexical_mixed", '"of the" -with or "de la"', "((contains(' ' || array_to_string(ws, ' ') || ' ', ' of the ') AND NOT list_contains(ws, 'with')) OR contains(' ' || array_to_string(ws, ' ') || ' ', ' de la '))")


@query(
    "lexical_top10",
    f"""WITH {_P}, s AS (SELECT doc_id, lang, CAST(list_count(list_filter(ws, lambda x: x = 'the')) AS DOUBLE) AS score FROM w
    JOIN labels USING (doc_id) WHERE doc_id % 17 <> 0 AND lang IN ('de', 'en') AND quality = 1 AND list_contains(ws, 'the'))
    SELECT doc_id, lang AS locale, score FROM s ORDER BY score DESC, CASE WHEN lang = 'de' THEN 0 ELSE 1 END, CAST(doc_id AS VARCHAR) LIMIT 10""",
)
def lexical_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Live, of the locale chain, with the metadata filter; score, then the primary locale, then the id."""
    docs = documents(spark, sf)
    rows = reads.live(docs).where(F.col("locale").isin("de", "en") & metadata.contains(F.col("metadata"), {"quality": 1}))
    rows = rows.select(F.col("id").alias("chunk_id"), "locale", F.col("content").alias("source"))
    hits = lexical.search(rows, Registry(), [("q", tsquery.parse("the"))]).join(rows.select("chunk_id", "locale"), "chunk_id")
    top = hits.orderBy(F.desc("score"), fusion.locale_rank(F.col("locale"), ["de"]), "chunk_id").limit(10)
    return top.select(F.col("chunk_id").cast("long").alias("doc_id"), "locale", F.round("score", 6).alias("score"))


@query("lexical_cover_rank")
def lexical_cover_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = _searchable(spark, sf)
    return lexical.search(rows, Registry(), [("a", tsquery.parse("with from")), ("b", tsquery.parse('"of the"'))])


@query(
    "fuzzy_blocking",
    r"""WITH w AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))) AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, substring(p, i, 3) AS gram FROM (SELECT doc_id, '  ' || x || ' ' AS p, unnest(generate_series(1, length(x) + 1)) AS i FROM (SELECT doc_id, unnest(ws) AS x FROM w)))
    SELECT doc_id, count(*) AS common FROM g WHERE gram IN ('  n', ' na', 'nat', 'ati', 'tio', 'ion', 'on ') GROUP BY doc_id""",
)
def fuzzy_blocking(spark: SparkSession, sf: str) -> DataFrame:
    grams = lexical.trigram_table(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    return grams.where(F.col("gram").isin(text.trigrams("nation"))).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("common"))


@query("fuzzy_trigram")
def fuzzy_trigram(spark: SparkSession, sf: str) -> DataFrame:
    rows = _searchable(spark, sf)
    return lexical.fuzzy_hits(rows, None, [("q", "nation"), ("q", "idiotic")], 0.45)


@query(
    "synonym_expand",
    r"""SELECT doc_id, array_to_string(list_filter(['idiot', 'clown', 'of the', 'scum'], lambda m: (hit AND NOT contains(p, ' ' || m || ' '))), ',') AS added
    FROM (SELECT doc_id, p, contains(p, ' idiot ') OR contains(p, ' clown ') OR contains(p, ' of the ') OR contains(p, ' scum ') AS hit FROM (SELECT doc_id, ' ' || """
    + _STAR
    + """ || ' ' AS p FROM documents))""",
)
def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    folded = Registry().sets["*"].column(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.concat_ws(",", text.expand_column(folded, ["idiot", "clown", "of the", "scum"])).alias("added"))


# --- metadata, locales, order ------------------------------------------------------------------------------------


@query("metadata_containment", f"WITH {_D} SELECT number FROM d WHERE quality = 1 AND toxic = 0")
def metadata_containment(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(metadata.contains(F.col("metadata"), {"quality": 1, "toxic": 0})).select("number")


@query(
    "metadata_containment_json",
    """SELECT event_id FROM events WHERE json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL""",
)
def metadata_containment_json(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with any key: containment of the empty object, and of nothing else."""
    return t(spark, sf, "events").where(metadata.contains(F.col("props"), {})).where(F.size(F.json_object_keys("props")) > 0).select("event_id")


@query("locale_chain_filter", f"WITH {_D} SELECT number, locale FROM d WHERE NOT deleted AND locale IN ('fr', 'en')")
def locale_chain_filter(spark: SparkSession, sf: str) -> DataFrame:
    chain = text.locale_chain("FR", {"fr": ["en"]})
    return reads.live(documents(spark, sf)).where(F.col("locale").isin(chain)).select("number", "locale")


@query(
    "final_order_locale_first",
    """SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, n_chars DESC, CAST(doc_id AS VARCHAR)) AS INT) AS place FROM documents ORDER BY place LIMIT 50""",
)
def final_order_locale_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("locale"), F.col("n_chars").cast("double").alias("score"))
    top = rows.orderBy(*fusion.final_order(["fr", "en"])).limit(50)
    return fusion.ranked(top, fusion.final_order(["fr", "en"]), []).select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("rank").alias("place"))


# --- vectors and fusion ------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit(0).alias("ordinal"), "embedding", "label")


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_KNN = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
k AS (SELECT query_id, vec_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CAST(vec_id AS VARCHAR)) AS n
  FROM (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings, q))"""


@query("vector_knn", f"WITH {_KNN} SELECT query_id, vec_id, round(score, 6) AS score FROM k WHERE n <= 10")
def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, sf), _vector_queries(spark, sf), 10).select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vector_floor", f"WITH {_KNN} SELECT query_id, count(*) AS n FROM k WHERE n <= 10 AND score >= 0.5 GROUP BY query_id")
def vector_floor(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.above_floor(vectors.nearest(_vectors(spark, sf), _vector_queries(spark, sf), 10), 0.5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vector_diagnostics",
    f"WITH {_KNN} SELECT count(*) AS rejected, round(max(score), 6) AS best_rejected FROM k WHERE n <= 10 AND score < 0.5",
)
def vector_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    got = vectors.rejected(vectors.nearest(_vectors(spark, sf), _vector_queries(spark, sf), 10), 0.5)
    return got.agg(F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.round(F.max("best_rejected"), 6).alias("best_rejected"))


@query("orphan_models", "SELECT 'm' || label AS model_slug, count(*) AS vectors FROM embeddings WHERE label >= 3 GROUP BY 1")
def orphan_models(spark: SparkSession, sf: str) -> DataFrame:
    stored = t(spark, sf, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_slug"))
    return vectors.orphan_models(stored, ["m0", "m1", "m2"])


@query("vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(text.dot(v, v)), 5).alias("norm"))


@query(
    "hash_embed",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents), h AS (SELECT doc_id, sha256(w) AS h FROM x)
    SELECT doc_id, CAST(('0x' || substring(h, 7, 2) || substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2))::UBIGINT % 128 AS BIGINT) AS bucket,
    CAST(sum(CASE WHEN ('0x' || substring(h, 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM h GROUP BY 1, 2""",
)
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.feature_weights(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", 128)


def _two_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("ordinal"), F.col("n_chars").cast("double").alias("a"), (F.col("doc_id") * 7919 % 1009).cast("double").alias("b"))
    a = rows.withColumn("score", F.col("a")).orderBy(F.desc("a"), "chunk_id").limit(50)
    b = rows.withColumn("score", F.col("b")).orderBy(F.desc("b"), "chunk_id").limit(50)
    order = [F.desc("score"), F.asc("chunk_id")]
    return fusion.ranked(a, order, []), fusion.ranked(b, order, [])


_LISTS = """a AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS r FROM documents QUALIFY r <= 50),
b AS (SELECT doc_id, CAST(doc_id * 7919 % 1009 AS DOUBLE) AS s, row_number() OVER (ORDER BY doc_id * 7919 % 1009 DESC, CAST(doc_id AS VARCHAR)) AS r FROM documents QUALIFY r <= 50),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score, a.r AS lr, b.r AS vr, a.s AS ls, b.s AS vs FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


@query("rrf_fuse", f"WITH {_LISTS} SELECT doc_id, round(score, 8) AS score FROM f")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(*_two_lists(spark, sf)).select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 8).alias("score"))


@query("rrf_explain", f"WITH {_LISTS} SELECT doc_id, CAST(coalesce(lr, 0) AS INT) AS lexical_rank, CAST(coalesce(vr, 0) AS INT) AS vector_rank, coalesce(ls, -1) AS lexical_score, coalesce(vs, -1) AS vector_score FROM f")
def rrf_explain(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(*_two_lists(spark, sf)).select(
        F.col("chunk_id").cast("long").alias("doc_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "vector_rank")], *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("lexical_score", "vector_score")]
    )


@query(
    "hybrid_search",
    f"""WITH {_P}, a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, CAST(doc_id AS VARCHAR)) AS r FROM
      (SELECT doc_id, least(list_count(list_filter(ws, lambda x: x = 'with')), 256) AS s FROM w WHERE doc_id % 17 <> 0 AND list_contains(ws, 'with')) QUALIFY r <= 50),
    v AS (SELECT vec_id AS doc_id, s, row_number() OVER (ORDER BY s DESC, CAST(vec_id AS VARCHAR)) AS r FROM
      (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 50) QUALIFY r <= 50),
    b AS (SELECT doc_id, r FROM v WHERE s >= 0.2),
    f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score, a.r AS lr, b.r AS vr FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT doc_id, lang AS locale, round(score, 8) AS score, CAST(coalesce(lr, 0) AS INT) AS lexical_rank, CAST(coalesce(vr, 0) AS INT) AS vector_rank FROM f JOIN documents USING (doc_id) WHERE doc_id % 17 <> 0 AND score >= 0.0093
    ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, f.score DESC, CAST(doc_id AS VARCHAR) LIMIT 20""",
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Words over all live documents and the nearest of all vectors above the floor, fused; the locale first, then limited.

    The vector of a document is the one with its id; what is asked for is the word "with" and vector 50.
    """
    rows = _searchable(spark, sf)
    found = lexical.search(rows, Registry(), [("q", tsquery.parse("with"))], most=lexical.MAX_PLACES).withColumn("ordinal", F.lit(0))
    words = fusion.ranked(found, [F.desc("score"), F.asc("chunk_id")], ["query_id"]).where(F.col("rank") <= 50)
    asked = t(spark, sf, "embeddings").where("vec_id = 50").select(F.lit("q").alias("query_id"), F.col("embedding").alias("q"))
    close = vectors.above_floor(vectors.nearest(_vectors(spark, sf), asked, 50), 0.2)
    near = fusion.ranked(close, fusion.fused_order(), ["query_id"])
    hits = fusion.fuse(words, near, 60, ["query_id"]).join(rows.select("chunk_id", "locale"), "chunk_id").where(F.col("score") >= 0.0093)
    top = hits.orderBy(*fusion.final_order(["de", "en"])).limit(20)
    return top.select(F.col("chunk_id").cast("long").alias("doc_id"), "locale", F.round("score", 8).alias("score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "vector_rank")])


@query(
    "search_lexical",
    f"""WITH {_P}, s AS (SELECT doc_id, least(list_count(list_filter(ws, lambda x: x = 'und')), 256) AS n,
      sha256(sha256(sha256('t' || chr(31) || 'all') || chr(31) || doc_id || chr(31) || 'de') || chr(31) || '1' || chr(31) || '0') AS chunk_id FROM w WHERE lang = 'de' AND list_contains(ws, 'und')),
    r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY n DESC, chunk_id) AS INT) AS position FROM s)
    SELECT position, CAST(doc_id AS VARCHAR) AS external_key, 'de' AS locale, round(1.0 / (60 + position), 8) AS score, position AS lexical_rank FROM r WHERE position <= 10""",
)
def search_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The API end to end: all documents are uploaded into new tables, then searched through the stored postings."""
    engine = Engine(spark, windows.shared_folder(spark), Settings(locales=["en", "fr", "de", "es"], table_buckets=4))
    engine.upsert_collection("t", "all")
    bodies = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("external_key"), F.col("lang").alias("locale"), F.col("text").alias("content"))
    engine.upsert_documents("t", "all", bodies)
    hits = engine.search("t", "all", "UND", "de", "lexical", explain=True).hits
    return hits.select("position", "external_key", "locale", F.round("score", 8).alias("score"), "lexical_rank")


# --- chunking, ingest --------------------------------------------------------------------------------------------


@query("chunk_paragraphs")
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"))
    return chunk_table(rows, "doc_id", "long").select("doc_id", "ordinal", "token_count", "content_hash", F.length("overlap").alias("overlap_chars"))


@query("chunk_headings")
def chunk_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as markdown: a title, and a section for each turn with its whole text."""
    blank = F.lit("")
    section = F.concat(F.lit("## "), F.coalesce(F.col("turn").cast("string"), blank), F.lit(" "), F.coalesce("role", blank), F.lit("\n\n"), F.coalesce("text", blank))
    docs = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("x"))
    docs = docs.select("conv_id", F.concat(F.lit("# conv "), F.coalesce(F.col("conv_id").cast("string"), blank), F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["s"]), "\n\n")).alias("content"))
    return chunk_table(docs, "conv_id", "long").select("conv_id", "ordinal", F.array_join("heading_path", " > ").alias("path"), "token_count", "content_hash", F.length("overlap").alias("overlap_chars"))


_OLD_NEW = """n AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)"""


def _new_old(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, sf, "documents")
    new = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit("r1").alias("normalizer_hash"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 4 <> 0").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("revision"), F.lit(0).alias("ordinal"),
        F.sha2(body.cast("binary"), 256).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "r0").otherwise("r1").alias("normalizer_hash"),
    )
    return new, old


@query("upsert_diff", f"WITH {_OLD_NEW} SELECT n.doc_id AS document_id, CASE WHEN o.h IS NULL THEN 'created' WHEN n.doc_id % 7 = 0 THEN 'refolded' ELSE 'reused' END AS status FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.h = o.h")
def upsert_diff(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.diff_chunks(*_new_old(spark, sf)).select("document_id", "status")


@query("upsert_diff_deleted", f"WITH {_OLD_NEW} SELECT 'c' || o.doc_id AS id FROM o ANTI JOIN n ON n.doc_id = o.doc_id AND n.h = o.h")
def upsert_diff_deleted(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _new_old(spark, sf)
    return ingest.stale_chunks(old, ingest.diff_chunks(new, old)).select("id")


@query(
    "upsert_changes",
    """WITH x AS (SELECT doc_id, sha256(CAST(length(source) AS VARCHAR) || chr(31) || source || text) AS h FROM documents),
    o AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN h ELSE 'old' END AS h, doc_id % 5 + 1 AS r FROM x WHERE doc_id % 3 <> 0)
    SELECT x.doc_id, o.h IS NULL OR o.h <> x.h AS changed, CAST(CASE WHEN o.h IS NULL OR o.h <> x.h THEN coalesce(o.r, 0) + 1 ELSE o.r END AS INT) AS revision FROM x LEFT JOIN o USING (doc_id)""",
)
def upsert_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents")
    bodies = docs.select("doc_id", F.col("doc_id").cast("string").alias("external_key"), F.col("lang").alias("locale"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit("{}").alias("metadata"), F.lit(0).alias("position"))
    h = text.document_hash(F.col("source"), F.col("text"))
    old = docs.where("doc_id % 3 <> 0").select(
        text.stable_id(F.lit("c"), F.col("doc_id").cast("string"), F.col("lang")).alias("id"), (F.col("doc_id") % 5 + 1).cast("int").alias("current_revision"),
        F.when(F.col("doc_id") % 2 == 0, h).otherwise("old").alias("content_hash"), F.when(F.col("doc_id") % 17 == 0, now()).alias("deleted_at"), now().alias("created_at"),
    )
    return ingest.changes(ingest.validated(bodies), old, "c").select("doc_id", "changed", "revision")


# --- reads -------------------------------------------------------------------------------------------------------


@query("list_documents_page", f"WITH {_D} SELECT external_key, locale, CAST(1 AS BIGINT) AS chunk_count FROM d WHERE NOT deleted AND collection_id = 'src3' AND (external_key, locale) > ('3', '') ORDER BY 1, 2 LIMIT 20")
def list_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("source_content_hash", F.lit(None).cast("string"))
    return reads.page(docs, chunks(spark, sf), "src3", cursor="3\x1f", limit=20).select("external_key", "locale", "chunk_count")


_PAIRS = """p AS (SELECT doc_id // 2 AS k, doc_id % 2 AS odd, doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE 'yy' END AS locale, sha256(text) AS h FROM documents)"""


@query(
    "list_stale_translations",
    f"""WITH {_PAIRS} SELECT y.doc_id FROM p y JOIN p x ON x.k = y.k AND x.odd = 0 WHERE y.odd = 1 AND x.doc_id % 17 <> 0 AND y.doc_id % 17 <> 0 AND (CASE WHEN y.doc_id % 3 = 0 THEN x.h ELSE 'before' END) <> x.h""",
)
def list_stale_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Odd documents are translations of the even ones before them; a third of them recorded the current hash."""
    docs = t(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("string").alias("external_key"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    docs = docs.withColumn("collection_id", F.lit("c")).withColumn("locale", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")).withColumn("deleted_at", F.when(F.col("doc_id") % 17 == 0, now()))
    source = docs.where("locale = 'xx'").select("external_key", F.col("content_hash").alias("s"))
    recorded = F.when(F.col("locale") == "yy", F.when(F.col("doc_id") % 3 == 0, F.col("s")).otherwise("before"))
    docs = docs.join(source, "external_key", "left").withColumn("source_content_hash", recorded).drop("s")
    return reads.live(reads.with_staleness(docs, "xx")).where("stale").select("doc_id")


@query("get_document_ambiguous", f"WITH {_D} SELECT CAST(number % 97 AS VARCHAR) AS external_key, count(DISTINCT locale) AS locales, count(DISTINCT locale) > 1 AS ambiguous FROM d WHERE NOT deleted GROUP BY 1")
def get_document_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return reads.locales_of(documents(spark, sf).withColumn("external_key", (F.col("number") % 97).cast("string")))


@query(
    "revision_history",
    """SELECT lang AS locale, CAST(r AS INT) AS revision, CAST(length(text) AS INT) AS length, sha256(text || r) AS content_hash FROM documents, (SELECT unnest([1, 2, 3]) AS r) WHERE source = 'src1' AND doc_id % 10 = 1""",
)
def revision_history(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("external_key", (F.col("number") % 10).cast("string"))
    rows = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("revision"), F.lit("").alias("title"), F.col("text").alias("content"))
    rows = rows.withColumn("content_hash", F.sha2(F.concat("content", F.col("revision").cast("string")).cast("binary"), 256)).withColumn("created_at", now())
    return reads.revisions(docs, rows, "src1", "1").select("locale", "revision", "length", "content_hash")


@query("list_collections", f"WITH {_D} SELECT collection_id AS key, count(*) FILTER (NOT deleted) AS documents FROM d GROUP BY 1")
def list_collections(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    keys = docs.select(F.col("collection_id").alias("id"), F.col("collection_id").alias("key")).distinct()
    return reads.document_counts(keys, docs).select("key", F.col("document_count").alias("documents"))


@query("stats_by_collection", f"WITH {_D} SELECT collection_id AS key, count(DISTINCT id) FILTER (NOT deleted) AS documents, count(*) AS chunks FROM d GROUP BY 1")
def stats_by_collection(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    keys = docs.select(F.col("collection_id").alias("id"), F.col("collection_id").alias("key")).distinct()
    return reads.stats_by_collection(keys, docs, chunks(spark, sf))


@query("stats_by_locale", f"WITH {_D} SELECT locale, count(DISTINCT id) FILTER (NOT deleted) AS documents, count(*) AS chunks, count(*) FILTER (number % 6 = 0 OR locale = 'es') AS stale_chunks FROM d GROUP BY 1")
def stats_by_locale(spark: SparkSession, sf: str) -> DataFrame:
    held = chunks(spark, sf).withColumn("normalizer_hash", F.when(F.col("id").cast("long") % 6 == 0, "before").otherwise("now"))
    expected = spark.createDataFrame([(x, "now") for x in ("en", "fr", "de")], "locale string, hash string")
    return reads.stats_by_locale(documents(spark, sf), held, expected)


@query("stats_totals", f"WITH {_D} SELECT count(*) FILTER (NOT deleted) AS documents, count(*) AS chunks, count(DISTINCT collection_id) AS collections FROM d")
def stats_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reads.totals(stats_by_collection(spark, sf))


# --- backlog, jobs, windows --------------------------------------------------------------------------------------


@query("backfill_missing_vectors", f"WITH {_D} SELECT id FROM d WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM embeddings WHERE CAST(vec_id * 2 AS VARCHAR) = d.id)")
def backfill_missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    held = t(spark, sf, "embeddings").select((F.col("vec_id") * 2).cast("string").alias("chunk_id"))
    return backlog.missing(chunks(spark, sf), documents(spark, sf), held).select("id")


def _backlog(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select(F.col("event_id").cast("string").alias("chunk_id"), F.col("event_type").alias("model_slug"), (F.col("event_id") % 12).cast("int").alias("attempts"), F.lit("before").alias("last_error"), F.col("ts").cast("timestamp").alias("next_attempt_at"))


@query("backlog_due", f"SELECT CAST(event_id AS VARCHAR) AS chunk_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}' AND event_id % 12 < 10 ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 100")
def backlog_due(spark: SparkSession, sf: str) -> DataFrame:
    return backlog.due(_backlog(spark, sf), "error", now()).select("chunk_id")


@query("backlog_depth", "SELECT event_type AS model_slug, count(*) AS depth FROM events GROUP BY 1")
def backlog_depth(spark: SparkSession, sf: str) -> DataFrame:
    return backlog.depth(_backlog(spark, sf))


@query(
    "backlog_backoff",
    f"""SELECT CAST(event_id AS VARCHAR) AS chunk_id, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 12 + 1 ELSE event_id % 12 END AS INT) AS attempts, CASE WHEN event_id % 5 = 0 THEN 'again' ELSE 'before' END AS last_error,
    CAST(epoch(CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{NOW}' + to_seconds(30 * (event_id % 12)) ELSE date_trunc('second', ts) END) AS BIGINT) AS due FROM events
    UNION ALL SELECT 'new', 1, 'first', CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT)""",
)
def backlog_backoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _backlog(spark, sf)
    failures = rows.where(F.col("chunk_id").cast("long") % 5 == 0).select("chunk_id", "model_slug", F.lit("again").alias("error"))
    failures = failures.unionByName(spark.createDataFrame([("new", "error", "first")], "chunk_id string, model_slug string, error string"))
    out = backlog.failed(rows, failures, now())
    return out.select("chunk_id", "attempts", "last_error", F.unix_seconds("next_attempt_at").alias("due"))


@query(
    "backlog_lease",
    f"""WITH c AS (SELECT event_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}' AND event_id % 12 < 10 ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 100)
    SELECT CAST(event_id AS VARCHAR) AS chunk_id, CAST(epoch(CASE WHEN event_id IN (SELECT event_id FROM c) THEN TIMESTAMP '{NOW}' + to_seconds(300) ELSE date_trunc('second', ts) END) AS BIGINT) AS due FROM events""",
)
def backlog_lease(spark: SparkSession, sf: str) -> DataFrame:
    rows = _backlog(spark, sf)
    return backlog.leased(rows, backlog.due(rows, "error", now()), now()).select("chunk_id", F.unix_seconds("next_attempt_at").alias("due"))


@query(
    "stale_jobs",
    f"""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR THEN 'failed' WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'running' ELSE 'succeeded' END AS state,
    CAST(CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR THEN 1 ELSE 0 END AS INT) AS errors FROM events""",
)
def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("succeeded")
    jobs = t(spark, sf, "events").select("event_id", state.alias("state"), F.array().cast("array<string>").alias("errors"), F.col("ts").cast("timestamp").alias("updated_at"))
    return backlog.reaped(jobs, now()).select("event_id", "state", F.size("errors").alias("errors"))


@query("rate_limit_window", "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2")
def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    return windows.request_counts(t(spark, sf, "events"), width="6 hours").select("user_id", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "requests")


@query("rate_limit_stream", ORACLES["rate_limit_window"])
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts from a Structured Streaming query with a watermark, run until it has read all events."""
    events = spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    got = windows.settled(windows.request_counts(events, width="6 hours"), windows.shared_folder(spark))
    return got.select("user_id", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "requests")


@query(
    "rate_limit_decisions",
    """SELECT event_id, CASE WHEN n <= 2 THEN 'admitted' WHEN n <= 3 THEN 'queued' ELSE 'rejected' END AS decision FROM
    (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) AS n FROM events)""",
)
def rate_limit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.admitted(t(spark, sf, "events"), 2, 1, width="6 hours").select("event_id", "decision")


@query(
    "circuit_breaker_window",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(k AS INT)) AS s FROM events, (SELECT unnest([0, 1, 2]) AS k))
    SELECT CAST(epoch(s) AS BIGINT) AS window_start, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, count(*) >= 10 AND count(*) FILTER (event_type = 'error') >= 0.25 * count(*) AS open FROM w GROUP BY s""",
)
def circuit_breaker_window(spark: SparkSession, sf: str) -> DataFrame:
    got = windows.failure_ratio(t(spark, sf, "events"), F.col("event_type") == "error", width="3 hours", slide="1 hour", ratio=0.25)
    return got.select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "calls", "failures", "open")


@query("latest_gauge", "SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1")
def latest_gauge(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest(t(spark, sf, "events")).select("user_id", F.round("value", 6).alias("value"))


# --- evaluation --------------------------------------------------------------------------------------------------

_CASES = """r AS (SELECT o_custkey AS case_id, o_orderpriority AS k, min(row_n) AS pos FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_n FROM orders) GROUP BY 1, 2),
p AS (SELECT case_id, k, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rank FROM r),
c AS (SELECT c_custkey AS case_id, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 3 END AS INT) AS max_rank FROM customer),
x AS (SELECT c.case_id, max_rank, CAST(coalesce(min(rank) FILTER (k IN ('1-URGENT', '5-LOW')), 0) AS INT) AS actual_rank FROM c LEFT JOIN p USING (case_id) GROUP BY 1, 2)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases, their orders in order as results, priorities as keys."""
    cases = t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")).alias("expect"), F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(3).alias("max_rank"))
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    results = t(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), position.alias("position"), F.col("o_orderpriority").alias("external_key"))
    return evaluation.case_ranks(cases, results)


@query("eval_cases", f"WITH {_CASES} SELECT case_id, actual_rank, actual_rank > 0 AND actual_rank <= max_rank AS passed FROM x")
def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", "actual_rank", "passed")


@query(
    "eval_report",
    f"""WITH {_CASES} SELECT count(*) AS total, count(*) FILTER (actual_rank > 0 AND actual_rank <= max_rank) AS passed, round(avg(CASE WHEN actual_rank = 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1,
    round(avg(CASE WHEN actual_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN actual_rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10,
    round(avg(CASE WHEN actual_rank > 0 THEN 1.0 / actual_rank ELSE 0 END), 6) AS mrr,
    avg(CASE WHEN actual_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END) >= 0.9 AND bool_and(max_rank <> 1 OR actual_rank = 1) AS meets FROM x""",
)
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluation.report(_cases(spark, sf))
    return got.select("total", "passed", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_10", "mrr")], "meets")


# --- snippets ----------------------------------------------------------------------------------------------------


@query("snippet_highlight")
def snippet_highlight(spark: SparkSession, sf: str) -> DataFrame:
    rules = Registry().sets["*"]

    @arrow_udf("struct<excerpt:string,spans:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            got = [snippets.excerpt(x or "", ["with", "mit", "avec"], rules) for x in b.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(got, pa.string()), pa.array([len(snippets.highlights(g, x or "")) for g, x in zip(got, b.to_pylist(), strict=True)], pa.int32())], ["excerpt", "spans"])

    return t(spark, sf, "documents").withColumn("s", run("text")).select("doc_id", "s.excerpt", "s.spans")


@query("tenant_lookup", f"WITH {_D} SELECT DISTINCT collection_id FROM d WHERE collection_id < 'src5' AND NOT deleted")
def tenant_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant's collections with live documents."""
    docs = documents(spark, sf)
    owner = F.when(F.col("collection_id") < "src5", "a").otherwise("b")
    collections = docs.select(F.col("collection_id").alias("id"), owner.alias("tenant_id")).distinct()
    return reads.live(reads.of_tenant(collections, docs, "a")[1]).select("collection_id").distinct()
