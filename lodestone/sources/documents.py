"""Document sources: markdown folders with front matter, JSON bodies, golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_locale_column, locale_column

DOCUMENT = "external_key string, locale string, title string, content string, metadata string, source_uri string, source_locale string, source_content_hash string"

#: The JSON body of one document, or of an item of a bulk request.
BODY = "externalKey string, locale string, title string, content string, sourceUri string, metadata string, sourceLocale string, sourceContentHash string"

GOLDEN = "collection string, locale string, mode string, cases array<struct<query:string,expect:array<string>,maxRank:int>>"

_FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def front_matter(text: Column) -> Column:
    """`key: value` lines between the leading dashes as a map; quotes are trimmed, of equal keys the last counts."""
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit("\"'")).alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def first_heading(text: Column) -> Column:
    """The text of the first line that starts with `# `, else null."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1)
    return F.when(found != "", F.trim(found))


def markdown_folder(spark: SparkSession, root: str) -> DataFrame:
    """All `<locale>/…/<name>.md` below root as documents; files without a locale folder or with a bad tag are skipped."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = root.rstrip("/").split("://")[-1]
    at = raw.select(F.col("value").alias("text"), F.element_at(F.split(F.col("_metadata.file_path"), base.replace(".", r"\.") + "/"), -1).alias("source_uri"))
    parts = F.split("source_uri", "/")
    found = at.where(F.size(parts) >= 2).withColumn("locale", locale_column(F.element_at(parts, 1))).where(is_locale_column(F.col("locale")))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")
    found = found.withColumn("external_key", stem).withColumn("meta", front_matter(F.col("text"))).withColumn("content", F.regexp_replace("text", _FRONT, ""))
    named = F.element_at(F.map_from_entries(F.transform(F.map_entries("meta"), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))), "title")
    title = F.when(named.isNull() | (named == F.col("external_key")), F.coalesce(first_heading(F.col("content")), F.col("external_key"))).otherwise(named)
    rest = F.map_filter("meta", lambda k, v: F.lower(k) != "title")
    return found.select("external_key", "locale", title.alias("title"), "content", F.to_json(rest).alias("metadata"), "source_uri", F.lit(None).cast("string").alias("source_locale"), F.lit(None).cast("string").alias("source_content_hash"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies, one a line."""
    return from_bodies(spark.read.schema(BODY).json(path))


def from_bodies(bodies: DataFrame) -> DataFrame:
    names = {"externalKey": "external_key", "sourceUri": "source_uri", "sourceLocale": "source_locale", "sourceContentHash": "source_content_hash"}
    return bodies.withColumnsRenamed(names).select("external_key", "locale", F.coalesce("title", "external_key").alias("title"), "content", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "source_uri", "source_locale", "source_content_hash")


def golden_sets(spark: SparkSession, path: str) -> DataFrame:
    """Cases of golden sets: collection, locale, mode, case_id, query, expect, max_rank."""
    sets = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    cases = sets.select("collection", "locale", "mode", F.posexplode("cases").alias("case_id", "case"))
    return cases.select("collection", "locale", "mode", "case_id", "case.query", "case.expect", F.coalesce("case.maxRank", F.lit(3)).alias("max_rank"))


def responses(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
