"""Language identification by compression: one raw-content zstandard dictionary per language.

A text, lower-cased and with all but letters as spaces, is compressed whole with each language's dictionary; the language
whose dictionary leaves the fewest bytes is the prediction. The margin is the gap to the runner-up as a share of the best
size; where it is under `min_margin` the operator rejects the prediction. Dictionaries are built from a bounded sample of
whole texts: about 2 * SAMPLE_DOCS labelled documents a language, by a hash of their ids, none longer than a quarter of a
dictionary; taken in the order of that hash, as many as fit into DICTIONARY_BYTES.

Nulls: a null text, and one without any letter, is `und` with score 0. Documents without a language are not learned
from; if none can be learned from, every prediction is `und`. Ties go to the language that sorts first. Repeated rows
are predicted alike. Very long texts are compressed whole. Empty tables give no rows. identify() keeps all columns and
adds _lang, with underscores after it where the documents have such a column.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, fresh, held_out, letter_words, sample_hash

#: Bounds of the sample that dictionaries are built from.
SAMPLE_DOCS = 320
DICTIONARY_BYTES = 131_072
#: Languages at most; a table with more distinct values is an error, as each costs a compression of every text.
MAX_LANGUAGES = 200

LEVEL = 3

_LETTER = regex.compile(r"\p{L}")


def normalise(text: str) -> bytes:
    """What is compressed: lower-cased letters, one space for each run of anything else."""
    return b" ".join(letter_words(text))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary per language. docs: doc_id, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, DICTIONARY_BYTES // 4))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # a share of each language's ids that holds about twice SAMPLE_DOCS: bounded, and no language meets in one task
    spread = 1 << 30
    cut = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(spread, math.ceil(spread * 2 * SAMPLE_DOCS / n)))) for k, n in counts.items()])
    order = sample_hash()
    sample = rows.where(F.pmod(order, F.lit(spread)) < cut).select("lang", F.pmod(order, F.lit(spread)).alias("o"), "text")
    held: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in sample.collect():
        held[r["lang"]].append((r["o"], r["text"]))
    out = {}
    for lang, texts in sorted(held.items()):
        parts, size = [], 0
        for _, text in sorted(texts):
            data = normalise(text)
            if data and size + len(data) < DICTIONARY_BYTES:
                parts.append(data)
                size += len(data) + 1
        if parts:
            out[lang] = b" ".join(parts)
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.by = []
        for lang in self.langs:
            data = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False))

    def sizes(self, text: str) -> list[int]:
        data = normalise(text)
        return [len(c.compress(data)) for c in self.by]


def _predict(model: Classifier, texts: list, min_margin: float) -> dict[str, list]:
    langs, scores, rejected = [], [], []
    for text in texts:
        if not text or not model.langs or not _LETTER.search(text):
            langs.append("und")
            scores.append(0.0)
            rejected.append(True)
            continue
        sizes = model.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / sizes[best]
        langs.append(model.langs[best])
        scores.append(1 - math.exp(-min(margin * 20, 0.5 * (rest - sizes[best]) + 0.05)))
        rejected.append(margin < min_margin)
    return {"lang": langs, "score": scores, "rejected": rejected}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """The documents with a struct column _lang: lang (best, und without letters), score, rejected (narrow margin)."""
    if sum(map(len, dictionaries.values())) > MAX_LANGUAGES * DICTIONARY_BYTES:
        raise ValueError("dictionaries are too large to send")
    types = {"lang": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    udf = batch_udf(lambda model, texts: _predict(model, texts, min_margin), "struct<lang:string,score:double,rejected:boolean>", types, lambda: Classifier(sent.value))
    return docs.select("*", udf(F.col("text").cast("string")).alias(fresh(docs, "_lang")))


def op2_language_id(docs: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", "text", "lang")
    model = learn(plain.where(~held_out()))
    found = identify(plain.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))
