"""The corpus operators as queries over whole tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, langid, linededup, packing, quality, simhash, suffixdedup, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": lambda s, d: chat.op1_chat_format(table(s, d, "conversations"), public_tokenizers.path("byte_bpe_50k.json")),
        "op2_language_id": lambda s, d: langid.op2_language_id(_docs(s, d)),
        "op3_toxicity": lambda s, d: toxicity.op3_toxicity(_docs(s, d), table(s, d, "labels")),
        "op4_packing": lambda s, d: packing.op4_packing(_docs(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op5_line_dedup": lambda s, d: linededup.op5_line_dedup(_docs(s, d)),
        "op6_decontamination": lambda s, d: decontam.op6_decontamination(_docs(s, d), table(s, d, "benchmark")),
        "op7_ann": lambda s, d: ann.op7_ann(table(s, d, "embeddings")),
        "op8_suffix_dedup": lambda s, d: suffixdedup.op8_suffix_dedup(_docs(s, d)),
        "op9_simhash": lambda s, d: simhash.op9_simhash(_docs(s, d)),
        "op10_quality": lambda s, d: quality.op10_quality(_docs(s, d), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "op5_line_dedup": linededup.ORACLE, "op6_decontamination": decontam.ORACLE}
