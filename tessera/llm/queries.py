"""One query for each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    alignment, bpe, chat_format, decontamination, licenses, ngram_join, phrases, quality, simhash_trie, substring_dedup, topk_search, toxicity, url_filter,
)
from tessera.llm.common import scan


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(scan(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_ngram_join": ngram_join.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_bpe": op5_bpe,
    "op6_topk_search": topk_search.query,
    "op7_quality": quality.query,
    "op8_toxicity": toxicity.query,
    "op9_licenses": licenses.query,
    "op10_chat_format": chat_format.query,
    "op11_simhash": simhash_trie.query,
    "op12_phrases": phrases.query,
    "op13_alignment": alignment.query,
}
SQL: dict[str, str] = {
    "op4_url_filter": url_filter.SQL,
    "op6_topk_search": topk_search.SQL,
    "op10_chat_format": chat_format.SQL,
    "op12_phrases": phrases.SQL,
}
