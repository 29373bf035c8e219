"""The registered queries of the training-data operators: thin digests over the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (
    compact_windows,
    hamming_tables,
    language_id,
    line_dedup,
    lsh_forest,
    mixing,
    prefix_trie,
    repair,
    resampling,
    suffix_merge,
    surrogates,
    url_rules,
    winnowing,
)
from ledgerlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_tables": lambda s, d: hamming_tables.near_vectors(table(s, d, "embeddings")),
    "op2_kneser_ney": lambda s, d: language_id.language_report(table(s, d, "documents")),
    "op3_minhash_forest": lambda s, d: lsh_forest.near_duplicates(table(s, d, "documents")),
    "op4_url_rules": lambda s, d: url_rules.judged_urls(table(s, d, "pages"), table(s, d, "labels")),
    "op5_repair_tokens": lambda s, d: repair.token_report(table(s, d, "documents")),
    "op6_suffix_merge": lambda s, d: suffix_merge.repeat_report(table(s, d, "documents")),
    "op7_compact_windows": lambda s, d: compact_windows.passage_report(table(s, d, "documents")),
    "op8_winnowing": lambda s, d: winnowing.contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_surrogates": lambda s, d: surrogates.surrogate_report(table(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.mixed_report(table(s, d, "documents")),
    "op11_prefix_trie": lambda s, d: prefix_trie.trie_report(table(s, d, "conversations")),
    "op12_line_dedup": lambda s, d: line_dedup.line_report(table(s, d, "documents")),
    "op13_resampling": lambda s, d: resampling.resampling_report(table(s, d, "documents"), table(s, d, "benchmark")),
}
