"""The registered queries of this subpackage: thin calls with production
parameters over the whole tables, and their DuckDB SQL where SQL can express
them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from msgscope.llm import bpe, bwt, langid, leaks, ledger, lines, near, quality, rans, repair, substring, treebpe, trie
from msgscope.sources.tables import read_table


def op1_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(read_table(spark, sf_dir, "documents"))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(read_table(spark, sf_dir, "documents"))


def op3_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rule_digest(read_table(spark, sf_dir, "documents"))


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op9_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.window_digest(read_table(spark, sf_dir, "documents"))


def op10_suffix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.byte_digest(read_table(spark, sf_dir, "documents"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.round_trip_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.damage(read_table(spark, sf_dir, "conversations")))


def op13_ternary_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_digest(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_spread, op2_probminhash, op3_cgk_leaks, op4_rans_tokens, op5_pairwise_quality, op6_rule_ledger,
        op7_byte_cnn_language, op8_byte_bpe, op9_substring_windows, op10_suffix_bytes,
        op11_tree_bpe, op12_run_length_repair, op13_ternary_trie,
    )
}
ORACLE: dict[str, str] = {
    "op1_line_spread": lines.digest_sql(),
    "op6_rule_ledger": ledger.digest_sql(),
    "op9_substring_windows": substring.digest_sql(),
    "op10_suffix_bytes": bwt.digest_sql(),
    "op13_ternary_trie": trie.digest_sql(),
}
