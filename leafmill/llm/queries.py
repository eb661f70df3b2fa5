"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, decontaminate, language_model, line_dedup, packing, quality, sharding, simhash, spelling, token_counts, token_orc, warc, word_runs


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_two_pass_shards(spark, sf_dir):
    return sharding.round_trip(table(spark, sf_dir, "documents"))


def op3_qgram_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_orc(spark, sf_dir):
    return token_orc.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op6_word_piece_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_lattice_lm(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_best_two_fit(spark, sf_dir):
    return packing.best_two_fit(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_line_dedup(spark, sf_dir):
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_trie_bpe(spark, sf_dir):
    path = vocabulary("word_bpe_49k.json")
    return bpe_trie.digest(bpe_trie.decode(bpe_trie.encode(table(spark, sf_dir, "documents"), path), path))


def op12_word_runs(spark, sf_dir):
    return word_runs.digest(word_runs.find_runs(word_runs.with_known_runs(table(spark, sf_dir, "documents"))))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_two_pass_shards, op3_qgram_decontamination, op4_warc, op5_token_orc, op6_word_piece_counts, op7_lattice_lm, op8_best_two_fit, op9_line_dedup, op10_simhash, op11_trie_bpe, op12_word_runs, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op4_warc": warc.ORACLE}
