"""The registered queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from siltworks.llm import bpe, codes, idstore, langid, leaks, lm, quality, repair, secrets, shards, simhash, suffix, wordbpe
from siltworks.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    return idstore.round_trip(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op5_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_word_bpe(spark, sf_dir):
    return wordbpe.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_token_ids, op4_suffix_dedup, op5_lm_score, op6_secret_scan, op7_simhash, op8_decontamination, op9_byte_bpe, op10_sharding, op11_conversation_repair, op12_word_bpe, op13_vector_codes)}
SQL = {"op1_quality_rules": quality.SQL}
