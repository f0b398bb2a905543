"""The queries and SQL that this subpackage adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, licenses, manifest, packing, pieces, quality, repair, sharding, simhash, suffix, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (simhash.op1_simhash_vptree, suffix.op2_suffix_array, quality.op3_quality_mcd, tokens.op4_unigram_trie, packing.op5_variable_packing, chat.op6_chat_rendering, sharding.op7_extendible_hashing, licenses.op8_license_scan, decontaminate.op9_latent_decontamination, language.op10_language_mixture, manifest.op11_merkle_manifest, repair.op12_structure_repair, pieces.op13_sentencepiece_spans)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_rendering": chat.OP6_SQL, "op7_extendible_hashing": sharding.OP7_SQL, "op8_license_scan": licenses.op8_sql(), "op11_merkle_manifest": manifest.op11_sql(), "op12_structure_repair": repair.op12_sql()}
