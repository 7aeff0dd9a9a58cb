"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fableguard.llm import exact_dedup, hard_negatives, language_id, licenses, lm_scoring, mixing, near_dup, pii, prefix_trie, sentencepiece, sharding, vector_search, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_permutation_sharding": sharding.op1_permutation_sharding,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_language_codes": language_id.op3_language_codes,
        "op4_candidate_boosting": pii.op4_candidate_boosting,
        "op5_dictionary_warc": warc.op5_dictionary_warc,
        "op6_approximation_search": vector_search.op6_approximation_search,
        "op7_pivotal_mixing": mixing.op7_pivotal_mixing,
        "op8_sentencepiece": sentencepiece.op8_sentencepiece,
        "op9_partial_matching": lm_scoring.op9_partial_matching,
        "op10_token_group_join": near_dup.op10_token_group_join,
        "op11_radix_trie": prefix_trie.op11_radix_trie,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_residue_negatives": hard_negatives.op13_residue_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_permutation_sharding": sharding.sql(),
        "op2_exact_dedup": exact_dedup.SQL,
        "op5_dictionary_warc": warc.SQL,
        "op6_approximation_search": vector_search.SQL,
        "op10_token_group_join": near_dup.SQL,
        "op11_radix_trie": prefix_trie.SQL,
        "op13_residue_negatives": hard_negatives.SQL,
    }
